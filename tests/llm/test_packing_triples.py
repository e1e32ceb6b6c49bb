"""Every combination of three lengths is there for packing."""

from __future__ import annotations

import numpy as np

from tallybridge.llm import packing


def test_all_triples_are_enumerated():
    window = 40
    brute = {
        (a, b, c)
        for a in range(1, window)
        for b in range(1, a + 1)
        for c in range(1, b + 1)
        if a + b + c == window
    }
    found = packing.combinations(window)
    assert {tuple(c) for c in found.tolist() if c[2]} == brute
    assert len(found) == len(brute) + window // 2
    held = np.bincount([15, 14, 11, 7], minlength=window + 1)
    assert packing.combinations(window, held=held).tolist() == [[15, 14, 11]]


def test_tails_without_a_round_length_fill_windows():
    histogram = np.zeros(1025, np.int64)
    histogram[[401, 333, 290]] = 70
    rows = packing.plan(histogram, packing.combinations(1024), 1024)
    assert sum(last - first for _, first, last, *_, residual in rows if not residual) == 210
    assert not any(row[-1] for row in rows)
