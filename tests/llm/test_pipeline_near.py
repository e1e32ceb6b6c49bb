"""The pipeline's near-duplicate stage at its own threshold, beside brute force."""

from __future__ import annotations

import corpus_pipeline as pipeline

from tallybridge.llm import minhash_dedup

from .conftest import documents
from .test_dedup import brute_components, shingle_set


def brute_kept(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i for i, c in brute_components(sets, links).items() if i == c}


def with_new_end(doc, words, many):
    return " ".join(words[: len(words) - many] + [f"end{doc}x{k}" for k in range(many)])


def test_copies_from_four_fifths_on_go(spark):
    rows = []
    for doc in range(0, 48, 2):  # 96 shingles, of which a copy replaces 0 to 23: 1.0 to 0.61 are shared
        words = [f"w{doc}x{k}" for k in range(100)]
        rows += [(doc, " ".join(words)), (doc + 1, with_new_end(doc, words, doc // 2))]
    expected = brute_kept(rows, 80)
    assert len(rows) > len(brute_kept(rows, 85)) > len(expected) > len(rows) // 2
    out = pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    assert {r.doc_id for r in out.collect()} == expected


def test_bands_follow_the_threshold():
    assert minhash_dedup.bands_for(minhash_dedup.PERCENT) == minhash_dedup.BANDS
    for percent in (50, 80, 85, 99):
        bands = minhash_dedup.bands_for(percent)
        assert (1 - (percent / 100) ** minhash_dedup.ROWS) ** bands < 1e-6
