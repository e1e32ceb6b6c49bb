"""Near-duplicate operators and components beside brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tallybridge.llm import components, minhash_dedup, vector_dedup
from tallybridge.operators.stored import Workspace

from .conftest import ODD_TEXTS, documents


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_brute_force(spark):
    pick = random.Random(2)
    links = [(pick.randrange(400), pick.randrange(400)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2001 + i) for i in range(150)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components.connected_components(df, Workspace(spark)).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_components(nodes, [x for x in links if x[0] != x[1]])
    a, b = np.array(links[:220]).T
    expected = brute_components(range(400), links[:220])
    assert components.roots_of(400, a, b).tolist() == [expected[i] for i in range(400)]


def shingle_set(text):
    words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_near(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, brute_components(sets, links)


def edited(words, pick, many):
    words = list(words)
    for _ in range(many):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return words


def corpus():
    pick = random.Random(7)
    texts = [*ODD_TEXTS, "SAME Text", "same\ttext\n", "a b", "b a", "one two three four five", "One two three four FIVE"]
    for _ in range(40):
        base = [f"w{pick.randrange(3000)}" for _ in range(pick.randint(20, 300))]
        for _ in range(pick.randint(1, 6)):
            texts.append(" ".join(edited(base, pick, pick.randint(0, max(1, len(base) // 60)))))
    base = [f"h{i}" for i in range(200)]  # a large group, whose members link only through some
    texts += [" ".join(edited(base, pick, pick.randint(0, 5))) for _ in range(150)]
    texts += ["copy of copies " * 20] * 30
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicate_texts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_TEXTS", block)
    rows = corpus()
    sets, expected = brute_near(rows)
    df = documents(spark, [*rows, rows[20]], clash=True)
    out = minhash_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows) + 1
    for row in out:
        assert row.n_shingles == len(sets[row.doc_id])
        assert row.component_id == expected[row.doc_id], row.doc_id
        assert row.kept == (row.doc_id == row.component_id)


def test_no_documents(spark, empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_signatures_estimate_the_overlap():
    pick = np.random.default_rng(1)
    pool = pick.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.85):
        common = int(2000 * share / (1 + share))
        a, b = pool[:1000], np.concatenate([pool[:common], pool[1000 : 2000 - common]])
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        equal = (minhash_dedup.signature(a, 2048) == minhash_dedup.signature(b, 2048)).mean()
        assert abs(equal - jaccard) < 0.05


def test_bands_miss_next_to_nothing():
    assert (1 - 0.85**minhash_dedup.ROWS) ** minhash_dedup.BANDS < 1e-6


# -- vectors ---------------------------------------------------------------------------

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("n_links", T.StringType()),
    ]
)


def vector_rows():
    pick = np.random.default_rng(5)
    rows = []
    for label in range(3):
        for _ in range(60):
            centre = pick.normal(size=64)
            for _ in range(int(pick.integers(1, 6))):
                noise = pick.normal(size=64) * pick.choice([0.0, 0.05, 0.2, 0.27, 0.3])
                rows.append((centre + noise, label))
    hot = pick.normal(size=64)
    rows += [(hot + 0.2 * pick.normal(size=64), 1) for _ in range(80)]
    rows += [(hot, 1)] * 25 + [(2.5 * hot, 1), (-hot, 1)]
    out = [(i, np.float32(v).tolist(), label, "x") for i, (v, label) in enumerate(rows)]
    n = len(out)
    bad = [None, [], [0.0] * 64, [None] + [1.0] * 63, [math.nan] + [1.0] * 63, [math.inf] + [1.0] * 63]
    out += [(n + k, v, 1, "x") for k, v in enumerate(bad * 2)]
    out += [(n + 50, out[0][1], None, "x"), (n + 51, out[0][1], None, "x"), (n + 52, [1.0, 2.0], 1, "x"),
            (n + 53, [2.0, 4.0], 1, "x")]
    return out


def brute_vectors(rows):
    good = {}
    for i, v, label, _ in rows:
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good.setdefault((label, len(v)), []).append((i, np.array(v, np.float64)))
    links, many = [], dict.fromkeys((r[0] for r in rows), 0)
    for group in good.values():
        unit = np.array([v / np.linalg.norm(v) for _, v in group])
        for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1))):
            links.append((group[a][0], group[b][0]))
            many[group[a][0]] += 1
            many[group[b][0]] += 1
    return many, brute_components(many, links)


@pytest.mark.parametrize(("strip", "tile"), [(4096, 256), (64, 16), (7, 3)])
def test_near_duplicate_vectors_equal_brute_force(spark, monkeypatch, strip, tile):
    monkeypatch.setattr(vector_dedup, "STRIP", strip)
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rows = vector_rows()
    many, expected = brute_vectors(rows)
    out = vector_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(out) == len(rows)
    found = sum(r.n_links for r in out)
    assert all(r.n_links <= many[r.vec_id] for r in out)
    assert found >= 0.999 * sum(many.values())
    assert sum(r.component_id == expected[r.vec_id] for r in out) >= 0.999 * len(out)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_no_vectors(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_large_components_and_null_ids(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(4, [1e200, 1e200], "a"), (2, [2e200, 2e200], "a"), (3, [1e-200, 1e-200], "a"), (None, [1.0, 1.0], "a"),
            (9, [1.0, -1.0], "a")]
    out = {r.vec_id: tuple(r)[1:] for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert out == {2: (2, 2, True), 3: (2, 2, False), 4: (2, 2, False), 9: (0, 9, True), None: (0, None, True)}


def test_recall_at_the_threshold(spark):
    """Pairs a little above the threshold, where a miss is likeliest, among unrelated vectors."""
    pick = np.random.default_rng(11)
    rows = []
    for _ in range(700):
        centre, away = pick.normal(size=(2, 32))
        away -= centre * (centre @ away) / (centre @ centre)
        angle = math.acos(0.9301)
        turned = math.cos(angle) * centre / np.linalg.norm(centre) + math.sin(angle) * away / np.linalg.norm(away)
        rows += [(len(rows), centre.tolist(), 1), (len(rows) + 1, turned.tolist(), 1)]
    out = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    many, _ = brute_vectors([(*r, None) for r in rows])
    assert sum(r.n_links for r in out.collect()) >= 0.998 * sum(many.values()) > 1300


def test_strips_meet_within_the_window_alone(spark):
    rows = [(1, 2, 0, 0.0), (1, 2, 0, 1.0), (1, 2, 1, 1.5), (1, 2, 2, 2.5), (1, 2, 3, 9.0), (2, 2, 3, 0.0)]
    placed = spark.createDataFrame(rows, "label int, width int, strip long, lead double")
    met = vector_dedup._meetings(placed, 1.0).where("side = 0").select("label", "i", "j").collect()
    assert sorted(map(tuple, met)) == [(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 2), (1, 2, 2), (1, 3, 3), (2, 3, 3)]


def test_calibration_keeps_the_threshold():
    pick = np.random.default_rng(9)
    d = vector_dedup.distance_at(0.93)
    least = vector_dedup.calibrated()
    a = pick.normal(size=(20_000, vector_dedup.COUNTED)) * d
    hits = (np.abs(a) <= vector_dedup.WINDOW * d).sum(axis=1)
    assert (hits < least).mean() < 1e-3 and least > vector_dedup.COUNTED / 2
    left, right = pick.normal(size=(30, 8)), pick.normal(size=(40, 8))
    brute = (np.abs(left[:, None] - right[None]) <= 0.3).sum(axis=2)
    assert (vector_dedup.collisions(left, right, 0.3) == brute).all()
