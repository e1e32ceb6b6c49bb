"""The trie of conversations beside dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallybridge.llm import prefix_trie, queries
from tallybridge.operators.stored import Workspace

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns (role, text) of every conversation, in order."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))

    def place(turn):
        at, role, text = turn
        return at is not None, at or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]

    return {c: [t[1:] for t in sorted(turns, key=place)] for c, turns in convs.items()}


def rebuilt(convs):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 4
        return convs.get(c - c % 20 if c >= 0 else c + (-c) % 20, [])[:h] + convs[c][h:]

    return {c: one(c) for c in convs}


def brute(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    below, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves, saved = int(not children[node]), (len(members[node]) - 1) * words
        for child in children[node]:
            leaves, saved = leaves + below[child][0], saved + below[child][1]
        below[node] = leaves, saved
        ids = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved,
                    hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(map(str, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(given):
    kept = Workspace(given.sparkSession).store(given)
    return sorted(str(tuple(r)) for r in prefix_trie.nodes_with_ends(kept).select(*COLUMNS).collect())


def test_given_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = sorted(str(tuple(r)) for r in queries.op12_prefix_trie(spark, SF).collect())
    assert got == brute(rebuilt(ordered(map(tuple, rows))))


def conversations(seed, n=400):
    """Shared beginnings of all lengths, one hot first turn, one conversation that a third of the rows repeat."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        kind = rng.random()
        if kind < 0.33:
            turns = ["hot", "copy", "copy", "end"]
        elif kind < 0.6:
            turns = ["hot", *(rng.choice("ab") for _ in range(rng.randrange(12)))]
        else:
            turns = [f"w{rng.randrange(6)} two three" for _ in range(rng.randrange(1, 6))]
        rows += [(c, i, rng.choice(["user", None]) if i > 3 else "user", t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_hot_beginnings(spark, monkeypatch, crowd):
    monkeypatch.setattr(prefix_trie, "CROWD", crowd)
    rows = conversations(crowd)
    given = prefix_trie.paths(spark.createDataFrame(rows, SCHEMA))
    assert found(given) == brute(ordered(rows))
    assert found(prefix_trie.with_borrowed_beginnings(given, 20, 3)) == brute(rebuilt(ordered(rows)))


def test_nulls_ties_and_other_columns(spark):
    rows = [(1, None, "u", "z"), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, None, "a"), (1, 0, "", "a"), (2, 5, "u", None),
            (2, 5, "u", ""), (None, 1, "u", "lost"), (20, 0, "ab", "c"), (21, 0, "a", "bc"), (-7, 0, "u", "z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as path", "'y' as record", "1 as base", "2 as key")
    assert found(prefix_trie.paths(df)) == brute(ordered(rows))
    assert found(prefix_trie.with_borrowed_beginnings(prefix_trie.paths(df), 20, 3)) == brute(rebuilt(ordered(rows)))


def test_turnless_conversations_and_long_texts(spark):
    # conversation 20 has nothing to lend to those whose only turn is taken away
    rows = [(c, 0, "u", "long " * 50_000 if c % 2 else "short") for c in range(21, 60) if c % 20]
    given = prefix_trie.with_borrowed_beginnings(prefix_trie.paths(spark.createDataFrame(rows, SCHEMA)), 20, 3)
    want = brute(rebuilt(ordered(rows)))
    assert found(given) == want and any("0," in w for w in want)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(prefix_trie.paths(empty)) == []


def test_ids_in_blocks(spark, monkeypatch):
    ids = list(range(0, 3_000_000, 300))
    given = spark.createDataFrame([(i, b"") for i in ids], "conv_id long, path binary")
    (row,) = prefix_trie.ends(given).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_double_array():
    rng = random.Random(5)
    chains = sorted({tuple(rng.randrange(1, 40) for _ in range(rng.randrange(7))) for _ in range(900)})
    trie = prefix_trie.DoubleArray(chains)
    known = {c[:d] for c in chains for d in range(len(c) + 1)}

    def walk(chain):
        state = trie.ROOT
        for code in chain:
            state = trie.child(state, code)
            if state < 0:
                return None
        return state

    cells = {walk(c) for c in known}
    assert None not in cells and len(cells) == len(known)
    for chain in known:
        for code in range(1, 41):
            assert (walk((*chain, code)) is not None) == ((*chain, code) in known)
    # single children fill the gaps between siblings
    assert len(trie.check) < 2 * len(known)
