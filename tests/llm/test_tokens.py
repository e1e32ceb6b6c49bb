"""Token counts, the transducer and packing beside the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallybridge.llm import packing, queries, token_counts, transducer
from tallybridge.llm.bpe import opened, public_path

from .conftest import ODD_TEXTS, documents

NAME = "byte_bpe_50k.json"
SF = "/root/testdata/sf0.001"
PARTS = ["a", "the", " ", "  ", "\n", "'s", "'", "re", "'re", "l", "1", "23", ".", "!!", "é", "日",
         "<|endoftext|>", "<|end", "\r\n", " " * 90, "a" * 130, "ÃÂ" * 30, "=" * 90, "0" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_path(NAME))


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def mixed(seed, many):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 25))) for _ in range(many)]


def test_words_and_ids_equal_the_library(library):
    bpe = opened(public_path(NAME))
    signs = [f"a{chr(c)}{chr(c)}b 1{chr(c)}" for c in range(1, 0x3200)]
    for text in [*signs, *mixed(1, 500)]:
        assert bpe.encode(text) == np.array(library_ids(library, text), "<u4").tobytes(), repr(text)


@pytest.mark.parametrize("chunk,overlap", [(30, 4), (64, 18), (200, 40)])
def test_spliced_counts(library, chunk, overlap):
    bpe = opened(public_path(NAME))
    for text in mixed(chunk, 300):
        assert token_counts.count_tokens_in(text, bpe, chunk, overlap) == len(library_ids(library, text))


@pytest.mark.parametrize("block", [20, 33, 200])
def test_stream_equals_the_library(library, monkeypatch, block):
    monkeypatch.setattr(transducer, "BLOCK", 32)  # words longer than this are streamed
    bpe = opened(public_path(NAME))
    encoder = transducer.StreamEncoder(bpe)
    for text in mixed(block, 300):
        ids = transducer.encode_text(text, encoder, block)
        assert ids == np.array(library_ids(library, text), "<u4").tobytes()
        assert transducer.decode_ids(ids, bpe, 3) == text


def test_lookahead_suffices_for_any_merge_list():
    pick = random.Random(5)
    for round_ in range(120):
        alphabet = b"abc" if round_ % 2 else b"ab"
        tokens, merges = [bytes([c]) for c in alphabet], []
        for _ in range(pick.randint(3, 60)):
            a, b = pick.choice(tokens), pick.choice(tokens)
            if a + b not in tokens and len(a + b) <= 9:
                merges.append((a, b))
                tokens.append(a + b)
        machine = transducer.Transducer(merges, {t: i for i, t in enumerate(tokens)})
        for _ in range(40):
            word = bytes(pick.choice(alphabet) for _ in range(pick.randint(1, 300)))
            assert [*machine.push(word), *machine.finish()] == machine._encode(word)


def test_memory_does_not_follow_the_word():
    machine = transducer.StreamEncoder(opened(public_path(NAME))).transducer
    for _ in machine.push(b"ab" * 200_000):
        assert len(machine._held) <= machine.capacity
    machine.finish()


def test_odd_texts(spark, odd, empty, library):
    counts = token_counts.count_tokens(odd, NAME, keep=["doc_id"]).collect()
    assert len(counts) == len(ODD_TEXTS) + 1
    for row in counts:
        text = ODD_TEXTS[row.doc_id] or ""
        n = len(library_ids(library, text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 1024)
    coded = transducer.decode(transducer.encode(odd, NAME), NAME)
    assert [c for c in coded.columns if c.lower() == "ids"] == ["ids"]
    for row in coded.collect():
        text = ODD_TEXTS[row.doc_id] or ""
        assert bytes(row["ids"]) == np.array(library_ids(library, text), "<u4").tobytes()
        assert row.decoded == text
    assert token_counts.count_tokens(empty, NAME).count() == 0
    assert transducer.encode(empty, NAME).count() == 0
    assert packing.pack(empty, NAME).count() == 0


def test_other_libraries(spark):
    texts = documents(spark, [(0, "Hello world"), (1, None)])
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        rows = token_counts.count_tokens(texts, name).orderBy("doc_id").collect()
        assert rows[0].n_tokens >= 2 and rows[1].n_tokens == 0


def test_queries_equal_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = queries.op2_token_counts(spark, SF).collect()
    coded = queries.op8_bpe_transducer(spark, SF).collect()
    assert len(counts) == len(coded) == len(texts)
    for row in counts:
        assert row.n_tokens == len(library_ids(library, texts[row.doc_id]))
    for row in coded:
        ids = library_ids(library, texts[row.doc_id])
        raw = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def check_packing(rows, texts, library, window):
    """Every id in exactly one piece, digests right, sequences gapless; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = [*library_ids(library, texts[doc]), 0]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    used = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        used += at
    return 1 - used / (window * len(sequences))


def test_packing_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(queries.op6_packing(spark, SF).collect(), texts, library, 1024) < 0.01


def test_packing_with_a_length_that_most_share(spark, library):
    texts = {i: "same words again " * 12 for i in range(200)} | {
        200 + i: "a b c d " * i for i in range(60)
    }
    texts |= {900: None, 901: ""}
    df = documents(spark, list(texts.items()), clash=True)
    rows = packing.pack(df, NAME, window=64, slices=4).collect()
    assert check_packing(rows, texts, library, 64) < 0.01


def test_repeats_never_exceed_the_histogram():
    pick = np.random.default_rng(3)
    combos = packing.combinations(64, 4)
    assert set(combos.sum(axis=1)) == {64}
    for many in (0, 5, 400):
        histogram = np.bincount(pick.integers(1, 64, many), minlength=65)
        whole = packing.solve_repeats(histogram, combos)
        taken = np.zeros(65, int)
        for c, n in zip(combos, whole):
            np.add.at(taken, c[c > 0], n)
        assert (whole >= 0).all() and (taken <= histogram).all()
        if many == 400:
            assert taken[1:].sum() > many / 2
