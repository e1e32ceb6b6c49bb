"""Every stage of the pipeline on what its predecessor kept, beside brute force."""

from __future__ import annotations

import corpus_pipeline as pipeline
import pytest
from tokenizers import Tokenizer

from tallybridge.llm import secrets, toxicity
from tallybridge.llm.bpe import public_path

from .conftest import ODD_TEXTS, documents
from .test_dedup import brute_near
from .test_native import all_spans
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def masked(text, spans):
    out, at = "", 0
    for a, _, b in spans:
        if a > at or not out:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def steps(spark):
    found, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        found.append((name, docs, out))
        docs = out
    return found


def test_columns_stay(steps):
    assert [name for name, *_ in steps] == [
        "language_id", "toxicity", "minhash_near_dedup", "secret_scan", "packing"
    ]
    for _, before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_languages(steps):
    _, before, after = steps[0]
    expected = {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in after.collect()} == expected


def test_toxic_documents_go(spark, steps):
    _, before, after = steps[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = toxicity.train(before, labels.where(~toxicity.held_out(labels))).scorer()
    expected = {r.doc_id for r in before.collect() if not score(r.text)[1]}
    assert {r.doc_id for r in after.collect()} == expected


def test_one_of_each_group_stays(steps):
    _, before, after = steps[2]
    _, component = brute_near([(r.doc_id, r.text) for r in before.collect()], pipeline.SIMILAR)
    assert {r.doc_id for r in after.collect()} == {i for i, c in component.items() if i == c}


def test_secrets_are_masked(steps):
    _, before, after = steps[3]
    ratios = secrets.train(secrets.samples_from(before))
    texts = {r.doc_id: r.text for r in before.collect()}
    out = {r.doc_id: r.text for r in after.collect()}
    assert out == {i: masked(t, all_spans(t, ratios)) for i, t in texts.items()}


def test_packing(steps):
    _, before, after = steps[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    library = Tokenizer.from_file(public_path(pipeline.TOKENIZER))
    assert check_packing(after.collect(), texts, library, 1024) < 0.01


def test_run_equals_the_stages(spark, steps):
    got = sorted(tuple(r) for r in pipeline.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in steps[-1][2].collect())


def test_stages_take_anything(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd, empty, documents(spark, [(1, t) for t in ODD_TEXTS])):
        docs = start
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).cache()
            docs.count()
