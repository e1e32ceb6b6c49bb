"""What a Python worker is handed at a time, and what it keeps."""

from __future__ import annotations

import pyarrow as pa

from tallybridge.llm import batches, shipping
from tallybridge.llm.bpe import opened, public_path

from .conftest import documents


def test_a_task_is_handed_small_batches(spark):
    """12,000 texts of 2,000 bytes in one partition came as 20 MB at a time."""

    def sizes(given):
        for batch in given:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

    shipping.ship(spark)
    texts = spark.range(0, 12_000, 1, 1).selectExpr("id", "repeat('x', 2000) as text")
    found = texts.mapInArrow(sizes, "n long, b long").collect()
    assert sum(r.n for r in found) == 12_000
    assert max(r.b for r in found) <= 2 * shipping.BATCH_BYTES


def test_a_size_that_the_session_names_stays(spark):
    before = spark.conf.get(shipping.BATCH_SETTING)
    try:
        spark.conf.set(shipping.BATCH_SETTING, "12345678")
        shipping.ship(spark)
        assert spark.conf.get(shipping.BATCH_SETTING) in ("12345678", "12345678b")
    finally:
        spark.conf.set(shipping.BATCH_SETTING, before)


def test_a_vocabulary_goes_when_its_worker_turns_to_other_work():
    path = public_path("byte_bpe_50k.json")
    opened.cache_clear()
    batches.started(lambda: opened(path).encode)
    batches.started(lambda: opened(path).encode)
    assert opened.cache_info().currsize == 1
    batches.started(lambda: len)
    assert opened.cache_info().currsize == 0


def test_texts_longer_than_a_batch_come_whole(spark):
    text = "long words " * (shipping.BATCH_BYTES // 8)
    from tallybridge.llm import minhash_dedup

    rows = minhash_dedup.near_duplicates(documents(spark, [(1, text), (2, text), (3, "x")])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}
