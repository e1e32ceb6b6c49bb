"""From raw documents to packed sequences: five stages, each one of the operators.

Every stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybridge.llm import language_id, minhash_dedup, packing, secrets, toxicity
from tallybridge.llm.batches import fresh_name
from tallybridge.operators.stored import Workspace

TOKENIZER = "byte_bpe_50k.json"
#: Near-duplicates share this many hundredths of their shingles; 85 is fixed for op5 alone.
SIMILAR = 80


def _documents(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select([f"`{c}`" for c in columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: those without a letter."""
    model = language_id.train(docs.where(~language_id.held_out(docs)))
    names = (fresh_name(docs, "lang_pred"), fresh_name(docs, "lang_score"))
    found = language_id.identify(docs, model, names=names)
    return _documents(found.where(F.col(names[0]) != language_id.UNDETERMINED), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it learns from the labels' training folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(labels)))
    names = (fresh_name(docs, "toxic_score"), fresh_name(docs, "toxic"))
    found = toxicity.score(docs, model, names=names)
    return _documents(found.where(F.col(names[1]) == 0), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    gone = minhash_dedup.near_duplicates(docs, percent=SIMILAR).where("not kept").select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay."""
    ratios = secrets.train(secrets.samples_from(docs))
    return _documents(secrets.redact(docs, ratios), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, TOKENIZER, packing.WINDOW)


STAGES = [
    ("language_id", identify_languages),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Not expressible in SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each result is written and read again."""
    workspace = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = workspace.store(stage(spark, docs, sf_dir))
    return docs
