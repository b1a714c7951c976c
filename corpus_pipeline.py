"""Corpus cleaning: toxic documents go, near copies go, benchmark leaks go, secrets are
masked, and what is left is encoded.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlens.llm import common as C
from fieldlens.llm import containment, secrets, sentence_pieces, simhash_cover, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not reject."""
    return toxicity.without_toxic(docs, C.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash class (3-word shingles, 2 bits)."""
    return simhash_cover.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark`` (5-word shingles, 0.8)."""
    return containment.without_items(docs, C.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip, parity and ids of all documents."""
    import public_tokenizers

    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored in the shared folder."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.cut(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
