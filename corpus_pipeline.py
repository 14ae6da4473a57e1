"""From raw documents to token ids: language, near copies, mix, encoding.

Each stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringweave.llm import bpe, langid, mixing, simhash
from ringweave.llm.common import documents, importable
from ringweave.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: the stages are models and sketches, which SQL cannot express; the tests hold them against brute force
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those that the models reject go."""
    importable(spark)
    model = langid.train(docs)
    return langid.predictions(docs, model, keep=COLUMNS).where(~langid.F.col("rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    importable(spark)
    return simhash.one_of_each(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard."""
    importable(spark)
    return mixing.Mix(docs, keep_text=True).mixed_documents().select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    importable(spark)
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing_sources", mix_sources),
    ("bpe_encoding_decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
