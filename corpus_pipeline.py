"""The corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``: the quality rules drop documents, the exact dedup
keeps one row of equal texts, the Jaccard join keeps one document of a group
of near copies, the mix drops and repeats documents to meet its sources'
targets, and packing gives one row per piece of a sequence.

Null and empty texts fail the quality rules; extra columns pass through to the
mix; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changelens.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from changelens.llm.common import delete, roots, save, saved_since
from changelens.session import ship_package

# Near copies: five words, similarity of 80 % or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules take for good."""
    ship_package(spark)
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the largest id, of equal texts."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship_package(spark)
    return mixing.apply_mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    import public_tokenizers
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


# (stage number, folders) that the last stage left behind.
_left: list = [-1, []]


def _stage(number: int, work):
    """A stage that first deletes the tables its predecessor saved on the way: the
    predecessor's output is stored by then, unless ``docs`` still reads them."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = {p.rsplit("/", 1)[-1] for p in roots(docs)}
        if _left[0] == number - 1 and not any(p.rsplit("/", 1)[-1] in read for p in _left[1]):
            delete(spark, _left[1])
        start = len(saved_since(0))
        out = work(spark, docs, sf_dir)
        _left[:] = [number, saved_since(start)]
        return out

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


STAGES = [(name, _stage(i, work)) for i, (name, work) in enumerate([
    ("quality rules", rules_stage), ("exact dedup", exact_stage), ("near copies", near_stage), ("mixing", mix_stage), ("packing", pack_stage)])]

# Expectation-maximisation and tokenizing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
