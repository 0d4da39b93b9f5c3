"""Shared pieces of the registered queries: table access and unit bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table.  Column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows when the scan gives fewer partitions than cores.

    Heavy per-row text work (regex shingling, hashing) runs in the scan
    stage.  A large input already arrives in thousands of splits and is left
    alone; a small single-row-group file would otherwise run on one thread.
    For plain scans only: there the check is planning, while a plan with an
    exchange would run a job for it.
    """
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def documents_as_units(docs: DataFrame) -> DataFrame:
    """``documents`` bound to the unit schema: one unit per document.

    repo = source, file = doc id, group = lang, scan order = doc id.
    """
    return docs.select(
        F.col("doc_id").alias("unit_id"),
        F.col("source").alias("repo"),
        F.col("doc_id").cast("string").alias("file"),
        F.lit("<document>").alias("name"),
        F.lit(1).alias("start_line"),
        line_count("text").cast("int").alias("line_count"),
        F.col("lang").alias("lang_group"),
        F.col("text").alias("code"),
        F.length("text").alias("n_chars"),
        F.col("doc_id").alias("scan_ord"),
    )


# SQL twin of ``line_count`` for the DuckDB oracle.
SQL_LINE_COUNT = "(length({c}) - length(replace({c}, chr(10), '')) + 1)"


def sql_line_count(c: str) -> str:
    return SQL_LINE_COUNT.format(c=c)
