"""Diff tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIFFS_SCHEMA = "owner string, repo string, pr_number int, diff string"


def load_diffs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Diffs keyed by (owner, repo, pr_number).

    ``fmt='parquet'``: a landed table with those columns.  ``fmt='text'``:
    one ``<owner>/<repo>/<pr_number>.diff`` file per change, read whole.
    """
    if fmt == "parquet":
        return spark.read.schema(DIFFS_SCHEMA).parquet(path)
    if fmt == "text":
        # wholetext must be the keyword: text() would reset the option to False
        raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        p = F.input_file_name()
        pat = r"([^/]+)/([^/]+)/(\d+)\.diff$"
        return raw.select(F.regexp_extract(p, pat, 1).alias("owner"),
                          F.regexp_extract(p, pat, 2).alias("repo"),
                          F.regexp_extract(p, pat, 3).cast("int").alias("pr_number"),
                          F.col("value").alias("diff"))
    raise ValueError(fmt)


def write_diffs(diffs: DataFrame, path: str) -> None:
    """Land diffs as Parquet in one folder per owner and repo, the layout in which
    a reader of few repositories reads their folders only."""
    diffs.select("owner", "repo", "pr_number", "diff").write.mode("overwrite").partitionBy("owner", "repo").parquet(path)
