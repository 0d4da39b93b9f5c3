"""Result sinks: idempotent per key / per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, path_exists


# Folders of a table that is written by key, fixed for its life: a key's folder follows from it.
KEY_FOLDERS = 256
_FOLDER = "key_folder"


def write_results(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  fmt: str = "parquet", key: list[str] | None = None, folders: int = KEY_FOLDERS) -> None:
    """Write a result table.  With ``partition_by`` only the partitions
    present in ``df`` are replaced (dynamic overwrite), so re-running a batch
    for the same keys replaces its rows instead of adding copies.  With ``key``
    the rows of ``df`` replace those of the same key (``replace_by_key``)."""
    if key:
        return replace_by_key(df, path, key, fmt, folders)
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def read_by_key(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table written by key, without its folder column."""
    return spark.read.format(fmt).load(path).drop(_FOLDER)


def replace_by_key(df: DataFrame, path: str, key: list[str], fmt: str = "parquet", folders: int = KEY_FOLDERS) -> None:
    """Rows of ``df`` in place of the table's rows of the same key (nulls are equal);
    several rows of a key stay together.  The other rows stay.

    The table is partitioned by a hash of the key.  Folders that ``df`` touches
    are found first (at most ``folders`` numbers), only they are read, their other rows are
    kept by an anti-join, and new and kept rows are written once to the
    checkpoint folder; Spark's dynamic overwrite then swaps these folders in when all files are
    written.  A write that fails before leaves the table as it was, and running it again
    gives the same table.
    """
    spark = df.sparkSession
    folder = F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(folders)).cast("int")
    new = df.withColumn(_FOLDER, folder)
    if path_exists(spark, path):
        new = materialize(new)
        touched = [r[0] for r in new.select(_FOLDER).distinct().collect()]
        old = spark.read.format(fmt).load(path).filter(F.col(_FOLDER).isin(touched))
        keys = new.select(_FOLDER, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).distinct().withColumnRenamed(_FOLDER, "_f")
        same = F.col(_FOLDER) == F.col("_f")
        for i, c in enumerate(key):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        new = materialize(new.unionByName(old.join(keys, same, "left_anti").select(new.columns)))
    (new.repartition(_FOLDER).write.mode("overwrite").format(fmt).partitionBy(_FOLDER)
     .option("partitionOverwriteMode", "dynamic").save(path))


def batch_writer(path: str, fmt: str = "parquet"):
    """``foreachBatch`` function writing each micro-batch to
    ``<path>/batch_id=<id>``; a retried batch overwrites its own folder, so
    the sink is exactly-once together with the stream checkpoint."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write
