"""Per-repo caps (first k files in listing order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Fixed values that must equal the reference's.
MAX_FILES = 25
MAX_FILES_FOR_ARCHITECTURE = 20


def cap_per_repo(files: DataFrame, k: int | None, repo: str = "repo", order: str = "ord") -> DataFrame:
    """First k files per repo by listing order; ``k=None`` keeps all.

    ``row_number() <= k`` is planned by Spark as a partial top-k per map task
    before the shuffle (WindowGroupLimit), so a repo holding a third of the
    files still ships at most k rows per task.  Adds ``rank_in_repo``.
    """
    w = Window.partitionBy(repo).orderBy(order)
    ranked = files.withColumn("rank_in_repo", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank_in_repo") <= k)


# Spark plans row_number() <= k as a partial top-k before the shuffle only up
# to this k (spark.sql.optimizer.windowGroupLimitThreshold, default 1000).
_PARTIAL_LIMIT_MAX = 1000


def top_n_per_key(df: DataFrame, key: list[str], order: list, n: int, salts: int = 64,
                  rank_col: str = "rank_in_key") -> DataFrame:
    """The first n rows per key by ``order`` (exact), with ``rank_in_key``.

    For n above Spark's partial-limit threshold a hot key would reach one
    task whole, so the cut runs in two levels: first per (key, salt), with
    salt a hash of the ordering columns spread over ``salts`` groups, then per
    key over at most n * salts rows.  Every row of the global first n is
    among the first n of its salt group, so the result is exact.
    """
    if n <= _PARTIAL_LIMIT_MAX:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order_cols), F.lit(salts)))
    w1 = Window.partitionBy(*key, "_salt").orderBy(*order)
    lvl1 = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(*key).orderBy(*order)
    return lvl1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= n)


def running_count(df: DataFrame, key: list[str], pos: str, flag, out: str = "running",
                  block: int = 4096) -> DataFrame:
    """Running count of ``flag`` rows per key in ``pos`` order (inclusive),
    exact and skew-safe for an integer position column.

    A plain window would put a key's rows in one task.  Here positions are
    cut into blocks: block totals are aggregated (map-side combined), their
    offsets come from a window over blocks only (rows / block per key), and
    the count inside a block is a window over at most ``block`` rows.
    """
    flag = F.col(flag) if isinstance(flag, str) else flag
    d = df.withColumn("_blk", F.floor(F.col(pos) / block)).withColumn("_f", flag.cast("long"))
    tot = d.groupBy(*key, "_blk").agg(F.sum("_f").alias("_bt"))
    wb = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wb), F.lit(0))).drop("_bt")
    wi = Window.partitionBy(*key, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (d.join(off, [*key, "_blk"])
            .withColumn(out, F.col("_off") + F.sum("_f").over(wi))
            .drop("_blk", "_f", "_off"))


def number_in_order(df: DataFrame, key: list[str], order: list[str], out: str = "ord") -> DataFrame:
    """``df`` with ``out``, the number from 1 of each row within its ``key`` by ``order``.

    No key's rows go to one task: rows are range-partitioned by (key, order),
    numbered inside their partition as they stand, and each partition's first
    number per key comes from counts (one row per key and partition).  The
    partitioned rows are written once to the checkpoint folder, so the ranges
    cannot differ between the two uses.
    """
    row = (1 << 33) - 1          # monotonically_increasing_id: partition * 2^33 + row
    placed = materialize(df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
                         .withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("_id", 33).alias("_part")).withColumn("_id", F.col("_id").bitwiseAND(row))
    counts = placed.groupBy(*key, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_key_{c}") for c in key], F.col("_part").alias("_p"),
                           (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return (placed.join(starts, same).withColumn(out, F.col("_id") + F.col("_start"))
            .drop("_id", "_part", "_p", "_start", *[f"_key_{c}" for c in key]))
