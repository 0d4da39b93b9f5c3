"""Mixing sources to target weights with hash-threshold histograms.

A document's rank within its source is a hash of its id.  Words are summed by
source and hash bucket; the bucket in which a source's budget runs out is
refined by the next hash bits, all other buckets are settled.  After the last
level the bucket is one hash value, which is the source's threshold: a document
is taken when its hash lies below.  Nothing is sorted, and the histogram of a
level has a fixed number of buckets per source, summed map-side, so a source
with a third of all rows is no hot key.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and
share 150 % of all words; a target stops at twice its source's words and the
excess goes to the others by weight, until none is above.  A source whose
target is k + f times its words is taken k times whole, and once more up to
the hash threshold for f.

Defined cases: null texts have size 0; null doc_id hashes like an empty id;
rows with one id share one hash and are taken together; a document of no words
follows its hash like any other; sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save, small_side, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
LEVELS, LEVEL_BITS = 4, 15       # 60 hash bits


def id_hash(c: Column) -> Column:
    """60 bits of the id's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source_size, target (sources: column ``source``, ``size``)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long"))
    # Sources reach their cap in the order of cap / weight, so the capped ones
    # are a prefix; whole numbers keep the comparison exact.
    order = Window.partitionBy(F.lit(0)).orderBy(
        (F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    dec = lambda c: c.cast("decimal(38,0)")
    per = per.select(
        "source", "source_size", "weight",
        # twice what is left to share when this source comes up
        (F.sum("source_size").over(Window.partitionBy(F.lit(0))) * int(2 * SHARE)
         - 2 * MAX_REPEAT * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left2"),
        F.sum("weight").over(after).alias("open_weight"),
        F.row_number().over(order).alias("rank"))
    capped = dec(2 * MAX_REPEAT * F.col("source_size")) * dec(F.col("open_weight")) <= dec(F.col("weight")) * dec(F.col("left2"))
    per = per.withColumn("capped", capped)
    first_open = F.first(F.when(~F.col("capped"), F.struct("left2", "open_weight")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("share", first_open)
    target = F.when(F.col("capped"), (MAX_REPEAT * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("share.left2")).cast("double") / (2 * F.col("share.open_weight")).cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(table: DataFrame) -> DataFrame:
    """Per source: source_size, target, whole (times), limit (hash), at_limit.

    ``table`` has source, size and hash.  The state has one row per source; it
    is written after each level, and broadcast while it is counted to be small.
    """
    per = targets(table)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = save(per.select(
        F.col("source").alias("_source"), "source_size", "target", whole.cast("int").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("last"))
        .withColumn("open", F.col("rest") > 0))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        edge = small_side(state.filter("open").select("_source", "prefix", "rest"))
        bucket = F.shiftright("hash", shift).alias("bucket")
        same_source = F.col("source").eqNullSafe(F.col("_source"))
        if level:
            rows = table.withColumn("_prefix", F.shiftright("hash", shift + LEVEL_BITS))
            inside = rows.join(edge, same_source & (F.col("_prefix") == F.col("prefix")))
            sums = inside.groupBy("_source", "rest", bucket).agg(F.sum("size").alias("size"))
        else:       # all rows are inside: sum first, join the sums
            sums = table.groupBy("source", bucket).agg(F.sum("size").alias("size")).join(edge, same_source)
        upto = Window.partitionBy("_source").orderBy("bucket")
        hit = (sums.withColumn("cum", F.sum("size").over(upto)).filter(F.col("cum") > F.col("rest"))
               .groupBy(F.col("_source").alias("_hit")).agg(F.min(F.struct("bucket", "cum", "size")).alias("hit")))
        found = F.col("open") & F.col("hit").isNotNull()
        state = save(state.join(hit, F.col("_source").eqNullSafe(F.col("_hit")), "left").select(
            "_source", "source_size", "target", "whole",
            F.when(found, F.col("rest") - (F.col("hit.cum") - F.col("hit.size"))).otherwise(F.col("rest")).alias("rest"),
            F.when(found, F.col("hit.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(found, F.col("hit.size")).otherwise(F.col("last")).alias("last"),
            found.alias("open")))
    # the value at the threshold is taken when at least half of it fits
    return state.select(
        F.col("_source").alias("source"), "source_size", "target", "whole",
        F.when(F.col("open"), F.col("prefix")).otherwise(-1).alias("limit"),
        (F.col("open") & (F.col("last") <= 2 * F.col("rest"))).alias("at_limit"))


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return save(docs.select(F.col(id_col).alias("doc_id"), F.col("source"), word_count(F.col(text_col)).alias("size"),
                            id_hash(F.col(id_col)).alias("hash")))


def _times(h: Column) -> Column:
    more = (h < F.col("limit")) | ((h == F.col("limit")) & F.col("at_limit"))
    return F.col("whole") + more.cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken."""
    table = _sized(docs.select(F.col(id_col), F.col("source"), F.col(text_col)), id_col, text_col)
    limits = small_side(thresholds(table).withColumnRenamed("source", "_source"))
    joined = table.join(limits, F.col("source").eqNullSafe(F.col("_source")))
    times = _times(F.col("hash")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", times.alias("times"),
                         (times * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a document taken twice is there twice."""
    table = _sized(docs.select("doc_id", "source", "text"), "doc_id", "text")
    src, = fresh(docs, "mix_source")
    limits = small_side(thresholds(table).withColumnRenamed("source", src))
    joined = docs.join(limits.select(src, F.struct("whole", "limit", "at_limit").alias(f"{src}_")),
                       F.col("source").eqNullSafe(F.col(src)))
    lim = F.col(f"{src}_")
    h = id_hash(F.col("doc_id"))
    times = lim["whole"] + ((h < lim["limit"]) | ((h == lim["limit"]) & lim["at_limit"])).cast("int")
    return (joined.withColumn(f"{src}_", F.explode(F.array_repeat(F.lit(1), times)))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS left2,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
c AS (SELECT *, 4 * source_size * open_weight <= weight * left2 AS capped FROM o),
u AS (SELECT max(left2) AS left2, max(open_weight) AS open_weight FROM c WHERE NOT capped),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN (2 * source_size)::DOUBLE
              ELSE (weight * u.left2)::DOUBLE / (2 * u.open_weight)::DOUBLE END AS target
  FROM c CROSS JOIN u),
k AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
r AS (
  SELECT d.*, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS cum,
         sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN rest > 0 AND (cum <= rest OR same <= 2 * (rest - (cum - same)) ) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
