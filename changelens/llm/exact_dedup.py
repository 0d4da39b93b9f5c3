"""Exact dedup by distributed MSD radix partitioning.

Texts are strings of bytes after lower-casing A-Z.  The first digit is the
byte length with the first code points, the next digits are ever longer runs
of successive bytes (eight times as long each round, so a text of n bytes
takes O(log n) rounds).  A round counts the rows of every (group, digit) with
a map-side combine; groups of one row leave, groups whose bytes are used up
are groups of equal texts, the rest go on.  Equality is decided by the bytes
alone; the SHA-256 in the result is output, never a key.

A group of copies that holds a third of all rows costs one counter per map
task; the join that hands group numbers back to rows is an inner (or left)
join with a unique right side, which adaptive execution splits when skewed.

Defined cases: null text counts as empty; null doc_id sorts below every
number; of rows with equal text and equal doc_id exactly one stays; an empty
table gives an empty result; extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, save, without

FIRST = 64        # code points in the first digit
GROWTH = 8        # each digit is this many times longer than the one before


def _normalise(batches):
    for b in batches:
        low = [bytes(x).lower() if x is not None else b"" for x in b.column("_text").to_pylist()]
        cols = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "_text"]
        names = [n for n in b.schema.names if n != "_text"]
        cols += [pa.array(low, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in low])]
        yield pa.RecordBatch.from_arrays(cols, names=names + ["_norm", "_sha"])


def _groups(docs: DataFrame, carry: list[str], names: list[str], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The saved rows (columns ``carry`` as ``names``, ``_rid``, ``_id``, ``_sha``), and of
    those in a group of equal texts ``_rid``, ``_n`` and ``_top``, which stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)],
        F.col(id_col).cast("long").alias("_id"),
        F.octet_length(text).cast("long").alias("_len"),
        F.translate(F.substring(text, 1, FIRST), upper, lower).alias("_digit"),
        *([] if text_col in carry else [F.encode(text, "UTF-8").alias("_text")]))
    # round 0: length and first code points.  Counting moves no text; handing out
    # the group numbers moves it once, by merge join at every size.
    groups = save(rows.groupBy("_len", "_digit").agg(F.count(F.lit(1)).alias("_n"))
                  .filter("_n > 1").select("_len", "_digit", F.monotonically_increasing_id().alias("_gid")))
    dealt = rows.join(groups.hint("merge"), ["_len", "_digit"], "left").drop("_digit")
    if text_col in carry:         # moved once, as the column that is carried
        dealt = dealt.withColumn("_text", F.encode(F.coalesce(F.col(names[carry.index(text_col)]), F.lit("")), "UTF-8"))
    schema = T.StructType([f for f in dealt.schema.fields if f.name != "_text"]
                          + [T.StructField("_norm", T.BinaryType()), T.StructField("_sha", T.StringType())])
    first = dealt.mapInArrow(_normalise, schema).withColumn("_norm", F.when(F.col("_gid").isNotNull(), F.col("_norm")))
    first = save(first.withColumn("_rid", F.monotonically_increasing_id()))
    live = first.filter(F.col("_gid").isNotNull()).select("_rid", "_id", "_len", "_gid", "_norm")
    longest = live.agg(F.max("_len")).first()[0] or 0
    ended = []
    # The first digit holds FIRST code points, so at least FIRST bytes are used up;
    # a text of fewer bytes has all its code points in the digit.
    offset, width = FIRST, FIRST * GROWTH
    used = [groups]
    while True:
        # a round's texts go once those that are left are stored; what ended keeps its ids
        ended.append(save(live.filter(F.col("_len") <= offset).select("_rid", "_id", "_gid")))
        if longest <= offset:
            break
        live = live.filter(F.col("_len") > offset)
        live = live.withColumn("_digit", F.substring("_norm", offset + 1, width))
        groups = save(live.groupBy("_gid", "_digit").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
                      .select("_gid", "_digit", F.monotonically_increasing_id().alias("_new")))
        live = save(live.join(groups, ["_gid", "_digit"])
                    .select("_rid", "_id", "_len", F.col("_new").alias("_gid"), "_norm"))
        discard(*used)
        used = [groups, live]
        offset, width = offset + width, width * GROWTH
    discard(*used)
    # a group number holds within its round only
    parts = [e.withColumn("_gid", F.struct(F.lit(i).alias("round"), "_gid")) for i, e in enumerate(ended)]
    same = parts[0]
    for p in parts[1:]:
        same = same.unionByName(p)
    tops = same.groupBy("_gid").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_id", "_rid")).alias("_top"))
    return first.select(*names, "_rid", "_id", "_sha"), same.join(tops, "_gid").select("_rid", "_n", "_top")


def mark_copies(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with ``_keep_id``, ``_size``,
    ``_kept`` and ``_sha`` (normalised text) for every row."""
    carry = docs.columns if carry is None else carry
    names = [f"_c{i}" for i in range(len(carry))]
    first, marked = _groups(docs, carry, names, id_col, text_col)
    out = first.join(marked, "_rid", "left")
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(carry, names)],
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_top._id")).alias("_keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("_size"),
        (F.col("_n").isNull() | (F.col("_top._rid") == F.col("_rid"))).alias("_kept"), "_sha")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    first, marked = _groups(docs, docs.columns, names, "doc_id", "text")
    gone = save(marked.filter(F.col("_top._rid") != F.col("_rid")).select("_rid"))
    return without(first.select(*names, "_rid"), gone, "_rid").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
