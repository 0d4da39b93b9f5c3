"""Shared pieces of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path, ship_package, shuffles_dropped

# Fixed value: the characters that separate words.
BLANKS = "\\x20\\x09-\\x0D"
WORD_SPLIT = f"[{BLANKS}]+"
NOT_BLANK = f"[^{BLANKS}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read afresh (a table may change within a session)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed value: bits of the filters that spare moving texts.
FILTER_BITS = 1 << 23

# Folders of the tables saved and not discarded yet, in order.
_SAVED: list[str] = []


def save(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder, read it back.

    Cuts the lineage: after a lost executor a task re-reads files instead of
    recomputing its inputs, and columns not needed later are not read.  The
    folder is the one ``spark.checkpoint.dir`` names; ``discard`` deletes a
    table once nothing reads it any more.  Shuffle files of the job go with it.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, "llm-tables", spark.sparkContext.applicationId, uuid.uuid4().hex)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    _SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def roots(df: DataFrame) -> list[str]:
    """The folders that the scans of ``df`` read."""
    out = []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(k).toString() for k in range(paths.size())]
    return out


def saved_since(start: int) -> list[str]:
    """Folders saved since ``len(saved_since(0))`` was ``start``."""
    return _SAVED[start:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``save`` wrote."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if path in _SAVED:
            _SAVED.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete saved tables; only when no frame still to be computed reads them."""
    names = {p.rsplit("/", 1)[-1] for t in tables for p in roots(t)}
    for t in tables[:1]:
        delete(t.sparkSession, [p for p in _SAVED if p.rsplit("/", 1)[-1] in names])


def without(rows: DataFrame, gone: DataFrame, number: str) -> DataFrame:
    """The rows of ``rows`` whose ``number`` is not in ``gone`` (saved tables; numbers are
    never null).  A bitmap of fixed size tells most rows that stay, and they are not
    moved; of the rows that it does not tell, the join decides."""
    part, bit, bits = fresh(rows, "part", "bit", "bits")
    at = F.pmod(F.xxhash64(number), F.lit(FILTER_BITS)) + 1          # bit positions count from 1
    place = {part: F.bitmap_bucket_number(at), bit: F.bitmap_bit_position(at)}
    filled = save(gone.select(*[c.alias(n) for n, c in place.items()]).repartition(part)
                  .groupBy(part).agg(F.bitmap_construct_agg(bit).alias(bits)))
    # at most FILTER_BITS / 32768 rows of 4096 bytes
    told = rows.withColumns(place).join(F.broadcast(filled), part, "left")
    byte = F.conv(F.hex(F.substring(bits, F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    same = [F.col(f"`{c}`") for c in rows.columns]
    return told.filter(~maybe).select(*same).union(told.filter(maybe).select(*same).join(gone, number, "left_anti").select(*same))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"_{n}"
        while c.lower() in taken:
            c = "_" + c
        taken.add(c.lower())
        out.append(c)
    return out


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def small_side(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast when it has at most ``limit`` rows (counted)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def crc32_sql(text: str) -> str:
    """CRC-32 of a DuckDB string expression, bit by bit."""
    bits = "[-1, -1, -1, -1, -1, -1, -1, -1]"
    steps = (f"flatten([[4294967295]] || list_transform(range(1, strlen({text}) + 1), "
             f"lambda i: [('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT] || {bits}))")
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce({steps}, lambda c, x: {step}), 4294967295)"
