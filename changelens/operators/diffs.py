"""Diff tables: per-file explode, truncation and primary language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import with_computed_once
from ..functions.text import truncate_text
from .caps import top_n_per_key
from .languages import GENERIC_FRAMEWORK, GENERIC_LANGUAGE, attach_language

# Fixed values that must equal the reference's.
MAX_DIFF_CHARS = 15000
TRUNCATION_SUFFIX = "\n\n... (diff truncated for length)"
# "diff --git a/<path> b/" header; captures the extension.  Flags: m = per
# line, d = only "\n" ends a line, U = Unicode \w (Python's defaults).
DIFF_HEADER = r"(?mdU)^diff --git a/.+?(\.\w+) b/"


def truncate_diff(df: DataFrame, col: str = "diff", n: int = MAX_DIFF_CHARS,
                  suffix: str = TRUNCATION_SUFFIX) -> DataFrame:
    """Cut diffs longer than n code points (exactly n is kept) and flag them."""
    return (df.withColumn("diff_truncated", F.length(col) > n)
            .withColumn(col, truncate_text(col, n, suffix)))


def explode_diff_files(diffs: DataFrame, key: list[str], col: str = "diff") -> DataFrame:
    """One row per ``diff --git`` header: key columns, pos (0-based), ext.

    Paths without an extension and root dot-files give no row; ``x.d.ts`` gives
    ``.ts``; case is kept.  Runs inside the row (no shuffle).
    """
    return diffs.select(*key, F.posexplode(F.regexp_extract_all(col, F.lit(DIFF_HEADER), 1))
                        .alias("pos", "ext"))


def primary_language(files: DataFrame, key: list[str], keys: DataFrame | None = None,
                     order: str | list[str] = "pos") -> DataFrame:
    """Most frequent extension per key; ties go to the extension seen first.

    ``files``: key columns, ``order`` (position of the header), ``ext``.
    Two aggregates (both combined map-side, so a hot key is no problem): count
    and first position per (key, ext), then ``min_by`` per key on
    (-count, first position).  ``order`` may be several columns.  An unknown winner gets the generic language
    even when a known extension comes second; ``keys`` (optional) adds the
    keys without any header, also generic.
    """
    place = F.struct(*([order] if isinstance(order, str) else order))
    per_ext = files.groupBy(*key, "ext").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_pos"))
    best = (per_ext.groupBy(*key)
            .agg(F.min_by("ext", F.struct((-F.col("n")).alias("n"), "first_pos")).alias("ext"),
                 F.max("n").alias("ext_count")))
    if keys is not None:
        best = keys.select(*key).distinct().join(best, key, "left")
    out = attach_language(best, "ext")
    return out.select(*key, "ext", F.coalesce("ext_count", F.lit(0)).alias("ext_count"),
                      "language", "framework")


def with_primary_language(diffs: DataFrame, text=None) -> DataFrame:
    """Adds ext, ext_count, language and framework of each row's own diff, inside
    the row: the most frequent extension of its headers, the first one on ties."""
    text = F.col("diff") if text is None else text
    found = with_computed_once(diffs, _exts=F.regexp_extract_all(text, F.lit(DIFF_HEADER), 1))
    exts = F.col("_exts")
    counted = F.transform(F.array_distinct(exts), lambda e: F.struct(
        F.size(F.filter(exts, lambda x: x == e)).alias("n"), (-F.array_position(exts, e)).alias("at"), e.alias("ext")))
    found = with_computed_once(found, _best=F.array_max(counted))
    out = attach_language(found.withColumn("ext", F.col("_best.ext")), "ext")
    return out.withColumn("ext_count", F.coalesce("_best.n", F.lit(0)).cast("long")).drop("_exts", "_best")


def headers_within(frags: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """Fragments of a diff (one header each) that survive truncation at n.

    A diff stored as ordered fragments (``frag`` text) is cut at n characters
    before its headers are read.  A header counts only when its `` b/`` lies
    inside the first n characters.  Every fragment has at least one character,
    so only the first n fragments of a key can qualify: an exact salted
    top-n (``caps.top_n_per_key``) keeps a key with millions of fragments
    from landing whole in one task; the running offset is then computed over
    at most n rows per key.
    """
    head = top_n_per_key(frags, key, order, n, rank_col="_rn")
    run = Window.partitionBy(*key).orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    with_off = head.withColumn("_start", F.coalesce(F.sum(F.length("frag")).over(run), F.lit(0)))
    b_end = F.col("_start") + F.instr("frag", " b/") + 2
    return (with_off.filter((F.instr("frag", " b/") > 0) & (b_end <= n))
            .withColumnRenamed("_rn", "frag_no").drop("_start"))


__all__ = ["MAX_DIFF_CHARS", "TRUNCATION_SUFFIX", "DIFF_HEADER", "GENERIC_LANGUAGE",
           "GENERIC_FRAMEWORK", "truncate_diff", "explode_diff_files", "primary_language",
           "headers_within", "with_primary_language"]
