"""Registered queries: diff tables (truncation, per-file explode, primary language).

Bindings: ``documents.text`` stands in for a diff (key = source, doc_id);
``events`` stand in for diff fragments of one change per user - each event
is one ``diff --git`` header plus one added line, in (ts, event_id) order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators import diffs as D
from ..operators.languages import GENERIC_FRAMEWORK, GENERIC_LANGUAGE, TEST_LANGUAGES
from .common import table

# Binding of the events table to file extensions (test binding, fixed).
EVENT_EXT = {"view": ".py", "click": ".js", "purchase": ".ts", "signup": ".tsx", "error": ".md"}


def _event_ext() -> F.Column:
    expr = F.lit(None).cast("string")
    for k, v in EVENT_EXT.items():
        expr = F.when(F.col("event_type") == k, F.lit(v)).otherwise(expr)
    return expr


def event_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    path = F.concat(F.col("event_type"), F.lit("/"), F.col("event_id").cast("string"), _event_ext())
    frag = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n+"), F.col("props"),
                    F.lit("\n"))
    return ev.select("user_id", "ts", "event_id", frag.alias("frag"))


def truncated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("diff"))
    t = D.truncate_diff(docs, "diff")
    return t.select("doc_id", "diff_truncated", F.length("diff").alias("n_chars"),
                    F.md5(F.col("diff")).alias("diff_md5"))


def blank_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return (conv.groupBy("role")
            .agg(F.count(F.lit(1)).alias("n_turns"),
                 F.sum(F.when(is_blank("text"), 1).otherwise(0)).cast("long").alias("n_blank")))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of all fragments of every change."""
    frags = event_fragments(spark, sf_dir).withColumnRenamed("frag", "diff")
    return D.explode_diff_files(frags, ["user_id", "ts", "event_id"])


def diff_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _headers(spark, sf_dir)
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"))


def diff_primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _headers(spark, sf_dir)
    keys = table(spark, sf_dir, "events").select("user_id")
    return D.primary_language(files, ["user_id"], keys=keys, order=["ts", "event_id"])


# --------------------------------------------------------------------------
# DuckDB twins
# --------------------------------------------------------------------------

def _sql_map(d: dict, col: str, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items())
    return f"CASE {col} {whens} ELSE {default} END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SUFFIX_SQL = "chr(10) || chr(10) || '... (diff truncated for length)'"

SQL_TRUNCATED = f"""
SELECT doc_id, length(text) > {D.MAX_DIFF_CHARS} AS diff_truncated,
       CAST(length(CASE WHEN length(text) > {D.MAX_DIFF_CHARS}
                   THEN substr(text, 1, {D.MAX_DIFF_CHARS}) || {_SUFFIX_SQL} ELSE text END) AS INTEGER) AS n_chars,
       md5(CASE WHEN length(text) > {D.MAX_DIFF_CHARS}
           THEN substr(text, 1, {D.MAX_DIFF_CHARS}) || {_SUFFIX_SQL} ELSE text END) AS diff_md5
FROM documents
"""

SQL_BLANK = """
SELECT role, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(sum(CASE WHEN text IS NULL OR length(regexp_replace(text, '\\s', '', 'g')) = 0
                THEN 1 ELSE 0 END) AS BIGINT) AS n_blank
FROM conversations GROUP BY role
"""

_SQL_KEPT = f"""
f AS (
  SELECT user_id, ts, event_id,
         'diff --git a/' || event_type || '/' || CAST(event_id AS VARCHAR) || ext || ' b/' ||
         event_type || '/' || CAST(event_id AS VARCHAR) || ext || chr(10) || '+' || props || chr(10) AS frag
  FROM (SELECT *, {_sql_map(EVENT_EXT, 'event_type')} AS ext FROM events)
  WHERE ext IS NOT NULL
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frag_no FROM f
),
k AS (
  SELECT user_id, frag_no, regexp_extract(frag, '^diff --git a/.+?(\\.\\w+) b/', 1) AS ext
  FROM o
),
h AS (SELECT * FROM k WHERE ext <> '')"""

SQL_DIFF_EXTENSIONS = f"""
WITH {_SQL_KEPT}
SELECT ext, CAST(count(*) AS BIGINT) AS n_files FROM h GROUP BY ext
"""

_LANG = {k: v[0] for k, v in TEST_LANGUAGES.items()}
_FW = {k: v[1] for k, v in TEST_LANGUAGES.items()}

SQL_PRIMARY_LANGUAGE = f"""
WITH {_SQL_KEPT},
c AS (SELECT user_id, ext, count(*) AS n, min(frag_no) AS first_pos FROM h GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_pos) AS rk FROM c),
b AS (SELECT user_id, ext, n FROM r WHERE rk = 1),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, b.ext, CAST(coalesce(b.n, 0) AS BIGINT) AS ext_count,
       {_sql_map({k: v.replace("'", "''") for k, v in _LANG.items()}, 'b.ext', _q(GENERIC_LANGUAGE))} AS language,
       {_sql_map({k: v.replace("'", "''") for k, v in _FW.items()}, 'b.ext', _q(GENERIC_FRAMEWORK))} AS framework
FROM u LEFT JOIN b ON b.user_id = u.user_id
"""

QUERIES = {
    "truncated_documents": truncated_documents,
    "blank_turns": blank_turns,
    "diff_extensions": diff_extensions,
    "diff_primary_language": diff_primary_language,
}

ORACLE = {
    "truncated_documents": SQL_TRUNCATED,
    "blank_turns": SQL_BLANK,
    "diff_extensions": SQL_DIFF_EXTENSIONS,
    "diff_primary_language": SQL_PRIMARY_LANGUAGE,
}
