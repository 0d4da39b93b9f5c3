"""Registered queries: unit segmentation.

Bindings: ``conversations`` - a unit is one turn (file = conversation,
name = role, start line = turn, group = role), and a segment is a user turn
with the turns that follow it (running count of user turns per
conversation).  ``documents`` units come from ``common.documents_as_units``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count
from ..operators import dedup
from ..operators.caps import running_count
from ..operators import structure
from ..operators.units import segment_units
from .common import documents_as_units, spread, sql_line_count, table


def turn_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("unit_id"),
        F.lit("conversations").alias("repo"),
        F.col("conv_id").cast("string").alias("file"),
        F.col("role").alias("name"),
        F.col("turn").cast("int").alias("start_line"),
        line_count("text").cast("int").alias("line_count"),
        F.col("role").alias("lang_group"),
        F.col("text").alias("code"),
        F.length("text").alias("n_chars"),
        (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("scan_ord"))


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as one source file (built inside the row): user and system
    turns become a Python function whose body is the text, assistant turns a
    JavaScript function whose body is the text as line comments."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("reply_"), F.col("turn").cast("string"))
    py = F.concat(F.lit("def "), name, F.lit("():\n    "),
                  F.replace(F.col("text"), F.lit("\n"), F.lit("\n    ")), F.lit("\n"))
    js = F.concat(F.lit("function "), name, F.lit("() {\n  // "),
                  F.replace(F.col("text"), F.lit("\n"), F.lit("\n  // ")), F.lit("\n}\n"))
    is_js = F.col("role") == "assistant"
    return c.select(
        F.lit("conversations").alias("repo"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"),
                 F.when(is_js, F.lit(".js")).otherwise(F.lit(".py"))).alias("path"),
        (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("ord"),
        F.when(is_js, js).otherwise(py).alias("content"))


def turn_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grammar-free segmentation of the turn files."""
    units = segment_units(spread(turn_files(spark, sf_dir)))
    return units.select("file", "name", "start_line", "line_count", "lang_group", "n_chars",
                        F.md5("code").alias("code_md5"))


def code_files(rows, key, text: str, is_js, prefix: str = ""):
    """Source files (repo, path, ord, content) that hold a whole text each:
    once as a docstring or block comment, and line by line in the comments of an
    import, and in a default value, a comment and a returned string of a function.
    Python functions have wrapped parameters, JS ones their brace on the next line."""
    line_no = lambda i: (i + 1).cast("string")
    lines = F.split(text, "\n", -1)
    quoted = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    ticked = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`"))
    word = lambda x: F.regexp_extract(x, "^([a-z]*)", 1)
    py = F.concat(
        F.lit('"""\n'), quoted(F.col(text)), F.lit('\n"""\n'),
        F.array_join(F.transform(lines, lambda x, i: F.concat(
            F.lit("from pkg.m"), word(x), F.lit(" import (a_"), line_no(i), F.lit(",  # "), x, F.lit("\n    b)\n"))), ""),
        F.array_join(F.transform(lines, lambda x, i: F.concat(
            F.lit("def line_"), line_no(i), F.lit('(\n        a="'), quoted(x), F.lit('",\n):\n    # '), x, F.lit("\n    return a\n\n\n"))), ""))
    js = F.concat(
        F.lit("/*\n"), F.replace(F.col(text), F.lit("*/"), F.lit("* /")), F.lit("\n*/\n"),
        F.array_join(F.transform(lines, lambda x, i: F.concat(
            F.lit("import { a_"), line_no(i), F.lit(' } from "./m'), word(x), F.lit('"; // '), x, F.lit("\n"))), ""),
        F.array_join(F.transform(lines, lambda x, i: F.concat(
            F.lit("function line_"), line_no(i), F.lit('(a = "'), quoted(x), F.lit('")\n{\n  // '), x, F.lit("\n  return `"), ticked(x),
            F.lit("`;\n}\n"))), ""))
    path = F.concat(F.lit(prefix), key.cast("string"), F.when(is_js, F.lit(".tsx")).otherwise(F.lit(".py")))
    return rows.select(F.lit("code").alias("repo"), path.alias("path"), F.xxhash64(path).alias("ord"), F.when(is_js, js).otherwise(py).alias("content"))


def turn_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return code_files(spread(c), key, "text", F.col("role") == "assistant")


def document_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return code_files(spread(d), F.col("doc_id"), "text", F.col("doc_id") % 2 == 1)


def code_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All functions of the source files that hold the turns."""
    return segment_units(turn_code(spark, sf_dir)).select(
        "file", "name", "start_line", "line_count", "lang_group", F.md5("code").alias("code_md5"))


def sized_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that a duplicate scan looks at: three lines or more, of the
    turns as files and of the source files that hold the turns."""
    files = turn_files(spark, sf_dir).unionByName(turn_code(spark, sf_dir))
    units = dedup.min_size_filter(segment_units(files))
    return units.select("file", "name", "start_line", "line_count")


def turn_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many imports and which symbols the source files that hold the turns have."""
    st = structure.file_structures(turn_code(spark, sf_dir))
    return st.select("file", F.size("imports").alias("n_imports"), F.array_join("symbols", ",").alias("symbols"))


def code_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and symbols of the source files that hold the documents."""
    st = structure.file_structures(document_code(spark, sf_dir))
    return st.select("file", F.array_join("imports", "|").alias("imports"), F.array_join("symbols", ",").alias("symbols"))


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments: each user turn starts one; sizes aggregated per segment.

    The running count of user turns is a blocked prefix sum
    (``caps.running_count``), so a conversation with a third of all turns is
    not one task; the sizes are a map-side combined aggregate - no text is
    collected.
    """
    c = table(spark, sf_dir, "conversations")
    seg = running_count(c, ["conv_id"], "turn", F.col("role") == "user", out="seg_no")
    return seg.groupBy("conv_id", "seg_no").agg(
        F.min("turn").alias("start_turn"), F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.length("text")).cast("long").alias("n_chars"),
        F.sum(line_count("text")).cast("long").alias("line_count"))


def unit_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of two sources in one table (documents and turns), then the
    blocking-key histogram per group."""
    units = documents_as_units(table(spark, sf_dir, "documents")).unionByName(turn_units(spark, sf_dir))
    return dedup.size_histogram(units, dedup.BUCKET_SIZE)


_LCT = sql_line_count("text")

SQL_SEGMENTS = f"""
WITH s AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
            OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg_no
  FROM conversations
)
SELECT conv_id, CAST(seg_no AS BIGINT) AS seg_no, min(turn) AS start_turn, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum({_LCT}) AS BIGINT) AS line_count
FROM s GROUP BY conv_id, seg_no
"""

SQL_UNIT_SIZES = f"""
WITH u AS (
  SELECT lang AS lang_group, {_LCT} AS lc FROM documents
  UNION ALL
  SELECT role AS lang_group, {_LCT} AS lc FROM conversations
),
h AS (SELECT lang_group, CAST(lc // 5 AS INTEGER) AS bucket, count(*) AS n_units FROM u GROUP BY 1, 2)
SELECT h.lang_group, h.bucket, CAST(h.n_units AS BIGINT) AS n_units,
       CAST(h.n_units * (h.n_units - 1) // 2 AS BIGINT) AS within_pairs,
       CAST(h.n_units * coalesce(nx.n_units, 0) AS BIGINT) AS next_pairs
FROM h LEFT JOIN h nx ON nx.lang_group = h.lang_group AND nx.bucket = h.bucket + 1
"""

QUERIES = {
    "conversation_segments": conversation_segments,
    "unit_sizes": unit_sizes,
    "turn_functions": turn_functions,
    "turn_structures": turn_structures,
    "code_functions": code_functions,
    "sized_functions": sized_functions,
    "code_structures": code_structures,
}

SQL_TURN_FUNCTIONS = r"""
WITH f AS (
  SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) ||
         CASE WHEN role = 'assistant' THEN '.js' ELSE '.py' END AS file,
         'reply_' || CAST(turn AS VARCHAR) AS name, role,
         CASE WHEN role = 'assistant'
              THEN 'function reply_' || CAST(turn AS VARCHAR) || '() {' || chr(10) || '  // ' ||
                   replace(text, chr(10), chr(10) || '  // ') || chr(10) || '}'
              ELSE regexp_replace('def reply_' || CAST(turn AS VARCHAR) || '():' || chr(10) || '    ' ||
                   replace(text, chr(10), chr(10) || '    '), '\s+$', '') END AS code
  FROM conversations
),
u AS (
  SELECT file, name, 1 AS start_line,
         CAST(length(code) - length(replace(code, chr(10), '')) + 1 AS INTEGER) AS line_count,
         CASE WHEN role = 'assistant' THEN 'js_ts' ELSE 'python' END AS lang_group,
         CAST(length(code) AS INTEGER) AS n_chars, md5(code) AS code_md5
  FROM f
)
SELECT * FROM u
"""

_NL = "chr(10)"
_TURN_FILE = "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)"
_QUOTED = """replace(replace(x, '\\', '\\\\'), '"', '\\"')"""
_TICKED = "replace(replace(x, '\\', '\\\\'), '`', '\\`')"


def _sql_lines(table: str, file: str, is_js: str) -> str:
    """One row per line of a text: file, is_js, k (lines of the text), i (from 1), x (the line)."""
    return f"""l0 AS (SELECT {file} AS f, {is_js} AS is_js, string_split(text, {_NL}) AS ls FROM {table} WHERE text IS NOT NULL),
l AS (SELECT f || CASE WHEN is_js THEN '.tsx' ELSE '.py' END AS file, is_js, len(ls) AS k, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l0)"""


_TURNS = _sql_lines("conversations", _TURN_FILE, "role = 'assistant'")
_DOCUMENTS = _sql_lines("documents", "CAST(doc_id AS VARCHAR)", "doc_id % 2 = 1")

SQL_CODE_FUNCTIONS = f"""
WITH {_TURNS}
SELECT file, 'line_' || i AS name, CAST(CASE WHEN is_js THEN 2 * k + 3 + 5 * (i - 1) ELSE 3 * k + 3 + 7 * (i - 1) END AS INTEGER) AS start_line,
       CAST(5 AS INTEGER) AS line_count, CASE WHEN is_js THEN 'js_ts' ELSE 'python' END AS lang_group,
       md5(CASE WHEN is_js
           THEN 'function line_' || i || '(a = "' || {_QUOTED} || '")' || {_NL} || '{{' || {_NL} || '  // ' || x || {_NL} || '  return `' ||
                {_TICKED} || '`;' || {_NL} || '}}'
           ELSE 'def line_' || i || '(' || {_NL} || '        a="' || {_QUOTED} || '",' || {_NL} || '):' || {_NL} || '    # ' || x || {_NL} ||
                '    return a' END) AS code_md5
FROM l
"""

SQL_SIZED_FUNCTIONS = f"""
SELECT file, name, start_line, line_count FROM ({SQL_CODE_FUNCTIONS}) WHERE line_count >= 3
UNION ALL
SELECT file, name, start_line, line_count FROM ({SQL_TURN_FUNCTIONS}) WHERE line_count >= 3
"""

SQL_TURN_STRUCTURES = f"""
WITH {_TURNS}
SELECT file, CAST(count(*) AS INTEGER) AS n_imports, string_agg('line_' || i, ',' ORDER BY i) AS symbols FROM l GROUP BY file
"""

_WORD = "regexp_extract(x, '^([a-z]*)', 1)"
SQL_CODE_STRUCTURES = f"""
WITH {_DOCUMENTS},
s AS (SELECT *, CASE WHEN is_js THEN 'import {{ a_' || i || ' }} from "./m' || {_WORD} || '";'
                     ELSE 'from pkg.m' || {_WORD} || ' import (a_' || i || ',  # ' || x || '     b)' END AS stmt FROM l)
SELECT file, string_agg(stmt, '|' ORDER BY i) AS imports, string_agg('line_' || i, ',' ORDER BY i) AS symbols FROM s GROUP BY file
"""

ORACLE = {
    "code_functions": SQL_CODE_FUNCTIONS,
    "code_structures": SQL_CODE_STRUCTURES,
    "sized_functions": SQL_SIZED_FUNCTIONS,
    "turn_functions": SQL_TURN_FUNCTIONS,
    "turn_structures": SQL_TURN_STRUCTURES,
    "conversation_segments": SQL_SEGMENTS,
    "unit_sizes": SQL_UNIT_SIZES,
}
