"""Registered queries: structure facts, import graph and architecture text.

Binding: each page is a file of its host's repo (repo = host, file = URL
path); its ``href`` targets are its imports and its ``<h1>`` texts the
symbols it defines.  For code, a page is a Python file of its host's repo
(``code_files``) that imports what the page links to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import with_computed_once
from ..operators import graph, structure
from .common import spread, table

HOST = r"^https?://([^/?#]+)"
PATH = r"^https?://[^/?#]+([^?#]*)"
FOLDER = r"^https?://[^/?#]+/([A-Za-z0-9_]+)"
HREF = r'href="([^"]*)"'
H1 = r"<h1>(.*?)</h1>"


def page_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select(
        "page_id",
        F.regexp_extract("url", HOST, 1).alias("repo"),
        F.regexp_extract("url", PATH, 1).alias("file"),
        F.col("page_id").alias("ord"),
        F.transform(F.regexp_extract_all("html", F.lit(HREF), 1),
                    lambda x: F.regexp_replace(F.regexp_replace(x, "\n", " "),
                                               r"(?U)^\s+|\s+$", "")).alias("imports"),
        F.regexp_extract_all("html", F.lit(H1), 1).alias("symbols"))


def structures_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = page_structures(spark, sf_dir)
    return s.select("page_id", "repo", "file", F.size("imports").alias("n_imports"),
                    F.size("symbols").alias("n_symbols"),
                    F.array_join("imports", "\n").alias("imports_text"),
                    F.array_join("symbols", "\n").alias("symbols_text"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a Python file: the folder is the first part of the URL path,
    the module is named after the first letter of the first link (a package when
    the path ends with a slash), and the links are imported in every form of the
    statement, with whole links in its comments."""
    pages = spread(table(spark, sf_dir, "pages"))
    links = F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), lambda x: F.regexp_replace(x, r"[\r\n]", " "))
    p = with_computed_once(pages.select("page_id", "url", "html"), links=links, repo=F.regexp_extract("url", HOST, 1),
                           d=F.regexp_extract("url", FOLDER, 1), package=F.regexp_extract("url", PATH, 1).endswith("/"))
    raw = [F.coalesce(F.get("links", F.lit(i)), F.lit("none")) for i in range(6)]
    n = [F.concat(F.lit("m"), F.regexp_replace(F.substring(x, 2, 1), "[^A-Za-z0-9]", "_")) for x in raw]
    d = F.col("d")
    content = F.concat(
        F.lit("import os, "), d, F.lit("."), n[1], F.lit(" as x; import sys\n"),
        F.lit("from "), d, F.lit(" import ("), n[2], F.lit(",  # "), raw[2], F.lit(", (see)\n    "), n[3], F.lit(" as y,\n)\n"),
        F.lit("from . import "), n[4], F.lit("  # "), raw[4], F.lit("\nfrom ."), n[5], F.lit(" import run, \\\n    "), n[1],
        F.lit("\nfrom .."), d, F.lit(" import "), n[2], F.lit("\nfrom "), d, F.lit("."), n[3], F.lit(" import *\n"))
    path = F.concat(d, F.lit("/"), n[0], F.when(F.col("package"), F.lit("/__init__.py")).otherwise(F.lit(".py")))
    return with_computed_once(p.select("repo", F.col("page_id").alias("ord"), "d", "package", "links"),
                              path=path, content=content).select("repo", "path", "ord", "content")


def code_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges of the code files, each resolved to a file of its repo."""
    st = structure.file_structures(code_files(spark, sf_dir))
    return graph.resolve_code_imports(graph.code_import_edges(st), st)


def rooted_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the files lie under source roots: how a page's URL ends
    decides whether its file is under ``src``, ``lib/py`` or the repo's root."""
    files = code_files(spark, sf_dir)
    ending = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.when(F.col("url").endswith("top"), "src/")
                                                  .when(F.col("url").endswith("html"), "lib/py/").otherwise("").alias("root"))
    rooted = files.join(ending, "ord").select("repo", F.concat("root", "path").alias("path"), "ord", "content")
    st = structure.file_structures(rooted)
    return graph.resolve_rooted_imports(graph.code_import_edges(st), st)


def _edges(spark, sf_dir):
    s = page_structures(spark, sf_dir)
    return s, graph.resolve_imports(graph.import_edges(s), s)


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _edges(spark, sf_dir)
    return e.select("repo", "src_file", "dst_module", "internal")


def external_import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = page_structures(spark, sf_dir)
    ext = graph.external_imports(graph.import_edges(s), s)
    return ext.groupBy("repo").agg(F.count(F.lit(1)).alias("n_external"))


def module_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _edges(spark, sf_dir)
    return graph.module_degree(e)


def top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _edges(spark, sf_dir)
    return graph.top_modules(graph.module_degree(e), graph.TOP_MODULES)


def diagram_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = _edges(spark, sf_dir)
    top = graph.top_modules(graph.module_degree(e), graph.TOP_MODULES)
    return graph.diagram_text(e, top)


def structure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of every host, in texts of bounded size."""
    return structure.structure_text(page_structures(spark, sf_dir))


# --------------------------------------------------------------------------
# DuckDB twins
# --------------------------------------------------------------------------

SQL_STRUCT = r"""
s AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS file, page_id AS ord,
         list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1),
                        lambda x: regexp_replace(replace(x, chr(10), ' '), '^\s+|\s+$', '', 'g')) AS imports,
         regexp_extract_all(html, '<h1>(.*?)</h1>', 1) AS symbols
  FROM pages
)"""

SQL_EDGES = SQL_STRUCT + r""",
e0 AS (SELECT DISTINCT repo, file AS src_file, unnest(imports) AS dst_module FROM s),
e1 AS (SELECT * FROM e0 WHERE dst_module <> ''),
names AS (SELECT DISTINCT repo, file AS dst_module FROM s),
e AS (
  SELECT e1.repo, e1.src_file, e1.dst_module, n.dst_module IS NOT NULL AS internal
  FROM e1 LEFT JOIN names n ON n.repo = e1.repo AND n.dst_module = e1.dst_module
),
od AS (SELECT repo, src_file AS module, count(*) AS out_degree FROM e GROUP BY 1, 2),
idg AS (SELECT repo, dst_module AS module, count(*) AS in_degree FROM e GROUP BY 1, 2),
deg AS (
  SELECT coalesce(od.repo, idg.repo) AS repo, coalesce(od.module, idg.module) AS module,
         CAST(coalesce(idg.in_degree, 0) AS BIGINT) AS in_degree,
         CAST(coalesce(od.out_degree, 0) AS BIGINT) AS out_degree
  FROM od FULL OUTER JOIN idg ON od.repo = idg.repo AND od.module = idg.module
),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY in_degree + out_degree DESC, module) AS rank
    FROM deg) WHERE rank <= 12
)"""

SQL_STRUCTURES = "WITH " + SQL_STRUCT + """
SELECT page_id, repo, file, CAST(len(imports) AS INTEGER) AS n_imports,
       CAST(len(symbols) AS INTEGER) AS n_symbols,
       array_to_string(imports, chr(10)) AS imports_text,
       array_to_string(symbols, chr(10)) AS symbols_text
FROM s
"""

SQL_IMPORT_EDGES = "WITH " + SQL_EDGES + """
SELECT repo, src_file, dst_module, internal FROM e
"""

SQL_CODE_IMPORT_EDGES = r"""
WITH l AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
         regexp_extract(url, '^https?://[^/?#]+/([A-Za-z0-9_]+)', 1) AS d,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) LIKE '%/' AS package,
         list_transform(range(1, 7), lambda i: 'm' || regexp_replace(
             substr(coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1)[i], 'none'), 2, 1), '[^A-Za-z0-9]', '_', 'g')) AS n
  FROM pages
),
f AS (
  SELECT DISTINCT repo, d, n, package, d || '/' || n[1] || CASE WHEN package THEN '/__init__.py' ELSE '.py' END AS src_file,
         CASE WHEN package THEN d || '/' || n[1] ELSE d END AS here,
         CASE WHEN package THEN d || '/' || d ELSE d END AS above
  FROM l
),
u AS (
  SELECT repo, src_file, unnest([
    {'m': 'os', 'p': 'os', 'n': ''}, {'m': 'sys', 'p': 'sys', 'n': ''},
    {'m': d || '.' || n[2], 'p': d || '/' || n[2], 'n': ''},
    {'m': d, 'p': d, 'n': n[3]}, {'m': d, 'p': d, 'n': n[4]},
    {'m': '.', 'p': here, 'n': n[5]},
    {'m': '.' || n[6], 'p': here || '/' || n[6], 'n': 'run'},
    {'m': '.' || n[6], 'p': here || '/' || n[6], 'n': n[2]},
    {'m': '..' || d, 'p': above, 'n': n[3]},
    {'m': d || '.' || n[4], 'p': d || '/' || n[4], 'n': ''}]) AS x
  FROM f
),
i AS (SELECT DISTINCT repo, src_file, x.m AS m, x.p AS p, x.n AS n FROM u),
t AS (
  SELECT repo, src_file, m, p, n, CASE WHEN m = '.' THEN '.' || n ELSE m || '.' || n END AS own,
         unnest([1, 2, 3, 4]) AS k FROM i
),
c AS (
  SELECT repo, src_file, m, n, k, CASE WHEN k <= 2 THEN own ELSE m END AS dst_module,
         CASE k WHEN 1 THEN p || '/' || n || '.py' WHEN 2 THEN p || '/' || n || '/__init__.py'
                WHEN 3 THEN p || '.py' ELSE p || '/__init__.py' END AS dst_file
  FROM t WHERE (k > 2 OR n <> '') AND (k <> 3 OR m <> '.')
),
hit AS (
  SELECT c.repo, c.src_file, c.m, c.n, arg_min(c.dst_module, k) AS dst_module, arg_min(c.dst_file, k) AS dst_file
  FROM c JOIN (SELECT DISTINCT repo, src_file AS dst_file FROM f) USING (repo, dst_file) GROUP BY 1, 2, 3, 4
)
SELECT DISTINCT i.repo, i.src_file, coalesce(hit.dst_module, i.m) AS dst_module, hit.dst_file,
       hit.dst_file IS NOT NULL AS internal
FROM i LEFT JOIN hit ON hit.repo = i.repo AND hit.src_file = i.src_file AND hit.m = i.m AND hit.n = i.n
"""

SQL_ROOTED_IMPORT_EDGES = r"""
WITH l AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
         regexp_extract(url, '^https?://[^/?#]+/([A-Za-z0-9_]+)', 1) AS d,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) LIKE '%/' AS package,
         CASE WHEN url LIKE '%top' THEN 'src/' WHEN url LIKE '%html' THEN 'lib/py/' ELSE '' END AS root,
         list_transform(range(1, 7), lambda i: 'm' || regexp_replace(
             substr(coalesce(regexp_extract_all(html, 'href="([^"]*)"', 1)[i], 'none'), 2, 1), '[^A-Za-z0-9]', '_', 'g')) AS n
  FROM pages
),
f AS (
  SELECT DISTINCT repo, d, n, package, root || d || '/' || n[1] || CASE WHEN package THEN '/__init__.py' ELSE '.py' END AS src_file,
         root || CASE WHEN package THEN d || '/' || n[1] ELSE d END AS here,
         root || CASE WHEN package THEN d || '/' || d ELSE d END AS above
  FROM l
),
u AS (
  SELECT repo, src_file, unnest([
    {'m': 'os', 'p': 'os', 'n': ''}, {'m': 'sys', 'p': 'sys', 'n': ''},
    {'m': d || '.' || n[2], 'p': d || '/' || n[2], 'n': ''},
    {'m': d, 'p': d, 'n': n[3]}, {'m': d, 'p': d, 'n': n[4]},
    {'m': '.', 'p': here, 'n': n[5]},
    {'m': '.' || n[6], 'p': here || '/' || n[6], 'n': 'run'},
    {'m': '.' || n[6], 'p': here || '/' || n[6], 'n': n[2]},
    {'m': '..' || d, 'p': above, 'n': n[3]},
    {'m': d || '.' || n[4], 'p': d || '/' || n[4], 'n': ''}]) AS x
  FROM f
),
i AS (SELECT DISTINCT repo, src_file, x.m AS m, x.p AS p, x.n AS n FROM u),
t AS (
  SELECT repo, src_file, m, p, n, CASE WHEN m = '.' THEN '.' || n ELSE m || '.' || n END AS own,
         unnest([1, 2, 3, 4]) AS k FROM i
),
c AS (
  SELECT repo, src_file, m, n, k, CASE WHEN k <= 2 THEN own ELSE m END AS dst_module,
         CASE k WHEN 1 THEN p || '/' || n || '.py' WHEN 2 THEN p || '/' || n || '/__init__.py'
                WHEN 3 THEN p || '.py' ELSE p || '/__init__.py' END AS cand
  FROM t WHERE (k > 2 OR n <> '') AND (k <> 3 OR m <> '.')
),
up AS (
  SELECT *, string_split(src_file, '/')[1:-2] AS folders FROM c
),
tried AS (
  SELECT repo, src_file, m, n, dst_module, k, cand, unnest(range(0, CASE WHEN m LIKE '.%' THEN 1 ELSE len(folders) + 1 END)) AS j, folders FROM up
),
hit AS (
  SELECT repo, src_file, m, n, arg_min(dst_module, j * 10 + k) AS dst_module, arg_min(path, j * 10 + k) AS dst_file
  FROM (SELECT *, array_to_string(list_concat(folders[1:j], [cand]), '/') AS path FROM tried) x
  JOIN (SELECT DISTINCT repo, src_file AS path FROM f) USING (repo, path) GROUP BY 1, 2, 3, 4
),
ends AS (
  SELECT c.repo, c.src_file, c.m, c.n, c.k, any_value(c.dst_module) AS dst_module, count(*) AS files, min(g.file) AS file
  FROM c JOIN (SELECT DISTINCT repo, src_file AS file FROM f) g
    ON c.repo = g.repo AND ends_with(g.file, '/' || c.cand) AND contains(c.cand, '/')
  WHERE c.m NOT LIKE '.%' GROUP BY 1, 2, 3, 4, 5
),
late AS (
  SELECT repo, src_file, m, n, arg_min(dst_module, k) AS dst_module, arg_min(files, k) AS files, arg_min(file, k) AS file FROM ends GROUP BY 1, 2, 3, 4
)
SELECT DISTINCT i.repo, i.src_file, coalesce(hit.dst_module, late.dst_module, i.m) AS dst_module,
       coalesce(hit.dst_file, CASE WHEN late.files = 1 THEN late.file END) AS dst_file,
       coalesce(hit.dst_file, CASE WHEN late.files = 1 THEN late.file END) IS NOT NULL AS internal,
       hit.dst_file IS NULL AND coalesce(late.files > 1, false) AS ambiguous
FROM i LEFT JOIN hit USING (repo, src_file, m, n) LEFT JOIN late USING (repo, src_file, m, n)
"""


SQL_EXTERNAL = "WITH " + SQL_EDGES + """
SELECT repo, CAST(count(*) AS BIGINT) AS n_external FROM e WHERE NOT internal GROUP BY repo
"""

SQL_DEGREES = "WITH " + SQL_EDGES + """
SELECT repo, module, in_degree, out_degree FROM deg
"""

SQL_TOP = "WITH " + SQL_EDGES + """
SELECT repo, module, in_degree, out_degree, CAST(rank AS INTEGER) AS rank FROM top
"""

SQL_DIAGRAM = "WITH " + SQL_EDGES + r""",
sel AS (
  SELECT e.repo, e.src_file, e.dst_module,
         '  ' || regexp_replace(e.src_file, '[^A-Za-z0-9_]', '_', 'g') || '_' || substr(md5(e.src_file), 1, 6) ||
         '[' || e.src_file || '] --> ' || regexp_replace(e.dst_module, '[^A-Za-z0-9_]', '_', 'g') || '_' ||
         substr(md5(e.dst_module), 1, 6) || '[' || e.dst_module || ']' AS line
  FROM e
  WHERE EXISTS (SELECT 1 FROM top t WHERE t.repo = e.repo AND t.module = e.src_file)
    AND EXISTS (SELECT 1 FROM top t WHERE t.repo = e.repo AND t.module = e.dst_module)
)
SELECT repo, CAST(count(*) AS BIGINT) AS n_edges,
       'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY src_file, dst_module) AS diagram
FROM sel GROUP BY repo
"""

SQL_STRUCTURE_TEXT = "WITH " + SQL_STRUCT + """,
b AS (
  SELECT repo, ord, CAST(ord // 100 AS BIGINT) AS part,
         concat_ws(chr(10), 'FILE: ' || file,
                   CASE WHEN len(imports) > 0 THEN '  imports:' || chr(10) ||
                        array_to_string(list_transform(imports, lambda x: '    ' || x), chr(10)) END,
                   CASE WHEN len(symbols) > 0 THEN '  defines: ' || array_to_string(symbols, ', ') END,
                   '') AS block
  FROM s
)
SELECT repo, part, CAST(count(*) AS BIGINT) AS n_files,
       string_agg(block, chr(10) ORDER BY ord) AS structure_text
FROM b GROUP BY repo, part
"""

QUERIES = {
    "page_structures": structures_summary,
    "import_edges": import_edges,
    "code_import_edges": code_import_edges,
    "rooted_import_edges": rooted_import_edges,
    "external_import_counts": external_import_counts,
    "module_degrees": module_degrees,
    "top_modules": top_modules,
    "diagram_text": diagram_text,
    "structure_text": structure_text,
}

ORACLE = {
    "page_structures": SQL_STRUCTURES,
    "import_edges": SQL_IMPORT_EDGES,
    "code_import_edges": SQL_CODE_IMPORT_EDGES,
    "rooted_import_edges": SQL_ROOTED_IMPORT_EDGES,
    "external_import_counts": SQL_EXTERNAL,
    "module_degrees": SQL_DEGREES,
    "top_modules": SQL_TOP,
    "diagram_text": SQL_DIAGRAM,
    "structure_text": SQL_STRUCTURE_TEXT,
}
