"""Registered queries: near-duplicate detection over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, report
from .common import documents_as_units, spread, sql_line_count, table

K = 5
T = dedup.SIMILARITY_THRESHOLD
B = dedup.BUCKET_SIZE


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).transform(documents_as_units)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents of one language and neighbouring size buckets whose
    5-word shingle sets have Jaccard >= 0.75 (exact copies collapsed)."""
    pairs = dedup.shingle_similar_pairs(_units(spark, sf_dir), k=K, threshold=T, bucket_size=B)
    pairs = pairs.withColumn("similarity", F.col("inter") / F.col("union_size"))
    return dedup.rank_pairs(pairs, ties=("a_id", "b_id")).withColumnRenamed("lang_group", "lang").drop("similarity")


def copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit with its identical-set representative and group size."""
    return dedup.copy_groups(_units(spark, sf_dir), k=K, bucket_size=B).withColumnRenamed(
        "lang_group", "lang").drop("repo")


def near_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's family: those that chains of the flagship's pairs and copies connect."""
    return dedup.near_families(_units(spark, sf_dir), k=K, threshold=T, bucket_size=B).withColumnRenamed("lang_group", "lang")


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's list of near-duplicate pairs as the reference orders it: by
    similarity at two places, highest first, with its rank in the list."""
    units = _units(spark, sf_dir)
    pairs = dedup.shingle_similar_pairs(units, k=K, threshold=T, bucket_size=B, within_repo=True)
    owned = pairs.join(units.select(F.col("unit_id").alias("a_id"), "repo"), "a_id")
    return dedup.rank_in_repo(owned).select("repo", "rank", "a_id", "b_id", "similarity")


def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.size_histogram(_units(spark, sf_dir), B).withColumnRenamed("lang_group", "lang")


def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents listed, units analysed, near-duplicate pairs found.

    Pairs are counted where either side belongs to the source; no per-source
    array is collected (a hot source would put every pair in one row).  Documents
    without a source are counted as a source of their own.
    """
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("repo"), F.col("doc_id").alias("ord"))
    units = _units(spark, sf_dir)
    keyed = dedup.shingled(units, K, B)
    pairs = dedup.shingle_similar_pairs(keyed, k=K, threshold=T, bucket_size=B)
    copies = dedup.copy_groups(keyed, k=K, bucket_size=B, materialize_keys=False)
    return report.duplicate_report(files, units, pairs, copies=copies, unnamed=True)


def _repo_units(units: DataFrame) -> DataFrame:
    """The documents as files of their source, with file names and listing
    orders that repeat from source to source."""
    return units.withColumn("file", (F.col("unit_id") % 50).cast("string")).withColumn("scan_ord", F.col("unit_id") % 50)


def repo_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs per source and in all, each source scanned by itself
    and all together, by arithmetic on copies."""
    units = _repo_units(_units(spark, sf_dir))
    keyed = dedup.shingled(units, K, B)
    out = None
    for name, within in (("within", True), ("across", False)):
        pairs = dedup.shingle_similar_pairs(keyed, k=K, threshold=T, bucket_size=B, within_repo=within)
        copies = dedup.copy_groups(keyed, k=K, bucket_size=B, materialize_keys=False, within_repo=within)
        rep = report.duplicate_report(units, units, pairs, copies=copies).select(
            F.lit(name).alias("mode"), "repo", "duplicate_pairs")
        out = rep if out is None else out.unionByName(rep)
    return out


# --------------------------------------------------------------------------
# DuckDB oracle (brute force over the band; no prefix filter, no hashing)
# --------------------------------------------------------------------------

_LC = sql_line_count("text")

SQL_UNITS = f"""
u AS (
  SELECT doc_id, lang, source, CAST({_LC} AS INTEGER) AS line_count,
         string_split(trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')), ' ') AS toks
  FROM documents
),
s AS (
  SELECT doc_id, lang, source, line_count, line_count // {B} AS bucket,
         CASE WHEN len(toks) < {K} THEN list_filter([array_to_string(toks, ' ')], lambda x: x <> '')
              ELSE list_sort(list_distinct(list_transform(range(1, len(toks) - {K - 2}),
                   lambda i: array_to_string(toks[i:i + {K - 1}], ' ')))) END AS sh
  FROM u
),
s2 AS (SELECT *, len(sh) AS n FROM s WHERE len(sh) > 0),
g AS (
  SELECT lang, bucket, sh, first(doc_id ORDER BY source, doc_id) AS rep, min(source) AS rep_src, count(*) AS n_copies
  FROM s2 GROUP BY lang, bucket, sh
)"""

SQL_NEAR_DUPLICATES = f"""
WITH {SQL_UNITS},
p AS (
  SELECT a.lang, a.rep AS a_id, b.rep AS b_id,
         CAST(a.n_copies AS BIGINT) AS a_copies, CAST(b.n_copies AS BIGINT) AS b_copies,
         CAST(len(list_intersect(a.sh, b.sh)) AS BIGINT) AS inter,
         CAST(len(a.sh) + len(b.sh) - len(list_intersect(a.sh, b.sh)) AS BIGINT) AS union_size
  FROM g a JOIN g b
    ON a.lang = b.lang
   AND ((b.bucket = a.bucket AND row(b.rep_src, b.rep) > row(a.rep_src, a.rep)) OR b.bucket = a.bucket + 1)
)
SELECT lang, a_id, b_id, a_copies, b_copies, inter, union_size
FROM p WHERE inter >= union_size * {T}
"""

SQL_COPY_GROUPS = f"""
WITH {SQL_UNITS}
SELECT s2.doc_id AS unit_id, s2.lang, CAST(s2.bucket AS INTEGER) AS bucket,
       g.rep AS rep_id, CAST(g.n_copies AS BIGINT) AS n_copies
FROM s2 JOIN g ON s2.lang = g.lang AND s2.bucket = g.bucket AND s2.sh = g.sh
"""

SQL_NEAR_FAMILIES = f"""
WITH RECURSIVE {SQL_UNITS},
gh AS MATERIALIZED (SELECT lang, bucket, rep, list_transform(sh, lambda x: hash(x)) AS sh, len(sh) AS n FROM g),
o AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y FROM gh a JOIN gh b
    ON a.lang = b.lang AND b.bucket IN (a.bucket, a.bucket + 1) AND (b.bucket > a.bucket OR b.rep > a.rep)
   AND least(a.n, b.n) >= {T} * greatest(a.n, b.n)
  WHERE len(list_intersect(a.sh, b.sh)) * {1 + T} >= {T} * (a.n + b.n)
),
p AS MATERIALIZED (SELECT x, y FROM o UNION ALL SELECT y, x FROM o),
reach AS (SELECT rep AS x, rep AS y FROM g UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
fam AS (SELECT x AS rep, min(y) AS family_id FROM reach GROUP BY x),
m AS (SELECT s2.doc_id AS unit_id, s2.source AS repo, s2.lang, g.rep AS rep_id, fam.family_id
      FROM s2 JOIN g ON s2.lang = g.lang AND s2.bucket = g.bucket AND s2.sh = g.sh JOIN fam ON fam.rep = g.rep)
SELECT *, CAST(count(*) OVER (PARTITION BY family_id) AS BIGINT) AS family_size FROM m
"""

SQL_RANKED_PAIRS = f"""
WITH {SQL_UNITS},
r AS (SELECT lang, bucket, source AS repo, min(doc_id) AS rep, list_transform(any_value(sh), lambda x: hash(x)) AS sh, len(any_value(sh)) AS n
      FROM s2 GROUP BY lang, bucket, source, s2.sh),
p AS (
  SELECT a.repo, a.rep AS a_id, b.rep AS b_id, len(list_intersect(a.sh, b.sh)) AS i, a.n + b.n AS both_n
  FROM r a JOIN r b ON a.lang = b.lang AND a.repo = b.repo AND least(a.n, b.n) >= {T} * greatest(a.n, b.n)
   AND ((b.bucket = a.bucket AND b.rep > a.rep) OR b.bucket = a.bucket + 1)
),
x AS (SELECT repo, a_id, b_id, CAST(printf('%.2f', i / (both_n - i)) AS DOUBLE) AS similarity FROM p WHERE i >= {T} * (both_n - i))
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY similarity DESC, a_id, b_id) AS rank, a_id, b_id, similarity FROM x
"""

SQL_SIZE_HISTOGRAM = f"""
WITH h AS (
  SELECT lang, CAST({_LC} // {B} AS INTEGER) AS bucket, count(*) AS n_units
  FROM documents
  GROUP BY 1, 2
)
SELECT h.lang, h.bucket, CAST(h.n_units AS BIGINT) AS n_units,
       CAST(h.n_units * (h.n_units - 1) // 2 AS BIGINT) AS within_pairs,
       CAST(h.n_units * coalesce(nx.n_units, 0) AS BIGINT) AS next_pairs
FROM h LEFT JOIN h nx ON nx.lang = h.lang AND nx.bucket = h.bucket + 1
"""

# All pairs of documents, copies and all: nothing is collapsed.  Only pairs that
# share a shingle can be similar.
SQL_PAIRS = f"""{SQL_UNITS},
sized AS MATERIALIZED (
  SELECT doc_id, lang, source, bucket, list_transform(sh, lambda x: hash(x)) AS sh, len(sh) AS n FROM s2),
p AS (
  SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.source AS a_repo, b.source AS b_repo, a.n AS a_n, b.n AS b_n,
         len(list_intersect(a.sh, b.sh)) AS inter
  FROM sized a JOIN sized b
    ON a.lang = b.lang
   AND ((b.bucket = a.bucket AND b.doc_id > a.doc_id) OR b.bucket = a.bucket + 1)
   AND least(a.n, b.n) >= {T} * greatest(a.n, b.n)
),
pp AS (SELECT a_id, b_id, a_repo, b_repo FROM p WHERE inter >= {T} * (a_n + b_n - inter)
)"""

SQL_DUPLICATE_REPORT = f"""
WITH {SQL_PAIRS},
f AS (SELECT source AS repo, count(*) AS files_scanned FROM documents GROUP BY 1),
fu AS (SELECT source AS repo, count(*) AS functions_analyzed FROM u GROUP BY 1),
fp AS (SELECT f.repo, count(*) AS duplicate_pairs FROM f JOIN pp
       ON f.repo IS NOT DISTINCT FROM a_repo OR f.repo IS NOT DISTINCT FROM b_repo GROUP BY 1)
SELECT f.repo, CAST(f.files_scanned AS BIGINT) AS files_scanned,
       CAST(coalesce(fu.functions_analyzed, 0) AS BIGINT) AS functions_analyzed,
       CAST(coalesce(fp.duplicate_pairs, 0) AS BIGINT) AS duplicate_pairs
FROM f LEFT JOIN fu ON fu.repo IS NOT DISTINCT FROM f.repo LEFT JOIN fp ON fp.repo IS NOT DISTINCT FROM f.repo
"""

SQL_REPO_DUPLICATES = f"""
WITH {SQL_PAIRS},
m AS (SELECT source AS repo, unnest(['within', 'across']) AS mode FROM documents GROUP BY 1),
c AS (SELECT m.mode, m.repo, count(*) AS n FROM m JOIN pp
      ON (m.repo = a_repo OR m.repo = b_repo) AND (m.mode = 'across' OR a_repo = b_repo) GROUP BY 1, 2)
SELECT m.mode, m.repo, CAST(coalesce(c.n, 0) AS BIGINT) AS duplicate_pairs
FROM m LEFT JOIN c ON c.mode = m.mode AND c.repo = m.repo
"""

QUERIES = {
    "near_duplicates": near_duplicates,
    "near_families": near_families,
    "ranked_pairs": ranked_pairs,
    "copy_groups": copy_groups,
    "size_histogram": size_histogram,
    "duplicate_report": duplicate_report,
    "repo_duplicates": repo_duplicates,
}

ORACLE = {
    "near_duplicates": SQL_NEAR_DUPLICATES,
    "near_families": SQL_NEAR_FAMILIES,
    "ranked_pairs": SQL_RANKED_PAIRS,
    "copy_groups": SQL_COPY_GROUPS,
    "size_histogram": SQL_SIZE_HISTOGRAM,
    "duplicate_report": SQL_DUPLICATE_REPORT,
    "repo_duplicates": SQL_REPO_DUPLICATES,
}
