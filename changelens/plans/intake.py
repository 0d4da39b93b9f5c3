"""Registered queries: target parsing, fetch outcomes, listing caps, counts.

Bindings: ``pages.url`` are the targets (any ``*.example.{com,net,org}``
host stands in for the code host); the events table stands in for a fetch
log (status from the event type, remaining-calls header and transport
error from the value, blank body from the props number); ``documents`` are
the listed files (source = repo, doc_id = listing order) and ``labels``
marks the files whose content could be fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import caps, outcomes, targets
from ..operators.report import analyzed_counts as _analyzed_counts
from .common import table

PAGE_HOST = r"[A-Za-z0-9.-]+\.example\.(?:com|net|org)"

PAGE_PARTS = r"^(https?)://([^/?#]+)/([^/?#]+)/(\d+)"

# events -> fetch log binding (fixed test binding)
EVENT_STATUS = {"view": 200, "click": 404, "purchase": 403, "signup": 401, "error": 500}


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    status = F.lit(None).cast("int")
    for k, v in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == k, F.lit(v)).otherwise(status)
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("key"),
        status.alias("http_status"),
        F.when(F.col("value") < 10, F.lit("0")).otherwise(F.lit("59")).alias("rate_remaining"),
        F.when(F.col("value") > 45, F.lit("timeout"))
         .when(F.col("value") > 40, F.lit("connection")).alias("error"),
        (k < 5).alias("body_blank"))


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return targets.parse_targets(pages, "url", kind="repo", host=PAGE_HOST).select(
        "page_id", "owner", "repo", "reject_reason")


def pr_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change URLs made of the pages' own: host, language and number become
    owner, repo and change; scheme, what follows and what fits no change stay."""
    changed = F.regexp_replace("url", PAGE_PARTS, "$1://github.com/$2/$3/pull/$4")
    pages = table(spark, sf_dir, "pages").select("page_id", changed.alias("url"))
    return targets.parse_targets(pages, "url", kind="pr").select("page_id", "owner", "repo", "pr_number", "reject_reason")


def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the later stages, which answer with other statuses."""
    out = None
    for stage in ("duplicates", "architecture", "review", "tests"):
        one = outcomes.outcome_counts(fetch_log(spark, sf_dir), stage).select(F.lit(stage).alias("stage"), "category", "status", "n")
        out = one if out is None else out.unionByName(one)
    return out


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.outcome_counts(fetch_log(spark, sf_dir), "fetch")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("file"))


def capped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 25 files per repo (duplicate scan), and whether each is also
    among the first 20 (architecture scan: the cap applied to the 25)."""
    first25 = caps.cap_per_repo(_listing(spark, sf_dir), caps.MAX_FILES)
    return first25.select("repo", "ord", "rank_in_repo",
                          (F.col("rank_in_repo") <= caps.MAX_FILES_FOR_ARCHITECTURE)
                          .alias("in_architecture"))


def analyzed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed file of every repo; those with a label are the analysed ones."""
    listed = _listing(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select("doc_id")
    content = (table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo"))
               .join(labels, "doc_id", "left_semi")
               .select("repo", F.col("doc_id").cast("string").alias("file")))
    return _analyzed_counts(listed, content)


_STATUS_CASE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in EVENT_STATUS.items()) + " END"

SQL_FETCH_LOG = f"""
log AS (
  SELECT event_id AS key, {_STATUS_CASE} AS http_status,
         CASE WHEN value < 10 THEN '0' ELSE '59' END AS rate_remaining,
         CASE WHEN value > 45 THEN 'timeout' WHEN value > 40 THEN 'connection' END AS error,
         CAST(json_extract_string(props, '$.k') AS INTEGER) < 5 AS body_blank
  FROM events
),
c AS (
  SELECT *, CASE
    WHEN error = 'timeout' THEN 'timeout'
    WHEN error = 'connection' THEN 'connection'
    WHEN http_status = 404 THEN 'not_found'
    WHEN http_status = 403 AND rate_remaining = '0' THEN 'rate_limited'
    WHEN http_status = 403 THEN 'forbidden'
    WHEN http_status = 401 THEN 'unauthorized'
    WHEN http_status >= 400 THEN 'http_error'
    WHEN body_blank THEN 'empty'
    ELSE 'ok' END AS category
  FROM log
)"""

SQL_FETCH_OUTCOMES = f"""
WITH {SQL_FETCH_LOG}
SELECT category,
       CASE WHEN category = 'ok' THEN 200 WHEN category = 'rate_limited' THEN 429
            WHEN category = 'timeout' THEN 504 ELSE 400 END AS status,
       CAST(count(*) AS BIGINT) AS n
FROM c GROUP BY 1, 2
"""

SQL_STAGE_OUTCOMES = f"""
WITH {SQL_FETCH_LOG},
s AS (SELECT unnest(['duplicates', 'architecture', 'review', 'tests']) AS stage, unnest([400, 400, 502, 502]) AS failed)
SELECT stage, category, CASE WHEN category = 'ok' THEN 200 WHEN category = 'rate_limited' THEN 429 ELSE failed END AS status,
       CAST(count(*) AS BIGINT) AS n
FROM c CROSS JOIN s GROUP BY 1, 2, 3
"""

_PR = r"'^https://([^/?#]+)/([^/?#]+)/([0-9]+)'"

SQL_PR_TARGETS = rf"""
WITH m AS (SELECT page_id, regexp_replace(url, '^\s+|\s+$', '', 'g') AS u, coalesce(regexp_matches(url, {_PR}), false) AS ok FROM pages)
SELECT page_id, CASE WHEN ok THEN regexp_extract(u, {_PR}, 1) END AS owner, CASE WHEN ok THEN regexp_extract(u, {_PR}, 2) END AS repo,
       CASE WHEN ok THEN TRY_CAST(regexp_extract(u, {_PR}, 3) AS BIGINT) END AS pr_number,
       CASE WHEN NOT ok THEN 'not a pull request URL' END AS reject_reason
FROM m
"""

SQL_PAGE_TARGETS = r"""
WITH s AS (SELECT page_id, url, regexp_replace(url, '^\s+|\s+$', '', 'g') AS u FROM pages),
m AS (SELECT *, regexp_matches(u, '^https://[A-Za-z0-9.-]+\.example\.(?:com|net|org)/([^/]+)/([^/]+)') AS ok FROM s)
SELECT page_id,
       CASE WHEN ok THEN regexp_extract(u, '^https://[A-Za-z0-9.-]+\.example\.(?:com|net|org)/([^/]+)/([^/]+)', 1) END AS owner,
       CASE WHEN ok THEN regexp_replace(regexp_extract(u, '^https://[A-Za-z0-9.-]+\.example\.(?:com|net|org)/([^/]+)/([^/]+)', 2), '\.git$', '') END AS repo,
       CASE WHEN NOT ok OR url IS NULL THEN 'not a repository URL' END AS reject_reason
FROM m
"""

SQL_CAPPED = f"""
WITH r AS (SELECT source AS repo, doc_id AS ord,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank_in_repo
           FROM documents)
SELECT repo, ord, CAST(rank_in_repo AS INTEGER) AS rank_in_repo,
       rank_in_repo <= {caps.MAX_FILES_FOR_ARCHITECTURE} AS in_architecture
FROM r WHERE rank_in_repo <= {caps.MAX_FILES}
"""

SQL_ANALYZED = """
WITH l AS (SELECT source AS repo, CAST(doc_id AS VARCHAR) AS file FROM documents),
c AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS file FROM labels)
SELECT l.repo, CAST(count(DISTINCT l.file) AS BIGINT) AS files_scanned,
       CAST(count(DISTINCT c.file) AS BIGINT) AS files_analyzed
FROM l LEFT JOIN c ON c.file = l.file GROUP BY l.repo
"""

QUERIES = {
    "page_targets": page_targets,
    "pr_targets": pr_targets,
    "stage_outcomes": stage_outcomes,
    "fetch_outcomes": fetch_outcomes,
    "capped_files": capped_files,
    "analyzed_counts": analyzed_counts,
}

ORACLE = {
    "page_targets": SQL_PAGE_TARGETS,
    "pr_targets": SQL_PR_TARGETS,
    "stage_outcomes": SQL_STAGE_OUTCOMES,
    "fetch_outcomes": SQL_FETCH_OUTCOMES,
    "capped_files": SQL_CAPPED,
    "analyzed_counts": SQL_ANALYZED,
}
