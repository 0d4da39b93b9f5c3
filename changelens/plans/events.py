"""Registered queries: sources and the signed delivery stream (batch twins).

Bindings: ``events`` become webhook deliveries - the body is a change-event
JSON (action from the event type, number = event id), signed with a test
secret; deliveries of type ``signup`` with value < 10 carry a signature of
another body (tampered), ``error`` deliveries with value < 5 carry none, and
value > 45 marks a different event name.  ``documents`` are the diffs of
changes 0..n-1 of one repo; ``benchmark`` texts are base64 payloads;
``pages`` are listed files (repo = host, path = URL path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256_hex
from ..functions.text import is_blank
from ..operators.languages import attach_language, known_suffix
from ..sources.files import decode_contents
from ..streaming import webhooks as W
from .common import spread, table
from ..operators import inference as I
from ..operators import render as R
from .reviews import _lit, _tmpl, sql_stub_comment, stub_model

# Fixed test bindings.
TEST_SECRET = "changelens-test-secret"
EVENT_ACTION = {"view": "opened", "click": "synchronize", "purchase": "closed",
                "signup": "reopened", "error": "labeled"}
OWNER, REPO = "acme", "site"


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events"))
    action = F.lit(None).cast("string")
    for k, v in EVENT_ACTION.items():
        action = F.when(F.col("event_type") == k, F.lit(v)).otherwise(action)
    body = F.concat(F.lit('{"action": "'), action, F.lit('", "pull_request": {"number": '),
                    F.col("event_id").cast("string"),
                    F.lit(f'}}, "repository": {{"name": "{REPO}", "owner": {{"login": "{OWNER}"}}}}}}'))
    d = ev.select(F.col("event_id").cast("string").alias("delivery_id"),
                  F.col("ts").cast("timestamp").alias("ts"),
                  F.when(F.col("value") > 45, F.lit("push")).otherwise(F.lit(W.EVENT_NAME)).alias("header"),
                  "event_type", "value", body.alias("body"))
    signed_body = F.when((F.col("event_type") == "signup") & (F.col("value") < 10),
                         F.concat(F.col("body"), F.lit(" "))).otherwise(F.col("body"))
    sig = F.concat(F.lit(W.SIGNATURE_PREFIX), hmac_sha256_hex(TEST_SECRET, F.encode(signed_body, "UTF-8")))
    sig = F.when((F.col("event_type") == "error") & (F.col("value") < 5), F.lit(None)).otherwise(sig)
    return d.select("delivery_id", "ts", F.col("header").alias("event_type"), sig.alias("signature"), "body")


def signed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = W.verify_deliveries(deliveries(spark, sf_dir), TEST_SECRET)
    return v.select("delivery_id", "valid")


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = W.verify_deliveries(deliveries(spark, sf_dir), TEST_SECRET)
    return W.relevant_events(v).drop("ts")


def diffs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.lit(OWNER).alias("owner"), F.lit(REPO).alias("repo"),
        F.col("doc_id").cast("int").alias("pr_number"), F.col("text").alias("diff"))


def review_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's per-batch job on the whole delivery log (its batch twin)."""
    ev = review_events(spark, sf_dir)
    return W.review_batch(ev, diffs_table(spark, sf_dir), stub_model)


def diff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("owner")).agg(
        F.count(F.lit(1)).alias("n_diffs"),
        F.sum(F.length("text")).cast("long").alias("total_chars"),
        F.sum(F.when(is_blank("text"), 1).otherwise(0)).cast("long").alias("n_blank"))


def decoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    payloads = b.select("item_id", F.lit(200).alias("status"), F.lit("base64").alias("encoding"),
                        F.base64(F.encode("text", "UTF-8")).alias("content"))
    out = decode_contents(payloads)
    return out.select("item_id", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("repo"),
        F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"), "page_id")
    p = p.withColumn("ext", F.regexp_extract("path", r"(\.[^./]*)$", 1))
    p = p.withColumn("scanned", known_suffix("path").isNotNull())
    return attach_language(p, "ext").select("page_id", "repo", "path", "ext", "scanned",
                                            "lang_group", "language", "framework")


# --------------------------------------------------------------------------
# DuckDB twins
# --------------------------------------------------------------------------

def _pads(secret: str) -> tuple[str, str]:
    key = secret.encode().ljust(64, b"\0")
    return (bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex())


_IPAD, _OPAD = _pads(TEST_SECRET)
_ACT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_ACTION.items())

SQL_DELIVERIES = f"""
d0 AS (
  SELECT CAST(event_id AS VARCHAR) AS delivery_id, event_type AS et, value,
         CASE WHEN value > 45 THEN 'push' ELSE 'pull_request' END AS event_type,
         '{{"action": "' || (CASE event_type {_ACT} END) || '", "pull_request": {{"number": ' ||
         CAST(event_id AS VARCHAR) || '}}, "repository": {{"name": "{REPO}", "owner": {{"login": "{OWNER}"}}}}}}' AS body
  FROM events
),
d AS (
  SELECT delivery_id, event_type, body,
         CASE WHEN et = 'error' AND value < 5 THEN NULL ELSE
           'sha256=' || sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') ||
             encode(CASE WHEN et = 'signup' AND value < 10 THEN body || ' ' ELSE body END)))) END AS signature
  FROM d0
),
v AS (
  SELECT *, coalesce(signature IS NOT NULL AND length(signature) > 0 AND
           signature = 'sha256=' || sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(body)))),
           false) AS valid
  FROM d
)"""

SQL_SIGNED = f"WITH {SQL_DELIVERIES}\nSELECT delivery_id, valid FROM v\n"

SQL_REVIEW_EVENTS = f"""
WITH {SQL_DELIVERIES}
SELECT delivery_id, json_extract_string(body, '$.repository.owner.login') AS owner,
       json_extract_string(body, '$.repository.name') AS repo,
       CAST(json_extract(body, '$.pull_request.number') AS INTEGER) AS pr_number,
       json_extract_string(body, '$.action') AS action
FROM v
WHERE valid AND event_type = 'pull_request'
  AND json_extract_string(body, '$.action') IN ('opened', 'reopened', 'synchronize')
"""

SQL_REVIEW_BATCH = f"""
WITH {SQL_DELIVERIES},
e AS (SELECT CAST(json_extract(body, '$.pull_request.number') AS INTEGER) AS n FROM v
      WHERE valid AND event_type = 'pull_request'
        AND json_extract_string(body, '$.action') IN ('opened', 'reopened', 'synchronize')),
r AS (SELECT '{OWNER}/{REPO}/' || e.n AS key, d.text,
             {_tmpl(I.REVIEW_TEMPLATE, {"DIFF": "d.text"})} AS prompt
      FROM e LEFT JOIN documents d ON d.doc_id = e.n)
SELECT key, CASE WHEN text IS NULL THEN {_lit(R.ERROR_PREFIX + "the change has no diff to analyse")}
            ELSE {sql_stub_comment("prompt")} END AS comment, text IS NULL AS is_error FROM r
"""

SQL_DIFF_TOTALS = r"""
SELECT source AS owner, CAST(count(*) AS BIGINT) AS n_diffs, CAST(sum(length(text)) AS BIGINT) AS total_chars,
       CAST(sum(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_blank
FROM documents GROUP BY source
"""

SQL_DECODED = """
SELECT item_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS content_md5
FROM (SELECT item_id, decode(from_base64(to_base64(encode(text)))) AS t FROM benchmark) WHERE length(t) > 0
"""


def _sql_page_files():
    from ..operators.languages import SCAN_GROUPS, TEST_LANGUAGES, GENERIC_LANGUAGE, GENERIC_FRAMEWORK
    grp = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCAN_GROUPS.items())
    lang = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in TEST_LANGUAGES.items())
    fw = " ".join("WHEN '%s' THEN '%s'" % (k, v[1].replace("'", "''")) for k, v in TEST_LANGUAGES.items())
    scanned = " OR ".join(f"ends_with(path, '{k}')" for k in SCAN_GROUPS)
    return rf"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages
),
e AS (SELECT *, regexp_extract(path, '(\.[^./]*)$', 1) AS ext FROM p)
SELECT page_id, repo, path, ext, ({scanned}) AS scanned,
       CASE ext {grp} END AS lang_group,
       coalesce(CASE ext {lang} END, '{GENERIC_LANGUAGE}') AS language,
       coalesce(CASE ext {fw} END, '{GENERIC_FRAMEWORK}') AS framework
FROM e
"""


QUERIES = {
    "signed_deliveries": signed_deliveries,
    "review_events": review_events,
    "review_batch": review_batch,
    "diff_totals": diff_totals,
    "decoded_payloads": decoded_payloads,
    "page_files": page_files,
}

ORACLE = {
    "signed_deliveries": SQL_SIGNED,
    "review_events": SQL_REVIEW_EVENTS,
    "review_batch": SQL_REVIEW_BATCH,
    "diff_totals": SQL_DIFF_TOTALS,
    "decoded_payloads": SQL_DECODED,
    "page_files": _sql_page_files(),
}
