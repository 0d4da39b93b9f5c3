"""Registered queries: jobs that write and go on from what they wrote.

Each query lands its input in a fresh folder under the shared checkpoint
folder, runs the job there as two runs (the second goes on after the first, as after
a restart), and reads the sink back.

Bindings: ``events`` are deliveries (id = event id, as in ``events``); a
delivery's change is the document of its number, whose language and source are
owner and repo, and ``documents`` are the diffs of those changes, landed in one
folder per owner and repo.  Deliveries of the month's first half are sent
again after ten minutes; those of its first two weeks once more after thirty days.
``pages`` are source files of their host's repo, landed as files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256_hex
from ..operators import inference as I
from ..operators import render as R
from ..session import checkpoint_path
from ..sources.diffs import load_diffs, write_diffs
from ..sources.files import land_files, load_files
from ..sources.sinks import read_by_key, write_results
from ..streaming import webhooks as W
from .common import spread, table
from .events import EVENT_ACTION, TEST_SECRET
from .reviews import _lit, _tmpl, sql_stub_comment, stub_model

# Fixed test bindings.
HALF, EARLY = "2024-01-16", "2024-01-14"
WITHIN = "1 hour"
FILES_PER_BATCH = 256
KEY_FOLDERS = 32


def _folder(spark: SparkSession, name: str) -> str:
    return checkpoint_path(spark, "plans", f"{name}-{uuid.uuid4().hex}")


def change_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed deliveries of changes in many repositories; some tampered, some without a signature."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "lang", "source")
    ev = table(spark, sf_dir, "events").join(docs, "event_id", "left")
    action = F.lit(None).cast("string")
    for k, v in EVENT_ACTION.items():
        action = F.when(F.col("event_type") == k, F.lit(v)).otherwise(action)
    body = F.to_json(F.struct(
        action.alias("action"), F.struct(F.col("event_id").alias("number")).alias("pull_request"),
        F.struct(F.coalesce("source", F.lit("none")).alias("name"),
                 F.struct(F.coalesce("lang", F.lit("none")).alias("login")).alias("owner")).alias("repository")))
    ev = ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", body.alias("body"))
    tampered = (F.col("event_type") == "signup") & (F.col("value") < 10)
    signed = F.when(tampered, F.concat("body", F.lit(" "))).otherwise(F.col("body"))
    signature = F.concat(F.lit(W.SIGNATURE_PREFIX), hmac_sha256_hex(TEST_SECRET, F.encode(signed, "UTF-8")))
    return ev.select(
        F.col("event_id").cast("string").alias("delivery_id"), "ts",
        F.when(F.col("value") > 45, F.lit("push")).otherwise(F.lit(W.EVENT_NAME)).alias("event_type"),
        F.when((F.col("event_type") == "error") & (F.col("value") < 5), F.lit(None)).otherwise(signature).alias("signature"), "body")


def streamed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review stream over delivery files: half of them, then, after a restart
    from the checkpoint, the rest; its sink read back."""
    base = _folder(spark, "reviews")
    write_diffs(table(spark, sf_dir, "documents").select(
        F.col("lang").alias("owner"), F.col("source").alias("repo"), F.col("doc_id").cast("int").alias("pr_number"),
        F.col("text").alias("diff")), f"{base}/diffs")
    deliveries = change_deliveries(spark, sf_dir)
    for half in (F.col("ts") < HALF, F.col("ts") >= HALF):
        deliveries.filter(half).write.mode("append").json(f"{base}/deliveries")
        stream = W.read_deliveries(spark, f"{base}/deliveries", max_files_per_trigger=FILES_PER_BATCH)
        W.review_stream(stream, load_diffs(spark, f"{base}/diffs"), stub_model, TEST_SECRET, f"{base}/comments",
                        f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/comments").select("key", "comment", "is_error")


def resent_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that the stream takes when many are sent twice or three times."""
    base = _folder(spark, "resent")
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("delivery_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.lit(None).cast("string").alias("signature"), F.col("props").alias("body"))
    first, second = ev.filter(F.col("ts") < HALF), ev.filter(F.col("ts") >= HALF)
    again = first.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    later = first.filter(F.col("ts") < EARLY).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    for sent in (first.unionByName(again), second.unionByName(again).unionByName(later)):
        sent.write.mode("append").json(f"{base}/deliveries")
        stream = W.without_resent(W.read_deliveries(spark, f"{base}/deliveries"), WITHIN)
        W.land_stream(stream.select("delivery_id", "event_type", "body"), f"{base}/taken", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/taken").groupBy("delivery_id", "event_type", "body").agg(F.count(F.lit(1)).alias("n_taken"))


def keyed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table by key after two writes: one row a document, then other
    rows, of another run, for the documents that have a label."""
    path = _folder(spark, "results")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("result"), F.lit(1).alias("run"))
    labels = table(spark, sf_dir, "labels").select("doc_id")
    redone = (table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi")
              .select("doc_id", "source", F.md5(F.reverse("text")).alias("result"), F.lit(2).alias("run")))
    for rows in (docs, redone):
        write_results(rows, path, key=["doc_id"], folders=KEY_FOLDERS)
    return read_by_key(spark, path)


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed as source files and listed again, numbered per repo."""
    root = _folder(spark, "files")
    pages = spread(table(spark, sf_dir, "pages"))
    ext = F.when(F.col("url").endswith("top"), ".tsx").when(F.col("url").endswith("html"), ".md").otherwise(".py")
    land_files(pages.select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("repo"),
                            F.concat(F.lit("src/p"), F.col("page_id").cast("string"), ext).alias("path"), F.col("html").alias("content")), root)
    return load_files(spark, root).select("repo", "path", "ord", F.md5("content").alias("content_md5"))


def limited_model(prompt: str) -> str:
    """The stand-in model under a rate limit that stops prompts of odd length."""
    if len(prompt) % 2:
        raise RuntimeError("rate limit reached")
    return stub_model(prompt)


def ledger_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews through an answer ledger: a first run that the rate limit stops
    half-way, and a second one that asks only what is missing."""
    ledger = _folder(spark, "ledger")
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("key"), F.col("text").alias("diff"))
    requests = I.build_requests(docs, "review")
    I.ledger_infer(requests, limited_model, ledger, waves=2)
    answers = I.ledger_infer(requests, stub_model, ledger, waves=2)
    valid = I.parse_valid(I.validate_responses(answers, I.REQUIRED_KEYS["review"], types=I.KEY_TYPES["review"]), I.REVIEW_SCHEMA)
    return R.render_comments(valid)


SQL_STREAMED_REVIEWS = f"""
WITH e AS (
  SELECT event_id, lang, source, text, {_tmpl(I.REVIEW_TEMPLATE, {"DIFF": "text"})} AS prompt
  FROM events LEFT JOIN documents ON doc_id = event_id
  WHERE value <= 45 AND event_type IN ('view', 'click', 'signup') AND NOT (event_type = 'signup' AND value < 10)
),
r AS (SELECT *, text IS NOT NULL AND regexp_matches(text, '\\S') AS ok FROM e)
SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || event_id AS key,
       CASE WHEN ok THEN {sql_stub_comment("prompt")} ELSE {_lit(R.ERROR_PREFIX + "the change has no diff to analyse")} END AS comment,
       NOT ok AS is_error FROM r
"""

SQL_RESENT = f"""
WITH s AS (
  SELECT event_id, event_type, props, ts FROM events
  UNION ALL SELECT event_id, event_type, props, ts + INTERVAL 10 MINUTE FROM events WHERE ts < '{HALF}'
  UNION ALL SELECT event_id, event_type, props, ts + INTERVAL 10 MINUTE FROM events WHERE ts < '{HALF}'
  UNION ALL SELECT event_id, event_type, props, ts + INTERVAL 30 DAY FROM events WHERE ts < '{EARLY}'
),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY event_id ORDER BY ts) AS since FROM s)
SELECT CAST(event_id AS VARCHAR) AS delivery_id, event_type, props AS body, CAST(count(*) AS BIGINT) AS n_taken
FROM g WHERE since IS NULL OR since > INTERVAL 1 HOUR GROUP BY ALL
"""

SQL_KEYED = """
SELECT doc_id, source, CASE WHEN l THEN md5(reverse(text)) ELSE md5(text) END AS result, CASE WHEN l THEN 2 ELSE 1 END AS run
FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents)
"""

SQL_LISTED = r"""
WITH f AS (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo,
         'src/p' || page_id || CASE WHEN url LIKE '%top' THEN '.tsx' WHEN url LIKE '%html' THEN '.md' ELSE '.py' END AS path, html FROM pages
)
SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY encode(path)) AS ord, md5(html) AS content_md5
FROM f WHERE html IS NOT NULL AND path NOT LIKE '%.md'
"""

SQL_LEDGER = f"""
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS key, {_tmpl(I.REVIEW_TEMPLATE, {"DIFF": "text"})} AS prompt FROM documents)
SELECT key, {sql_stub_comment("prompt")} AS comment FROM r
"""

QUERIES = {
    "streamed_reviews": streamed_reviews,
    "resent_deliveries": resent_deliveries,
    "keyed_results": keyed_results,
    "listed_files": listed_files,
    "ledger_reviews": ledger_reviews,
}

ORACLE = {
    "streamed_reviews": SQL_STREAMED_REVIEWS,
    "resent_deliveries": SQL_RESENT,
    "keyed_results": SQL_KEYED,
    "listed_files": SQL_LISTED,
    "ledger_reviews": SQL_LEDGER,
}
