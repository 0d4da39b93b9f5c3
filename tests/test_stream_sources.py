import base64
import hashlib
import hmac
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from changelens.sources.files import decode_contents, load_files
from changelens.streaming import webhooks as W

SECRET = "s3cret"


def _sign(body: bytes, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def _payload(action, number=7):
    return json.dumps({"action": action, "pull_request": {"number": number},
                       "repository": {"name": "r", "owner": {"login": "o"}}})


def _rows():
    good = _payload("opened", 1)
    return [
        ("d1", "2024-01-01 00:00:00", "pull_request", _sign(good.encode()), good),
        ("d2", "2024-01-01 00:00:01", "pull_request", _sign(b"other"), _payload("opened", 2)),  # tampered
        ("d3", "2024-01-01 00:00:02", "pull_request", None, _payload("opened", 3)),              # no header
        ("d4", "2024-01-01 00:00:03", "push", _sign(_payload("opened", 4).encode()), _payload("opened", 4)),
        ("d5", "2024-01-01 00:00:04", "pull_request", _sign(_payload("closed", 5).encode()), _payload("closed", 5)),
        ("d1", "2024-01-01 00:00:05", "pull_request", _sign(good.encode()), good),              # re-sent
    ]


def _df(spark):
    return spark.createDataFrame(_rows(), W.DELIVERY_SCHEMA.replace("timestamp", "string")).withColumn(
        "ts", F.col("ts").cast("timestamp"))


def test_verify_matches_python_hmac(spark):
    got = [r.valid for r in W.verify_deliveries(_df(spark), SECRET).collect()]
    want = [bool(sig) and hmac.compare_digest(_sign(body.encode()), sig) for _, _, _, sig, body in _rows()]
    assert got == want


def test_long_secret_is_hashed(spark):
    long = "k" * 100
    df = spark.createDataFrame([("x", _sign(b"x", long))], "body string, signature string")
    assert W.verify_deliveries(df, long).collect()[0].valid


def test_missing_secret_fails(spark):
    with pytest.raises(ValueError):
        W.verify_deliveries(_df(spark), None)


def test_relevant_events(spark):
    ev = W.relevant_events(W.verify_deliveries(_df(spark), SECRET))
    assert sorted((r.delivery_id, r.owner, r.repo, r.pr_number) for r in ev.collect()) == [
        ("d1", "o", "r", 1), ("d1", "o", "r", 1)]


def test_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="cl-deliv-")
    with open(os.path.join(folder, "part-0.json"), "w") as fh:
        for d, ts, et, sig, body in _rows():
            fh.write(json.dumps({"delivery_id": d, "ts": ts, "event_type": et, "signature": sig,
                                 "body": body}) + "\n")
    diffs = spark.createDataFrame([("o", "r", 1, "diff --git a/x.py b/x.py\n+print(1)\n")], W_DIFFS)
    out = tempfile.mkdtemp(prefix="cl-out-")
    ckpt = tempfile.mkdtemp(prefix="cl-ckpt-")
    stream = W.read_deliveries(spark, folder, stream=True)
    ans = _answer()
    q = W.review_stream(stream, diffs, lambda p, a=ans: a, SECRET, out, ckpt, dedupe_within="1 hour")
    q.awaitTermination(120)
    streamed = spark.read.parquet(out).select("key", "comment", "is_error").collect()
    batch = W.review_batch(W.relevant_events(W.verify_deliveries(W.read_deliveries(spark, folder, stream=False),
                                                                 SECRET)).dropDuplicates(["delivery_id"]),
                           diffs, lambda p, a=ans: a).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))
    assert len(streamed) == 1 and not streamed[0].is_error


W_DIFFS = "owner string, repo string, pr_number int, diff string"


def _answer():
    return json.dumps({"summary": "ok", "risk_level": "low", "key_changes": [], "files_changed": 1, "issues": []})


def test_missing_diff_gives_error_comment(spark):
    ev = spark.createDataFrame([("o", "r", 9)], "owner string, repo string, pr_number int")
    diffs = spark.createDataFrame([], W_DIFFS)
    ans = _answer()
    rows = W.review_batch(ev, diffs, lambda p, a=ans: a).collect()
    assert len(rows) == 1 and rows[0].is_error


def test_load_files_and_decode(spark):
    root = tempfile.mkdtemp(prefix="cl-files-")
    os.makedirs(os.path.join(root, "repo1", "pkg"))
    with open(os.path.join(root, "repo1", "pkg", "a.py"), "wb") as fh:
        fh.write(b"def f():\n    return '\xff'\n")          # invalid UTF-8 byte dropped
    with open(os.path.join(root, "repo1", "b.tsx"), "w") as fh:
        fh.write("const x = () => 1;\n")
    with open(os.path.join(root, "repo1", "notes.txt"), "w") as fh:
        fh.write("skip")
    got = {(r.repo, r.path): r.content for r in load_files(spark, root).collect()}
    assert got == {("repo1", "pkg/a.py"): "def f():\n    return ''\n", ("repo1", "b.tsx"): "const x = () => 1;\n"}

    text = "héllo\nworld"
    b64 = base64.b64encode(text.encode()).decode()
    wrapped = "\n".join(b64[i:i + 4] for i in range(0, len(b64), 4))
    rows = [("ok", 200, "base64", b64), ("404", 404, "base64", b64), ("enc", 200, "none", b64),
            ("wrap", 200, "base64", wrapped), ("bad", 200, "base64", base64.b64encode(b"a\xffb").decode()),
            ("empty", 200, "base64", "")]
    df = spark.createDataFrame(rows, "path string, status int, encoding string, content string")
    got = {r.path: r.content for r in decode_contents(df).collect()}
    assert got == {"ok": text, "wrap": text, "bad": "ab"}


def test_write_results_is_idempotent(spark):
    from changelens.sources.sinks import write_results
    out = tempfile.mkdtemp(prefix="cl-sink-")
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "part string, key int, v string")
    write_results(df, out, ["part"])
    write_results(df.filter("part = 'a'").withColumn("v", F.lit("z")), out, ["part"])
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("part", "key", "v").collect())
    assert got == [("a", 1, "z"), ("b", 2, "y")]        # partition a replaced, b kept


def test_stream_equals_batch_on_event_log(spark):
    """The whole events-derived delivery log: stream (availableNow, two
    files per trigger) against the batch twin."""
    from changelens.plans import events as P
    folder = tempfile.mkdtemp(prefix="cl-evlog-")
    P.deliveries(spark, "/root/testdata/sf0.001").repartition(4).write.mode("overwrite").json(folder)
    diffs = P.diffs_table(spark, "/root/testdata/sf0.001")
    ans = _answer()
    out, ckpt = tempfile.mkdtemp(prefix="cl-out-"), tempfile.mkdtemp(prefix="cl-ckpt-")
    stream = W.read_deliveries(spark, folder, stream=True, max_files_per_trigger=2)
    q = W.review_stream(stream, diffs, lambda p, a=ans: a, P.TEST_SECRET, out, ckpt)
    q.awaitTermination(300)
    streamed = sorted(map(tuple, spark.read.parquet(out).select("key", "comment", "is_error").collect()))
    batch_ev = W.relevant_events(W.verify_deliveries(W.read_deliveries(spark, folder, stream=False),
                                                     P.TEST_SECRET))
    batch = sorted(map(tuple, W.review_batch(batch_ev, diffs, lambda p, a=ans: a).collect()))
    assert streamed == batch and len(batch) > 0
    assert any(r[2] for r in batch) and any(not r[2] for r in batch)   # errors (no diff) and reviews


def test_load_diffs_text_and_table(spark):
    from changelens.sources.diffs import load_diffs
    from changelens.sources.files import from_table
    root = tempfile.mkdtemp(prefix="cl-diffs-")
    os.makedirs(os.path.join(root, "o1", "r1"))
    with open(os.path.join(root, "o1", "r1", "7.diff"), "w") as fh:
        fh.write("diff --git a/x.py b/x.py\n+1\n")
    got = [tuple(r) for r in load_diffs(spark, root, fmt="text").collect()]
    assert got == [("o1", "r1", 7, "diff --git a/x.py b/x.py\n+1\n")]
    files = spark.createDataFrame([("r", "a.py", 1, "x"), ("r", "b.md", 2, "y"), ("r", "c.tsx", 3, "z")],
                                  "repo string, path string, ord bigint, content string")
    assert sorted(r.path for r in from_table(files).collect()) == ["a.py", "c.tsx"]
