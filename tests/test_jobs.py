"""Jobs that write and go on: keyed tables, landed files, pruned diffs, answer ledger, re-sent deliveries."""

import collections
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from changelens.operators import inference as I
from changelens.operators.caps import number_in_order
from changelens.sources.diffs import load_diffs, write_diffs
from changelens.sources.files import land_files, load_files
from changelens.sources.sinks import read_by_key, write_results
from changelens.streaming import webhooks as W


def _dir(name):
    return tempfile.mkdtemp(prefix=f"cl-{name}-")


def _table(spark, path):
    return sorted(map(tuple, read_by_key(spark, path).select("a", "b", "v").collect()), key=str)


KEYED = "a string, b int, v string"


def test_rows_are_replaced_by_key(spark):
    path = os.path.join(_dir("keyed"), "t")
    write_results(spark.createDataFrame([("x", 1, "old"), ("x", 2, "old"), (None, 1, "old"), ("y", 1, "old")], KEYED), path, key=["a", "b"], folders=4)
    new = [("x", 1, "new"), ("x", 1, "more"), (None, 1, "new"), ("z", None, "new")]
    for _ in range(2):          # the same write again changes nothing
        write_results(spark.createDataFrame(new, KEYED), path, key=["a", "b"], folders=4)
        assert _table(spark, path) == sorted(new + [("x", 2, "old"), ("y", 1, "old")], key=str)
    write_results(spark.createDataFrame([], KEYED), path, key=["a", "b"], folders=4)
    assert len(_table(spark, path)) == 6


def test_a_failed_write_leaves_the_table(spark):
    path = os.path.join(_dir("killed"), "t")
    rows = spark.createDataFrame([(f"k{i}", i, "old") for i in range(50)], KEYED)
    write_results(rows, path, key=["a"], folders=8)
    before = _table(spark, path)
    broken = rows.withColumn("v", F.when(F.col("b") == 30, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        write_results(broken, path, key=["a"], folders=8)
    assert _table(spark, path) == before


def test_numbers_follow_the_order_of_each_key(spark):
    rows = [("hot", i % 700) for i in range(2000)] + [("one", 5), (None, 2), (None, 1)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(7)
    got = collections.defaultdict(list)
    for r in number_in_order(df, ["k"], ["o"]).collect():
        got[r.k].append((r.ord, r.o))
    for k, pairs in got.items():
        pairs.sort()
        assert [n for n, _ in pairs] == list(range(1, len(pairs) + 1)) and [o for _, o in pairs] == sorted(o for x, o in rows if x == k)
    assert number_in_order(df.limit(0), ["k"], ["o"]).count() == 0


def test_files_are_landed_and_listed(spark):
    root = _dir("land")
    rows = [("r", f"d{i % 3}/f{i}.py", f"x = {i}\n") for i in range(40)] + [("q", "a.ts", "é"), ("q", "b.md", "no"), ("q", "c.js", None)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    for _ in range(2):
        assert land_files(files.repartition(5), root) == 42
    got = sorted(map(tuple, load_files(spark, root).collect()))
    paths = sorted(p for r, p, _ in rows if r == "r")
    content = {p: c for _, p, c in rows}
    assert got == [("q", "a.ts", 1, "é")] + sorted(("r", p, n + 1, content[p]) for n, p in enumerate(paths))


def test_only_the_named_repositories_are_read(spark):
    path = _dir("diffs")
    write_diffs(spark.createDataFrame([(f"o{i % 3}", f"r{i % 5}", i, f"d{i}") for i in range(60)], "owner string, repo string, pr_number int, diff string"), path)
    events = spark.createDataFrame([("o1", "r1", 1), ("o1", "r1", 16), ("o2", "r9", 2)], "owner string, repo string, pr_number int")
    pruned = W.prune_diffs(load_diffs(spark, path), events)
    assert "dynamicpruning" in pruned._jdf.queryExecution().executedPlan().toString()
    assert {(r.owner, r.repo) for r in pruned.collect()} == {("o1", "r1")}
    whole = W.prune_diffs(load_diffs(spark, path), events, most=1)     # too many repositories: the table as it is
    assert whole.count() == 60
    assert sorted(r.is_error for r in W.review_batch(events, pruned, lambda p: "x").collect()) == [True, True, True]


def _asking(log, stop_at=None, limit=None):
    def fn(prompt):
        if stop_at and stop_at in prompt:
            raise KeyboardInterrupt      # ends the task, unlike a failed call
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if limit and prompt.endswith(limit):
            raise RuntimeError("rate limit reached")
        return f"answer to {prompt}"
    return fn


def _calls(log):
    if not os.path.exists(log):
        return collections.Counter()
    with open(log) as f:
        return collections.Counter(f.read().split("\n")[:-1])


def test_answers_survive_a_run_that_dies(spark):
    base = _dir("ledger")
    ledger, log = f"{base}/ledger", f"{base}/calls"
    rows = [(str(i), "review", f"prompt {i % 40}") for i in range(120)] + [("none", "review", None)]
    requests = spark.createDataFrame(rows, "key string, kind string, prompt string")
    with pytest.raises(Exception):
        I.ledger_infer(requests, _asking(log, stop_at="prompt 7"), ledger, waves=8)
    stored = {r.prompt_hash for r in I.read_ledger(spark, ledger).collect()} if os.path.exists(ledger) else set()
    first = _calls(log)
    answers = {r.key: r for r in I.ledger_infer(requests, _asking(log), ledger, parallelism=3, waves=8).collect()}
    import hashlib
    kept = {p for p in first if hashlib.sha256(p.encode()).hexdigest() in stored}
    assert all(_calls(log)[p] == 1 for p in kept) and set(_calls(log)) == {f"prompt {i}" for i in range(40)}
    assert all(answers[k].raw == f"answer to {p}" for k, _, p in rows if p)
    assert answers["none"].error_category == "no_input" and answers["none"].raw is None and len(answers) == 121
    before = _calls(log)
    assert I.ledger_infer(requests, _asking(log), ledger, waves=8).count() == 121 and _calls(log) == before


def test_each_prompt_is_asked_once_and_limits_again(spark):
    base = _dir("ledger")
    ledger, log = f"{base}/ledger", f"{base}/calls"
    requests = spark.createDataFrame([(str(i), "tests", f"p{i % 10}") for i in range(60)], "key string, kind string, prompt string")
    got = I.ledger_infer(requests, _asking(log, limit="3"), ledger, waves=3).collect()
    assert {r.error_category for r in got if r.raw is None} == {"rate_limited"} and sum(r.raw is None for r in got) == 6
    assert set(_calls(log).values()) == {1}
    assert all(r.raw for r in I.ledger_infer(requests, _asking(log), ledger, waves=3).collect())
    assert _calls(log) == collections.Counter({f"p{i}": 2 if i == 3 else 1 for i in range(10)})


def test_resent_deliveries_are_taken_once(spark):
    folder, out, ckpt = _dir("in"), os.path.join(_dir("out"), "t"), _dir("ckpt")
    rows = lambda *r: spark.createDataFrame([(i, t, "e", None, "b") for i, t in r], W.DELIVERY_SCHEMA.replace("timestamp", "string"))
    for sent in (rows(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 05:00:00")),
                 rows(("a", "2024-01-01 00:20:00"), ("b", "2024-01-01 05:30:00"), ("a", "2024-01-02 00:00:00"), ("c", "2024-01-01 01:00:00"))):
        sent.write.mode("append").json(folder)
        W.land_stream(W.without_resent(W.read_deliveries(spark, folder), "1 hour"), out, ckpt).awaitTermination(120)
    got = sorted((r.delivery_id, str(r.ts.date())) for r in spark.read.parquet(out).collect())
    # one of those that came again in time stays, whichever the batch reads first; c is older than the watermark
    assert got == [("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-01")]
