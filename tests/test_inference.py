import json

from pyspark.sql import functions as F

from changelens.operators import inference as I
from changelens.operators import render as R


def _py_strip_fences(raw):
    """The fence rule written out for the test."""
    t = raw.strip()
    if t.startswith("```"):
        t = t.strip("`")
        t = t.replace("json", "", 1).strip()
    return t


def _py_reason(raw, required):
    t = _py_strip_fences(raw)
    try:
        v = json.loads(t)
    except ValueError:
        return "not json"
    if not isinstance(v, dict):
        return "not object"
    missing = sorted(set(required) - v.keys())
    return f"missing keys: {', '.join(missing)}" if missing else None


RESPONSES = [
    '{"a": 1, "b": 2}',
    '```json\n{"a": 1, "b": 2}\n```',
    '```\n{"a": "json here", "b": 2}\n```',       # untagged fence loses the inner "json"
    '```JSON\n{"a": 1, "b": 2}\n```',            # upper-case tag stays -> not json
    'sure, here it is',
    '[1, 2]',
    '{"a": 1}',
    '{"a": null, "b": null, "c": 3}',
    '  \n {"b": 1, "a": 2}  ',
]


def test_strip_fences_and_validate(spark):
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(RESPONSES)], "key string, raw string")
    v = I.validate_responses(df, ["a", "b"]).orderBy(F.col("key").cast("int")).collect()
    assert [r.text for r in v] == [_py_strip_fences(x) for x in RESPONSES]
    assert [r.reject_reason for r in v] == [_py_reason(x, ["a", "b"]) for x in RESPONSES]


def test_parse_valid_and_findings(spark):
    ans = [("k1", json.dumps({"summary": "s", "risk_level": "high", "key_changes": ["x"], "files_changed": 2,
                              "issues": [{"severity": "low", "description": "d1", "confidence": "high"},
                                         {"severity": "high", "description": "d2", "confidence": "low"}]})),
           ("k2", json.dumps({"summary": "t", "risk_level": "weird", "key_changes": [], "files_changed": 0,
                              "issues": []}))]
    df = spark.createDataFrame(ans, "key string, raw string")
    valid = I.parse_valid(I.validate_responses(df, I.REQUIRED_KEYS["review"]), I.REVIEW_SCHEMA)
    f = R.explode_findings(valid).collect()
    assert sorted((r.key, r.pos, r.severity) for r in f if r.pos is not None) == [("k1", 0, "low"), ("k1", 1, "high")]
    assert [r.key for r in f if r.pos is None] == ["k2"]
    counts = {(r.severity, r.confidence): r.n for r in R.finding_counts(R.explode_findings(valid)).collect()}
    assert counts[(None, None)] == 1
    comments = {r.key: r.comment for r in R.render_comments(valid).collect()}
    assert comments["k1"].split("\n") == [
        R.TITLE, "", "**Risk level:** \U0001F534 high  ", "**Files changed:** 2", "", "s", "", "### Key changes",
        "- x", "", "### Potential issues", "- **[LOW]** d1 _(confidence: high)_",
        "- **[HIGH]** d2 _(confidence: low)_", "", R.FOOTER]
    assert "⚪ weird" in comments["k2"] and R.NO_ISSUES in comments["k2"]


def test_comment_lines_equal_rendered(spark):
    heads = spark.createDataFrame([("k1", "low", 1, "s", ["c"]), ("k2", "medium", 0, "t", [])],
                                  "key string, risk_level string, files_changed int, summary string, key_changes array<string>")
    findings = spark.createDataFrame([("k1", 0, "high", "d", "low"), ("k1", 1, "low", "e", "high")],
                                     "key string, pos int, severity string, description string, confidence string")
    lines = R.render_comment_lines(heads, findings)
    joined = {k: "\n".join(l for _, l in sorted(v)) for k, v in _group(lines.collect()).items()}
    reviews = heads.join(
        findings.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "severity", "description",
                                                                          "confidence"))).alias("i")), "key", "left")
    reviews = reviews.withColumn("issues", F.transform(F.coalesce("i", F.array()), lambda x: F.struct(
        x["severity"].alias("severity"), x["description"].alias("description"), x["confidence"].alias("confidence"))))
    rendered = {r.key: r.comment for r in R.render_comments(reviews).collect()}
    assert joined == rendered


def _group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.key, []).append((r.line_no, r.line))
    return out


def test_batch_infer_failures_become_rows(spark):
    def fn(p):  # no module globals: the worker cannot import test modules
        if "boom" in p:
            raise RuntimeError("Rate limit hit")
        if "slow" in p:
            raise TimeoutError("deadline exceeded")
        if "empty" in p:
            return "   "
        return '{"ok": true}'
    req = spark.createDataFrame([("a", "review", "fine"), ("b", "review", "boom"), ("c", "review", "slow"),
                                 ("d", "review", "empty")], "key string, kind string, prompt string")
    got = {r.key: (r.raw, r.error_category) for r in I.batch_infer(req, fn).collect()}
    assert got == {"a": ('{"ok": true}', None), "b": (None, "rate_limited"), "c": (None, "timeout"),
                   "d": (None, "unusable")}


def test_build_requests(spark):
    df = spark.createDataFrame([("k", "x" * 15001, "Go", "testing")],
                               "key string, diff string, language string, framework string")
    whole = I.build_requests(df, "tests").collect()[0]
    assert not whole.truncated and "x" * 15001 in whole.prompt
    r = I.build_requests(df, "tests", max_chars=15000).collect()[0]
    assert r.truncated and "Go" in r.prompt and "... (diff truncated for length)" in r.prompt
    assert "<<" not in r.prompt


def test_tests_report(spark):
    rows = [("Python", "", []), ("Python", "code", ["f", "g"]), ("Go", "code", ["f"])]
    df = spark.createDataFrame(rows, "language string, test_code string, functions_covered array<string>")
    s = {r.language: (r.n_answers, r.n_empty_code, r.n_covered) for r in R.tests_summary(df).collect()}
    assert s == {"Python": (2, 1, 2), "Go": (1, 0, 1)}
    c = {(r.language, r.function): r.n for r in R.covered_functions(df).collect()}
    assert c == {("Python", "n/a"): 1, ("Python", "f"): 1, ("Python", "g"): 1, ("Go", "f"): 1}


def test_architecture_answers(spark):
    good = json.dumps({"overview": "o", "components": [{"name": "a.py", "role": "r"}],
                       "mermaid_diagram": "graph TD\n  a --> b"})
    missing = json.dumps({"overview": "o", "components": []})
    df = spark.createDataFrame([("r1", good), ("r2", missing)], "key string, raw string")
    v = {r.key: r.reject_reason for r in I.validate_responses(df, I.REQUIRED_KEYS["architecture"]).collect()}
    assert v == {"r1": None, "r2": "missing keys: mermaid_diagram"}
    parsed = I.parse_valid(I.validate_responses(df, I.REQUIRED_KEYS["architecture"]), I.ARCHITECTURE_SCHEMA)
    row = parsed.collect()[0]
    assert row.components[0].name == "a.py" and row.mermaid_diagram.startswith("graph TD")


def test_long_answers_with_escapes(spark):
    """Strings of a megabyte and of many escapes are checked without recursion."""
    import json
    rows = [("big", json.dumps({"k": "x" * 1_000_000})), ("esc", json.dumps({"k": '"\\\n' * 200_000})),
            ("tail", json.dumps({"k": '"' * 5000}) + " x")]
    df = spark.createDataFrame(rows, "key string, raw string")
    got = {r.key: r.reject_reason for r in I.validate_responses(df, ["k"]).collect()}
    assert got == {"big": None, "esc": None, "tail": "not json"}


def test_type_drift_is_rejected(spark):
    rows = [("none", '{"summary": "s", "risk_level": "low", "key_changes": [], "files_changed": 1, "issues": "none"}'),
            ("text", '{"summary": "s", "risk_level": "low", "key_changes": [], "files_changed": "3", "issues": []}'),
            ("null", '{"summary": null, "risk_level": "low", "key_changes": [], "files_changed": null, "issues": []}')]
    df = spark.createDataFrame(rows, "key string, raw string")
    v = I.validate_responses(df, I.REQUIRED_KEYS["review"], types=I.KEY_TYPES["review"])
    assert {r.key: r.reject_reason for r in v.collect()} == {
        "none": "wrong types: issues", "text": "wrong types: files_changed", "null": None}


def test_finding_counts_collect_nothing_per_key(spark):
    from changelens.plans import reviews
    plan = reviews.finding_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan


def test_few_prompts_are_held_at_once(spark, monkeypatch):
    """A batch of many prompts is asked in parts: the rows that leave Python first
    come before the last prompts are read."""
    import pyarrow as pa

    from changelens.operators import inference
    seen = []
    runs = {}
    requests = spark.createDataFrame([("k", "review", "p")], "key string, kind string, prompt string")
    monkeypatch.setattr(type(requests), "mapInArrow", lambda self, run, schema: runs.update(run=run))
    inference.batch_infer(requests, lambda p: seen.append(p) or ("" if p == "p3" else p.upper()))
    n = 3 * inference.HELD_PROMPTS + 7
    prompts = [None if i == 5 else f"p{i}" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(n)]), pa.array(["review"] * n), pa.array(prompts)], names=["key", "kind", "prompt"])
    out = runs["run"](iter([batch]))
    first = next(out)
    assert first.num_rows == inference.HELD_PROMPTS and len(seen) == inference.HELD_PROMPTS - 1
    rows = first.to_pylist() + [r for b in out for r in b.to_pylist()]
    assert [r["key"] for r in rows] == [str(i) for i in range(n)]
    assert rows[5]["error_category"] == "no_input" and rows[3]["error_category"] == "unusable" and rows[-1]["raw"] == f"P{n - 1}"
