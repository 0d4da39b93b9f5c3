"""Randomised agreement with the Python rules (one Spark job per property)."""

import json
import random
import re

from pyspark.sql import functions as F

from changelens.operators import inference as I
from changelens.operators import targets


def _py_fences(raw):
    t = raw.strip()
    if t.startswith("```"):
        t = t.strip("`").replace("json", "", 1).strip()
    return t


def _py_reason(raw, required):
    t = _py_fences(raw)
    try:
        v = json.loads(t)
    except ValueError:
        return "not json"
    if not isinstance(v, dict):
        return "not object"
    missing = sorted(set(required) - v.keys())
    return f"missing keys: {', '.join(missing)}" if missing else None


def _answers(n=300, seed=7):
    rnd = random.Random(seed)
    pieces = ["```", "json", "JSON", " ", "\n", "\t", '{"a": 1', ', "b": [1, 2]', "}", "[", "]", '"x"',
              "3", "null", "`", "{}", '{"a": "json"}', ","]
    out = []
    for _ in range(n):
        out.append("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 7))))
    return out


def test_fences_and_validation_agree_with_python(spark):
    raws = _answers()
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "key int, raw string")
    got = {r.key: (r.text, r.reject_reason) for r in I.validate_responses(df, ["a", "b"]).collect()}
    for i, raw in enumerate(raws):
        assert got[i] == (_py_fences(raw), _py_reason(raw, ["a", "b"])), raw


def _urls(n=300, seed=11):
    rnd = random.Random(seed)
    parts = ["https://", "http://", "github.com/", "gitlab.com/", "o", "r", ".git", "/", "pull/", "12", "x",
             " ", "\t", "/files", "-", "_"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def test_targets_agree_with_python(spark):
    urls = _urls()
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    pr = {r.i: (None if r.reject_reason else (r.owner, r.repo, r.pr_number))
          for r in targets.parse_targets(df, "url", "pr").collect()}
    repo = {r.i: (None if r.reject_reason else (r.owner, r.repo))
            for r in targets.parse_targets(df, "url", "repo").collect()}
    for i, u in enumerate(urls):
        m = re.match(r"https://github\.com/([^/]+)/([^/]+)/pull/(\d+)", u.strip())
        assert pr[i] == ((m.group(1), m.group(2), int(m.group(3))) if m else None), u
        m = re.match(r"https://github\.com/([^/]+)/([^/]+)", u.strip())
        want = None
        if m:
            name = m.group(2).rstrip("/")
            want = (m.group(1), name[:-4] if name.endswith(".git") else name)
        assert repo[i] == want, u
