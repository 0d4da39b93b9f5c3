import re
from collections import Counter

from pyspark.sql import functions as F

from changelens.operators import caps, diffs, outcomes, targets
from changelens.operators.languages import GENERIC_LANGUAGE, TEST_LANGUAGES, attach_language


def _py_primary(diff):
    exts = re.compile(r"^diff --git a/.+?(\.\w+) b/", re.MULTILINE).findall(diff)
    if not exts:
        return GENERIC_LANGUAGE
    best, _ = Counter(exts).most_common(1)[0]
    return TEST_LANGUAGES.get(best, (GENERIC_LANGUAGE, ""))[0]


DIFFS = {
    "k1": "diff --git a/x.py b/x.py\n+a\ndiff --git a/y.js b/y.js\ndiff --git a/z.js b/z.js\n",
    "k2": "diff --git a/a.ts b/a.ts\ndiff --git a/b.py b/b.py\n",          # tie -> first seen
    "k3": "diff --git a/Makefile b/Makefile\ndiff --git a/.env b/.env\n",   # no extension, dot-file
    "k4": "diff --git a/types.d.ts b/types.d.ts\n",                          # .d.ts -> .ts
    "k5": "diff --git a/M.PY b/M.PY\n",                                      # case kept -> unknown
    "k6": "diff --git a/a.txt b/a.txt\ndiff --git a/b.txt b/b.txt\ndiff --git a/c.py b/c.py\n",
    "k7": "",
}


def test_explode_and_primary_language(spark):
    df = spark.createDataFrame(list(DIFFS.items()), "key string, diff string")
    files = diffs.explode_diff_files(df, ["key"])
    got = {r.key: r.language for r in diffs.primary_language(files, ["key"], keys=df).collect()}
    assert got == {k: _py_primary(v) for k, v in DIFFS.items()}
    exts = {(r.key, r.ext) for r in files.collect()}
    assert ("k4", ".ts") in exts and ("k5", ".PY") in exts
    assert not [e for k, e in exts if k == "k3"]


def test_truncation_edges(spark):
    n = diffs.MAX_DIFF_CHARS
    df = spark.createDataFrame([("a", "x" * n), ("b", "y" * (n + 1))], "key string, diff string")
    got = {r.key: (r.diff_truncated, len(r.diff)) for r in diffs.truncate_diff(df).collect()}
    assert got["a"] == (False, n)
    assert got["b"] == (True, n + len(diffs.TRUNCATION_SUFFIX))


def test_headers_within_truncation(spark):
    frag = "diff --git a/f.py b/f.py\n" + "+" * 9000 + "\n"
    rows = [("u", i, frag if i < 2 else frag.replace(".py", ".js")) for i in range(4)]
    df = spark.createDataFrame(rows, "key string, pos int, frag string")
    kept = diffs.headers_within(df, ["key"], ["pos"], 15000)
    # only headers whose " b/" lies in the first 15000 characters count
    assert sorted(r.frag_no for r in kept.collect()) == [1, 2]


def _py_parse_pr(url):
    m = re.match(r"https://github\.com/([^/]+)/([^/]+)/pull/(\d+)", url.strip())
    return (m.group(1), m.group(2), int(m.group(3))) if m else None


def _py_parse_repo(url):
    m = re.match(r"https://github\.com/([^/]+)/([^/]+)", url.strip())
    if not m:
        return None
    repo = m.group(2).rstrip("/")
    return (m.group(1), repo[:-4] if repo.endswith(".git") else repo)


URLS = ["https://github.com/o/r/pull/12", "https://github.com/o/r/pull/12/files",
        "https://github.com/o/r", "https://github.com/o/r.git", "http://github.com/o/r/pull/1",
        "https://github.com/o", "  https://github.com/o/r/pull/3  ", "not a url"]


def test_parse_targets(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    pr = {r.url: (None if r.reject_reason else (r.owner, r.repo, r.pr_number))
          for r in targets.parse_targets(df, "url", "pr").collect()}
    assert pr == {u: _py_parse_pr(u) for u in URLS}
    rp = {r.url: (None if r.reject_reason else (r.owner, r.repo))
          for r in targets.parse_targets(df, "url", "repo").collect()}
    assert rp == {u: _py_parse_repo(u) for u in URLS}


def test_normalize_and_blank(spark):
    df = spark.createDataFrame([("o/r",), ("  ",), ("http://x",)], "url string")
    got = [r.n for r in df.select(targets.normalize_target(F.col("url")).alias("n")).collect()]
    assert got == ["https://github.com/o/r", "", "http://x"]
    b = targets.reject_blank(spark.createDataFrame([("  \n",), ("x",)], "t string"), "t").collect()
    assert [r.reject_reason for r in b] == ["blank", None]


def test_classify_outcomes(spark):
    rows = [(1, 200, "59", "timeout", False), (2, 200, "59", "connection", False), (3, 404, "59", None, False),
            (4, 403, "0", None, False), (5, 403, "5", None, False), (6, 401, None, None, False),
            (7, 500, None, None, False), (8, 200, None, None, True), (9, 200, None, None, False)]
    df = spark.createDataFrame(rows, "key int, http_status int, rate_remaining string, error string, body_blank boolean")
    got = {r.key: (r.category, r.status) for r in outcomes.classify_outcomes(df).collect()}
    assert got == {1: ("timeout", 504), 2: ("connection", 400), 3: ("not_found", 400), 4: ("rate_limited", 429),
                   5: ("forbidden", 400), 6: ("unauthorized", 400), 7: ("http_error", 400), 8: ("empty", 400),
                   9: ("ok", 200)}
    review = {r.key: r.status for r in outcomes.classify_outcomes(df, "review").collect()}
    assert review[1] == 502 and review[4] == 429


def test_cap_per_repo_composes(spark):
    rows = [("r1", i) for i in range(30)] + [("r2", i) for i in range(3)]
    df = spark.createDataFrame(rows, "repo string, ord int")
    c = caps.cap_per_repo(caps.cap_per_repo(df, 25).drop("rank_in_repo"), 20)
    got = sorted((r.repo, r.ord) for r in c.collect())
    assert got == sorted([("r1", i) for i in range(20)] + [("r2", i) for i in range(3)])
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "Window" in plan


def test_attach_language_default(spark):
    df = spark.createDataFrame([(".py",), (".rb",), (".xyz",), (None,)], "ext string")
    got = [(r.language, r.framework) for r in attach_language(df, "ext").collect()]
    assert got[0] == ("Python", "pytest") and got[1] == ("Ruby", "RSpec")
    assert got[2][0] == GENERIC_LANGUAGE and got[3][0] == GENERIC_LANGUAGE


def test_top_n_per_key_salted_is_exact(spark):
    rows = [("hot", i, (i * 7919) % 5003) for i in range(5000)] + [("cold", i, i) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = caps.top_n_per_key(df, ["k"], ["v", "i"], 1200, salts=8)
    hot = sorted((r.v, r.i) for r in got.filter("k = 'hot'").collect())
    assert hot == sorted((v, i) for _, i, v in rows if _ == "hot")[:1200]
    assert got.filter("k = 'cold'").count() == 10
    ranks = sorted(r.rank_in_key for r in got.filter("k = 'hot'").collect())
    assert ranks == list(range(1, 1201))


def test_running_count_blocked(spark):
    import random
    rnd = random.Random(3)
    rows = [("a", t, rnd.random() < 0.3) for t in range(0, 3000, 3)] + [("b", t, True) for t in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, f boolean")
    got = {(r.k, r.t): r.running for r in caps.running_count(df, ["k"], "t", "f", block=64).collect()}
    want, acc = {}, {}
    for k, t, f in sorted(rows):
        acc[k] = acc.get(k, 0) + int(f)
        want[(k, t)] = acc[k]
    assert got == want


def test_small_helpers(spark):
    from changelens.operators.languages import languages_dim
    from changelens.operators.render import ERROR_PREFIX, render_error_comments
    from changelens.session import scale_conf
    dim = {r.ext: (r.lang_group, r.language) for r in languages_dim(spark).collect()}
    assert dim[".py"] == ("python", "Python") and dim[".go"] == (None, "Go") and len(dim) == 10
    df = spark.createDataFrame([("a", None), ("b", "blank")], "k string, reject_reason string")
    ok, bad = targets.split_rejects(df)
    assert [r.k for r in ok.collect()] == ["a"] and [r.k for r in bad.collect()] == ["b"]
    e = render_error_comments(spark.createDataFrame([("k", "boom")], "key string, error_message string"))
    assert e.collect()[0].comment == ERROR_PREFIX + "boom"
    conf = scale_conf(40 * 10 ** 12, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) > 100000
