from changelens.operators import scans

PY_A = "import pkg.util\n\ndef total(items):\n    s = 0\n    for i in items:\n        s += i\n    return s\n"
PY_B = "from pkg import util\n\ndef summe(values):\n    s = 0\n    for i in values:\n        s += i\n    return s\n"
UTIL = "def helper(x):\n    y = x * 2\n    return y\n"


def _files(spark):
    rows = [("r1", "app/a.py", 1, PY_A), ("r1", "app/b.py", 2, PY_B), ("r1", "pkg/util.py", 3, UTIL),
            ("r2", "x.js", 1, "function f() {\n  return 1;\n}\n")]
    return spark.createDataFrame(rows, "repo string, path string, ord bigint, content string")


def test_duplicate_scan_exact_and_shingle(spark):
    out = scans.duplicate_scan(_files(spark), method="exact")
    pairs = [(r.a.name, r.b.name) for r in out["pairs"].collect()]
    assert pairs == [("total", "summe")]
    rep = {r.repo: (r.files_scanned, r.functions_analyzed, r.duplicate_pairs) for r in out["report"].collect()}
    assert rep == {"r1": (3, 3, 1), "r2": (1, 1, 0)}
    sh = scans.duplicate_scan(_files(spark), method="shingle", k=2, threshold=0.5)
    assert sh["pairs"].count() == 1


def test_duplicate_scan_takes_shingles_by_default(spark):
    assert "copies" in scans.duplicate_scan(_files(spark))


def test_architecture_facts(spark):
    out = scans.architecture_facts(_files(spark))
    edges = {(r.src_file, r.dst_module): r.dst_file for r in out["edges"].collect()}
    assert edges[("app/a.py", "pkg.util")] == "pkg/util.py"
    assert "FILE: app/a.py" in out["structure_text"].filter("repo = 'r1'").collect()[0].structure_text
    assert out["diagram"].collect()[0].diagram.startswith("graph TD")
    assert out["requests"].count() == 2


def test_review_requests_from_diffs(spark):
    d = spark.createDataFrame([("o", "r", 1, "diff --git a/x.go b/x.go\n+x\n")],
                              "owner string, repo string, pr_number int, diff string")
    r = scans.review_requests(d, "tests").collect()[0]
    assert r.key == "o/r/1" and "Go's built-in testing package" in r.prompt
