"""Repo identity in the duplicate scan, bad rows, paths and long words."""

from pyspark.sql import functions as F

from changelens.functions.text import word_shingles
from changelens.operators import dedup, graph, outcomes, render, report, structure, targets
from changelens.sources.files import decode_contents

CODE = "one two three four five six seven eight nine ten\n" * 4
UNITS = ("unit_id bigint, repo string, file string, name string, start_line int, line_count int, lang_group string, "
         "code string, n_chars int, scan_ord bigint")


def _units(spark, rows):
    return spark.createDataFrame([(i, r, f, n, 1, 5, "python", c, len(c), o) for i, r, f, n, c, o in rows], UNITS)


def test_pairs_stay_in_their_repo(spark):
    near = CODE + "tail words here\n"
    u = _units(spark, [(1, "r1", "a.py", "f", CODE, 0), (2, "r1", "b.py", "g", near, 1),
                       (3, "r2", "a.py", "f", CODE + "z\n", 0), (4, "r2", "b.py", "g", near + "y\n", 1)])
    within = {(r.a_unit_id, r.b_unit_id) for r in dedup.similar_pairs_exact(u, within_repo=True).collect()}
    assert within == {(1, 2), (3, 4)}
    across = {(r.a_unit_id, r.b_unit_id) for r in dedup.similar_pairs_exact(u).collect()}
    assert across == {(1, 2), (3, 4), (1, 3), (1, 4), (2, 3), (2, 4)}


def test_report_counts_copies_by_arithmetic(spark):
    rows = [(i, "r1" if i < 3 else "r2", f"{i}.py", "f", CODE, i) for i in range(5)]
    rows += [(5, "r3", "x.py", "f", "a b c d e f g", 0)]
    u = _units(spark, rows)
    for within, want in ((False, {"r1": 9, "r2": 7, "r3": 0}), (True, {"r1": 3, "r2": 1, "r3": 0})):
        pairs = dedup.shingle_similar_pairs(u, within_repo=within)
        rep = report.duplicate_report(u.select("repo"), u, pairs, copies=dedup.copy_groups(u, within_repo=within))
        assert {r.repo: r.duplicate_pairs for r in rep.collect()} == want


def test_short_units_are_copies_of_each_other(spark):
    u = _units(spark, [(1, "r", "a", "f", "ab cd", 0), (2, "r", "b", "f", "ab  cd", 1), (3, "r", "c", "f", " ", 2)])
    got = {(r.unit_id, r.rep_id, r.n_copies) for r in dedup.copy_groups(u).collect()}
    assert got == {(1, 1, 2), (2, 1, 2)}


def test_counts_match_by_repo_and_file(spark):
    files = spark.createDataFrame([("r1", "m.py"), ("r2", "m.py")], "repo string, file string")
    have = spark.createDataFrame([("r1", "m.py")], "repo string, file string")
    assert {r.repo: r.files_analyzed for r in report.analyzed_counts(files, have).collect()} == {"r1": 1, "r2": 0}


def test_bad_rows_do_not_fail_the_job(spark):
    t = spark.createDataFrame([("https://github.com/o/r/pull/" + "9" * 30,)], "url string")
    assert targets.parse_targets(t).collect()[0].pr_number is None
    p = spark.createDataFrame([("a", 200, "base64", "!!!"), ("b", 200, "base64", "aGVs\nbG8=")],
                              "path string, status int, encoding string, content string")
    assert [(r.path, r.content) for r in decode_contents(p).collect()] == [("b", "hello")]


def test_null_parts_of_an_issue_keep_it(spark):
    df = spark.sql("SELECT 'k' AS key, 'low' AS risk_level, 1 AS files_changed, 's' AS summary, array('c') AS key_changes, "
                   "array(struct(CAST(NULL AS string) AS severity, 'd' AS description, 'low' AS confidence)) AS issues")
    assert "- **[NONE]** d _(confidence: low)_" in render.render_comments(df).collect()[0].comment


def test_paths_climb_any_number_of_folders(spark):
    df = spark.createDataFrame([("a/b/c/d/e/f/g/h/i/" + "../" * 9 + "x", "x"), ("./a/./b", "a/b"), ("a/../../b", "../b")],
                               "p string, want string")
    got = df.select(graph._normalize_path(F.col("p")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_imports_without_comments_and_after_semicolons(spark):
    df = spark.createDataFrame([("import os  # noqa\nimport sys; import re\nfrom a import (b,\n  c)\nx = 1\n",)], "c string")
    got = df.select(structure.extract_imports(F.col("c"), F.lit("python")).alias("i")).collect()[0].i
    assert got == ["import os", "import sys", "import re", "from a import (b,   c)"]


def test_long_last_word_is_linear(spark):
    df = spark.createDataFrame([("a b c d " + "x" * 300_000,)], "t string")
    assert df.select(F.size(word_shingles("t", 5)).alias("n")).collect()[0].n == 1


def test_duplicate_stage_errors_are_400(spark):
    df = spark.createDataFrame([("timeout",), ("ok",)], "category string")
    got = df.select(outcomes.service_status("category", "duplicates").alias("s")).collect()
    assert [r.s for r in got] == [400, 200]
