"""Findings, review comments and the tests report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: risk marks.
RISK_MARKS = {"low": "\U0001F7E2", "medium": "\U0001F7E1", "high": "\U0001F534"}
UNKNOWN_RISK_MARK = "⚪"
NO_ISSUES = "No issues found."
# Own wording for the title and footer.
TITLE = "## Automated code review"
FOOTER = "_Generated by an automated review job_"
ERROR_PREFIX = "⚠️ The automated review could not analyse this change: "
NA = "n/a"


def risk_mark(risk: Column) -> Column:
    kv = []
    for k, v in RISK_MARKS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), risk), F.lit(UNKNOWN_RISK_MARK))


def issue_line(sev: Column, desc: Column, conf: Column) -> Column:
    """One issue's line; a null part reads ``None``, so no issue is lost."""
    sev, desc, conf = (F.coalesce(x, F.lit("None")) for x in (sev, desc, conf))
    return F.concat(F.lit("- **["), F.upper(sev), F.lit("]** "), desc,
                    F.lit(" _(confidence: "), conf, F.lit(")_"))


def explode_findings(reviews: DataFrame, key: str = "key") -> DataFrame:
    """One row per issue (key, pos, severity, description, confidence); a
    review without issues keeps one row with null issue fields."""
    return reviews.select(key, F.posexplode_outer("issues").alias("pos", "issue")).select(
        key, "pos", F.col("issue.severity").alias("severity"),
        F.col("issue.description").alias("description"),
        F.col("issue.confidence").alias("confidence"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Issues per (severity, confidence); reviews with none counted under nulls."""
    return findings.groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


# Fixed values that must equal the reference's: the comment's headings, their
# order and the shape of its lines.
def _head_lines(risk: Column, files_changed: Column, summary: Column, key_changes: Column) -> Column:
    head = F.array(F.lit(TITLE), F.lit(""),
                   F.concat(F.lit("**Risk level:** "), risk_mark(risk), F.lit(" "),
                            F.coalesce(risk, F.lit("None")), F.lit("  ")),
                   F.concat(F.lit("**Files changed:** "), F.coalesce(files_changed.cast("string"), F.lit("None"))),
                   F.lit(""), F.coalesce(summary, F.lit("None")), F.lit(""), F.lit("### Key changes"))
    bullets = F.transform(F.coalesce(key_changes, F.array().cast("array<string>")),
                          lambda c: F.concat(F.lit("- "), F.coalesce(c, F.lit("None"))))
    return F.concat(head, bullets, F.array(F.lit(""), F.lit("### Potential issues")))


def comment_column() -> Column:
    """The Markdown comment of a review row (columns risk_level,
    files_changed, summary, key_changes, issues) as one expression."""
    issues = F.transform("issues", lambda i: issue_line(i["severity"], i["description"], i["confidence"]))
    body = F.when(F.size(F.coalesce("issues", F.array())) > 0, issues).otherwise(F.array(F.lit(NO_ISSUES)))
    lines = F.concat(_head_lines(F.col("risk_level"), F.col("files_changed"), F.col("summary"),
                                 F.col("key_changes")),
                     body, F.array(F.lit(""), F.lit(FOOTER)))
    return F.array_join(lines, "\n")


def render_comments(reviews: DataFrame, key: str = "key") -> DataFrame:
    """One Markdown comment per review row (issues as an array in the row)."""
    return reviews.select(key, comment_column().alias("comment"))


def render_error_comments(errors: DataFrame, key: str = "key", message: str = "error_message") -> DataFrame:
    """The comment posted when the review could not be made."""
    return errors.select(key, F.concat(F.lit(ERROR_PREFIX), F.col(message)).alias("comment"))


def render_comment_lines(heads: DataFrame, findings: DataFrame, key: str = "key") -> DataFrame:
    """The comments as a lines table (key, line_no, line), for reviews whose
    issues are stored one row each (``findings``: key, pos 0..n-1, severity,
    description, confidence).

    Nothing is collected per review: head lines come from the review row,
    issue lines from the finding rows (line_no = head size + pos), the tail
    from a map-side combined max of the issue positions per review.
    ``line_no`` orders the lines of one comment; it may have gaps when the
    positions do.
    """
    hl = _head_lines(F.col("risk_level"), F.col("files_changed"), F.col("summary"), F.col("key_changes"))
    h = heads.select(key, hl.alias("_hl"))
    head_rows = h.select(key, F.posexplode("_hl").alias("line_no", "line"))
    sizes = h.select(key, F.size("_hl").alias("h"))
    n = findings.groupBy(key).agg((F.max("pos") + 1).alias("n"))
    issue_rows = (findings.join(sizes, key)
                  .select(key, (F.col("h") + F.col("pos")).alias("line_no"),
                          issue_line(F.col("severity"), F.col("description"), F.col("confidence")).alias("line")))
    tail = sizes.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tail_arr = F.when(F.col("n") > 0, F.array(F.lit(""), F.lit(FOOTER))).otherwise(
        F.array(F.lit(NO_ISSUES), F.lit(""), F.lit(FOOTER)))
    start = F.col("h") + F.col("n")
    tail_rows = tail.select(key, start.alias("_s"), F.posexplode(tail_arr).alias("_p", "line")).select(
        key, (F.col("_s") + F.col("_p")).alias("line_no"), "line")
    return head_rows.unionByName(issue_rows).unionByName(tail_rows).withColumn(
        "line_no", F.col("line_no").cast("int"))


def tests_summary(tests: DataFrame, language: str = "language") -> DataFrame:
    """Per language: answers, answers with empty test code, covered names."""
    return tests.groupBy(language).agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.sum(F.when(F.col("test_code") == "", 1).otherwise(0)).cast("long").alias("n_empty_code"),
        F.sum(F.size(F.coalesce("functions_covered", F.array()))).cast("long").alias("n_covered"))


def covered_functions(tests: DataFrame, language: str = "language") -> DataFrame:
    """Covered function names counted per language; answers without any
    count under ``n/a``."""
    names = F.explode_outer(F.coalesce("functions_covered", F.array().cast("array<string>")))
    return (tests.select(language, names.alias("function"))
            .withColumn("function", F.coalesce("function", F.lit(NA)))
            .groupBy(language, "function").agg(F.count(F.lit(1)).alias("n")))
