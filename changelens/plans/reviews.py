"""Registered queries: inference requests, answer checks, findings, comments.

Bindings: ``documents`` are diffs (key = doc_id); the architecture prompt
uses the page structure text per host; ``events.props`` are model answers
wrapped per event type (plain, fenced with tag, fenced without tag, a JSON
array, an object missing the required key); ``answer_findings`` makes review answers of
documents; ``orders`` are reviews
(priority -> risk) and ``lineitem`` rows their issues (return flag ->
severity, line status -> confidence); ``conversations`` are test answers
(role = language, blank text = empty test code, capitalised words =
covered functions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffs as D
from ..operators import inference as I
from ..operators.languages import TEST_LANGUAGES
from ..operators import render as R
from ..functions.text import is_blank
from .architecture import structure_text
from .common import spread, table

# Fixed test bindings.
PRIORITY_RISK = {"1-URGENT": "high", "2-HIGH": "medium", "3-MEDIUM": "low"}
HEADER_EXTS = [".py", ".js", ".ts", ".md"]
FLAG_SEVERITY = {"R": "high", "A": "medium", "N": "low"}
STATUS_CONFIDENCE = {"O": "high", "F": "low"}
# ASCII word boundary written out: Java's \b treats accented letters as word
# characters, RE2's does not.
CAPITALISED = r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)"


def _case(col: str, d: dict, default=None):
    expr = F.lit(default) if default is not None else F.col(col)
    for k, v in d.items():
        expr = F.when(F.col(col) == k, F.lit(v)).otherwise(expr)
    return expr


def _summ(req: DataFrame) -> DataFrame:
    return req.select(F.col("key").cast("string").alias("key"), "kind", "truncated",
                      F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


def review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("diff"))
    return _summ(I.build_requests(docs, "review"))


def test_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests prompts in the primary language of each document's diff: one to four
    file headers (ties and unknown extensions among them), then the text."""
    path = lambda i: F.concat(F.lit("f"), i.cast("string"), F.get(
        F.array(*[F.lit(e) for e in HEADER_EXTS]), ((F.col("doc_id") + i * i) % len(HEADER_EXTS)).cast("int")))
    headers = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), lambda i: F.concat(
        F.lit("diff --git a/"), path(i), F.lit(" b/"), path(i)))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        F.concat(F.array_join(headers, "\n"), F.lit("\n"), F.col("text")).alias("diff"))
    return _summ(I.build_requests(D.with_primary_language(docs), "tests"))


def architecture_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = structure_text(spark, sf_dir).withColumn("key", F.concat_ws("#", "repo", F.col("part").cast("string")))
    return _summ(I.build_requests(st, "architecture", key="key"))


def wrapped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events"))
    p = F.col("props")
    raw = (F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
           .when(F.col("event_type") == "purchase", F.concat(F.lit("  ```\n"), p, F.lit("\n```  ")))
           .when(F.col("event_type") == "signup", F.concat(F.lit("["), p, F.lit("]")))
           .when(F.col("event_type") == "error",
                 F.concat(F.lit('{"value": '), F.col("value").cast("string"), F.lit("}")))
           .otherwise(p))
    return ev.select(F.col("event_id").alias("key"), raw.alias("raw"))


def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.validate_responses(wrapped_answers(spark, sf_dir), ["k"])
    return v.select("key", "reject_reason", F.array_join("missing_keys", ",").alias("missing"),
                    F.when(F.col("reject_reason").isNull(),
                           F.get_json_object("text", "$.k").cast("int")).alias("k"))


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests answers that carry whole documents as test code (quotes, line ends
    and all escaped), some with a key missing, a value of the wrong type or
    words after the object; what is accepted is parsed back."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    names = F.when(i % 5 == 1, F.to_json(F.struct(F.lit("none").alias("x")))).otherwise(
        F.to_json(F.struct(F.array(F.lit("f")).alias("x"))))
    code = F.to_json(F.struct(F.col("text").alias("x")))
    inner = lambda c: F.expr(f"substring({c}, 6, length({c}) - 6)")
    d = d.select(i.alias("key"), names.alias("_n"), code.alias("_c"))
    raw = F.concat(F.lit('{"language": "Python", "functions_covered": '), inner("_n"), F.lit(', "test_code": '), inner("_c"),
                   F.when(F.col("key") % 7 == 2, F.lit("}")).otherwise(F.lit(', "notes": null}')),
                   F.when(F.col("key") % 11 == 3, F.lit(" done")).otherwise(F.lit("")))
    v = I.validate_responses(d.select("key", raw.alias("raw")), I.REQUIRED_KEYS["tests"], types=I.KEY_TYPES["tests"])
    ok = F.when(F.col("reject_reason").isNull(), F.from_json("text", I.TESTS_SCHEMA)["test_code"])
    return v.select("key", "reject_reason", F.length(ok).alias("n_chars"), F.md5(ok).alias("code_md5"))


def _review_heads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("key"),
        _case("o_orderpriority", PRIORITY_RISK).alias("risk_level"),
        F.lit(None).cast("int").alias("files_changed"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "),
                 F.col("o_custkey").cast("string"), F.lit(".")).alias("summary"),
        F.array(F.concat(F.lit("status "), F.col("o_orderstatus")),
                F.concat(F.lit("priority "), F.col("o_orderpriority"))).alias("key_changes"))


def _findings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).alias("pos"),
        _case("l_returnflag", FLAG_SEVERITY).alias("severity"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" quantity "),
                 F.col("l_quantity").cast("string")).alias("description"),
        _case("l_linestatus", STATUS_CONFIDENCE).alias("confidence"))


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues per (severity, confidence); reviews with none under nulls."""
    heads = _review_heads(spark, sf_dir).select("key")
    findings = _findings(spark, sf_dir).select("key", "severity", "confidence")
    return R.finding_counts(heads.join(findings, "key", "left"))


def answer_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of parsed review answers, whose issues are an array in the row:
    one for each line of a document, none where it has one line."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.split("text", "\n").alias("lines"))
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), n % len(values))
    issues = F.transform("lines", lambda x: F.struct(
        pick(["low", "medium", "high"], F.length(x)).alias("severity"), x.alias("description"),
        pick(["low", "high"], F.length(x)).alias("confidence")))
    raw = F.to_json(F.struct(F.lit("s").alias("summary"), F.lit("low").alias("risk_level"), F.array(F.lit("c")).alias("key_changes"),
                             F.lit(1).alias("files_changed"),
                             F.when(F.size("lines") > 1, issues).otherwise(F.slice(issues, 1, 0)).alias("issues")))
    valid = I.parse_valid(I.validate_responses(d.select("key", raw.alias("raw")), I.REQUIRED_KEYS["review"],
                                               types=I.KEY_TYPES["review"]), I.REVIEW_SCHEMA)
    return R.explode_findings(valid).select("key", "pos", "severity", "confidence", F.md5("description").alias("description_md5"))


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.render_comment_lines(_review_heads(spark, sf_dir), _findings(spark, sf_dir))


def _test_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("role").alias("language"),
                    F.when(is_blank("text"), F.lit("")).otherwise(F.col("text")).alias("test_code"),
                    F.regexp_extract_all("text", F.lit(CAPITALISED), 1).alias("functions_covered"))


def tests_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tests_summary(_test_answers(spark, sf_dir))


def covered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.covered_functions(_test_answers(spark, sf_dir))


def stub_model(prompt: str) -> str:
    """Deterministic stand-in for a model: answers from the prompt's size."""
    import json
    n = len(prompt)
    risk = ("low", "medium", "high", "unknown")[n % 4]
    issues = [{"severity": ("low", "medium", "high")[(n + i) % 3],
               "description": f"check item {i}", "confidence": "medium"} for i in range(n % 3)]
    body = {"summary": f"A change of {n} characters.", "risk_level": risk,
            "key_changes": [f"size {n}"], "files_changed": n % 7, "issues": issues}
    text = json.dumps(body)
    return f"```json\n{text}\n```" if n % 2 else text


def stub_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review path with a stub model: requests -> model -> checks -> comments."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("key"),
                                                            F.col("text").alias("diff"))
    answers = I.batch_infer(I.build_requests(docs, "review"), stub_model)
    valid = I.parse_valid(I.validate_responses(answers, I.REQUIRED_KEYS["review"], types=I.KEY_TYPES["review"]),
                          I.REVIEW_SCHEMA)
    return R.render_comments(valid)


# --------------------------------------------------------------------------
# DuckDB twins
# --------------------------------------------------------------------------

def _lit(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _tmpl(template: str, values: dict[str, str]) -> str:
    out = []
    rest = template
    while True:
        hits = [(rest.find(f"<<{k}>>"), k) for k in values if rest.find(f"<<{k}>>") >= 0]
        if not hits:
            out.append(_lit(rest))
            break
        pos, k = min(hits)
        out += [_lit(rest[:pos]), f"({values[k]})"]
        rest = rest[pos + len(k) + 4:]
    return " || ".join(out)


def _ext_case(part: int, default: str) -> str:
    whens = " ".join(f"WHEN '{e}' THEN {_lit(TEST_LANGUAGES[e][part])}" for e in HEADER_EXTS if e in TEST_LANGUAGES)
    return f"CASE ext {whens} ELSE {_lit(default)} END"


def sql_stub_comment(prompt: str) -> str:
    """The comment that the stub model's answer to ``prompt`` gives, in SQL."""
    n = f"length({prompt})"
    risk = f"['low', 'medium', 'high', 'unknown'][CAST({n} % 4 + 1 AS INTEGER)]"
    marks = [R.RISK_MARKS["low"], R.RISK_MARKS["medium"], R.RISK_MARKS["high"], R.UNKNOWN_RISK_MARK]
    mark = f"{marks}[CAST({n} % 4 + 1 AS INTEGER)]"
    issue = (f"'- **[' || ['LOW', 'MEDIUM', 'HIGH'][CAST(({n} + i) % 3 + 1 AS INTEGER)] || ']** check item ' || i || "
             "' _(confidence: medium)_'")
    return (f"concat_ws(chr(10), {_lit(R.TITLE)}, '', '**Risk level:** ' || {mark} || ' ' || {risk} || '  ', "
            f"'**Files changed:** ' || CAST({n} % 7 AS VARCHAR), '', 'A change of ' || {n} || ' characters.', '', "
            f"'### Key changes', '- size ' || {n}, '', '### Potential issues', "
            f"CASE WHEN {n} % 3 = 0 THEN {_lit(R.NO_ISSUES)} ELSE array_to_string(list_transform(range(0, {n} % 3), "
            f"lambda i: {issue}), chr(10)) END, '', {_lit(R.FOOTER)})")


SQL_STUB_REVIEWS = f"""
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS key, {_tmpl(I.REVIEW_TEMPLATE, {"DIFF": "text"})} AS prompt FROM documents)
SELECT key, {sql_stub_comment("prompt")} AS comment FROM r
"""

SQL_ANSWER_TEXTS = """
WITH a AS (SELECT doc_id AS key, text, CASE
    WHEN doc_id % 11 = 3 THEN 'not json'
    WHEN doc_id % 7 = 2 THEN 'missing keys: notes'
    WHEN doc_id % 5 = 1 THEN 'wrong types: functions_covered' END AS reject_reason FROM documents)
SELECT key, reject_reason, CASE WHEN reject_reason IS NULL THEN CAST(length(text) AS INTEGER) END AS n_chars,
       CASE WHEN reject_reason IS NULL THEN md5(text) END AS code_md5 FROM a
"""

SQL_REVIEW_REQUESTS = f"""
WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS key, 'review' AS kind, false AS truncated,
                  {_tmpl(I.REVIEW_TEMPLATE, {"DIFF": "text"})} AS prompt FROM documents)
SELECT key, kind, truncated, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM r
"""

SQL_TEST_REQUESTS = f"""
WITH h AS (SELECT doc_id, text, unnest(range(0, doc_id % 4 + 1)) AS i FROM documents),
x AS (SELECT *, {HEADER_EXTS}[CAST((doc_id + i * i) % 4 + 1 AS INTEGER)] AS ext FROM h),
d AS (SELECT doc_id, string_agg('diff --git a/f' || i || ext || ' b/f' || i || ext, chr(10) ORDER BY i)
             || chr(10) || any_value(text) AS diff FROM x GROUP BY doc_id),
n AS (SELECT doc_id, ext, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS rk
      FROM x GROUP BY doc_id, ext),
r AS (SELECT CAST(d.doc_id AS VARCHAR) AS key, 'tests' AS kind, false AS truncated,
             {_tmpl(I.TESTS_TEMPLATE, {"DIFF": "diff", "LANGUAGE": _ext_case(0, D.GENERIC_LANGUAGE),
                                        "FRAMEWORK": _ext_case(1, D.GENERIC_FRAMEWORK)})} AS prompt
      FROM d JOIN n ON n.doc_id = d.doc_id AND n.rk = 1)
SELECT key, kind, truncated, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM r
"""


def _sql_architecture():
    from .architecture import SQL_STRUCTURE_TEXT
    return f"""
WITH st AS ({SQL_STRUCTURE_TEXT}),
r AS (SELECT repo || '#' || CAST(part AS VARCHAR) AS key, 'architecture' AS kind, false AS truncated,
             {_tmpl(I.ARCHITECTURE_TEMPLATE, {"STRUCTURE": "structure_text"})} AS prompt FROM st)
SELECT key, kind, truncated, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM r
"""


SQL_RESPONSE_CHECKS = r"""
WITH w AS (
  SELECT event_id AS key, CASE
    WHEN event_type = 'click' THEN '```json' || chr(10) || props || chr(10) || '```'
    WHEN event_type = 'purchase' THEN '  ```' || chr(10) || props || chr(10) || '```  '
    WHEN event_type = 'signup' THEN '[' || props || ']'
    WHEN event_type = 'error' THEN '{"value": ' || CAST(value AS VARCHAR) || '}'
    ELSE props END AS raw
  FROM events
),
s AS (SELECT key, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS st FROM w),
b AS (SELECT *, regexp_replace(st, '^`+|`+$', '', 'g') AS bt FROM s),
t AS (
  SELECT key, raw, CASE WHEN starts_with(st, '```') THEN
      regexp_replace(CASE WHEN instr(bt, 'json') > 0
                          THEN substr(bt, 1, instr(bt, 'json') - 1) || substr(bt, instr(bt, 'json') + 4)
                          ELSE bt END, '^\s+|\s+$', '', 'g')
    ELSE st END AS text
  FROM b
),
v AS (
  SELECT *, json_valid(text) AS ok, CASE WHEN json_valid(text) THEN json_type(text::JSON) END AS jt FROM t
),
m AS (
  SELECT *, CASE WHEN ok AND jt = 'OBJECT' THEN
              list_sort(list_filter(['k'], lambda x: NOT list_contains(json_keys(text::JSON), x))) END AS missing_l
  FROM v
)
SELECT key,
       CASE WHEN raw IS NULL THEN 'no answer' WHEN NOT ok THEN 'not json' WHEN jt <> 'OBJECT' THEN 'not object'
            WHEN len(missing_l) > 0 THEN 'missing keys: ' || array_to_string(missing_l, ', ') END AS reject_reason,
       array_to_string(missing_l, ',') AS missing,
       CASE WHEN ok AND jt = 'OBJECT' AND len(missing_l) = 0
            THEN CAST(json_extract_string(text, '$.k') AS INTEGER) END AS k
FROM m
"""


def _sql_case(col, d, default=None):
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in d.items())
    return f"CASE {whens} ELSE {default if default else col} END"


SQL_HEADS = f"""
heads AS (
  SELECT o_orderkey AS key, {_sql_case('o_orderpriority', PRIORITY_RISK)} AS risk_level,
         'Order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR) || '.' AS summary,
         ['status ' || o_orderstatus, 'priority ' || o_orderpriority] AS key_changes
  FROM orders
),
f AS (
  SELECT l_orderkey AS key, l_linenumber - 1 AS pos, {_sql_case('l_returnflag', FLAG_SEVERITY)} AS severity,
         'part ' || CAST(l_partkey AS VARCHAR) || ' quantity ' || CAST(l_quantity AS VARCHAR) AS description,
         {_sql_case('l_linestatus', STATUS_CONFIDENCE)} AS confidence
  FROM lineitem
)"""

SQL_FINDING_COUNTS = f"""
WITH {SQL_HEADS}
SELECT f.severity, f.confidence, CAST(count(*) AS BIGINT) AS n
FROM heads h LEFT JOIN f ON f.key = h.key GROUP BY 1, 2
"""

_RM = " ".join(f"WHEN risk_level = '{k}' THEN '{v}'" for k, v in R.RISK_MARKS.items())

SQL_ANSWER_FINDINGS = """
WITH l AS (SELECT doc_id AS key, string_split(text, chr(10)) AS lines FROM documents),
i AS (SELECT key, unnest(range(0, len(lines))) AS p, unnest(lines) AS line FROM l WHERE len(lines) > 1)
SELECT key, CAST(p AS INTEGER) AS pos, ['low', 'medium', 'high'][CAST(length(line) % 3 + 1 AS INTEGER)] AS severity,
       ['low', 'high'][CAST(length(line) % 2 + 1 AS INTEGER)] AS confidence, md5(line) AS description_md5 FROM i
UNION ALL SELECT key, NULL, NULL, NULL, NULL FROM l WHERE len(lines) = 1
"""

SQL_COMMENT_LINES = f"""
WITH {SQL_HEADS},
hl AS (
  SELECT key, [{_lit(R.TITLE)}, '',
               '**Risk level:** ' || CASE {_RM} ELSE '{R.UNKNOWN_RISK_MARK}' END || ' ' || coalesce(risk_level, 'None') || '  ',
               '**Files changed:** None', '', summary, '', '### Key changes']
             || list_transform(key_changes, lambda c: '- ' || c) || ['', '### Potential issues'] AS lines
  FROM heads
),
head_rows AS (SELECT key, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no, unnest(lines) AS line FROM hl),
sizes AS (SELECT key, len(lines) AS h FROM hl),
n AS (SELECT key, max(pos) + 1 AS n FROM f GROUP BY key),
issue_rows AS (
  SELECT f.key, CAST(s.h + f.pos AS INTEGER) AS line_no,
         '- **[' || upper(severity) || ']** ' || description || ' _(confidence: ' || confidence || ')_' AS line
  FROM f JOIN sizes s ON s.key = f.key
),
t AS (
  SELECT s.key, s.h + coalesce(n.n, 0) AS st,
         CASE WHEN coalesce(n.n, 0) > 0 THEN ['', {_lit(R.FOOTER)}]
              ELSE [{_lit(R.NO_ISSUES)}, '', {_lit(R.FOOTER)}] END AS arr
  FROM sizes s LEFT JOIN n ON n.key = s.key
),
tail_rows AS (SELECT key, CAST(st + generate_subscripts(arr, 1) - 1 AS INTEGER) AS line_no, unnest(arr) AS line FROM t)
SELECT * FROM head_rows UNION ALL SELECT * FROM issue_rows UNION ALL SELECT * FROM tail_rows
"""

SQL_TESTS = r"""
tests AS (
  SELECT role AS language,
         CASE WHEN text IS NULL OR length(regexp_replace(text, '\s', '', 'g')) = 0 THEN '' ELSE text END AS test_code,
         regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]*)', 1) AS functions_covered
  FROM conversations
)"""

SQL_TESTS_SUMMARY = "WITH " + SQL_TESTS + """
SELECT language, CAST(count(*) AS BIGINT) AS n_answers,
       CAST(sum(CASE WHEN test_code = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty_code,
       CAST(sum(len(functions_covered)) AS BIGINT) AS n_covered
FROM tests GROUP BY language
"""

SQL_COVERED = "WITH " + SQL_TESTS + """,
e AS (SELECT language, CASE WHEN len(functions_covered) = 0 THEN ['n/a'] ELSE functions_covered END AS fc FROM tests)
SELECT language, "function", CAST(count(*) AS BIGINT) AS n
FROM (SELECT language, unnest(fc) AS "function" FROM e) GROUP BY 1, 2
"""

QUERIES = {
    "review_requests": review_requests,
    "test_requests": test_requests,
    "architecture_requests": architecture_requests,
    "response_checks": response_checks,
    "finding_counts": finding_counts,
    "answer_findings": answer_findings,
    "comment_lines": comment_lines,
    "tests_summary": tests_summary,
    "covered_functions": covered_functions,
    "stub_reviews": stub_reviews,
    "answer_texts": answer_texts,
}

ORACLE = {
    "review_requests": SQL_REVIEW_REQUESTS,
    "test_requests": SQL_TEST_REQUESTS,
    "architecture_requests": _sql_architecture(),
    "response_checks": SQL_RESPONSE_CHECKS,
    "finding_counts": SQL_FINDING_COUNTS,
    "answer_findings": SQL_ANSWER_FINDINGS,
    "comment_lines": SQL_COMMENT_LINES,
    "tests_summary": SQL_TESTS_SUMMARY,
    "covered_functions": SQL_COVERED,
    "stub_reviews": SQL_STUB_REVIEWS,
    "answer_texts": SQL_ANSWER_TEXTS,
}
