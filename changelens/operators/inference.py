"""Inference requests, the model call, and validation of the JSON answers.

The model is a caller-supplied Python callable; everything around it
(prompt building, fence stripping, JSON checks, reject split) is native.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import with_computed_once
from ..functions.text import py_strip
from ..session import materialize, path_exists
from .diffs import TRUNCATION_SUFFIX

# The keys each answer kind must carry.
REQUIRED_KEYS = {
    "review": ["summary", "risk_level", "key_changes", "files_changed", "issues"],
    "tests": ["language", "test_code", "functions_covered", "notes"],
    "architecture": ["overview", "components", "mermaid_diagram"],
}

# The types of those keys' values (a null value passes).
KEY_TYPES = {
    "review": {"summary": "string", "risk_level": "string", "key_changes": "array", "files_changed": "integer",
               "issues": "array"},
    "tests": {"language": "string", "test_code": "string", "functions_covered": "array", "notes": "string"},
    "architecture": {"overview": "string", "components": "array", "mermaid_diagram": "string"},
}

# Prompts: the input first, then the answer's fields one by one.  Placeholders
# are replaced literally, so a ``%`` or ``{`` inside code needs no escaping.
REVIEW_TEMPLATE = """[DIFF]
<<DIFF>>
[END OF DIFF]

Task: review this diff for defects that change behaviour. Style remarks are not wanted.
Output: one bare JSON object (no markdown). Its fields:
  issues         array, empty if there is no defect; every element has the strings
                 severity (low | medium | high), confidence (low | medium | high), description
  risk_level     low | medium | high, for the diff as a whole
  files_changed  integer
  key_changes    array of strings, a phrase each
  summary        string, at most three sentences
"""

TESTS_TEMPLATE = """[DIFF]
<<DIFF>>
[END OF DIFF]

Task: unit tests in <<LANGUAGE>> with <<FRAMEWORK>>.
Scope: functions that the diff adds or edits, each with a normal and a boundary case; nothing else.
Output: one bare JSON object (no markdown). Its fields:
  test_code          string, the whole test file; an empty string if no function is touched
  functions_covered  array of function names
  language           "<<LANGUAGE>>"
  notes              string: what the tests take for granted, or why there are none
"""

ARCHITECTURE_TEMPLATE = """[FACTS]
<<STRUCTURE>>
[END OF FACTS]

The facts list every file's imports and definitions. Task: an overview of how the files work together,
from these facts alone.
Output: one bare JSON object (no markdown). Its fields:
  mermaid_diagram  string, a "graph TD" chart: 6-12 nodes, the files with most import links; an edge is an
                   import from the facts; ids are letters and digits, file names go in [brackets]
  components       array of objects with the strings name and role
  overview         string, one paragraph
"""


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Literal placeholder replacement as one ``concat`` (no format codes)."""
    parts: list[Column] = []
    rest = template
    while True:
        hits = [(rest.find(f"<<{k}>>"), k) for k in values if rest.find(f"<<{k}>>") >= 0]
        if not hits:
            parts.append(F.lit(rest))
            break
        pos, k = min(hits)
        parts += [F.lit(rest[:pos]), values[k]]
        rest = rest[pos + len(k) + 4:]
    return F.concat(*[p for p in parts])


def build_requests(df: DataFrame, kind: str, key: str = "key", diff: str = "diff",
                   language: str = "language", framework: str = "framework",
                   structure: str = "structure_text", max_chars: int | None = None) -> DataFrame:
    """One prompt per row: (key, kind, prompt, truncated).

    review / tests: the whole diff goes in, unless ``max_chars`` cuts it
    (``MAX_DIFF_CHARS`` is the usual cut; the flag says whether it did); tests
    also needs language and framework (``primary_language``); architecture
    takes the repo's structure text.
    """
    if kind in ("review", "tests"):
        d = F.col(diff)
        truncated = F.length(d) > max_chars if max_chars else F.lit(False)
        cut = F.when(truncated, F.concat(F.substring(d, 1, max_chars), F.lit(TRUNCATION_SUFFIX))).otherwise(d) \
            if max_chars else d
        if kind == "review":
            prompt = _fill(REVIEW_TEMPLATE, {"DIFF": cut})
        else:
            prompt = _fill(TESTS_TEMPLATE, {"DIFF": cut, "LANGUAGE": F.col(language),
                                            "FRAMEWORK": F.col(framework)})
    elif kind == "architecture":
        truncated = F.lit(False)
        prompt = _fill(ARCHITECTURE_TEMPLATE, {"STRUCTURE": F.col(structure)})
    else:
        raise ValueError(f"unknown kind {kind}")
    return df.select(F.col(key).alias("key"), F.lit(kind).alias("kind"), prompt.alias("prompt"),
                     truncated.alias("truncated"))


# --------------------------------------------------------------------------
# model call
# --------------------------------------------------------------------------

ANSWER_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("error_category", T.StringType()),
    T.StructField("error_message", T.StringType()),
])


def _categorize(exc: BaseException) -> str:
    msg = str(exc).lower()
    if "rate limit" in msg or type(exc).__name__ in ("ResourceExhausted", "RateLimitError"):
        return "rate_limited"
    if isinstance(exc, TimeoutError) or "deadline" in msg or "timeout" in msg:
        return "timeout"
    return "model_error"


# Prompts of an Arrow batch that are Python strings at a time.
HELD_PROMPTS = 256


def batch_infer(requests: DataFrame, fn: Callable[[str], str], parallelism: int | None = None) -> DataFrame:
    """Apply ``fn(prompt) -> text`` to every request in Arrow batches.

    A failing call becomes a row with ``error_category`` (rate_limited,
    timeout, model_error; an empty answer is ``unusable``; a null prompt is
    ``no_input`` and is not sent) instead of failing the job.  ``parallelism``
    bounds concurrent calls, the rate limit of the model service: requests are
    dealt round robin to so many tasks, and the stage that builds the prompts
    keeps its own.  Spark retries a lost task, so ``fn`` should be idempotent
    per prompt; ``ledger_infer`` keeps answers over failures.
    """
    src = requests.select(F.col("key").cast("string").alias("key"), "kind", "prompt")
    if parallelism:
        src = src.repartition(parallelism)

    def run(batches):
        import pyarrow as pa
        names = ["key", "kind", "raw", "error_category", "error_message"]
        for whole in batches:
            for start in range(0, whole.num_rows, HELD_PROMPTS):
                part = whole.slice(start, HELD_PROMPTS)
                answers = [ask(p) for p in part.column(2).to_pylist()]
                told = [pa.array([x[i] for x in answers], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *told], names=names)

    def ask(p):
        """(raw, error_category, error_message) of one prompt."""
        if p is None:                      # nothing to ask (no input)
            return None, "no_input", "no input to analyse"
        try:
            r = fn(p)
            if r is None or not str(r).strip():
                return None, "unusable", "empty answer"
            return str(r), None, None
        except Exception as e:  # noqa: BLE001 - every failure becomes a row
            return None, _categorize(e), str(e)

    return src.mapInArrow(run, ANSWER_SCHEMA)


# Prompts are asked in so many waves; each wave's answers are stored before the next.
WAVES = 16
_LEDGER = "prompt_hash string, raw string, error_category string, error_message string, wave int"
# Failures that another call may mend.
_ASK_AGAIN = ["rate_limited", "timeout"]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(prompt_hash, wave, answer) of a ledger: per prompt one answer, a good one if there is any."""
    held = spark.read.schema(_LEDGER).parquet(ledger) if path_exists(spark, ledger) else spark.createDataFrame([], _LEDGER)
    answer = F.struct("raw", "error_category", "error_message")
    return held.groupBy("prompt_hash", "wave").agg(F.min_by(answer, F.struct(F.col("error_category").isNotNull(), F.col("raw"))).alias("answer"))


def ledger_infer(requests: DataFrame, fn: Callable[[str], str], ledger: str, parallelism: int | None = None,
                 waves: int = WAVES) -> DataFrame:
    """``batch_infer`` with a ledger of answers, keyed by the prompt's SHA-256.

    Every distinct prompt is asked once, however many requests carry it and
    whatever fails in between: prompts fall into waves by their hash, a wave
    asks those that the ledger does not hold (anti-join) and appends its
    answers to the ledger's folder ``wave=<n>`` in one commit.  A run that dies is started
    again and goes on with the wave that was open.  Failed calls are
    answers with a category; those that a rate limit or a timeout caused are
    asked again by the next run.  ``ledger`` is a folder on shared storage
    that one run at a time writes to.
    """
    spark = requests.sparkSession
    asked = requests.select(F.col("key").cast("string").alias("key"), "kind", "prompt", F.sha2("prompt", 256).alias("prompt_hash"))
    prompts = materialize(asked.filter(F.col("prompt").isNotNull()).groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
                          .withColumn("wave", F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)).cast("int")))
    for n in range(waves):
        again = F.coalesce(F.col("answer.error_category").isin(_ASK_AGAIN), F.lit(False))
        kept = read_ledger(spark, ledger).filter((F.col("wave") == n) & ~again)
        todo = prompts.filter(F.col("wave") == n).join(kept, "prompt_hash", "left_anti")
        if todo.isEmpty():
            continue
        new = batch_infer(todo.select(F.col("prompt_hash").alias("key"), F.lit("").alias("kind"), "prompt"), fn, parallelism)
        (new.select(F.col("key").alias("prompt_hash"), "raw", "error_category", "error_message")
         .write.mode("append").parquet(f"{ledger.rstrip('/')}/wave={n}"))
    answers = asked.join(read_ledger(spark, ledger), "prompt_hash", "left")
    no_input = F.col("prompt").isNull()
    return answers.select("key", "kind", "answer.raw", F.when(no_input, F.lit("no_input")).otherwise(F.col("answer.error_category")).alias("error_category"),
                          F.when(no_input, F.lit("no input to analyse")).otherwise(F.col("answer.error_message")).alias("error_message"))


# --------------------------------------------------------------------------
# answer checks
# --------------------------------------------------------------------------

def strip_fences(raw) -> Column:
    """The reference's fence handling, quirks included.

    Only when the stripped text starts with three backticks: all leading and
    trailing backticks go, then the first ``json`` anywhere, then blanks.  So
    an untagged fence loses a ``json`` inside the payload and an upper-case
    ``JSON`` tag stays (and fails to parse).
    """
    s = py_strip(F.col(raw) if isinstance(raw, str) else raw)
    bt = F.regexp_replace(s, "^`+|`+$", "")
    pos = F.instr(bt, "json")
    removed = F.when(pos > 0, F.concat(F.substring(bt, F.lit(1), pos - 1),
                                       F.substring(bt, pos + 4, F.lit(2147483647)))).otherwise(bt)
    return F.when(s.startswith("```"), py_strip(removed)).otherwise(s)


# possessive: Java then loops instead of recursing once per character
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_JSON_SCALAR = r'^(?:""|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$'


def json_whole_text(text: Column) -> Column:
    """True when the first JSON value spans the whole (stripped) text.

    ``try_parse_json`` stops after the first value, so ``{"a": 1} thanks!``
    would pass; Python's parser rejects trailing data.  String literals are
    blanked, then one pass over the brackets alone (``aggregate``) finds
    where the top-level object or array closes; scalars are matched whole.
    """
    ns = py_strip(F.regexp_replace(text, _JSON_STRING, '""'))
    first = F.substring(ns, 1, 1)
    # only the brackets matter: the value spans the text when the depth first
    # returns to zero at the last bracket and the text ends with it
    brackets = F.regexp_replace(ns, r"[^\[\]{}]", "")

    def step(acc, c):
        d = acc["d"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        i = acc["i"] + 1
        e = F.when((acc["e"] == 0) & (d == 0), i).otherwise(acc["e"])
        return F.struct(d.alias("d"), i.alias("i"), e.alias("e"))

    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("e"))
    closes_at = F.aggregate(F.split(brackets, ""), start, step)["e"]
    last = F.substring(ns, -1, 1)
    return (F.when(first.isin("{", "["), (closes_at == F.length(brackets)) & last.isin("}", "]"))
            .otherwise(F.regexp_like(ns, F.lit(_JSON_SCALAR))))


_VARIANT_TYPES = {"string": ("STRING",), "integer": ("BIGINT", "INT", "SMALLINT", "TINYINT"), "array": ("ARRAY",)}


def validate_responses(answers: DataFrame, required: list[str], raw: str = "raw",
                       types: dict[str, str] | None = None) -> DataFrame:
    """Adds ``text`` (fences stripped), ``reject_reason`` and ``missing_keys``.

    Reasons: "no answer" (null text), "not json" (also trailing data after
    the value, as Python's parser), "not object" (a JSON array
    or scalar - the reference has no branch for it), "missing keys: a, b",
    and with ``types`` (see ``KEY_TYPES``) "wrong types: a, b".
    Parsing is ``try_parse_json`` (Variant); keys by ``json_object_keys``;
    the missing list is ``array_except(required, keys)``, sorted.
    """
    base = with_computed_once(answers, text=strip_fences(raw))
    base = with_computed_once(base, _v=F.try_parse_json(F.col("text")),
                              _whole=json_whole_text(F.col("text")),
                              _keys=F.json_object_keys(F.col("text")))
    v = F.col("_v")
    kind = F.schema_of_variant(v)
    req = F.array(*[F.lit(k) for k in required])
    missing = F.sort_array(F.array_except(req, F.coalesce("_keys", F.array().cast("array<string>"))))
    reason = (F.when(F.col(raw).isNull(), F.lit("no answer"))
              .when(v.isNull() | ~F.col("_whole"), F.lit("not json"))
              .when(~kind.startswith("OBJECT"), F.lit("not object"))
              .when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))))
    if types:
        wrong = F.array_compact(F.array(*[F.when(_wrong_type(v, k, t), F.lit(k)) for k, t in sorted(types.items())]))
        reason = reason.when(F.size(wrong) > 0, F.concat(F.lit("wrong types: "), F.array_join(wrong, ", ")))
    obj = v.isNotNull() & F.col("_whole") & kind.startswith("OBJECT")
    return (base.withColumns({"missing_keys": F.when(obj, missing), "reject_reason": reason})
            .drop("_v", "_whole", "_keys"))


def _wrong_type(v: Column, key: str, wanted: str) -> Column:
    found = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    fits = found == "VOID"
    for name in _VARIANT_TYPES[wanted]:
        fits = fits | (found.startswith(name) if wanted == "array" else found == name)
    return F.coalesce(~fits, F.lit(False))


REVIEW_SCHEMA = ("summary string, risk_level string, key_changes array<string>, files_changed int, "
                 "issues array<struct<severity:string,description:string,confidence:string>>")
TESTS_SCHEMA = "language string, test_code string, functions_covered array<string>, notes string"
ARCHITECTURE_SCHEMA = ("overview string, components array<struct<name:string,role:string>>, "
                       "mermaid_diagram string")


def parse_valid(validated: DataFrame, schema: str) -> DataFrame:
    """Accepted answers parsed into typed columns (``from_json``)."""
    ok = validated.filter(F.col("reject_reason").isNull())
    return ok.select("*", F.from_json("text", schema).alias("_p")).select(
        *[c for c in validated.columns], "_p.*").drop("_p")
