"""Quality rules combined by weak supervision.

Every rule reads the text's own counts and votes good (1), bad (0) or abstains
(null).  Expectation-maximisation estimates, from the votes of all documents
and without labels, how often each rule is right on good and on bad text; a
document's posterior probability of being good replaces the usual demand that
it pass every rule.

The votes of a corpus are summed up as counts per vote pattern (at most 3 to
the number of rules, whatever the corpus size, combined map-side); only these
counts reach the driver.  Everything per document is native expressions, in
the scan stage; text is never shuffled.

Defined cases: null and empty texts have no words, all counts 0, and fail the
base rule; very long texts are read whole (repeats are found by sorting inside
the row); an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import with_computed_once
from .common import NOT_BLANK, fresh, save, words_of

MIN_WORDS = 50               # base rule
MAX_REPEAT_PERCENT = 50      # base rule
PRIOR_GOOD = 0.85            # starting share of good documents
# Pseudo-counts: before any count, a rule that votes calls 99 of 100 good texts
# good and, as texts are bad in many ways, only 25 of 100 bad texts bad.
PRIOR_ON_GOOD = (99.0, 1.0)
PRIOR_ON_BAD = (25.0, 75.0)
ROUNDS = 60
THRESHOLD = 0.5

# A word of letters with at most one mark after it; a line that ends a sentence.
_PLAIN = rf"(?<!{NOT_BLANK})\p{{L}}[\p{{L}}'-]*+[.,;:]?(?!{NOT_BLANK})"
_SENTENCE = r"[\p{L}\p{N}][.!?][ \t\r]*+$"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _band(x: Column, good: float, bad: float) -> Column:
    """Good up to ``good``, bad from ``bad``, abstain between."""
    return F.when(x <= good, 1).when(x >= bad, 0)


def _least(x: Column, good: float, bad: float) -> Column:
    """Good from ``good`` on, bad up to ``bad``, abstain between."""
    return F.when(x >= good, 1).when(x <= bad, 0)


def rules(c: dict[str, Column]) -> dict[str, Column]:
    """The votes, from the columns of ``counts``."""
    n, chars = c["n_words"], c["word_chars"]
    length = _rate(chars, n)
    return {
        "long_enough": F.when(n < MIN_WORDS, 0).when(n >= 2 * MIN_WORDS, 1),
        "word_length": F.when((length < 2) | (length > 14), 0).when((length >= 3) & (length <= 10), 1),
        "few_symbols": _band(_rate(c["n_symbols"], n), 0.05, 0.3),
        "few_dup_lines": _band(_rate(c["n_dup_lines"], c["n_lines"]), 0.1, 0.3),
        "few_repeats": _band(_rate(c["n_repeat_words"], n), 0.2, 0.4),
        "few_capitals": _band(_rate(c["n_capitals"], chars), 0.2, 0.5),
        "few_shouts": _band(_rate(c["n_shouts"], n), 0.05, 0.3),
        "few_digits": _band(_rate(c["n_digits"], chars), 0.1, 0.3),
        "plain_words": _least(_rate(c["n_plain"], n), 0.9, 0.75),
        "sentence_lines": _least(_rate(c["n_sentence_lines"], c["n_lines"]), 0.9, 0.6),
        "varied_words": _least(_rate(c["n_distinct"], n), 0.5, 0.3),
    }


def counts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with one struct column of counts; and the counts by name."""
    t, w, h, s, p = fresh(docs, "t", "w", "h", "s", "counts")
    df = with_computed_once(docs, **{t: F.coalesce(F.col(f"`{text_col}`"), F.lit(""))})
    df = with_computed_once(df, **{w: words_of(F.col(t))})
    n = F.size(w)
    windows = F.transform(
        F.slice(F.col(w), F.lit(1), n - 2),
        lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    df = with_computed_once(df, **{h: F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>"))})
    # texts with a window found twice: windows sorted by hash, then position
    repeated = F.size(F.array_distinct(F.col(h))) < F.size(h)
    order = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = with_computed_once(df, **{s: F.when(repeated, order)})
    at = F.col(s)

    def twice(e, j):
        before = F.when(j > 0, F.get(at, j - 1)["h"] == e["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(at, j + 1)["h"] == e["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(at, twice), lambda e: e["i"]))
    # each place covers three words; overlapping places count once
    covered = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(NOT_BLANK))
    df = with_computed_once(df, **{p: F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(F.col(w), "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(t), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count(F.col(t), F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(F.col(t), F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count(F.col(t), F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count(F.col(t), F.lit(_PLAIN)).cast("long").alias("n_plain"),
        F.size(F.filter(lines, lambda x: x.rlike(_SENTENCE))).cast("long").alias("n_sentence_lines"),
        F.size(F.array_distinct(F.col(w))).cast("long").alias("n_distinct"))})
    return df.drop(t, w, h, s), {k: F.col(p)[k] for k in (
        *COUNTS, "n_lines", "n_capitals", "n_shouts", "n_digits", "n_plain", "n_sentence_lines", "n_distinct")} | {"": F.col(p)}


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def estimate(patterns: list[tuple[tuple, int]], n_rules: int) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, count) pairs: the log odds of a good document before any
    vote, and per rule what a good and a bad vote add to them."""
    share = PRIOR_GOOD
    prior = (PRIOR_ON_GOOD[0], sum(PRIOR_ON_GOOD), PRIOR_ON_BAD[0], sum(PRIOR_ON_BAD))
    right = [(prior[0] / prior[1], prior[2] / prior[3])] * n_rules      # on good, on bad text
    weights: list[tuple[float, float]] = []
    for _ in range(ROUNDS):
        weights = [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in right]
        start = math.log(share / (1 - share))
        sums = [list(prior) for _ in range(n_rules)]
        good, total = 10 * PRIOR_GOOD, 10.0
        for votes, n in patterns:
            odds = start + sum(w[0] if v else w[1] for v, w in zip(votes, weights) if v is not None)
            q = _sigmoid(odds)
            good, total = good + n * q, total + n
            for v, s in zip(votes, sums):
                if v is not None:
                    s[0] += n * q * v
                    s[1] += n * q
                    s[2] += n * (1 - q) * (1 - v)
                    s[3] += n * (1 - q)
        # a rule votes good on good text more often than on bad, else the two could swap
        on_good = [min(max(a / b, 0.55), 0.998) for a, b, _, _ in sums]
        right = [(g, min(max(c / d, 1.02 - g, 0.02), 0.98)) for g, (_, _, c, d) in zip(on_good, sums)]
        share = min(max(good / total, 0.05), 0.95)
    return math.log(share / (1 - share)), weights


def _fit(votes: DataFrame, names: list[str]) -> tuple[float, list[tuple[float, float]]]:
    found = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).collect()
    patterns = sorted(((tuple(r[k] for k in names), r["_n"]) for r in found), key=repr)
    return estimate(patterns, len(names))


def _odds(votes: list[Column], model) -> Column:
    start, weights = model
    return reduce(lambda a, b: a + b, [
        F.when(v == 1, F.lit(w[0])).when(v == 0, F.lit(w[1])).otherwise(F.lit(0.0))
        for v, w in zip(votes, weights)], F.lit(start))


def _base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, votes, posterior and verdict."""
    df, c = counts(docs.select(F.col(id_col), F.col(text_col)), text_col)
    votes = rules(c)
    table = save(df.select(F.col(id_col), *[c[k].alias(k) for k in COUNTS],
                           *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()]))
    names = [f"vote_{k}" for k in votes]
    odds = _odds([F.col(n) for n in names], _fit(table, names))
    failed = _base_failed({k: F.col(k) for k in COUNTS})
    p = 1 / (1 + F.exp(-odds))
    return table.select("*", p.alias("p_good"), failed.alias("base_failed"), (~failed & (p >= THRESHOLD)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    df, c = counts(docs)
    votes = rules(c)
    names = [f"vote_{k}" for k in votes]
    model = _fit(df.select(*[v.cast("int").alias(n) for n, v in zip(names, votes.values())]), names)
    good = 1 / (1 + F.exp(-_odds([v.cast("int") for v in votes.values()], model))) >= THRESHOLD
    return df.filter(~_base_failed(c) & good).select(*[F.col(f"`{x}`") for x in docs.columns])
