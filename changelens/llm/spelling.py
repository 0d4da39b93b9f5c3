"""Spelling variants: words one edit apart, grouped under their commonest form.

Words are maximal runs of Latin letters, lower-cased in A-Z only, counted over
all texts (per batch in the worker, then by a map-side combined sum).  Near
words, one inserted, deleted or replaced code point apart, come from
asymmetric q-chunks: of two words the shorter (of equal lengths the smaller)
contributes two disjoint chunks, its halves; the other contributes its
positional grams of a chunk's length, of which only those within shift one of
a chunk can join and are emitted.  One edit leaves one half whole and moves it
by one place at most, so an equi-join on the gram finds every near pair; the
join's condition verifies the whole words, and no unverified pair leaves it.

A gram that very many words share is not joined: its words go on without it,
cut in halves again, under the gram as their group, until the groups are small
or one letter is left, where the alphabet bounds them.  This takes a logarithm of
the word length in rounds and loses no pair.

A word's form is its near word of largest count (ties: smallest in code-point
order) when that is at least ``ratio`` times its own; counts then grow along
forms, so they end, and pointer doubling finds every root in few rounds.

Defined cases: null text has no words; a null id counts as an empty one; very
long runs are words like others (their grams travel as 64-bit hashes); repeated
rows count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, save

RUN = "[A-Za-zÀ-ÿ]+"          # fixed value
HELD = 200_000          # counted words a worker holds before it passes them on
LARGEST_JOIN = 250_000  # pairs of one gram that are verified without splitting it further
_UPPER = {c: c + 32 for c in range(65, 91)}


def _count_batches(typo_every: int | None, least_length: int):
    find = re.compile(RUN).findall

    def lowered(run, known):
        if (pair := known.get(run)) is None:
            if len(known) > HELD:
                known.clear()
            low = run.translate(_UPPER)
            pair = known[run] = (low, low.encode())
        return pair

    def run(batches):
        known: dict[str, tuple[str, bytes]] = {}
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                             names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs: Counter = Counter()
                for r, n in Counter(find(text.as_py() or "")).items():
                    runs[lowered(r, known)] += n
                for (low, raw), n in runs.items():
                    if typo_every and (h := zlib.crc32(raw, start)) % typo_every == 0:
                        at = h % len(low)
                        low = low[:at] + low[at + 1:]
                    if len(low) >= least_length:
                        total[low] += n
                if len(total) > HELD:
                    yield flush()
        if total:
            yield flush()
    return run


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, typo_every: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words of ``least_length`` code points found ``least_count`` times.

    ``typo_every`` drops a letter of one in so many (document, word) pairs,
    chosen by the CRC-32 ``h`` of ``<id>:<word>``: the one at ``h`` % length.
    """
    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(
        _count_batches(typo_every, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _struct(length: Column, side: int, at: Column, size: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), F.lit(side).alias("side"), at.cast("int").alias("at"),
                    size.cast("int").alias("size"))


def _chunks() -> Column:
    """The halves of ``rest``."""
    n = F.length("rest")
    half = F.floor(n / 2)
    return F.array(_struct(n, 0, F.lit(0), half), _struct(n, 1, half, n - half))


def _grams() -> Column:
    """Grams of ``rest`` within shift one of a half of a word as long or one shorter."""
    m = F.length("rest")
    out = []
    for n in (m - 1, m):
        half = F.floor(n / 2)
        for side, at, size in ((0, F.lit(0), half), (1, half, n - half)):
            out += [F.when((n >= 0) & (at + d >= 0) & (at + d + size <= m), _struct(n, side, at + d, size)) for d in (-1, 0, 1)]
    return F.array_compact(F.array(*out))


def _keyed(items: DataFrame, parts: Column) -> DataFrame:
    """One row per part of each item (grp, word, n, rest), under the part's key."""
    p = items.select("*", F.explode(parts).alias("p"))
    gram = F.substring("rest", F.col("p.at") + 1, F.col("p.size"))
    return p.withColumn("key", F.xxhash64("grp", "p.length", "p.side", gram))


def _without_part(keyed: DataFrame) -> DataFrame:
    rest = F.concat(F.substring("rest", F.lit(1), F.col("p.at")), F.expr("substring(rest, p.at + p.size + 1)"))
    return keyed.select(F.col("key").alias("grp"), "word", "n", rest.alias("rest"))


def near_pairs(words: DataFrame, largest_join: int = LARGEST_JOIN) -> DataFrame:
    """(a, a_n, b, b_n) for all pairs of words (word, n) exactly one edit apart, once each."""
    items = words.select(F.lit(0).cast("long").alias("grp"), "word", "n", F.col("word").alias("rest"))
    short, long_ = items, items
    found = None
    while True:
        chunks, grams = _keyed(short, _chunks()), _keyed(long_, _grams())
        sizes = (chunks.select("key", F.lit(1).alias("c"), F.lit(0).alias("g"), F.when(F.length("rest") > 1, 1).otherwise(0).alias("s"))
                 .union(grams.select("key", F.lit(0), F.lit(1), F.lit(0))).groupBy("key")
                 .agg(F.sum("c").alias("c"), F.sum("g").alias("g"), F.max("s").alias("s")))
        hot = save(sizes.filter((F.col("c") * F.col("g") > largest_join) & (F.col("s") == 1)).select("key"))
        split = not hot.isEmpty()
        c, g = (chunks.join(hot, "key", "left_anti"), grams.join(hot, "key", "left_anti")) if split else (chunks, grams)
        c = c.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        g = g.select("key", F.col("word").alias("b"), F.col("n").alias("b_n")).distinct()
        shorter = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
        pairs = c.join(g, (c["key"] == g["key"]) & shorter & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        found = pairs if found is None else found.union(pairs)
        if not split:
            return found.distinct()
        short = save(_without_part(chunks.join(hot, "key", "left_semi")))
        long_ = save(_without_part(grams.join(hot, "key", "left_semi")).distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form), following forms to the last."""
    at = save(forms.select("word", F.col("form").alias("root")))
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = save(at.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                        F.col("further").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")


def group_variants(words: DataFrame, ratio: float = 2, largest_join: int = LARGEST_JOIN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    words = save(words)
    pairs = near_pairs(words, largest_join)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                                         F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("b"))
    best = best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.col1")).alias("near_n"))
    all_ = words.join(best, "word", "left")
    is_form = F.col("near_n") >= F.lit(ratio) * F.col("n")
    all_ = save(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = _roots(all_.filter(F.col("form").isNotNull()))
    return all_.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")



# DuckDB's levenshtein counts bytes: letters beyond ASCII become other ASCII ones.
_BEYOND = "".join(map(chr, range(0xC0, 0x100)))
_ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"

ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS k FROM runs),
h AS (SELECT run, n, {crc32_sql("k")} AS h FROM hashed),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                      ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_BEYOND}', '{_ONE_BYTE}') AS t
      FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM w a JOIN w b
         ON abs(length(a.t) - length(b.t)) <= 1 AND a.word <> b.word AND levenshtein(a.t, b.t) = 1),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n
         FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
             CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL
          UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL),
last AS (SELECT c.word, c.at FROM chain c JOIN f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(last.at, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN last USING (word)
"""
