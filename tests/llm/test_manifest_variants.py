"""Merkle manifest, best-fit packing and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changelens.llm import best_fit, merkle, spelling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
UPPER = {c: c + 32 for c in range(65, 91)}


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) -> sorted result rows, one tree at a time."""
    def leaf(r, text):
        return _hash(*map(_field, (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        """Root and, for every node, its path of (left, right) siblings."""
        paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            up, over = [], []
            for at in range(0, len(nodes), 8):
                run = nodes[at:at + 8]
                for k in range(len(run)):
                    for m in members[at + k]:
                        paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
                up.append(_hash(*run))
                over.append([m for k in range(len(run)) for m in members[at + k]])
            nodes, members = up, over
        return nodes[0], paths

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        langs[name].sort(key=lambda x: x[:3])
        built[name] = tree([x[2] for x in langs[name]])
    root, above = tree([built[x][0] for x in names]) if names else (None, [])
    out = []
    for name, outer in zip(names, above):
        for (_, _, own, r), path in zip(langs[name], built[name][1]):
            tampered = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, r[1].translate(UPPER)) if tampered else own
            for a, b in path + outer:
                h = _hash(a, h, b)
            out.append((r[0], own, built[name][0], root, _hash(*[x for p in path + outer for x in p]), h, h == root))
    return sorted(out, key=str)


def _manifest(spark, rows, levels, extra=None):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        df = df.withColumns(extra)
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, merkle.manifest(df, tampered, altered={"text": lowered}, levels=levels).collect()), key=str)


def _documents(n, seed=3):
    rng = random.Random(seed)
    rows = [(i, f"Text {i} É" if i % 4 else "low", rng.choice(["en", "en", "de", "fr", None]), "s", i) for i in rng.sample(range(10 * n), n)]
    return rows + [(None, None, None, None, None), (None, "A null id", "en", "s", 1), (7, "Same", "en", "s", 4), (7, "Same", "en", "s", 4),
                   (7, "Other", "en", "s", 4), (8, "", "lone", None, 0), (9, "Long " * 50_000, "de", "s", None)]


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_matches_brute_force(spark, levels):
    # one level a superblock takes several rounds up and down
    rows = _documents(300)
    assert _manifest(spark, rows, levels) == brute_manifest(rows)


def test_manifest_of_one_row_one_group_and_none(spark):
    rows = _documents(9)
    clash = {"tree": F.lit("x"), "pos": F.lit(1), "node": F.lit("n"), "id": F.lit(5), "row": F.lit(2), "n": F.lit(3), "block": F.lit(0)}
    assert _manifest(spark, rows, 4, clash) == brute_manifest(rows)
    for few in (rows[:1], [(i, "A", "en", "s", 1) for i in range(20)], [(1, "A", x, "s", 1) for x in "abcdefghijklmnop"]):
        assert _manifest(spark, few, 1) == brute_manifest(few)
    assert _manifest(spark, [], 4) == []


def test_a_changed_field_fails_the_check(spark):
    df = spark.createDataFrame([(i, "t", "en", "s", i) for i in range(50)], DOCS)
    got = merkle.manifest(df, F.col("doc_id") == 11, altered={"n_chars": F.col("n_chars") + 1}).collect()
    assert [r.id for r in got if not r.verified] == [11] and len(got) == 50


# --------------------------------------------------------------------------

WORD_BPE = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(WORD_BPE)


def _ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def _check_packing(rows, got, capacity):
    """Every id in exactly one piece, no gaps, no overfull sequence; returns their number."""
    want = Counter()
    for doc_id, text in rows:
        ids = _ids(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("group", [8192, 40])
def test_best_fit_covers_every_id(spark, group):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["Variant", "word's", "x1", "née"], k=rng.randrange(1, 90)))) for i in range(400)]
    rows += [(None, None), (None, "a b"), (3, ""), (3, ""), (4, "long text " * 700), (5, "tab\tand　space\x85 <|endoftext|> it's")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"bin": F.lit(1), "row": F.lit("x"), "free": F.lit(0)})
    got = best_fit.pack(df, WORD_BPE, capacity=128, group=group).collect()
    n = _check_packing(rows, got, 128)
    least = -(-sum(r.length for r in got) // 128)
    assert n <= 1.02 * least + 1
    assert best_fit.pack(df.limit(0), WORD_BPE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZéÉßſİªŉ '\n\t ́​1.!<|")), max_size=12), max_size=6))
def test_word_encoder_equals_the_tokenizer(words):
    text = " ".join(words)
    encoder = best_fit.WordEncoder(WORD_BPE)
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() + [1] == _ids(text)


def test_letters_that_normalizing_ends_in_a_mark():
    encoder = best_fit.WordEncoder(WORD_BPE)
    for word in ["İ<", "aİ.", "\ufb2a<", "\u0958!", "é<", "a\u0301."]:
        assert np.frombuffer(encoder.encode(word), "<u4").tolist() + [1] == _ids(word), word


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=120))
def test_exchanges_raise_the_squared_fill(lengths):
    bins = []
    for i, n in enumerate(lengths):                 # a poor start: two documents a bin at most
        if i % 2 == 0 or bins[-1].fill + n > 100:
            bins.append(best_fit.Bin())
        bins[-1].add(n, i)
    before = sum(b.fill ** 2 for b in bins)
    after = best_fit.local_search(list(bins), 100)
    assert len(after) <= len(bins) and all(0 < b.fill <= 100 for b in after)
    assert sum(b.fill ** 2 for b in after) >= before
    assert sorted(d for b in after for ds in b.docs.values() for d in ds) == list(range(len(lengths)))
    assert all(lengths[d] == n for b in after for n, ds in b.docs.items() for d in ds)


def test_swaps_empty_a_bin_that_moves_alone_cannot():
    bins = []
    for docs in ([60, 25], [35, 5], [70]):      # 35 fits nowhere until it changes places with 25
        bins.append(best_fit.Bin())
        for d in docs:
            bins[-1].add(d, len(bins) * 10 + len(bins[-1].docs))
    assert sorted(b.fill for b in best_fit.local_search(bins, 100)) == [95, 100]


# --------------------------------------------------------------------------

def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def _variants(spark, words, **kw):
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.group_variants(df, **kw).collect())


@pytest.mark.parametrize("largest_join", [spelling.LARGEST_JOIN, 4])
def test_variants_match_brute_force(spark, largest_join):
    # a bound of 4 pairs sends most grams through the splitting rounds
    rng = random.Random(11)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 7))): rng.randrange(1, 40) for _ in range(150)}
    words |= {"prefix" + "".join(rng.choices("xyz", k=rng.randrange(0, 5))): rng.randrange(1, 400) for _ in range(80)}
    words |= {"a" * n: 1 + n % 7 for n in range(1, 20)} | {"z" * 4000: 5, "z" * 3999: 10, "z" * 2000 + "é" + "z" * 1999: 1}
    assert _variants(spark, words, largest_join=largest_join) == brute_variants(words)


def test_forms_end_in_a_root(spark):
    chain = {"a" * (5 + i): 2 ** i for i in range(14)}      # every word's form is the next
    got = _variants(spark, chain)
    assert got == brute_variants(chain) and {r[2] for r in got} == {"a" * 18}
    assert _variants(spark, {"lone": 3}) == [("lone", "", "lone", 3, 0, 0)]


def test_words_are_counted_over_whole_texts(spark):
    rows = [(i % 40, "Colour colour COLOUR Élan élan×way don't " * 3 + "x" * (i % 4)) for i in range(200)]
    rows += [(None, "colour colour"), (None, None), (3, ""), (1, "abcde " * 30_000), (1, "q" * 70_000), (2, "q" * 70_000), (4, "q" * 70_000)]
    want = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 5 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("w"), "n": F.lit(1)})
    assert {r.word: r.n for r in spelling.count_words(df, typo_every=5).collect()} == want
    assert spelling.group_variants(spelling.count_words(df.limit(0))).count() == 0
