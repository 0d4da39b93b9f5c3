"""Mixing, sharding and packing: exact laws on small tables."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changelens.llm import mixing, packing, sharding

DOCS = "doc_id bigint, text string, source string"


def _docs(n=600):
    rows = []
    for i in range(n):
        s = "big" if i % 3 == 0 else f"s{i % 11}"
        rows.append((i, " ".join(["w"] * (1 + i * 37 % 90)), None if i % 101 == 7 else s))
    return rows + [(n, None, "s1"), (n + 1, "", "empty"), (n + 2, "x " * 5000, "s2"), (None, "a b", "s3"), (5, "again here", "s5"),
                   (5, "again here", "s5")]


def brute_mix(rows):
    import hashlib
    size = lambda t: len((t or "").encode().split())
    h = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    taken = []
    for s in names:
        own = sorted((h(i), size(t)) for i, t, x in rows if x == s)
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, cum, limit = target[s] - whole * total[s], 0, -1
        for v in sorted({a for a, _ in own}):
            same = sum(b for a, b in own if a == v)
            if rest <= 0 or (cum + same > rest and same > 2 * (rest - cum)):
                break
            cum, limit = cum + same, v
            if cum > rest:
                break
        taken += [(s, b, (whole + (a <= limit and rest > 0)) * b) for a, b in own]
    return target, taken


def test_mix_matches_brute_force(spark):
    rows = _docs()
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    target, taken = brute_mix(rows)
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted(((r.source, r.size, r.taken) for r in got), key=key) == sorted(taken, key=key)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
    assert sorted(got, key=str) == sorted(mixing.mix(spark.createDataFrame(rows, DOCS).repartition(7)).collect(), key=str)


def test_apply_mix_repeats_rows_and_keeps_columns(spark):
    rows = _docs(200)
    df = spark.createDataFrame(rows, DOCS).withColumns({"limit": F.lit(1), "size": F.lit("clash"), "_mix_source": F.lit(0)})
    out = mixing.apply_mix(df)
    want = {(r.doc_id, r.source): r.times for r in mixing.mix(df).collect()}
    assert out.columns == df.columns
    assert out.count() == sum(r.times for r in mixing.mix(df).collect())
    assert {(r.doc_id, r.source) for r in out.collect()} == {k for k, v in want.items() if v}
    assert mixing.apply_mix(df.limit(0)).count() == 0


def plain_shard(key, n, founded):
    """The descent in plain Python."""
    nodes, at = sharding.tree(n, None, founded), ""
    for _ in range(3):
        u = lambda name: ((xxhash.xxh64(f"{key}/{name}", seed=42).intdigest() >> 12) + 0.5) / 2 ** 52
        at = min((-math.log(u(name)) / w, name) for name, w in nodes[at].items())[1]
    return int(at)


def test_growth_moves_rows_into_the_new_shard_only_at_every_count():
    for founded in (None, 1, 7, 24):
        for n in range(1, 41):
            start = min(n, n if founded is None else founded)
            for key in range(120):
                old, new = plain_shard(key, n, start), plain_shard(key, n + 1, start)
                assert new in (old, n) and 0 <= old < n


@pytest.mark.parametrize("n, founded", [(1, 1), (7, 7), (23, 23), (24, 24), (23, 5), (40, 24)])
def test_shards_match_a_plain_descent(spark, n, founded):
    rows = [(i, "x") for i in range(200)] + [(None, "x"), (7, "x"), (8, None), (9, "y" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("shard", "part", "size", "n")})
    got = sharding.assign(df, n, founded=founded).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (plain_shard(key, n, founded), plain_shard(key, n + 1, founded))
    sizes = defaultdict(list)
    for r in got:
        sizes[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())


def test_shards_obey_the_key_law(spark):
    rows = [(i, "x" * (i % 50)) for i in range(6000)] + [(None, None), (3, "é"), (3, "é")]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    slots, counts = defaultdict(set), defaultdict(int)
    for r in got:
        counts[r.shard] += 1
        slots[r.shard].add(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(slots[s] == set(range(n)) for s, n in counts.items()) and set(counts) == set(range(24))
    assert max(counts.values()) < 1.35 * len(rows) / 24 and sum(r.grown_shard == 24 for r in got) > 150
    by = {(r.doc_id, r.size): r.text_crc32 for r in got}
    assert by[(3, 10)] == zlib.crc32("é".encode()) and by[(None, 8)] == 0
    assert sharding.assign(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_changed_weight_moves_rows_within_its_path_only(spark):
    ids = spark.range(5000)
    moved = ids.select(sharding.shard_of(F.col("id"), 24).alias("a"), sharding.shard_of(F.col("id"), 24, {5: 3.0}).alias("b")).collect()
    region, rack = (lambda s: s // 12), (lambda s: s // 4)
    for r in moved:
        if r.a != r.b:      # into the heavier region, rack or shard
            assert (region(r.a) != region(r.b) == region(5)) or (rack(r.a) != rack(r.b) == rack(5)) or r.b == 5
    assert sum(r.b == 5 for r in moved) > 2 * sum(r.a == 5 for r in moved)


PATH, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ENCODER = packing.Encoder(PATH, RANKS)
PIECES = st.one_of(st.text(max_size=6), st.sampled_from([
    " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\x1c", "don't", "'s", "It's", "a,b", "12ab", "é", "ß.", "...", "<|endoftext|>", "$$$ ", "日本"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_ids_equal_the_tokenizers(text):
    want = ENCODER.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want


@given(st.integers(1, 10_000))
def test_cut_covers_a_document(n):
    parts = packing.cut(n)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
    assert len(parts) <= n // 2048 + 6


def test_packing(spark):
    rows = [(i, " ".join(f"word{j} and" for j in range(i * 13 % 700))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "a b " * 20_000), (903, "x" * 30_000), (5, rows[5][1]), (None, "no id")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, RANKS).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    seen, bins = defaultdict(list), defaultdict(list)
    for r in out:
        seen[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, docs in want.items():
        pieces = []
        for ids in docs:
            start = 0
            for n in packing.cut(len(ids)):
                pieces.append((start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()), len(ids)))
                start += n
        assert sorted(seen[i]) == sorted(pieces)
    used = 0
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        used += at
    assert used > 0.97 * 2048 * (len(bins) - 1)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(empty, PATH, RANKS).count() == 0
