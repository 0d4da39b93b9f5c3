"""Families of near copies against brute force, and the positional bound."""

import random

import pytest
from pyspark.sql import functions as F

from changelens.functions.columns import rounded_ratio
from changelens.operators import components, dedup

UNITS = ("unit_id bigint, repo string, file string, name string, start_line int, line_count int, "
         "lang_group string, code string, n_chars int, scan_ord bigint")


def _unit(i, code, group="en", repo="r"):
    return (i, repo, f"f{i}", "n", 1, code.count("\n") + 1, group, code, len(code), i)


def _units(spark, texts):
    return spark.createDataFrame([_unit(*t) for t in texts], UNITS)


def _shingles(code, k=5):
    words = code.split()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(texts, t=0.75, within=False):
    """Unit -> smallest representative of its family, by comparing everything."""
    units = [(i, _shingles(c), (c.count("\n") + 1) // dedup.BUCKET_SIZE, g, r) for i, c, g, r in texts if c.split()]
    units.sort(key=lambda u: (u[4], u[0]))
    rep = {}
    for i, s, b, g, r in units:
        rep.setdefault((s, b, g, r if within else None), i)
    parent = {i: i for i in rep.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    items = [(i, *key) for key, i in rep.items()]
    for n, (i, s, b, g, r) in enumerate(items):
        for j, s2, b2, g2, r2 in items[n + 1:]:
            if g == g2 and r == r2 and abs(b - b2) <= 1 and len(s & s2) >= t * len(s | s2):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(rep[s, b, g, r if within else None]) for i, s, b, g, r in units}


def _texts(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    base = [rng.choices(vocab, k=rng.randrange(6, 60)) for _ in range(12)]
    texts = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        sep = "\n" if i % 3 == 0 else " "
        texts.append((i, sep.join(words) + "\n" * rng.randrange(0, 7), rng.choice(["en", "en", "de"]), f"r{i % 4}"))
    return texts + [(n, "", "en", "r1"), (n + 1, "a b", "en", "r1"), (n + 2, "a  b", "en", "r2"), (n + 3, "a b", "de", "r1")]


@pytest.mark.parametrize("rounds", [1, 4])
@pytest.mark.parametrize("within", [False, True])
def test_families_match_brute_force(spark, rounds, within):
    texts = _texts(7)
    got = {r.unit_id: r.family_id for r in dedup.near_families(_units(spark, texts), within_repo=within, rounds=rounds).collect()}
    assert got == brute(texts, within=within)


def test_a_large_family_is_one_family(spark):
    # every text differs from every other in a word of its own
    words = [f"w{i}" for i in range(80)]
    texts = [(i, " ".join(words[:i % 78] + [f"own{i}"] + words[i % 78:]), "en", "r") for i in range(1500)]
    texts += [(2000 + i, " ".join(f"x{i}_{j}" for j in range(30)), "en", "r") for i in range(20)]
    rows = dedup.near_families(_units(spark, texts)).collect()
    assert len(rows) == 1520
    assert {(r.family_id, r.family_size) for r in rows if r.unit_id < 2000} == {(0, 1500)}
    assert all(r.family_size == 1 and r.family_id == r.unit_id for r in rows if r.unit_id >= 2000)


def test_links_form_groups(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 90), (90, 7), (7, 5), (3, 3)] + [(1, x) for x in rng.sample(range(200, 400), 60)]
    links = spark.createDataFrame(chain, "a_id long, b_id long")
    got = {(r.node, r.family) for r in components.connected(links).collect()}
    want = {(i, 100) for i in range(100, 141)} | {(5, 5), (7, 5), (90, 5), (1, 1)} | {(b, 1) for a, b in chain if a == 1}
    assert got == want
    assert components.connected(links.limit(0)).count() == 0


def test_positions_bound_loses_no_pair(spark):
    texts = _texts(23, 90)
    units = _units(spark, texts)
    pairs = {(r.a_id, r.b_id) for r in dedup.shingle_similar_pairs(units).collect()}
    sets = {i: (_shingles(c), (c.count("\n") + 1) // dedup.BUCKET_SIZE, g, r) for i, c, g, r in texts if c.split()}
    rep = {}
    for i in sorted(sets, key=lambda i: (sets[i][3], i)):
        rep.setdefault(sets[i][:3], i)
    ids = sorted(rep.values())
    want = set()
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            (s, b, g, _), (s2, b2, g2, _) = sets[i], sets[j]
            if g == g2 and abs(b - b2) <= 1 and len(s & s2) >= 0.75 * len(s | s2):
                want.add(frozenset((i, j)))
    assert {frozenset(p) for p in pairs} == want
    assert dedup.near_families(units.filter(F.lit(False))).count() == 0


def test_ratios_round_as_python_does(spark):
    pairs = [(i, u) for u in list(range(1, 60)) + [200, 400, 1000, 8000] for i in range(0, u + 1, 1 if u <= 200 else 3)] + [(173, 200), (1, 8), (7, 8)]
    df = spark.createDataFrame(pairs, "i long, u long")
    got = df.select("i", "u", rounded_ratio(F.col("i"), F.col("u")).alias("r")).collect()
    assert [(r.i, r.u, r.r) for r in got if r.r != round(r.i / r.u, 2)] == []


def test_rank_follows_the_rounded_similarity(spark):
    rows = [("r", 1, 2, 90, 100), ("r", 3, 4, 901, 1000), ("r", 0, 9, 8, 8), ("q", 5, 6, 4, 5), ("r", 7, 8, 76, 100)]
    df = spark.createDataFrame(rows, "repo string, a_id long, b_id long, inter long, union_size long")
    got = sorted((r.repo, r.rank, r.a_id, r.similarity) for r in dedup.rank_in_repo(df).collect())
    assert got == [("q", 1, 5, 0.8), ("r", 1, 0, 1.0), ("r", 2, 1, 0.9), ("r", 3, 3, 0.9), ("r", 4, 7, 0.76)]


def test_sets_and_prefixes_are_moved_once(spark):
    """One exchange of the sets and one of slim prefix rows serve all branches."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = dedup.shingle_similar_pairs(_units(spark, _texts(5, 60)))
        assert pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert sum("Exchange hashpartitioning(tok#" in x for x in moved) == 1, moved
    assert sum("Exchange hashpartitioning(nid#" in x for x in moved) == 1, moved
