"""The shingle join: orders, bounds, cells and what they leave on disk."""

import os
import random

from pyspark.sql import functions as F

from changelens.functions.shingles import hashed_sets
from changelens.llm import jaccard_join
from changelens.operators import dedup, report
from changelens.schemas import UNITS
from changelens.session import shuffles_dropped


def _units(spark, texts):
    return spark.createDataFrame([(i, r, f"f{i}", "n", 1, c.count("\n") + 1, g, c, len(c), i) for i, c, g, r in texts], UNITS)


def _family(n, size=200, own=4):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(size)]
    out = []
    for i in range(n):
        words = list(base)
        for j in range(rng.randrange(own)):
            words[rng.randrange(size)] = f"own{i}_{j}"
        out.append((i, " ".join(words), "en" if i % 5 else "de", f"r{i % 3}"))
    return out


def _brute(texts, t=0.75):
    sets = {}
    for i, c, g, r in sorted(texts, key=lambda x: (x[3], x[0])):
        w = c.split()
        sets.setdefault((g, frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4))), (r, i))
    items = [(g, s, p) for (g, s), p in sets.items()]
    out = set()
    for x, (g, s, p) in enumerate(items):
        for h, u, q in items[x + 1:]:
            if g == h and len(s & u) >= t * len(s | u):
                out.add((min(p, q)[1], max(p, q)[1], len(s & u), len(s | u)))
    return out


def test_parted_cells_check_every_pair(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(dedup, "BLOCK_PAIRS", 40)
    texts = _family(70)
    got = {(r.a_id, r.b_id, r.inter, r.union_size) for r in dedup.shingle_similar_pairs(_units(spark, texts)).collect()}
    assert got == _brute(texts) and len(got) > 300


def test_a_few_common_words_are_no_candidate(spark):
    # all share one passage that is a tenth of their shingles, and nothing else
    passage = [f"p{i}" for i in range(14)]
    texts = [(i, " ".join([f"x{i}_{j}" for j in range(80)] + passage), "en", "r") for i in range(40)]
    reps = dedup._representatives(_units(spark, texts), 5, 5, first=lambda s: s[:dedup.prefix_len_py(len(s), 0.75)])
    met = dedup._met(dedup._prefixes(reps))
    assert met.count() > 100 and dedup._candidates(met, 0.75).count() == 0


def test_order_counts_every_row(spark):
    # one frequent shingle in a small part of the rows: no sample may miss it
    texts = [(i, " ".join(f"x{i}_{j}" for j in range(9)), "en", "r") for i in range(200)] + [(300 + i, f"a b c d e z{i}", "en", "r") for i in range(3)]
    s = hashed_sets(["a b c d e"], 5)[0]
    assert dedup._heavy_tokens(_units(spark, texts), 3, 1, 1.0) == [int(s[0]) & (dedup._SLOTS - 1)]


def test_documents_without_a_source_are_reported(spark):
    text = " ".join(f"w{i}" for i in range(30))
    texts = [(1, text, "en", None), (2, text, "en", None), (3, text + " z", "en", None), (4, text, "en", "r1"), (5, "a b", "en", "r2")]
    u = _units(spark, texts)
    rep = report.duplicate_report(u.select("repo"), u, dedup.shingle_similar_pairs(u), copies=dedup.copy_groups(u), unnamed=True)
    got = {r.repo: tuple(r)[1:] for r in rep.collect()}
    assert got == {None: (3, 3, 6), "r1": (1, 1, 3), "r2": (1, 1, 0)}


def test_order_tells_tokens_below_any_multiple_of_the_mean(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f{i} " + " ".join(f"x{i}_{j}" for j in range(4000))) for i in range(12)], "doc_id long, text string")
    table = docs.mapInArrow(jaccard_join._keys_and_counts(4), jaccard_join._FIRST_PASS)
    levels = jaccard_join.frequency_levels(table.filter("block is not null").select("block", "counts"))
    common = int(jaccard_join.shingle_sets(["a b c d"], 4)[0][0]) & (jaccard_join.SKETCH - 1)
    assert levels[common] >= 28 and (levels >= levels[common]).sum() < 20


def test_shuffle_files_go_with_the_job(spark):
    import time
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf)
    with shuffles_dropped(spark):
        assert spark.conf.get(conf) == "true"
    assert spark.conf.get(conf) == before
    ids = lambda: {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
                   for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    from changelens.session import store
    old = ids()
    table = store(spark.range(50_000).groupBy((F.col("id") % 5000).alias("k")).count())
    for _ in range(50):
        if not ids() - old:
            break
        time.sleep(0.1)
    assert not ids() - old
    assert table.count() == 5000
