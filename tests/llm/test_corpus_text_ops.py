"""Exact dedup, quality rules, personal data and URL filter against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changelens.llm import exact_dedup, pii, quality_rules, url_filter

DOCS = "doc_id bigint, text string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed * 104729) % 9973}x{seed}" for i in range(n))


@pytest.fixture(scope="module")
def copies(spark):
    long = words(30_000)
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "abc"), (6, long), (7, long.upper()), (8, long + "!"),
            (9, long[:5000]), (10, long[:5000]), (11, "É"), (12, "é"), (13, "dup"), (13, "dup"), (None, "abc"), (14, "abd")]
    rows += [(100 + i, "Same text in a large group") for i in range(300)]
    rows += [(500 + i, long[:600] + chr(97 + i % 20)) for i in range(40)]
    return rows


def test_copies_match_brute_force(spark, copies):
    out = exact_dedup.mark_copies(spark.createDataFrame(copies, DOCS), carry=["doc_id"]).collect()
    assert len(out) == len(copies)
    groups = {}
    for i, t in copies:
        groups.setdefault(low(t), []).append(i)
    want = sorted((str(i), str(max((x for x in groups[low(t)] if x is not None), default=None)), len(groups[low(t)]),
                   hashlib.sha256(low(t).encode()).hexdigest()) for i, t in copies)
    assert sorted((str(r.doc_id), str(r._keep_id), r._size, r._sha) for r in out) == want
    assert sum(r._kept for r in out) == len(groups)      # of repeated rows one stays


def test_copies_keep_columns_and_empty_tables(spark, copies):
    df = spark.createDataFrame(copies, DOCS).withColumns({"_len": F.lit(1), "_gid": F.lit("x"), "extra": F.lit(None).cast("int")})
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len({low(t) for _, t in copies})
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def brute_counts(t):
    t = t or ""
    w, seen = WORD.findall(t), {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


RULE_TEXTS = [None, "", " \t\n", "one", "a b c a b c", "a a a a a", "x\u00a0y z", "l1 a\n\nl1 a\n l1 a\n", "é ü\x0bß\x0c|<>#",
              words(20_000), "a b c d " * 5000, "Good words " * 3 + words(200, 1) + "."]


def test_rule_counts_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(RULE_TEXTS)), DOCS)
    for r in quality_rules.judge(df).collect():
        b = brute_counts(RULE_TEXTS[r.doc_id])
        assert tuple(r[k] for k in quality_rules.COUNTS) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])


def test_rules_part_clean_from_junk(spark):
    clean = [(i, "This is line one of it. " + words(120, i).replace("w", "ab").translate(str.maketrans("0123456789", "cdefghijkl")) + ".")
             for i in range(200)]
    junk = [(1000 + i, " | ".join(t.split())) for i, t in clean[:20]]
    junk += [(2000 + i, t.upper().replace(" ", "!! ")) for i, t in clean[20:40]]
    df = spark.createDataFrame(clean + junk, DOCS).withColumn("n_words", F.lit("clash"))
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in clean}
    assert quality_rules.keep_good(df.limit(0)).count() == 0


def test_rules_estimate_is_stable_without_documents():
    odds, weights = quality_rules.estimate([], 3)
    assert odds > 0 and all(g > 0 > b for g, b in weights)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PII_TEXTS = [None, "", "a@b.c@d.e x", "@b.c@d.e", "1.2.3.4.5.6.7.8", "a@@b.com", "x..y@z.com.", "+1 2 3", "0001.2.3.4 256.1.1.1",
             "call +1 (555) 010-7788 now", "4111 1111 1111 1111 and 4111 1111 1111 1112", "4111-1111-1111-1111 1.2.3.4",
             "é mail jo@ex.org, ü", "9" * 300, "1 " * 500, "a@" * 200 + "b.c", "+" * 50 + "1 234 567 8901"]


def brute_pii(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), DOCS)
    for r in pii.digest(pii.find(df)).collect():
        want = brute_pii(PII_TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k in BASE)


def test_pii_method_adds_spelled_addresses_and_leaves_clean_text(spark):
    rows = [(i, f"please write mail to user{i}@site{i}.com today") for i in range(60)]
    rows += [(100 + i, f"contact jane{i} [at] host{i} [dot] com please") for i in range(10)]
    rows += [(200 + i, f"plain words number {i} and version 1.2.{i}") for i in range(50)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, DOCS))).collect()}
    assert all(got[i].startswith("email:") for i in range(60)) and all(got[100 + i].startswith("email:") for i in range(10))
    assert all(got[200 + i] == "" for i in range(50))
    assert pii.digest(pii.find(spark.createDataFrame([], DOCS))).count() == 0


SECRET = "".join(hashlib.md5(b"%d" % i).hexdigest()[:10] for i in range(4))


def test_pii_finds_what_no_base_pattern_names(spark):
    rows = [(i, f'set token = "{hashlib.sha1(b"%d" % i).hexdigest()}" here') for i in range(30)]
    rows += [(100 + i, "pay to IBAN DE89 3704 0044 0532 0130 00 today") for i in range(5)]
    rows += [(200 + i, "server 2606:4700:4700::1111 answers") for i in range(5)]
    rows += [(300 + i, f"at 12:30:{10 + i} the commit-message-of-2024 and Supercalifragilistic2") for i in range(30)]
    rows += [(None, rows[0][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, DOCS).withColumns({"found": F.lit("clash"), "spans": F.lit(1), "code": F.lit("x")})
    got = pii.digest(pii.find(df)).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert all(spans[i] == "secret:13:53" for i in [*range(30), None]) and len(got) == len(rows)
    assert all(spans[i] == "iban:12:39" for i in range(100, 105)) and all(spans[i] == "ip:7:27" for i in range(200, 205))
    assert all(r.spans == "" and r.n_spans == 0 for r in got if r.doc_id and r.doc_id >= 300)
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}


def test_pii_estimation_demotes_a_bad_labeler():
    # labelers 0, 1, 2 and 4 agree; labeler 3 says the opposite
    post = pii.em({"11101": 500, "00010": 500, "22212": 1, "22122": 1})
    assert post["11101"] > 0.95 and post["00010"] < 0.05
    assert post["22212"] < post["22122"] - 0.2
    even = pii.em({"22212": 1, "22122": 1})
    assert abs(even["22212"] - even["22122"]) < 0.01


def test_pii_gazetteers_are_a_parameter():
    gaz = pii.GAZETTEERS._replace(secret_starts=("zz-",), tlds=frozenset(["zz"]))
    assert pii.votes("zz-12ab34cd56ef78gh", 4, 0, 19, False, gaz)[2] == "1"
    assert pii.votes("zz-12ab34cd56ef78gh", 4, 0, 19, False)[2] == "2"
    assert pii.votes("a@b.zz", 0, 0, 6, True, gaz)[2] == "1"


def test_pii_text_of_very_many_candidates():
    """Spans stay disjoint from those before; overlap is found by binary search."""
    text = f"no 1234567890123 {SECRET} 1.2.3.4 " * 3000
    found = pii.candidates(text)
    assert Counter(k for k, *_ in found) == {1: 3000, 2: 3000, 4: 3000}
    spans = sorted((s, e) for _, s, e, *_ in found)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


URLS = {
    "https://m.Example.ORG/es/1?x": ("m.example.org", "/es/1", "example.org/es/", "block"),
    "http://example.org/en/15": ("example.org", "/en/15", "example.org/en/1", "block"),
    "http://example.org/en/25": ("example.org", "/en/25", "org/", "allow"),
    "http://org": ("org", "", None, "allow"), "http://xorg/": ("xorg", "/", None, "allow"),
    "http://adult.com/fr/x": ("adult.com", "/fr/x", "com/fr/", "allow"), "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
    "http://casino-win.net/a": ("casino-win.net", "/a", None, "block"), "http://freebets.net/": ("freebets.net", "/", None, "allow"),
    "http://a.net/FREE/cheap": ("a.net", "/FREE/cheap", None, "block"), "http://a.net/free/free": ("a.net", "/free/free", None, "allow"),
    "no scheme casino": ("", "", None, "block"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
    "x://h?q/p": ("h", "", None, "allow"), "x://h#/p": ("h", "", None, "allow"), "a://" + "y" * 9000 + "/p": ("y" * 9000, "/p", None, "allow"),
}


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string").withColumn("verdict", F.lit("clash"))
    for r in url_filter.judge(df).collect():
        j = r.judged
        assert (j.host, j.path, j.rule, j.verdict) == URLS[r.url], r.url
    assert url_filter.judge(df.limit(0)).count() == 0


def test_exact_dedup_moves_a_carried_text_once(spark, monkeypatch):
    """Lower-casing comes after the exchange that deals out the group numbers."""
    plans = []
    real = exact_dedup.save
    monkeypatch.setattr(exact_dedup, "save", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a))
    rows = [(1, "A text"), (2, "a Text"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "a text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == [4, 5, 6, 7]
    made = [p for p in plans if "MapInArrow" in p]
    assert made and all(p.index("MapInArrow") < p.index("SortMergeJoin") for p in made)
