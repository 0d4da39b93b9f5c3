"""URL filter: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased
URL in one pass.  A hit counts only between boundaries (no letter or digit on
either side), and each term counts once.  Strict terms weigh as much as the
limit, soft terms less, so one strict or several distinct soft terms block.

Host, path and rules are native expressions; the automaton (a few dozen terms,
built once per worker) runs over the URL column alone, in Arrow batches.

Defined cases: a null URL, or one without ``://``, has empty host and path and
fits no rule; a null URL has no terms and is allowed; an empty table gives an
empty result; repeated rows are judged each.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2
# The vocabulary.  A strict term weighs LIMIT, a soft term 1.
STRICT = ("adult", "bets", "casino", "escort", "gambling", "malware", "phishing", "pills", "poker", "porn",
          "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bonus", "cheap", "clicks", "coupon", "deal", "farm", "free", "loan", "lottery", "prize", "promo",
        "popup", "seo", "track", "tracker", "win", "winner")
# Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_substr(rest, F.lit("^[^/?#]+"))
    host = F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*+(/[^?#]*+)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=4)
def _automaton(weights: tuple[tuple[str, int], ...]):
    import ahocorasick
    a = ahocorasick.Automaton()
    for term, w in weights:
        a.add_word(term, (term, w))
    a.make_automaton()
    return a


def hits(url: str, automaton) -> dict[str, int]:
    """Distinct terms of ``url`` that stand between boundaries, with weights."""
    low = "".join(c.lower() if c.isascii() else c for c in url) if not url.isascii() else url.lower()
    found = {}
    for end, (term, w) in automaton.iter(low):
        start = end - len(term)
        if not (start >= 0 and _is_word(low[start])) and not (end + 1 < len(low) and _is_word(low[end + 1])):
            found[term] = w
    return found


def _is_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def term_hits(weights: dict[str, int]):
    key = tuple(sorted(weights.items()))

    @F.pandas_udf("struct<n_terms int, weight int>")
    def run(urls: pd.Series) -> pd.DataFrame:
        a = _automaton(key)
        found = [hits(u, a) if u else {} for u in urls]
        return pd.DataFrame({"n_terms": [len(f) for f in found], "weight": [sum(f.values()) for f in found]},
                            dtype="int32")
    return run


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """``pages`` with ``judged``: host, path, rule, n_terms, weight, verdict."""
    host, path = host_and_path(F.col(url_col))
    rule, verdict = rule_of(host, path, rules)
    t = term_hits({t: 1 for t in soft} | {t: limit for t in strict})(F.col(url_col))
    own = F.when(t["weight"] >= limit, "block").otherwise("allow")
    return pages.withColumn("judged", F.struct(
        host.alias("host"), path.alias("path"), rule.alias("rule"), t["n_terms"].alias("n_terms"),
        t["weight"].alias("weight"), F.coalesce(verdict, own).alias("verdict")))


def _oracle() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    weight = " + ".join(f"{w} * regexp_matches({low}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
                        for t, w in [(t, 1) for t in SOFT] + [(t, LIMIT) for t in STRICT])
    fits = {h + p: f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p, _ in RULES}
    ranked = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits[h + p]} THEN '{h + p}'" for h, p, _ in ranked)
    verdict = " ".join(f"WHEN {fits[h + p]} THEN '{v}'" for h, p, v in ranked)
    return f"""
        WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                   FROM pages),
        h AS (SELECT page_id, {weight} AS weight,
                     translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r)
        SELECT page_id, host, path, CASE {rule} END AS rule,
               CASE {verdict} WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict FROM h"""


ORACLE = _oracle()
