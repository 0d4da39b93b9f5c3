"""Personal data by weak supervision.

The base patterns give spans that always stay.  Looser patterns give more
candidates: base matches that failed their check, spelled-out mail addresses,
telephone numbers without a plus, and, apart from any base pattern, secrets
(long runs that mix letters and digits), IBANs and IPv6 addresses.  On every
candidate, base or not, labelers vote yes (1), no (0) or abstain: two read the
format, one looks the value up in ``Gazetteers`` (a parameter), one reads the
words before it, one the characters around it.

Expectation-maximisation over the counts of vote patterns estimates, per kind,
how reliable each labeler is; its posteriors train a logistic span classifier
on the votes and coarse features of the span and its place, and candidates it rates at or above
the threshold become added spans.  A vote pattern is a short code, so the
corpus reaches the driver as counts per (kind, code): at most a few thousand
rows, whatever its size.  Texts stay in the scan tasks.

Defined cases: null text is empty and gives no spans; very long texts are
scanned whole, n candidates in n log n steps; repeated rows are scanned each;
of candidates that overlap the first of its list stays; null ids and ids that
repeat are rows like any other; other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import ipaddress
import math
import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban")
THRESHOLD = 0.9
ROUNDS = 40
CONTEXT = 32                 # code points read before a candidate
PRIOR = 0.3                  # share of true candidates before any count
RIGHT, WRONG = 8.0, 2.0      # pseudo-counts of a labeler's votes


class Gazetteers(NamedTuple):
    """What labelers look up.  Words are alternatives of a regular expression."""
    tlds: frozenset = frozenset("com net org edu gov info io co de fr es uk it nl eu us ch at be".split())
    country_codes: tuple = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47",
                            "48", "49", "52", "55", "61", "81", "82", "86", "91")
    card_starts: tuple = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
    secret_starts: tuple = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_",
                            "rk_live_", "eyJ")
    iban_lengths: tuple = (("AT", 20), ("BE", 16), ("CH", 21), ("DE", 22), ("DK", 18), ("ES", 24), ("FR", 27), ("GB", 22),
                           ("IE", 22), ("IT", 27), ("LU", 20), ("NL", 18), ("NO", 15), ("PL", 28), ("PT", 25), ("SE", 24))
    words_for: tuple = (
        "mail|e-mail|email|contact|write|correo|courriel|kontakt",
        "ip|ipv6|server|host|address|network|dirección|adresse",
        "card|visa|mastercard|credit|carte|tarjeta|karte|kreditkarte",
        "phone|tel|telephone|call|mobile|fax|téléphone|teléfono|telefon|ruf",
        "token|secret|password|passwd|pwd|key|apikey|api_key|access_key|auth|bearer|credential|passwort|contraseña",
        "iban|account|konto|compte|cuenta|rekening")
    words_against: str = ("version|release|isbn|issn|order|invoice|serial|article|section|page|id|no|build|ref|"
                          "commit|checksum|digest|hash|md5|sha1|sha256|uuid")


GAZETTEERS = Gazetteers()


@lru_cache(maxsize=16)
def _before(words: str) -> re.Pattern:
    return re.compile(rf"\b(?:{words})\b\W*$", re.I)


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?:\x20?\[at\]\x20?|\x20?\(at\)\x20?)[A-Za-z0-9-]+"
                      r"(?:(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z0-9-]+)+")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")
_DIGITS = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_SWITCH = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Matches of local part + ``pattern``, leftmost and non-overlapping: a local
    part is the whole run before the sign, cut at the match before it."""
    out, free = [], 0
    at = pattern.search(text)
    while at:
        start = at.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at.start():
            free = at.end()
            out.append((start, free))
        # a domain without a local part may hold the next one
        at = pattern.search(text, at.end() if out and out[-1][1] == at.end() else at.start() + 1)
    return out


def base_and_failed(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (kind number, start, end) of the base patterns that pass and that fail."""
    good, bad = [], []
    if "@" in text:
        good += [(0, s, e) for s, e in _emails(text, _DOMAIN)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            ok = all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
            (good if ok else bad).append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m[0])
                if len(d) >= 12:
                    (good if 16 <= len(d) <= 19 and luhn(d) else bad).append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 8 <= len(_digits(m[0])) <= 15 else bad).append((3, *m.span()))
    return good, bad


def _own(text: str) -> list[tuple[int, int, int]]:
    """Candidates of kinds that have no base pattern."""
    if not _DIGITS.search(text):
        return []
    out = [(5, *m.span()) for m in _IBAN.finditer(text)]
    out += [(4, *m.span()) for m in _RUN.finditer(text) if _SWITCH.search(m[0])]
    if ":" in text:
        out += [(1, *m.span()) for m in _IPV6.finditer(text) if "::" in m[0] or m[0].count(":") == 7]
    return out


def _loose(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "at]" in text or "at)" in text:
        out += [(0, s, e) for s, e in _emails(text, _SPELLED)]
    if _DIGITS.search(text):
        out += [(3, *m.span()) for m in _NATIONAL.finditer(text)]
    return out


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _ipv6(value: str):
    try:
        return ipaddress.IPv6Address(value)
    except ValueError:
        return None


def votes(text: str, kind: int, start: int, end: int, passed: bool, gaz: Gazetteers = GAZETTEERS) -> str:
    """The labelers' votes on one candidate and its features, as a code of digits
    (0 no, 1 yes, 2 abstain; then features 0 or 1)."""
    value, base = text[start:end], int(passed)
    before = text[max(0, start - CONTEXT):start]
    d = _digits(value)
    if kind == 0:
        form = 1 if value.count("@") == 1 and ".." not in value and value[0] not in ".-" else 2
        tld = re.split(r"[^A-Za-z0-9]+", value)[-1].lower()
        known = 1 if tld in gaz.tlds else 0 if tld.isdigit() else 2
    elif kind == 1 and ":" in value:
        six, base = _ipv6(value), 2
        form = 1 if six else 0
        known = 0 if not six or six.is_loopback or six.is_unspecified else 1 if six.is_global else 2
    elif kind == 1:
        form = 1 if passed and not re.search(r"(?:^|\.)0[0-9]", value) else 0
        first = int(value.split(".")[0].lstrip("0")[:4] or 0)
        known = 0 if first in (0, 127) or first > 255 else 1 if first < 240 else 2
    elif kind == 2:
        form = 1 if luhn(d) and 13 <= len(d) <= 19 else 0
        known = 1 if d.startswith(gaz.card_starts) else 0 if d[0] in "01789" else 2
    elif kind == 3:
        form = 1 if 8 <= len(d) <= 15 else 0
        known = 1 if d.startswith(gaz.country_codes) and value[0] == "+" else 2
    elif kind == 4:
        # no base pattern could have passed: that labeler abstains
        switches, base = len(_SWITCH.findall(value)), 2
        form = 1 if switches >= 4 and len(set(value)) >= 8 else 0 if switches < 2 else 2
        known = 1 if value.startswith(gaz.secret_starts) else 2
    else:
        base, length = 2, dict(gaz.iban_lengths).get(value[:2])
        form = 1 if _iban(value) else 0
        known = 2 if length is None else int(length == len(value.replace(" ", "")))
    context = 1 if _before(gaz.words_for[kind]).search(before) else 0 if _before(gaz.words_against).search(before) else 2
    left, right = text[start - 1:start] if start else " ", text[end:end + 1] or " "
    around = 0 if left.isalnum() or right.isalnum() or (left + right).strip(" \t\r\n.,;:!?()[]<>\"'|*$%&#=") else 1
    grouped = int(any(not ("0" <= c <= "9") for c in value))
    assigned = int(before.rstrip(" \t\"'")[-1:] in ("=", ":"))
    quoted = int(left in "\"'`" and right == left)
    return "".join(map(str, (base, form, known, context, around, grouped, int(len(value) > 16), assigned, quoted)))


N_LABELERS = 5               # leading digits of a code that are votes


class _Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, start: int, end: int) -> bool:
        """Take a span that overlaps none; whether it was free."""
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def candidates(text: str, gaz: Gazetteers = GAZETTEERS) -> list[tuple[int, int, int, bool, str]]:
    """(kind number, start, end, base, code) of a text, by kind and start."""
    good, bad = base_and_failed(text)
    spans = [(k, s, e, True, votes(text, k, s, e, True, gaz)) for k, s, e in good]
    taken = _Taken((s, e) for _, s, e in good)
    for k, s, e in _own(text) + bad + _loose(text):
        if taken.add(s, e):
            spans.append((k, s, e, False, votes(text, k, s, e, False, gaz)))
    return sorted(spans)


def _scan(gaz: Gazetteers):
    def run(batches):
        for b in batches:
            one = [[{"kind": k, "start": s, "end": e, "base": base, "code": c}
                    for k, s, e, base, c in candidates(text.as_py() or "", gaz)] for text in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(one, _SPANS)], names=["doc_id", "found"])
    return run


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
                             ("code", pa.string())]))
_SCAN = "doc_id {id}, found array<struct<kind int, start bigint, end bigint, base boolean, code string>>"


def em(patterns: dict[str, int]) -> dict[str, float]:
    """Posterior of each vote pattern (leading digits of a code) with counts."""
    share, right = PRIOR, [(RIGHT / (RIGHT + WRONG),) * 2] * N_LABELERS
    post: dict[str, float] = {}
    for _ in range(ROUNDS):
        sums = [[RIGHT, RIGHT + WRONG, RIGHT, RIGHT + WRONG] for _ in range(N_LABELERS)]
        yes, total = 10 * PRIOR, 10.0
        for code, n in sorted(patterns.items()):
            odds = math.log(share / (1 - share))
            for v, (a, b) in zip(code, right):
                if v == "1":
                    odds += math.log(a / (1 - b))
                elif v == "0":
                    odds += math.log((1 - a) / b)
            q = post[code] = 1 / (1 + math.exp(-odds))
            yes, total = yes + n * q, total + n
            for v, s in zip(code, sums):
                if v != "2":
                    s[0] += n * q * (v == "1")
                    s[1] += n * q
                    s[2] += n * (1 - q) * (v == "0")
                    s[3] += n * (1 - q)
        right = [(min(max(a / b, 0.55), 0.98), min(max(c / d, 0.55), 0.98)) for a, b, c, d in sums]
        share = min(max(yes / total, 0.02), 0.98)
    return post


def _features(kind: int, code: str) -> list[float]:
    x = [1.0] + [float(k == kind) for k in range(len(KINDS))]
    for v in code[:N_LABELERS]:
        x += [float(v == "1"), float(v == "0")]
    return x + [float(v) for v in code[N_LABELERS:]]


def accepted(counts: dict[tuple[int, str], int]) -> set[tuple[int, str]]:
    """The (kind, code) pairs the trained classifier takes as personal data."""
    if not counts:
        return set()
    target = {}
    for k in range(len(KINDS)):
        own: dict[str, int] = {}
        for (kind, code), n in counts.items():
            if kind == k:
                own[code[:N_LABELERS]] = own.get(code[:N_LABELERS], 0) + n
        post = em(own)
        target |= {(kind, code): post[code[:N_LABELERS]] for kind, code in counts if kind == k}
    keys = sorted(counts)
    x = np.array([_features(k, c) for k, c in keys])
    y = np.array([target[k] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    n = np.sqrt(n) / np.sqrt(n).sum()
    w = np.zeros(x.shape[1])
    for _ in range(500):             # Newton-free, deterministic: fixed steps on a convex loss
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (n * (p - y)) + 1e-3 * w)
    p = 1 / (1 + np.exp(-x @ w))
    return {k for k, q in zip(keys, p) if q >= THRESHOLD}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gazetteers: Gazetteers = GAZETTEERS) -> DataFrame:
    """One row per document: doc_id, found (all candidates, each with kind,
    start, end, base, code) and spans (those that are personal data)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    table = save(rows.mapInArrow(_scan(gazetteers), _SCAN.format(id=rows.schema["doc_id"].dataType.simpleString())))
    per = table.select(F.explode("found").alias("s")).groupBy("s.kind", "s.code").agg(F.count(F.lit(1)).alias("n"))
    ok = accepted({(r["kind"], r["code"]): r["n"] for r in per.collect()})
    ok = F.array(*[F.lit(f"{k}:{c}") for k, c in sorted(ok)]).cast("array<string>")

    def is_private(s):
        return s["base"] | F.array_contains(ok, F.concat(s["kind"].cast("string"), F.lit(":"), s["code"]))

    return table.withColumn("spans", F.filter("found", is_private))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans (sorted by kind and start), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])

    def of_kind(i):
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")

    kinds = [of_kind(i).alias(f"n_{name}") for i, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *kinds, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
                        F.size("spans").cast("long").alias("n_spans"))
