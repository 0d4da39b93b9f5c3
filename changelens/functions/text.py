"""Column-level text helpers (all native Catalyst expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace class used for tokenising, written out so the
# DuckDB oracle (RE2) and Spark (java.util.regex) agree on it.
WS_CLASS = "[\\t\\n\\x0B\\f\\r ]"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_count(c) -> Column:
    """Newlines + 1 (the reference counts ``text.count("\\n") + 1``)."""
    c = col_of(c)
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def py_strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode blanks at both ends.

    Spark's ``trim`` only removes the space character.
    """
    return F.regexp_replace(col_of(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    """True when nothing is left after ``str.strip()`` (or the value is null)."""
    c = col_of(c)
    return c.isNull() | (F.length(F.regexp_replace(c, r"(?U)\s", "")) == 0)


def normalize_ws(c) -> Column:
    """Runs of ASCII blanks -> one space, then trimmed."""
    return F.trim(F.regexp_replace(col_of(c), WS_CLASS + "+", " "))


def word_shingles(c, k: int) -> Column:
    """All overlapping k-word shingles of a text, in order, as one array.

    One regex pass: a look-ahead captures the k words that start at each word
    boundary while the match itself consumes only one word, so the matches
    slide by one word.  Nothing is exploded and no window is needed, and the
    text is scanned inside the row (no shuffle).  Texts with fewer than k words
    give an empty array.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    # anchored at word starts and possessive: linear, whatever a word's length
    pattern = "(?<![^ ])(?=((?:[^ ]++ ){%d}[^ ]++))[^ ]++" % (k - 1)
    return F.regexp_extract_all(normalize_ws(c), F.lit(pattern), 1)


def truncate_text(c, n: int, suffix: str) -> Column:
    """First n code points + suffix when longer than n; exactly n is kept."""
    c = col_of(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)
