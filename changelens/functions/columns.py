"""Column helpers that shape how Catalyst evaluates expensive expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns whose expressions must run exactly once per row.

    Filters that Catalyst infers later (``explode`` adds ``size(x) > 0``,
    joins add ``isnotnull``) are pushed through projections by substituting
    the expression, so an expensive expression (a regex over a whole text)
    would run twice - once in the pushed filter and once in the projection.
    Values produced by a generator cannot be substituted, so the new columns
    come out of a one-element ``inline``; the pushed filters stop above it.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(packed))


def bitmap_of(keys: list[int], m_bits: int) -> bytes:
    """A one-hash bit set over ``pmod(key, m_bits)`` (driver side, bounded
    by ``m_bits / 8`` bytes whatever the number of keys)."""
    bits = bytearray(m_bits // 8)
    for k in keys:
        p = k % m_bits          # Python's % is non-negative, like pmod
        bits[p >> 3] |= 1 << (p & 7)
    return bytes(bits)


def bitmap_contains(bitmap: bytes, key: Column, m_bits: int) -> Column:
    """Membership test of a long column in ``bitmap_of`` (false positives
    possible, no false negatives), as native expressions on one binary
    literal: byte = substring(bits, p div 8 + 1, 1), bit = byte >> (p % 8) & 1."""
    p = F.pmod(key, F.lit(m_bits).cast("long"))
    byte = F.substring(F.lit(bitmap), (p / 8).cast("int") + 1, F.lit(1))
    val = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("shiftright", val, (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def rounded_ratio(part: Column, whole: Column, places: int = 2) -> Column:
    """``round(part / whole, places)`` of Python, for whole numbers 0 <= part <= whole.

    Python rounds the exact value of the binary quotient, to even where it lies
    half-way.  Away from half-way whole-number arithmetic decides; the half-way
    quotients are (2q + 1) / (2 * 10^places), whose rounded values form a table
    built with Python's own ``round``.
    """
    unit = 10 ** places
    twice = part.cast("long") * F.lit(2 * unit)
    whole = whole.cast("long")
    down = F.call_function("div", part.cast("long") * F.lit(unit), whole)
    halves = F.array(*[F.lit(round((2 * q + 1) / (2 * unit), places)) for q in range(unit)])
    is_half = twice == whole * (2 * down + 1)
    up = (twice > whole * (2 * down + 1)).cast("long")
    return F.when(is_half, F.element_at(halves, (down + 1).cast("int"))).otherwise((down + up) / F.lit(float(unit)))
