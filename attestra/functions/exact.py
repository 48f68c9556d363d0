"""Column helpers whose results agree bit for bit with IEEE arithmetic and Unicode-aware text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round4(v: Column) -> Column:
    """Round half to even at four decimals of the exact binary value, by splitting the product exactly."""
    hi = (F.lit(134217729.0) * v) - ((F.lit(134217729.0) * v) - v)
    r = F.floor(v * F.lit(1e4)).cast("double")
    s = (hi * F.lit(20000.0) - (F.lit(2.0) * r + F.lit(1.0))) + (v - hi) * F.lit(20000.0)
    up = (s > 0) | ((s == 0) & (r % 2 == 1))
    return (r + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / F.lit(1e4)


ROUND4_SQL = (
    "(floor(({v}) * 1e4) + case when (((134217729.0::double * ({v})) - ((134217729.0::double * ({v})) - ({v}))) * 20000 - (2 * floor(({v}) * 1e4) + 1))"
    " + (({v}) - ((134217729.0::double * ({v})) - ((134217729.0::double * ({v})) - ({v})))) * 20000 > 0 then 1 else 0 end) / 1e4"
)


def py_trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def noisy_or(strengths: Column) -> Column:
    """``1 - prod(1 - s)`` over an array in its order, rounded; 0 for an empty one."""
    return round4(F.lit(1.0) - F.aggregate(strengths, F.lit(1.0), lambda p, s: p * (F.lit(1.0) - s)))


def ordered_mean4(values: Column) -> Column:
    """Left-to-right sum over the count, rounded; 0 for an empty array."""
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(
        round4(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    )


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short strings."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    return let(chars(b), lambda bs: F.element_at(
        F.aggregate(
            chars(a), F.array_repeat(F.lit(0), F.size(bs) + 1),
            lambda row, ch: F.aggregate(
                F.sequence(F.lit(0), F.size(bs) - 1), F.array(F.lit(0)),
                lambda new, j: F.concat(new, F.array(
                    F.when(F.get(bs, j) == ch, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.element_at(new, -1)))
                )),
            ),
        ), -1))


def similarity(a: Column, b: Column, percent: int = 88) -> Column:
    """Twice the common subsequence in percent of both lengths together; 0 where the lengths alone rule out ``percent``."""
    total = F.length(a) + F.length(b)
    enough = (200 * F.least(F.length(a), F.length(b)) >= percent * total) & (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(total == 0, F.lit(100.0)).when(enough, 200.0 * lcs_length(a, b) / total).otherwise(F.lit(0.0))


def similar(a: Column, b: Column, percent: int = 88) -> Column:
    return similarity(a, b, percent) >= percent


def title_case(x: Column) -> Column:
    """Each letter upper case unless a letter stands before it."""
    return F.array_join(F.transform(F.split(x, r"(?<!\p{L})(?=\p{L})|(?<=\p{L})(?!\p{L})"), F.initcap), "")


def all_lower(x: Column) -> Column:
    return x.rlike(r"\p{Ll}") & ~x.rlike(r"[\p{Lu}\p{Lt}]")
