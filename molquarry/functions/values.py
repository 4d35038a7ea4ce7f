"""Scalar values, word matches, entry filters and metadata as Columns. Null is what SQL makes of it unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS_VALUE, EPS_FILTER = 1e-9, 1e-8


def plus(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def times(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column, integers: bool = False) -> Column:
    """Integer by integer is cut towards 0."""
    return F.when(b != 0, (a - a % b) / b).cast("long") if integers else a / b


def power(a: Column, b: Column, integers: bool = False) -> Column:
    return F.pow(a, b).cast("long") if integers else F.pow(a, b)


def equal(a: Column, b: Column, reals: bool = False) -> Column:
    return F.abs(a - b) <= EPS_VALUE if reals else a == b


def not_equal(a: Column, b: Column, reals: bool = False) -> Column:
    return ~equal(a, b, reals)


def logical_and(*operands: Column) -> Column:
    """Read from right to left: the first false decides, and so does the first null met before it."""
    return reduce(lambda rest, c: F.when(c.isNull(), None).when(~c, False).otherwise(rest), operands, F.lit(True))


def logical_or(*operands: Column) -> Column:
    return reduce(lambda rest, c: F.when(c.isNull(), None).when(c, True).otherwise(rest), operands, F.lit(False))


def logical_xor(*operands: Column) -> Column:
    return reduce(lambda a, b: a != b, operands)


def has_word(value: Column, word: str, ignore_case: bool = True) -> Column:
    """The first occurrence of word in value stands between characters that are neither letters nor digits."""
    v, w = (F.lower(value), word.lower()) if ignore_case else (value, word)
    at = F.instr(v, w)
    free = lambda c: ~c.rlike(r"^[\p{L}\p{Nd}]$")
    before = F.when(at > 1, free(F.substring(value, at - 1, F.lit(1)))).otherwise(True)
    after = free(F.substring(value, at + len(w), F.lit(1)))
    return (at > 0) & before & after


def _in_some(values: Column, word: str, ignore_case: bool) -> Column:
    return F.exists(values, lambda v: has_word(v, word, ignore_case))


def has_all(values: Column, *words: str, ignore_case: bool = True) -> Column:
    return reduce(lambda a, b: a & b, [_in_some(values, w, ignore_case) for w in words], F.lit(True))


def has_any(values: Column, *words: str, ignore_case: bool = True) -> Column:
    """True if any of the words is found (not only the first)."""
    return reduce(lambda a, b: a | b, [_in_some(values, w, ignore_case) for w in words], F.lit(False))


def year_of(date: Column) -> Column:
    """Year of a date of an entry (release, latest revision); null without one, also for a text that is no date."""
    return F.year(F.try_to_timestamp(date.cast("string")).cast("date"))


def text_less(a: Column, b: Column, equal: bool = False) -> Column:
    """Order of texts by code points, whatever the locale."""
    x, y = a.cast("string").cast("binary"), b.cast("string").cast("binary")
    return x <= y if equal else x < y


def listed(values: Column) -> Column:
    return F.array_join(values, "; ")


# filters of entries: null is false

_COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def int_filter(column: Column, op: str, value: int) -> Column:
    return _sure(_COMPARE[op](column, F.lit(value)))


def double_filter(column: Column, op: str, value: float) -> Column:
    """Equality, also inside <= and >=, is within 1e-8."""
    near = F.abs(column - F.lit(value)) < EPS_FILTER
    strict = {"<": column < value, ">": column > value}
    return _sure({"=": near, "<": strict["<"], ">": strict[">"], "<=": strict["<"] | near, ">=": strict[">"] | near}[op])


def date_filter(column: Column, op: str, value: str) -> Column:
    """value as yyyy-M-d; what is no date makes every row false."""
    return _sure(_COMPARE[op](column.cast("date"), F.try_to_timestamp(F.lit(value), F.lit("yyyy-M-d")).cast("date")))


def is_value(values: Column, value: str) -> Column:
    return _sure(F.array_contains(F.transform(values, F.lower), value.lower()))


def contains_word(values: Column, word: str) -> Column:
    return _sure(F.exists(values, lambda v: has_word(v, word)))


def matches(values: Column, regex: str) -> Column:
    return _sure(F.exists(values, lambda v: v.rlike(f"(?i){regex}")))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def one_of(*conditions: Column) -> Column:
    """Exclusive or, folded from the left."""
    return reduce(lambda a, b: a != b, conditions)


def none_of(*conditions: Column) -> Column:
    return ~any_of(*conditions)
