"""Column forms of the dialect's few non-ANSI semantics; all of them are native expressions.

Integers are 32 bits wide and wrap; the average of integers is cut to an
integer; sums, averages, minima and maxima of strings are those of their lengths
in bytes; an integer counts as true when it is not zero; a comparison has the
value 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(x: Column) -> Column:
    """A whole number as 32 bits, wrapped."""
    return (F.pmod(x.cast("bigint") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def add32(a: Column, b: Column) -> Column:
    return wrap32(a.cast("bigint") + b.cast("bigint"))


def sub32(a: Column, b: Column) -> Column:
    return wrap32(a.cast("bigint") - b.cast("bigint"))


def sum32(x: Column) -> Column:
    return wrap32(F.sum(x.cast("bigint")))


def avg_cut(x: Column) -> Column:
    """The average without its fraction, cut towards zero."""
    total, n = F.sum(x.cast("bigint")), F.count(x)
    return wrap32((total - F.sign(total).cast("bigint") * F.pmod(F.abs(total), n)) / n)


def bytes_of(x: Column) -> Column:
    return F.octet_length(x)


def truth(x: Column) -> Column:
    return x != 0


def as_number(condition: Column) -> Column:
    return condition.cast("int")


def joined(*parts: Column) -> Column:
    return F.concat(*parts)
