"""Numbers from what a table holds: text, integers, doubles with NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number in text; a plain cast would also take forms such as 1.5d.
NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"
#: Texts that stand for a missing value in CSV files, as pandas documents them.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def no_nan(c: Column) -> Column:
    """c (a double) with NaN as null; NaN would otherwise count as the largest value."""
    return F.nanvl(c, F.lit(None).cast("double"))  # evaluates c once


def is_number(text: Column) -> Column:
    return F.rlike(text, F.lit(NUMBER))


def to_number(c: Column, kind: T.DataType) -> Column:
    """c as a double; null where it is missing, NaN or not a number."""
    if isinstance(kind, T.StringType):
        return no_nan(F.when(is_number(c), F.trim(c).try_cast("double")))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return no_nan(c.cast("double"))
    return F.lit(None).cast("double")


def finite(c: Column) -> Column:
    return F.abs(c) < F.lit(float("inf"))
