"""Typed access to loosely typed columns: NaN and unparsable input become NULL once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86400e6


class Fields:
    """Reads a table's columns as numbers, timestamps or text, whatever their stored type."""

    def __init__(self, df: DataFrame):
        self._types = {f.name: f.dataType for f in df.schema.fields}

    def has(self, *names: str) -> bool:
        return all(n in self._types for n in names)

    def number(self, name: str) -> Column:
        kind, col = self._types[name], F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.nanvl(col.cast("double"), F.lit(None).cast("double"))
        if isinstance(kind, T.NumericType):
            return col.cast("double")
        return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))

    def stamp(self, name: str) -> Column:
        kind, col = self._types[name], F.col(name)
        if isinstance(kind, T.TimestampType):
            return col
        if isinstance(kind, (T.TimestampNTZType, T.DateType)):
            return col.cast("timestamp")
        return F.try_to_timestamp(col.cast("string"))

    def text(self, name: str) -> Column:
        return F.col(name).cast("string")

    def category(self, name: str) -> Column:
        """Text form of a category in which 1, 1.0 and '1' are one value."""
        if isinstance(self._types[name], (T.DoubleType, T.FloatType)):
            whole = F.col(name).cast("bigint").cast("string")
            return F.when(F.col(name) == F.floor(F.col(name)), whole).otherwise(self.text(name))
        return self.text(name)


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(MICROS_PER_DAY)


def quantised(col: Column, digits: int = 6) -> Column:
    """Nearest multiple of 10^-digits, halves upward; plain arithmetic, stays in codegen."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def rounded(col: Column, digits: int) -> Column:
    return F.round(col, digits)
