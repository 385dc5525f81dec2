"""Numbers read from columns of any type, and their machine-readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMAL_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# Largest integer a double holds exactly.
SAFE_INTEGER = 2**53 - 1


def quoted(name: str) -> str:
    """A column name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def field_type(frame: DataFrame, name: str) -> T.DataType:
    return frame.schema[name].dataType


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def finite(value: Column) -> Column:
    """A double without NaN and infinities; those become NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def numeric(frame: DataFrame, name: str) -> Column:
    """Column ``name`` as a finite double; blank, non-numeric and non-finite are NULL."""
    data_type = field_type(frame, name)
    column = F.col(quoted(name))
    if is_number(data_type) or isinstance(data_type, T.BooleanType):
        return finite(column)
    if isinstance(data_type, T.StringType):
        text = F.trim(column)
        return finite(F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double")))
    return F.lit(None).cast("double")


def is_blank(frame: DataFrame, name: str) -> Column:
    """NULL or, for text, only spaces."""
    column = F.col(quoted(name))
    if isinstance(field_type(frame, name), T.StringType):
        return column.isNull() | (F.trim(column) == F.lit(""))
    return column.isNull()


def double_text(value: Column) -> Column:
    """Shortest text of a double without exponent between 1e-6 and 1e21: 5, 0.1, 1e+21."""
    number = value.cast("double")
    size = F.abs(number)
    text = number.cast("string")
    plain = F.regexp_replace(text, r"\.0$", "")
    large = F.regexp_replace(number.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(number.try_cast("decimal(38,23)").cast("string"), r"0+$", "")
    exponent = F.regexp_replace(
        F.regexp_replace(text, r"\.0E", "E"), r"E(-?)(\d+)$", "e$1$2"
    )
    signed = F.regexp_replace(exponent, r"e(\d)", r"e+$1")
    return (
        F.when(F.isnan(number), F.lit("NaN"))
        .when(size == F.lit(float("inf")), F.when(number > 0, "Infinity").otherwise("-Infinity"))
        .when(number == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), plain)
        .when((size >= 1e7) & (size < 1e21), large)
        .when((size >= 1e-6) & (size < 1e-3), small)
        .otherwise(signed)
    )
