"""Result values and the text of CSV cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.numbers import SAFE_INTEGER, double_text, field_type, quoted

ISO_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def has_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType))


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.StructType, T.MapType))


def shown_value(column: Column, data_type: T.DataType, long_text: bool = False) -> Column:
    """Times as ISO text, decimals as doubles, at any depth; other values as they are.

    Whole decimals of more than 15 digits are text, since no double holds them all; so are
    64-bit integers with ``long_text``.
    """
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if has_time(data_type):
        return F.date_format(column, ISO_INSTANT)
    if isinstance(data_type, T.DecimalType):
        wide = data_type.scale == 0 and data_type.precision > 15
        return column.cast("string" if wide else "double")
    if isinstance(data_type, T.LongType) and long_text:
        return column.cast("string")
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: shown_value(item, data_type.elementType, long_text))
    if isinstance(data_type, T.MapType):
        values = F.transform_values(column, lambda _, v: shown_value(v, data_type.valueType, long_text))
        return F.transform_keys(values, lambda k, _: shown_value(k, data_type.keyType, long_text))
    if isinstance(data_type, T.StructType):
        fields = [
            shown_value(column.getField(f.name), f.dataType, long_text).alias(f.name) for f in data_type
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def is_unsafe(column: Column, data_type: T.DataType) -> Column | None:
    """Whether a value holds an integer, at any depth, that no double holds exactly.

    None for types without 64-bit integers.
    """
    if isinstance(data_type, T.LongType):
        return ~column.between(-SAFE_INTEGER, SAFE_INTEGER)
    parts: list[Column | None] = []
    if isinstance(data_type, T.ArrayType):
        parts = [_any_unsafe(column, data_type.elementType)]
    elif isinstance(data_type, T.MapType):
        parts = [_any_unsafe(F.map_keys(column), data_type.keyType),
                 _any_unsafe(F.map_values(column), data_type.valueType)]
    elif isinstance(data_type, T.StructType):
        parts = [is_unsafe(column.getField(f.name), f.dataType) for f in data_type]
    held = [F.coalesce(part, F.lit(False)) for part in parts if part is not None]
    return reduce(lambda left, right: left | right, held) if held else None


def _any_unsafe(items: Column, data_type: T.DataType) -> Column | None:
    if is_unsafe(F.lit(None), data_type) is None:
        return None
    return F.exists(items, lambda item: F.coalesce(is_unsafe(item, data_type), F.lit(False)))


def result_value(frame: DataFrame, name: str, long_text: bool = False) -> Column:
    """The value of a column as results show it."""
    return shown_value(F.col(quoted(name)), field_type(frame, name), long_text)


def guard_formula(text: Column) -> Column:
    """A leading apostrophe on text that a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def cell_text(frame: DataFrame, name: str) -> Column:
    """CSV text of a value: NULL is empty, only text values get the formula guard."""
    column, data_type = F.col(quoted(name)), field_type(frame, name)
    if isinstance(data_type, T.StringType):
        text = guard_formula(column)
    elif isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        text = double_text(column)
    elif isinstance(data_type, T.LongType):
        # Integers a double cannot hold travel as text, and are guarded as text.
        plain = column.cast("string")
        text = F.when(column.between(-SAFE_INTEGER, SAFE_INTEGER), plain).otherwise(
            guard_formula(plain)
        )
    elif is_nested(data_type):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    else:
        text = result_value(frame, name).cast("string")
    return F.coalesce(text, F.lit(""))


def quote_cell(text: Column) -> Column:
    """Quotes round a cell with a comma, quote or line break."""
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\r\\n]'), doubled).otherwise(text)
