"""Display text of values, fixed to en-US."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.numbers import DECIMAL_TEXT, field_type, finite, is_number, quoted

MISSING = "—"
# En-US currency marks and the currencies without decimals.
SYMBOLS = {
    "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹",
    "CNY": "CN¥", "KRW": "₩", "BRL": "R$", "CAD": "CA$", "AUD": "A$",
    "MXN": "MX$", "NZD": "NZ$", "HKD": "HK$", "ILS": "₪", "TWD": "NT$",
    "VND": "₫", "PHP": "₱",
}
NO_DECIMALS = ["JPY", "KRW", "VND", "CLP", "ISK", "XAF", "XOF", "PYG", "UGX"]
STEPS = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]


@dataclass(frozen=True)
class ValueFormat:
    format: str = "number"
    currency: str = "USD"
    notation: str = "standard"

    @property
    def coerces_text(self) -> bool:
        """Whether text that reads as a number is shown as one."""
        return self.format != "number" or self.notation == "compact"


def _grouped(size: Column, least: int, most: int) -> Column:
    """Thousands separators, ``least`` to ``most`` decimals, halves away from zero."""
    pattern = "#,##0" + ("." + "0" * least + "#" * (most - least) if most else "")
    # format_number rounds halves to even, so the value is rounded before.
    return F.call_function("format_number", F.round(size, most), F.lit(pattern))


def _compact(size: Column) -> Column:
    """One decimal at most, with K, M, B or T."""
    result = _grouped(size, 0, 1)
    for unit, letter in reversed(STEPS):
        scaled = F.round(size / unit, 1)
        # Grouping starts at five digits: 1000T, 10,000T.
        digits = F.when(
            scaled < 10000, F.regexp_replace(_grouped(scaled, 0, 1), ",", "")
        ).otherwise(_grouped(scaled, 0, 1))
        lower = unit / 1000
        reached = F.round(size / lower, 1) >= 1000
        result = F.when(reached, F.concat(digits, F.lit(letter))).otherwise(result)
    return result


def format_number(value: Column, style: ValueFormat = ValueFormat(), signed: bool = False) -> Column:
    """Text of a finite double column; NULL stays NULL."""
    number = value.cast("double")
    size = F.abs(number)
    prefix = F.lit("")
    suffix = F.lit("")
    if style.format == "percent":
        size, suffix = F.round(size * 100, 10), F.lit("%")
    if style.notation == "compact":
        body = _compact(size)
    elif style.format == "currency":
        decimals = 0 if style.currency in NO_DECIMALS else 2
        body = _grouped(size, decimals, decimals)
    else:
        body = _grouped(size, 0, 1 if style.format == "percent" else 3)
    if style.format == "currency":
        prefix = F.lit(SYMBOLS.get(style.currency, style.currency + "\u00a0"))
    negative = F.lit("-")
    sign = F.when(number < 0, negative).otherwise(F.lit("+") if signed else F.lit(""))
    return F.concat(sign, prefix, body, suffix)


def format_signed_percent(value: Column) -> Column:
    """A fraction as percent with sign and exactly one decimal."""
    number = value.cast("double")
    body = _grouped(F.round(F.abs(number) * 100, 10), 1, 1)
    return F.concat(F.when(number < 0, "-").otherwise("+"), body, F.lit("%"))


def format_value(frame: DataFrame, name: str, style: ValueFormat = ValueFormat()) -> Column:
    """Display text of column ``name``; NULL is a dash, other non-numbers are text."""
    column = F.col(quoted(name))
    data_type = field_type(frame, name)
    text = column.cast("string")
    number = None
    if is_number(data_type):
        number = finite(column)
    elif style.coerces_text and isinstance(data_type, T.StringType):
        trimmed = F.trim(column)
        number = F.when(trimmed == "", F.lit(0.0)).when(
            trimmed.rlike(DECIMAL_TEXT), finite(trimmed.try_cast("double"))
        )
    elif style.coerces_text and isinstance(data_type, T.BooleanType):
        number = column.cast("double")
    shown = text if number is None else F.coalesce(format_number(number, style), text)
    return F.coalesce(shown, F.lit(MISSING))
