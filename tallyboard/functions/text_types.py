"""Types and instants of text values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.numbers import SAFE_INTEGER, quoted

# Text read as NULL, and the white space stripped round a value.
NULL_TEXT = ["", "null", "none", "na"]
BOOLEAN_TEXT = ["true", "false"]
UNSIGNED_NUMBER_WORDS = ["inf", "infinity", "nan"]
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# One bit per class, so that a column's type is the bit_or of its values.
BOOLEAN, INTEGER, NUMBER, DATETIME, STRING = 1, 2, 4, 8, 16
# Marks beside the class: an integer that is no 64-bit one as written, a number in
# non-ASCII digits, a date with a clock time, an integer that a double cannot hold, an
# integer of more than 38 digits.
BEYOND_LONG, OTHER_DIGITS, CLOCK, UNSAFE, BEYOND_DECIMAL = 32, 64, 128, 256, 512
_MARKS = BEYOND_LONG | OTHER_DIGITS | CLOCK | UNSAFE | BEYOND_DECIMAL
WIDE_INTEGER = "decimal(38,0)"
TYPE_BITS = {
    "boolean": BOOLEAN, "integer": INTEGER, "number": NUMBER, "date": DATETIME,
    "datetime": DATETIME | CLOCK, "string": STRING,
}
TEXT_FACTS = (
    "column_name string, rows long, bits int, min_at timestamp, max_at timestamp, "
    "values long, datetime boolean, naive boolean, invalid long"
)


def _number_patterns(digit: str) -> tuple[str, str]:
    """Patterns of integers and of other numbers, with single underscores inside."""
    digits = rf"{digit}+(?:_{digit}+)*"
    mantissa = rf"(?:{digits}(?:\.(?:{digits})?)?|\.{digits})"
    return (
        rf"^[+-]?{digits}$",
        rf"^[+-]?(?:{mantissa}(?:[eE][+-]?{digits})?|(?i:inf|infinity|nan))$",
    )


INTEGER_TEXT, NUMBER_TEXT = _number_patterns("[0-9]")
# Digits of any script count too; the slower patterns see non-ASCII text only.
ANY_INTEGER_TEXT, ANY_NUMBER_TEXT = _number_patterns(r"\p{Nd}")
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
# Shapes Spark casts by itself: an offset needs seconds before it and stays within
# 18 hours.
_PLAIN_SHAPE = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}"
    r"(?:[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?(?:Z|[+-](?:0\d|1[0-7]):?[0-5]\d)?)?)?$"
)
# Every other ISO 8601 shape: basic dates and times, week dates, any separator.
_WEEK_DATE = r"^(\d{4})-?W(\d{2})(?:-?(\d))?"
_CLOCK = r"\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?"
_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?"
_ANY_SHAPE = (
    r"^(?!0000)(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-?W\d{2}(?:-?\d)?)"
    rf"(?:.{_CLOCK}{_OFFSET})?$"
)
# Steps from those shapes to the plain one, in this order.
_TO_PLAIN = [
    (r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3"),
    (r"^(.{10}).(?=\d)", "$1T"),
    (r"^(.{11}\d{2})(\d{2})(\d{2})", "$1:$2:$3"),
    (r"^(.{11}\d{2})(\d{2})(?!\d)", "$1:$2"),
    (r"^(.{11}\d{2})(?=Z|[+-]|$)", "$1:00"),
    (r"^(.{11}\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00"),
    (r"(:\d{2}),(?=\d)", "$1."),
    (r"(\.\d{6})\d+", "$1"),
]
OFFSET_TEXT = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)$"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def _week_day(text: Column) -> Column:
    """The date of an ISO week date at the start of a text."""

    def part(group: int) -> Column:
        return F.regexp_extract(text, _WEEK_DATE, group)

    week = part(2).cast("int")
    weekday = F.coalesce(part(3).try_cast("int"), F.lit(1))
    # 4 January always lies in week one.
    week_one = F.trunc(F.make_date(part(1).cast("int"), F.lit(1), F.lit(4)), "WEEK")
    found = F.date_add(week_one, (week - 1) * 7 + weekday - 1)
    return F.when((F.weekofyear(found) == week) & weekday.between(1, 7), found)


def iso_instant(value: Column) -> Column:
    """The instant of an ISO 8601 text, offset-free text read as UTC; else NULL.

    Offsets reach 18 hours, as far as time zones can go in Spark.
    """
    return stripped_instant(strip(value))


def stripped_instant(text: Column) -> Column:
    """``iso_instant`` of a text without white space round it."""
    # The rare shapes sit in a lambda, which is not compiled into the loop over the
    # rows: inlined there, they make it too long for the JVM to optimise.
    unusual = F.element_at(F.transform(F.array(text), lambda item: _unusual_instant(item)), 1)
    return F.when(text.rlike(_PLAIN_SHAPE), text.try_cast("timestamp")).when(
        text.rlike(_ANY_SHAPE), unusual
    )


def _unusual_instant(text: Column) -> Column:
    dated = F.when(
        text.rlike(_WEEK_DATE),
        F.concat(_week_day(text).cast("string"), F.regexp_replace(text, _WEEK_DATE, "")),
    ).otherwise(text)
    for pattern, replacement in _TO_PLAIN:
        dated = F.regexp_replace(dated, pattern, replacement)
    return dated.try_cast("timestamp")


def iso_granularity(value: Column) -> Column:
    """``date`` for date-only text, ``datetime`` otherwise."""
    return F.when(strip(value).rlike(DATE_TEXT), "date").otherwise("datetime")


def iso_is_naive(value: Column) -> Column:
    """True for a date with a clock time and no offset."""
    text = strip(value)
    return ~text.rlike(DATE_TEXT) & ~text.rlike(OFFSET_TEXT)


def undated_bit(text: Column) -> Column:
    """Bit of a stripped value's class, leaving out dates: 0 for NULL text, which
    fits any type, and NULL for what may be a datetime."""
    lower = F.lower(text)
    short = text.try_cast("long")
    wide = F.replace(text, F.lit("_"), F.lit("")).try_cast(WIDE_INTEGER)
    beyond = (
        F.when(short.between(-SAFE_INTEGER, SAFE_INTEGER), INTEGER)
        .when(short.isNotNull(), INTEGER | UNSAFE)
        .when(wide.isNull(), INTEGER | BEYOND_LONG | UNSAFE | BEYOND_DECIMAL)
        .when(wide.between(-SAFE_INTEGER, SAFE_INTEGER), INTEGER | BEYOND_LONG)
        .otherwise(INTEGER | BEYOND_LONG | UNSAFE)
    )
    # Cheap looks at single characters decide which patterns are worth trying: no
    # number has a hyphen at both places of a date's, and numbers and dates start
    # with a sign, a point or a digit.
    dashed = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    ascii_only = F.octet_length(text) == F.char_length(text)
    numeric_start = F.ascii(text).between(ord("+"), ord("9"))
    number = F.when(text.rlike(INTEGER_TEXT), beyond).when(text.rlike(NUMBER_TEXT), NUMBER)
    other_script = F.when(text.rlike(ANY_INTEGER_TEXT), INTEGER | OTHER_DIGITS).when(
        text.rlike(ANY_NUMBER_TEXT), NUMBER | OTHER_DIGITS
    )
    return (
        F.when(text.isNull() | (text == ""), 0)
        .when(dashed, F.lit(None).cast("int"))
        .when(~ascii_only, other_script)
        .when(numeric_start, number)
        .when(lower.isin(NULL_TEXT), 0)
        .when(lower.isin(BOOLEAN_TEXT), BOOLEAN)
        .when(lower.isin(UNSIGNED_NUMBER_WORDS), NUMBER)
        .otherwise(STRING)
    )


def text_facts(frame: DataFrame, names: Sequence[str], times: Sequence[str] = ()) -> DataFrame:
    """One row per text column: rows, class bits, and for ``times`` the instants.

    Columns become rows before they are classified: the tests are compiled once
    and not once per column, and a value is stripped and parsed once. The facts are
    numbers, flags and times, so the partial aggregate is a hash aggregate and
    leaves one row per task and column for the shuffle.
    """
    values = F.array(*[F.col(quoted(name)) for name in names])
    is_time = F.col("column_index").isin([names.index(name) for name in times]) if times else None
    wanted = F.col("undated").isNull() if is_time is None else F.col("undated").isNull() | is_time
    text, at = F.col("text"), F.col("at")
    timed = F.lit(False) if is_time is None else is_time
    clock = F.when(text.rlike(DATE_TEXT), DATETIME).otherwise(DATETIME | CLOCK)
    dated_bit = F.when(at.isNotNull(), clock).otherwise(STRING)
    return (
        frame.select(F.posexplode(values).alias("column_index", "value"))
        .select("column_index", strip(F.col("value")).alias("text"))
        .select("column_index", "text", undated_bit(text).alias("undated"))
        .select("*", F.when(wanted, stripped_instant(text)).alias("at"))
        .select(
            "column_index", "text", "at",
            F.coalesce("undated", dated_bit).alias("bit"),
        )
        .groupBy("column_index")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.bit_or("bit").alias("bits"),
            F.min(F.when(timed, at)).alias("min_at"),
            F.max(F.when(timed, at)).alias("max_at"),
            F.count(F.when(timed & (text != ""), 1)).alias("values"),
            F.bool_or(F.when(timed & at.isNotNull(), ~text.rlike(DATE_TEXT))).alias("datetime"),
            F.bool_or(
                F.when(
                    timed & at.isNotNull(), ~text.rlike(DATE_TEXT) & ~text.rlike(OFFSET_TEXT)
                )
            ).alias("naive"),
            F.count(F.when(timed & (text != "") & at.isNull(), 1)).alias("invalid"),
        )
        .select(
            F.element_at(F.array(*[F.lit(name) for name in names]), F.col("column_index") + 1)
            .alias("column_name"),
            *["rows", "bits", "min_at", "max_at", "values", "datetime", "naive", "invalid"],
        )
    )


def type_of_bits(bits: Column) -> Column:
    """Type name for the bit_or of a column's class bits."""
    seen = F.coalesce(bits, F.lit(0)).bitwiseAND(F.lit(~_MARKS))
    return (
        F.when(seen == 0, "null")
        .when(seen == BOOLEAN, "boolean")
        .when(seen == INTEGER, "integer")
        .when(seen.isin(NUMBER, INTEGER | NUMBER), "number")
        .when(seen == DATETIME, "datetime")
        .otherwise("string")
    )


def kind_of_bits(bits: int | None) -> str:
    """``type_of_bits`` of bits that are known."""
    seen = (bits or 0) & ~_MARKS
    kinds = {0: "null", BOOLEAN: "boolean", INTEGER: "integer", DATETIME: "datetime"}
    return "number" if seen in (NUMBER, INTEGER | NUMBER) else kinds.get(seen, "string")


def typed_value(value: Column, bits: int) -> Column:
    """A text value cast to the type of its column, given the column's bits.

    Integers stay exact: beyond 64 bits they are decimals, beyond 38 digits text; a
    column that mixes numbers with integers no double can hold stays text.
    """
    text = strip(value)
    present = F.when(~F.lower(text).isin(NULL_TEXT), text)
    if bits == BOOLEAN:
        return F.lower(present).try_cast("boolean")
    if bits & ~UNSAFE == INTEGER:
        return present.try_cast("long")
    plain = F.replace(present, F.lit("_"), F.lit(""))
    if bits & ~UNSAFE == INTEGER | BEYOND_LONG:
        return plain.try_cast(WIDE_INTEGER)
    if bits and not bits & ~(INTEGER | NUMBER | BEYOND_LONG):
        return plain.try_cast("double")
    if bits == DATETIME:
        return iso_instant(present).cast("date")
    if bits == DATETIME | CLOCK:
        return iso_instant(present)
    return value
