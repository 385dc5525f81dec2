from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.functions.csv_text import cell_text, guard_formula, quote_cell
from tallyboard.functions.formatting import (
    ValueFormat, format_number, format_signed_percent, format_value,
)
from tallyboard.functions.numbers import double_text, numeric
from tallyboard.functions.text_types import iso_granularity, iso_instant, iso_is_naive
from tallyboard.operators.profile import infer_text_types


@pytest.mark.parametrize(
    "texts, expected",
    [
        (["", " NA ", "None", "null", None], "null"),
        (["true", "FALSE", "na"], "boolean"),
        (["1", "-2", "+3", " 4 ", "1_000", "", "99999999999999999999"], "integer"),
        (["1", "2.5"], "number"),
        (["1e5", ".5", "5.", "inf", "NaN", "1_0.5"], "number"),
        (["2026-06-29T13:10:00Z", "2026-06-29", "2026-06-29 10:00"], "datetime"),
        (["20260701T101500", "2026-W27-3", "2026-07-01X10"], "datetime"),
        (["2026-13-01"], "string"),
        (["2026-06"], "string"),
        (["20260701", "3"], "integer"),
        (["true", "1"], "string"),
        (["2026-06-29", "1"], "string"),
        (["1d"], "string"),
        (["_1"], "string"),
        (["0x10"], "string"),
        (["2026-W54-1"], "string"),
        (["２０", "1２"], "integer"),
        (["-inf", "+NaN", "Infinity"], "number"),
        (["123e-00005"], "number"),
        (["2026-07-01\u300010:30"], "datetime"),
        (["été", "x"], "string"),
        (["nano"], "string"),
    ],
)
def test_inferred_types(frame, texts, expected):
    rows = frame([(text, "x") for text in texts], "c string, other string")
    assert sorted(values(infer_text_types(rows))) == [("c", expected), ("other", "string")]


ISO_SHAPES = [
    "2026-07-01", "2026-07-01T10", "2026-07-01T10:30", "2026-07-01 10:30:05",
    "2026-07-01T10:30:05.1", "2026-07-01T10:30:05.123456789", "2026-07-01T10:30:05Z",
    "2026-07-01T10:30:05+02:00", "2026-07-01T10:30:05-0530", "2026-07-01T10:30:05+02",
    "2026-07-01T10:30:05,5", "20260701T103005Z", "20260701T1030", "2026-07-01T1030+0100",
    "2026-07-01_10:30", "2026-W27-3", "2026W273", "2026-W01", "2020-W53-7T01:02:03",
    "2026-W27-3T10:30Z", "  2026-07-01T10:30:05Z ", "20260701", "2024-02-29", "0001-01-01",
]
NOT_ISO = [
    "2026-02-30", "2026-07-01T24:30", "2026-07-01T10:60", "2026-7-1", "2026-07", "07/01/2026",
    "2026-07-01T", "2026-W54", "2026-W27-8", "now", "2026-07-01T10:30:61", "2021-W53",
]


def test_iso_shapes_against_the_standard_library(frame):
    rows = frame([(text,) for text in ISO_SHAPES], "t string")
    found = rows.select("t", F.unix_micros(iso_instant(F.col("t"))).alias("us")).collect()
    for row in found:
        want = datetime.fromisoformat(row.t.strip())
        if want.tzinfo is None:
            want = want.replace(tzinfo=timezone.utc)
        delta = want - datetime(1970, 1, 1, tzinfo=timezone.utc)
        micros = (delta.days * 86400 + delta.seconds) * 10**6 + delta.microseconds
        assert row.us == micros, row.t


def test_texts_that_are_no_instants(frame):
    for text in NOT_ISO:
        with pytest.raises(ValueError):
            datetime.fromisoformat(text)
    rows = frame([(text,) for text in NOT_ISO], "t string")
    assert rows.where(iso_instant(F.col("t")).isNotNull()).collect() == []


def test_granularity_and_naive_flag(frame):
    rows = frame(
        [("2026-07-01",), ("2026-07-01 10:00:00",), ("2026-07-01T10:00Z",), ("2026-07-01T10:00-03",)],
        "t string",
    )
    found = rows.select(iso_granularity(F.col("t")), iso_is_naive(F.col("t")))
    assert [tuple(r) for r in found.collect()] == [
        ("date", False), ("datetime", True), ("datetime", False), ("datetime", False)
    ]


def test_numeric_reads_numbers_only(frame):
    rows = frame([(t,) for t in ["12", " 1e3 ", "", None, "x", "1d", "NaN", "-.5"]], "t string")
    assert values(rows.select(numeric(rows, "t").alias("n"))) == [
        (12.0,), (1000.0,), (None,), (None,), (None,), (None,), (None,), (-0.5,)
    ]


@pytest.mark.parametrize(
    "number, style, text",
    [
        (1234.5678, {}, "1,234.568"), (0.0005, {}, "0.001"), (-1.5, {}, "-1.5"), (12.0, {}, "12"),
        (2.5, {"format": "currency"}, "$2.50"), (-1234.5, {"format": "currency"}, "-$1,234.50"),
        (99.5, {"format": "currency", "currency": "JPY"}, "¥100"),
        (10.0, {"format": "currency", "currency": "RUB"}, "RUB\u00a010.00"),
        (0.425, {"format": "percent"}, "42.5%"), (0.07, {"format": "percent"}, "7%"),
        (12.0, {"format": "percent"}, "1,200%"),
        (15123123.0, {"notation": "compact"}, "15.1M"), (999.94, {"notation": "compact"}, "999.9"),
        (999.95, {"notation": "compact"}, "1K"), (999950.0, {"notation": "compact"}, "1M"),
        (999949.0, {"notation": "compact"}, "999.9K"), (1500.0, {"notation": "compact"}, "1.5K"),
        (2.5e9, {"notation": "compact"}, "2.5B"), (1.2e15, {"notation": "compact"}, "1200T"),
        (1e16, {"notation": "compact"}, "10,000T"), (0.0, {"notation": "compact"}, "0"),
        (1500.0, {"format": "currency", "notation": "compact"}, "$1.5K"),
        (-0.25, {"format": "percent", "notation": "compact"}, "-25%"),
    ],
)
def test_number_format(frame, number, style, text):
    rows = frame([(number,)], "v double")
    assert rows.select(format_value(rows, "v", ValueFormat(**style))).first()[0] == text


def test_other_values(frame):
    rows = frame([(None, "12", "abc", True, "")], "a double, b string, c string, d boolean, e string")
    percent = ValueFormat("percent")
    shown = rows.select(
        format_value(rows, "a"), format_value(rows, "b"), format_value(rows, "b", percent),
        format_value(rows, "c", percent), format_value(rows, "d"), format_value(rows, "e", percent),
    ).first()
    assert tuple(shown) == ("—", "12", "1,200%", "abc", "true", "0%")


def test_signed_texts(frame):
    rows = frame([(20.0,), (-1.25,), (0.0,)], "v double")
    found = rows.select(format_number(F.col("v"), signed=True), format_signed_percent(F.col("v")))
    assert [tuple(r) for r in found.collect()] == [
        ("+20", "+2,000.0%"), ("-1.25", "-125.0%"), ("+0", "+0.0%")
    ]


@pytest.mark.parametrize(
    "number, text",
    [
        (5.0, "5"), (0.1, "0.1"), (-2.5, "-2.5"), (1e7, "10000000"), (123456789.125, "123456789.125"),
        (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (1e-6, "0.000001"),
        (0.00025, "0.00025"), (1e-7, "1e-7"), (-1.5e-9, "-1.5e-9"), (0.0, "0"),
        (float("inf"), "Infinity"), (float("nan"), "NaN"), (9007199254740991.0, "9007199254740991"),
    ],
)
def test_machine_text_of_doubles(frame, number, text):
    assert frame([(number,)], "v double").select(double_text(F.col("v"))).first()[0] == text


def test_formula_guard_and_quotes(frame):
    texts = ["=2+2", "+1", "-1", "@x", "\tx", "\rx", "a=b", "", 'A, "q"', "a\nb"]
    rows = frame([(t,) for t in texts], "t string")
    guarded = [r[0] for r in rows.select(guard_formula(F.col("t"))).collect()]
    assert guarded == ["'=2+2", "'+1", "'-1", "'@x", "'\tx", "'\rx", "a=b", "", 'A, "q"', "a\nb"]
    quoted = [r[0] for r in rows.select(quote_cell(F.col("t"))).collect()]
    assert quoted[-2:] == ['"A, ""q"""', '"a\nb"'] and quoted[0] == "=2+2"


def test_cell_text(spark):
    rows = spark.sql(
        """SELECT -5 i, cast(-9223372036854775808 as bigint) big, -1.5D d, '-x' s, date'2026-07-01' day,
                  timestamp'2026-07-01 10:00:00' t, named_struct('a', 1, 'b', null) j, true b,
                  cast(null as string) n"""
    )
    texts = rows.select(*[cell_text(rows, c).alias(c) for c in rows.columns]).first()
    assert tuple(texts) == (
        "-5", "'-9223372036854775808", "-1.5", "'-x", "2026-07-01", "2026-07-01T10:00:00.000Z",
        '{"a":1,"b":null}', "true", "",
    )
