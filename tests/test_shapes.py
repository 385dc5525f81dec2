import math
import random
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import values
from tallyboard.functions import exact
from tallyboard.functions.formatting import ValueFormat
from tallyboard.operators.cohort import cohort_retention
from tallyboard.operators.heatmap import (
    heatmap_cells, heatmap_domain, heatmap_matrix, heatmap_row_metric, row_metric_conflicts,
    with_row_metric,
)
from tallyboard.operators.kpi import HIGHER, LOWER, kpi_delta, kpi_value
from tallyboard.operators.series import axis_type, period_compare, series_frame, series_rank
from tallyboard.operators.stack import (
    GROSS, NET, STANDARD, stack_normalize, stack_offenders, stack_zero,
)
from tallyboard.operators.table import normalize_result, table_projection, unsafe_columns
from tallyboard.operators.tooltip import tooltip_entries

STACK = "week string, depot string, fare double"


def stack(frame, *amounts):
    return frame([("w12", f"d{i}", v) for i, v in enumerate(amounts)], STACK)


def shares(frame, mode, *amounts):
    shared = stack_normalize(stack(frame, *amounts), "week", "fare", mode)
    return [row[0] for row in values(shared.orderBy("depot"), "fare_normalized")]


@pytest.mark.parametrize(
    "mode, amounts, expected",
    [
        (GROSS, (30.0, -10.0), [0.75, -0.25]),
        (NET, (50.0, -10.0), [1.25, -0.25]),
        (NET, (10.0, -35.0), [0.4, -1.4]),
        (GROSS, (0.0, 0.0), [0.0, 0.0]),
        (STANDARD, (9.0, 3.0), [0.75, 0.25]),
        (STANDARD, (0.0, 0.0), [0.0, 0.0]),
        (STANDARD, (9.0, None, 3.0, math.nan, math.inf), [0.75, None, 0.25, None, None]),
    ],
)
def test_normalized_stacks(frame, mode, amounts, expected):
    found = shares(frame, mode, *amounts)
    assert [v is None for v in found] == [v is None for v in expected]
    for got, want in zip(found, expected, strict=True):
        assert got == want or got == pytest.approx(want)


def test_refused_stacks(frame):
    with pytest.raises(PySparkException, match="not negative, at week=w12"):
        shares(frame, STANDARD, 30.0, -10.0)
    with pytest.raises(PySparkException, match="not zero, at week=w12"):
        shares(frame, NET, 15.0, -15.0)
    offenders = stack_offenders(stack(frame, 15.0, -15.0), "week", "fare", NET)
    assert values(offenders, "x") == [("w12",)]
    assert stack_offenders(stack(frame, 15.0, -15.0), "week", "fare", GROSS).count() == 0
    # A stack without any number has nothing to refuse.
    assert shares(frame, NET, None, None) == [None, None]


def test_shares_of_text_values_and_null_x(frame):
    rows = frame([(None, "a", " 30 "), (None, "b", "10"), (None, "c", "x"), ("p", "a", "")],
                 "week string, depot string, fare string")
    found = stack_normalize(rows, "week", "fare").orderBy("depot", "week")
    assert values(found, "depot", "fare_normalized") == [
        ("a", 0.75), ("a", None), ("b", 0.25), ("c", None)
    ]


def test_derived_name_is_free(frame):
    rows = stack(frame, 1.0).withColumn("fare_normalized", F.lit("taken"))
    assert stack_normalize(rows, "week", "fare").columns[-1] == "fare_normalized_"


def test_temporal_x_groups_by_instant(frame):
    rows = frame([("2026-01-01", "a", 1.0), ("2026-01-01T00:00:00.000Z", "b", 3.0)], STACK)
    apart = stack_normalize(rows, "week", "fare").orderBy("depot")
    assert values(apart, "fare_normalized") == [(1.0,), (1.0,)]
    together = stack_normalize(rows, "week", "fare", temporal=True).orderBy("depot")
    assert values(together, "fare_normalized") == [(0.25,), (0.75,)]


def test_stack_zero_piles_both_ways(frame):
    rows = frame(
        [("p", "a", 5.0), ("p", "b", -2.0), ("p", "c", 3.0), ("p", "d", -1.0), ("p", "e", None)],
        STACK,
    )
    found = stack_zero(rows, "week", "fare", ["depot"]).orderBy("depot")
    assert values(found, "y0", "y1") == [
        (0.0, 5.0), (0.0, -2.0), (5.0, 8.0), (-2.0, -3.0), (None, None)
    ]


METRIC = "cohort string, period int, size int"


def test_row_metric_repeated_or_once(frame):
    rows = frame([("2026-01", 0, 15240), ("2026-01", 1, 15240), ("2026-02", 0, 900)], METRIC)
    found = heatmap_row_metric(rows, "cohort", "size", ValueFormat(notation="compact"))
    assert values(found.orderBy("cohort")) == [
        ("2026-01", 15240.0, "15.2K", "15,240"), ("2026-02", 900.0, "900", "900")
    ]
    gaps = frame([("2026-01", 0, 100), ("2026-01", 1, None), ("2026-02", 0, None)], METRIC)
    found = heatmap_row_metric(gaps, "cohort", "size").orderBy("cohort")
    assert values(found, "metric", "metric_display") == [(100.0, "100"), (None, "—")]
    cells = with_row_metric(gaps, "cohort", "size")
    assert sorted(values(cells, "cohort", "metric_tooltip")) == [
        ("2026-01", "100"), ("2026-01", "100"), ("2026-02", "—")
    ]


def test_row_metric_conflicts(frame):
    rows = frame([("2026-01", 0, 100), ("2026-01", 1, 99)], METRIC)
    with pytest.raises(PySparkException, match="more than one value for cohort=2026-01"):
        heatmap_row_metric(rows, "cohort", "size").collect()
    assert values(row_metric_conflicts(rows, "cohort", "size"), "cohort") == [("2026-01",)]
    text = frame([("2026-01", 0, "many")], "cohort string, period int, size string")
    with pytest.raises(PySparkException, match="not a number for cohort=2026-01"):
        heatmap_row_metric(text, "cohort", "size").collect()


def test_heatmap_cells_and_matrix(frame):
    rows = frame(
        [("2026-02", 0, 1.0), ("2026-01", 1, 0.425), ("2026-01", 0, 1.0)],
        "cohort string, period int, retention double",
    )
    cells = heatmap_cells(rows, "period", "cohort", "retention", percent_label=True)
    assert values(cells) == [
        (0, "2026-01", 1.0, 100.0), (0, "2026-02", 1.0, 100.0), (1, "2026-01", 0.425, 42.5)
    ]
    matrix = heatmap_matrix(rows, "period", "cohort", "retention", [0, 1]).orderBy("cohort")
    assert values(matrix) == [("2026-01", 1.0, 0.425), ("2026-02", 1.0, None)]


@pytest.mark.parametrize(
    "amounts, expected",
    [
        ((1.0, 4.0), ("sequential", 0.0, 4.0, 2)),
        ((-3.0, 2.0), ("diverging", -3.0, 3.0, 2)),
        ((-1.0, -2.0), ("diverging", -2.0, 2.0, 2)),
        ((None, math.nan), ("sequential", 0.0, 0.0, 2)),
        ((), ("sequential", 0.0, 0.0, 0)),
    ],
)
def test_heatmap_domain(frame, amounts, expected):
    rows = frame([(i or None, v) for i, v in enumerate(amounts)], "y int, v double")
    assert values(heatmap_domain(rows, "y", "v")) == [expected]


def test_kpi_value(frame):
    rows = frame([(1, None), (2, 0.0)], "id int, v double")
    assert values(kpi_value(rows, "v", order=[F.col("id")])) == [(None, "—")]
    assert values(kpi_value(rows, "v", order=[F.col("id").desc()])) == [(0.0, "0")]
    blank = frame([("  ",)], "v string")
    assert values(kpi_value(blank, "v"), "display") == [("—",)]
    text = frame([("on track",)], "v string")
    assert values(kpi_value(text, "v"), "display") == [("on track",)]


@pytest.mark.parametrize(
    "current, previous, direction, delta, share, verdict, text",
    [
        (120.0, 100.0, HIGHER, 20.0, 0.2, "good", "+20 · +20.0%"),
        (120.0, 100.0, LOWER, 20.0, 0.2, "bad", "+20 · +20.0%"),
        (80.0, -100.0, HIGHER, 180.0, 1.8, "good", "+180 · +180.0%"),
        (5.0, 0.0, "neutral", 5.0, None, "neutral", "+5 · —"),
        (5.0, 5.0, HIGHER, 0.0, 0.0, "neutral", "+0 · +0.0%"),
        (0.0, 2.0, HIGHER, -2.0, -1.0, "bad", "-2 · -100.0%"),
        (None, 2.0, HIGHER, None, None, None, None),
        (2.0, math.inf, HIGHER, None, None, None, None),
    ],
)
def test_kpi_delta(frame, current, previous, direction, delta, share, verdict, text):
    rows = frame([(current, previous)], "cur double, prev double")
    found = kpi_delta(rows, "cur", "prev", direction=direction).first()
    assert (found.delta, found.verdict, found.delta_text) == (delta, verdict, text)
    assert found.delta_share == (None if share is None else pytest.approx(share))


def test_table_projection(frame):
    rows = frame([(1, "x")], "a int, b string")
    assert table_projection(rows, ["b", "c"]).first().asDict() == {"b": "x", "c": None}
    assert table_projection(rows).columns == ["a", "b"]


def test_normalize_result(spark):
    rows = spark.sql(
        """SELECT date'2026-07-01' d, timestamp'2026-07-01 10:00:00.123456' t,
                  cast(1.50 as decimal(10,2)) n, array(1, 2) a"""
    )
    found = normalize_result(rows).first()
    assert (found.d, found.t, found.n, found.a) == (
        "2026-07-01", "2026-07-01T10:00:00.123Z", 1.5, [1, 2]
    )


def test_series_frame_prefers_group(frame):
    rows = frame([(1, 2, "g", "c", "d")], "x int, y int, g string, c string, d string")
    assert series_frame(rows, "x", "y", group="g", color="c", details=["d", "x"]).columns == [
        "x", "y", "g", "d"
    ]
    assert series_frame(rows, "x", "y", color="c").columns == ["x", "y", "c"]


@pytest.mark.parametrize(
    "texts, expected",
    [
        ([None, "2026-01-01", "x"], "temporal"),
        (["2026-01-01T10:00:00Z"], "temporal"),
        (["x", "2026-01-01"], "nominal"),
        (["2026-13-01"], "nominal"),
        (["2026-01"], "nominal"),
        ([None], "nominal"),
    ],
)
def test_axis_type_follows_the_first_value(frame, texts, expected):
    rows = frame(list(enumerate(texts)), "id int, x string")
    assert axis_type(rows, "x", ["id"]).first()[0] == expected
    assert axis_type(rows, "x", ["id"], side_by_side=True).first()[0] == "nominal"


def test_series_rank(frame):
    rows = frame([("b",), ("a",), ("b",), (None,)], "s string")
    assert sorted(values(series_rank(rows, "s")), key=lambda r: r[1]) == [
        ("a", 0), ("b", 1), (None, 2)
    ]
    assert dict(values(series_rank(rows, "s", reverse=True)))["a"] == 2


def test_period_compare(frame):
    rows = frame(
        [(date(2026, 1, 5), 1), (date(2026, 1, 9), 2), (date(2026, 2, 1), 5)], "d date, v int"
    )
    found = period_compare(rows, "d", F.sum("v")).orderBy("period")
    assert values(found, "current_value", "previous_value") == [(3, None), (5, 3)]


def test_tooltip_entries(frame):
    rows = frame(
        [(1, "2026-01", "b", 5, 9), (2, "2026-01", "a", 7, 8), (3, "2026-02", "a", 1, None)],
        "id int, month string, channel string, gmv int, cohort_size int",
    )
    found = tooltip_entries(
        rows, "month", "gmv", ["id"], series="channel", details=" cohort_size , "
    ).orderBy("x", "place")
    assert values(found, "x", "place", "series", "color_value", "value") == [
        ("2026-01", 1, "b", "b", 5), ("2026-01", 2, "a", "a", 7), ("2026-02", 1, "a", "a", 1)
    ]
    detail = found.first().details[0]
    assert (detail.label, detail.value) == ("Cohort size", "9")
    plain = tooltip_entries(rows, "month", "gmv", ["id"]).orderBy("x", "place").first()
    assert (plain.series, plain.details) == (5, [])


def test_cohort_retention(frame):
    rows = frame(
        [("a", date(2026, 1, 5)), ("a", date(2026, 1, 6)), ("a", date(2026, 2, 1)),
         ("b", date(2026, 1, 9)), ("c", date(2025, 12, 1)), ("c", date(2026, 2, 1)),
         ("d", None), (None, date(2026, 1, 1))],
        "who string, day date",
    )
    found = cohort_retention(rows, "who", "day").orderBy("cohort_month", "period_number")
    assert values(found) == [
        (date(2025, 12, 1), 0, 1, 1, 1.0), (date(2025, 12, 1), 2, 1, 1, 1.0),
        (date(2026, 1, 1), 0, 2, 2, 1.0), (date(2026, 1, 1), 1, 2, 1, 0.5),
    ]


def spread_values(seed, rows):
    """Doubles of many sizes, with cancellation, in a few groups."""
    rng = random.Random(seed)
    found = []
    for i in range(rows):
        size = rng.choice([1e-300, 1e-12, 0.1, 1.0, 3.3, 1e6, 1e15, 1e200 if i % 5 == 0 else 7.0])
        found.append((f"x{i % 5}", i, rng.uniform(-1, 1) * size if i % 11 else None))
    found += [("none", -1, None), ("zero", -2, 0.0), ("tiny", -3, 5e-324), ("tiny", -4, 5e-324)]
    return found + [("power", -5 - e, 2.0**e) for e in range(-40, 41, 5)]


def test_totals_are_exact_in_any_order(spark):
    rows = spread_values(3, 3000)
    base = spark.createDataFrame(rows, "x string, i long, y double")
    bits = set()
    for parts in (1, 3, 17):
        dealt = base.repartition(parts, F.xxhash64("i", F.lit(parts)))
        found = {r["k"]: (r["__net"], r["__gross"], r["low"]) for r in exact.exact_totals(
            dealt, {"k": F.col("x")}, F.col("y"), "low").collect()}
        bits.add(repr(sorted(found.items())))
    assert len(bits) == 1
    for key, (net, gross, low) in found.items():
        own = [y for x, _, y in rows if x == key and y is not None]
        if not own:
            assert (net, gross, low) == (None, None, None)
            continue
        sizes = math.fsum(map(abs, own))
        assert abs(net - math.fsum(own)) <= 4e-16 * sizes and low == min(own)
        assert abs(gross - sizes) <= 4e-16 * sizes
    assert found["tiny"][0] == 1e-323 and found["power"][0] == math.fsum(y for x, _, y in rows if x == "power")


@pytest.mark.parametrize("mode", ["zero", "normalize_gross"])
def test_stacks_agree_to_the_bit(spark, mode):
    rows = [(x, i, y) for x, i, y in spread_values(4, 600) if y is None or abs(y) < 1e100]
    base = spark.createDataFrame(rows, "x string, i long, y double")
    seen = set()
    for parts in (1, 3, 17):
        dealt = base.repartition(parts, F.xxhash64("i", F.lit(parts)))
        shaped = stack_zero(dealt, "x", "y", ["i"]) if mode == "zero" else stack_normalize(dealt, "x", "y", mode)
        seen.add(repr(sorted(map(repr, shaped.collect()))))
    assert len(seen) == 1
    if mode == "zero":
        piled = sorted(stack_zero(base, "x", "y", ["i"]).where("x = 'x1' and y > 0").collect(), key=lambda r: r.i)
        at = 0.0
        for row, after in zip(piled, [*piled[1:], None], strict=True):
            at += row.y
            assert row.y1 == pytest.approx(at, rel=1e-12, abs=max(r.y for r in piled) * 2**-70)
            assert after is None or after.y0 == row.y1


def test_unsafe_integers_become_text(frame):
    big = 2**53
    rows = frame(
        [(1, big, [1, None], {"a": (big + 1, "x")}, {5: -big}, 3, None), (2, None, None, {"a": None}, None, None, None)],
        "n long, wide long, few array<long>, deep map<string, struct<v: long, t: string>>, keyed map<long, long>, "
        "small int, none array<struct<v: long>>",
    )
    assert unsafe_columns(rows) == ["wide", "deep", "keyed"]
    shown = normalize_result(rows, unsafe_columns(rows))
    assert [t for _, t in shown.dtypes] == [
        "bigint", "string", "array<bigint>", "map<string,struct<v:string,t:string>>", "map<string,string>", "int",
        "array<struct<v:bigint>>",
    ]
    first = shown.orderBy("n").first()
    assert (first.wide, first.deep["a"].v, first.keyed) == (str(big), str(big + 1), {"5": str(-big)})
    assert unsafe_columns(frame([(big - 1,)], "n long")) == [] and unsafe_columns(frame([("x",)], "t string")) == []
    assert normalize_result(rows).schema["wide"].dataType.simpleString() == "bigint"
