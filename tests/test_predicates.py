import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.functions.predicates import between_filter, dimension, in_filter, option_label
from tallyboard.operators.options import (
    collapse_selection, commit_selection, option_labels, param_options,
)
from tallyboard.plans.params import DateRange, Dimension, MultiSelect, Options, Select


@pytest.fixture
def countries(frame):
    return frame([(1, "DE"), (2, "FR"), (3, None), (4, "O'x")], "id int, country string")


def kept(df, test):
    return sorted(row.id for row in df.where(test).collect())


@pytest.mark.parametrize(
    "selection, settings, ids",
    [
        (None, {}, [3]),
        (["DE", None, "FR"], {}, [1, 2, 3]),
        ("all", {}, [1, 2, 3, 4]),
        ([], {}, []),
        ([], {"empty": "all"}, [1, 2, 3, 4]),
        (None, {"include_null": False}, []),
        (["DE", None], {"include_null": False}, [1]),
        ([None], {"include_null": False, "empty": "all"}, [1, 2, 3, 4]),
        ("DE", {}, [1]),
        (["O'x"], {}, [4]),
        (['DE" OR 1=1'], {}, []),
    ],
)
def test_in_filter(countries, selection, settings, ids):
    assert kept(countries, in_filter("country", selection, **settings)) == ids


def test_in_filter_keeps_types(frame):
    df = frame([(1, 1.5, True), (2, 2.0, False)], "id int, n double, flag boolean")
    assert kept(df, in_filter("n", [1.5])) == [1]
    assert kept(df, in_filter("flag", [False])) == [2]
    assert kept(df, in_filter("id", 2)) == [2]


def test_in_filter_dotted_name(countries):
    assert kept(countries.alias("facts"), in_filter("facts.country", ["DE"])) == [1]


def test_between_includes_the_whole_last_day(frame):
    df = frame(
        [(1, "2026-06-01 00:00:00"), (2, "2026-06-30 23:59:59.999999"), (3, "2026-07-01 00:00:00")],
        "id int, at string",
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    chosen = {"start": "2026-06-01", "end": "2026-06-30"}
    assert kept(df, between_filter("at", chosen)) == [1, 2]
    assert kept(df, between_filter("at", "all")) == [1, 2, 3]
    for broken in ({"start": "2026-06-01"}, {}, None, "2026"):
        with pytest.raises(ValueError, match="start and end"):
            between_filter("at", broken)


def test_between_reaches_the_scan(spark, frame, tmp_path):
    path = str(tmp_path / "t.parquet")
    frame([(1,)], "id int").select("id", F.lit("2026-01-01").cast("timestamp_ntz").alias("at")).write.parquet(path)
    kept_rows = spark.read.parquet(path).where(
        between_filter("at", {"start": "2026-01-01", "end": "2026-01-31"})
    )
    plan = kept_rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at" in plan and "LessThan(at" in plan


def test_dimension(countries):
    fields = {"country": "country"}
    groups = countries.groupBy(dimension("country", fields).alias("b")).count()
    assert groups.count() == 4
    single = countries.groupBy(dimension("none", fields, allow_none=True).alias("b")).count()
    assert values(single) == [("", 4)]
    with pytest.raises(ValueError):
        dimension("none", fields)
    with pytest.raises(ValueError):
        dimension("city", fields)


def test_parameter_declarations():
    with pytest.raises(ValueError):
        MultiSelect(Options("orders", "country", include_null=False), default=["DE", None])
    with pytest.raises(ValueError):
        Select(Options("orders", "country"), allow_all=False)
    with pytest.raises(ValueError):
        Dimension({"country": "country"}, default="none")
    with pytest.raises(ValueError):
        Dimension({"none": "country"}, default="none", allow_none=True)
    assert DateRange().default == "all"


def test_options_are_sorted_with_null_last(countries):
    assert values(param_options(countries, "country")) == [("DE",), ("FR",), ("O'x",), (None,)]
    no_null = param_options(countries, "country", include_null=False)
    assert values(no_null) == [("DE",), ("FR",), ("O'x",)]
    with pytest.raises(ValueError):
        param_options(countries, "city")
    labels = option_labels(param_options(countries, "country"), "(none)")
    assert values(labels, "label")[-1] == ("(none)",)


def test_label_of_null(countries):
    assert countries.where("id = 3").select(option_label("country")).first()[0] == "(Null)"


def test_selecting_every_option_is_all(countries):
    assert commit_selection(countries, "country", ["DE", "FR", "O'x", None]) == "all"
    assert commit_selection(countries, "country", ["DE", "FR", "O'x"]) == ["DE", "FR", "O'x"]
    # Without a selectable NULL the three values are every option.
    every = commit_selection(countries, "country", ["DE", "FR", "O'x"], include_null=False)
    assert every == "all"
    state = collapse_selection(countries, "country", []).first()
    assert (state.options, state.selected, state.selection) == (4, 0, "none")
