from functools import partial

import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.plans.params import DateRange, Dimension, MultiSelect, Number, Options, Select
from tallyboard.plans.report import Report, ReportError, ResultCache
from tallyboard.sources.load import table_source

ROWS = [
    (1, "DE", "Software", 10.5, "2026-06-29"), (2, "FR", "Hardware", 20.0, "2026-06-30"),
    (3, None, "Software", -5.25, "2026-07-02"), (4, "DE", "Hardware", 1.0, "2026-06-30"),
]


@pytest.fixture
def report(spark):
    made = Report(spark, "ticket-sales", "Tickets", cache=ResultCache())
    rows = spark.createDataFrame(ROWS, "id int, country string, kind string, revenue double, day string")
    made.source(table_source("orders", rows.withColumn("day", F.col("day").cast("timestamp_ntz"))))
    made.param("country", MultiSelect(Options("orders", "country")))
    made.param("dates", DateRange({"start": "2026-06-01", "end": "2026-06-30"}))
    made.param(
        "group_by", Dimension(
            {"country": "country", "kind": "kind"}, default="none", allow_none=True,
            labels={"country": "Country"},
        ),
    )

    @made.view("filtered", reads=["orders"], uses=["country", "dates"])
    def filtered(inputs):
        return inputs["orders"].where(
            inputs.filter("country", "country") & inputs.filter("day", "dates")
        )

    @made.query("by_group", reads=["filtered"], uses=["group_by"])
    def by_group(inputs):
        group = inputs.dimension("group_by").alias("b")
        return inputs["filtered"].groupBy(group).agg(F.sum("revenue").alias("revenue"))

    made.sql_block(
        "query", "total", "SELECT sum(revenue) AS revenue FROM {filtered}", reads=["filtered"]
    )
    made.sql_block("query", "raw_count", "SELECT count(*) AS n FROM {orders}", reads=["orders"])
    return made


def test_lineage_reaches_through_views(report):
    lineage = report.lineage("by_group")
    assert lineage.sources == ("orders",)
    assert lineage.params == ("country", "dates", "group_by")
    assert lineage.blocks == ("filtered",)
    assert report.check()["raw_count"].params == ()


def test_run_with_defaults_and_values(report):
    run = report.run()
    assert values(run.outputs["by_group"]) == [("", 31.5)]
    assert values(run.outputs["raw_count"]) == [(4,)]
    chosen = report.run({"country": ["DE"], "group_by": "kind", "dates": "all"})
    assert sorted(values(chosen.outputs["by_group"])) == [("Hardware", 1.0), ("Software", 10.5)]
    assert values(chosen.outputs["total"]) == [(11.5,)]


def test_changed_parameters_pick_the_outputs(report):
    assert report.affected(["group_by"]) == ["by_group"]
    assert report.affected(["country"]) == ["by_group", "total"]
    run = report.run({"group_by": "kind"}, changed=["group_by"])
    assert list(run.outputs) == ["by_group"]
    assert report.affected(["dates"], ["total"]) == ["total"]


def test_failures_stay_with_their_readers(spark, report):
    report.sql_block("view", "broken", "SELECT nothing FROM {orders}", reads=["orders"])
    report.sql_block("query", "reader", "SELECT * FROM {broken}", reads=["broken"])
    status = {row.output: row for row in report.run().status(spark).collect()}
    assert status["broken"].status == "failed"
    assert "nothing" in status["broken"].message and "SELECT" in status["broken"].message
    assert status["reader"].status == "skipped" and "broken" in status["reader"].message
    assert status["total"].status == "planned"
    done = report.run(sink=lambda name, df: df.count()).status(spark)
    assert {r.output: r.status for r in done.collect()}["total"] == "done"
    report.sql_block(
        "query", "late", "SELECT raise_error('boom') AS x FROM {orders}", reads=["orders"]
    )
    late = report.run(outputs=["late"], sink=lambda name, df: df.collect()).status(spark).first()
    assert late.status == "failed" and "boom" in late.message


def test_a_sink_that_fails_fails_its_output_only(report):
    seen = []

    def sink(name, df):
        if name == "by_group":
            raise RuntimeError("disk full")
        seen.append((name, df.count()))

    run = report.run(sink=sink)
    assert sorted(seen) == [("raw_count", 1), ("total", 1)]
    assert "by_group" not in run.outputs


def test_broken_declarations(spark, report):
    with pytest.raises(ReportError, match="already taken"):
        report.sql_block("query", "orders", "SELECT 1", reads=["orders"])
    with pytest.raises(ReportError, match="is a view"):
        report.run(outputs=["filtered"])
    with pytest.raises(ReportError, match="unknown output"):
        report.run(outputs=["nope"])
    with pytest.raises(ReportError, match="unknown parameters"):
        report.run({"nope": 1})
    with pytest.raises(ReportError, match="no column"):
        report.param("x", MultiSelect(Options("orders", "nope")))
    with pytest.raises(ReportError, match="no source"):
        report.param("x", MultiSelect(Options("nope", "country")))
    report.sql_block("query", "constant", "SELECT 1", reads=[])
    with pytest.raises(ReportError, match="does not reach a source"):
        report.check()


def test_unknown_inputs_and_cycles(spark, report):
    report.sql_block("view", "a", "SELECT * FROM {b}", reads=["b"])
    with pytest.raises(ReportError, match="unknown inputs: b"):
        report.lineage("a")
    report.sql_block("view", "b", "SELECT * FROM {a}", reads=["a", "orders"])
    with pytest.raises(ReportError, match="depends on itself"):
        report.lineage("a")


def test_cache_is_keyed_by_relevant_parameters(report):
    report.snapshot_id = "build one"
    first = report.run(outputs=["raw_count", "by_group"]).outputs
    again = report.run({"group_by": "kind"}, outputs=["raw_count", "by_group"]).outputs
    assert again["raw_count"] is first["raw_count"]
    assert again["by_group"] is not first["by_group"]
    assert report.cache.hits == 1
    report.snapshot_id = "other data"
    assert report.run(outputs=["raw_count"]).outputs["raw_count"] is not first["raw_count"]
    report.cache.clear()


def test_nothing_is_cached_before_a_build(report):
    first = report.run(outputs=["raw_count"]).outputs["raw_count"]
    assert report.run(outputs=["raw_count"]).outputs["raw_count"] is not first
    assert report.cache.hits == 0 and not first.is_cached


def test_reports_share_a_cache_without_sharing_results(spark):
    cache, found = ResultCache(), []
    for rows in (1, 2):
        made = Report(spark, f"r{rows}", "R", cache=cache)
        made.source(table_source("t", spark.range(rows)))
        made.sql_block("query", "n", "SELECT count(*) AS n FROM {t}", reads=["t"])
        made.snapshot_id = "same"
        found += values(made.run().outputs["n"])
    assert found == [(1,), (2,)]
    cache.clear()


def test_a_changed_view_changes_the_cached_output(spark):
    cache, found = ResultCache(), []
    for limit in (1, 3):
        made = Report(spark, "r", "R", cache=cache)
        made.source(table_source("t", spark.range(5)))
        made.sql_block("view", "some", f"SELECT * FROM {{t}} WHERE id < {limit}", reads=["t"])
        made.sql_block("query", "n", "SELECT count(*) AS n FROM {some}", reads=["some"])
        made.snapshot_id = "same"
        found += values(made.run().outputs["n"])
    assert found == [(1,), (3,)]
    cache.clear()


def test_cache_drops_the_oldest(report):
    report.snapshot_id = "build one"
    report.cache.size = 1
    report.run(outputs=["raw_count", "total"])
    kept = report.run(outputs=["raw_count"]).outputs["raw_count"]
    assert report.cache.hits == 0 and kept.is_cached
    report.cache.clear()
    assert not kept.is_cached


def test_definition_hash_sees_closed_over_values(spark):
    def made(factor, version=None):
        report = Report(spark, "r", "R")
        report.source(table_source("t", spark.range(3)))

        @report.query("q", reads=["t"], version=version)
        def q(inputs):
            return inputs["t"].select((F.col("id") * factor).alias("x"))

        return report.definition_sha256()

    assert made(2) == made(2) != made(5)
    with pytest.raises(ReportError, match="give the block a version"):
        made(object())
    assert made(object(), version="1") == made(object(), version="1")
    report = Report(spark, "r", "R")
    with pytest.raises(ReportError, match="no source text"):
        report.query("q", reads=["t"])(partial(max, 1))


def test_sql_blocks_take_parameters(spark, report):
    report.param("least", Number(0))
    report.sql_block(
        "query", "by_sql",
        "SELECT group_name, sum(revenue) AS revenue FROM {orders} WHERE revenue > :least"
        " GROUP BY group_name",
        reads=["orders"], filters={"orders": {"country": "country", "dates": "day"}},
        dimensions={"orders": {"group_by": "group_name"}}, uses=["least"],
    )
    assert report.lineage("by_sql").params == ("country", "dates", "group_by", "least")
    run = report.run({"country": ["DE"], "group_by": "kind", "least": 5}, outputs=["by_sql"])
    assert values(run.outputs["by_sql"]) == [("Software", 10.5)]
    with pytest.raises(ReportError, match="does not read"):
        report.sql_block("query", "x", "SELECT 1", reads=["orders"], filters={"t": {"dates": "d"}})


def test_values_are_checked(report):
    report.param("one", Select(Options("orders", "kind"), default="Software", allow_all=False))
    for values_ in (
        {"one": "all"}, {"one": ["Software"]}, {"group_by": "nope"}, {"dates": "yesterday"},
    ):
        with pytest.raises(ReportError, match="parameter"):
            report.run(values_)


def test_definition_hash(spark, report):
    before = report.definition_sha256()
    assert before == report.definition_sha256()
    report.sql_block("query", "more", "SELECT * FROM {orders}", reads=["orders"])
    assert report.definition_sha256() != before


def test_options(report):
    assert values(report.options("country")) == [("DE",), ("FR",), (None,)]
