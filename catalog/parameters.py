"""Parameters, the report job, and selectable values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import query, scratch, table, table_path
from catalog.frames import monthly
from tallyboard.functions.predicates import between_filter, dimension, in_filter
from tallyboard.operators.options import collapse_selection, option_labels, param_options
from tallyboard.plans.params import DateRange, Dimension, MultiSelect, Number, Options
from tallyboard.plans.report import Inputs, Report, ResultCache
from tallyboard.plans.store import ResultStore
from tallyboard.sources.load import load_source

FIELDS = {"priority": "o_orderpriority", "status": "o_orderstatus"}
RANGE = {"start": "1997-02-01", "end": "1998-01-31"}
URGENT_AS_NULL = "nullif(o_orderpriority, '1-URGENT')"


def kept_orders(spark: SparkSession, sf_dir: str, test: Column) -> DataFrame:
    """Which orders a predicate keeps, in sums; urgent ones have no priority here."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.expr(URGENT_AS_NULL).alias("priority")
    )
    return orders.where(test).groupBy("priority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("key_sum")
    )


def kept_sql(test: str) -> str:
    return f"""SELECT priority, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
        FROM (SELECT o_orderkey, o_orderdate, {URGENT_AS_NULL} AS priority FROM orders)
        WHERE {test} GROUP BY priority"""


@query("in_filter_all", kept_sql("TRUE"))
def in_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_orders(spark, sf_dir, in_filter("priority", "all"))


@query("in_filter_values", kept_sql("priority IN ('2-HIGH', '5-LOW')"))
def in_filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_orders(spark, sf_dir, in_filter("priority", ["2-HIGH", "5-LOW"]))


@query("in_filter_null", kept_sql("(priority IN ('5-LOW') OR priority IS NULL)"))
def in_filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_orders(spark, sf_dir, in_filter("priority", ["5-LOW", None]))


@query(
    "in_filter_empty",
    f"""SELECT 'none' AS rule, count(*) AS orders FROM orders WHERE FALSE
        UNION ALL SELECT 'all', count(*) FROM orders WHERE TRUE""",
)
def in_filter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    counts = [
        orders.where(in_filter("o_orderpriority", [], empty=rule)).agg(
            F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("orders")
        )
        for rule in ("none", "all")
    ]
    return counts[0].unionByName(counts[1])


@query("in_filter_no_null", kept_sql("priority IN ('5-LOW')"))
def in_filter_no_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_orders(spark, sf_dir, in_filter("priority", ["5-LOW", None], include_null=False))


@query(
    "between_filter",
    kept_sql(
        f"""o_orderdate >= DATE '{RANGE["start"]}'
            AND o_orderdate < CAST('{RANGE["end"]}' AS DATE) + INTERVAL 1 DAY"""
    ),
)
def between_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_orders(spark, sf_dir, between_filter("o_orderdate", RANGE))


def by_dimension(spark: SparkSession, sf_dir: str, choice: str) -> DataFrame:
    breakdown = dimension(choice, FIELDS, allow_none=True).alias("breakdown")
    return table(spark, sf_dir, "orders").groupBy(breakdown).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


@query(
    "dimension_group",
    """SELECT o_orderpriority AS breakdown, round(sum(o_totalprice), 2) AS revenue
       FROM orders GROUP BY 1""",
)
def dimension_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_dimension(spark, sf_dir, "priority")


@query(
    "dimension_none",
    "SELECT '' AS breakdown, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1",
)
def dimension_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_dimension(spark, sf_dir, "none")


def revenue_report(spark: SparkSession, sf_dir: str) -> Report:
    """Orders behind two filters and a switchable breakdown."""
    report = Report(spark, "order-flow", "Order flow", timezone="UTC")
    report.source(load_source(spark, "orders", table_path(sf_dir, "orders")))
    report.param("priority", MultiSelect(Options("orders", "o_orderpriority")))
    report.param("dates", DateRange(RANGE))
    report.param("breakdown", Dimension(FIELDS, default="status", allow_none=True))

    @report.view("chosen_orders", reads=["orders"], uses=["priority", "dates"])
    def chosen_orders(inputs: Inputs) -> DataFrame:
        return inputs["orders"].where(
            inputs.filter("o_orderpriority", "priority") & inputs.filter("o_orderdate", "dates")
        )

    @report.query("revenue_by_month", reads=["chosen_orders"], uses=["breakdown"])
    def revenue_by_month(inputs: Inputs) -> DataFrame:
        orders = inputs["chosen_orders"]
        return monthly(
            orders.withColumn("choice", inputs.dimension("breakdown")), "choice", "breakdown"
        )

    report.sql_block(
        "query", "revenue_summary",
        "SELECT round(sum(o_totalprice), 2) AS revenue FROM {chosen_orders}",
        reads=["chosen_orders"],
    )
    return report


SELECTION = {"priority": ["2-HIGH", "5-LOW"], "breakdown": "status"}
FILTERED_SQL = f"""o_orderpriority IN ('2-HIGH', '5-LOW')
    AND o_orderdate >= DATE '{RANGE["start"]}'
    AND o_orderdate < CAST('{RANGE["end"]}' AS DATE) + INTERVAL 1 DAY"""


@query(
    "filtered_view",
    f"""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE {FILTERED_SQL}""",
)
def filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = revenue_report(spark, sf_dir).run(SELECTION, ["revenue_summary"])
    return run.views["chosen_orders"].select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "revenue_by_dim",
    f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               o_orderstatus AS breakdown, round(sum(o_totalprice), 2) AS revenue
        FROM orders WHERE {FILTERED_SQL} GROUP BY 1, 2 ORDER BY month, breakdown""",
    dates=("month",),
)
def revenue_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = revenue_report(spark, sf_dir).run(SELECTION, ["revenue_by_month"])
    return run.outputs["revenue_by_month"].orderBy("month", "breakdown")


@query(
    "run_report",
    f"""SELECT 'revenue_by_month' AS output, 'query' AS kind, 'done' AS status,
               count(DISTINCT (date_trunc('month', o_orderdate), o_orderstatus)) AS "rows"
        FROM orders WHERE {FILTERED_SQL}
        UNION ALL SELECT 'revenue_summary', 'query', 'done', 1
        UNION ALL SELECT 'chosen_orders', 'view', 'planned', NULL
        UNION ALL SELECT 'broken', 'query', 'failed', NULL
        UNION ALL SELECT 'after_broken', 'query', 'skipped', NULL""",
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = revenue_report(spark, sf_dir)
    # It fails when its first row is computed, not when it is declared.
    report.sql_block(
        "query", "broken", "SELECT raise_error('no revenue') AS x FROM {orders}", reads=["orders"]
    )
    report.sql_block("query", "after_broken", "SELECT * FROM {broken}", reads=["broken"])
    folder = scratch(spark, "outputs")
    run = report.run(SELECTION, sink=lambda name, df: df.write.parquet(f"{folder}/{name}"))
    counts = [
        spark.read.parquet(f"{folder}/{name}").agg(
            F.lit(name).alias("output"), F.count(F.lit(1)).alias("rows")
        )
        for name in run.outputs
    ]
    rows = counts[0]
    for other in counts[1:]:
        rows = rows.unionByName(other)
    # One row per output on either side.
    return run.status(spark).drop("message").join(F.broadcast(rows), "output", "left")


@query(
    "sql_block_params",
    f"""SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
        FROM orders WHERE {FILTERED_SQL} AND o_totalprice >= 1000 GROUP BY 1""",
)
def sql_block_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = revenue_report(spark, sf_dir)
    report.param("least", Number(0))
    report.sql_block(
        "query", "by_status",
        "SELECT status, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue"
        " FROM {orders} WHERE o_totalprice >= :least GROUP BY status",
        reads=["orders"], uses=["least"],
        filters={"orders": {"priority": "o_orderpriority", "dates": "o_orderdate"}},
        dimensions={"orders": {"breakdown": "status"}},
    )
    return report.run({**SELECTION, "least": 1000}, ["by_status"]).outputs["by_status"]


URGENT_SQL = FILTERED_SQL.replace("'2-HIGH', '5-LOW'", "'1-URGENT'")


@query(
    "cached_run",
    f"""SELECT 'first' AS run, round(sum(o_totalprice), 2) AS revenue
        FROM orders WHERE {FILTERED_SQL}
        UNION ALL SELECT 'second', round(sum(o_totalprice), 2) FROM orders WHERE {URGENT_SQL}""",
)
def cached_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = ResultCache()
    rows = []
    for name, priority in (("first", SELECTION["priority"]), ("second", ["1-URGENT"])):
        report = revenue_report(spark, sf_dir)
        report.cache, report.snapshot_id = cache, f"tables in {sf_dir}"
        run = report.run({**SELECTION, "priority": priority}, ["revenue_summary"])
        rows.append(run.outputs["revenue_summary"].select(F.lit(name).alias("run"), "revenue"))
    return rows[0].unionByName(rows[1])


@query(
    "stored_run",
    f"""SELECT run, hits, round(sum(o_totalprice), 2) AS revenue
        FROM orders, (VALUES ('first', 0), ('again', 1)) AS r(run, hits) WHERE {FILTERED_SQL} GROUP BY run, hits
        UNION ALL SELECT 'other', 0, round(sum(o_totalprice), 2) FROM orders WHERE {URGENT_SQL}""",
)
def stored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in a store: a second report and store read what the first ones left."""
    folder, rows = scratch(spark, "results"), []
    for name, priority in (("first", SELECTION["priority"]), ("again", SELECTION["priority"]),
                           ("other", ["1-URGENT"])):
        report = revenue_report(spark, sf_dir)
        report.cache, report.snapshot_id = ResultStore(spark, folder), f"tables in {sf_dir}"
        run = report.run({**SELECTION, "priority": priority}, ["revenue_summary"])
        rows.append(run.outputs["revenue_summary"].select(
            F.lit(name).alias("run"), F.lit(report.cache.hits).alias("hits"), "revenue"
        ))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "param_options",
    f"SELECT DISTINCT {URGENT_AS_NULL} AS value FROM orders ORDER BY 1",
)
def options_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.expr(URGENT_AS_NULL).alias("priority"))
    return param_options(orders, "priority")


@query(
    "param_options_no_null",
    f"""SELECT DISTINCT {URGENT_AS_NULL} AS value FROM orders
        WHERE {URGENT_AS_NULL} IS NOT NULL ORDER BY 1""",
)
def options_no_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.expr(URGENT_AS_NULL).alias("priority"))
    return param_options(orders, "priority", include_null=False)


@query(
    "option_labels",
    f"""SELECT DISTINCT {URGENT_AS_NULL} AS value,
               coalesce({URGENT_AS_NULL}, '(No priority)') AS label FROM orders""",
)
def labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return option_labels(options_query(spark, sf_dir), "(No priority)")


@query(
    "select_all_collapse",
    """WITH c AS (SELECT count(DISTINCT event_type) AS options,
                         count(DISTINCT event_type) FILTER (event_type IN
                           ('click', 'error', 'purchase', 'signup', 'view')) AS selected FROM events)
       SELECT options, selected, CASE WHEN options = selected THEN 'all'
              WHEN selected = 0 THEN 'none' ELSE 'partial' END AS selection FROM c""",
)
def select_all_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ["click", "error", "purchase", "signup", "view"]
    return collapse_selection(table(spark, sf_dir, "events"), "event_type", chosen)
