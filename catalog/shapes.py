"""Result shaping: tables, single values, series, stacks, heatmaps, tooltips, cohorts."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import query, table
from catalog.frames import monthly
from tallyboard.functions.formatting import ValueFormat, format_number, format_value
from tallyboard.functions.numbers import numeric
from tallyboard.operators.cohort import cohort_retention
from tallyboard.operators.heatmap import (
    heatmap_cells, heatmap_domain, heatmap_matrix, heatmap_row_metric,
)
from tallyboard.operators.kpi import HIGHER, kpi_delta, kpi_value
from tallyboard.operators.series import axis_kind, period_compare, series_frame, series_rank
from tallyboard.operators.stack import GROSS, NET, STANDARD, stack_normalize, stack_zero
from tallyboard.operators.table import normalize_result, table_projection, unsafe_columns
from tallyboard.operators.tooltip import tooltip_entries

SIGNED_AMOUNT = "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END"
MONTH_SQL = "CAST(date_trunc('month', o_orderdate) AS DATE)"


def month_sql(field: str, alias: str, amount: str = "o_totalprice") -> str:
    return f"""SELECT {MONTH_SQL} AS month, {field} AS {alias},
        round(sum({amount}), 2) AS revenue FROM orders GROUP BY 1, 2"""


STATUS_SQL = month_sql("o_orderstatus", "status")
SIGNED_SQL = month_sql("o_orderpriority", "priority", SIGNED_AMOUNT)


def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(table(spark, sf_dir, "orders"), "o_orderstatus", "status")


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue per priority, finished orders counted as negative."""
    return monthly(
        table(spark, sf_dir, "orders"), "o_orderpriority", "priority", F.expr(SIGNED_AMOUNT)
    )


@query("table_projection", "SELECT p_brand, NULL::VARCHAR AS absent, p_partkey FROM part")
def projection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_projection(table(spark, sf_dir, "part"), ["p_brand", "absent", "p_partkey"])


@query(
    "normalize_result",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS o_orderdate,
              strftime(o_orderdate, '%Y-%m-%d') AS day,
              CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS price,
              CAST(9007199254740000 + o_orderkey AS VARCHAR) AS wide,
              concat(o_custkey, '/', 9007199254740000 + o_orderkey) AS pair FROM orders""",
)
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        (F.col("o_orderkey") + F.lit(9007199254740000)).alias("wide"),
        F.array(F.col("o_custkey").cast("long"), F.col("o_orderkey") + F.lit(9007199254740000)).alias("pair"),
    )
    shown = normalize_result(orders, unsafe_columns(orders))
    return shown.withColumn("pair", F.array_join("pair", "/"))


COMPARE_SQL = f"""SELECT {MONTH_SQL} AS period, round(sum(o_totalprice), 2) AS current_value
    FROM orders GROUP BY 1"""
COMPARED_SQL = f"""SELECT period, current_value,
    lag(current_value) OVER (ORDER BY period) AS previous_value FROM ({COMPARE_SQL})"""


@query("period_compare", COMPARED_SQL, dates=("period",))
def compare_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_compare(
        table(spark, sf_dir, "orders"), "o_orderdate", F.round(F.sum("o_totalprice"), 2)
    )


def latest_first():
    return [F.col("period").desc_nulls_last()]


@query(
    "kpi_value",
    f"""WITH k AS (SELECT current_value AS value, CAST(round(current_value) AS BIGINT) AS v
                   FROM ({COMPARE_SQL}) ORDER BY period DESC LIMIT 1),
        u AS (SELECT *, CASE WHEN v >= 999950000 THEN 1000000000 WHEN v >= 999950 THEN 1000000
                             ELSE 1000 END AS unit FROM k),
        t AS (SELECT *, (v + unit // 20) // (unit // 10) AS tenths FROM u)
        SELECT value, CAST(tenths // 10 AS VARCHAR)
          || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || CAST(tenths % 10 AS VARCHAR) END
          || CASE unit WHEN 1000000000 THEN 'B' WHEN 1000000 THEN 'M' ELSE 'K' END AS display
        FROM t""",
)
def kpi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_value(compare_query(spark, sf_dir), "current_value", order=latest_first())


def compact_sql(size: str) -> str:
    """A size with one decimal at most and K, M, B or T."""
    steps = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    shown = "regexp_replace(format('{{:.1f}}', round({size} / {unit}, 1)), '\\.0$', '')"
    cases = " ".join(
        f"WHEN round({size} / {unit / 1000}, 1) >= 1000 THEN {shown.format(size=size, unit=unit)} || '{letter}'"
        for unit, letter in steps
    )
    return f"CASE {cases} ELSE {shown.format(size=size, unit=1.0)} END"


def sign_sql(value: str) -> str:
    return f"CASE WHEN {value} < 0 THEN '-' ELSE '+' END"


DELTA, SHARE = "(current_value - previous_value)", "((current_value - previous_value) / abs(previous_value))"
DELTA_TEXT_SQL = f"""{sign_sql(DELTA)} || {compact_sql(f'abs({DELTA})')} || ' · '
    || {sign_sql(SHARE)} || format('{{:,.1f}}', round(abs({SHARE}) * 100, 1)) || '%'"""


@query(
    "kpi_delta",
    f"""SELECT current_value, previous_value, current_value - previous_value AS delta,
               (current_value - previous_value) / nullif(abs(previous_value), 0) AS delta_share,
               CASE WHEN current_value > previous_value THEN 'good'
                    WHEN current_value < previous_value THEN 'bad'
                    WHEN current_value = previous_value THEN 'neutral' END AS verdict, {DELTA_TEXT_SQL} AS delta_text
        FROM ({COMPARED_SQL}) ORDER BY period DESC LIMIT 1""",
)
def delta_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_delta(
        compare_query(spark, sf_dir), "current_value", "previous_value",
        direction=HIGHER, order=latest_first(),
    )


@query("series_frame", STATUS_SQL, dates=("month",))
def series_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_frame(
        by_status(spark, sf_dir), "month", "revenue", group="status", color="month"
    )


@query(
    "axis_type",
    """WITH f AS (SELECT min_by(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS day,
                         min_by(o_orderpriority, o_orderkey) AS priority FROM orders)
       SELECT 'day' AS x, CASE WHEN regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}(T.*)?$')
              THEN 'temporal' ELSE 'nominal' END AS axis_type FROM f
       UNION ALL SELECT 'priority', CASE WHEN regexp_matches(priority, '^\\d{4}-\\d{2}-\\d{2}(T.*)?$')
              THEN 'temporal' ELSE 'nominal' END FROM f
       UNION ALL SELECT 'date', 'temporal' UNION ALL SELECT 'key', 'nominal'
       UNION ALL SELECT 'side_by_side', 'nominal'""",
)
def axis_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("date"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    order = ["o_orderkey"]
    cases = {
        "day": axis_kind(orders, "day", order),
        "priority": axis_kind(orders, "o_orderpriority", order),
        "date": axis_kind(orders, "date", order),
        "key": axis_kind(orders, "o_orderkey", order),
        "side_by_side": axis_kind(orders, "day", order, side_by_side=True),
    }
    one = orders.agg(*[kind.alias(name) for name, kind in cases.items()])
    pairs = [part for name in cases for part in (F.lit(name), F.col(name))]
    return one.select(F.explode(F.create_map(*pairs)).alias("x", "axis_type"))


@query(
    "stack_zero",
    f"""SELECT month, priority, revenue, round(y0, 2) AS y0, round(y0 + revenue, 2) AS y1
        FROM (SELECT *, coalesce(sum(revenue) OVER (PARTITION BY month, revenue < 0 ORDER BY priority
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0 FROM ({SIGNED_SQL}))""",
    dates=("month",),
)
def stack_zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = stack_zero(signed(spark, sf_dir), "month", "revenue", ["priority"])
    return stacked.withColumns({name: F.round(name, 2) for name in ("y0", "y1")})


def normalize_sql(frame: str, whole: str) -> str:
    return f"""SELECT *, round(revenue / ({whole} OVER (PARTITION BY month)), 9) AS share
        FROM ({frame})"""


def shares(frame: DataFrame, mode: str) -> DataFrame:
    shared = stack_normalize(frame, "month", "revenue", mode, into="share")
    return shared.withColumn("share", F.round("share", 9))


@query("stack_normalize", normalize_sql(STATUS_SQL, "sum(revenue)"), dates=("month",))
def stack_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(by_status(spark, sf_dir), STANDARD)


@query("stack_normalize_gross", normalize_sql(SIGNED_SQL, "sum(abs(revenue))"), dates=("month",))
def stack_gross_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(signed(spark, sf_dir), GROSS)


@query(
    "stack_normalize_net",
    f"""SELECT *, round(revenue / abs(sum(revenue) OVER (PARTITION BY month)), 6) AS share
        FROM ({SIGNED_SQL})""",
    dates=("month",),
)
def stack_net_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = stack_normalize(signed(spark, sf_dir), "month", "revenue", NET, into="share")
    return shared.withColumn("share", F.round("share", 6))


COHORT_SQL = """WITH active AS (
      SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
    first AS (SELECT o_custkey, min(month) AS cohort_month FROM active GROUP BY 1),
    cells AS (SELECT cohort_month,
        CAST(datediff('month', cohort_month, month) AS INTEGER) AS period_number,
        count(*) AS retained FROM active JOIN first USING (o_custkey) GROUP BY 1, 2),
    cohorts AS (SELECT cohort_month, period_number,
        max(CASE WHEN period_number = 0 THEN retained END) OVER (PARTITION BY cohort_month)
          AS cohort_size, retained FROM cells),
    frame AS (SELECT *, retained / cohort_size AS retention FROM cohorts)"""


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_retention(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("cohort_retention", f"{COHORT_SQL} SELECT * FROM frame", dates=("cohort_month",))
def cohort_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts(spark, sf_dir)


@query(
    "heatmap_cells",
    f"""{COHORT_SQL} SELECT period_number, cohort_month, retention, retained,
        retention * 100 AS cell_label FROM frame ORDER BY 1, 2""",
    dates=("cohort_month",),
)
def cells_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap_cells(
        cohorts(spark, sf_dir), "period_number", "cohort_month", "retention",
        details=["retained"], percent_label=True,
    )


@query(
    "heatmap_matrix",
    f"""SELECT month, max(revenue) FILTER (status = 'F') AS "F", max(revenue) FILTER (status = 'O') AS "O",
               max(revenue) FILTER (status = 'P') AS "P" FROM ({STATUS_SQL}) GROUP BY month""",
    dates=("month",),
)
def matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap_matrix(by_status(spark, sf_dir), "status", "month", "revenue", ["F", "O", "P"])


@query(
    "heatmap_domain",
    f"""WITH d AS (SELECT least(min(revenue), 0) AS low, greatest(max(revenue), 0) AS high,
                          count(DISTINCT month) AS row_count FROM ({SIGNED_SQL}))
        SELECT CASE WHEN low < 0 THEN 'diverging' ELSE 'sequential' END AS scale,
               CASE WHEN low < 0 THEN -greatest(abs(low), abs(high)) ELSE low END AS domain_low,
               CASE WHEN low < 0 THEN greatest(abs(low), abs(high)) ELSE high END AS domain_high,
               row_count FROM d""",
)
def domain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap_domain(signed(spark, sf_dir), "month", "revenue")


@query(
    "heatmap_row_metric",
    f"""{COHORT_SQL} SELECT cohort_month, CAST(max(cohort_size) AS DOUBLE) AS metric,
        format('{{:,}}', max(cohort_size)) AS metric_display,
        format('{{:,}}', max(cohort_size)) AS metric_tooltip FROM frame GROUP BY 1""",
    dates=("cohort_month",),
)
def metric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap_row_metric(cohorts(spark, sf_dir), "cohort_month", "cohort_size")


@query(
    "tooltip_buckets",
    f"""WITH f AS (SELECT {MONTH_SQL} AS x, o_orderstatus AS series,
                          round(sum(o_totalprice), 2) AS value, count(*) AS order_count
                   FROM orders GROUP BY 1, 2)
        SELECT x, row_number() OVER (PARTITION BY x ORDER BY series) AS place, series,
               series AS color_value, value, 'Order count' AS detail_label,
               CAST(order_count AS VARCHAR) AS detail_value FROM f""",
    dates=("x",),
)
def tooltip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")
    rows = table(spark, sf_dir, "orders").groupBy(month, "o_orderstatus").agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"),
        F.count(F.lit(1)).alias("order_count"),
    )
    entries = tooltip_entries(
        rows, "month", "revenue", ["o_orderstatus"], series="o_orderstatus",
        details="order_count",
    )
    detail = F.col("details")[0]
    return entries.select(
        "x", "place", "series", "color_value", "value",
        detail["label"].alias("detail_label"), detail["value"].alias("detail_value"),
    )


@query(
    "series_rank",
    """SELECT p_brand AS series, row_number() OVER (ORDER BY p_brand) - 1 AS color_rank
       FROM (SELECT DISTINCT p_brand FROM part)""",
)
def rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_rank(table(spark, sf_dir, "part"), "p_brand")


@query(
    "format_values",
    """WITH c AS (SELECT c_custkey, c_acctbal, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS cents
                  FROM customer),
       t AS (SELECT *, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END AS sign,
                    format('{:,}', cents // 100) AS whole, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS part,
                    CASE WHEN cents >= 99995 THEN (cents + 5000) // 10000 ELSE (cents + 5) // 10 END AS tenths,
                    CASE WHEN cents >= 99995 THEN 'K' ELSE '' END AS letter FROM c)
       SELECT c_custkey,
         sign || regexp_replace(whole || '.' || part, '\\.?0+$', '') AS number_text,
         sign || '€' || whole || '.' || part AS currency_text,
         sign || CAST(tenths // 10 AS VARCHAR) || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || CAST(tenths % 10 AS VARCHAR) END
           || letter AS compact_text,
         CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || whole || '.' || part AS signed_text,
         sign || format('{:,}', (cents + 500) // 10000)
           || CASE WHEN (cents + 500) // 1000 % 10 = 0 THEN '' ELSE '.' || CAST((cents + 500) // 1000 % 10 AS VARCHAR) END
           || '%' AS percent_text,
         CASE WHEN c_custkey % 10 = 0 THEN '—' ELSE sign || regexp_replace(whole || '.' || part, '\\.?0+$', '') END
           AS missing_text
       FROM t""",
)
def format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    balance = numeric(customers, "c_acctbal")
    dollars = format_number(balance, ValueFormat("currency"), signed=True)
    # A column without a value for some customers.
    kept = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))
    customers = customers.withColumn("known", kept)
    return customers.select(
        "c_custkey",
        format_value(customers, "c_acctbal").alias("number_text"),
        format_value(customers, "c_acctbal", ValueFormat("currency", "EUR")).alias("currency_text"),
        format_value(customers, "c_acctbal", ValueFormat(notation="compact")).alias("compact_text"),
        F.replace(dollars, F.lit("$"), F.lit("")).alias("signed_text"),
        format_number(balance / 10000, ValueFormat("percent")).alias("percent_text"),
        format_value(customers, "known").alias("missing_text"),
    )
