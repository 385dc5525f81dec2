"""Scans and the plain query surface: projection, filter, aggregation, joins, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import query, scratch, table, table_path
from tallyboard.functions.predicates import between_filter, in_filter
from tallyboard.sources.load import Source, load_source, register
from tallyboard.sources.ragged import quarantine
from tallyboard.sources.snapshot import Layout, snapshot_sources


def csv_copy(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A table written as CSV, for the queries that read CSV."""
    path = scratch(spark, name) + ".csv"
    table(spark, sf_dir, name).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "scan_csv",
    """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
              c_mktsegment
       FROM customer""",
)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_source(spark, "customer", csv_copy(spark, sf_dir, "customer")).frame


@query(
    "scan_csv_wide",
    """SELECT CAST(CAST(10000000000000000000 AS HUGEINT) + o_orderkey % 1000 AS VARCHAR) AS wide_key,
              count(*) AS orders FROM orders GROUP BY 1""",
)
def scan_csv_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 20 digits stay exact through a CSV file."""
    path = f"{scratch(spark, 'wide')}.csv"
    key = F.lit(str(10**19)).cast("decimal(38,0)") + (F.col("o_orderkey") % 1000)
    table(spark, sf_dir, "orders").select(key.cast("string").alias("wide_key")).write.csv(
        path, header=True
    )
    keys = load_source(spark, "wide", path).frame
    return keys.groupBy(F.col("wide_key").cast("string").alias("wide_key")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query(
    "check_csv_contract",
    """SELECT 'customer' AS source, 'csv_valid' AS name, 'passed' AS status,
              count(*) AS "rows" FROM customer""",
)
def check_csv_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalog.profiles import BUILT_AT
    from tallyboard.operators.profile import data_checks, source_facts

    source = load_source(spark, "customer", csv_copy(spark, sf_dir, "customer"))
    facts = source_facts(source)
    checks = data_checks(source, BUILT_AT, facts).select("source", "name", "status")
    return checks.join(F.broadcast(facts.select("rows")), F.lit(True))


#: A record of an order: a cell is missing, or there is one too many, for some keys.
RAGGED_RECORD = '''concat(CAST(o_orderkey AS {text}), ',"', o_orderpriority, ', ""', o_orderstatus, '""',
    CASE WHEN o_orderkey % 7 = 0 THEN '"' WHEN o_orderkey % 11 = 0 THEN '",x,"y,z"' ELSE '",x' END)'''


@query(
    "ragged_rows",
    f"""SELECT kind, cells, record FROM (
          SELECT record, CASE WHEN o_orderkey % 7 = 0 THEN 2 WHEN o_orderkey % 11 = 0 THEN 4 ELSE 3 END AS cells,
            CASE WHEN o_orderkey % 7 = 0 THEN 'short_rows' WHEN o_orderkey % 11 = 0 THEN 'long_rows' END AS kind
          FROM (SELECT o_orderkey, {RAGGED_RECORD.format(text='VARCHAR')} AS record FROM orders))
        WHERE kind IS NOT NULL
        UNION ALL SELECT 'check short_rows', CAST(count(*) AS INT),
          'rows with fewer cells than the header; missing ones are NULL: ' || count(*) FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL SELECT 'check long_rows', CAST(count(*) AS INT),
          'rows with more cells than the header; further ones are dropped: ' || count(*) FROM orders
          WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0""",
)
def ragged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that do not fit the header, as data, and the check rows that count them."""
    from catalog.profiles import BUILT_AT
    from tallyboard.operators.profile import data_checks

    path = f"{scratch(spark, 'ragged')}.csv"
    record = F.expr(RAGGED_RECORD.format(text="STRING")).alias("order_key,label,mark")
    # Written as they are below a header, by a writer that neither separates nor quotes.
    table(spark, sf_dir, "orders").select(record).write.csv(path, header=True, sep="\x01", quote="\x02")
    source = load_source(spark, "ragged", path)
    odd = quarantine(spark, path, source.raw.columns).select("kind", "cells", "record")
    counts = data_checks(source, BUILT_AT).where(F.col("name").endswith("_rows"))
    return odd.union(counts.select(
        F.concat(F.lit("check "), "name"),
        F.regexp_extract("message", "([0-9]+)$", 1).cast("int"), "message",
    ))


@query(
    "scan_parquet",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = load_source(spark, "orders", table_path(sf_dir, "orders"))
    return source.frame.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )


@query(
    "register_sources",
    """SELECT n_name, count(*) AS customers, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance
       FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def register_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(
        load_source(spark, name, table_path(sf_dir, name)) for name in ("customer", "nation")
    )
    return spark.sql(
        """SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
           FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
    )


@query(
    "mixed_source_join",
    """SELECT c_mktsegment, count(*) AS "rows", count(o_orderkey) AS orders,
              round(coalesce(sum(o_totalprice), 0), 2) AS revenue
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
def mixed_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load_source(spark, "customer", csv_copy(spark, sf_dir, "customer")).frame
    orders = load_source(spark, "orders", table_path(sf_dir, "orders")).frame
    # Orders are summed per customer before the join, so a customer with very many
    # orders reaches the join as one row.
    per_customer = orders.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("spent")
    )
    joined = customers.join(per_customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_mktsegment").agg(
        F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("rows"),
        F.sum(F.coalesce("n", F.lit(0))).alias("orders"),
        F.round(F.coalesce(F.sum("spent"), F.lit(0.0)), 2).alias("revenue"),
    )


@query(
    "snapshot_sources",
    """SELECT 'nation' AS name, count(*) AS "rows", sum(n_nationkey)::BIGINT AS key_sum FROM nation
       UNION ALL SELECT 'part', count(*), sum(p_partkey)::BIGINT FROM part""",
)
def snapshot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "snapshot")
    names = {"nation": "n_nationkey", "part": "p_partkey"}
    written = snapshot_sources(
        [load_source(spark, name, table_path(sf_dir, name)) for name in names], folder
    )
    parts = [
        spark.read.parquet(path).agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"),
            F.sum(F.col(names[name]).cast("long")).alias("key_sum"),
        )
        for name, path in written.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "sql_projection",
    """SELECT l_orderkey AS order_key, l_linenumber AS line, l_extendedprice * (1 - l_discount) AS net
       FROM lineitem""",
)
def sql_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


@query(
    "sql_filter",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
         AND l_returnflag IN ('A', 'R') AND l_linestatus IS NOT NULL GROUP BY l_returnflag""",
)
def sql_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").where(
        (F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1999-01-01")
        & F.col("l_returnflag").isin("A", "R") & F.col("l_linestatus").isNotNull()
    )
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(
    "sql_global_agg",
    """SELECT round(sum(l_quantity), 2) AS quantity, min(l_extendedprice) AS low,
              max(l_extendedprice) AS high, count(*) AS n FROM lineitem""",
)
def sql_global_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "sql_topk",
    """SELECT o_orderkey, o_totalprice FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
)
def sql_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
        .orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last())
        .limit(10)
    )


@query(
    "sql_left_join",
    """SELECT d.lang, count(*) AS documents, count(l.doc_id) AS labelled,
              CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS good
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""",
)
def sql_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = documents.alias("d").join(
        table(spark, sf_dir, "labels").alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left"
    )
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count("l.doc_id").alias("labelled"),
        F.coalesce(F.sum("quality"), F.lit(0)).alias("good"),
    )


@query(
    "sql_cte",
    """WITH by_month AS (
         SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS revenue
         FROM orders GROUP BY 1)
       SELECT CAST(month AS DATE) AS month, round(revenue, 2) AS revenue FROM by_month ORDER BY month""",
    dates=("month",),
)
def sql_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """WITH by_month AS (
             SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS revenue
             FROM {orders} GROUP BY 1)
           SELECT CAST(month AS DATE) AS month, round(revenue, 2) AS revenue
           FROM by_month ORDER BY month""",
        orders=table(spark, sf_dir, "orders"),
    )


@query(
    "revenue_by_month",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS status,
              round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2""",
    dates=("month",),
)
def revenue_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(table(spark, sf_dir, "orders"), "o_orderstatus", "status")


@query(
    "revenue_by_day",
    """SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day,
              round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1""",
)
def revenue_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "orders").groupBy(day).agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


def monthly(orders: DataFrame, field: str, alias: str, value=None) -> DataFrame:
    """Revenue per month and one field: the frame that charts are drawn from."""
    amount = F.col("o_totalprice") if value is None else value
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")
    return orders.groupBy(month, F.col(field).alias(alias)).agg(
        F.round(F.sum(amount), 2).alias("revenue")
    )


def text_source(name: str, text: DataFrame, **settings) -> Source:
    """A table of text columns seen as the rows of a CSV source."""
    return Source(name, "csv", text, text, None, **settings)


@query(
    "snapshot_layout",
    """SELECT o_orderstatus, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders
       WHERE o_orderdate >= DATE '1997-03-03' AND o_orderdate < DATE '1997-03-09' + INTERVAL 1 DAY
         AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY o_orderstatus""",
)
def layout_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of two priorities, from a copy clustered by day with Bloom filters on priorities."""
    source = load_source(spark, "orders", table_path(sf_dir, "orders"))
    written = snapshot_sources(
        [source], scratch(spark, "layout"),
        layouts={"orders": Layout("o_orderdate", ("o_orderpriority",), distinct=16)},
    )
    week = between_filter("o_orderdate", {"start": "1997-03-03", "end": "1997-03-09"})
    chosen = in_filter("o_orderpriority", ["1-URGENT", "5-LOW"])
    return spark.read.parquet(written["orders"]).where(week & chosen).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("key_sum")
    )
