"""Source profiles, checks, identity, manifest and registry."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import query, scratch, table, table_path
from catalog.frames import text_source
from tallyboard.functions.text_types import iso_granularity, iso_instant, iso_is_naive
from tallyboard.operators.identity import content_identity, table_fingerprint
from tallyboard.operators.measure import fingerprint
from tallyboard.operators.profile import (
    data_checks, facts_of, infer_text_types, leaf_profile, passport, source_window,
    timezone_check, union_all,
)
from tallyboard.operators.status import data_status, freshness_rollup
from tallyboard.sources import folders
from tallyboard.sources import manifest as manifests
from tallyboard.sources import registry as registries
from tallyboard.sources.footers import footer_facts
from tallyboard.sources.ledger import ContentLedger
from tallyboard.sources.load import Freshness, Source, load_source, table_source

BUILT_AT = datetime(2024, 2, 2, tzinfo=timezone.utc)
SQL_TIME = "%Y-%m-%d %H:%M:%S.%f"


def time_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def profiled(spark: SparkSession, sf_dir: str) -> list[Source]:
    """Three typed tables and two that are seen as text, as a CSV would be."""
    orders = table(spark, sf_dir, "orders")
    events = table(spark, sf_dir, "events")
    order_text = orders.select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
        F.col("o_totalprice").cast("string").alias("price"),
    )
    event_text = events.select(
        F.col("event_id").cast("string").alias("event_id"),
        time_text("ts").alias("ts"),
        F.concat(time_text("ts"), F.lit("+02:00")).alias("processed"),
        F.col("value").cast("string").alias("value"),
    )
    return [
        load_source(
            spark, "events", table_path(sf_dir, "events"),
            freshness=Freshness("ts", "ts", max_lag_hours=24),
        ),
        load_source(
            spark, "lineitem", table_path(sf_dir, "lineitem"),
            freshness=Freshness("l_shipdate", max_lag_hours=1_000_000),
        ),
        load_source(spark, "orders", table_path(sf_dir, "orders")),
        text_source("order_text", order_text, freshness=Freshness("order_day")),
        text_source("event_text", event_text, freshness=Freshness("ts", "processed", 72)),
    ]


PASSPORT_SQL = """
    SELECT 'events' AS name, 'parquet' AS source_format, count(*) AS "rows", 6 AS columns,
           'event_id,ts,user_id,event_type,value,props' AS column_names,
           'integer,datetime,integer,string,number,string' AS column_types,
           min(ts) AS low, max(ts) AS high, 'datetime' AS gran,
           max(ts) AS processed, 'datetime' AS pgran, 'warning' AS status FROM events
    UNION ALL SELECT 'lineitem', 'parquet', count(*), 11,
           'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate',
           'integer,integer,integer,integer,number,number,number,number,string,string,datetime',
           min(l_shipdate), max(l_shipdate), 'datetime', NULL, NULL, 'passed' FROM lineitem
    UNION ALL SELECT 'orders', 'parquet', count(*), 6,
           'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority',
           'integer,integer,string,number,datetime,string',
           NULL, NULL, NULL, NULL, NULL, 'passed' FROM orders
    UNION ALL SELECT 'order_text', 'csv', count(*), 3, 'order_key,order_day,price',
           'integer,datetime,number', CAST(CAST(min(o_orderdate) AS DATE) AS TIMESTAMP),
           CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP), 'date', NULL, NULL, 'passed' FROM orders
    UNION ALL SELECT 'event_text', 'csv', count(*), 4, 'event_id,ts,processed,value',
           'integer,datetime,datetime,number', min(ts), max(ts), 'datetime',
           max(ts) - INTERVAL 2 HOUR, 'datetime', 'passed' FROM events"""


def sql_times(*columns: str) -> str:
    return ", ".join(f"strftime({c}, '{SQL_TIME}') AS {c}" for c in columns)


@query(
    "source_passport",
    f"""SELECT name, source_format, "rows", columns, column_names, column_types,
               {sql_times('low', 'high', 'processed')}, gran, pgran, status
        FROM ({PASSPORT_SQL})""",
)
def passport_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    passports = union_all([passport(source, BUILT_AT) for source in profiled(spark, sf_dir)])
    types = F.transform("column_names", lambda n: F.col("inferred_column_types")[n])
    return passports.select(
        "name", "source_format", "rows", "columns",
        F.array_join("column_names", ",").alias("column_names"),
        F.array_join(types, ",").alias("column_types"),
        time_text("data_min_at").alias("low"), time_text("data_max_at").alias("high"),
        time_text("processed_at").alias("processed"),
        F.col("data_time_granularity").alias("gran"),
        F.col("processed_time_granularity").alias("pgran"),
        F.col("freshness_status").alias("status"),
    )


# One column per case of the type merge, built from the rows of orders.
TEXT_COLUMNS = {
    "order_key": "CAST(o_orderkey AS {s})",
    "price": "CAST(o_totalprice AS {s})",
    "order_date": "CAST(o_orderdate AS {s})",
    "priority": "o_orderpriority",
    "is_open": "CASE o_orderstatus WHEN 'O' THEN 'TRUE' WHEN 'F' THEN 'false' ELSE 'NA' END",
    "nothing": "CASE o_orderstatus WHEN 'O' THEN 'none' WHEN 'F' THEN '' ELSE 'Null' END",
    "key_or_price": "CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS {s}) ELSE CAST(o_totalprice AS {s}) END",
    "key_or_date": "CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS {s}) ELSE CAST(o_orderdate AS {s}) END",
    "key_or_flag": "CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS {s}) ELSE 'true' END",
    "sparse_key": "CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS {s}) END",
}
# The same classification in SQL: one flag per class and column.
_CLASS = """CASE WHEN lower(trim(coalesce(v, ''))) IN ('', 'null', 'none', 'na') THEN 'null'
    WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean'
    WHEN regexp_full_match(trim(v), '[+-]?\\d+') THEN 'integer'
    WHEN try_cast(trim(v) AS DOUBLE) IS NOT NULL THEN 'number'
    WHEN try_cast(trim(v) AS TIMESTAMP) IS NOT NULL THEN 'datetime' ELSE 'string' END"""
_MERGE = """CASE WHEN count(DISTINCT c) FILTER (c <> 'null') = 0 THEN 'null'
    WHEN count(DISTINCT c) FILTER (c <> 'null') = 1 THEN max(c) FILTER (c <> 'null')
    WHEN bool_and(c IN ('integer', 'number', 'null')) THEN 'number' ELSE 'string' END"""


@query(
    "infer_text_types",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS column_name, {_MERGE} AS inferred_type FROM
            (SELECT {_CLASS} AS c FROM (SELECT {text.format(s='VARCHAR')} AS v FROM orders))"""
        for name, text in TEXT_COLUMNS.items()
    ),
)
def infer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        F.expr(text.format(s="STRING")).alias(name) for name, text in TEXT_COLUMNS.items()
    ]
    return infer_text_types(table(spark, sf_dir, "orders").select(*columns))


@query(
    "schema_types",
    """SELECT 'embeddings' AS source, unnest(['vec_id', 'embedding.list.element', 'label']) AS column_name,
              unnest(['integer', 'number', 'integer']) AS inferred_type,
              unnest([count(vec_id), CAST(sum(len(embedding)) AS BIGINT), count(label)]) AS "values"
       FROM embeddings
       UNION ALL
       SELECT 'events', unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']),
              unnest(['integer', 'datetime', 'integer', 'string', 'number', 'string']),
              unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value),
                      count(props)]) FROM events""",
)
def schema_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [
        leaf_profile(load_source(spark, name, table_path(sf_dir, name))).select(
            F.lit(name).alias("source"), "column_name", "inferred_type", "values"
        )
        for name in ("embeddings", "events")
    ]
    return union_all(named)


# Event times written in one ISO 8601 shape per event type; errors are no dates.
@query(
    "parse_iso_datetime",
    f"""SELECT event_id,
          strftime(CASE event_type WHEN 'view' THEN ts
             WHEN 'signup' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
             WHEN 'click' THEN ts - INTERVAL 330 MINUTE
             WHEN 'purchase' THEN date_trunc('minute', ts) END, '{SQL_TIME}') AS instant,
          CASE WHEN event_type = 'signup' THEN 'date' ELSE 'datetime' END AS granularity,
          event_type IN ('purchase', 'error') AS naive FROM events""",
)
def iso_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(kind == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'+05:30'"))
        .when(kind == "purchase", F.date_format("ts", "yyyyMMdd'T'HHmm"))
        .otherwise(F.date_format("ts", "MM/dd/yyyy HH:mm"))
    )
    texts = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return texts.select(
        "event_id",
        time_text(iso_instant(F.col("text"))).alias("instant"),
        iso_granularity(F.col("text")).alias("granularity"),
        iso_is_naive(F.col("text")).alias("naive"),
    )


@query(
    "source_window",
    f"""SELECT name, {sql_times('low', 'high', 'processed')}, gran, pgran FROM ({PASSPORT_SQL})""",
)
def window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = union_all([source_window(source) for source in profiled(spark, sf_dir)])
    return windows.select(
        "name", time_text("data_min_at").alias("low"), time_text("data_max_at").alias("high"),
        time_text("processed_at").alias("processed"),
        F.col("data_time_granularity").alias("gran"),
        F.col("processed_time_granularity").alias("pgran"),
    )


EVENT_LAG = "(epoch_us(TIMESTAMP '2024-02-02') - epoch_us(max(ts))) / 3.6e9"


@query(
    "freshness_check",
    f"""SELECT source, status, message FROM (
          SELECT 'events' AS source, CASE WHEN {EVENT_LAG} > 24 THEN 'warning' ELSE 'passed' END AS status,
            CASE WHEN {EVENT_LAG} > 24 THEN 'newest data is ' || format('{{:.1f}}', {EVENT_LAG})
              || ' hours back, 24 hours are allowed' END AS message FROM events
          UNION ALL SELECT 'lineitem', 'passed', NULL
          UNION ALL SELECT 'event_text', CASE WHEN {EVENT_LAG} > 72 THEN 'warning' ELSE 'passed' END,
            NULL FROM events)""",
)
def freshness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = union_all([data_checks(source, BUILT_AT) for source in profiled(spark, sf_dir)])
    return checks.where(F.col("name") == "data_freshness").select("source", "status", "message")


def broken_sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    """Sources that fail: a missing column, a column without values, no dates at all."""
    orders = table(spark, sf_dir, "orders")
    blank = orders.select(F.when(F.col("o_orderkey").isNull(), F.col("o_orderdate")).alias("seen"))
    named = orders.select(F.lower("o_orderpriority").alias("day"))
    return [
        table_source("no_column", orders, Freshness("missing_at")),
        table_source("no_values", blank, Freshness("seen")),
        text_source("no_dates", named, freshness=Freshness("day")),
    ]


@query(
    "data_checks",
    f"""SELECT 'events' AS source, 'parquet_valid' AS name, 'passed' AS status, NULL AS message
         UNION ALL SELECT 'events', 'data_freshness', CASE WHEN {EVENT_LAG} > 24 THEN 'warning' ELSE 'passed' END,
           CASE WHEN {EVENT_LAG} > 24 THEN 'newest data is ' || format('{{:.1f}}', {EVENT_LAG})
             || ' hours back, 24 hours are allowed' END FROM events
         UNION ALL SELECT 'lineitem', 'parquet_valid', 'passed', NULL
         UNION ALL SELECT 'lineitem', 'data_freshness', 'passed', NULL
         UNION ALL SELECT 'orders', 'parquet_valid', 'passed', NULL
         UNION ALL SELECT 'order_text', 'csv_valid', 'passed', NULL
         UNION ALL SELECT 'event_text', 'csv_valid', 'passed', NULL
         UNION ALL SELECT 'event_text', 'timezone_assumed', 'warning',
           'times of ts without an offset count as UTC' FROM events HAVING count(ts) > 0
         UNION ALL SELECT 'event_text', 'data_freshness',
           CASE WHEN {EVENT_LAG} > 72 THEN 'warning' ELSE 'passed' END, NULL FROM events
         UNION ALL SELECT 'no_column', 'freshness_columns', 'failed',
           'the source lacks its freshness columns missing_at'
         UNION ALL SELECT 'no_values', 'freshness_values', 'failed', concat(chr(39), 'seen', chr(39), ' is empty in every row')
           FROM orders HAVING count(o_orderkey) = count(*)
         UNION ALL SELECT 'no_dates', 'freshness_parse', 'failed',
           concat(chr(39), 'day', chr(39), ' holds ', count(o_orderpriority), ' values that are no ISO 8601 times')
           FROM orders
         UNION ALL SELECT NULL, 'report_timezone_defaulted', 'warning', 'no report time zone is set; UTC is used'""",
)
def checks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [*profiled(spark, sf_dir), *broken_sources(spark, sf_dir)]
    checks = [data_checks(source, BUILT_AT) for source in sources]
    checks.append(timezone_check(checks[0], None))
    return union_all(checks).select("source", "name", "status", "message")


@query(
    "freshness_rollup",
    f"""SELECT 'warning' AS status, strftime(max(high), '{SQL_TIME}') AS data_through,
               strftime(max(processed), '{SQL_TIME}') AS processed_at FROM ({PASSPORT_SQL})""",
)
def rollup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = profiled(spark, sf_dir)
    # A few rows per source: each source is profiled once, all in one job, without types.
    facts = facts_of(sources, with_types=False)
    rollup = freshness_rollup(
        union_all([passport(source, BUILT_AT, facts[source.name]) for source in sources]),
        union_all([data_checks(source, BUILT_AT, facts[source.name]) for source in sources]),
    )
    return rollup.select(
        "status", time_text("data_through").alias("data_through"),
        time_text("processed_at").alias("processed_at"),
    )


def shown_sql(column: str, gran: str) -> str:
    return f"""CASE WHEN {column} IS NULL THEN 'Not configured'
        WHEN {gran} = 'date' THEN strftime({column}, '%b %d, %Y')
        ELSE strftime({column} + INTERVAL 1 HOUR, '%b %d, %Y, %I:%M %p') END"""


# The zone below is one hour ahead of UTC all year.
@query(
    "data_status",
    f"""SELECT name, {shown_sql('high', 'gran')} AS through,
               {shown_sql('processed', 'pgran')} AS processed,
               format('{{:,}}', "rows") AS "rows", status FROM ({PASSPORT_SQL})""",
)
def status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    passports = union_all([passport(source, BUILT_AT) for source in profiled(spark, sf_dir)])
    return data_status(passports, "Africa/Lagos")


FINGERPRINTED = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                 "c_acctbal": "double", "c_mktsegment": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
               "o_orderpriority": "string"},
}


def fingerprint_sql(name: str) -> str:
    texts = [
        f"strftime({c}, '{SQL_TIME}')" if c.endswith("date") else f"CAST({c} AS VARCHAR)"
        for c in FINGERPRINTED[name]
    ]
    row = ", ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts)
    lanes = ", ".join(
        f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0) AS VARCHAR)"
        for i in range(4)
    )
    schema = ",".join(f"{len(c)}:{c} {kind}" for c, kind in FINGERPRINTED[name].items())
    return f"""SELECT '{name}' AS name, count(*) AS "rows",
        sha256(concat_ws('|', '{schema}', CAST(count(*) AS VARCHAR), {lanes})) AS fingerprint
        FROM (SELECT sha256(concat_ws('|', {row})) AS h FROM {name})"""


FINGERPRINT_SQL = " UNION ALL ".join(fingerprint_sql(name) for name in FINGERPRINTED)


@query("table_fingerprint", FINGERPRINT_SQL)
def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(
        [
            table_fingerprint(table(spark, sf_dir, name), list(columns)).select(
                F.lit(name).alias("name"), "rows", "fingerprint"
            )
            for name, columns in FINGERPRINTED.items()
        ]
    )


VERSIONS = {"tool_version": "0.1.0", "runtime_version": "spark"}
DEFINITION = "0" * 64


IDENTITY_SQL = f"""WITH s AS ({FINGERPRINT_SQL}),
        j AS (SELECT sha256('{{"report_source_sha256":"{DEFINITION}","runtime_version":"spark","sources":{{'
          || string_agg('"' || name || '":"' || fingerprint || '"', ',' ORDER BY name)
          || '}},"tool_version":"0.1.0"}}') AS content_sha256 FROM s)
        SELECT 'orders-report__' || substr(content_sha256, 1, 12) AS artifact_id, content_sha256 FROM j"""


@query("content_identity", IDENTITY_SQL)
def identity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = fingerprint_query(spark, sf_dir).select("name", F.col("fingerprint").alias("sha256"))
    return content_identity(hashes, "orders-report", DEFINITION, **VERSIONS)


@query(
    "manifest",
    f"""WITH i AS (SELECT * FROM ({IDENTITY_SQL}))
        SELECT 'orders-report' AS slug, 'warning' AS checks_status, name AS source_name,
               source_format, "rows", columns, column_names, column_types, status AS freshness_status,
               {sql_times('low', 'high', 'processed')}, gran, pgran,
               '2024-02-02 00:00:00.000000' AS built_at, artifact_id, content_sha256,
               CASE name WHEN 'events' THEN 'data_freshness:warning,parquet_valid:passed'
                 WHEN 'lineitem' THEN 'data_freshness:passed,parquet_valid:passed'
                 WHEN 'orders' THEN 'parquet_valid:passed' WHEN 'order_text' THEN 'csv_valid:passed'
                 ELSE 'csv_valid:passed,data_freshness:passed,timezone_assumed:warning' END AS tests
        FROM ({PASSPORT_SQL}), i""",
)
def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = profiled(spark, sf_dir)
    facts = facts_of(sources)
    manifest = manifests.build_manifest(
        union_all([passport(s, BUILT_AT, facts[s.name]) for s in sources]),
        union_all([data_checks(s, BUILT_AT, facts[s.name]) for s in sources]),
        identity_query(spark, sf_dir),
        slug="orders-report", title="Orders", built_at=BUILT_AT, timezone=None, **VERSIONS,
    )
    path = scratch(spark, "manifest")
    manifests.write_manifest(manifest, path)
    back = manifests.read_manifest(spark, path)
    own = F.filter("checks.tests", lambda t: t["source"] == F.col("s.name"))
    tests = F.array_sort(F.transform(own, lambda t: F.concat_ws(":", t["name"], t["status"])))
    types = F.transform("s.column_names", lambda n: F.col("s.inferred_column_types")[n])
    return back.select("*", F.explode("sources").alias("s")).select(
        F.col("report.slug").alias("slug"), F.col("checks.status").alias("checks_status"),
        F.col("s.name").alias("source_name"), "s.source_format", "s.rows", "s.columns",
        F.array_join("s.column_names", ",").alias("column_names"),
        F.array_join(types, ",").alias("column_types"), "s.freshness_status",
        time_text("s.data_min_at").alias("low"), time_text("s.data_max_at").alias("high"),
        time_text("s.processed_at").alias("processed"),
        F.col("s.data_time_granularity").alias("gran"), F.col("s.processed_time_granularity").alias("pgran"),
        time_text("build.built_at").alias("built_at"), F.col("artifact.id").alias("artifact_id"),
        "artifact.content_sha256", F.array_join(tests, ",").alias("tests"),
    )


BUILDS_SQL = """SELECT event_type AS slug, ts AS built_at, 'build-' || event_id AS artifact_id
    FROM events"""
LATEST_SQL = f"""SELECT slug, built_at, artifact_id FROM (SELECT *, row_number() OVER
    (PARTITION BY slug ORDER BY built_at DESC, artifact_id DESC) AS r FROM ({BUILDS_SQL})) WHERE r = 1"""


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build log from the events: one slug per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("slug"), F.col("ts").alias("built_at"),
        F.concat(F.lit("build-"), F.col("event_id").cast("string")).alias("artifact_id"),
    )


@query(
    "registry_publish",
    f"""SELECT slug, strftime(built_at, '{SQL_TIME}') AS built_at, artifact_id, '0.1' AS schema_version
        FROM ({LATEST_SQL})""",
)
def publish_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = builds(spark, sf_dir).select(
        F.lit(registries.RECORD_VERSION).alias("schema_version"), "slug",
        F.initcap("slug").alias("title"), "artifact_id",
        F.col("built_at").cast("timestamp").alias("built_at"),
        *[F.lit(text).alias(name) for name, text in VERSIONS.items()],
    )
    folder = scratch(spark, "registry")
    registries.publish(records, folder)
    latest = registries.registry_latest(registries.read_registry(spark, folder))
    return latest.select(
        "slug", time_text("built_at").alias("built_at"), "artifact_id", "schema_version"
    )


@query(
    "registry_log",
    f"""SELECT slug, strftime(built_at, '{SQL_TIME}') AS built_at, artifact_id, 1 AS tail FROM ({LATEST_SQL})""",
)
def log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest builds from a folded log and the one publication behind the fold."""
    records = builds(spark, sf_dir).select(
        F.lit(registries.RECORD_VERSION).alias("schema_version"), "slug",
        F.initcap("slug").alias("title"), "artifact_id", F.col("built_at").cast("timestamp").alias("built_at"),
        *[F.lit(text).alias(name) for name, text in VERSIONS.items()],
    )
    log = registries.RegistryLog(spark, scratch(spark, "registry-log"))
    part = F.pmod(F.xxhash64("artifact_id"), F.lit(3))
    log.publish(records.where(part == 0))
    log.publish(records.where(part == 1))
    log.fold()
    log.vacuum()
    log.publish(records.where(part == 2))
    return log.latest().select(
        "slug", time_text("built_at").alias("built_at"), "artifact_id", F.lit(len(log.tail())).alias("tail")
    )


@query("registry_latest", LATEST_SQL)
def latest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registries.registry_latest(builds(spark, sf_dir))


@query(
    "registry_outdated",
    f"""SELECT b.slug, b.built_at, b.artifact_id, l.artifact_id AS latest_artifact_id
        FROM ({BUILDS_SQL}) b JOIN ({LATEST_SQL}) l ON l.slug = b.slug
        WHERE b.artifact_id <> l.artifact_id""",
)
def outdated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = builds(spark, sf_dir)
    return registries.registry_outdated(log, registries.registry_latest(log))


#: Whole numbers and dates, whose ranges the footers of Parquet files have.
FOOTERS = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_linenumber"]}


@query(
    "footer_facts",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS source, '{column}' AS column_name, count(*) AS "rows",
            count({column}) AS "values", CAST(min({column}) AS VARCHAR) AS low,
            CAST(max({column}) AS VARCHAR) AS high, true AS pushed FROM {name}"""
        for name, columns in FOOTERS.items() for column in columns
    ) + """ UNION ALL SELECT 'shipments', 'day', count(*), count(l_shipdate),
        CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR), CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR), true
        FROM lineitem""",
)
def footer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ranges without reading rows; days are written from the ship dates first."""
    days = f"{scratch(spark, 'shipments')}.parquet"
    table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).write.parquet(days)
    paths = {name: (table_path(sf_dir, name), columns) for name, columns in FOOTERS.items()}
    rows = []
    for name, (path, columns) in (paths | {"shipments": (days, ["day"])}).items():
        found = footer_facts(spark, path, columns)
        rows += [
            (name, column, found.rows, facts.values, str(facts.low), str(facts.high), found.pushed)
            for column, facts in found.columns.items()
        ]
    return spark.createDataFrame(
        rows, "source string, column_name string, rows long, values long, low string, high string, pushed boolean"
    )


@query(
    "content_ledger",
    f"""SELECT step, files, scanned, r.* EXCLUDE (name) FROM ({fingerprint_sql('orders')}) r,
        (VALUES ('first', 3, 3), ('again', 3, 0), ('added', 5, 2), ('removed', 3, 0)) AS s(step, files, scanned)
        WHERE step IN ('added')
        UNION ALL SELECT step, files, scanned, r.* EXCLUDE (name)
        FROM ({fingerprint_sql('orders').replace('FROM orders', 'FROM orders WHERE o_orderkey % 3 <> 0')}) r,
        (VALUES ('first', 3, 3), ('again', 3, 0), ('removed', 3, 0)) AS s(step, files, scanned)""",
)
def ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files that come and go: only new files are read, the hash is that of all rows."""
    path = f"{scratch(spark, 'growing')}.parquet"
    orders = table(spark, sf_dir, "orders")
    late = F.col("o_orderkey") % 3 == 0
    orders.where(~late).repartition(3).write.parquet(path)
    ledger, rows = ContentLedger(spark, scratch(spark, "ledger")), []

    def step(name: str) -> None:
        source = load_source(spark, "orders", path)
        state = ledger.update(source)
        rows.append((name, state.files, state.scanned, state.measures["rows"],
                     fingerprint(source, state.measures)))

    step("first")
    step("again")
    before = set(folders.children(spark, path))
    orders.where(late).repartition(2).write.mode("append").parquet(path)
    step("added")
    for file, _ in set(folders.children(spark, path)) - before:
        if file.startswith("part-"):
            folders.remove(spark, f"{path}/{file}")
    step("removed")
    return spark.createDataFrame(rows, "step string, files int, scanned int, rows long, fingerprint string")
