"""Visible data of outputs and their CSV text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import query, scratch, table
from catalog.shapes import COHORT_SQL, STATUS_SQL, by_status, cohorts, normalize_sql
from tallyboard.functions.csv_text import guard_formula
from tallyboard.operators.export import BAR, HEATMAP, LINE, Output, csv_lines, visible_data, write_csv
from tallyboard.operators.stack import STANDARD


@query("export_line", f"SELECT month, status, revenue, NULL::VARCHAR AS absent FROM ({STATUS_SQL})", dates=("month",))
def export_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_status(spark, sf_dir).withColumn("hidden", F.lit("x"))
    output = Output(LINE, x="month", y="revenue", group="status", details=["absent"])
    return visible_data(rows, output)


@query(
    "export_bar_normalized",
    f"""SELECT month, status, revenue, share AS revenue_normalized
        FROM ({normalize_sql(STATUS_SQL, 'sum(revenue)')})""",
    dates=("month",),
)
def export_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = Output(BAR, x="month", y="revenue", group="status", stack=STANDARD)
    shown = visible_data(by_status(spark, sf_dir), output)
    return shown.withColumn("revenue_normalized", F.round("revenue_normalized", 9))


@query(
    "export_heatmap",
    f"""{COHORT_SQL} SELECT cohort_month, period_number, cohort_size, retained, retention FROM frame""",
    dates=("cohort_month",),
)
def export_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohorts(spark, sf_dir).withColumn("hidden", F.lit("x"))
    output = Output(
        HEATMAP, x="period_number", y="cohort_month", value="retention",
        row_metric="cohort_size", details=["retained"],
    )
    return visible_data(rows, output)


def quoted_sql(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '[",\\r\\n]')
        THEN '"' || replace({text}, '"', '""') || '"' ELSE {text} END"""


GUARDED = "CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END"


@query(
    "export_csv_text",
    f"""SELECT doc_id || ',' || {quoted_sql(f"({GUARDED})")} || ',' || lang || ','
               || coalesce(CAST(quality AS VARCHAR), '') AS line
        FROM documents LEFT JOIN labels USING (doc_id)""",
)
def export_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return csv_lines(rows.select("doc_id", "text", "lang", "quality"))


@query(
    "write_csv_roundtrip",
    f"""SELECT doc_id, {GUARDED} AS text, coalesce(lang, '') AS "the, lang" FROM documents
       UNION ALL SELECT NULL, 'every part has a header', 'none'""",
)
def write_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written bytes read back: mark, header, CRLF and quoting included."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("the, lang")
    )
    path = scratch(spark, "export")
    write_csv(rows, path)
    start = '\ufeffdoc_id,text,"the, lang"\r\n'
    parts = spark.read.format("binaryFile").load(path).where("length > 0")
    head = F.substring("content", 1, len(start.encode())).cast("string")
    note = parts.agg(F.bool_and(head == start).alias("fine")).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.when(F.col("fine"), "every part has a header").alias("text"),
        F.lit("none").alias("the, lang"),
    )
    back = (
        spark.read.schema("doc_id long, text string, lang string")
        .option("header", True).option("multiLine", True).option("escape", '"')
        .option("lineSep", "\r\n").csv(path)
    )
    return back.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("lang", F.lit("")).alias("the, lang"),
    ).unionByName(note)


@query(
    "formula_guard",
    """SELECT doc_id, CASE WHEN source = 'wiki' OR lang = 'en' THEN '''=' || text
          ELSE CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END
          END AS cell FROM documents""",
)
def formula_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    risky = (F.col("source") == "wiki") | (F.col("lang") == "en")
    text = F.when(risky, F.concat(F.lit("="), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", guard_formula(text).alias("cell"))
