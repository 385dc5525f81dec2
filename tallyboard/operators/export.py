"""The visible data of an output, and its CSV form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.csv_text import cell_text, quote_cell
from tallyboard.operators.series import effective_series
from tallyboard.operators.stack import MODES, stack_normalize
from tallyboard.operators.table import table_projection
from tallyboard.plans.grouped import free_name

TABLE, LINE, BAR, HEATMAP = "table", "line", "bar", "heatmap"


@dataclass(frozen=True)
class Output:
    """What an output shows of its query."""

    kind: str
    columns: Sequence[str] = ()
    x: str | None = None
    y: str | None = None
    value: str | None = None
    group: str | None = None
    color: str | None = None
    stack: str = "zero"
    row_metric: str | None = None
    details: Sequence[str] = ()
    temporal: bool = False

    def requested(self) -> list[str]:
        if self.kind == HEATMAP:
            wanted = [self.x, self.y, self.value, self.row_metric, *self.details]
        else:
            wanted = [self.x, self.y, effective_series(self.group, self.color), *self.details]
        return [name for name in dict.fromkeys(wanted) if name]


def visible_columns(rows: DataFrame, output: Output) -> list[str]:
    """What an output shows: a table its own list, a chart the query's columns it asks for.

    Columns that the query lacks are shown too, as NULL, after the others.
    """
    if output.kind == TABLE:
        return list(output.columns) or rows.columns
    asked = output.requested()
    there = set(rows.columns)
    return sorted(asked, key=lambda name: rows.columns.index(name) if name in there else len(there))


def visible_data(rows: DataFrame, output: Output) -> DataFrame:
    """The shown columns; a normalised bar has its share right of the value."""
    shown = visible_columns(rows, output)
    if output.kind != BAR or output.stack not in MODES:
        return table_projection(rows, shown)
    share = free_name([*rows.columns, *shown], f"{output.y}_normalized")
    shared = stack_normalize(
        rows, output.x, output.y, output.stack, into=share, temporal=output.temporal
    )
    with_share = [column for name in shown for column in ([name, share] if name == output.y else [name])]
    return table_projection(shared, with_share)


def csv_lines(rows: DataFrame, into: str = "line") -> DataFrame:
    """Rows as finished CSV lines."""
    return rows.select(
        F.concat_ws(",", *[quote_cell(cell_text(rows, name)) for name in rows.columns]).alias(into)
    )


def write_csv(
    rows: DataFrame, path: str, *, byte_order_mark: bool = True, mode: str = "errorifexists"
) -> None:
    """Part files that each are a whole CSV: mark, header, lines ending in CRLF.

    The finished lines go through the text writer; the CSV writer would turn the
    line breaks inside cells into CRLF as well. The header is put before the first
    row of each task, which writes one file. A result without rows becomes one part
    with mark and header alone.
    """
    names = rows.sparkSession.createDataFrame([tuple(rows.columns)], _text_schema(rows.columns))
    header = csv_lines(names).first()[0]
    start = ("\ufeff" if byte_order_mark else "") + header + "\r\n"
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.when(in_task == 0, F.concat(F.lit(start), F.col("line"))).otherwise(F.col("line"))
    (
        csv_lines(rows).select(line.alias("line")).write.mode(mode)
        .option("lineSep", "\r\n").option("maxRecordsPerFile", 0).text(path)
    )
    spark = rows.sparkSession
    if spark.read.text(path).isEmpty():
        alone = spark.createDataFrame([(start.removesuffix("\r\n"),)], "line string").coalesce(1)
        alone.write.mode("append").option("lineSep", "\r\n").text(path)


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
