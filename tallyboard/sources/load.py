"""CSV and Parquet sources as named tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions.numbers import quoted
from tallyboard.functions.text_types import TYPE_BITS, text_facts, typed_value
from tallyboard.sources.ragged import LONG, SHORT, quarantine, ragged_counts

CSV, PARQUET = "csv", "parquet"
# A line is whole when every quoted field on it is closed and followed by a comma
# or the end. Possessive quantifiers keep the match linear on long lines.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^",][^,]*+|)'
WHOLE_LINE = rf"^{_FIELD}(?:,{_FIELD})*+$"
# What a line does when a quoted field reaches into it, and when one reaches out of it.
_QUOTED = r'(?:[^"]++|"")*+'
CLOSES = rf'^{_QUOTED}"(?:,{_FIELD})*+$'
STAYS_OPEN = rf"^{_QUOTED}$"
REOPENS = rf'^{_QUOTED}"(?:,{_FIELD})*+,"{_QUOTED}$'
OPENS = rf'^(?:{_FIELD},)*+"{_QUOTED}$'
# A line, a split or a file maps "outside" and "inside" to what holds at its end: bit 0
# says whether it ends inside after a start outside, bit 1 after a start inside.
UNCHANGED = 2


class ContractError(ValueError):
    """A source that breaks the contract of its format or of its freshness setting."""


@dataclass(frozen=True)
class Freshness:
    data_time_column: str | None = None
    processed_time_column: str | None = None
    max_lag_hours: float | None = None

    def columns(self) -> list[str]:
        return list(filter(None, (self.data_time_column, self.processed_time_column)))


@dataclass(frozen=True)
class Source:
    """A named table. ``frame`` is what queries read; ``raw`` is what is profiled:
    the same frame for Parquet, the untyped text columns for CSV. ``columns`` are
    the facts of the text columns, one row each, if loading already found them;
    ``bits`` are the classes that the columns of ``frame`` were typed by, ``ragged`` the
    numbers of CSV rows that do not fit the header."""

    name: str
    format: str
    frame: DataFrame
    raw: DataFrame
    path: str | None = None
    freshness: Freshness = field(default_factory=Freshness)
    columns: tuple[Row, ...] | None = None
    bits: Mapping[str, int] | None = None
    ragged: Mapping[str, int] = field(default_factory=dict)

    @property
    def in_files(self) -> bool:
        """Whether the rows are all those of Parquet files, as they are."""
        return self.format == PARQUET and self.path is not None and self.frame is self.raw

    def typed(self, raw: DataFrame) -> DataFrame:
        """Rows of ``raw``, as the columns of ``frame``."""
        if self.frame is self.raw:
            return raw
        if self.bits is None:
            raise ValueError(f"source {self.name}: no types are known for its raw rows")
        return typed_frame(raw, self.bits)


def source_format(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in (CSV, PARQUET):
        raise ContractError(f"a source path ends in .csv or .parquet, not {path!r}")
    return suffix


def csv_lines(spark: SparkSession, path: str, columns: int = 0) -> DataFrame:
    """Facts about the raw lines: bad UTF-8, lines that do not end their record, ragged ones."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.agg(
        F.coalesce(F.bool_or(~F.is_valid_utf8("line")), F.lit(False)).alias("bad_utf8"),
        F.coalesce(F.bool_or(~F.col("line").rlike(WHOLE_LINE)), F.lit(False)).alias("open_lines"),
        *ragged_counts(F.col("line"), columns),
    )


def _after(first: Column, then: Column) -> Column:
    """The mapping of two stretches of text, one after the other."""

    def end(start: int) -> Column:
        between = F.shiftright(first, start).bitwiseAND(1)
        return F.when(between == 1, F.shiftright(then, 1)).otherwise(then).bitwiseAND(1)

    return end(0).bitwiseOR(F.shiftleft(end(1), 1))


def _folded(pieces: str) -> Column:
    """The mapping of ordered pieces, (place, mapping) structs."""
    return F.aggregate(
        F.array_sort(F.collect_list(pieces)), F.lit(UNCHANGED),
        lambda whole, piece: _after(whole, piece["mapping"]),
    )


def open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field is never closed in some file of any size.

    Lines are folded into a mapping per split, where they are in order, and the splits
    of a file into one. Only lines with quotes take part, and a split has a bounded
    number of them.
    """
    line = F.col("value")
    outside = F.when(line.rlike(WHOLE_LINE), 0).when(line.rlike(OPENS), 1).otherwise(0)
    inside = F.when(line.rlike(CLOSES), 0).when(
        line.rlike(STAYS_OPEN) | line.rlike(REOPENS), 2
    ).otherwise(0)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("place"),
    )
    splits = (
        lines.where(line.contains('"'))
        .select("file", "start", F.struct("place", (outside + inside).alias("mapping")).alias("piece"))
        .groupBy("file", "start").agg(_folded("piece").alias("mapping"))
    )
    files = splits.select(
        "file", F.struct(F.col("start").alias("place"), "mapping").alias("piece")
    ).groupBy("file").agg(_folded("piece").alias("mapping"))
    return not files.where(F.col("mapping").bitwiseAND(1) == 1).isEmpty()


def csv_header(spark: SparkSession, path: str, multiline: bool = False) -> list[str]:
    """Cells of the first row of a source, as written."""
    cells = (
        spark.read.option("escape", '"').option("multiLine", multiline)
        .csv(path, header=False)
        .where(F.col("_metadata.file_block_start") == 0)
        .limit(1)
        .collect()
    )
    return [] if not cells else [cell or "" for cell in cells[0]]


def header_problem(columns: list[str]) -> str | None:
    """What is wrong with a header, or None."""
    names = [column.strip() for column in columns]
    repeated = sorted({name for name in columns if columns.count(name) > 1})
    if not names:
        return "the file has no header line"
    if "" in names:
        return f"column {names.index('') + 1} has no name"
    return f"columns named twice: {', '.join(repeated)}" if repeated else None


@dataclass(frozen=True)
class CsvText:
    """An open CSV source: its columns as text, its header, whether records span lines, and how
    many rows have fewer or more cells than the header."""

    frame: DataFrame
    columns: list[str]
    spans: bool
    ragged: dict[str, int]


def open_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> CsvText:
    """All columns as text; short rows end in NULLs, extra cells are dropped.

    One pass over the lines checks the encoding, counts ragged rows, and finds out whether a
    record spans lines; where it does, quotes must close, and a file is one task.
    ``multiline`` tells the reader so for files whose lines do not show it.
    """
    spans = bool(multiline)
    columns = csv_header(spark, path, spans)
    facts = csv_lines(spark, path, len(columns)).first()
    if facts["bad_utf8"]:
        raise ContractError(f"{path} is not UTF-8")
    if facts["open_lines"] and open_quotes(spark, path):
        raise ContractError(f"{path}: a quoted field is not closed")
    if facts["open_lines"] and not spans:
        spans, columns = True, csv_header(spark, path, True)
    problem = header_problem(columns)
    if problem:
        raise ContractError(f"{path}: {problem}")
    if spans:
        # Lines are no records here; the reader's own pass counts them.
        kinds = quarantine(spark, path, columns, spans).groupBy("kind").count().collect()
        ragged = {row["kind"]: row["count"] for row in kinds}
    else:
        ragged = {kind: facts[kind] for kind in (SHORT, LONG) if facts[kind]}
    return CsvText(csv_reader(spark, columns, spans).csv(path), columns, spans, ragged)


def csv_reader(spark: SparkSession, columns: list[str], spans: bool) -> DataFrameReader:
    """The reader of CSV text with the given header; ``spans`` where records span lines."""
    schema = ", ".join(f"{quoted(column)} string" for column in columns)
    return (
        spark.read.schema(schema)
        .option("header", True)
        # Every further file of the source must have the same header.
        .option("enforceSchema", False)
        .option("escape", '"')
        # Text after a closing quote fails the read; a row of another length does not.
        .option("unescapedQuoteHandling", "RAISE_ERROR")
        .option("multiLine", spans)
        .option("mode", "PERMISSIVE")
    )


def typed_frame(text: DataFrame, bits: Mapping[str, int]) -> DataFrame:
    """Text columns cast to the types that all their values share."""
    return text.select(
        *[typed_value(F.col(quoted(name)), bits.get(name, 0)).alias(name) for name in text.columns]
    )


def load_source(
    spark: SparkSession,
    name: str,
    path: str,
    *,
    freshness: Freshness | None = None,
    multiline: bool | None = None,
    column_types: Mapping[str, str] | None = None,
) -> Source:
    """Open a source; the path's suffix names the format.

    A CSV source is read once for its line structure and once for its column
    types, and the second pass finds the profile as well. ``column_types``, as an
    earlier passport has them, spare the second.
    """
    settings = freshness or Freshness()
    if source_format(path) == PARQUET:
        frame = spark.read.parquet(path)
        return Source(name, PARQUET, frame, frame, path, settings)
    opened = open_csv(spark, path, multiline)
    text = opened.frame
    if column_types is not None:
        bits = {column: TYPE_BITS.get(kind, 0) for column, kind in column_types.items()}
        return Source(name, CSV, typed_frame(text, bits), text, path, settings, None, bits, opened.ragged)
    times = [column for column in dict.fromkeys(settings.columns()) if column in text.columns]
    # One row per column; there is none when the source has no rows.
    columns = tuple(text_facts(text, text.columns, times).collect())
    bits = {row.column_name: row.bits for row in columns}
    return Source(name, CSV, typed_frame(text, bits), text, path, settings, columns, bits, opened.ragged)


def table_source(name: str, frame: DataFrame, freshness: Freshness | None = None) -> Source:
    """A source from a DataFrame that is already typed."""
    return Source(name, PARQUET, frame, frame, None, freshness or Freshness())


def register(sources: Iterable[Source]) -> list[str]:
    """Make each source a temporary view of its name."""
    names = []
    for source in sources:
        source.frame.createOrReplaceTempView(source.name)
        names.append(source.name)
    return names


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, name, length, time of change. File contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length",
                F.col("modificationTime").alias("changed_at"))
    )
