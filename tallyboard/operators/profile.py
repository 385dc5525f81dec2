"""Source profiles: types, windows, freshness and the check table.

Everything about one source comes from one aggregate over its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.numbers import quoted
from tallyboard.functions.csv_text import has_time
from tallyboard.functions.text_types import TEXT_FACTS, kind_of_bits, text_facts, type_of_bits
from tallyboard.sources.footers import footer_facts
from tallyboard.sources.load import CSV, ContractError, Source
from tallyboard.sources.ragged import LONG, SHORT

PASSED, WARNING, FAILED = "passed", "warning", "failed"
CHECK_SCHEMA = "name string, status string, message string, source string"


def leaf_types(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Dotted leaf columns of a typed schema with the type names of a profile."""
    found: dict[str, str] = {}
    for field in schema.fields:
        found.update(_leaves(f"{prefix}{field.name}", field.dataType))
    return found


def _leaves(path: str, data_type: T.DataType) -> dict[str, str]:
    # Lists and maps add the group names that Parquet puts round their elements.
    if isinstance(data_type, T.StructType):
        return leaf_types(data_type, f"{path}.")
    if isinstance(data_type, T.ArrayType):
        return _leaves(f"{path}.list.element", data_type.elementType)
    if isinstance(data_type, T.MapType):
        return {
            **_leaves(f"{path}.key_value.key", data_type.keyType),
            **_leaves(f"{path}.key_value.value", data_type.valueType),
        }
    return {path: type_name(data_type)}


def type_name(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DateType) or has_time(data_type):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "number"
    return "string"


def infer_text_types(text: DataFrame) -> DataFrame:
    """(column_name, inferred_type) of text columns, from one pass."""
    return text_facts(text, text.columns).select(
        "column_name", type_of_bits(F.col("bits")).alias("inferred_type")
    )


def schema_types(source: Source) -> DataFrame:
    """(column_name, inferred_type) of a typed schema; no data is read."""
    rows = list(leaf_types(source.frame.schema).items())
    return source.frame.sparkSession.createDataFrame(
        rows, "column_name string, inferred_type string"
    )


def _present(value: Column, data_type: T.DataType) -> list[Column]:
    """Number of non-NULL values of each leaf below a value, in schema order."""
    if isinstance(data_type, T.StructType):
        fields = data_type.fields
        return [n for f in fields for n in _present(value.getField(f.name), f.dataType)]
    if isinstance(data_type, T.ArrayType):
        return _present_in(value, data_type.elementType)
    if isinstance(data_type, T.MapType):
        return [
            *_present_in(F.map_keys(value), data_type.keyType),
            *_present_in(F.map_values(value), data_type.valueType),
        ]
    return [F.count(value)]


def _field_of(name: str) -> Callable[[Column], Column]:
    return lambda item: item.getField(name)


def _present_in(items: Column, data_type: T.DataType) -> list[Column]:
    """The same for the items of an array."""
    if isinstance(data_type, T.StructType):
        return [
            count
            for field in data_type.fields
            for count in _present_in(F.transform(items, _field_of(field.name)), field.dataType)
        ]
    if isinstance(data_type, T.ArrayType):
        return _present_in(F.flatten(F.array_compact(items)), data_type.elementType)
    if isinstance(data_type, T.MapType):
        maps = F.array_compact(items)
        keys = F.flatten(F.transform(maps, lambda item: F.map_keys(item)))
        values = F.flatten(F.transform(maps, lambda item: F.map_values(item)))
        return [*_present_in(keys, data_type.keyType), *_present_in(values, data_type.valueType)]
    return [F.coalesce(F.sum(F.size(F.array_compact(items)).cast("long")), F.lit(0))]


def leaf_profile(source: Source) -> DataFrame:
    """(column_name, inferred_type, values) per leaf column, counted in one pass."""
    leaves = leaf_types(source.frame.schema)
    counts = [
        count
        for field in source.frame.schema.fields
        for count in _present(F.col(quoted(field.name)), field.dataType)
    ]
    counted = source.frame.agg(*[count.alias(f"n{i}") for i, count in enumerate(counts)])
    rows = [
        F.struct(
            F.lit(name).alias("column_name"), F.lit(kind).alias("inferred_type"),
            F.col(f"n{i}").alias("values"),
        )
        for i, (name, kind) in enumerate(leaves.items())
    ]
    return counted.select(F.inline(F.array(*rows)))


_FACTS = {
    "min_at": "timestamp", "max_at": "timestamp", "values": "long",
    "datetime": "boolean", "naive": "boolean", "invalid": "long",
}


def _typed_time(source: Source, prefix: str, name: str) -> list[Column]:
    """Facts of a freshness column that holds dates or timestamps."""
    column, data_type = F.col(quoted(name)), source.raw.schema[name].dataType
    timed = isinstance(data_type, T.DateType) or has_time(data_type)
    at = column.cast("timestamp") if timed else F.lit(None).cast("timestamp")
    # No other type can hold a date; its values are reported as not parsing.
    facts = {
        "min_at": F.min(at), "max_at": F.max(at), "values": F.count(column),
        "datetime": F.when(F.count(at) > 0, has_time(data_type)),
        "naive": F.lit(False),
        "invalid": F.lit(0).cast("long") if timed else F.count(column),
    }
    return [value.alias(f"{prefix}_{fact}") for fact, value in facts.items()]


def _text_time(prefix: str, name: str) -> list[Column]:
    """The same facts, picked from the per-column rows of ``text_facts``."""
    mine = F.col("column_name") == name
    return [F.max(F.when(mine, F.col(fact))).alias(f"{prefix}_{fact}") for fact in _FACTS]


def _absent(prefix: str) -> list[Column]:
    return [F.lit(None).cast(kind).alias(f"{prefix}_{fact}") for fact, kind in _FACTS.items()]


def _footer_facts(source: Source, times: Mapping[str, str]) -> DataFrame:
    """Row count and facts of date columns from the footers of a Parquet source."""
    spark = source.raw.sparkSession
    found = footer_facts(spark, source.path, list(dict.fromkeys(times.values())))
    values: list[Any] = [found.rows]
    for name in times.values():
        column = found.columns[name]
        values += [column.low, column.high, column.values, False if column.values else None, False, 0]
    kinds = [f"{p}_{fact} {'date' if fact.endswith('_at') else kind}"
             for p in times for fact, kind in _FACTS.items()]
    local = spark.createDataFrame([tuple(values)], ", ".join(["rows long", *kinds]))
    return local.select(*[
        F.col(name).cast("timestamp").alias(name) if name.endswith("_at") else F.col(name)
        for name in local.columns
    ])


def source_facts(source: Source, with_types: bool = True) -> DataFrame:
    """One row with everything the passport and the checks need, from one pass.

    A CSV source that was profiled when it was loaded is not read again. The rows of a Parquet
    source are not read at all if its freshness columns are dates or none are set: counts
    and ranges come from the footers, as far as all files have statistics.
    """
    raw, settings = source.raw, source.freshness
    configured = {
        "data": settings.data_time_column, "processed": settings.processed_time_column,
    }
    times = {p: c for p, c in configured.items() if c in raw.columns}
    texts = [c for c in times.values() if isinstance(raw.schema[c].dataType, T.StringType)]
    inferred = with_types and source.format == CSV
    in_footers = source.in_files and all(
        isinstance(raw.schema[c].dataType, T.DateType) for c in times.values()
    )
    if in_footers:
        facts = _footer_facts(source, times)
    elif inferred or (texts and len(texts) == len(times)):
        # Every column of interest is text.
        names = list(raw.columns) if inferred else list(dict.fromkeys(texts))
        columns = (
            text_facts(raw, names, list(dict.fromkeys(texts))) if source.columns is None
            else raw.sparkSession.createDataFrame(list(source.columns), TEXT_FACTS)
        )
        kinds = F.map_from_entries(
            F.collect_list(F.struct("column_name", type_of_bits(F.col("bits")).alias("kind")))
        )
        facts = columns.agg(
            F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
            *([kinds.alias("kinds")] if inferred else []),
            *[fact for p, c in times.items() for fact in _text_time(p, c)],
        )
    else:
        typed = {p: c for p, c in times.items() if c not in texts}
        facts = raw.agg(
            F.count(F.lit(1)).alias("rows"),
            *[fact for p, c in typed.items() for fact in _typed_time(source, p, c)],
        )
        if texts:
            side = text_facts(raw, texts, texts).agg(
                *[fact for p, c in times.items() if c in texts for fact in _text_time(p, c)]
            )
            facts = facts.join(F.broadcast(side), F.lit(True))
    facts = facts.select("*", *[c for p in configured if p not in times for c in _absent(p)])
    return shaped_facts(source, facts, inferred)


def shaped_facts(source: Source, facts: DataFrame, inferred: bool = False) -> DataFrame:
    """The row of ``source_facts`` from counts, times and, if ``inferred``, the text types (kinds).

    Otherwise types come from the schema, or from what loading a CSV source found.
    """
    raw, configured = source.raw, ("data", "processed")
    leaves = dict.fromkeys(raw.columns, "null") if inferred else leaf_types(source.frame.schema)
    if not inferred and source.format == CSV and source.columns is not None:
        found = {row.column_name: kind_of_bits(row.bits) for row in source.columns}
        leaves = {name: found.get(name, "null") for name in raw.columns}
    types = {
        name: F.coalesce(F.try_element_at("kinds", F.lit(name)), F.lit(kind))
        if inferred else F.lit(kind)
        for name, kind in leaves.items()
    }
    pairs = [item for name, kind in types.items() for item in (F.lit(name), kind)]

    def granularity(prefix: str) -> Column:
        clock = F.col(f"{prefix}_datetime")
        return F.when(clock, "datetime").when(~clock, "date")

    naive = [
        (F.coalesce(f"{p}_naive", F.lit(False)) & F.lit(source.format == CSV)).alias(f"{p}_naive")
        for p in configured
    ]
    return facts.select(
        F.lit(source.name).alias("name"),
        F.lit(source.format).alias("source_format"),
        "rows",
        F.lit(len(types)).alias("columns"),
        F.array(*[F.lit(name) for name in types]).alias("column_names"),
        F.create_map(*pairs).alias("inferred_column_types"),
        F.col("data_min_at"),
        F.col("data_max_at"),
        granularity("data").alias("data_time_granularity"),
        F.col("processed_max_at").alias("processed_at"),
        granularity("processed").alias("processed_time_granularity"),
        *[f"{p}_{fact}" for p in configured for fact in ("values", "invalid")],
        *naive,
    )


def lag_hours(built_at: datetime, data_max: Column) -> Column:
    if built_at.tzinfo is None:
        raise ValueError("built_at needs a time zone")
    micros = F.unix_micros(F.lit(built_at)) - F.unix_micros(data_max)
    return micros / F.lit(3.6e9)


def freshness_status(source: Source, built_at: datetime) -> Column:
    limit = source.freshness.max_lag_hours
    if limit is None:
        return F.lit(PASSED)
    late = lag_hours(built_at, F.col("data_max_at")) > F.lit(float(limit))
    return F.when(late, WARNING).otherwise(PASSED)


def passport(source: Source, built_at: datetime, facts: DataFrame | None = None) -> DataFrame:
    """One row of profile facts; a build adds the file name, size and hash."""
    found = source_facts(source) if facts is None else facts
    return found.select(
        "name", "source_format", "rows", "columns", "column_names", "inferred_column_types",
        F.lit(built_at).alias("loaded_into_report_at"),
        "data_min_at", "data_max_at", "data_time_granularity",
        "processed_at", "processed_time_granularity",
        freshness_status(source, built_at).alias("freshness_status"),
    )


def source_window(source: Source) -> DataFrame:
    """Data window, processed time and their granularities."""
    return source_facts(source, with_types=False).select(
        "name", "data_min_at", "data_max_at", "data_time_granularity",
        "processed_at", "processed_time_granularity",
    )


def _check(name: str, status: Column | str, message: Column | str | None, source: Source) -> Column:
    shown = F.lit(status) if isinstance(status, str) else status
    return F.struct(
        F.lit(name).alias("name"),
        shown.alias("status"),
        (message if isinstance(message, Column) else F.lit(message).cast("string")).alias("message"),
        F.lit(source.name).alias("source"),
    )


def data_checks(source: Source, built_at: datetime, facts: DataFrame | None = None) -> DataFrame:
    """The check rows of one source: passed, warning, or failed."""
    settings = source.freshness
    columns = list(source.raw.columns)
    missing = [name for name in sorted(settings.columns()) if name not in columns]
    found = source_facts(source, with_types=False) if facts is None else facts

    failures = [
        F.when(F.col("rows") == 0, _check("has_rows", FAILED, "the source is empty", source)),
    ]
    if len(columns) != len(set(columns)):
        failures.append(_check("unique_columns", FAILED, "a column name occurs twice", source))
    if missing:
        text = "the source lacks its freshness columns " + ", ".join(missing)
        failures.append(_check("freshness_columns", FAILED, text, source))
    named = {"data": settings.data_time_column, "processed": settings.processed_time_column}
    present = {prefix: column for prefix, column in named.items() if column in columns}
    for prefix, column in present.items():
        invalid = F.col(f"{prefix}_invalid")
        failures += [
            F.when(
                (F.col("rows") > 0) & (F.col(f"{prefix}_values") == 0),
                _check("freshness_values", FAILED, f"{column!r} is empty in every row", source),
            ),
            F.when(
                invalid > 0,
                _check(
                    "freshness_parse", FAILED,
                    F.format_string(f"{column!r} holds %d values that are no ISO 8601 times", invalid),
                    source,
                ),
            ),
        ]
    checks = [
        # Both freshness settings may name one column; it is warned about once.
        *[
            F.when(
                reduce(lambda a, b: a | b, [F.col(f"{p}_naive") for p, c in present.items() if c == column]),
                _check("timezone_assumed", WARNING, f"times of {column} without an offset count as UTC", source),
            )
            for column in sorted(set(present.values()))
        ],
    ]
    # Rows that do not fit the header are read all the same, so their numbers are no warning.
    for kind, done in ((SHORT, "fewer cells than the header; missing ones are NULL"),
                       (LONG, "more cells than the header; further ones are dropped")):
        if source.ragged.get(kind):
            text = f"rows with {done}: {source.ragged[kind]}"
            checks.append(_check(kind, PASSED, text, source))
    limit = settings.max_lag_hours
    if limit is not None and "data" in present:
        lag = lag_hours(built_at, F.col("data_max_at"))
        late = lag > F.lit(float(limit))
        message = F.when(
            late, F.format_string(f"newest data is %.1f hours back, {limit:g} hours are allowed", lag)
        )
        checks.append(
            F.when(
                F.col("data_max_at").isNotNull(),
                _check("data_freshness", F.when(late, WARNING).otherwise(PASSED), message, source),
            )
        )
    failed = F.array_compact(F.array(*failures))
    valid = F.when(
        F.size(failed) == 0, _check(f"{source.format}_valid", PASSED, None, source)
    )
    every = F.concat(failed, F.array_compact(F.array(valid, *checks)))
    return found.select(F.inline(every))


def timezone_check(frame: DataFrame, timezone: str | None) -> DataFrame:
    """The warning for a report without a time zone; no row when one is set."""
    rows = [] if timezone else [
        ("report_timezone_defaulted", WARNING, "no report time zone is set; UTC is used", None)
    ]
    return frame.sparkSession.createDataFrame(rows, CHECK_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def facts_of(sources: Iterable[Source], with_types: bool = True) -> dict[str, DataFrame]:
    """The row of ``source_facts`` of each source by its name, as local rows of one job."""
    every = union_all([source_facts(source, with_types) for source in sources])
    return {
        row["name"]: every.sparkSession.createDataFrame([row], every.schema) for row in every.collect()
    }


def require_passed(checks: DataFrame) -> None:
    """Raise when any check failed; there are a few rows per source at most."""
    failed = checks.where(F.col("status") == FAILED).orderBy("source", "name").collect()
    if failed:
        raise ContractError("; ".join(f"source {row.source}: {row.message}" for row in failed))
