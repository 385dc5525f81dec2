"""What a build has to know about the rows of a source, measured in one pass.

Row count, data and processing times and the content hash are plain aggregates over the
rows. They can be taken by an aggregate of their own, for many sources in one job; they
can be observed while the rows are written somewhere; and they can be kept per file,
since measures of disjoint rows add up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.csv_text import has_time
from tallyboard.functions.numbers import quoted
from tallyboard.functions.text_types import DATE_TEXT, OFFSET_TEXT, strip, stripped_instant
from tallyboard.operators.identity import PIECES, fingerprint_of, row_pieces, schema_text
from tallyboard.operators.profile import shaped_facts, source_facts
from tallyboard.plans.grouped import free_name
from tallyboard.sources.load import CSV, Source

TIME_FACTS = {
    "min_at": "timestamp", "max_at": "timestamp", "values": "long",
    "datetime": "boolean", "naive": "boolean", "invalid": "long",
}
#: Sums of 16 bits of row hashes stay within 64 bits for 2**47 rows.
HALVES = [f"piece_{piece}_{half}" for piece in range(PIECES) for half in ("high", "low")]
#: Every measure, and how measures of disjoint rows are put together.
MERGES: dict[str, Callable[[Column], Column]] = {
    "rows": F.sum,
    **{
        f"{prefix}_{fact}": {
            "min_at": F.min, "max_at": F.max, "datetime": F.bool_or, "naive": F.bool_or,
        }.get(fact, F.sum)
        for prefix in ("data", "processed") for fact in TIME_FACTS
    },
    **{half: F.sum for half in HALVES},
}
KINDS = {name: TIME_FACTS.get(name.split("_", 1)[-1], "long") for name in MERGES}


def _time_measures(raw: DataFrame, name: str | None, beside: dict[str, Column]) -> dict[str, Column]:
    """Measures of one freshness column; ``beside`` gets the columns they need."""
    if name is None or name not in raw.columns:
        return {fact: F.max(F.lit(None).cast(kind)) for fact, kind in TIME_FACTS.items()}
    column, data_type = F.col(quoted(name)), raw.schema[name].dataType
    if isinstance(data_type, T.StringType):
        text = free_name([*raw.columns, *beside], "text")
        beside[text] = strip(column)
        at = free_name([*raw.columns, *beside], "at")
        beside[at] = stripped_instant(strip(column))
        clock = ~F.col(text).rlike(DATE_TEXT)
        held = F.col(at).isNotNull()
        return {
            "min_at": F.min(at), "max_at": F.max(at),
            "values": F.count(F.when(F.col(text) != "", 1)),
            "datetime": F.bool_or(F.when(held, clock)),
            "naive": F.bool_or(F.when(held, clock & ~F.col(text).rlike(OFFSET_TEXT))),
            "invalid": F.count(F.when((F.col(text) != "") & ~held, 1)),
        }
    timed = isinstance(data_type, T.DateType) or has_time(data_type)
    at = column.cast("timestamp") if timed else F.lit(None).cast("timestamp")
    return {
        "min_at": F.min(at), "max_at": F.max(at), "values": F.count(column),
        "datetime": F.bool_or(F.when(at.isNotNull(), F.lit(has_time(data_type)))),
        "naive": F.bool_or(F.when(column.isNotNull(), F.lit(False))),
        # No other type can hold a date; its values are reported as not parsing.
        "invalid": F.count(F.lit(None) if timed else column),
    }


def measures(source: Source, rows: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The rows of a source with what the measures need beside them, and the measures by name.

    ``rows`` are some rows of the source, perhaps with further columns; else all are taken.
    """
    raw, beside = source.raw if rows is None else rows, {}
    settings = source.freshness
    found: dict[str, Column] = {"rows": F.count(F.lit(1))}
    for prefix, name in (("data", settings.data_time_column), ("processed", settings.processed_time_column)):
        found |= {f"{prefix}_{k}": v for k, v in _time_measures(raw, name, beside).items()}
    pieces = [free_name([*raw.columns, *beside], f"piece_{i}") for i in range(PIECES)]
    beside |= dict(zip(pieces, row_pieces(raw, source.raw.columns), strict=True))
    for number, piece in enumerate(pieces):
        found[f"piece_{number}_high"] = F.sum(F.shiftright(piece, 16))
        found[f"piece_{number}_low"] = F.sum(F.col(piece).bitwiseAND(0xFFFF))
    return raw.withColumns(beside), found


def measured(sources: Iterable[Source]) -> dict[str, dict[str, Any]]:
    """The measures of each source by its name: one row a source, all in one job."""
    frames = []
    for source in sources:
        rows, found = measures(source)
        frames.append(rows.agg(*[value.alias(name) for name, value in found.items()]).select(
            F.lit(source.name).alias("source"), *[F.col(name) for name in MERGES]
        ))
    if not frames:
        return {}
    every = reduce(lambda left, right: left.union(right), frames)
    return {row["source"]: row.asDict() for row in every.collect()}


def observed(source: Source) -> tuple[DataFrame, Observation]:
    """The source's frame, which measures its rows while an action reads them all, once.

    The observation's ``get`` gives the measures after the first action, which has to be one
    without a shuffle, such as a write: its tasks count once each, however often they
    were tried. The frame has the source's columns and types.
    """
    rows, found = measures(source)
    seen = Observation(f"{source.name}-{uuid.uuid4().hex}")
    watched = rows.observe(seen, *[value.alias(name) for name, value in found.items()])
    return source.typed(watched.select(*[quoted(name) for name in source.raw.columns])), seen


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """Measures of disjoint rows, one row each, put together by ``keys``."""
    return states.groupBy(*keys).agg(*[merge(F.col(name)).alias(name) for name, merge in MERGES.items()])


def fingerprint(source: Source, found: Mapping[str, Any]) -> str:
    """The fingerprint of the source's rows, as ``table_fingerprint`` gives it."""
    sums = [
        (found[f"piece_{i}_high"] or 0) * 65536 + (found[f"piece_{i}_low"] or 0) for i in range(PIECES)
    ]
    return fingerprint_of(schema_text(source.raw, source.raw.columns), found["rows"] or 0, sums)


def facts(source: Source, found: Mapping[str, Any]) -> DataFrame:
    """The row of ``source_facts``, from measures; the rows of the source are not read again.

    Only a CSV source whose types were given when it was loaded has to be read for them.
    """
    if source.format == CSV and source.columns is None:
        return source_facts(source)
    kinds = {name: kind for name, kind in KINDS.items() if name not in HALVES}
    settings, columns = source.freshness, source.raw.columns
    # Counts of a column that is there are numbers, those of one that is not are NULL.
    there = {"rows": True, "data": settings.data_time_column in columns,
             "processed": settings.processed_time_column in columns}
    values = tuple(
        (found[name] or 0) if kind == "long" and there[name.split("_")[0]] else found[name]
        for name, kind in kinds.items()
    )
    local = source.raw.sparkSession.createDataFrame(
        [values], ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
    )
    return shaped_facts(source, local)
