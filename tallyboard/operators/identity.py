"""Content hashes of sources and the identity of a report build."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.csv_text import has_time, is_nested
from tallyboard.functions.numbers import field_type, quoted

# A multiset of rows is hashed as sums over pieces of its row hashes, so that row
# order and partitioning do not matter: four pieces of 32 bits.
PIECES = 4


def _canonical(frame: DataFrame, name: str) -> Column:
    """Text of a value; its length in front keeps neighbouring cells apart."""
    column, data_type = F.col(quoted(name)), field_type(frame, name)
    if has_time(data_type):
        text = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif is_nested(data_type):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    else:
        text = column.cast("string")
    sized = F.concat(F.char_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def row_pieces(frame: DataFrame, names: Sequence[str]) -> list[Column]:
    """The first pieces of the hash of every row, numbers of 32 bits."""
    digest = F.sha2(F.concat_ws("|", *[_canonical(frame, name) for name in names]), 256)
    return [
        F.conv(F.substring(digest, 1 + 8 * piece, 8), 16, 10).cast("long") for piece in range(PIECES)
    ]


def _summed(pieces: DataFrame) -> DataFrame:
    """One row: the number of rows and the sums of their pieces (piece_0, ...).

    Sums run as 64-bit integers within a task, where two billion rows fit, and as
    decimals over the tasks, where they cannot overflow.
    """
    per_task = pieces.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"piece_{i}").alias(f"piece_{i}") for i in range(PIECES)],
    )
    return per_task.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[
            F.coalesce(F.sum(F.col(f"piece_{i}").cast("decimal(28,0)")), F.lit(0))
            .cast("string").alias(f"piece_{i}")
            for i in range(PIECES)
        ],
    )


def fingerprint_of(schema: str, rows: int, sums: Sequence[int]) -> str:
    """The fingerprint of a table from its schema text, row count and sums of pieces."""
    return hashlib.sha256("|".join([schema, str(rows), *map(str, sums)]).encode()).hexdigest()


def schema_text(frame: DataFrame, columns: Sequence[str]) -> str:
    """Names and types of the columns, lengths in front of the names."""
    return ",".join(
        f"{len(name)}:{name} {field_type(frame, name).simpleString()}" for name in columns
    )


def table_fingerprint(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(rows, fingerprint) of a table as a schema and a multiset of rows, in one pass.

    Partition values, column names and types count; row order and the cut into
    files do not.
    """
    names = list(columns or frame.columns)
    pieces = [piece.alias(f"piece_{i}") for i, piece in enumerate(row_pieces(frame, names))]
    sums = _summed(frame.select(*pieces))
    pieces = [F.col(f"piece_{i}") for i in range(PIECES)]
    folded = F.concat_ws("|", F.lit(schema_text(frame, names)), F.col("n").cast("string"), *pieces)
    return sums.select(F.col("n").alias("rows"), F.sha2(folded, 256).alias("fingerprint"))


def content_identity(
    hashes: DataFrame, slug: str, definition_sha256: str, tool_version: str, runtime_version: str
) -> DataFrame:
    """(artifact_id, content_sha256) from (name, sha256) rows, one per source.

    The hash covers canonical JSON with sorted keys; the build time is left out,
    so rebuilding the same content gives the same id.
    """
    pairs = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    content = hashes.agg(F.map_from_entries(pairs).alias("sources")).select(
        F.sha2(
            F.to_json(
                F.struct(
                    F.lit(definition_sha256).alias("report_source_sha256"),
                    F.lit(runtime_version).alias("runtime_version"),
                    "sources",
                    F.lit(tool_version).alias("tool_version"),
                )
            ),
            256,
        ).alias("content_sha256")
    )
    short = F.substring("content_sha256", 1, 12)
    return content.select(
        F.concat(F.lit(f"{slug}__"), short).alias("artifact_id"), "content_sha256"
    )
