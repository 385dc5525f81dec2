"""Shards that each match the mixture of sources.

Proportional stratified interleaving: the rows of every source are shuffled by a
seeded hash and ranked; a row's fraction is (rank + 1/2) / rows of its source; all
rows are sorted by fraction and the sorted sequence is cut into shards of equal
row counts. A source with a share p of the rows has a share p of every stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import ranked

SEED = "interleave-1"


def interleaved_shards(
    frame: DataFrame, key: str, source: str, ties: list[str], shards: int, seed: str = SEED
) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    The law is on rows: shard sizes differ by one at most. NULL sources form a
    source of their own, NULL keys are shuffled like any other key. ``ties`` are
    columns that order rows of equal keys; rows equal in all of them are copies
    and interchangeable. An empty frame gives no rows. Neither rank puts a
    source, or the whole sequence, into one task.
    """
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    shuffled = frame.withColumn(
        "_order", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    )
    inside = ranked(shuffled, [source], ["_order", key, *ties], "_rank", "_rows")
    inside = inside.withColumn("_fraction", (F.col("_rank") + F.lit(0.5)) / F.col("_rows"))
    whole = ranked(inside, [], ["_fraction", source, "_order", key, *ties], "_at", "_all")
    shard = F.expr(f"(_at * {shards}) div _all")
    start = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return (
        whole.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.col("_at") - start)
        .drop("_order", "_rank", "_rows", "_fraction", "_at", "_all")
    )
