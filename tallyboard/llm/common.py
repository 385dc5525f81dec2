"""Shared folders, distributed ranks and word helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text a task works on at once, in bytes.
CHUNK_BYTES = 4 << 20
#: Words whose hashes a task remembers.
MEMO_WORDS = 1 << 17
INDEX_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    Where the session names none (tests on one machine) a folder below the
    warehouse is used, which a cluster shares as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/llm-shared").rstrip("/")


def shared_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared checkpoint folder; later plans start there."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(frame.sparkSession))
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """``frame`` written as Parquet below the shared folder and read back."""
    spark = frame.sparkSession
    path = shared_path(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores behind it while a column is called so."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_of(frame: DataFrame) -> Column:
    """The text column; NULL counts as empty."""
    return F.coalesce(frame["text"].cast("string"), F.lit(""))


def ranked(
    frame: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    rank: str,
    total: str,
    weight: str | None = None,
) -> DataFrame:
    """Add the place of each row in its group and the size of the group.

    Rows are range-partitioned by (group, order), numbered inside each range and
    shifted by what earlier ranges hold of the same group. No task needs a whole
    group, so a group may hold most rows. ``order`` should tell rows apart; rows
    equal in all of it are interchangeable. With ``weight`` the place is the sum
    of that column over earlier rows of the group, and ``total`` its sum.
    """
    keys = [F.col(name).asc_nulls_last() for name in [*group, *order]]
    placed = cut(
        frame.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_range", F.shiftright("_place", INDEX_BITS))
    inside = Window.partitionBy("_range", *group)
    if weight is None:
        index = F.col("_place").bitwiseAND((1 << INDEX_BITS) - 1)
        placed = placed.withColumn("_index", index)
        ranges = placed.groupBy("_range", *group).agg(
            F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_held")
        )
    else:
        running = inside.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_index", F.coalesce(F.sum(weight).over(running), F.lit(0)))
        ranges = placed.groupBy("_range", *group).agg(
            F.lit(0).cast("long").alias("_first"), F.sum(weight).alias("_held")
        )
    every = Window.partitionBy(*(group or [F.lit(0)]))
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("_range").alias("_range_"),
        *[F.col(name).alias(f"_key_{name}") for name in group],
        (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_held").over(every).alias(total),
    )
    same = F.col("_range") == F.col("_range_")
    for name in group:
        same = same & F.col(name).eqNullSafe(F.col(f"_key_{name}"))
    return (
        placed.join(ranges, same)
        .withColumn(rank, F.col("_index") + F.col("_shift"))
        .drop("_place", "_range", "_range_", "_index", "_shift", *[f"_key_{n}" for n in group])
    )


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the smallest node that links reach, for every linked node.

    Each round takes the smallest root among neighbours and then the root of that
    root, so the rounds grow with the logarithm of a chain's length. Both steps
    are joins and grouped minima; only the number of changed nodes is collected.
    """
    edges = cut(
        links.select(F.col(left).alias("node"), F.col(right).alias("other"))
        .union(links.select(F.col(right).alias("node"), F.col(left).alias("other")))
        .distinct()
    )
    roots = cut(
        edges.groupBy("node").agg(F.min("other").alias("low"))
        .select("node", F.least("node", "low").alias("root"))
    )
    while True:
        near = (
            edges.join(roots.select(F.col("node").alias("other"), "root"), "other")
            .groupBy("node").agg(F.min("root").alias("near"))
        )
        hooked = (
            roots.join(near, "node", "left")
            .select("node", F.col("root").alias("was"),
                    F.least("root", F.coalesce("near", "root")).alias("root"))
        )
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        following = cut(
            hooked.join(jump, "root", "left")
            .select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        )
        changed = following.where("root <> was").limit(1).count()
        roots = following.select("node", "root")
        if not changed:
            return roots


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = np.array(
            pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64
        )
        start = 0
        while start < len(sizes):
            held = np.cumsum(sizes[start:start + 65536])
            stop = start + max(1, int(np.searchsorted(held, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class WordHashes:
    """64-bit word hashes that are the same on every executor, with a bounded memo."""

    def __init__(self, seed: int = 42):
        self.seed = seed
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(words) - memo.keys():
            memo[word] = xxhash.xxh64_intdigest(word, self.seed)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))
