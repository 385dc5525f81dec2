"""Exact top-k search by integer inner products.

Vectors are packed into blocks, queries into tiles of bounded size. Every block meets every
tile of its vectors' length: blocks are dealt into parts, each tile goes to all parts, and the
matrix products run where a (tile, part) comes together. Each keeps the best k of every query,
and the lists are merged in a tree. Nothing but two counts passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import cut, ranked, stored

#: Queries of a tile: 4096 vectors of 1024 components are 32 MB.
TILE_QUERIES = 4096
#: Vectors of a block, which are multiplied at once.
BLOCK = 2048
#: Bytes of blocks that meet a tile in one task.
PART_BYTES = 32 << 20
#: Lists merged into one at each level of the tree.
FAN_IN = 32
#: Levels below the root; with two, 32 lists meet at the root for every 32,768 parts.
LEVELS = 2
SCALE = 1024
BLOCKS = "width int, block long, ids binary, data binary"
TILES = "width int, tile long, ids binary, slots binary, data binary"
LISTS = "width int, piece long, query_id long, slot long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not NULL, and neither NULL, NaN nor infinite in any component."""
    fine = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & fine


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of every component; what no 64-bit number holds is an error."""
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        beyond = F.raise_error(F.lit("a component is too large for 64 bits")).cast("long")
        return F.when(F.abs(scaled) < F.lit(2.0**63), F.floor(scaled)).otherwise(beyond)

    return F.transform(vector, whole)


def matrix(data: bytes, rows: int) -> np.ndarray:
    """Rows of numbers of 64 bits; without any bytes they have no components."""
    return np.frombuffer(data, "<i8").reshape(rows, -1) if data else np.zeros((rows, 0), np.int64)


def products(tile: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer products; a score beyond 64 bits is an error.

    Floating point, 64-bit or unbounded numbers are used as far as every sum is exact in them.
    """
    largest = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (tile, block)]
    bound = largest[0] * largest[1] * max(1, tile.shape[1])
    if bound < 2**53:
        return (tile.astype(np.float64) @ block.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return tile @ block.T
    scores = tile.astype(object) @ block.astype(object).T
    if scores.size and not -(2**63) <= scores.min() <= scores.max() < 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(row, id, score) of the k best of each row; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    for row in range(len(scores)):
        line = scores[row]
        other = np.flatnonzero(ids != own[row])
        line = line[other]
        if len(line) > k:
            edge = np.partition(line, len(line) - k)[len(line) - k]
            above = np.flatnonzero(line > edge)
            level = np.flatnonzero(line == edge)[:k - len(above)]
            keep = np.concatenate([above, level])
        else:
            keep = np.arange(len(line))
        yield row, ids[other[keep]], line[keep]


def packed(rows: DataFrame) -> DataFrame:
    """(width, block, ids, data): ``rows`` (vec_id, vector) in blocks of equal lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            widths = pa.compute.list_value_length(batch.column("vector")).to_numpy()
            for width in np.unique(widths):
                own = batch.filter(pa.array(widths == width))
                for at in range(0, own.num_rows, BLOCK):
                    part = own.slice(at, BLOCK)
                    data = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([width], pa.int32()), pa.array([number]),
                         pa.array([part.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                         pa.array([data.astype("<i8").tobytes()], pa.binary())],
                        names=["width", "block", "ids", "data"],
                    )
                    number += 1

    return rows.select("vec_id", "vector").mapInArrow(run, BLOCKS)


def tiled(queries: DataFrame) -> DataFrame:
    """(width, tile, ids, slots, data): ``queries`` (vec_id, vector, width, slot), a row a tile."""
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot").combine_chunks()
        data = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        numbers = lambda name: table.column(name).to_numpy().astype("<i8").tobytes()
        return pa.table({
            "width": table.column("width").slice(0, 1), "tile": table.column("tile").slice(0, 1),
            "ids": pa.array([numbers("vec_id")], pa.binary()),
            "slots": pa.array([numbers("slot")], pa.binary()),
            "data": pa.array([data.astype("<i8").tobytes()], pa.binary()),
        })

    rows = queries.withColumn("tile", F.expr(f"slot div {TILE_QUERIES}"))
    return rows.groupBy("width", "tile").applyInArrow(pack, TILES)


def multiplied(k: int):
    def run(blocks: pa.Table, tiles: pa.Table) -> pa.Table:
        """The best ``k`` of each query of a tile among the vectors of a part."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids = slots = np.empty(0, np.int64)
        if tiles.num_rows:
            ids, slots = (np.frombuffer(tiles.column(n)[0].as_py(), "<i8") for n in ("ids", "slots"))
            vectors = matrix(tiles.column("data")[0].as_py(), len(ids))
            held = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
            for row in range(blocks.num_rows):
                own = np.frombuffer(blocks.column("ids")[row].as_py(), "<i8")
                scores = products(vectors, matrix(blocks.column("data")[row].as_py(), len(own)))
                for query, new_ids, new_scores in best(scores, own, ids, k):
                    both_ids = np.concatenate([held[query][0], new_ids])
                    both = np.concatenate([held[query][1], new_scores])
                    keep = np.lexsort((both_ids, -both))[:k]
                    held[query] = both_ids[keep], both[keep]
        counts = [len(x[0]) for x in held]
        total = sum(counts)
        many = lambda column: [column[0].as_py()] * total if total else []
        flat = lambda at: np.concatenate([x[at] for x in held]) if total else []
        return pa.table({
            "width": pa.array(many(tiles.column("width")), pa.int32()),
            "piece": pa.array(many(blocks.column("part")) if blocks.num_rows else [], pa.int64()),
            "query_id": pa.array(np.repeat(ids, counts) if total else [], pa.int64()),
            "slot": pa.array(np.repeat(slots, counts) if total else [], pa.int64()),
            "vec_id": pa.array(flat(0), pa.int64()), "score": pa.array(flat(1), pa.int64()),
        })

    return run


def top_k(frame: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best of each query.

    ``frame`` has vec_id and embedding. Unusable vectors (NULL, with NULL or
    non-finite components) and rows without vec_id take no part; neither do, for a
    query, vectors of another length. Rows that carry the query's own vec_id are
    no candidates of it; other rows of one vec_id each count. Queries equal in
    vec_id and vector are one query. A query without candidates has no rows.
    Ties go to the smaller vec_id. Scores are exact; one that no 64-bit number holds is an
    error. A vector of any length is multiplied whole.
    """
    clean = frame.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("vector"),
        is_query.alias("_query"),
    )
    queries = ranked(
        clean.where("_query").select("vec_id", "vector", F.size("vector").alias("width")).distinct(),
        ["width"], ["vec_id", "vector"], "slot", "_all",
    )
    tiles = stored(tiled(cut(queries)), "query-tiles")
    blocks = stored(packed(clean), "vector-blocks")
    # Two numbers: bytes of the blocks, and the tiles of the length that has most.
    size = blocks.agg(F.sum(F.length("data") + F.length("ids"))).first()[0] or 0
    last = tiles.agg(F.max("tile")).first()[0]
    if last is None:
        return frame.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = max(1, -(-size // PART_BYTES))
    key = ["width", "tile", "part"]
    left = blocks.select(
        "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("tile"),
        F.pmod(F.xxhash64("block"), F.lit(parts)).cast("long").alias("part"), "ids", "data",
    )
    right = tiles.select(
        "width", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
        "ids", "slots", "data",
    )
    lists = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(multiplied(k), LISTS)
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    for _ in range(LEVELS):
        lists = lists.withColumn("piece", F.expr(f"piece div {FAN_IN}"))
        best_of = Window.partitionBy("query_id", "width", "slot", "piece").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k)
    final = Window.partitionBy("query_id", "width", "slot").orderBy(*order)
    return lists.select(
        "query_id", F.row_number().over(final).cast("int").alias("rank"), "vec_id", "score"
    )
