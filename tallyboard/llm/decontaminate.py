"""Benchmark decontamination by greedy string tiling.

Seeds, runs of ``seed`` words, are shared between a document and a test item. For each
pair with a seed, tiles are laid: the longest runs of words that both share and that no
earlier tile covers are marked, longest first, down to ``seed`` words; runs are found by
Karp-Rabin hashes. The coverage is the share of the item's words that tiles cover, in
whatever order the passages stand in the document.

A bitmap of fixed size over the hashes of all test seeds is broadcast. Documents that hit
it are few; they send their hashed seeds, which meet the test seeds in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.llm.common import WordHashes, chunks, mixed, stored

SEED_WORDS = 5
COVERAGE = 0.5
#: Bits of the seed bitmap: 2**23 bits are 1 MB, whatever the benchmark's size.
BITMAP_BITS = 23
#: Places where an item and a text agree that are held at once.
PAIRS_AT_ONCE = 2_000_000
TOKENS = T.ArrayType(T.LongType())
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def token_rows(frame: DataFrame, key: str, into: str) -> DataFrame:
    """(key, tokens): word hashes of the text, A-Z in lower case; NULL texts have none."""
    rows = frame.select(
        F.col(key).alias(into), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    schema = rows.drop("text").schema.add("tokens", TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            tokens = [hashes(t.translate(LOWER).split()).view(np.int64)
                      for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(into), pa.array(tokens, pa.list_(pa.int64()))],
                names=[into, "tokens"],
            )

    return rows.mapInArrow(run, schema)


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs that agree between sequences of different lengths."""
    total = np.zeros(max(0, len(tokens) - width + 1), np.uint64)
    powers = np.cumprod(np.append(np.uint64(1), np.full(width - 1, BASE, np.uint64)))
    for at, power in enumerate(powers):
        total += mixed(tokens[at:at + len(total)]) * power
    return mixed(total)


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(item start, text start, length) of the tiles, longest first.

    Equal lengths are taken by item start, then text start. Tiles do not overlap in
    either sequence.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    found: list[tuple[int, int, int]] = []
    while True:
        at_item, at_text, run = free_runs(item, text, free_item, free_text, least)
        if not len(run):
            return found
        laid, length = len(found), int(run.max())
        longest = np.flatnonzero(run == length)
        for k in longest[np.lexsort((at_text[longest], at_item[longest]))]:
            i, j = int(at_item[k]), int(at_text[k])
            in_item, in_text = slice(i, i + length), slice(j, j + length)
            if free_item[in_item].all() and free_text[in_text].all():
                if (item[in_item] == text[in_text]).all():
                    found.append((i, j, length))
                    free_item[in_item], free_text[in_text] = False, False
        if len(found) == laid:
            return found


def free_runs(
    item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item start, text start, length) of the longest runs of free, equal tokens.

    Places where ``least`` tokens agree lie on diagonals; neighbours there are one run. Texts
    that agree nearly everywhere are taken a stretch at a time, with as much more as
    a run may go on, so that no more than about PAIRS_AT_ONCE places are held.
    """
    def starts(tokens: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.append(0, np.cumsum(free))
        whole = np.flatnonzero(held[least:] - held[:-least] == least)
        return window_hashes(tokens, least)[whole], whole

    none = np.empty(0, np.int64)
    if min(len(item), len(text)) < least:
        return none, none, none
    item_hash, item_at = starts(item, free_item)
    text_hash, text_at = starts(text, free_text)
    order = np.argsort(item_hash, kind="stable")
    item_hash, item_at = item_hash[order], item_at[order]
    low = np.searchsorted(item_hash, text_hash, "left")
    many = np.searchsorted(item_hash, text_hash, "right") - low
    met = many > 0
    text_at, low, many = text_at[met], low[met], many[met]
    if not len(many):
        return none, none, none
    step = len(text) if many.sum() <= PAIRS_AT_ONCE else max(1, PAIRS_AT_ONCE // len(item))
    side, parts = len(item) + 1, []
    for start in range(0, len(text), step):
        near = slice(*np.searchsorted(text_at, [start - 1, start + step + len(item)]))
        count = many[near]
        if not len(count):
            continue
        at_text = np.repeat(text_at[near], count)
        inside = np.arange(len(at_text)) - np.repeat(np.cumsum(count) - count, count)
        at_item = item_at[np.repeat(low[near], count) + inside]
        # Along a diagonal the place in this order goes up by one.
        place = np.sort((at_text - at_item + len(item)) * side + at_item)
        first = np.flatnonzero(np.append(True, np.diff(place) != 1))
        run = np.diff(np.append(first, len(place))) + least - 1
        at_item = place[first] % side
        at_text = place[first] // side - len(item) + at_item
        own = (at_text >= start) & (at_text < start + step)
        parts.append((at_item[own], at_text[own], run[own]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def seed_bitmap(items: DataFrame, seed: int) -> np.ndarray:
    """The bitmap of all test seeds; at most 2**BITMAP_BITS / 64 numbers reach the driver."""
    seeds = item_seeds(items, seed)
    bit = F.pmod(F.shiftrightunsigned("seed", 64 - BITMAP_BITS), F.lit(1 << BITMAP_BITS))
    words = (
        seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def item_seeds(items: DataFrame, seed: int) -> DataFrame:
    """(item_id, seed): distinct seed hashes of every test item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tokens in zip(batch.column("item_id"), batch.column("tokens"), strict=True):
                own = np.unique(window_hashes(tokens.values.to_numpy().view(np.uint64), seed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(own), batch.column("item_id").type),
                     pa.array(own.view(np.int64))], names=["item_id", "seed"],
                )

    schema = items.select("item_id").schema.add("seed", "long")
    return items.mapInArrow(run, schema)


def suspects(docs: DataFrame, bitmap: np.ndarray, seed: int) -> DataFrame:
    """(row, seeds, tokens) of rows that hit the bitmap; ``docs`` has row and text."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = docs.select(
        "row", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )
    schema = rows.select("row").schema.add("seeds", TOKENS).add("tokens", TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHashes(), shipped.value
        for batch in chunks(batches, "text"):
            words: list[bytes] = []
            counts = np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = text.translate(LOWER).split()
                words += own
                counts[i] = len(own)
            tokens = hashes(words)
            ends = np.cumsum(counts)
            found = window_hashes(tokens, seed)
            owner = np.repeat(np.arange(len(counts)), counts)[:len(found)]
            inside = np.arange(len(found)) + seed <= ends[owner]
            place = found >> np.uint64(64 - BITMAP_BITS)
            hit = inside & (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)
                            ).astype(bool)
            rows_hit = np.unique(owner[hit])
            if not len(rows_hit):
                continue
            cut = np.searchsorted(owner[hit], rows_hit)
            seeds = [np.unique(x).view(np.int64) for x in np.split(found[hit], cut[1:])]
            own = [tokens[ends[r] - counts[r]:ends[r]].view(np.int64) for r in rows_hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(rows_hit)),
                 pa.array(seeds, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))],
                names=["row", "seeds", "tokens"],
            )

    return rows.mapInArrow(run, schema)


def coverage(
    docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS
) -> DataFrame:
    """(row, item_id, covered, item_words, longest) of all pairs that share a seed.

    ``docs`` has row (any unique key) and text, ``benchmark`` has item_id and text.
    Items of fewer than ``seed`` words, NULL and empty texts share none; items
    without item_id and repeated items are items like any other, told apart by text.
    """
    items = stored(
        token_rows(benchmark.select("item_id", "text").distinct(), "item_id", "item_id")
        .withColumn("item", F.monotonically_increasing_id()),
        "benchmark",
    )
    by_item = items.select(F.col("item").alias("item_id"), "tokens")
    bitmap = seed_bitmap(by_item, seed)
    found = stored(suspects(docs, bitmap, seed), "suspects")
    pairs = (
        found.select("row", F.explode("seeds").alias("seed"))
        .join(item_seeds(by_item, seed).withColumnRenamed("item_id", "item"), "seed")
        .select("row", "item").distinct()
    )
    rows = (
        pairs.join(found.select("row", "tokens"), "row")
        .join(items.withColumnRenamed("tokens", "item_tokens"), "item")
        .select("row", "item_id", "tokens", "item_tokens")
    )
    schema = (
        rows.select("row", "item_id").schema
        .add("covered", "integer").add("item_words", "integer").add("longest", "integer")
    )

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, total, longest = [], [], []
            for text, item in zip(batch.column("tokens"), batch.column("item_tokens"), strict=True):
                item_tokens = item.values.to_numpy().view(np.uint64)
                laid = tiles(item_tokens, text.values.to_numpy().view(np.uint64), seed)
                covered.append(sum(t[2] for t in laid))
                total.append(len(item_tokens))
                longest.append(max((t[2] for t in laid), default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("item_id"),
                 *[pa.array(x, pa.int32()) for x in (covered, total, longest)]],
                names=["row", "item_id", "covered", "item_words", "longest"],
            )

    return rows.mapInArrow(tile, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS) -> DataFrame:
    """(doc_id, body, item_id, covered, item_words, longest, coverage) of covered documents.

    One row for each different (doc_id, text) that shares a tile with some item: the
    item of the largest coverage, ties to the smaller item_id. ``body`` is the hash
    of the text (NULL as empty), as ``body_of`` gives it.
    """
    rows = docs.select(F.struct("doc_id", body_of().alias("body")).alias("row"), "text")
    share = F.col("covered") / F.col("item_words")
    best = F.min_by(
        F.struct("item_id", "covered", "item_words", "longest", share.alias("coverage")),
        F.struct(-share, F.col("item_id")),
    )
    return (
        coverage(rows, benchmark, seed).where("covered > 0")
        .groupBy("row").agg(best.alias("best")).select("row.*", "best.*")
    )


def body_of():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def with_coverage(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``found``; NULL where a document shares nothing."""
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_body") == F.col("_found"))
    return (
        docs.withColumn("_body", body_of())
        .join(found.withColumnsRenamed({"doc_id": "_doc", "body": "_found"}), same, "left")
        .drop("_doc", "_body", "_found")
    )
