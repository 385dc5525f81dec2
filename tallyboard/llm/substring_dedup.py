"""Removal of repeated word windows, with a count-min prefilter.

Two passes over the texts. The first counts hashed windows into sparse count-min
sketches, one per piece of input, which are merged by segments; what the second
pass needs of the merged sketch is one bit per cell, "two or more". A window seen
twice sets its cells in every row of the sketch, so none is lost; a window seen once
passes only if others share its cell in every row. The second pass sends the windows
that pass on, and groups them exactly. The bits have a fixed upper size and may be
broadcast; beyond it more windows pass the filter and are grouped, nothing else changes.

Within a piece only the first occurrence of a window is sent on, so a passage that
very many documents share has a row per piece, not per document. Windows travel by
the smallest word pair in them, which keeps neighbours of a repeated passage together:
their findings are runs, not single windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import chunks, mixed, stored

WINDOW = 20
#: Rows of the sketch, and bounds of its cells per row as powers of two.
ROWS = 2
LEAST_BITS, MOST_BITS = 20, 29
#: Cells of a segment, the unit in which sketches are merged: 2**SEGMENT_BITS.
SEGMENT_BITS = 21
#: Text bytes per cell: with two, cells are a few times the windows.
BYTES_PER_CELL = 2
#: About as many text bytes meet in one task of the exact pass, if all windows passed.
BYTES_PER_GROUP = 4 << 20
#: Text bytes of a piece: larger pieces settle more windows on the spot.
PIECE_BYTES = 8 << 20
#: Words that are held as objects at once; of the others there are only hashes. One text's at least.
HELD_WORDS = 1 << 16
SEED = 42
BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
CELL_SALTS = tuple(np.uint64(s) for s in (0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F))
PACK = "group int, key binary"
RUNS = "key long, body long, start int, length int"


def window_sums(hashes: np.ndarray, base: np.uint64, width: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of every ``width`` neighbouring word hashes, by doubling."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    total, held, sums, span = np.zeros(len(hashes) + 1, np.uint64), 0, hashes, 1
    while True:
        if width & span:
            count = len(hashes) - held - span + 1
            further = sums[held:held + count] * np.uint64(pow(int(base), held, 1 << 64))
            further += total[:count]
            total, held = further, held + span
        if held == width:
            return total
        following = sums[span:] * np.uint64(pow(int(base), span, 1 << 64))
        following += sums[:-span]
        sums, span = following, span * 2


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Windows:
    """Windows of the texts of a piece: hashes, owner and start of each."""

    def __init__(self, width: int):
        self.width = width

    def hashed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the words of each text."""
        parts, words = [np.empty(0, np.uint64)], []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(words)
            words += text.as_py().split()
            counts[i] = len(words) - before
            if len(words) >= HELD_WORDS or i == len(texts) - 1:
                found = map(xxhash.xxh64_intdigest, words, repeat(SEED))
                parts.append(np.fromiter(found, np.uint64, len(words)))
                words.clear()
        return mixed(np.concatenate(parts)), counts

    def __call__(self, texts: pa.Array):
        self.words, counts = self.hashed(texts)
        first = window_sums(self.words, BASES[0], self.width)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), counts)[:len(first)]
        start = (np.arange(len(first)) - (ends - counts)[owner]).astype(np.int32)
        inside = start + self.width <= counts[owner]
        return first[inside], owner[inside], start[inside], np.flatnonzero(inside)


def cells(first: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mixed(first * CELL_SALTS[row]) >> np.uint64(64 - bits)


def packed(values: np.ndarray) -> bytes:
    """Sorted integers as gaps, byte planes apart, compressed."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype("<u4")
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)
    return len(gaps).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    count = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], count * 4, "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(4, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def sketch_bits(text_bytes: int) -> int:
    wanted = max(1, text_bytes // BYTES_PER_CELL)
    return min(MOST_BITS, max(LEAST_BITS, int(wanted - 1).bit_length()))


def repeated_cells(rows: DataFrame, width: int, bits: int) -> list[np.ndarray]:
    """For each sketch row, the bits of cells counted twice or more, from all windows."""
    segment_bits = min(bits, SEGMENT_BITS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width)
        for batch in chunks(batches, "text", PIECE_BYTES):
            first = windows(batch.column("text"))[0]
            groups, blobs = [], []
            for row in range(ROWS):
                own = np.sort(cells(first, row, bits))
                # More than two of a cell say no more than two.
                own = own[np.append([True, True], own[2:] != own[:-2])[:len(own)]]
                cuts = np.searchsorted(own, np.arange(1, 1 << (bits - segment_bits),
                                                      dtype=np.uint64) << np.uint64(segment_bits))
                for segment, part in enumerate(np.split(own, cuts)):
                    if len(part):
                        groups.append(row << 16 | segment)
                        blobs.append(packed(part & np.uint64((1 << segment_bits) - 1)))
            if groups:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups, pa.int32()), pa.array(blobs, pa.binary())],
                    names=["group", "key"],
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, group = np.zeros(1 << segment_bits, np.uint8), None
        for batch in batches:
            for blob, group in zip(batch.column("key"), batch.column("group"), strict=True):
                cell, times = np.unique(unpacked(blob.as_py()), return_counts=True)
                counts[cell] = np.minimum(counts[cell] + times, 2)
        if group is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([group.as_py()], pa.int32()),
                 pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())],
                names=["group", "key"],
            )

    merged = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    sparse = rows.select("text").mapInArrow(sketch, PACK)
    size = (1 << segment_bits) // 8
    for line in sparse.groupBy("group").applyInArrow(merge, PACK).toLocalIterator():
        at = (line["group"] & 0xFFFF) * size
        merged[line["group"] >> 16][at:at + size] = np.frombuffer(line["key"], np.uint8)
    return merged


def passing(bitmaps: list[np.ndarray], first: np.ndarray, bits: int) -> np.ndarray:
    fine = np.ones(len(first), bool)
    for row, bitmap in enumerate(bitmaps):
        cell = cells(first[fine], row, bits)
        hit = bitmap[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1
        fine[fine] = hit.astype(bool)
    return fine


#: A window on its way to the exact pass. ``later`` marks those already known not to be first.
WINDOW_TYPE = np.dtype([
    ("first", "<u8"), ("second", "<u4"), ("key", "<i8"), ("start", "<i4"),
    ("body", "<i8"), ("later", "u1"),
])


def sent(pieces: np.ndarray) -> bytes:
    """Columns one after the other, compressed: keys and starts of a run shrink to little."""
    return len(pieces).to_bytes(8, "little") + pa.compress(
        b"".join(np.ascontiguousarray(pieces[n]).tobytes() for n in WINDOW_TYPE.names),
        "zstd", asbytes=True,
    )


def received(blob: bytes) -> np.ndarray:
    count = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], count * WINDOW_TYPE.itemsize, "zstd", asbytes=True)
    out, at = np.empty(count, WINDOW_TYPE), 0
    for name in WINDOW_TYPE.names:
        kind = WINDOW_TYPE[name]
        out[name] = np.frombuffer(raw, kind, count, at)
        at += count * kind.itemsize
    return out


def by_content(windows: np.ndarray) -> np.ndarray:
    """The places of the windows by content, key and start."""
    return np.lexsort((windows["start"], windows["key"], windows["second"], windows["first"]))


def later_ones(windows: np.ndarray) -> np.ndarray:
    """Which of the windows, in the order of ``by_content``, have an earlier equal."""
    same = np.zeros(len(windows), bool)
    same[1:] = (windows["first"][1:] == windows["first"][:-1]) & (
        windows["second"][1:] == windows["second"][:-1]
    )
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(windows))))
    return (windows["key"] != windows["key"][head]) | (windows["start"] != windows["start"][head])


def exact_runs(
    rows: DataFrame, width: int, bits: int, bitmaps: list[np.ndarray], groups: int
) -> DataFrame:
    """(key, body, start, length): runs of windows that also start earlier.

    Grouping is by 96 bits of two independent polynomial hashes of the words.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(bitmaps)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(width)
        for batch in chunks(batches, "text", PIECE_BYTES):
            first, owner, start, at = windows(batch.column("text"))
            fine = passing(shipped.value, first, bits)
            first, owner, start, at = first[fine], owner[fine], start[fine], at[fine]
            if not len(first):
                continue
            found = np.empty(len(first), WINDOW_TYPE)
            found["first"] = first
            found["second"] = window_sums(windows.words, BASES[1], width)[at] >> np.uint64(32)
            found["key"] = batch.column("key").to_numpy()[owner]
            found["body"] = batch.column("body").to_numpy()[owner]
            found["start"] = start
            pairs = mixed(window_sums(windows.words, BASES[1], 2))
            home = (mixed(smallest(pairs, width - 1)[at]) % np.uint64(groups)).astype(np.int32)
            # Only what is sent stays while it is sorted.
            del first, owner, start, at, fine, pairs, windows.words
            # Sorted by content; within a piece all but the first are known to be later ones.
            order = by_content(found)
            found, home = found[order], home[order]
            found["later"] = later_ones(found)
            # These are settled; they go by document, so no passage gathers in one task.
            settled = found["later"] == 1
            spread = mixed(found["key"][settled].astype(np.uint64)) % np.uint64(groups)
            home[settled] = spread.astype(np.int32)
            order = np.lexsort((found["start"], found["key"], home))
            found, home = found[order], home[order]
            del order, settled, spread
            names, cuts = np.unique(home, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()),
                 pa.array([sent(part) for part in np.split(found, cuts[1:])], pa.binary())],
                names=["group", "key"],
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [received(blob.as_py()) for batch in batches for blob in batch.column("key")]
        if not parts:
            return
        windows = np.concatenate(parts)
        known = windows[windows["later"] == 1]
        windows = windows[windows["later"] == 0]
        windows = windows[by_content(windows)]
        gone = np.concatenate([known, windows[later_ones(windows)]])
        gone = gone[np.lexsort((gone["start"], gone["body"], gone["key"]))]
        fresh = np.ones(len(gone), bool)
        fresh[1:] = (
            (gone["key"][1:] != gone["key"][:-1]) | (gone["body"][1:] != gone["body"][:-1])
            | (gone["start"][1:] > gone["start"][:-1] + width)
        )
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(gone))[:len(heads)] - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(gone["key"][heads]), pa.array(gone["body"][heads]),
             pa.array(gone["start"][heads]),
             pa.array((gone["start"][tails] - gone["start"][heads] + width).astype(np.int32))],
            names=["key", "body", "start", "length"],
        )

    return rows.mapInArrow(send, PACK).groupBy("group").applyInArrow(settle, RUNS)


def remove_repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs`` (doc_id, text).

    Words are separated by ASCII white space. A word goes if a window of ``width``
    words that covers it also starts earlier: at a smaller doc_id, or in the same
    document before. NULL texts have no words; texts shorter than a window keep
    all. A NULL doc_id counts as the largest. Rows that repeat doc_id and text
    are the same document: neither is earlier than the other. ``kept`` is the
    remaining text, its words joined by one space. An empty frame gives no rows.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    ).withColumn("body", F.xxhash64("text"))
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(text_bytes)
    long = rows.where(F.octet_length("text") >= 2 * width - 1)
    bitmaps = repeated_cells(long, width, bits)
    groups = max(1, text_bytes // BYTES_PER_GROUP)
    runs = stored(exact_runs(long, width, bits, bitmaps, groups), "runs")
    spans = runs.groupBy("key", "body").agg(
        F.collect_list(F.struct("start", "length")).alias("spans")
    )
    joined = rows.join(spans, ["key", "body"], "left").select("doc_id", "text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            total, removed, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().split()
                total.append(len(words))
                if own.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    flat = own.values.flatten()
                    np.add.at(cover, flat[0].to_numpy(), 1)
                    np.add.at(cover, flat[0].to_numpy() + flat[1].to_numpy(), -1)
                    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                    words = [words[i] for i in stay]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add(
        "kept", "string"
    )
    return joined.mapInArrow(remove, schema)
