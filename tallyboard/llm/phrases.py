"""Phrases that words form more often than by chance, counted in counting quotient filters.

Texts are cut into pieces of bounded size. A piece numbers its own words; the words that
occur often enough in a language get dense numbers there, and every piece learns the numbers
of its words by a join. A phrase that is frequent enough consists of such words only, so all
other words merely separate.

The numbers of the words of an n-gram, packed side by side, are one number of n * b bits,
which a Feistel network permutes. The first bits of the result choose a segment, the
following ones are the quotient and all others the remainder, so nothing is lost: the network
run backwards gives the words again. A task counts its n-grams in one filter per segment:

- a bit per quotient, whether any n-gram has it,
- a bit per n-gram, whether it is the last one of its quotient,
- the remainders, and a byte per count with larger counts behind.

Filters are sorted by quotient and remainder, so those of a segment are merged as sorted
lists. An n-gram comes to the merge once a task, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import chunks, mixed, ranked, stored

LEAST, LONGEST = 10, 3
#: A phrase goes if a longer one has this many hundredths of its count.
INSIDE_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
NO_LANG = "und"
#: Bytes of text numbered together, over all languages.
PIECE_BYTES = 6 << 20
#: N-grams that a task holds before it counts them, and that a segment should have.
HELD_GRAMS = 3_000_000
SEGMENT_GRAMS = 1_000_000
ROUNDS = 4
BREAK = b"\xff"
#: A-Z to lower case; what ends a piece of a sentence to a byte that no UTF-8 has.
LETTERS = bytes.maketrans(
    bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + BREAK * 10
)
PIECES = "piece long, lang string, total long, words array<string>, counts array<long>, codes binary"
ONE = np.uint64(1)


def spans(text: bytes, limit: int) -> Iterator[bytes]:
    """``text``, translated, in spans of about ``limit`` bytes that end where a phrase has to."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(BREAK, at + limit)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, counts, codes): a code is 0 for a break, else one more than the word's place."""
    words = BREAK.join(texts).replace(BREAK, b" \xff ").split()
    index = {BREAK: 0}
    for word in words:
        if word not in index:
            index[word] = len(index)
    codes = np.fromiter(map(index.__getitem__, words), np.uint32, len(words))
    counts = np.bincount(codes, minlength=len(index))[1:]
    del index[BREAK]
    return list(index), counts, codes


def pieces(docs: DataFrame) -> DataFrame:
    """(piece, lang, total, words, counts, codes): the words of ``docs`` (lang, text), numbered.

    ``codes`` are unsigned numbers of 16 bits, where there are few enough, else of 32.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size, number = 0, TaskContext.get().partitionId() << 32

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang, texts in held.items():
                words, counts, codes = numbered(texts)
                if not words:
                    continue
                kind = np.uint16 if len(words) < 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([lang]), pa.array([int(counts.sum())]),
                     pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
                     pa.array([counts], pa.list_(pa.int64())),
                     pa.array([codes.astype(kind).tobytes()], pa.binary())],
                    names=["piece", "lang", "total", "words", "counts", "codes"],
                )
                number += 1
            held.clear()

        for batch in chunks(batches, "text"):
            for lang, text in zip(
                batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                for span in spans(text.translate(LETTERS), PIECE_BYTES):
                    held.setdefault(lang, []).append(span)
                    size += len(span)
                    if size >= PIECE_BYTES:
                        yield from settled()
                        size = 0
        yield from settled()

    return rows.mapInArrow(run, PIECES)


def feistel_round(half: np.ndarray, number: int, bits: int) -> np.ndarray:
    salt = np.uint64((number + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    return mixed(mixed(half + salt)) >> np.uint64(64 - bits)


@dataclass(frozen=True)
class Packing:
    """How n-grams of ``n`` words become numbers: ``word_bits`` for a word, ``segment_bits`` on top."""

    n: int
    word_bits: int
    segment_bits: int

    def __post_init__(self):
        if self.half > 62 or self.width > 64 + 30:
            raise ValueError("too many different words for phrases of this length")

    @property
    def half(self) -> int:
        """Bits of one half; both together hold the words, and one holds the segment."""
        return max(-(-self.n * self.word_bits // 2), self.word_bits, self.segment_bits)

    def permuted(self, words: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(left, right) halves of the permuted numbers of n-grams."""
        half, bits = np.uint64(self.half), np.uint64(self.word_bits)
        mask = (ONE << half) - ONE
        left, right = np.zeros_like(words[0]), np.zeros_like(words[0])
        for word in words:
            left = ((left << bits) | (right >> (half - bits))) & mask
            right = ((right << bits) | word) & mask
        for number in range(ROUNDS):
            left, right = right, left ^ feistel_round(right, number, self.half)
        return left, right

    def restored(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        """The words of permuted numbers."""
        half, bits = np.uint64(self.half), np.uint64(self.word_bits)
        for number in reversed(range(ROUNDS)):
            left, right = right ^ feistel_round(left, number, self.half), left
        mask, words = (ONE << bits) - ONE, []
        for _ in range(self.n):
            words.append(right & mask)
            right = (right >> bits) | ((left & mask) << (half - bits))
            left = left >> bits
        return words[::-1]

    def cut(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, high, low): low has the last 64 bits, high what is between."""
        half = np.uint64(self.half)
        segment = left >> np.uint64(self.half - self.segment_bits)
        left = left & ((ONE << np.uint64(self.half - self.segment_bits)) - ONE)
        low = (left << half) | right
        high = left >> np.uint64(64 - self.half)
        return segment, high, low

    def joined(self, segment: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left, right) of what ``cut`` gave."""
        half = np.uint64(self.half)
        right = low & ((ONE << half) - ONE)
        left = (low >> half) | (high << np.uint64(64 - self.half))
        return left | (np.uint64(segment) << np.uint64(self.half - self.segment_bits)), right

    @property
    def width(self) -> int:
        """Bits of a number within its segment."""
        return 2 * self.half - self.segment_bits


def summed(
    high: np.ndarray, low: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different numbers with the sums of their counts."""
    order = np.lexsort((low, high)) if high.any() else np.argsort(low, kind="stable")
    high, low, counts = high[order], low[order], counts[order]
    first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    at = np.flatnonzero(first)
    return high[at], low[at], np.add.reduceat(counts, at) if len(at) else counts


def as_filter(high: np.ndarray, low: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The counting quotient filter of sorted different numbers of ``width`` bits.

    Quotients have as many bits as the number of numbers, and so many that remainders fit 64.
    """
    quotient_bits = min(width, max(width - 64, len(low).bit_length()))
    rest = width - quotient_bits
    if rest == 64:
        quotient, remainder = high, low
    else:
        quotient = (low >> np.uint64(rest)) | (high << np.uint64(64 - rest) if rest else np.uint64(0))
        remainder = low & ((ONE << np.uint64(rest)) - ONE)
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotient] = 1
    last = np.append(quotient[1:] != quotient[:-1], True).astype(np.uint8)
    digits = remainder.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-rest // 8)]
    large = counts[counts >= 255]
    return b"".join([
        np.array([len(low), quotient_bits, rest, len(large)], "<u4").tobytes(),
        np.packbits(occupied).tobytes(), np.packbits(last).tobytes(), digits.tobytes(),
        np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes(),
    ])


def from_filter(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, counts) of a filter, sorted."""
    n, quotient_bits, rest, many = (int(x) for x in np.frombuffer(data, "<u4", 4))
    at = 16

    def part(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    occupied = np.unpackbits(part(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits)
    last = np.unpackbits(part(-(-n // 8)), count=n)
    size = -(-rest // 8)
    digits = np.zeros((n, 8), np.uint8)
    digits[:, :size] = part(n * size).reshape(n, size)
    counts = part(n).astype(np.int64)
    counts[counts == 255] = part(8 * many).view("<i8") if many else 0
    remainder = digits.view("<u8").ravel()
    run = np.cumsum(last) - last
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run]
    if rest == 64:
        return quotient, remainder, counts
    low = remainder | (quotient << np.uint64(rest))
    high = quotient >> np.uint64(64 - rest) if rest else np.zeros_like(low)
    return high, low, counts


def filters(rows: DataFrame, packings: dict[int, Packing]) -> DataFrame:
    """(lang, n, segment, filter) of ``rows`` (lang, codes, known).

    ``known`` has (at, id) of the words of the piece that count; others separate.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        grams = 0

        def settled() -> Iterator[pa.RecordBatch]:
            for (lang, n), parts in held.items():
                packing = packings[n]
                segment, high, low = packing.cut(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                # By segment first: its bits go above those of the numbers.
                order = np.lexsort((low, high, segment)) if high.any() else np.lexsort((low, segment))
                segment, high, low = segment[order], high[order], low[order]
                first = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])
                                  | (segment[1:] != segment[:-1]))
                at = np.flatnonzero(first)
                counts = np.diff(np.append(at, len(low)))
                segment, high, low = segment[at], high[at], low[at]
                starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
                ends = np.append(starts[1:], len(segment))
                made = [as_filter(high[a:b], low[a:b], counts[a:b], packing.width)
                        for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(made)), pa.array([n] * len(made), pa.int32()),
                     pa.array(segment[starts].astype(np.int64)), pa.array(made, pa.binary())],
                    names=["lang", "n", "segment", "filter"],
                )
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                lang = batch.column("lang")[row].as_py()
                known = batch.column("known")[row].values
                data = batch.column("codes")[row].as_py()
                wide = batch.column("wide")[row].as_py()
                codes = np.frombuffer(data, np.uint32 if wide else np.uint16)
                ids = np.zeros(int(codes.max()) + 1, np.uint64)
                ids[known.field("at").to_numpy() + 1] = known.field("id").to_numpy()
                words = ids[codes]
                whole = words > 0
                for n in range(2, LONGEST + 1):
                    # Places whose n words all count; a shorter run never holds a longer one.
                    size = len(words) - n + 1
                    if size <= 0:
                        break
                    whole = whole[:size] & (words[n - 1:] > 0)
                    at = np.flatnonzero(whole)
                    if len(at):
                        pairs = packings[n].permuted([words[at + k] for k in range(n)])
                        held.setdefault((lang, n), []).append(pairs)
                        grams += len(at)
                if grams >= HELD_GRAMS:
                    yield from settled()
                    grams = 0
        yield from settled()

    return rows.mapInArrow(run, "lang string, n int, segment long, filter binary")


def merged(parts: DataFrame, packings: dict[int, Packing], least: int) -> DataFrame:
    """(lang, ids, f): the n-grams that all filters of a segment together count ``least`` times."""
    kind = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int64())), ("f", pa.int64())])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, n, segment = key[0].as_py(), key[1].as_py(), key[2].as_py()
        lists = [from_filter(x.as_py()) for batch in batches for x in batch.column("filter")]
        high, low, counts = summed(*(np.concatenate(x) for x in zip(*lists, strict=True)))
        enough = counts >= least
        packing = packings[n]
        words = packing.restored(*packing.joined(segment, high[enough], low[enough]))
        flat = np.stack(words, axis=1).astype(np.int64).ravel()
        rows = int(enough.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * rows, pa.string()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, n * rows + 1, n), pa.int32()), pa.array(flat)),
             pa.array(counts[enough], pa.int64())], schema=kind,
        )

    return parts.groupBy("lang", "n", "segment").applyInArrow(run, "lang string, ids array<long>, f long")


@dataclass(frozen=True)
class Counts:
    """``words`` (lang, id, word, f) and ``grams`` (lang, ids, f) that are frequent; ``totals`` (lang, n)."""

    words: DataFrame
    grams: DataFrame
    totals: DataFrame


def counted(docs: DataFrame, least: int = LEAST) -> Counts:
    """Exact counts of all words and phrases of ``docs`` (lang, text) that occur ``least`` times."""
    cut = stored(pieces(docs), "pieces")
    own = cut.select(
        "piece", "lang",
        F.posexplode(F.arrays_zip("words", "counts")).alias("at", "of"),
    ).select("piece", "lang", "at", F.col("of.words").alias("word"), F.col("of.counts").alias("count"))
    frequent = own.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    words = stored(
        ranked(frequent, ["lang"], ["word"], "place", "size")
        .select("lang", "word", "f", (F.col("place") + 1).alias("id"), "size"), "words",
    )
    row = words.agg(F.max("size").alias("size"), F.sum("f").alias("occurrences")).first()
    size, occurrences = row.size or 1, row.occurrences or 0
    segment_bits = max(2, (LONGEST * occurrences // SEGMENT_GRAMS).bit_length())
    packings = {n: Packing(n, int(size).bit_length(), segment_bits) for n in range(2, LONGEST + 1)}
    known = (
        own.drop("count").join(words.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("piece").agg(F.collect_list(F.struct("at", "id")).alias("known"))
    )
    rows = cut.select(
        "piece", "lang", (F.size("words") >= 1 << 16).alias("wide"), "codes"
    ).join(known, "piece").select("lang", "wide", "codes", "known")
    return Counts(
        words.select("lang", "id", "word", "f"),
        stored(merged(filters(rows, packings), packings, least), "grams"),
        cut.groupBy("lang").agg(F.sum("total").alias("n")),
    )


def wide(name: str):
    return F.col(name).cast("decimal(38,0)")


def scored(counts: Counts) -> DataFrame:
    """(lang, ids, a, l, r, score): every phrase at the cut that scores least.

    The score of a cut is floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits; ties
    of cuts go to the shorter first part.
    """
    every = counts.words.select("lang", F.array("id").alias("ids"), "f").union(counts.grams)
    cuts = counts.grams.select(
        "lang", "ids", F.col("f").alias("a"),
        F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"),
    ).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"),
    )
    both = (
        cuts.join(every.select("lang", F.col("ids").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(every.select("lang", F.col("ids").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumns({"up": F.lit(SCALE) * wide("a") * wide("a"), "down": wide("l") * wide("r")})
        .withColumn("score", F.expr("cast(up as decimal(38,0)) div cast(down as decimal(38,0))"))
    )
    return (
        both.groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
        .select("lang", "ids", "a", "least.l", "least.r", F.col("least.score").cast("long").alias("score"))
    )


def outside(phrases: DataFrame, grams: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """``phrases`` (lang, ids, a, ...) that are no part of a longer one nearly as frequent."""
    places = F.transform(
        F.sequence(F.lit(2), F.size("ids") - 1),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.size("ids") - n + 1), lambda at: F.slice(F.col("ids"), at, n)
        ),
    )
    inside = (
        grams.where(F.size("ids") > 2).select("lang", "f", F.explode(F.flatten(places)).alias("ids"))
        .groupBy("lang", "ids").agg(F.max("f").alias("longer"))
    )
    return (
        phrases.join(inside, ["lang", "ids"], "left")
        .where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * percent)).drop("longer")
    )


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with ``phrase``, their words joined by spaces."""
    texts = (
        phrases.select("lang", "ids", F.posexplode("ids").alias("at", "id"))
        .join(words.select("lang", "id", "word"), ["lang", "id"])
        .groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("all"))
    )
    text = F.array_join(F.transform("all", lambda x: x["word"]), " ").alias("phrase")
    return phrases.join(texts.select("lang", "ids", text), ["lang", "ids"])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    ``docs`` has lang (NULL is "und") and text. A-Z count as lower case; words are separated
    by spaces and tabs, and phrases of 2 or 3 words do not go beyond a full stop, comma, semicolon,
    colon, exclamation or question mark, or line break. A phrase with ``least`` occurrences
    (a) is scored at its worst cut; it goes if a longer one, with at least half as many
    occurrences, holds it. The order is by score, then occurrences, both falling, then phrase in
    UTF-8 order; ranks come from a distributed sort. NULL and empty texts have no words,
    repeated rows count again, very long texts are cut where phrases end, and an empty frame
    gives no rows.
    """
    counts = counted(docs.select("lang", "text"), least)
    kept = spelled(outside(scored(counts), counts.grams), counts.words)
    kept = kept.withColumns({"falling": -F.col("score"), "rarer": -F.col("a")}).drop("ids")
    placed = ranked(kept, ["lang"], ["falling", "rarer", "phrase"], "place", "all")
    return placed.where(F.col("place") < top).join(counts.totals, "lang").select(
        "lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
