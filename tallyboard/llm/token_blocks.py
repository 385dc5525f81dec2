"""Token ids in files of independently coded blocks.

A file holds the ids of whole documents, in blocks of ``BLOCK`` ids. Every block starts
with a fresh model and has its own checksum, so any of them can be read alone. Ids are
coded by an adaptive range coder that mixes three predictions:

- order 2: the id that followed the last two ids before, with a confidence;
- order 1: the id that followed the last id before, with a confidence;
- order 0: how often ids, taken as four digits of base 16, came up in the block.

A first decision says whether order 2 is right, a second one whether order 1 is; the
chance of each mixes adaptive estimates for both confidences and the latest outcomes in
the logistic domain, with weights learned on the way. Ids that neither predicts are coded
digit by digit by order 0. All of it is integer arithmetic, so every machine decodes
alike. The blocks of a file advance side by side, one id each at a time.

A file is: magic, number of blocks, number of documents; for every block its ids, words
of code and CRC-32 of its ids; for every document its ids; then the code of the blocks.
Numbers are little-endian and unsigned, of 32 bits; code is words of 16 bits.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyboard.llm.common import chunks, ranked, shared_path

MAGIC = b"CMRB"
BLOCK = 2048
#: Text bytes whose ids go into one file; whole documents, at least one. A step of the coder costs
#: about as much for a thousand blocks as for one, and a block has tables of some 90 KB.
FILE_BYTES = 12 << 20
#: Text bytes tokenized at once.
ENCODE_BYTES = 1 << 20
#: Ids are below 2**16.
DIGITS = 4
MEMO_WORDS = 1 << 18
#: Characters of pieces that a worker remembers; long ones would fill its memory.
MEMO_CHARS = 1 << 23
#: How the tokenizer has to prepare texts for their ids to be put together from pieces.
CUTTING = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
            "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: Not ASCII's white space and visible characters nor Latin letters, whose lower-case form is one
#: letter whatever stands beside it, and which NFC leaves as they are.
FOREIGN = re.compile("[^\\t-\\r -~À-ÖØ-öø-\u012f\u0131-\u017f]").search
#: The same pattern for the other texts, in lower case.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-\u017f]+|[0-9]|[^\\sa-z0-9ß-öø-\u017f]+")
ORDER1, ORDER2 = 12, 13
#: Rows of order 0: one for the first digit, then one per prefix; prefixes of three
#: digits share the last ones.
FIRST_ROW = (0, 1, 17, 273)
SHARED_ROWS = 1024
ROWS = 273 + SHARED_ROWS
LEARN = 4
SQUASH = np.array(
    [min(4095, max(1, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int64
)
STRETCH = np.array(
    [max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)],
    np.int64,
)
PULL = np.array(
    [[j + (32768 - 16 if j > digit else 0) for j in range(16)] for digit in range(16)], np.int16
)
#: Certainty after a miss and after a hit, by certainty before.
SURER = np.array([[k >> 1 for k in range(16)], [min(k + 1, 15) for k in range(16)]], np.int64).ravel()
#: The eight bytes of a number, each of them 0 or 1, times this have their sum in the first byte.
BYTE_SUM, FIRST_BYTE = np.uint64(0x0101010101010101), np.uint64(56)
LOW_BITS, WORD = 48, 16
OUT = LOW_BITS - WORD
BOTTOM, TOP = 1 << OUT, 1 << LOW_BITS
FLAG_BITS, DIGIT_BITS = 16, 15
WHOLE_FLAG, LAST_START = 1 << FLAG_BITS, (1 << DIGIT_BITS) - 1
#: Words of code that one id can take, by its two flags and its digits, with some to spare.
ID_WORDS = 8
#: Lanes are the first ones, as a slice, or some, as an array of their numbers.
Lanes = slice | np.ndarray


def chosen(lanes: Lanes, at: np.ndarray) -> np.ndarray:
    return at if isinstance(lanes, slice) else lanes[at]


def digit_range(starts: np.ndarray, places: np.ndarray, digit: np.ndarray):
    """Start and size of each digit; behind the starts of all rows stands one more number, 0."""
    at = places + digit
    start = starts.take(at, mode="clip")
    at += 1
    # A row's first start is 0, and so a last digit ends at 2**15.
    size = starts.take(at, mode="clip")
    size -= start
    size &= LAST_START
    return start.astype(np.int64), size


class Writer:
    """Range coders side by side; each lane codes into words of its own, a column of ``words``."""

    def __init__(self, lanes: int, most_ids: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, TOP - 1, np.int64)
        self.words = np.zeros((2 * most_ids + 16, lanes), np.uint16)
        self.used = np.zeros(lanes, np.int64)

    def code(self, lanes: Lanes, start, size, bits):
        unit = self.range[lanes] >> bits
        start *= unit
        start += self.low[lanes]
        low, span = start, unit * size
        carry = (low >= TOP).nonzero()[0]
        if len(carry):
            carried = chosen(lanes, carry)
            low[carry] &= TOP - 1
            at = self.used[carried] - 1
            while len(carried):
                self.words[at, carried] += np.uint16(1)
                further = self.words[at, carried] == 0
                carried, at = carried[further], at[further] - 1
        short = (span < BOTTOM).nonzero()[0]
        if len(short):
            own, full = chosen(lanes, short), low[short]
            used = self.used[own]
            self.words.reshape(-1)[used * len(self.low) + own] = full >> OUT
            used += 1
            self.used[own] = used
            low[short] = (full & (BOTTOM - 1)) << WORD
            span[short] <<= WORD
        self.low[lanes], self.range[lanes] = low, span

    def room(self, ids: int):
        """Make room for the code of ``ids`` more ids."""
        missing = int(self.used.max()) + ID_WORDS * (ids + 1) - len(self.words)
        if missing > 0:
            more = np.zeros((max(missing, len(self.words) // 2), len(self.low)), np.uint16)
            self.words = np.concatenate([self.words, more])

    def flag(self, lanes: Lanes, chance, bit):
        one = chance << 4
        # A set bit is the lower part of the range.
        self.code(lanes, one * ~bit, np.where(bit, one, WHOLE_FLAG - one), FLAG_BITS)
        return bit

    def digit(self, lanes: np.ndarray, starts, places, digit):
        self.code(lanes, *digit_range(starts, places, digit), DIGIT_BITS)
        return digit

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        self.room(0)
        for _ in range(LOW_BITS // WORD):
            self.words[self.used, lanes] = self.low >> OUT
            self.low = (self.low & (BOTTOM - 1)) << WORD
            self.used += 1
        rows = np.ascontiguousarray(self.words[:self.used.max()].T)
        return [row[:n].astype("<u2").tobytes() for row, n in zip(rows, self.used, strict=True)]


class Reader:
    """The other side of Writer, with the same calls; what is to be coded is found."""

    def __init__(self, code: list[bytes]):
        longest = max(len(c) for c in code) // 2 + 4
        rows = np.zeros((len(code), longest), np.uint16)
        for lane, own in enumerate(code):
            rows[lane, :len(own) // 2] = np.frombuffer(own, "<u2")
        self.words = np.ascontiguousarray(rows.T)
        self.value = np.zeros(len(code), np.int64)
        for at in range(LOW_BITS // WORD):
            self.value = (self.value << WORD) | self.words[at]
        self.range = np.full(len(code), TOP - 1, np.int64)
        self.used = np.full(len(code), LOW_BITS // WORD, np.int64)

    def narrow(self, lanes: Lanes, value, unit, start, size):
        start *= unit
        value = value - start
        span = unit * size
        short = (span < BOTTOM).nonzero()[0]
        if len(short):
            own = chosen(lanes, short)
            used = self.used[own]
            # A word too far, in a damaged file, is found by the checksum.
            following = self.words.take(used * len(self.range) + own, mode="clip")
            # Only in a damaged file there are bits to drop.
            value[short] = (value[short] & (BOTTOM - 1)) << WORD | following
            used += 1
            self.used[own] = used
            span[short] <<= WORD
        self.value[lanes], self.range[lanes] = value, span

    def flag(self, lanes: Lanes, chance, bit):
        one = chance << 4
        unit, value = self.range[lanes] >> FLAG_BITS, self.value[lanes]
        bit = value < unit * one
        self.narrow(lanes, value, unit, one * ~bit, np.where(bit, one, WHOLE_FLAG - one))
        return bit

    def digit(self, lanes: np.ndarray, starts, places, digit):
        unit, value = self.range[lanes] >> DIGIT_BITS, self.value[lanes]
        # Both are below 2**48 and the quotient about 2**15, so that its whole part is exact.
        place = np.minimum(value / unit, LAST_START).astype(np.int16)
        below = (starts[:-1].reshape(-1, 16) <= place[:, None]).view(np.uint64)
        below *= BYTE_SUM
        below >>= FIRST_BYTE
        digit = (below[:, 0] + below[:, 1]).astype(np.int64)
        digit -= 1
        self.narrow(lanes, value, unit, *digit_range(starts, places, digit))
        return digit


class Mixer:
    """A decision whose chance mixes three adaptive estimates; one state per lane.

    Estimates of one context lie side by side, lane by lane: few contexts come up often.
    """

    def __init__(self, lanes: int):
        # Estimates have 16 bits; they are widened where they are used.
        self.chance = np.full(3 * 256 * lanes, 1 << 15, np.uint16)
        self.weight = np.full((3, lanes), 1 << 15, np.int64)
        self.places = np.arange(3)[:, None] * (256 * lanes) + np.arange(lanes)

    def __call__(self, coder, lanes: Lanes, contexts, bit):
        places, weights = contexts * self.weight.shape[1], self.weight[:, lanes]
        places += self.places[:, lanes]
        chances = self.chance.take(places, mode="clip").astype(np.int64)
        inputs = STRETCH.take(chances >> 4, mode="clip")
        dot = np.add.reduce(weights * inputs, axis=0)
        dot >>= 16
        dot += 2047
        # Beyond the ends of the table its ends hold.
        mix = SQUASH.take(dot, mode="clip")
        bit = coder.flag(lanes, mix, bit)
        one = bit.astype(np.int64)
        error = ((one << 12) - mix) * 6
        change = one * 65535 - chances
        change >>= LEARN
        chances += change
        self.chance[places] = chances
        inputs *= error
        inputs += 1 << 9
        inputs >>= 10
        inputs += weights
        self.weight[:, lanes] = inputs
        return bit


class Model:
    """Predictions of all lanes. ``step`` codes or finds the next id of the first ``n`` lanes."""

    def __init__(self, lanes: int):
        # Row by row, the lanes of each side by side.
        table = np.empty((ROWS * lanes, 16), np.int16)
        table[:] = np.arange(16, dtype=np.int16) * 2048
        self.rows, self.whole_rows = table, table.view("V32").ravel()
        self.starts = np.zeros(lanes * 16 + 1, np.int16)
        # A guess, and in the last four bits how certain it is.
        self.after1 = np.zeros(lanes << ORDER1, np.int32)
        self.after2 = np.zeros(lanes << ORDER2, np.int32)
        self.last = np.zeros((2, lanes), np.int64)
        self.history = np.zeros(lanes, np.int64)
        self.second, self.first = Mixer(lanes), Mixer(lanes)
        self.lanes = np.arange(lanes)
        self.own1, self.own2 = self.lanes << ORDER1, self.lanes << ORDER2
        self.own_starts = self.lanes * 16
        self.contexts = np.zeros((3, lanes), np.int64)

    def new_ids(self, coder, lanes: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Code or find ids that nothing predicts, digit by digit."""
        places, all_lanes = self.own_starts[:len(lanes)], len(self.lanes)
        # The place behind the last row stays 0.
        self.starts[len(lanes) * 16] = 0
        starts = self.starts[:len(lanes) * 16 + 1]
        rows = starts[:-1].reshape(-1, 16)
        prefix = np.zeros(len(lanes), np.int64)
        for k in range(DIGITS):
            at = prefix.copy() if k < 3 else (prefix * 40503 >> 6) & (SHARED_ROWS - 1)
            at += FIRST_ROW[k]
            at *= all_lanes
            at += lanes
            self.rows.take(at, axis=0, out=rows, mode="clip")
            wanted = None if ids is None else (ids >> (12 - 4 * k)) & 15
            digit = coder.digit(lanes, starts, places, wanted)
            pull = PULL.take(digit, axis=0, mode="clip")
            pull -= rows
            pull >>= LEARN
            pull += rows
            self.whole_rows[at] = pull.view("V32").ravel()
            prefix *= 16
            prefix += digit
        return prefix

    def step(self, coder, n: int, ids: np.ndarray | None) -> np.ndarray:
        lanes = slice(0, n)
        one, two = self.last[0, :n], self.last[1, :n]
        at1 = one * 40503
        at2 = two * 30011
        at2 += at1
        at2 >>= 4
        at2 &= (1 << ORDER2) - 1
        at2 |= self.own2[:n]
        at1 >>= 4
        at1 &= (1 << ORDER1) - 1
        at1 |= self.own1[:n]
        held1 = self.after1.take(at1, mode="clip").astype(np.int64)
        held2 = self.after2.take(at2, mode="clip").astype(np.int64)
        guess1, guess2, sure1, sure2 = held1 >> 4, held2 >> 4, held1 & 15, held2 & 15
        same, history = guess1 == guess2, self.history[:n]

        contexts = self.contexts[:, :n]
        np.add(sure2, sure2, out=contexts[0])
        contexts[0] += same
        both = np.multiply(sure1, 16, out=contexts[1])
        both += sure2
        contexts[2] = history
        hit2 = self.second(coder, lanes, contexts, None if ids is None else ids == guess2)
        missed = ~hit2
        rest = (missed & ~same).nonzero()[0]
        hit1 = np.zeros(n, bool)
        if len(rest):
            contexts[0] = sure1
            bit = None if ids is None else (ids == guess1)[rest]
            hit1[rest] = self.first(coder, rest, contexts[:, rest], bit)
        missed &= ~hit1
        new = missed.nonzero()[0]
        out = np.where(hit1, guess1, guess2) if ids is None else ids
        if len(new):
            found = self.new_ids(coder, new, None if ids is None else ids[new])
            if ids is None:
                out[new] = found

        for after, at, guess, sure, right in (
            (self.after1, at1, guess1, sure1, out == guess1),
            (self.after2, at2, guess2, sure2, out == guess2),
        ):
            kept = np.where(right | (sure > 1), guess, out)
            kept <<= 4
            sure += right * 16
            kept |= SURER.take(sure, mode="clip")
            after[at] = kept
        self.last[1, :n], self.last[0, :n] = one, out
        history *= 4
        history += hit2 * 2
        history += hit1
        history &= 255
        return out


def lane_lengths(count: int, block: int) -> np.ndarray:
    lengths = np.full(-(-count // block), block, np.int64)
    if count % block:
        lengths[-1] = count % block
    return lengths


def ids_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(ids: np.ndarray, documents: list[int], block: int = BLOCK) -> bytes:
    """The file of ``ids``, of which each document has as many as ``documents`` says."""
    if len(ids) and int(ids.max()) >= 1 << (4 * DIGITS):
        raise ValueError("ids of more than 16 bits")
    lengths = lane_lengths(len(ids), block)
    code: list[bytes] = []
    if len(lengths):
        padded = np.zeros(block * len(lengths), np.uint16)
        padded[:len(ids)] = ids
        grid = np.ascontiguousarray(padded.reshape(len(lengths), block).T)
        del padded
        model, coder = Model(len(lengths)), Writer(len(lengths), min(block, int(lengths[0])))
        for at in range(int(lengths[0])):
            n = len(lengths) - (at >= lengths[-1])
            if at % 64 == 0:
                coder.room(64)
            model.step(coder, n, grid[at, :n].astype(np.int64))
        code = coder.finish()
        # The next file's tables are not to lie beside these.
        del model, coder, grid
    ends = np.cumsum(lengths)
    checks = [ids_crc(ids[e - n:e]) for e, n in zip(ends, lengths, strict=True)]
    index = np.array([lengths, [len(c) // 2 for c in code], checks], "<u4").T
    head = np.array([len(lengths), len(documents)], "<u4")
    return b"".join(
        [MAGIC, head.tobytes(), index.tobytes(), np.array(documents, "<u4").tobytes(), *code]
    )


def unpack(file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document); raises ValueError where a checksum does not fit."""
    if file[:4] != MAGIC:
        raise ValueError("not a file of token blocks")
    blocks, documents = np.frombuffer(file, "<u4", 2, 4)
    index = np.frombuffer(file, "<u4", 3 * blocks, 12).reshape(-1, 3).astype(np.int64)
    counts = np.frombuffer(file, "<u4", documents, 12 + 12 * int(blocks)).astype(np.int64)
    start = 12 + 12 * int(blocks) + 4 * int(documents)
    ends = start + 2 * np.cumsum(index[:, 1])
    code = [file[e - 2 * n:e] for e, n in zip(ends, index[:, 1], strict=True)]
    lengths = index[:, 0]
    parts: list[np.ndarray] = []
    if len(lengths):
        grid = np.zeros((int(lengths[0]), len(lengths)), np.uint16)
        model, coder = Model(len(lengths)), Reader(code)
        for at in range(int(lengths[0])):
            n = len(lengths) - (at >= lengths[-1])
            grid[at, :n] = model.step(coder, n, None)
        del model, coder
        parts = [grid[:n, lane] for lane, n in enumerate(lengths)]
    for number, (ids, check) in enumerate(zip(parts, index[:, 2], strict=True)):
        if ids_crc(ids) != check:
            raise ValueError(f"block {number} is damaged")
    return (np.concatenate(parts) if parts else np.empty(0, np.uint16)), counts


@cache
def tokenizer_of(path: str) -> Tokenizer:
    """The one tokenizer of a Python worker, which keeps to its task's thread.

    The library's threads hold memory for each tokenizer they have worked with, also when it is gone.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


class Pieces:
    """Ids of the pieces into which the tokenizer cuts texts, with a bounded memo.

    The tokenizer lowers letters, cuts by one pattern, drops white space and merges inside
    each piece. The last token of a piece, and no other, has the suffix that ends a word: so
    pieces are encoded many at once, with a space between them, and their ids cut apart.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.memo: dict[str, bytes] = {}
        self.held = 0
        settings = json.loads(tokenizer.to_str())
        suffix = settings["model"].get("end_of_word_suffix")
        added = settings["added_tokens"]
        self.added = [token["content"] for token in added]
        #: Whether the tokenizer cuts as it is said here, and no added token is in a piece.
        self.known = bool(suffix) and settings["post_processor"] is None and all(
            settings[part] == CUTTING[part] for part in CUTTING
        ) and not any(
            token["normalized"] or len(PIECE.findall(token["content"].lower())) < 2
            or re.search(r"\s", token["content"]) for token in added
        )
        vocabulary = tokenizer.get_vocab() if self.known else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def plain(self, text: str) -> bool:
        """Whether a text's ids are those of its pieces."""
        return self.known and not FOREIGN(text) and not any(token in text for token in self.added)

    def encode(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)
        ids = np.array(found[0].ids, np.int64)
        stops = (2 * (self.ends[ids].nonzero()[0] + 1)).tolist()
        held = ids.astype("<u2").tobytes()
        for piece, start, stop in zip(pieces, [0, *stops[:-1]], stops, strict=True):
            self.memo[piece] = held[start:stop]

    def learn(self, pieces: set[str]) -> None:
        """See to it that the memo has the ids of ``pieces``."""
        if len(self.memo) > MEMO_WORDS or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        fresh = [piece for piece in pieces if piece not in self.memo]
        self.held += sum(map(len, fresh))
        for at in range(0, len(fresh), 4096):
            self.encode(fresh[at:at + 4096])


@cache
def pieces_of(path: str) -> Pieces:
    """The pieces that a Python worker knows, from all its tasks."""
    return Pieces(tokenizer_of(path))


class Encoder:
    """Ids of texts as bytes of 16-bit numbers, by pieces and words, with bounded memos.

    The tokenizer drops white space and never looks across it, so a text's ids are
    those of its words. Where it cuts texts as ``CUTTING`` says, those of Latin letters
    are put together from pieces; the words of others go to it whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.pieces = tokenizer_of(path), pieces_of(path)
        self.memo: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        fresh = [word for word in words if word not in self.memo]
        for at in range(0, len(fresh), 4096):
            part = fresh[at:at + 4096]
            coded = self.tokenizer.encode_batch_fast(
                [w.decode() for w in part], add_special_tokens=False
            )
            for word, ids in zip(part, coded, strict=True):
                self.memo[word] = np.array(ids.ids, "<u2").tobytes()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        pieces, words = set(), set()
        cut: list[tuple[dict, list]] = []
        for whole in texts:
            text = whole.decode()
            if self.pieces.plain(text):
                own = PIECE.findall(text.lower())
                pieces.update(own)
                cut.append((self.pieces.memo, own))
            else:
                own = whole.split()
                words.update(own)
                cut.append((self.memo, own))
        self.pieces.learn(pieces)
        self.learn(words)
        return [np.frombuffer(b"".join(map(memo.__getitem__, own)), "<u2") for memo, own in cut]


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``, in ascending doc_id order.

    A row of the Parquet dataset is one file (``file``) with its place in the order
    (part, number), its ids and the doc_ids of its documents. NULL texts have
    only the end id; NULL doc_ids come last; rows of one doc_id are ordered by a
    hash of the text.
    """
    rows = docs.select(
        "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    ).withColumn("_body", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("_body"), F.col("_row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("part"), "doc_id", "text"
    )
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, number int, ids long, doc_ids array<{key}>, file binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = Encoder(vocabulary), 0
        for batch in chunks(batches, "text", FILE_BYTES):
            ids = [
                np.append(x, np.uint16(end_id)) for part in chunks(iter([batch]), "text", ENCODE_BYTES)
                for x in encode(part.column("text").to_pylist())
            ]
            counts = [len(x) for x in ids]
            flat = np.concatenate(ids)
            del ids
            yield pa.RecordBatch.from_arrays(
                [batch.column("part").slice(0, 1), pa.array([number], pa.int32()),
                 pa.array([len(flat)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()),
                                          batch.column("doc_id")),
                 pa.array([pack(flat, counts)], pa.binary())],
                names=["part", "number", "ids", "doc_ids", "file"],
            )
            number += 1

    rows.mapInArrow(run, schema).write.parquet(path)


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below ``path``."""
    files = spark.read.parquet(path)
    places = ranked(
        files.select("part", "number", "ids"), [], ["part", "number"], "base", "all", weight="ids"
    ).select("part", "number", "base")
    key = files.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"part int, number int, doc_id {key}, at long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(whole.num_rows):
                batch = whole.slice(row, 1)
                ids, counts = unpack(batch.column("file")[0].as_py())
                ends = np.cumsum(counts)
                checks = [ids_crc(ids[e - n:e]) for e, n in zip(ends, counts, strict=True)]
                part, number = (batch.column(c)[0].as_py() for c in ("part", "number"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(counts), pa.int32()),
                     pa.array([number] * len(counts), pa.int32()),
                     batch.column("doc_ids")[0].values, pa.array(ends - counts),
                     pa.array(counts), pa.array(checks, pa.int64())],
                    names=["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = files.select("part", "number", "doc_ids", "file").mapInArrow(run, schema)
    return found.join(places, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def packed_documents(
    docs: DataFrame, vocabulary: str = public_tokenizers.path("word_bpe_49k.json"), end_id: int = 2
) -> DataFrame:
    """Write the documents' ids and read them back; see ``write_files`` and ``read_files``.

    An empty frame writes no file and gives no rows.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "token-blocks")
    write_files(docs, path, vocabulary, end_id)
    return read_files(spark, path)
