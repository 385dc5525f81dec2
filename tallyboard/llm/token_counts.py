"""Numbers of tokens of whole texts, by whole-token shortcuts.

The tokenizer merges pieces of a text along the pieces of its vocabulary. ``prove`` looks
at the vocabulary alone and finds out, before any text is read,

- that a text may be cut before every run of spaces and around line feeds, since no piece
  of several characters goes on after such a place: merges never cross a cut, so the
  tokens of a text are those of its pre-tokens;
- which of its strings, taken as pre-tokens, come out as one token. Each is encoded once.

A pre-token among these strings counts one, without being encoded. Only the others are
merged by the tokenizer; a memo of bounded size remembers how many tokens they gave.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import chunks, free_name

#: What the tokenizer writes for a space.
SPACE = "▁"
#: Starts what is encoded alone, so that no space is put before it; itself cut off.
EDGE = "\n"
#: A run of spaces with the word behind it, spaces at an end, or a line feed.
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
#: Characters of a text that are cut into pre-tokens at once, and what a memo holds.
PIECE_CHARS = 1 << 18
MEMO_WORDS = 1 << 17
LONG_WORD = 256
LIMIT = 4096


@dataclass(frozen=True)
class Shortcut:
    """What holds for one vocabulary: pre-tokens that are one token, and of how many one consists."""

    whole: frozenset[str]
    edge_tokens: int


def prove(model: sentencepiece.SentencePieceProcessor) -> Shortcut:
    """The strings of the vocabulary that encode alone as one token.

    Raises ValueError for a vocabulary whose texts cannot be cut: one with a piece that
    goes on after a space or a line feed, or one that takes a space off.
    """
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    for piece in pieces:
        if re.search(f"[^{SPACE}]{SPACE}", piece) or (EDGE in piece and len(piece) > 1):
            raise ValueError(f"a piece goes on after a cut: {piece!r}")
    edge, sample = model.encode(EDGE), f"a  a {EDGE} a "
    cut = model.encode([EDGE + word for word in PRE_TOKEN.findall(" " + sample)])
    if len(model.encode(sample)) != sum(len(ids) - len(edge) for ids in cut):
        raise ValueError("spaces are not kept as they are")
    alone = model.encode([EDGE + piece.replace(SPACE, " ") for piece in pieces])
    return Shortcut(
        frozenset(
            piece.replace(SPACE, " ") for piece, ids in zip(pieces, alone, strict=True)
            if len(ids) == len(edge) + 1
        ),
        len(edge),
    )


class Counter:
    """Numbers of tokens of texts; the memo lives as long as the task."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, shortcut: Shortcut):
        self.model, self.shortcut = model, shortcut
        self.merged: dict[str, int] = {}

    def pieces(self, text: str) -> Iterator[str]:
        """The text behind the space that the tokenizer puts before it, cut at pre-tokens."""
        text = " " + text.replace(SPACE, " ")
        at = 0
        while at < len(text):
            # A run of spaces belongs to what follows, so a cut is made before its first one.
            cut = re.compile(r"(?<=[^ ]) |\n").search(text, at + PIECE_CHARS)
            stop = cut.start() if cut else len(text)
            yield text[at:stop]
            at = stop

    def merge(self, words: set[str]) -> dict[str, int]:
        """Numbers of tokens of pre-tokens, from the memo or the tokenizer."""
        if len(self.merged) > MEMO_WORDS:
            self.merged.clear()
        fresh = [w for w in words if w not in self.merged]
        found = {}
        for at in range(0, len(fresh), 4096):
            part = fresh[at:at + 4096]
            for word, ids in zip(part, self.model.encode([EDGE + w for w in part]), strict=True):
                found[word] = len(ids) - self.shortcut.edge_tokens
        self.merged.update((w, n) for w, n in found.items() if len(w) <= LONG_WORD)
        return self.merged if all(len(w) <= LONG_WORD for w in fresh) else self.merged | found

    def __call__(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; an empty text has none."""
        whole, totals = self.shortcut.whole, [0] * len(texts)
        rest: list[tuple[int, list[str]]] = []
        held = 0

        def settle() -> None:
            tokens = self.merge({w for _, own in rest for w in own})
            for number, own in rest:
                totals[number] += sum(map(tokens.__getitem__, own))
            rest.clear()

        for number, text in enumerate(texts):
            if not text:
                continue
            for piece in self.pieces(text):
                words = PRE_TOKEN.findall(piece)
                others = [w for w in words if w not in whole]
                totals[number] += len(words) - len(others)
                rest.append((number, others))
                held += len(piece)
                if held > 4 * PIECE_CHARS:
                    settle()
                    held = 0
        settle()
        return totals


def count_tokens(
    docs: DataFrame, keep: list[Column], vocabulary: str = public_tokenizers.path("piece_bpe_32k.model"),
    into: str = "n_tokens",
) -> DataFrame:
    """``keep`` and ``into``, the number of tokens of ``text``, for every row of ``docs``.

    The number is that of the tokenizer in the file ``vocabulary`` on the whole text,
    without marks of beginning or end; strings of special tokens are text like any other.
    NULL and empty texts have none. Repeated rows stay; an empty frame gives no
    rows. Very long texts are counted piece by piece. The file has to be on every executor;
    the proof is made once a task's process, from the vocabulary alone.
    """
    held = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = free_name("counted_text", [*docs.select(*keep).columns, into])
    rows = docs.select(*keep, held.alias(source))
    schema = rows.drop(source).schema.add(into, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        count = Counter(model, prove(model))
        for batch in chunks(batches, source):
            at = batch.schema.get_field_index(source)
            totals = count(batch.column(at).to_pylist())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64())], names=[*names, into]
            )

    return rows.mapInArrow(run, schema)
