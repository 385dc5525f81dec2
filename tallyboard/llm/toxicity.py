"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

Features are words, pairs of neighbouring words and skip-grams (a word and the one
after next), each hashed into 2**bits places and present or absent in a text.
Training keeps a rate per coordinate and an L1 term, so most weights are zero and
what is broadcast to the scoring tasks is small: at most 2**bits weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallyboard.llm.common import WordHashes, chunks, free_name, mixed

#: ASCII upper case to lower; punctuation at the ends of words is not part of them.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
EDGES = b".,;:!?\"'()[]{}<>*#$%&"
SALTS = tuple(np.uint64(s) for s in (0xA24BAED4963EE407, 0x9FB21C651E98DF25))


@dataclass(frozen=True)
class Ftrl:
    """Settings of the training; ``sample_rows`` bounds the labelled rows it reads.

    ``l1`` is multiplied by the square root of the number of rows, with which the
    sums of chance gradients grow. The sample is dealt over ``shards`` tasks whose
    weights are averaged; a sample of this size fits one task, and one pass over all of
    it learns rare words better.
    """

    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 0.07
    l2: float = 0.0
    epochs: int = 4
    shards: int = 1
    sample_rows: int = 20_000


@dataclass(frozen=True)
class Weights:
    """Non-zero weights by place, and the bias."""

    bits: int
    places: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << self.bits)
        full[self.places] = self.values
        return full


class Features:
    """Hashed features of texts; the memo of words lives as long as the task."""

    def __init__(self, bits: int):
        self.bits, self.hashes = bits, WordHashes()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, place) of every feature, repeats included."""
        shift = np.uint64(64 - self.bits)
        # Every text starts with a mark, which also stands between two texts.
        words: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = [w.strip(EDGES) for w in text.translate(LOWER).split()]
            words += own
            counts[i] = len(own)
        hashes = self.hashes(words)
        owner = np.repeat(np.arange(len(texts)), counts)
        rows, places = [owner], [mixed(hashes) >> shift]
        for gap, salt in zip((1, 2), SALTS, strict=True):
            same = owner[:-gap] == owner[gap:]
            pair = mixed((hashes[:-gap] * salt)[same] + mixed(hashes[gap:][same]))
            rows.append(owner[:-gap][same])
            places.append(pair >> shift)
        return np.concatenate(rows), np.concatenate(places).astype(np.int64)


def sigmoid(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def fit_shard(
    settings: Ftrl, features: list[np.ndarray], labels: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights and bias of one FTRL-proximal pass sequence over the rows in their order.

    ``features`` has the distinct places of each row.
    """
    size = (1 << settings.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = settings.l1 * len(features) ** 0.5
    bias = size - 1

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        rate = (settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2
        over = np.sign(zs) * l1 - zs
        return np.where(np.abs(zs) > l1, over / rate, 0.0)

    for _ in range(settings.epochs):
        for own, label in zip(features, labels, strict=True):
            at = np.append(own, bias)
            w = weight(at)
            gradient = sigmoid(w.sum()) - label
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    full = weight(np.arange(size))
    return full[:-1], float(full[-1])


def bounded_sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled keys, those of the smallest hashes; one row per key."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return (
        known.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("label"))
        .withColumn("order", F.xxhash64(F.lit("sample"), F.col(key).cast("string")))
        .orderBy("order", key).limit(rows)
    )


def places_of(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``places``, the distinct hashed features of ``text``, in its stead."""
    schema = rows.drop("text").schema.add("places", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Features(bits)
        for batch in chunks(batches, "text"):
            at = batch.schema.get_field_index("text")
            # One text at a time: only its distinct places are held.
            places = [
                np.unique(extract([text])[1]).astype(np.int32)
                for text in batch.column(at).to_pylist()
            ]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(places, pa.list_(pa.int32()))], names=[*names, "places"]
            )

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, settings: Ftrl = Ftrl()) -> Weights:
    """Fit on ``labels`` (doc_id, label) joined with ``docs`` (doc_id, text).

    The sample is bounded by ``settings.sample_rows`` and so may be broadcast; it is
    dealt over a fixed number of shards, each trained in a task of its own, and the
    weights are averaged by place. Texts become features before they are dealt, so a
    training task holds at most 2**bits places a row, whatever the length of the texts.
    NULL texts are empty; without labelled rows all weights are zero and every score is
    one half. Rows that repeat a doc_id count once, with the smallest of their texts, so
    that equal inputs give equal weights however they are dealt over tasks.
    """
    sample = bounded_sample(labels, "doc_id", "label", settings.sample_rows)
    rows = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))
    )
    rows = places_of(rows, settings.bits).withColumn("shard", F.pmod("order", F.lit(settings.shards)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"])
        full, bias = fit_shard(settings, list(pdf["places"]), pdf["label"].to_numpy())
        at = np.flatnonzero(full)
        return pd.DataFrame({"place": np.append(at, -1), "value": np.append(full[at], bias)})

    fitted = rows.groupBy("shard").applyInPandas(fit, "place long, value double")
    mean = (
        fitted.groupBy("place").agg(F.sort_array(F.collect_list("value")).alias("values"))
        .select("place", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("sum"))
        .toPandas().sort_values("place")
    )
    bias = mean.loc[mean["place"] < 0, "sum"].sum() / settings.shards
    mean = mean[mean["place"] >= 0]
    return Weights(
        settings.bits, mean["place"].to_numpy(), mean["sum"].to_numpy() / settings.shards, bias
    )


def score(
    docs: DataFrame, weights: Weights, keep: list[Column], into: str = "score"
) -> DataFrame:
    """``keep`` and ``into``, a score (0 to 1) of every row of ``docs``; NULL and empty texts by bias."""
    parts = (weights.bits, weights.places, weights.values, weights.bias)
    shipped = docs.sparkSession.sparkContext.broadcast(parts)
    held = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = free_name("scored_text", [*docs.select(*keep).columns, into])
    rows = docs.select(*keep, held.alias(source))
    schema = rows.drop(source).schema.add(into, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(*shipped.value)
        full, features = model.dense(), Features(model.bits)
        active, size = full != 0, np.int64(1 << model.bits)
        for batch in chunks(batches, source):
            at = batch.schema.get_field_index(source)
            owner, place = features(batch.column(at).to_pylist())
            hit = active[place]
            once = np.unique(owner[hit] * size + place[hit])
            margin = np.bincount(once // size, full[once % size], minlength=batch.num_rows)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != source]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sigmoid(margin + model.bias))], names=[*names, into]
            )

    return rows.mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """True for keys that no training sees: crc32 of the key's text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0
