"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``tau`` bits agree well in some part of the
bits: with parts i and thresholds t_i whose sum of (t_i + 1) exceeds tau, at least
one part differs in at most t_i bits. Correlated bits are grouped into the same part.
The thresholds (also "this part is not used") come from a dynamic program over the
estimated costs of each part and threshold: probes, and candidates that they meet.
Parts and costs are fitted on a bounded sample; every fingerprint is probed.

Both sides of a pair look up every value within ``radius`` of their own part, so they
meet if the parts differ in at most 2 * radius bits. Candidates are verified in
buckets of probes, and a bucket gives a spanning forest of its links, never all
pairs. A value that very many fingerprints share is split first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import chunks, components, cut, mixed, stored

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = 64
#: Fingerprints that the parts are fitted on.
SAMPLE = 4096
MOST_PARTS = 6
RADII = (-1, 0, 1, 2)
#: Cost of a probe that is shuffled, in verified candidates.
PROBE_COST = 60.0
#: Probes verified in one bucket, and the most that may share a value unsplit.
BUCKET_ROWS = 200_000
#: Links that one task thins out.
LINKS_AT_ONCE = 1_000_000
HOT_ROWS = 8192
PROBES = "bucket long, part int, value long, node long, fp long"


def bit_majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes: the bits set in more than half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """A hash of each shingle of a text, as often as it occurs."""
    digest = xxhash.xxh64_intdigest
    words = text.translate(LOWER).split()
    if len(words) > shingle:
        ranges = [words[k:] for k in range(shingle)]
        return [digest(b" ".join(x), 42) for x in zip(*ranges, strict=False)]
    return [digest(b" ".join(words), 42)] if words else []


def hashed_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(
        *keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_hashed_text")
    )


def fingerprints(docs: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint, of every row.

    Texts are lower-cased in A-Z and split at ASCII white space. Shingles of
    ``shingle`` words are joined by a space and hashed by XXH64 with seed 42, each as
    often as it occurs; with fewer words the whole sequence is the shingle, without words
    (also NULL) the fingerprint is zero. A bit is set if it is in over half.
    """
    rows = hashed_text(docs, keep)
    schema = rows.drop("_hashed_text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_hashed_text"):
            at = batch.schema.get_field_index("_hashed_text")
            hashes: list[int] = []
            counts = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(at).to_pylist()):
                own = shingle_hashes(text, shingle)
                hashes += own
                counts[i] = len(own)
            prints = np.zeros(batch.num_rows, np.uint64)
            some = counts > 0
            if some.any():
                starts = (np.cumsum(counts) - counts)[some]
                prints[some] = bit_majority(np.array(hashes, np.uint64), starts, counts[some])
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "_hashed_text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(prints.view(np.int64))], names=[*names, "fp"]
            )

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Part:
    """Bits probed together (0 is the lowest), and the radius of the look-up."""

    bits: tuple[int, ...]
    radius: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def patterns(self) -> np.ndarray:
        """What the bits are changed by in a look-up."""
        flips = [
            sum(1 << b for b in chosen)
            for size in range(self.radius + 1) for chosen in combinations(self.bits, size)
        ]
        return np.array(flips, np.uint64)


def correlated_groups(bits: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bit numbers in ``parts`` groups of nearly equal size; correlated bits together."""
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).mean(axis=0)) + 1e-9
    strength = np.abs((centred / spread).T @ (centred / spread))
    left, groups = list(range(BITS)), []
    for part in range(parts):
        size = BITS // parts + (part < BITS % parts)
        first = max(left, key=lambda b: strength[b, left].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            following = max(left, key=lambda b: strength[b, group].sum())
            group.append(following)
            left.remove(following)
        groups.append(tuple(sorted(group)))
    return groups


def agreement(differ: np.ndarray, most: int) -> float:
    """Chance that at most ``most`` of independent bits differ; ``differ``: chance of each."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for p in differ:
        moved = np.append(0.0, chance[:-1]) * p
        chance = chance * (1 - p) + moved
        chance[-1] = 0.0
    return float(chance[:-1].sum())


def plan_parts(sample: np.ndarray, nodes: int, tau: int) -> list[Part]:
    """The parts with the least estimated cost that lose no pair within ``tau`` bits."""
    shifts = np.arange(BITS, dtype=np.uint64)
    bits = ((sample[:, None] >> shifts) & np.uint64(1)).astype(np.float64)
    if not len(sample):
        bits = np.zeros((1, BITS))
    ones = bits.mean(axis=0)
    differ = np.clip(2 * ones * (1 - ones), 1e-3, 0.5)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best: tuple[float, list[Part]] = (float("inf"), [])
    for parts in range(1, MOST_PARTS + 1):
        groups = correlated_groups(bits, parts)
        # cheapest[c]: cost and radii so far with a sum of (2 * radius + 1) of c, capped.
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            near = np.zeros(2 * max(RADII) + 1, np.int64)
            mask = np.uint64(Part(group, 0).mask)
            for at in range(0, len(sample), 256):
                block = np.bitwise_count((sample[at:at + 256, None] ^ sample[None, :]) & mask)
                near += np.bincount(block.ravel(), minlength=BITS + 1)[:len(near)]
            near[0] -= len(sample)
            costs = {-1: 0.0}
            for radius in RADII[1:]:
                seen = near[:2 * radius + 1].sum() / 2 / pairs
                met = max(seen, agreement(differ[list(group)], 2 * radius))
                probes = sum(len(list(combinations(group, k))) for k in range(radius + 1))
                costs[radius] = nodes * probes * PROBE_COST + met * nodes * nodes / 2
            following: dict[int, tuple[float, list[int]]] = {}
            for reached, (cost, radii) in cheapest.items():
                for radius, more in costs.items():
                    to = min(tau + 1, reached + 2 * radius + 1 if radius >= 0 else reached)
                    if to not in following or cost + more < following[to][0]:
                        following[to] = (cost + more, [*radii, radius])
            cheapest = following
        if tau + 1 in cheapest and cheapest[tau + 1][0] < best[0]:
            cost, radii = cheapest[tau + 1]
            best = cost, [Part(g, r) for g, r in zip(groups, radii, strict=True) if r >= 0]
    return best[1]


def joined_roots(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a and b: each points to the smallest row of its tree."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return roots
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            further = roots[roots]
            if (further == roots).all():
                break
            roots = further


def forest(value: np.ndarray, codes: np.ndarray, tau: int) -> np.ndarray:
    """Roots of rows linked within equal ``value``; rows are sorted by it.

    Linked: the codes differ in at most ``tau`` bits.
    """
    roots = np.arange(len(value))
    at, gap = np.arange(len(value)), 1
    while True:
        at = at[at + gap < len(value)]
        at = at[value[at] == value[at + gap]]
        if not len(at):
            return roots
        apart = at[roots[at] != roots[at + gap]]
        apart = apart[np.bitwise_count(codes[apart] ^ codes[apart + gap]) <= tau]
        roots = joined_roots(roots, apart, apart + gap)
        gap += 1


def thinned(links: DataFrame) -> DataFrame:
    """A spanning forest of every piece of ``links`` (a, b), which keeps what is connected.

    Buckets link the members of a large class over and over. Pieces have a bounded
    number of links, so the pass is distributed, and small inputs are one piece.
    """
    links = cut(links.distinct())
    pieces = max(1, links.count() // LINKS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]) for b in batches]
        if found:
            nodes, ends = np.unique(np.concatenate(found, axis=1), return_inverse=True)
            a, b = ends.reshape(2, -1)
            roots = joined_roots(np.arange(len(nodes)), a, b)
            linked = np.flatnonzero(roots != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[roots[linked]]), pa.array(nodes[linked])], names=["a", "b"]
            )

    return links.repartition(pieces).mapInArrow(run, "a long, b long")


def find_links(nodes: DataFrame, tau: int) -> DataFrame:
    """(a, b): links between ``nodes`` (node, fp) that keep every component whole.

    ``nodes`` is a stored frame, one row per different fingerprint. Every pair whose
    fingerprints differ in at most ``tau`` bits is probed and verified.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    sample = nodes.orderBy(F.xxhash64(F.lit("sample"), "fp")).limit(SAMPLE)
    codes = sample.select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    parts = plan_parts(codes, count, tau)
    masks = [np.uint64(p.mask) for p in parts]
    patterns = [p.patterns() for p in parts]
    buckets = max(1, count * sum(map(len, patterns)) // BUCKET_ROWS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                node, fp = (batch.column(c).to_numpy() for c in ("node", "fp"))
                for part, (mask, flips) in enumerate(zip(masks, patterns, strict=True)):
                    value = ((fp.view(np.uint64) & mask)[:, None] ^ flips[None, :]).ravel()
                    home = mixed(value + np.uint64(part)) % np.uint64(buckets)
                    own = [np.repeat(x, len(flips)) for x in (node, fp)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(home.astype(np.int64)),
                         pa.array(np.full(len(value), part, np.int32)),
                         pa.array(value.view(np.int64)), *map(pa.array, own)],
                        names=["bucket", "part", "value", "node", "fp"],
                    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        part, value, node, fp = (
            table.column(c).to_numpy() for c in ("part", "value", "node", "fp")
        )
        order = np.lexsort((node, value, part))
        part, value, node = part[order], value[order], node[order]
        group = np.cumsum(
            np.append(0, (value[1:] != value[:-1]) | (part[1:] != part[:-1]))
        )
        roots = forest(group, fp[order].view(np.uint64), tau)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        pair = np.unique(np.stack([node[roots[linked]], node[linked]]), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"]
        )

    probes = nodes.select("node", "fp").mapInArrow(probe, PROBES)
    shared = cut(
        probes.groupBy("part", "value").agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > HOT_ROWS)
    )
    if not shared.limit(1).count():
        return probes.groupBy("bucket").applyInArrow(verify, "a long, b long")
    usual = probes.join(shared, ["part", "value"], "left_anti")
    links = usual.groupBy("bucket").applyInArrow(verify, "a long, b long")
    hot = probes.join(shared, ["part", "value"])
    if tau == 2:
        # Codes within two bits have a code within one bit of both: all that share
        # such a middle are linked to the smallest of them.
        middles = hot.select("node", "fp").distinct().select(
            "node", F.explode(F.array(F.col("fp"), *[
                F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)
            ])).alias("middle"),
        )
        low = middles.groupBy("middle").agg(F.min("node").alias("low"))
        return links.union(
            middles.join(low, "middle").where("node <> low").select("low", "node").distinct()
        )
    # Blocks of a hot value meet each other two at a time, each pair in a task of its own.
    blocks = hot.withColumn("blocks", F.ceil(F.col("rows") / F.lit(HOT_ROWS // 2)).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    meeting = blocks.select("*", other).withColumn(
        "bucket",
        F.xxhash64("part", "value", F.least("block", "other"), F.greatest("block", "other")),
    )
    return links.union(
        meeting.select("bucket", "part", "value", "node", "fp")
        .groupBy("bucket").applyInArrow(verify, "a long, b long")
    )


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def near_groups(least: DataFrame, tau: int) -> DataFrame:
    """(fp, least): the smallest value that links reach, per fingerprint.

    ``least`` (fp, least) has a row for each fingerprint. Copies are one node, so a
    large group of copies costs one probe.
    """
    nodes = stored(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(thinned(find_links(nodes, tau)))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    return rooted.join(smallest, "root").select("fp", F.col("smallest").alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    Fingerprints that differ in at most ``tau`` bits are linked; component_id is the
    smallest doc_id reachable, the document included. Texts without words (NULL,
    empty, blank) have fingerprint zero and are linked like any other; repeated rows
    are one class. A NULL doc_id belongs to a class but is never its smallest,
    unless nothing else is in it. A text of any length is hashed whole, in one task.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), shingle, ["doc_id"]), "fingerprints")
    groups = near_groups(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), tau)
    return prints.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def one_of_each(docs: DataFrame, shingle: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, body) of the document that stays of each class of ``near_duplicates``.

    ``docs`` has doc_id, text and body, a hash of the text. The smallest (doc_id, body)
    stays, a NULL doc_id after all others.
    """
    prints = fingerprints(docs, shingle, ["doc_id", "body"])
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body")
    groups = near_groups(prints.groupBy("fp").agg(F.min(place).alias("least")), tau)
    return groups.select("least.doc_id", "least.body").distinct()
