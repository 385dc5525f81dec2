"""Repair of conversation structure by a grammar-compressed dynamic program.

A conversation should be nothing, or a system turn that may be absent and then turns of user
and assistant in alternation. Rows may be kept, given the other role, or deleted; empty turns
may be put in. The cheapest edits are a shortest path over four states (nothing yet, after
system, user, assistant), a product of min-plus matrices, one per row. An entry holds the
cost and the audit: the initials of the edits, as a rope whose parts are shared.

A row counts for the matrices by its role and fault only. So conversations become sequences
of nine symbols, cut into segments of bounded length; equal segments are one sequence. Re-Pair
replaces frequent pairs of symbols by new ones, round by round over all sequences. The matrix
of a new symbol is the product of its two parts, evaluated once, bottom-up, and shared by all
conversations. The segments of a long conversation are multiplied in a tree, so no task
needs a whole conversation.

Ties go to the audit that is least in ASCII. Two audits of one entry with one cost are never
prefixes of each other (what is longer has inserted more), so the least parts make
the least whole and the product may be taken in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyboard.llm.common import cut, ranked, stored

#: Rows of a conversation that are one sequence.
SEGMENT = 1024
#: Rounds of Re-Pair and new symbols in each; a digram has to occur twice.
ROUNDS, RULES_A_ROUND = 8, 16
#: Segments multiplied in one step.
FAN_IN = 32
#: The first of the symbols that stand for pairs: private characters of Unicode.
FIRST_RULE = 0xE000
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ("su", "ua", "au")
#: Characters of a text that order rows of one turn before its SHA-256 does.
HEAD = 64
BLANK = " \t\n\x0b\x0c\r"


class Rope:
    """A text put together of shared parts."""

    __slots__ = ("leaf", "left", "right", "size")

    def __init__(self, leaf: str = "", left: Rope | None = None, right: Rope | None = None):
        self.leaf, self.left, self.right = leaf, left, right
        self.size = len(leaf) if left is None else left.size + right.size

    def __str__(self) -> str:
        found, todo = [], [self]
        while todo:
            part = todo.pop()
            if part.left is None:
                found.append(part.leaf)
            else:
                todo += [part.right, part.left]
        return "".join(found)

    def before(self, other: Rope) -> bool:
        """Whether this text is less than the other's; parts that both share are not read."""
        ours, theirs = [self], [other]
        while ours and theirs:
            a, b = ours.pop(), theirs.pop()
            if a is b:
                continue
            if a.left is not None and (b.left is None or a.size >= b.size):
                ours += [a.right, a.left]
                theirs.append(b)
            elif b.left is not None:
                theirs += [b.right, b.left]
                ours.append(a)
            else:
                n = min(a.size, b.size)
                if a.leaf[:n] != b.leaf[:n]:
                    return a.leaf[:n] < b.leaf[:n]
                if a.size > n:
                    ours.append(Rope(a.leaf[n:]))
                if b.size > n:
                    theirs.append(Rope(b.leaf[n:]))
        return not ours and bool(theirs)


#: (from, to): (cost, audit).
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def product(first: Matrix, second: Matrix) -> Matrix:
    """What the rows of ``first`` and then those of ``second`` do, at the least cost."""
    out: Matrix = {}
    for (i, k), (cost, audit) in first.items():
        for j in range(4):
            following = second.get((k, j))
            if following is None:
                continue
            total, known = cost + following[0], out.get((i, j))
            if known is not None and total > known[0]:
                continue
            rope = Rope(left=audit, right=following[1])
            if known is None or total < known[0] or rope.before(known[1]):
                out[i, j] = total, rope
    return out


def inserts() -> Matrix:
    """Empty turns put in between two rows, none included."""
    out = {(state, state): (0, Rope()) for state in range(4)}
    out |= {(state, USER): (INSERT, Rope("I")) for state in (START, SYSTEM, ASSISTANT)}
    out |= {(state, ASSISTANT): (2 * INSERT, Rope("II")) for state in (START, SYSTEM)}
    return out | {(USER, ASSISTANT): (INSERT, Rope("I"))}


def symbol_matrix(symbol: str) -> Matrix:
    """One row, and what is put in before it; ``symbol`` is "d" or the role's initial.

    "d" has to be deleted; x is any other role; a truncated row's letter is upper case.
    """
    row: Matrix = {(state, state): (DELETE, Rope("D")) for state in range(4)}
    if symbol != "d":
        extra = TRUNCATED if symbol.isupper() else 0
        for state in range(4):
            to = ASSISTANT if state == USER else USER
            row[state, to] = REROLE + extra, Rope("R")
        kept = STATE_OF.get(symbol.lower())
        for state in {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}.get(kept, ()):
            row[state, kept] = extra, Rope("K")
    return product(inserts(), row)


SYMBOLS = "dsuaxSUAX"


def matrices(rules: Sequence[str]) -> dict[str, Matrix]:
    """The matrix of every symbol; ``rules`` are the pairs in the order they were made."""
    known = {symbol: symbol_matrix(symbol) for symbol in SYMBOLS}
    for number, (left, right) in enumerate(rules):
        known[chr(FIRST_RULE + number)] = product(known[left], known[right])
    return known


def whole(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit of a complete conversation."""
    ended = product({k: v for k, v in matrix.items() if k[0] == START}, inserts())
    best: tuple[int, Rope] | None = None
    for state in (START, ASSISTANT):
        found = ended.get((START, state))
        if found and (best is None or found[0] < best[0]
                      or (found[0] == best[0] and found[1].before(best[1]))):
            best = found
    return best[0], str(best[1])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``rows`` after damage by the CRC-32 of "conv_id:turn".

    Modulo 20: 0 drops a row, 1 empties its text, 2 takes out its full stops, exclamation and
    question marks, 3 repeats it, 4 makes its role user. A NULL counts as one space.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return (
        rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                    kind.alias("kind"))
        .where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
                .alias("role"), text.alias("text"), times.alias("time"))
        .drop("time")
    )


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, timed, turn, role, head, digest, text): conv is null-safe, the rest its order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        F.struct("conv_id").alias("conv"), F.col("turn").isNotNull().alias("timed"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.substring(text, 1, HEAD).alias("head"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"),
    )


ORDER = ["timed", "turn", "role", "head", "digest"]


def symbols(rows: DataFrame) -> DataFrame:
    """(conv, pos, turn, initial, fault, symbol) of ``ordered`` rows.

    Places come from a distributed sort; "seen earlier" is a comparison with the first place
    of the same role and text, which is joined on only where a second one exists.
    """
    bare = F.rtrim("text", F.lit(BLANK))
    facts = rows.select(
        "conv", *ORDER, (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    placed = ranked(facts, ["conv"], ORDER, "pos", "rows")
    same = ["conv", "role", "digest"]
    again = placed.groupBy(*same).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times"))
    found = placed.join(again.where("times > 1").drop("times"), same, "left")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate")
        .when(F.col("open"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin(*STATE_OF), initial).otherwise("x")
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), "d")
        .when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    )
    return found.select("conv", "pos", "turn", "role", fault.alias("fault")).select(
        "conv", "pos", "turn", "fault", initial.alias("initial"), symbol.alias("symbol")
    )


def segments(rows: DataFrame, length: int) -> DataFrame:
    """(conv, segment, symbols, ...): the sequences, and what is counted, of every segment.

    A segment also sees the last row before it, so that neighbours are counted across cuts.
    """
    own = F.expr(f"pos div {length}")
    last = F.col("pos") % length == length - 1
    rows = rows.select(
        "*", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias("segment")
    )
    held = rows.groupBy("conv", "segment").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn", "fault", "initial", "symbol"))).alias("all")
    )
    mine = F.filter("all", lambda x: x["pos"] >= F.col("segment") * length)
    n = F.size("all")
    pairs = F.arrays_zip(
        F.slice("all", F.lit(1), n - 1).alias("a"), F.slice("all", F.lit(2), n - 1).alias("b")
    )
    illegal = F.filter("pairs", lambda p: ~F.concat(p["a"]["initial"], p["b"]["initial"]).isin(*LEGAL))
    fresh = F.filter("pairs", lambda p: p["b"]["turn"].isNotNull() & (
        p["a"]["turn"].isNull() | (p["a"]["turn"] != p["b"]["turn"])))
    opening = ((F.col("segment") == 0) & F.col("all")[0]["turn"].isNotNull()).cast("int")
    count = lambda fault: F.size(F.filter("mine", lambda x: x["fault"] == fault))
    return (
        held.withColumns({"mine": mine, "pairs": pairs}).where(F.size("mine") > 0)
        .select(
            "conv", "segment",
            F.array_join(F.transform("mine", lambda x: x["symbol"]), "").alias("symbols"),
            *[count(f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")],
            F.size(illegal).cast("long").alias("illegal"),
            (F.size(fresh) + opening).cast("long").alias("turns"),
            F.array_min(F.transform("mine", lambda x: x["turn"])).alias("low"),
            F.array_max(F.transform("mine", lambda x: x["turn"])).alias("high"),
        )
    )


@dataclass(frozen=True)
class Grammar:
    """Pairs of symbols, in the order they were made, and the sequences written in them."""

    rules: tuple[str, ...]
    packed: DataFrame


def re_pair(sequences: DataFrame, rounds: int = ROUNDS) -> Grammar:
    """Re-Pair over all ``sequences`` (symbols), each a row of its own.

    A round counts the pairs of neighbours of all sequences and replaces the most frequent
    ones, from the left, in the order of their counts. At most RULES_A_ROUND pairs a
    round reach the driver.
    """
    packed, rules = cut(sequences.withColumn("packed", F.col("symbols"))), []
    for _ in range(rounds):
        pairs = F.transform(
            F.sequence(F.lit(1), F.length("packed") - 1), lambda i: F.substring(F.col("packed"), i, F.lit(2))
        )
        frequent = (
            packed.where(F.length("packed") > 1).select(F.explode(pairs).alias("pair"))
            .groupBy("pair").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
            .orderBy(F.col("times").desc(), "pair").limit(RULES_A_ROUND).collect()
        )
        if not frequent:
            break
        written = F.col("packed")
        for row in frequent:
            written = F.replace(written, F.lit(row.pair), F.lit(chr(FIRST_RULE + len(rules))))
            rules.append(row.pair)
        packed = cut(packed.withColumn("packed", written))
    return Grammar(tuple(rules), packed)


ENTRIES = "array<struct<i: int, j: int, cost: long, audit: string>>"


def as_entries(matrix: Matrix) -> list[dict]:
    return [{"i": i, "j": j, "cost": c, "audit": str(a)} for (i, j), (c, a) in matrix.items()]


def as_matrix(entries: list[dict]) -> Matrix:
    return {(e["i"], e["j"]): (e["cost"], Rope(e["audit"])) for e in entries}


def evaluated(grammar: Grammar) -> DataFrame:
    """(symbols, cost, audit, entries): every sequence as a whole conversation, and its matrix."""
    rules = grammar.rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        for batch in batches:
            costs, audits, entries = [], [], []
            for packed in batch.column("packed").to_pylist():
                matrix = known[packed[0]]
                for symbol in packed[1:]:
                    matrix = product(matrix, known[symbol])
                cost, audit = whole(matrix)
                costs.append(cost)
                audits.append(audit)
                entries.append(as_entries(matrix))
            kind = pa.list_(pa.struct(
                [("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]
            ))
            yield pa.RecordBatch.from_arrays(
                [batch.column("symbols"), pa.array(costs, pa.int64()), pa.array(audits, pa.string()),
                 pa.array(entries, kind)], names=["symbols", "cost", "audit", "entries"],
            )

    return grammar.packed.select("symbols", "packed").mapInArrow(
        run, f"symbols string, cost long, audit string, entries {ENTRIES}"
    )


def joined_segments(parts: DataFrame, last: int) -> DataFrame:
    """(conv, cost, audit) of ``parts`` (conv, segment, entries), numbered up to ``last``.

    Neighbours are multiplied ``FAN_IN`` at a time until one is left.
    """
    schema = parts.select("conv", "segment", "entries").schema

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(
            (row for batch in batches for row in batch.to_pylist()), key=lambda row: row["segment"]
        )
        matrix = as_matrix(held[0]["entries"])
        for row in held[1:]:
            matrix = product(matrix, as_matrix(row["entries"]))
        first = held[0]["segment"]
        if first == 0:
            matrix = {k: v for k, v in matrix.items() if k[0] == START}
        row = {"conv": held[0]["conv"], "segment": first // FAN_IN, "entries": as_entries(matrix)}
        yield pa.RecordBatch.from_pylist([row], schema=kind)

    kind = to_arrow_schema(schema)
    while last > 0:
        parts = cut(
            parts.withColumn("step", F.expr(f"segment div {FAN_IN}"))
            .groupBy("conv", "step").applyInArrow(
                lambda table: pa.Table.from_batches(list(multiply(iter(table.to_batches()))), schema=kind),
                schema,
            )
        )
        last //= FAN_IN

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [whole(as_matrix(e)) for e in batch.column("entries").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array([c for c, _ in ends], pa.int64()),
                 pa.array([a for _, a in ends], pa.string())], names=["conv", "cost", "audit"],
            )

    out = parts.select("conv").schema.add("cost", "long").add("audit", "string")
    return parts.select("conv", "entries").mapInArrow(finish, out)


@dataclass
class Walk:
    """The turns that an audit makes of the rows of one conversation."""

    audit: str
    at: int = 0
    state: int = START

    def put(self, edit: str, role: str | None, text: str) -> tuple[str, str, str]:
        if role is None:
            role = "assistant" if self.state == USER else "user"
        self.state = STATE_OF[role[:1]]
        self.at += 1
        return edit, role, text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            yield self.put("Insert", None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        else:
            yield self.put(*(("Keep", role, text) if edit == "K" else ("Rerole", None, text)))


def walked(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, audit, role, text): an audit of each conversation, then its rows in order.

    A task streams through its conversations and holds one batch and one audit.
    """
    lines = rows.select("conv", F.lit(1).alias("kind"), *ORDER, F.lit("").alias("audit"), "text")
    empty = [F.lit(None).cast(rows.schema[name].dataType).alias(name) for name in [*ORDER, "text"]]
    heads = audits.select("conv", F.lit(0).alias("kind"), *empty[:-1], "audit", empty[-1])
    return (
        heads.union(lines).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER)
        .select("conv", "kind", "audit", "role", "text")
    )


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator, bool]]:
    """(conv, turns, whether it ends) for each row of ``walked`` and each end of a conversation."""
    walk, conv = None, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for key, kind, audit, role, text in zip(*columns, strict=True):
            if kind == 0:
                if walk is not None:
                    yield conv, walk.inserted(), True
                walk, conv = Walk(audit), key
            else:
                yield conv, walk.row(role, text), False
    if walk is not None:
        yield conv, walk.inserted(), True


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the turns of the repaired conversations.

    ``rows`` come from ``ordered``, ``audits`` (conv, audit) from ``repaired_audits``.
    """
    plan = walked(rows, audits)
    out = rows.select("conv").schema.add("place", "long").add("edit", "string")
    out = out.add("role", "string").add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [], 0
        for conv, turns, ends in steps(batches):
            for edit, role, text in turns:
                held.append({"conv": conv, "place": place, "edit": edit, "role": role, "text": text})
                place += 1
            place = 0 if ends else place
            if len(held) > 4096:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    kind = to_arrow_schema(out)
    return plan.mapInArrow(run, out)


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of the repaired turns, "role:text" joined by line feeds.

    A SHA-256 is sequential by definition: the turns of one conversation are streamed through
    one task, a batch at a time.
    """
    plan = walked(rows, audits)
    out = rows.select("conv").schema.add("repaired_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, first = [], hashlib.sha256(), True
        for conv, turns, ends in steps(batches):
            for _, role, text in turns:
                digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
                first = False
            if ends:
                held.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                digest, first = hashlib.sha256(), True
            if len(held) > 4096:
                yield pa.RecordBatch.from_pylist(held, schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    kind = to_arrow_schema(out)
    return plan.mapInArrow(run, out)


def repaired_audits(rows: DataFrame, length: int = SEGMENT) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of ``ordered`` rows."""
    parts = stored(segments(symbols(rows), length), "segments")
    table = stored(evaluated(re_pair(parts.select("symbols").distinct())), "sequences")
    counted = parts.groupBy("conv").agg(
        F.max("segment").alias("last"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "turns")],
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    span = F.least(wide("high") - wide("low") + 1 - wide("turns"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    gaps = F.coalesce(span, F.lit(0)).cast("long").alias("gaps")
    counted = stored(
        counted.select("conv", "last", gaps, "blank", "duplicate", "truncated", "illegal"), "counted"
    )
    ends = parts.where("segment = 0").select("conv", "symbols").join(
        table.select("symbols", "cost", "audit"), "symbols"
    )
    last = counted.agg(F.max("last")).first()[0] or 0
    if last:
        many = counted.where("last > 0").select("conv")
        ends = ends.join(many, "conv", "left_anti").select("conv", "cost", "audit").union(
            joined_segments(
                parts.join(many, "conv").select("conv", "segment", "symbols")
                .join(table.select("symbols", "entries"), "symbols")
                .select("conv", "segment", "entries"), last,
            )
        )
    return counted.drop("last").join(ends.select("conv", "cost", "audit"), "conv")


def repair(rows: DataFrame, conversations: DataFrame | None = None, length: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``rows`` has conv_id, turn, role and text. The rows of a conversation are taken by turn
    (NULL first), rows of one turn by role and text (its first 64 characters, then its
    SHA-256). NULL roles and texts are one space; a NULL conv_id is a conversation of its
    own. A role counts by its first letter; s, u and a are system, user and
    assistant, an empty role is none of them. Repeated rows are duplicates. A row's first fault counts:
    blank, duplicate, truncated. A conversation may have any number of rows, in segments of
    ``length``. ``conversations`` (conv_id) names further conversations that have no row;
    they have zeros and the digest of nothing. An empty frame gives no rows.
    """
    lines = ordered(rows)
    audits = stored(repaired_audits(lines, length), "audits")
    digests = repaired_digests(lines, audits.select("conv", "audit"))
    found = audits.join(digests, "conv")
    if conversations is not None:
        every = conversations.select(F.struct("conv_id").alias("conv")).distinct()
        found = every.join(found, "conv", "left")
    zero = F.lit(0).cast("long")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv.conv_id", *[F.coalesce(name, zero).alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
