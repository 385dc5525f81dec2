"""Removal of repeated runs of lines, by a suffix array over line ids.

Every line of every different text starts a suffix, a sequence of line ids up to the end of its
text. Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: the next rank orders
the pair of a suffix's rank and the rank of the suffix that starts where its known prefix
ends. Ranks come from a distributed sort of the different pairs. Suffixes whose prefix is
unique are settled and leave; doubling goes on until all have left.

Suffixes of one rank are an interval of the suffix array whose longest common prefix reaches
that many lines. For each place the longest interval with an earlier place in it is found: first
among the powers of two, then by halving steps between two of them, where a prefix of any length
is the pair of the ranks at its front and at its end. That length is the longest run that starts
at the place and also starts earlier. Runs that are no part of the one a line before are
maximal. Those of three lines or more, or with a line of eight words, are later copies that go.

A text that occurs again as a whole is one run in itself and takes no part in the doubling.
Everything is DataFrame operations. A line that makes up a third of all lines is one row
among the different pairs, and its places are only joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import cut, ranked, shared_path, stored

#: A repeated run goes if it has so many lines, or a line of so many words.
LINES, WORDS = 3, 8
WORD = r"[^\x20\x09-\x0D]+"


def is_long(line: Column, words: int) -> Column:
    return F.regexp_count(line, F.lit(WORD)) >= words


def suffixes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(row, at, first, second, long): the place and the 128-bit id of every line."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return docs.select("row", F.posexplode(lines).alias("at", "line")).select(
        "row", "at", F.xxhash64("line").alias("first"),
        F.xxhash64(F.lit("second"), F.reverse("line")).alias("second"),
        is_long(F.col("line"), words).alias("long"),
    )


def ranks_of(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(row, at, rank): rows by the order of (left, right), for pairs that occur again.

    Equal pairs have the same rank, the number of rows of smaller pairs.
    """
    seen = pairs.groupBy(left, right).agg(F.count(F.lit(1)).alias("rows"))
    placed = ranked(seen, [], [left, right], "_rank", "_all", weight="rows")
    again = placed.where("rows > 1").select(
        F.col(left).alias("_left"), F.col(right).alias("_right"),
        F.col("_rank").alias("_new_rank"),
    )
    same = (F.col(left) == F.col("_left")) & (F.col(right) == F.col("_right"))
    return pairs.join(again, same).select("row", "at", F.col("_new_rank").alias("rank"))


def levels(lines: DataFrame) -> DataFrame:
    """(level, row, at, rank): ranks of prefixes of 2**level lines that occur again.

    ``lines`` has row, at, first and second, one row for each place. Levels are written as
    one table, so that what reads them has one input and a small plan.
    """
    spark = lines.sparkSession
    path, paths = shared_path(spark, "line-ranks"), []
    pairs, left, right = lines, "first", "second"
    while True:
        ranks = ranks_of(pairs, left, right).select(F.lit(len(paths)).alias("level"), "row", "at", "rank")
        paths.append(f"{path}/{len(paths)}")
        ranks.write.parquet(paths[-1])
        known = spark.read.schema(ranks.schema).parquet(paths[-1])
        if not known.limit(1).count():
            return spark.read.schema(ranks.schema).parquet(*paths)
        step = 1 << (len(paths) - 1)
        further = known.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        pairs, left, right = known.join(further, ["row", "at"]).drop("level"), "rank", "next"


def place() -> Column:
    return F.struct("row", "at")


def earlier_runs(ranks: DataFrame) -> DataFrame:
    """(row, at, length, first): the longest run from each place that also starts earlier.

    ``ranks`` comes from ``levels``; ``first`` is the earliest place of the run.
    """
    heads = ranks.groupBy("level", "rank").agg(F.min(place()).alias("first"))
    later = ranks.join(heads, ["level", "rank"]).where(F.col("first") < place())
    # The longest power of two; ``more`` lines are known to follow it. Steps are written as tables:
    # a checkpoint would hand what is known of its columns on and on to the planner.
    found = stored(
        later.groupBy("row", "at").agg(F.max_by(F.struct("level", "rank", "first"), "level").alias("best"))
        .select("row", "at", "best.*", F.lit(0).alias("more")), "line-runs",
    )
    top = found.agg(F.max("level")).first()[0] or 0
    second = ranks.select("level", "row", F.col("at").alias("end"), F.col("rank").alias("end_rank"))
    for back in range(1, top + 1):
        # Each place of a level tries as many lines more as a halving step has.
        step = F.expr(f"shiftleft(1, level - {back})")
        tried = found.where(F.col("level") >= back).withColumn("try", F.col("more") + step)
        tests = tried.select("level", "rank", "try").distinct()
        members = (
            ranks.join(tests, ["level", "rank"]).withColumn("end", F.col("at") + F.col("try"))
            .join(second, ["level", "row", "end"]).drop("end")
        )
        firsts = members.groupBy("level", "rank", "try", "end_rank").agg(F.min(place()).alias("longer"))
        met = (
            members.join(firsts, ["level", "rank", "try", "end_rank"])
            .where(F.col("longer") < place()).select("level", "row", "at", "try", "longer")
        )
        found = stored(
            found.withColumn("try", F.col("more") + step)
            .join(met, ["level", "row", "at", "try"], "left")
            .select(
                "row", "at", "level", "rank", F.coalesce("longer", "first").alias("first"),
                F.when(F.col("longer").isNotNull(), F.col("try")).otherwise(F.col("more")).alias("more"),
            ), "line-runs",
        )
    length = F.expr("shiftleft(1, level) + more")
    return found.select("row", "at", length.alias("length"), "first")


def later_copies(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """(row, start, length, first_row, first_start): maximal runs that also start earlier.

    ``docs`` has row (a sortable key) and text, each row once. Earlier means at a smaller row,
    or in the same row before. Of all maximal runs those are given that have at least
    ``lines`` lines or a line of at least ``words`` words; ``first_row`` and ``first_start``
    tell where a run occurs first.
    """
    places = cut(suffixes(docs, words))
    runs = earlier_runs(levels(places))
    in_row = Window.partitionBy("row").orderBy("at")
    before = F.struct(F.lag("at").over(in_row).alias("at"), F.lag("length").over(in_row).alias("length"))
    part = (F.col("before.at") == F.col("at") - 1) & (F.col("length") < F.col("before.length"))
    maximal = cut(
        runs.withColumn("before", before).where(~F.coalesce(part, F.lit(False)))
        .select("row", F.col("at").alias("start"), "length", F.col("first.row").alias("first_row"),
                F.col("first.at").alias("first_start"))
    )
    short = maximal.where(F.col("length") < lines)
    each = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")
    telling = (
        short.select("row", "start", each)
        .join(places.where("long").select("row", "at"), ["row", "at"])
        .select("row", "start").distinct()
    )
    return maximal.where(F.col("length") >= lines).union(short.join(telling, ["row", "start"], "left_semi").select(
        *maximal.columns
    ))


def joined_runs(runs: DataFrame) -> DataFrame:
    """(row, gone, longest): the lines that runs cover as sorted, separate (start, stop) pairs."""
    order = Window.partitionBy("row").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = (
        runs.withColumn("stop", F.col("start") + F.col("length"))
        .withColumn("apart", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
        .withColumn("piece", F.sum("apart").over(order))
        .groupBy("row", "piece").agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("length").alias("longest"))
    )
    return pieces.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"),
        F.max("longest").alias("longest"),
    )


def remove_repeated_runs(docs: DataFrame, lines: int = LINES, words: int = WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, longest, kept) for every row of ``docs`` (doc_id, text).

    Lines are separated by a line feed and compared exactly; empty lines are lines, a
    NULL text is one empty line. A line goes if it lies in a run that also starts earlier, at a
    smaller doc_id or in the same document before, and that has at least ``lines`` lines or
    a line of at least ``words`` words; so blank and short lines alone stay. What is removed
    is judged on the input. A NULL doc_id counts as the largest; rows that repeat doc_id and
    text are one document. ``longest`` is the length of the longest run removed, ``kept`` the
    remaining lines joined by line feeds, NULL if none remains. A text of any length is
    split in one task; its removal takes one pass over its lines and runs.
    """
    spark = docs.sparkSession
    key = F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("key"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("body"),
    )
    rows = docs.select(key.alias("row"), "doc_id", "text")
    # Of texts that are equal as a whole the first stands for all; the others are one run each.
    heads = rows.groupBy("row.body").agg(F.min("row").alias("row")).select("row", "body")
    every = rows.select("row").distinct().withColumn("body", F.col("row.body"))
    copies = every.join(heads.select("body", F.col("row").alias("head")), "body").where(
        F.col("row") != F.col("head")
    )
    once = rows.groupBy("row").agg(F.first("text").alias("text")).join(heads.select("row"), "row")
    spans = joined_runs(later_copies(once, lines, words)).select("row", "gone", "longest", F.lit(False).alias("whole"))
    path = shared_path(spark, "line-runs")
    spans.union(copies.select(
        "row", F.lit(None).cast("array<struct<start:int,stop:int>>"), F.lit(None).cast("int"), F.lit(True)
    )).write.parquet(path)
    spans = spark.read.parquet(path)
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    n = F.size("_lines")
    enough = F.col("whole") & ((n >= lines) | F.exists("_lines", lambda line: is_long(line, words)))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("stop")))
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    gone = F.coalesce(F.when(enough, whole), "gone", nothing)
    # What stays lies between the end of one piece and the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda x: x["stop"]))
    starts = F.concat(F.transform("_gone", lambda x: x["start"]), F.array(n))
    stay = F.flatten(F.transform(
        F.arrays_zip(ends.alias("from"), starts.alias("to")),
        lambda x: F.slice(F.col("_lines"), x["from"] + 1, x["to"] - x["from"]),
    ))
    return (
        # Texts are shuffled at every size, so costs keep in proportion to the input.
        rows.join(spans.hint("merge"), "row", "left")
        .withColumn("_lines", split).withColumn("_gone", gone).withColumn("_stay", stay)
        .select(
            "doc_id", n.cast("long").alias("n_lines"),
            (n - F.size("_stay")).cast("long").alias("n_removed"),
            F.coalesce(F.when(enough, n), "longest", F.lit(0)).alias("longest"),
            F.when(F.size("_stay") > 0, F.array_join("_stay", "\n")).alias("kept"),
        )
    )
