"""Mixing sources to target weights by entropy balancing.

Documents start at rate one. The rates w that stay closest to it in relative
entropy while every source s gives its target of words, sum(w * size) = T_s, with
0 <= w <= cap, are w = min(cap, exp(lambda_s * size)). The multipliers solve a
convex dual by Newton steps; each step is one grouped sum over all sources at
once. Rates are then rounded into whole copies.

Sizes of a source are counted first. Documents of one source and size have one
rate, so (source, size, count) is all that the dual depends on, and a hot source
or a group of copies costs no more than its distinct sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.common import cut, ranked

CAP = 3
NEWTON_ROUNDS = 40
TOLERANCE = 1e-9
REPAIR_ROUNDS = 6
EXACT = "decimal(38,12)"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def capped_targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): shares of all words by weight.

    A target stops at ``cap`` times the source's size and the excess is shared
    again. Sorted by cap over weight, the stopped sources come first, and each
    is tested against what those before it leave. One row per source.
    """
    line = Window.orderBy(
        (F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        sources.withColumn("_cap", F.col("source_size") * F.lit(cap))
        .withColumn(
            "_left",
            F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        )
        .withColumn("_weights", F.sum("weight").over(after))
        .withColumn("_stops", F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("weight"))
        .withColumn("_share", F.col("_left") / F.col("_weights"))
    )
    # The first source that does not stop sets the share of all that follow.
    free = F.first(F.when(~F.col("_stops"), F.col("_share")), ignorenulls=True).over(
        line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return level.select(
        *sources.columns,
        F.when(F.col("_stops"), F.col("_cap").cast("double"))
        .otherwise(free * F.col("weight")).alias("target"),
    )


def cycle_weights(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight): weights repeat over sources by code point, NULL last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
        .withColumn("weight", F.element_at(cycle, (place % len(weights)) + 1))
    )


def solve_rates(sizes: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``rate`` to (source, size, count): the entropy-balanced rate of each document.

    The multiplier of a source is kept between a value where it gives too few
    words and one where it gives too many; a Newton step that leaves the bracket
    is replaced by its middle. Sums are of decimals, so reruns agree to the bit. A source
    that has not reached its target after NEWTON_ROUNDS raises an error: its rates are
    never used as they are.
    """
    scale = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1.0))
    known = cut(
        sources.join(
            sizes.groupBy(F.col("source").alias("_s")).agg(
                F.sum("count").alias("documents"), F.max("size").alias("largest"),
                F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"),
            ),
            F.col("source").eqNullSafe(F.col("_s")),
        ).drop("_s").withColumn("scale", scale)
    )
    cells = cut(
        sizes.join(
            known.select(F.col("source").alias("_s"), "scale", "target", "source_size"),
            F.col("source").eqNullSafe(F.col("_s")),
        ).drop("_s").withColumn("x", F.col("size") / F.col("scale"))
    )
    # At the upper end the smallest document reaches the cap; at the lower one the
    # words of all documents together are below any target.
    most = F.log(F.lit(float(cap))) * F.col("scale") / F.col("smallest")
    state = cut(
        known.where((F.col("source_size") > 0) & (F.col("target") > 0)).select(
            "source", "target",
            # A source whose target is its cap starts where all rates are at the cap.
            F.when(F.col("target") >= F.col("source_size") * cap, most).otherwise(0.0).alias("tilt"),
            (-F.log(F.col("source_size") * 2 / F.col("target") + 2)
             * F.col("scale") / F.col("smallest")).alias("low"),
            most.alias("high"),
        )
    )
    rate = F.least(F.exp(F.col("tilt") * F.col("x")), F.lit(float(cap)))
    for _ in range(NEWTON_ROUNDS):
        tilts = state.select(F.col("source").alias("_s"), "tilt")
        words = F.col("count") * F.col("size") * rate
        slope = F.when(rate < cap, words * F.col("x")).otherwise(0.0)
        sums = (
            cells.join(tilts, F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("_s")
            .agg(F.sum(words.cast(EXACT)).cast("double").alias("words"),
                 F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        )
        step = F.col("tilt") + (F.col("target") - F.col("words")) / F.col("slope")
        short = F.col("words") < F.col("target")
        low = F.when(short, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(short, F.col("high")).otherwise(F.col("tilt"))
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        done = F.abs(F.col("words") / F.col("target") - 1) < TOLERANCE
        state = cut(
            state.join(sums, F.col("source").eqNullSafe(F.col("_s"))).select(
                "source", "target",
                F.when(done, F.col("tilt")).when(inside, step)
                .otherwise((low + high) / 2).alias("tilt"),
                low.alias("low"), high.alias("high"), done.alias("done"),
            )
        )
        if not state.where(~F.col("done")).limit(1).count():
            break
    else:
        unsolved = state.where(~F.col("done")).select("source").first()
        raise ArithmeticError(
            f"source {unsolved['source']!r} is off its target after {NEWTON_ROUNDS} Newton steps"
        )
    tilts = state.select(F.col("source").alias("_s"), "tilt")
    return (
        cells.join(tilts, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("source", "size", "count", "target",
                F.round(F.when(F.col("tilt").isNotNull(), rate).otherwise(0.0), 9).alias("rate"))
    )


def whole_copies(rates: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``copies``: how many copies all documents of a (source, size) get together.

    Going from large sizes to small ones, the running sum of count * rate is
    rounded, which keeps the words of a source within about its largest document.
    A few repair rounds then add or remove copies of the largest size that still
    fits into what is missing or in excess. A window holds the distinct sizes of
    a source, which its longest document bounds, whatever its number of rows.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    running = F.sum((F.col("count") * F.col("rate")).cast(EXACT)).over(
        down.rowsBetween(Window.unboundedPreceding, 0)
    )
    step = F.round(running, 0).cast("long")
    most = F.col("count") * F.lit(cap)
    plan = rates.withColumn("_to", step).withColumn(
        "copies",
        F.least(F.greatest(F.col("_to") - F.lag("_to", 1, 0).over(down), F.lit(0)), most),
    ).drop("_to")
    plan = cut(plan.withColumn("copies", F.col("copies").cast("long")))
    whole = Window.partitionBy("source")
    for _ in range(REPAIR_ROUNDS):
        missing = F.round(
            F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole), 0
        ).cast("long")
        room = F.when(F.col("_missing") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_missing")) & (room > 0)
        chosen = F.max(F.when(fits, F.col("size"))).over(whole)
        moved = F.least(F.expr("abs(_missing) div size"), room) * F.signum("_missing")
        plan = (
            plan.withColumn("_missing", missing)
            .withColumn("_chosen", chosen)
            .withColumn(
                "copies",
                F.when(F.col("size") == F.col("_chosen"), F.col("copies") + moved.cast("long"))
                .otherwise(F.col("copies")),
            )
            .drop("_missing", "_chosen")
        )
    return plan


def balanced_copies(
    frame: DataFrame,
    key: str,
    source: str = "source",
    size: str = "size",
    ties: tuple[str, ...] = (),
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = CAP,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` (0 to ``cap``) to every row.

    NULL sources are one source, last in order. Sources without words have
    target 0 and their documents no copies. Documents of one source and size
    share their copies: each gets the whole part, and the first by hash of the
    key one more; repeated rows are told apart by their place only. An empty
    frame gives no rows.
    """
    named = frame.withColumnsRenamed({source: "source", size: "size"})
    sizes = cut(named.groupBy("source", "size").agg(F.count(F.lit(1)).alias("count")))
    sources = cut(capped_targets(cycle_weights(sizes, weights), cap))
    plan = cut(whole_copies(solve_rates(sizes, sources, cap), cap))
    placed = ranked(
        named.withColumn("_order", F.xxhash64(F.lit("copies"), F.col(key).cast("string"))),
        ["source", "size"], ["_order", key, *ties], "_rank", "_rows",
    )
    plan = plan.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("copies").alias("_copies")
    )
    sources = sources.select(F.col("source").alias("_t"), "source_size", "target")
    extra = (F.col("_rank") < F.col("_copies") % F.col("_rows")).cast("long")
    return (
        placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
        .join(sources, F.col("source").eqNullSafe(F.col("_t")))
        .withColumn("copies", F.expr("_copies div _rows") + extra)
        .drop("_order", "_rank", "_rows", "_s", "_z", "_copies", "_t")
        .withColumnsRenamed({"source": source, "size": size})
    )
