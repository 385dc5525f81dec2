import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.operators.series import series_rank
from tallyboard.operators.stack import stack_zero
from tallyboard.operators.tooltip import tooltip_entries
from tallyboard.plans.grouped import attach, free_name, position, sum_before


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of the rows, a run of identical rows, and a NULL group."""
    ids = spark.range(3000)
    group = F.when(F.col("id") < 1000, F.lit("hot")).when(
        F.col("id") % 50 == 0, F.lit(None)
    ).otherwise(F.concat(F.lit("g"), F.col("id") % 40))
    return ids.select(
        group.alias("g"),
        F.when(F.col("id") < 300, F.lit(5)).otherwise(F.col("id") % 97).cast("int").alias("k"),
        F.when(F.col("id") < 300, F.lit(2)).otherwise(F.col("id") % 13).cast("double").alias("v"),
    )


@pytest.mark.parametrize("group", [["g"], []])
def test_ranged_sums_equal_a_sequential_scan(skewed, group):
    order = ["k", "v"]
    rows = [row.asDict() for row in skewed.collect()]
    key = lambda r: tuple("" if r[c] is None else r[c] for c in order)
    expected = []
    for name in {tuple(r[c] for c in group) for r in rows}:
        total = 0.0
        for row in sorted((r for r in rows if tuple(r[c] for c in group) == name), key=key):
            expected.append((*map(str, name), row["k"], row["v"], total))
            total += row["v"]
    found = sum_before(skewed, F.col("v"), group, order, "before")
    assert found.columns == ["g", "k", "v", "before"]
    got = [(*[str(r[c]) for c in group], r.k, r.v, float(r.before)) for r in found.collect()]
    assert sorted(got) == sorted(expected)


def test_ranged_positions_are_complete(skewed):
    placed = position(skewed, ["g"], ["k", "v"], "place")
    per_group = placed.groupBy("g").agg(
        F.count("*").alias("n"), F.min("place").alias("low"),
        F.max("place").alias("high"), F.count_distinct("place").alias("d"),
    )
    for row in per_group.collect():
        assert (row.low, row.high, row.d) == (1, row.n, row.n)


def test_ranged_path_splits_the_hot_group(skewed):
    placed = skewed.repartitionByRange(8, "g", "k", "v", F.rand(1)).withColumn(
        "part", F.spark_partition_id()
    )
    assert placed.where("g = 'hot'").select("part").distinct().count() > 1


def test_attach_matches_null_keys(frame):
    rows = frame([("a", 1), (None, 2), ("b", 3)], "g string, v int")
    side = frame([("a", 10), (None, 20)], "g string, total int")
    joined = attach(rows, side, {"g": F.col("g")})
    assert joined.columns == ["g", "v", "total"]
    assert sorted(values(joined, "v", "total")) == [(1, 10), (2, 20), (3, None)]


def test_free_name():
    assert free_name(["a"], "b") == "b"
    assert free_name(["b", "b_"], "b") == "b__"


def test_operators_do_not_depend_on_the_cut(spark, skewed):
    unique = skewed.groupBy("g", "k").agg((F.sum("v") - 40).alias("v"))
    for build in (
        lambda: stack_zero(unique, "g", "v", ["k"]),
        lambda: tooltip_entries(unique, "g", "v", ["k"], series="k").drop("details"),
        lambda: series_rank(unique, "k"),
        lambda: series_rank(unique, "k", reverse=True),
    ):
        found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
        for count in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", count)
            found.append(sorted(map(repr, build().collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert found[0] == found[1]


def test_a_hot_key_is_split_when_the_side_is_not_broadcast(spark):
    """With a large per-group side the join shuffles, and the hot partition is split."""
    rows = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        totals = rows.groupBy(F.col("g").alias("k")).agg(F.count("*").alias("n"))
        joined = attach(rows, totals, {"k": F.col("g")})
        counted = joined.groupBy("n").agg(
            F.count("*").alias("rows"), F.count_distinct("payload").alias("payloads")
        )
        assert sorted(values(counted)) == [(1, 266_666, 266_666), (133_334, 133_334, 133_334)]
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
