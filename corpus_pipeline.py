"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept. Its result is written as Parquet and read again as the next one's ``docs``.
Documents are told apart by doc_id and text; rows that repeat both are one document from
the near-duplicate stage on, except for the copies that the mixing stage makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm import balance, common, decontaminate, sharding, simhash, toxicity

SHARDS = 8
#: No SQL fingerprints, tiles or trains; tests compare the stages with plain versions.
ORACLE_SQL = None


def body() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row): every row of ``docs`` as one value, so that no column can clash with another."""
    return docs.select(
        F.struct("doc_id", body().alias("body")).alias("key"),
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"),
    )


def chosen(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(row, plan): documents that ``plan`` (doc_id, body, ...) names, once each.

    Rows that repeat a document are put together before the shuffle, so a row that makes
    up a third of the table arrives once a task. Neither side is broadcast unseen.
    """
    others = [name for name in plan.columns if name not in ("doc_id", "body")]
    plan = plan.select(
        F.struct("doc_id", "body").alias("key"), F.struct(*others, F.lit(1)).alias("plan")
    )
    once = keyed(docs).groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return once.join(plan, "key").select("row", "plan")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that score as toxic; NULL and empty texts are clean.

    The scores are learned from labelled documents that are not held out.
    """
    labels = common.table(spark, sf_dir, "labels").where(
        ~toxicity.held_out(F.col("doc_id"))
    ).select("doc_id", F.col("toxic").alias("label"))
    weights = toxicity.train(docs.select("doc_id", "text"), labels)
    into = common.free_name("toxicity", docs.columns)
    scored = toxicity.score(docs, weights, [F.col(f"`{n}`") for n in docs.columns], into=into)
    return scored.where(F.col(into) < 0.5).select(*[f"`{n}`" for n in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Groups are those of the SimHash operator: fingerprints of three-word shingles that
    reach each other over steps of two bits at most.
    """
    rows = docs.select("doc_id", "text", body().alias("body"))
    return chosen(docs, simhash.one_of_each(rows)).select("row.*")


def keep_untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every benchmark item."""
    benchmark = common.table(spark, sf_dir, "benchmark")
    found = decontaminate.contaminated(docs.select("doc_id", "text"), benchmark)
    leaks = found.where(F.col("coverage") >= decontaminate.COVERAGE).select(
        F.struct("doc_id", "body").alias("key")
    )
    return keyed(docs).join(leaks, "key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, up to three times, or not at all.

    Texts without words are no words of any source and are left out.
    """
    sizes = docs.select(
        "doc_id", body().alias("body"), "source", balance.word_count(F.col("text")).alias("size")
    )
    plan = (
        balance.balanced_copies(sizes, "doc_id", ties=("body",))
        .groupBy("doc_id", "body").agg(F.sum("copies").alias("times")).where("times > 0")
    )
    times = F.explode(F.sequence(F.lit(1), F.col("plan.times").cast("int"))).alias("time")
    return chosen(docs, plan).select("row", times).select("row.*")


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, 0 to 7, and their place in it (columns shard, slot).

    Columns of these names that the documents have already are replaced.
    """
    kept = [n for n in docs.columns if n.lower() not in ("shard", "slot")]
    rows = docs.select("doc_id", body().alias("body"), "source")
    placed = sharding.interleaved_shards(rows, "doc_id", "source", ["body"], SHARDS)
    plan = placed.groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places")
    )
    return (
        chosen(docs.select(*[f"`{n}`" for n in kept]), plan)
        .select("row", F.explode("plan.places").alias("place"))
        .select("row.*", "place.shard", "place.slot")
    )


STAGES = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_untested),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
