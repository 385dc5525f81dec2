"""Published builds and the latest one per report."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.plans.grouped import attach
from tallyboard.sources import folders
from tallyboard.sources.manifest import TIMES

# Version of the record layout.
RECORD_VERSION = "0.1"
RECORD = (
    "schema_version string, slug string, title string, artifact_id string, "
    "built_at timestamp, tool_version string, runtime_version string"
)


def latest_record(manifest: DataFrame) -> DataFrame:
    """The registry record of a manifest row."""
    return manifest.select(
        F.lit(RECORD_VERSION).alias("schema_version"),
        F.col("report.slug").alias("slug"),
        F.col("report.title").alias("title"),
        F.col("artifact.id").alias("artifact_id"),
        F.col("build.built_at").cast("timestamp").alias("built_at"),
        F.col("build.tool_version").alias("tool_version"),
        F.col("build.runtime_version").alias("runtime_version"),
    )


def publish(records: DataFrame, registry: str) -> None:
    """Append build records; appending never touches an earlier publication.

    Records of a slug meet before the write, so a slug gets a few files, not one per task.
    """
    together = records.hint("rebalance", "slug")
    together.write.mode("append").option("timestampFormat", TIMES).partitionBy("slug").json(registry)


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    return spark.read.schema(RECORD).json(registry)


def registry_latest(builds: DataFrame) -> DataFrame:
    """Latest build per slug; records without slug or id are left out.

    ``max`` of a struct merges before the shuffle, so a slug with very many
    builds costs no more than any other.
    """
    usable = builds.where(F.col("slug").isNotNull() & F.col("artifact_id").isNotNull())
    others = [c for c in builds.columns if c not in ("slug", "built_at", "artifact_id")]
    newest = F.max(F.struct("built_at", "artifact_id", *others)).alias("newest")
    return usable.groupBy("slug").agg(newest).select("slug", "newest.*")


def registry_outdated(builds: DataFrame, latest: DataFrame) -> DataFrame:
    """Builds whose slug has a latest build with another id; age plays no part."""
    newest = latest.select(
        F.col("slug").alias("__slug"), F.col("artifact_id").alias("latest_artifact_id")
    )
    return attach(builds, newest, {"__slug": F.col("slug")}).where(
        F.col("artifact_id") != F.col("latest_artifact_id")
    )


@dataclass(frozen=True)
class Fold:
    """A folded registry: the latest record per slug of all commits up to a number."""

    number: int
    folder: str


class RegistryLog:
    """A registry as a log of publications with a folded snapshot of its past.

    A publication is a Parquet folder and, once that is complete, a commit file with the next
    number. Folding writes the latest record per slug of the last fold and of the commits
    since, and a fold file that names the last commit it holds. Whoever reads takes the
    last fold and the commits behind it. Files are made once and never changed, so what
    stops half-way leaves a folder that no commit or fold names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def publish(self, records: DataFrame) -> int:
        """Append build records; returns the number of the commit."""
        name = f"batch-{uuid.uuid4().hex}"
        rows = records.select(*[f.split()[0] for f in RECORD.split(", ")])
        rows.write.parquet(f"{self.folder}/batches/{name}")
        # Numbers go on where a fold has taken the commits in.
        number = max([0, *self._numbers("commits"), *self._numbers("folds")])
        while True:
            number += 1
            if folders.write_once(self.spark, self._file("commits", number), json.dumps(name)):
                return number

    def _file(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/{number:012d}.json"

    def _numbers(self, kind: str) -> list[int]:
        names = [name for name, _ in folders.children(self.spark, f"{self.folder}/{kind}")]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def _named(self, kind: str, number: int):
        return json.loads(folders.read_text(self.spark, self._file(kind, number)))

    def last_fold(self) -> Fold | None:
        numbers = self._numbers("folds")
        return Fold(numbers[-1], self._named("folds", numbers[-1])) if numbers else None

    def tail(self) -> list[int]:
        """Numbers of the commits that the last fold does not hold."""
        fold = self.last_fold()
        return [n for n in self._numbers("commits") if fold is None or n > fold.number]

    def _records(self, fold: Fold | None, numbers: list[int]) -> DataFrame:
        paths = [f"{self.folder}/batches/{self._named('commits', n)}" for n in numbers]
        if fold is not None:
            paths.append(f"{self.folder}/folded/{fold.folder}")
        if not paths:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*paths)

    def latest(self) -> DataFrame:
        """The latest record per slug: of the last fold and the commits behind it."""
        fold = self.last_fold()
        return registry_latest(self._records(fold, self.tail()))

    def fold(self) -> int | None:
        """Fold all commits up to now; returns the last one's number, None if none is new.

        Of two folds at once, that of the later commit counts; both are right.
        """
        fold, numbers = self.last_fold(), self.tail()
        if not numbers:
            return None
        name = f"fold-{uuid.uuid4().hex}"
        registry_latest(self._records(fold, numbers)).write.parquet(f"{self.folder}/folded/{name}")
        folders.write_once(self.spark, self._file("folds", numbers[-1]), json.dumps(name))
        return numbers[-1]

    def vacuum(self) -> int:
        """Remove publications and folds that the last fold holds; returns how many.

        Commit and fold files go first. Readers that began before may fail, as with any
        file that is removed; call it when none are left.
        """
        fold, removed = self.last_fold(), 0
        if fold is None:
            return 0
        for kind, home, limit in (("commits", "batches", fold.number + 1), ("folds", "folded", fold.number)):
            for number in [n for n in self._numbers(kind) if n < limit]:
                name = self._named(kind, number)
                folders.remove(self.spark, self._file(kind, number))
                folders.remove(self.spark, f"{self.folder}/{home}/{name}")
                removed += 1
        return removed
