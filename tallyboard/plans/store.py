"""Results of outputs kept as Parquet, for later sessions as well.

A result lies in a folder named after the SHA-256 of its key: the content it was computed
from, the definitions, the output and its parameter values. It is written to a folder of its
attempt first; then a commit file, which names the attempt, makes it the result. A session
that stops in between leaves an attempt that nobody reads and that ``evict`` clears away.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.plans.grouped import free_name
from tallyboard.sources import folders

COMMIT = "commit.json"


class ResultStore:
    """Durable results below ``folder``, which all executors have to see.

    It takes the place of a ``ResultCache``. ``hits`` counts results that were read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.hits = 0

    def _home(self, key: str) -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"

    def _committed(self, key: str) -> dict | None:
        text = folders.read_text(self.spark, f"{self._home(key)}/{COMMIT}")
        found = json.loads(text) if text else None
        # The name of a folder is a digest: the key itself has to agree too.
        return found if found and found["key"] == key else None

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``key``, computed and committed if there is none."""
        commit = self._committed(key)
        if commit is not None:
            self.hits += 1
            return self._read(key, commit)
        frame, attempt = make(), uuid.uuid4().hex
        place = free_name(frame.columns, "place") if is_ordered(frame) else None
        rows = frame if place is None else frame.withColumn(place, F.monotonically_increasing_id())
        rows.write.parquet(f"{self._home(key)}/{attempt}")
        commit = {
            "key": key, "attempt": attempt, "place": place, "schema": rows.schema.json(),
            "committed_at": datetime.now(timezone.utc).isoformat(),
        }
        if not folders.write_once(self.spark, f"{self._home(key)}/{COMMIT}", json.dumps(commit)):
            # Another session was first. Equal keys stand for equal results; theirs is read.
            commit = self._committed(key) or commit
        return self._read(key, commit)

    def _read(self, key: str, commit: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(commit["schema"]))
        rows = self.spark.read.schema(schema).parquet(f"{self._home(key)}/{commit['attempt']}")
        place = commit["place"]
        # Files are read in any order; an ordered result gets its order back.
        return rows if place is None else rows.orderBy(place).drop(place)

    def evict(self, older_than: timedelta, now: datetime | None = None) -> int:
        """Remove results committed longer ago than that, and attempts as old without a commit.

        The commit goes first, so that a result that is half removed is no result. Returns
        how many results and attempts were removed.
        """
        limit, removed = (now or datetime.now(timezone.utc)) - older_than, 0
        for name, _ in folders.children(self.spark, self.folder):
            home = f"{self.folder}/{name}"
            inside = dict(folders.children(self.spark, home))
            text = folders.read_text(self.spark, f"{home}/{COMMIT}")
            commit = json.loads(text) if text else None
            if commit and datetime.fromisoformat(commit["committed_at"]) < limit:
                folders.remove(self.spark, f"{home}/{COMMIT}")
                folders.remove(self.spark, home)
                removed += 1
                continue
            for attempt, changed_at in inside.items():
                kept = attempt == COMMIT or (commit and attempt == commit["attempt"])
                if not kept and changed_at < limit:
                    folders.remove(self.spark, f"{home}/{attempt}")
                    removed += 1
        return removed

    def clear(self) -> None:
        folders.remove(self.spark, self.folder)


def is_ordered(frame: DataFrame) -> bool:
    """Whether the rows of a frame have an order of their own."""
    return bool(frame._jdf.queryExecution().optimizedPlan().outputOrdering().nonEmpty())
