"""Secret scans over every historical version of a corpus, by an incremental blob ledger.

A version is a path with a text; its text is a blob, addressed by its SHA-256. The
ledger is a folder with three Parquet tables: ``paths`` (which path has which blob),
``scanned`` (blob and rule version) and ``findings`` (spans by blob and rule version).
A run adds the addresses of the given versions, scans only pairs of blob and rule
version that the ledger lacks, each blob once however many paths have it, and joins
the findings back to all paths. Everything runs on Spark's own expressions.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ADDRESS = "path string, blob string"
SCANNED = "blob string, rule string"
FINDING = "blob string, rule string, kind string, start long, end long"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; matches that fail ``keep`` are dropped.

    ``keep`` is a pattern that has to fit the whole match; "" keeps every match.
    """

    kind: str
    pattern: str
    keep: str = ""

    @property
    def version(self) -> str:
        """Changes with anything that can change a finding."""
        text = "\x00".join([self.kind, self.pattern, self.keep])
        return f"{self.kind}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


ASSIGNED = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
)
#: In the order in which kinds at one place are listed.
BASE_RULES = (
    Rule("assign", ASSIGNED + "[A-Za-z0-9+/_.=-]+", ASSIGNED + "[A-Za-z0-9+/_.=-]{6,}"),
    # A run is taken whole, so asking for the length in the pattern changes no match.
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rule, kind, start, end) of the matches in ``blobs`` (blob, text, rules).

    Offsets are code points. The texts between the matches come from a split at
    the same pattern, so the start of a match is the length of what stands before
    it. The running sum is per blob and rule and holds the matches of one text.
    """

    def parts(rule: Rule) -> Column:
        gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
        matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
        wanted = F.array_contains("rules", rule.version) & F.col("text").rlike(rule.pattern)
        zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("found"))
        return F.struct(F.lit(rule.version).alias("rule"), F.when(wanted, zipped).alias("parts"))

    rows = (
        blobs.select("blob", F.explode(F.array(*[parts(rule) for rule in rules])).alias("of"))
        .where(F.col("of.parts").isNotNull())
        .select("blob", F.col("of.rule").alias("rule"), F.posexplode("of.parts").alias("at", "part"))
        .where(F.col("part.found").isNotNull())
        .select("blob", "rule", "at", F.col("part.gap").alias("gap"),
                F.col("part.found").alias("found"))
    )
    upto = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(upto))
    kind = keep = None
    for rule in rules:
        own = F.col("rule") == rule.version
        kind = F.when(own, rule.kind) if kind is None else kind.when(own, rule.kind)
        fits = F.col("found").rlike(f"^(?:{rule.keep})$") if rule.keep else F.lit(True)
        keep = F.when(own, fits) if keep is None else keep.when(own, fits)
    return placed.where(keep).select(
        "blob", "rule", kind.alias("kind"),
        (F.col("end") - F.length("found")).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
    )


class BlobLedger:
    """The ledger below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("paths", ADDRESS), ("scanned", SCANNED), ("findings", FINDING)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def read(self, name: str) -> DataFrame:
        schema = {"paths": ADDRESS, "scanned": SCANNED, "findings": FINDING}[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
        """Bring the ledger up to date with ``versions`` (path, text); return their addresses.

        The result has a row (path, blob) for each given row. NULL texts are empty
        blobs, repeated versions add nothing to the ledger, an empty frame does
        nothing. Findings are written before the pairs that vouch for them: a run
        that stops between the two scans those pairs again, and readers count
        equal rows once.
        """
        call = f"{self.path}/calls/{uuid.uuid4().hex}"
        here = versions.select(
            F.col("path").cast("string").alias("path"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"), address(F.col("text")).alias("blob"),
        )
        here.select("path", "blob").write.parquet(f"{call}/addresses")
        given = self.spark.read.schema(ADDRESS).parquet(f"{call}/addresses")
        same = F.expr("a.path <=> k.path AND a.blob = k.blob")
        given.distinct().alias("a").join(self.read("paths").alias("k"), same, "left_anti") \
            .write.mode("append").parquet(f"{self.path}/paths")

        # One path stands for each blob; only its text goes on to the scan.
        (
            given.groupBy("blob").agg(F.min(F.struct("path")).alias("first"))
            .select("blob", F.col("first.path").alias("path"),
                    F.explode(F.array(*[F.lit(r.version) for r in rules])).alias("rule"))
            .join(self.read("scanned"), ["blob", "rule"], "left_anti")
            .write.parquet(f"{call}/unseen")
        )
        pairs = self.spark.read.schema("blob string, path string, rule string").parquet(
            f"{call}/unseen"
        )
        # Keys without NULL, so that the join needs no second shuffle of the texts. Rows that
        # repeat path and text are put together before it: a blob is scanned once.
        place = [F.col("path").isNull().alias("nameless"),
                 F.coalesce("path", F.lit("")).alias("named"), F.col("blob")]
        todo = pairs.groupBy(*place).agg(F.collect_set("rule").alias("rules"))
        once = here.groupBy(*place).agg(F.first("text").alias("text"))
        unseen = once.join(todo, ["nameless", "named", "blob"]).select("blob", "text", "rules")
        spans(unseen, rules).distinct().write.mode("append").parquet(f"{self.path}/findings")
        pairs.select("blob", "rule").write.mode("append").parquet(f"{self.path}/scanned")
        return given

    def scanned(self) -> DataFrame:
        """(blob, rule): the pairs that need no further scan."""
        return self.read("scanned").distinct()

    def findings(self, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
        """(blob, spans): the spans of ``rules`` by start, then kind in the order of ``rules``."""
        kinds = F.array(*[F.lit(r.version) for r in rules])
        return (
            self.read("findings").where(F.col("rule").isin([r.version for r in rules])).distinct()
            .groupBy("blob")
            .agg(F.sort_array(F.collect_list(F.struct(
                "start", F.array_position(kinds, F.col("rule")).alias("order"), "kind", "end",
            ))).alias("spans"))
        )

    def findings_by_path(self, rules: Sequence[Rule] = BASE_RULES) -> DataFrame:
        """(path, blob, spans) of all paths that ever had a blob with a finding."""
        return self.read("paths").distinct().join(self.findings(rules), "blob")
