"""A report as a Spark job: sources, parameters, views and outputs.

Views and outputs are functions from their inputs to a DataFrame. They stay lazy,
so Spark itself reads and computes only what a run asks for.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession

from tallyboard.operators.options import param_options
from tallyboard.plans.definition import NoText, definition_text
from tallyboard.plans.params import MultiSelect, Param
from tallyboard.plans.store import ResultStore
from tallyboard.sources.load import Source, register

VIEW, QUERY = "view", "query"
DONE, PLANNED, FAILED, SKIPPED = "done", "planned", "failed", "skipped"
STATUS_SCHEMA = "output string, kind string, status string, message string"


class ReportError(ValueError):
    """A report whose blocks do not fit together."""


@dataclass(frozen=True)
class Block:
    """A named view or query with its declared inputs and parameters."""

    name: str
    kind: str
    build: Callable[[Inputs], DataFrame]
    reads: tuple[str, ...]
    uses: tuple[str, ...] = ()
    text: str = ""
    keep: bool = False


@dataclass(frozen=True)
class Lineage:
    sources: tuple[str, ...]
    params: tuple[str, ...]
    blocks: tuple[str, ...]


class Inputs:
    """What a block's function sees: its input frames and parameter columns."""

    def __init__(
        self, spark: SparkSession, frames: Mapping[str, DataFrame],
        params: Mapping[str, Param], values: Mapping[str, Any],
    ):
        self.spark, self._frames = spark, frames
        self._params, self._values = params, values

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def value(self, param: str) -> Any:
        return self._values[param]

    def filter(self, column: str | Column, param: str) -> Column:
        """The predicate of a select, multiselect or date range."""
        return self._params[param].predicate(column, self._values[param])

    def dimension(self, param: str) -> Column:
        """The chosen breakdown; the caller gives it an alias."""
        return self._params[param].field_column(self._values[param])

    def sql(
        self, text: str, args: Mapping[str, Any] | None = None, **frames: DataFrame
    ) -> DataFrame:
        """Spark SQL over the inputs as ``{name}``, or over frames derived from them."""
        return self.spark.sql(text, dict(args or {}), **{**self._frames, **frames})


@dataclass
class Run:
    """Outputs and views of a run, and what happened to each block."""

    outputs: dict[str, DataFrame] = field(default_factory=dict)
    views: dict[str, DataFrame] = field(default_factory=dict)
    events: list[tuple[str, str, str, str | None]] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)

    def status(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, STATUS_SCHEMA)

    def release(self) -> None:
        """Let go of the views that were kept for this run's outputs."""
        while self.kept:
            self.kept.pop().unpersist()


class ResultCache:
    """Persisted outputs by content, output, and the parameters it depends on.

    Persisted data keeps its lineage, so an executor that is lost costs a
    recomputation and nothing else.
    """

    def __init__(self, size: int = 32):
        self.size = size
        self._kept: OrderedDict[str, DataFrame] = OrderedDict()
        self.hits = 0

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self._kept:
            self.hits += 1
            self._kept.move_to_end(key)
            return self._kept[key]
        frame = make().persist()
        self._kept[key] = frame
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)[1].unpersist()
        return frame

    def clear(self) -> None:
        while self._kept:
            self._kept.popitem()[1].unpersist()


class Report:
    def __init__(
        self, spark: SparkSession, slug: str, title: str, *,
        timezone: str | None = None, cache: ResultCache | ResultStore | None = None,
    ):
        self.spark, self.slug, self.title, self.timezone = spark, slug, title, timezone
        self.sources: dict[str, Source] = {}
        self.params: dict[str, Param] = {}
        self.blocks: dict[str, Block] = {}
        self.cache = cache
        self.snapshot_id = ""

    # Declaration.

    def source(self, source: Source) -> Source:
        self.sources[source.name] = source
        register([source])
        return source

    def param(self, name: str, param: Param) -> None:
        if isinstance(param, MultiSelect):
            origin = self.sources.get(param.options.source)
            if origin is None:
                raise ReportError(f"parameter {name!r}: no source {param.options.source!r}")
            if param.options.column not in origin.frame.columns:
                raise ReportError(
                    f"parameter {name!r}: no column {param.options.source}.{param.options.column}"
                )
        self.params[name] = param

    def _add(self, block: Block) -> None:
        if block.name in self.sources or block.name in self.blocks:
            raise ReportError(f"the name {block.name!r} is already taken")
        self.blocks[block.name] = block

    def _declare(
        self, kind: str, name: str, reads: Iterable[str], uses: Iterable[str], keep: bool = False,
        version: str | None = None,
    ):
        def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
            text = _source_text(build, version)
            self._add(Block(name, kind, build, tuple(reads), tuple(uses), text, keep))
            return build

        return add

    def view(
        self, name: str, *, reads: Iterable[str], uses: Iterable[str] = (), keep: bool = False,
        version: str | None = None,
    ):
        """Decorator for a reusable relation.

        A view is computed by every output that reads it, with only the columns
        and rows that the output needs. ``keep`` stores it for the run instead:
        worth it for a small result of a large scan that many outputs read. The
        function's text, its defaults and the values and functions it sees are part of the
        report's identity; ``version`` stands in for them where they have no text.
        """
        return self._declare(VIEW, name, reads, uses, keep, version)

    def query(
        self, name: str, *, reads: Iterable[str], uses: Iterable[str] = (),
        version: str | None = None,
    ):
        """Decorator for an output; ``version`` as for a view."""
        return self._declare(QUERY, name, reads, uses, version=version)

    def sql_block(
        self, kind: str, name: str, text: str, *, reads: Iterable[str],
        filters: Mapping[str, Mapping[str, str]] | None = None,
        dimensions: Mapping[str, Mapping[str, str]] | None = None,
        uses: Iterable[str] = (),
    ) -> None:
        """A view or output from Spark SQL over its inputs as ``{name}``.

        ``filters`` says for an input which parameter filters which column
        ({input: {parameter: column}}); the SQL sees the input already filtered.
        ``dimensions`` adds the chosen breakdown as a column ({input: {parameter: new
        column}}). Parameters in ``uses`` are named arguments, ``:parameter``.
        """
        where, broken_down, scalars = dict(filters or {}), dict(dimensions or {}), tuple(uses)
        lost = (where.keys() | broken_down.keys()) - set(reads)
        if lost:
            raise ReportError(f"{name!r} filters what it does not read: {', '.join(sorted(lost))}")
        params = [p for by in (*where.values(), *broken_down.values()) for p in by]

        def build(inputs: Inputs) -> DataFrame:
            frames: dict[str, DataFrame] = {}
            for read in reads:
                frame = inputs[read]
                for param, column in where.get(read, {}).items():
                    frame = frame.where(inputs.filter(column, param))
                for param, column in broken_down.get(read, {}).items():
                    frame = frame.withColumn(column, inputs.dimension(param))
                frames[read] = frame
            return inputs.sql(text, {p: inputs.value(p) for p in scalars}, **frames)

        reads = tuple(reads)
        described = json.dumps([text, where, broken_down, scalars], sort_keys=True)
        plain = not (where or broken_down or scalars)
        self._add(Block(
            name, kind, build, reads, tuple(dict.fromkeys([*params, *scalars])),
            text if plain else described,
        ))

    # Structure.

    def lineage(self, name: str) -> Lineage:
        """Sources, parameters and blocks that reach ``name``, with those of its inputs."""
        sources: set[str] = set()
        params: set[str] = set()
        ordered: list[str] = []
        self._reach(name, (), sources, params, ordered)
        if not sources:
            raise ReportError(f"{name!r} does not reach a source")
        return Lineage(tuple(sorted(sources)), tuple(sorted(params)), tuple(ordered[:-1]))

    def _reach(
        self, name: str, above: tuple[str, ...],
        sources: set[str], params: set[str], ordered: list[str],
    ) -> None:
        if name in above:
            raise ReportError(f"{name!r} depends on itself")
        block = self.blocks[name]
        unknown = [n for n in block.reads if n not in self.sources and n not in self.blocks]
        if unknown:
            raise ReportError(f"{name!r} reads unknown inputs: {', '.join(unknown)}")
        undeclared = [n for n in block.uses if n not in self.params]
        if undeclared:
            raise ReportError(f"{name!r} uses unknown parameters: {', '.join(undeclared)}")
        params.update(block.uses)
        for read in block.reads:
            if read in self.sources:
                sources.add(read)
            elif read not in ordered:
                self._reach(read, (*above, name), sources, params, ordered)
        ordered.append(name)

    def check(self) -> dict[str, Lineage]:
        return {name: self.lineage(name) for name in self.blocks}

    def affected(self, changed: Iterable[str], outputs: Iterable[str] | None = None) -> list[str]:
        """Outputs to recompute when the named parameters change."""
        names = set(changed)
        return [
            name for name in self._chosen(outputs) if names & set(self.lineage(name).params)
        ]

    def _chosen(self, outputs: Iterable[str] | None) -> list[str]:
        if outputs is None:
            return [name for name, block in self.blocks.items() if block.kind == QUERY]
        for name in outputs:
            if name not in self.blocks:
                raise ReportError(f"unknown output {name!r}")
            if self.blocks[name].kind != QUERY:
                raise ReportError(f"{name!r} is a view and cannot be an output")
        return list(outputs)

    def definition_sha256(self) -> str:
        """Hash of the report's declarations, for its content identity."""
        content = {
            "slug": self.slug, "title": self.title, "timezone": self.timezone,
            "params": {name: repr(param) for name, param in self.params.items()},
            "blocks": {
                name: [b.kind, b.reads, b.uses, b.text] for name, b in self.blocks.items()
            },
            "sources": {name: repr(s.freshness) for name, s in self.sources.items()},
        }
        text = json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode()).hexdigest()

    # Running.

    def options(self, param: str) -> DataFrame:
        settings = self.params[param].options
        return param_options(
            self.sources[settings.source].frame, settings.column,
            include_null=settings.include_null,
        )

    def values(self, given: Mapping[str, Any] | None = None) -> dict[str, Any]:
        unknown = set(given or {}) - set(self.params)
        if unknown:
            raise ReportError(f"unknown parameters: {', '.join(sorted(unknown))}")
        settings = {n: param.default for n, param in self.params.items()} | dict(given or {})
        for name, value in settings.items():
            problem = self.params[name].problem(value)
            if problem:
                raise ReportError(f"parameter {name!r}: {problem}")
        return settings

    def run(
        self, values: Mapping[str, Any] | None = None, outputs: Iterable[str] | None = None, *,
        changed: Iterable[str] | None = None,
        sink: Callable[[str, DataFrame], Any] | None = None,
    ) -> Run:
        """Build the chosen outputs for one set of parameter values.

        Shared views are built once per run. ``sink`` is the action for each
        output, such as a write; without it the outputs stay lazy and are ``planned``,
        as views always are. A block that fails is reported with its text, those that read it are skipped, and the
        rest runs.
        """
        settings = self.values(values)
        chosen = self._chosen(outputs)
        if changed is not None:
            chosen = self.affected(changed, chosen)
        lineages = {name: self.lineage(name) for name in chosen}
        run = Run()
        frames: dict[str, DataFrame] = {n: s.frame for n, s in self.sources.items()}
        broken: set[str] = set()
        for output in chosen:
            for name in (*lineages[output].blocks, output):
                if name not in frames and name not in broken:
                    self._run_block(name, settings, frames, broken, run, sink)
        return run

    def _run_block(self, name, settings, frames, broken, run, sink) -> None:
        block = self.blocks[name]
        lost = [read for read in block.reads if read in broken]
        if lost:
            broken.add(name)
            run.events.append(
                (name, block.kind, SKIPPED, "failed inputs: " + ", ".join(lost))
            )
            return
        try:
            inputs = Inputs(
                self.spark, {read: frames[read] for read in block.reads}, self.params, settings
            )
            frame = self._result(block, inputs, settings)
            if block.kind == VIEW:
                if block.keep:
                    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
                    run.kept.append(frame)
                run.views[name] = frame
            else:
                run.outputs[name] = frame
                if sink is not None:
                    sink(name, frame)
            frames[name] = frame
            # Without an action nothing has been computed yet.
            done = block.kind == QUERY and sink is not None
            run.events.append((name, block.kind, DONE if done else PLANNED, None))
        except Exception as problem:  # any failure of a block is data of the run
            broken.add(name)
            run.outputs.pop(name, None)
            run.events.append((name, block.kind, FAILED, f"{problem}\n\n{block.text}"))

    def _result(self, block: Block, inputs: Inputs, settings: Mapping[str, Any]) -> DataFrame:
        # Only a build's snapshot says what data an output stands for.
        if self.cache is None or block.kind == VIEW or not self.snapshot_id:
            return block.build(inputs)
        used = {name: settings[name] for name in self.lineage(block.name).params}
        key = json.dumps(
            [self.slug, self.snapshot_id, self.definition_sha256(), block.name, used],
            sort_keys=True, default=str,
        )
        return self.cache.get(key, lambda: block.build(inputs))


def _source_text(build: Callable[..., Any], version: str | None = None) -> str:
    try:
        return definition_text(build, version)
    except NoText as problem:
        raise ReportError(str(problem)) from problem
