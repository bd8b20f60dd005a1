"""Runs, what each wrote, and what can be asked of them later.

A run is one line that says it is running and one that says how it ended, each a file put in place by a rename: a
reader sees a whole line or none, and a driver that is lost leaves a run that stays running. Lines are never
changed, so writers need no lock; the last line of a run counts.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import Folder
from tidemark.sources.shared import shared_dir

LINE = "run_id string, line int, job string, status string, started_at timestamp, finished_at timestamp, params string, totals map<string,bigint>, models map<string,string>, meta map<string,string>, errors array<string>"
#: Fixed value: messages of errors that a run keeps; all of them are counted.
ERRORS = 50


def _now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat()


class Run:
    """A run under way: what it writes, counts and meets."""

    def __init__(self, run_id: str):
        self.id, self.totals, self.meta, self.errors = run_id, {}, {}, []

    def add(self, **totals: int) -> None:
        for name, n in totals.items():
            self.totals[name] = self.totals.get(name, 0) + int(n or 0)

    def error(self, message: str) -> None:
        """Something that went wrong without ending the run."""
        self.add(errors=1)
        self.errors = [*self.errors, message][:ERRORS]

    def write(self, rows: DataFrame, path: str, totals: dict[str, Column], by: Sequence[str] = (), mode: str = "error") -> None:
        """Write ``rows`` as Parquet and add the aggregates ``totals`` of them, gathered by the tasks that write.

        The metrics sit in the last stage, where a task counts once however often it is tried; below a shuffle a
        stage that is run again for a lost executor would count twice. Null counts as 0.
        """
        if not totals:
            rows.write.mode(mode).partitionBy(*by).parquet(path)
            return
        seen = Observation()
        names = list(totals)
        metrics = [totals[n].cast("long").alias(f"m{i}") for i, n in enumerate(names)]
        rows.observe(seen, *metrics).write.mode(mode).partitionBy(*by).parquet(path)
        self.add(**{n: seen.get[f"m{i}"] for i, n in enumerate(names)})


def by_source(sources: Sequence[str], totals: dict[str, Column]) -> dict[str, Column]:
    """Totals for each source in one pass: ``totals`` are conditions, and a total is named ``source.name``."""
    return {f"{s}.{name}": F.count_if((F.col("source") == s) & condition) for s in sources for name, condition in totals.items()}


class Ledger:
    """The runs below a folder of the file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.folder = spark, Folder(spark, path or f"{shared_dir(spark)}/tidemark/runs")

    def _put(self, run: Run, line: int, **values) -> None:
        name = f"{run.id}.{line}.json"
        text = json.dumps({"run_id": run.id, "line": line, "totals": run.totals, "meta": run.meta, "errors": run.errors} | values)
        if not self.folder.put(name, text, f"_{uuid.uuid4().hex}"):
            raise ValueError(f"the ledger has a run {run.id} already")

    @contextmanager
    def run(self, job: str, params: dict | None = None, models: dict[str, str] | None = None, run_id: str | None = None) -> Iterator[Run]:
        """Record what happens in the block as a run of ``job``: succeeded, or failed with the error that ends it, which goes on."""
        run = Run(run_id or uuid.uuid4().hex)
        same = {"job": job, "started_at": _now(), "params": json.dumps(params or {}, sort_keys=True), "models": models or {}}
        self._put(run, 0, status="running", **same)
        try:
            yield run
        except BaseException as e:
            run.error(f"{type(e).__name__}: {e}")
            self._put(run, 1, status="failed", finished_at=_now(), **same)
            raise
        self._put(run, 1, status="succeeded", finished_at=_now(), **same)

    def runs(self) -> DataFrame:
        """One row a run, as its last line has it."""
        if not self.folder.names():
            return self.spark.createDataFrame([], LINE)
        lines = self.spark.read.schema(LINE).option("pathGlobFilter", "*.json").json(self.folder.path)
        last = lines.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in lines.columns if c != "run_id"]), "line").alias("last"))
        return last.select("run_id", "last.*")

    def find(self, run_id: str) -> Row | None:
        """The run of an id, by its own files alone."""
        for line in (1, 0):
            text = self.folder.read(f"{run_id}.{line}.json")
            if text is not None:
                return self.spark.createDataFrame([(text,)], "text string").select(F.from_json("text", LINE).alias("x")).select("x.*").first()
        return None

    def totals(self) -> DataFrame:
        """(run_id, job, status, name, value)."""
        return self.runs().select("run_id", "job", "status", F.explode("totals").alias("name", "value"))

    def as_of(self, time: Column) -> DataFrame:
        """The last run of each job that had succeeded by a time; of equal times that of the largest id."""
        done = self.runs().where((F.col("status") == "succeeded") & (F.col("finished_at") <= time))
        last = done.groupBy("job").agg(F.max_by(F.struct(*[c for c in done.columns if c != "job"]), F.struct("finished_at", "run_id")).alias("last"))
        return last.select("job", "last.*")

    def meta(self) -> DataFrame:
        """(key, value, run_id): of each key the value that the last succeeded run with it gave."""
        said = self.runs().where("status = 'succeeded'").select("run_id", "finished_at", F.explode("meta").alias("key", "value"))
        return said.groupBy("key").agg(F.max_by(F.struct("value", "run_id"), F.struct("finished_at", "run_id")).alias("last")).select("key", "last.*")

    def models(self) -> DataFrame:
        """(kind, version, first_used, last_used, runs): the versions of models that runs used (E7); a version names its model, as in ``name@1``."""
        used = self.runs().select("started_at", F.explode("models").alias("kind", "version"))
        return used.groupBy("kind", "version").agg(F.min("started_at").alias("first_used"), F.max("started_at").alias("last_used"), F.count("*").alias("runs"))
