"""Saved questions, the time range that they are asked over, and what their runs cost.

A question is a function of a ``Scope``, from which it takes its tables by name: each table with
a time column is read with the scope's range in front of everything else, also in the arms of joins
and unions, so that the range reaches every scan. ``Notebook`` keeps questions and runs in a folder:
questions as one small JSON file, runs as a Parquet table that is only appended to. What a run
read is taken from Spark's own figures of its stages, so that nothing is put into the plan
and filters still reach the scans.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import exists, hadoop, removed, staged
from ..operators.table import Table

RUNS = "id string, question string, name string, at timestamp, seconds double, rows_read long, bytes_read long, rows_returned long, error string, range_start timestamp, range_end timestamp"
HISTORY = 100


@dataclass(frozen=True)
class Scope:
    """Tables by name, all within one time range, both ends included; either end may be open."""

    tables: Callable[[str], Table]
    start: dt.datetime | None = None
    end: dt.datetime | None = None

    def __call__(self, name: str) -> Table:
        return self.tables(name).between(self.start, self.end)


def in_folder(spark: SparkSession, folder: str, time_columns: dict[str, str]) -> Callable[[str], Table]:
    """The Parquet tables of a folder; ``time_columns`` by table name, tables without one are not restricted."""
    return lambda name: Table.read(spark, f"{folder}/{name}.parquet", time_columns.get(name))


@dataclass(frozen=True)
class Question:
    """A question by the name of its function, with its range: fixed ends, or so many seconds back from the run."""

    name: str
    function: str
    description: str = ""
    start: str | None = None
    end: str | None = None
    last_seconds: int | None = None
    uses: int = 0
    id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])

    def bounds(self, now: dt.datetime) -> tuple[dt.datetime | None, dt.datetime | None]:
        if self.last_seconds is not None:
            return now - dt.timedelta(seconds=self.last_seconds), now
        read = lambda x: dt.datetime.fromisoformat(x) if x else None
        return read(self.start), read(self.end)


class Notebook:
    """Questions and their runs. ``functions`` are the questions that there are, by name."""

    def __init__(self, spark: SparkSession, folder: str, tables: Callable[[str], Table], functions: dict[str, Callable[[Scope], Table]]):
        self.spark, self.folder, self.tables, self.functions = spark, folder.rstrip("/"), tables, functions

    # ---- questions ----

    def questions(self) -> list[Question]:
        """Most used first, then by name."""
        path = f"{self.folder}/questions.json"
        if not exists(self.spark, path):
            return []
        text = "\n".join(r["value"] for r in self.spark.read.text(path).collect())
        return sorted((Question(**q) for q in json.loads(text)), key=lambda q: (-q.uses, q.name.lower()))

    def _write(self, questions: list[Question]) -> None:
        fs, path = hadoop(self.spark, f"{self.folder}/questions.json")
        out = fs.create(path, True)
        try:
            out.write(bytearray(json.dumps([asdict(q) for q in questions]), "utf-8"))
        finally:
            out.close()

    def save(self, question: Question) -> str:
        """Add a question, or replace the one with its id."""
        if question.function not in self.functions:
            raise ValueError(f"no question function {question.function!r}")
        self._write([*(q for q in self.questions() if q.id != question.id), question])
        return question.id

    def delete(self, id_: str) -> bool:
        all_ = self.questions()
        self._write([q for q in all_ if q.id != id_])
        return any(q.id == id_ for q in all_)

    # ---- runs ----

    def run(self, id_: str, now: dt.datetime | None = None) -> DataFrame:
        """The answer of a saved question, as a staged table; the run is noted, failed ones with their error."""
        question = next(q for q in self.questions() if q.id == id_)
        start, end = question.bounds(now or dt.datetime.now(dt.timezone.utc))
        self.save(replace(question, uses=question.uses + 1))
        run, began, answer, error = uuid.uuid4().hex, time.time(), None, None
        sc = self.spark.sparkContext
        sc.setJobGroup(run, question.name)
        try:
            answer = staged(self.functions[question.function](Scope(self.tables, start, end)).df)
        except Exception as e:
            error = str(e)[:400]
            raise
        finally:
            seconds = time.time() - began
            rows, size = self._read_by(run)
            sc._jsc.clearJobGroup()
            row = (run, question.id, question.name, dt.datetime.fromtimestamp(began, dt.timezone.utc), seconds, rows, size, None if answer is None else answer.count(), error, start, end)
            self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")
        return answer

    def _read_by(self, group: str) -> tuple[int, int]:
        """Rows and bytes that the scans of a job group's stages have read."""
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())}
        told = [store.lastStageAttempt(s) for s in stages if tracker.getStageInfo(s)]
        return sum(s.inputRecords() for s in told), sum(s.inputBytes() for s in told)

    def runs(self) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/runs"):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs")

    def last_runs(self, question: str | None = None, n: int = HISTORY) -> DataFrame:
        """The newest runs, of one question if given."""
        rows = self.runs() if question is None else self.runs().where(F.col("question") == question)
        return rows.orderBy(F.desc("at"), "id").limit(n)

    def costs(self) -> DataFrame:
        """Per question: runs, failures, median and longest seconds, share of the rows read that was returned."""
        share = F.try_divide(F.sum(F.when(F.col("error").isNull(), F.col("rows_returned"))), F.sum(F.when(F.col("error").isNull(), F.col("rows_read"))))
        return self.runs().groupBy("question", "name").agg(F.count(F.lit(1)).alias("runs"), F.count("error").alias("failed"), F.median("seconds").alias("median_seconds"), F.max("seconds").alias("longest"), share.alias("returned_share"))

    def clear_runs(self) -> None:
        removed(self.spark, f"{self.folder}/runs")
