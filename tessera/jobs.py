"""Queries as jobs: plan text, asynchronous runs with progress, a log, and cancellation."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

#: Modes of a plan's text, from the least to the most.
PLAN_MODES = ("simple", "formatted", "extended", "cost")


@dataclass
class Job:
    """A running or ended query. result() waits; failed holds the error's text."""

    spark: SparkSession
    df: DataFrame
    name: str
    group: str = field(default_factory=lambda: uuid.uuid4().hex)
    log: list[tuple[float, str]] = field(default_factory=list)
    failed: str | None = None
    cancelled: bool = False
    rows: list | None = None
    _thread: threading.Thread | None = None

    def note(self, text: str) -> None:
        self.log.append((time.time(), text))

    @property
    def done(self) -> bool:
        return self._thread is not None and not self._thread.is_alive()

    def progress(self) -> float:
        """Share of the tasks, of the stages known so far, that have ended."""
        if self.done:
            return 1.0
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.group) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
        total = sum(s.numTasks for s in stages if s)
        return sum(s.numCompletedTasks for s in stages if s) / total if total else 0.0

    def text(self, offset: int = 0, length: int | None = None) -> str:
        """Part of the log."""
        whole = "\n".join(t for _, t in self.log)
        return whole[offset : None if length is None else offset + length]

    def cancel(self) -> None:
        self.cancelled = True
        self.note("cancelled")
        self.spark.sparkContext.cancelJobGroup(self.group)

    def result(self, timeout: float | None = None) -> list:
        """The rows; raises what the query raised, or TimeoutError."""
        assert self._thread is not None
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError(self.name)
        if self.failed is not None:
            raise RuntimeError(self.failed)
        return self.rows or []


def compile_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A parsed and analysed query; raises if it is none. Tables in braces are given by name."""
    return spark.sql(sql, **tables)


#: Hints of a query: how its rows are joined with others, or dealt.
HINTS = ("broadcast", "merge", "shuffle_hash", "shuffle_replicate_nl", "coalesce", "repartition", "repartition_by_range", "rebalance")


def optimise(df: DataFrame, hints: dict[str, list] | None = None) -> DataFrame:
    """The query with hints, by name and with their parameters; the optimizer follows those that it can."""
    for name, parameters in (hints or {}).items():
        if name not in HINTS:
            raise ValueError(f"one of {HINTS} is needed")
        df = df.hint(name, *parameters)
    return df


def plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text of a query's plan."""
    if mode not in PLAN_MODES:
        raise ValueError(f"one of {PLAN_MODES} is needed")
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def submit(df: DataFrame, name: str = "query", take: Callable[[DataFrame], list] = DataFrame.collect) -> Job:
    """Starts a query in a job group of its own. take: what is done with it; by default all rows are brought to the driver."""
    job = Job(df.sparkSession, df, name)

    def run() -> None:
        sc = job.spark.sparkContext
        sc.setJobGroup(job.group, name, interruptOnCancel=True)
        job.note("running")
        try:
            job.rows = take(df)
            job.note("done")
        except Exception as error:  # noqa: BLE001  reported by result()
            job.failed = str(error).split("\n")[0]
            job.note(f"failed: {job.failed}")

    job._thread = InheritableThread(target=run, daemon=True)
    job._thread.start()
    return job


def clear_caches(spark: SparkSession) -> None:
    """Drops cached tables, so that the next run is cold for Spark."""
    spark.catalog.clearCache()
