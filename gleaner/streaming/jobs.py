"""States of jobs' stages from events that come late, twice, out of order or never.

An event submits a job (with what it scans), tells a stage's status, or that the job failed. Statuses
only go forward: of several for a stage the furthest counts, whatever the order they come in, and a
stage that a job does not have stays skipped. Once a job has failed, or nothing has been heard of it for
the timeout, what is pending or running is an error; what a late event then tells as done is done.

``states`` is the batch form. ``stream`` keeps a row a job in a state store with a timer, and gives all
stages of a job whenever one of them changes; the last row of a stage is its state. Events that are
later than the watermark allows are lost to the stream, so ``lateness`` is part of the contract.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators import report

EVENT = "job_id string, kind string, stage string, status string, at timestamp, ip string, firmware string, url string, report boolean"
STATE = "job_id string, ord int, stage string, status string"
SUBMITTED, TOLD, FAILED = "submitted", "stage", "failed"
#: How far each status is.
ORDER = ("pending", "running", "done", "error")
NAMES = tuple(name for name, _ in report.STAGES)


def states(events: DataFrame, timeout_s: float | None = None, now: str | None = None) -> DataFrame:
    """(job_id, ord, stage, status) of every job that was submitted; with ``now`` jobs time out as of then."""
    jobs = events.groupBy("job_id").agg(
        F.max(F.when(F.col("kind") == SUBMITTED, F.struct("ip", "firmware", "url", "report"))).alias("job"),
        F.coalesce(F.bool_or(F.col("kind") == FAILED), F.lit(False)).alias("failed"),
        F.max("at").alias("last"),
    ).filter("job IS NOT NULL")
    over = F.lit(False) if now is None or timeout_s is None else F.col("last") + F.make_dt_interval(secs=F.lit(timeout_s).cast("decimal(18,6)")) <= F.lit(now).cast("timestamp")
    jobs = jobs.select("job_id", "job.*", (F.col("failed") | over).alias("failed"))
    first = report.initial_stages(jobs).join(jobs.select("job_id", "failed"), "job_id")
    rank = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col("status"))
    told = events.filter((F.col("kind") == TOLD) & (rank > 0)).groupBy("job_id", "stage").agg(F.max(rank).alias("rank"))
    rows = first.join(told, ["job_id", "stage"], "left")
    status = F.when((F.col("status") == "skipped") | F.col("rank").isNull(), F.col("status")).otherwise(F.element_at(F.array(*[F.lit(s) for s in ORDER]), F.col("rank").cast("int")))
    return rows.select("job_id", "ord", "stage", F.when(F.col("failed"), report.after_failure(status)).otherwise(status).alias("status"))


class Job(StatefulProcessor):
    """One job: the stages it has, how far each is, whether it failed, and when it was last heard of."""

    def __init__(self, timeout_s: float):
        self.timeout_ms = int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "given array<boolean>, ranks array<int>, failed boolean, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        given, ranks, failed, last = ([*held[0]], [*held[1]], held[2], held[3]) if held else ([], [0] * len(NAMES), False, 0)
        before = self.shown(given, ranks, failed)
        for frame in rows:
            for e in frame.itertuples():
                last = max(last, int(e.at.value // 1_000_000))
                if e.kind == SUBMITTED:
                    has = {"ip": bool(e.ip), "firmware": bool(e.firmware), "url": bool(e.url), "report": e.report is True or e.report == True, "": True}  # noqa: E712
                    given = [has[need] for _, need in report.STAGES]
                elif e.kind == FAILED:
                    failed = True
                elif e.stage in NAMES and e.status in ORDER:
                    k = NAMES.index(e.stage)
                    ranks[k] = max(ranks[k], ORDER.index(e.status))
        self.state.update((given, ranks, failed, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if given and not failed:
            self.handle.registerTimer(last + self.timeout_ms)
        yield self.told(key, self.shown(given, ranks, failed), before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given, ranks, failed, last = self.state.get()
        before = self.shown([*given], [*ranks], failed)
        self.state.update(([*given], [*ranks], True, last))
        yield self.told(key, self.shown([*given], [*ranks], True), before)

    @staticmethod
    def shown(given: list[bool], ranks: list[int], failed: bool) -> list[str]:
        """The statuses of all stages; none of a job that was not submitted yet."""
        now = [ORDER[r] if has else "skipped" for has, r in zip(given, ranks, strict=False)]
        return ["error" if failed and s in ("pending", "running") else s for s in now]

    @staticmethod
    def told(key, now: list[str], before: list[str]) -> pd.DataFrame:
        rows = [] if now == before else [(key[0], k, NAMES[k], s) for k, s in enumerate(now)]
        return pd.DataFrame(rows, columns=["job_id", "ord", "stage", "status"]).astype({"ord": "int32"})

    def close(self) -> None:
        pass


def stream(events: DataFrame, timeout_s: float, lateness: str) -> DataFrame:
    """The changes of jobs' states, from a stream of events (``EVENT``). The session's state store is RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = events.withWatermark("at", lateness).groupBy("job_id")
    return seen.transformWithStateInPandas(Job(timeout_s), STATE, "Update", "EventTime")
