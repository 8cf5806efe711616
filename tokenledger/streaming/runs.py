"""Streaming forms of the collapse of steps. An extension: batches are all there is to match."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def latest_verdicts(steps: DataFrame, key: str = "question_id", step: str = "step_i", verdict: str = "is_correct", time: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, first_verdict, steps) of a stream of steps: the verdict of the first step that has one, and how many
    steps came. With a time column, steps later than `late` are dropped with their state."""
    if time:
        steps = steps.withWatermark(time, late)
    return steps.groupBy(key).agg(F.min_by(verdict, F.when(F.col(verdict).isNotNull(), F.col(step))).alias("first_verdict"), F.count(F.lit(1)).alias("steps"))


class _Collapse(StatefulProcessor):
    """State of a question: its first step with a verdict, its last step, how many came, whether verdicts differ, and the time of
    its latest step. A timer closes it once the watermark is so far beyond that time that no step can come."""

    _STATE = "first_step long, first_verdict boolean, last_step long, steps long, differs boolean, latest long"

    def __init__(self, key: str, step: str, verdict: str, time: str, idle_ms: int):
        self.names = key, step, verdict, "steps", "differs"
        self.step, self.verdict, self.time, self.idle_ms = step, verdict, time, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("question", self._STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, verdict, last, n, differs, latest = self.state.get() if self.state.exists() else (None, None, None, 0, False, 0)
        for row in rows:
            at, said, n = row[self.step], row[self.verdict], n + 1
            last = at if last is None else max(last, at)
            latest = max(latest, int(row[self.time].timestamp() * 1000))
            if said is not None:
                differs = differs or verdict is not None and said != verdict
                if first is None or at < first:
                    first, verdict = at, said
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)
        self.state.update((first, verdict, last, n, differs, latest))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        first, verdict, last, n, differs, _ = self.state.get()
        self.state.clear()
        yield Row(*self.names)(key[0], last if first is None else first, None if differs else verdict, n, differs)

    def close(self) -> None:
        pass


def collapse_stream(steps: DataFrame, key: str = "question_id", step: str = "step_i", verdict: str = "is_correct", time: str = "time", late: str = "1 hour", idle_ms: int = 3_600_000) -> DataFrame:
    """(key, step, verdict, steps, differs) of a stream of steps with an event time, a row a question once it is closed: its first step
    with a verdict, else its last step; how many steps came; and whether their verdicts differ (then the verdict is null, where
    the batch form ends in an error).

    A question is closed when the watermark, `late` behind the latest time seen, is idle_ms past its latest step. Steps older than
    the watermark are dropped, by the same rule whether their question is open or closed; a step in time that comes after its
    question was closed opens it anew. State is kept only for open questions, in the state store: set
    spark.sql.streaming.stateStore.providerClass to RocksDB's.
    """
    kind = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    rows = steps.select(key, F.col(step).cast("long").alias(step), verdict, time).withWatermark(time, late)
    out = f"{key} {kind[key]}, {step} long, {verdict} boolean, steps long, differs boolean"
    return rows.groupBy(key).transformWithState(_Collapse(key, step, verdict, time, idle_ms), out, "append", "EventTime")
