"""Labels released when they are due: an event-time timer at a patient's next due instant, no schedule read again."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels inside the query, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "encounter_id STRING, label INT, due_us BIGINT, released_us BIGINT"
Released = Row(*[part.split()[0] for part in OUTPUT.split(", ")])


class PendingLabels(StatefulProcessor):
    """One patient's labels that wait for their due instant, and the encounters already released.

    A row schedules a label; a timer releases it when it is due. A patient has one timer, at the earliest due instant of
    what waits. Labels that are due when they arrive are released at once. An encounter is released once, whatever is
    scheduled again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "encounter_id STRING, label INT, due_us BIGINT")
        self.released = handle.getListState("released", "encounter_id STRING")

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """An encounter of the release log: encounter_id."""
        self.released.appendValue((initialState.encounter_id,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        pending = list(self.pending.get())
        taken = {i for i, _, _ in pending} | {i for i, in self.released.get()}
        waiting, out = [], []
        for row in sorted(rows, key=lambda r: (r.due_us, r.encounter_id, r.label)):
            if row.encounter_id in taken:
                continue
            taken.add(row.encounter_id)
            (out if row.due_us <= mark else waiting).append((row.encounter_id, row.label, row.due_us))
        if waiting:
            self.pending.appendList(waiting)
            first, standing = self._first(waiting), self._first(pending)
            if standing is None or first < standing:
                if standing is not None:
                    self.handle.deleteTimer(standing)
                self.handle.registerTimer(first)
        yield from self._release(out, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.pending.get())
        due, rest = [r for r in rows if r[2] <= mark], [r for r in rows if r[2] > mark]
        if due:
            if rest:
                self.pending.put(rest)
                self.handle.registerTimer(self._first(rest))
            else:
                self.pending.clear()
        yield from self._release(due, mark)

    @staticmethod
    def _first(cells: list[tuple]) -> int | None:
        return min((-(-due // 1000) for _, _, due in cells), default=None)

    def _release(self, due: list[tuple], mark: int) -> Iterator[Row]:
        if due:
            self.released.appendList([(i,) for i, _, _ in due])
        for cell in due:
            yield Released(*cell, mark)


def released_labels(schedule: DataFrame, arrivals: DataFrame, at: str, released: DataFrame | None = None) -> DataFrame:
    """Labels as a stream: encounter_id, label, due_at, released_at, each once and never early.

    ``schedule`` is a stream of entity, encounter_id, label and due_at (a null entity or due instant is never due);
    ``arrivals`` is the stream whose instants ``at`` are the clock. A label comes out once an arrival at or past its due
    instant has been read. ``released`` (entity, encounter_id) is a stored log from which a new query starts.
    """
    told = schedule.filter("entity IS NOT NULL AND due_at IS NOT NULL AND encounter_id IS NOT NULL AND label IS NOT NULL").select(
        F.col("entity").cast("string").alias("entity"), F.col("encounter_id").cast("string").alias("encounter_id"),
        F.col("label").cast("int").alias("label"), F.unix_micros("due_at").alias("due_us"),
        # Says nothing of the time; the arrivals do.
        F.timestamp_seconds(F.lit(0)).alias("_clock"),
    )
    clock = arrivals.select(
        F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("encounter_id"),
        F.lit(None).cast("int").alias("label"), F.lit(None).cast("long").alias("due_us"), F.col(at).alias("_clock"),
    )
    # Arrivals end here. The test names the clock in one piece with the rest, so it stays behind the watermark, which
    # has to see them.
    waiting = told.unionByName(clock).withWatermark("_clock", "0 seconds").filter(
        "entity IS NOT NULL OR _clock < TIMESTAMP'0001-01-02 00:00:00'"
    ).drop("_clock")
    initial = None if released is None else released.select(
        F.col("entity").cast("string").alias("entity"), F.col("encounter_id").cast("string").alias("encounter_id")
    ).dropDuplicates().groupBy("entity")
    return waiting.groupBy("entity").transformWithState(
        statefulProcessor=PendingLabels(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", initialState=initial,
    ).select("encounter_id", "label", F.timestamp_micros("due_us").alias("due_at"), F.timestamp_micros("released_us").alias("released_at"))
