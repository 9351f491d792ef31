"""Windows, labels and splices over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from anchorline.operators.monitor import SPAN_DAYS, STEP_DAYS, grid, realized_by_boundary, touched
from anchorline.operators.order import Switches, spliced
from anchorline.sources.logs import ParquetLog, first_scores
from anchorline.streaming.ingest import PARTS

_DAY = 86_400


def sliding_counts(events: DataFrame, at: str, start: str, keys: tuple[str, ...] = (), closing: str | None = None) -> DataFrame:
    """Events per 30-day window and 7-day step, windows clipped at ``start``.

    For a stream, give ``events`` a watermark; a window is final once the watermark passes its boundary. With
    ``closing``, the instant of the marker that a source ends with (see ``closing_marker``), the last windows become
    final too; the marker is counted nowhere.
    """
    origin = events.sparkSession.sql(f"SELECT unix_timestamp(timestamp'{start}')").first()[0]
    offset = (origin - SPAN_DAYS * _DAY) % (STEP_DAYS * _DAY)
    window = F.window(at, f"{SPAN_DAYS} days", f"{STEP_DAYS} days", f"{offset} seconds")
    first = F.lit(start).cast("timestamp")
    within = F.col(at) >= first
    if closing is not None:
        within &= F.col(at) < F.lit(closing).cast("timestamp")
    return (
        events.filter(within)
        .groupBy(window.alias("w"), *keys)
        .agg(F.count("*").alias("events"))
        .filter(F.col("w.end") > first)
        .select(F.col("w.end").alias("boundary"), *keys, "events")
    )


def closing_marker(spark: SparkSession, schema: StructType, at: str, last: str) -> tuple[DataFrame, str]:
    """The row a source ends with, and its instant: past every window that holds an event up to ``last``.

    Written behind a source's data, it moves the watermark over the last boundary, so that no window waits for ever.
    """
    closing = spark.sql(f"SELECT string(timestamp'{last}' + INTERVAL {SPAN_DAYS + STEP_DAYS} DAYS)").first()[0]
    row = spark.range(1).select(*[
        F.lit(closing).cast("timestamp").cast(f.dataType).alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
    return row, closing


def owned_events(parts: dict[str, DataFrame], switches: Switches, at: str = "at") -> DataFrame:
    """Several populations' streams as one, each while it is in charge."""
    return spliced(parts, switches, at)


def score_sink(log: ParquetLog) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that logs one score per encounter; the first stands."""

    def step(batch: DataFrame, _batch_id: int) -> None:
        log.append(first_scores(batch, log.read().select("encounter_id")))

    return step


def realized_sink(predictions: Callable[[], DataFrame], labels: Callable[[], DataFrame], start: str, end: str, path: str):
    """A ``foreachBatch`` handler over released labels (event_time, released_at) that refreshes the windows they touch.

    The results are one folder per boundary; only touched boundaries are ranked and rewritten.
    """

    def step(batch: DataFrame, _batch_id: int) -> None:
        changed = touched(batch, start, end)
        if changed is None:
            return
        fresh = realized_by_boundary(predictions(), labels(), start, end, only=changed)
        by_day = fresh.withColumn("day", F.date_format("boundary", "yyyy-MM-dd")).write.mode("overwrite")
        by_day.option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return step


def realized_table(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """The whole grid with what the sink has written; a window that no label has touched has count 0."""
    written = spark.read.parquet(path).drop("day")
    return grid(spark, start, end).select("boundary").join(written, "boundary", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def state_rows(spark: SparkSession, checkpoint: str, parts: tuple[str, ...]) -> DataFrame:
    """name, n_rows: how many entries of each part (see ``PARTS``) a stopped query's state holds over all keys."""
    held = spark.read.format("statestore").option("stateVarName", "entries").option("flattenCollectionTypes", "true").load(checkpoint)
    # A byte an entry.
    what = held.select(F.explode(F.regexp_extract_all(F.hex("list_element.what"), F.lit("(..)"))).alias("what"))
    counts = [F.struct(F.lit(p).alias("name"), F.count_if(F.col("what").cast("int").isin(*PARTS[p])).alias("n_rows")) for p in parts]
    return what.agg(F.array(*counts).alias("parts")).select(F.inline("parts"))


def run_available(stream: DataFrame, checkpoint: str, *, path: str | None = None, handler=None, mode: str = "append") -> None:
    """Process everything available on the stream's source, then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if handler is not None:
        query = writer.foreachBatch(handler).outputMode(mode).start()
    else:
        query = writer.format("parquet").option("path", path).outputMode(mode).start()
    query.awaitTermination()
