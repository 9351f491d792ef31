"""Append-only logs and state tables on a shared folder: the first row per key stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from anchorline.contracts import TABLES, TableContract
from anchorline.operators.joins import missing_rows
from anchorline.operators.order import arrival
from anchorline.operators.rank import with_row_number
from anchorline.operators.upsert import conflicts_with, new_rows
from anchorline.operators.validate import with_errors
from anchorline.session import materialize

PART = "part"


def first_scores(predictions: DataFrame, logged: DataFrame) -> DataFrame:
    """Predictions of discharges the log does not hold yet; the first score stands."""
    key = ["encounter_id"]
    values = [c for c in predictions.columns if c not in key]
    once = predictions.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct("event_time", "score")).alias("_v"))
    return missing_rows(once.select(*key, "_v.*"), logged, key).select(*predictions.columns)


def labels_to_write(labels: DataFrame, predictions: DataFrame, stored: DataFrame) -> DataFrame:
    """Due labels attached to their prediction: new, duplicate, or unscored when there is none.

    Of several labels for one discharge the earliest release counts, then the smaller label; the others are duplicates.
    """
    first = Window.partitionBy("encounter_id").orderBy(*[c for c in ("released_at", "label") if c in labels.columns])
    labels = labels.withColumn("_nth", F.row_number().over(first))
    attached = labels.join(predictions.select("encounter_id", "prediction_id"), "encounter_id", "left")
    held = stored.select("prediction_id", F.lit(True).alias("_held"))
    status = (
        F.when(F.col("prediction_id").isNull(), "unscored")
        .when(F.col("_held") | (F.col("_nth") > 1), "duplicate").otherwise("new")
    )
    return attached.join(held, "prediction_id", "left").withColumn("status", status).drop("_held", "_nth")


def logged_features(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows with their model inputs as a map of doubles; NaN is refused."""
    pairs = []
    for name in names:
        value = F.col(name).cast("double")
        pairs += [F.lit(name), F.when(F.isnan(value), F.raise_error(F.lit(f"cannot log NaN for {name}")).cast("double")).otherwise(value)]
    return rows.withColumn("features", F.create_map(*pairs))


class ParquetLog:
    """A folder of appended parquet files, read back in write order."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as missing:  # the folder appears with the first append
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def has(self, column: str, value) -> bool:
        return not self.read().filter(F.col(column) == F.lit(value)).isEmpty()


class PredictionLog(ParquetLog):
    """One prediction per encounter, numbered in write order."""

    SCHEMA = (
        "prediction_id BIGINT, patient_id STRING, encounter_id STRING, event_time TIMESTAMP, scored_at TIMESTAMP, "
        "input_hash STRING, model_name STRING, model_version INT, feature_version STRING, cohort_version STRING, "
        "score DOUBLE, features MAP<STRING, DOUBLE>"
    )

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, self.SCHEMA)

    def record(self, predictions: DataFrame) -> DataFrame:
        """Append what is not logged yet and return it with its ids."""
        log = self.read()
        last = log.agg(F.coalesce(F.max("prediction_id"), F.lit(0)).alias("n")).first()["n"]
        columns = [c for c in log.columns if c not in ("prediction_id", "scored_at")]
        # Numbering reads its rows four times; they are worked out once.
        fresh = materialize(first_scores(predictions.select(*columns), log.select("encounter_id")))
        numbered = with_row_number(fresh, ["event_time", "encounter_id"], "prediction_id").withColumns(
            {"prediction_id": F.col("prediction_id") + F.lit(last), "scored_at": F.current_timestamp()}
        ).select(*log.columns)
        self.append(numbered)
        return self.read().filter(F.col("prediction_id").between(last + 1, last + fresh.count()))

    def all(self) -> DataFrame:
        return self.read().orderBy("prediction_id")

    def of_encounter(self, encounter_id: str) -> DataFrame:
        return self.read().filter(F.col("encounter_id") == encounter_id)


class UnscoredDischarge(LookupError):
    """A label has no prediction to go with."""


class LabelLog(ParquetLog):
    """One label per prediction, never released before it is due."""

    SCHEMA = (
        "label_id BIGINT, prediction_id BIGINT, encounter_id STRING, label INT, label_version STRING, "
        "due_at TIMESTAMP, released_at TIMESTAMP, recorded_at TIMESTAMP"
    )

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, self.SCHEMA)

    def record(self, labels: DataFrame, predictions: DataFrame) -> int:
        """Append new labels, drop known ones, raise when a discharge was never scored; the number written."""
        log = self.read()
        last = log.agg(F.coalesce(F.max("label_id"), F.lit(0)).alias("n")).first()["n"]
        marked = materialize(labels_to_write(labels, predictions, log))
        unscored = marked.filter("status = 'unscored'").select("encounter_id").orderBy("encounter_id").take(5)
        if unscored:
            raise UnscoredDischarge(f"labels without a logged prediction, among them {[r[0] for r in unscored]}")
        early = marked.filter("released_at < due_at").take(1)
        if early:
            raise ValueError(f"{early[0]['encounter_id']}: released_at lies before due_at")
        fresh = marked.filter("status = 'new'").drop("status")
        written = fresh.count()
        numbered = with_row_number(fresh, ["due_at", "encounter_id"], "label_id").withColumns(
            {"label_id": F.col("label_id") + F.lit(last), "recorded_at": F.current_timestamp()}
        ).select(*log.columns)
        self.append(numbered)
        return written


class ReferenceExists(RuntimeError):
    """References are written once."""


class ReferenceStore:
    """Monitoring references, one folder per model version; a second write is refused."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _folder(self, name: str, version: int) -> str:
        return f"{self.path}/model_name={name}/model_version={version}"

    def record(self, reference: DataFrame, name: str, version: int) -> None:
        try:
            reference.write.mode("errorifexists").parquet(self._folder(name, version))
        except Exception as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise ReferenceExists(f"{self._folder(name, version)} is taken") from error
            raise

    def read(self, name: str, version: int) -> DataFrame | None:
        try:
            return self.spark.read.schema("signal STRING, value DOUBLE").parquet(self._folder(name, version))
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise


class EventStore:
    """The state tables: verbatim rows, unique per natural key.

    Rows are partitioned by the month of START where START is part of the key, else by a hash of
    the key, so that recording a batch reads the partitions the batch falls into.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def part(self, contract: TableContract):
        if "START" in contract.key:
            return F.substring("START", 1, 7)
        return F.format_string("%02d", F.pmod(F.xxhash64(*contract.key), F.lit(self.BUCKETS)))

    def table(self, name: str) -> DataFrame:
        schema = ", ".join(f"{c} STRING" for c in TABLES[name].payload) + f", {PART} STRING"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def frames(self) -> dict[str, DataFrame]:
        return {name: self.table(name).drop(PART) for name in TABLES}

    def record(self, name: str, rows: DataFrame) -> tuple[int, DataFrame]:
        """Append the new rows of a batch; how many there were, and the conflicts.

        New rows stay although others conflict. Recording a batch again changes nothing. Rows of
        a batch carry no order, so of two that contradict each other the smaller one stands.
        """
        return self._append(name, materialize(rows.select(*TABLES[name].payload)))

    def _append(self, name: str, rows: DataFrame) -> tuple[int, DataFrame]:
        """``record`` of rows that are read from a table or a checkpoint."""
        contract = TABLES[name]
        key = [PART, *contract.key]
        incoming = rows.select(*contract.payload).withColumn(PART, self.part(contract))
        # At most one value per bucket or calendar month, so the scan is pruned by a plain filter.
        parts = [r[0] for r in incoming.select(PART).distinct().collect()]
        stored = self.table(name).filter(F.col(PART).isin(*parts))
        values = [c for c in contract.payload if c not in contract.key]
        seq = [f"_seq_{c}" for c in values]
        ordered = incoming.withColumns(dict(zip(seq, map(F.col, values), strict=True))) if values else incoming.distinct()
        new = new_rows(ordered, stored, key, seq) if values else missing_rows(ordered, stored, key)
        # Worked out once: the conflicts, the files and the count all read it.
        fixed = materialize(new.select(*contract.payload, PART))
        conflicts = self.spark.createDataFrame([], "differing ARRAY<STRING>")
        if values:
            conflicts = materialize(conflicts_with(ordered, stored, fixed, key, seq))
        # Files are gathered per partition; a partition that takes most of the batch is split.
        fixed.hint("rebalance", PART).write.mode("append").partitionBy(PART).parquet(f"{self.path}/{name}")
        return fixed.count(), conflicts


def preload(store: EventStore, raw: dict[str, DataFrame], before: str | None = None) -> DataFrame:
    """Load tables in bulk, per kind: loaded, already_present, conflicts, malformed, later.

    Every row is counted once. ``before`` leaves rows that arrive at or after that instant for the stream. Malformed
    rows are not stored, so what partitions the store is always a well-formed time or a hash.
    """
    out = []
    for name, df in raw.items():
        contract = TABLES[name]
        checked = materialize(with_errors(df, contract).select(*contract.payload, F.size("errors").alias("_errors")))
        good = F.col("_errors") == 0
        now = good if before is None or contract.kind == "patient" else good & (arrival(contract.kind) < before)
        total, well, here = checked.agg(F.count("*"), F.count_if(good), F.count_if(now)).first()
        loaded, conflicts = store._append(name, checked.filter(now))
        clashing = conflicts.count()
        out.append((contract.kind, loaded, here - loaded - clashing, clashing, total - well, well - here))
    return store.spark.createDataFrame(
        out, "kind STRING, loaded BIGINT, already_present BIGINT, conflicts BIGINT, malformed BIGINT, later BIGINT"
    )
