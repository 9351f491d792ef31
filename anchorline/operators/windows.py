"""Which history rows at least one anchor can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.contracts import LOOKBACK_DAYS
from anchorline.functions.scalar import DAY
from anchorline.operators.timeline import Lookup, Measure, as_of, next_at_or_after

TABLE_NAMES = ("patients", "encounters", "medications", "conditions")


def readable_rows(cohort: DataFrame, frames: dict[str, DataFrame], names: tuple[str, ...] = TABLE_NAMES) -> dict[str, DataFrame]:
    """The rows of each table (of those named) that the features of some anchor read.

    Encounters by STOP from 365 days before the admission to the discharge, both ends included;
    medications active at the discharge; conditions recorded by its date. The question is asked
    from the row's side (is any anchor's window open here?), so no row meets another anchor by
    anchor.
    """
    anchors = cohort.selectExpr(
        "patient_id AS patient", "unix_micros(stop) AS discharged",
        f"unix_micros(start) - {LOOKBACK_DAYS * DAY}L AS floor",
    )
    found = {}
    if "encounters" in names:
        # An encounter is read when more windows have opened than closed strictly before its STOP.
        edges = anchors.selectExpr(
            "patient", "explode(array(struct(floor AS at, 1 AS opened, 0 AS closed), "
            "struct(discharged AS at, 0 AS opened, 1 AS closed))) AS e",
        ).selectExpr("patient", "e.at AS at", "e.opened AS opened", "e.closed AS closed")
        stays = frames["encounters"].filter("stop IS NOT NULL").withColumn("at", F.expr("unix_micros(stop)"))
        found["encounters"] = as_of(
            stays, edges, entity="patient", at="at", measures=[Measure("opened"), Measure("closed")],
            lookups=[Lookup("_opened", "opened", inclusive=True), Lookup("_closed", "closed")],
        ).filter("_opened > _closed").drop("at", "_opened", "_closed")
    if "medications" in names:
        # A medication is read when the first discharge at or after its START comes before its STOP.
        instants = anchors.selectExpr("patient", "discharged AS at")
        found["medications"] = next_at_or_after(
            frames["medications"].withColumn("at", F.expr("unix_micros(start)")), instants,
            entity="patient", at="at", name="_next",
        ).filter("_next IS NOT NULL AND (stop IS NULL OR _next < unix_micros(stop))").drop("at", "_next")
    last = cohort.groupBy(F.col("patient_id").alias("_p")).agg(F.max(F.to_date("stop")).alias("_last"))
    if "conditions" in names:
        found["conditions"] = frames["conditions"].join(
            last, (F.col("patient") == F.col("_p")) & (F.col("start") <= F.col("_last")), "left_semi"
        )
    if "patients" in names:
        found["patients"] = frames["patients"].join(last, F.col("id") == F.col("_p"), "left_semi")
    return found
