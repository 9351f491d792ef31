"""Adequacy statistics of a raw population."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorline.contracts import LABEL_WINDOW_DAYS
from anchorline.functions.scalar import DAY, approximate_age
from anchorline.operators.timeline import forward_count


def iso_valid(value: F.Column) -> F.Column:
    """Text that reads as an ISO-8601 date or instant."""
    return value.try_cast("timestamp").isNotNull() & value.rlike(r"^\d{4}-\d{2}-\d{2}")


def population_stats(patients: DataFrame, encounters: DataFrame, as_of: str) -> DataFrame:
    """Totals, adult share, time span and unreadable rows of the raw text tables, in one row."""
    adult = approximate_age(F.to_date("BIRTHDATE"), F.lit(as_of).cast("date")) >= 18
    people = patients.agg(
        F.count("*").alias("total_patients"),
        F.round(F.coalesce(F.avg(adult.cast("int")), F.lit(0.0)), 9).alias("adult_share"),
    )
    valid = iso_valid(F.col("START")) & iso_valid(F.col("STOP"))
    stays = encounters.agg(
        F.count("*").alias("total_encounters"),
        F.count_if(valid & (F.col("ENCOUNTERCLASS") == "inpatient")).alias("inpatient_encounters"),
        F.min(F.when(valid, F.col("START"))).alias("first_start"),
        F.max(F.when(valid, F.col("STOP"))).alias("last_stop"),
        F.count_if(~valid).alias("invalid_timestamp_rows"),
    )
    one = F.lit(1)
    return people.withColumn("_one", one).join(stays.withColumn("_one", one), "_one").select(
        "total_patients", "total_encounters", "inpatient_encounters", "adult_share", "first_start", "last_stop",
        "invalid_timestamp_rows",
    )


def crude_readmission_rate(encounters: DataFrame) -> DataFrame:
    """Share of closed inpatient stays with another closed inpatient stay starting within 30 days.

    A stay that starts after its own stop is not its own readmission.
    """
    stays = encounters.filter("encounter_class = 'inpatient' AND stop IS NOT NULL").selectExpr(
        "patient", "unix_micros(start) AS started", "unix_micros(stop) AS at"
    )
    ahead = forward_count(
        stays, stays.selectExpr("patient", "started AS at"), entity="patient", at="at",
        span=LABEL_WINDOW_DAYS * DAY, name="later",
    )
    itself = ((F.col("started") > F.col("at")) & (F.col("started") <= F.col("at") + LABEL_WINDOW_DAYS * DAY)).cast("long")
    again = F.col("later") - itself > 0
    return ahead.agg(
        F.count("*").alias("inpatient"), F.count_if(again).alias("readmitted"),
        F.round(F.count_if(again) / F.count("*"), 9).alias("rate"),
    )
