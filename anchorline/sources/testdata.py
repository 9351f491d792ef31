"""Adapter views: the clinical tables, derived from the generated order tables.

Ids stay long integers here; every operator takes ids of any type. ``raw_population`` gives
the same rows as verbatim text under the export's own column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from anchorline.functions.scalar import iso
from anchorline.session import prepare

# Condition codes the adapter cycles through.
CODE_CYCLE = (
    "88805009", "84114007", "87433001", "26929004", "44054006", "254837009",
    "22298006", "399211009", "431855005", "444814009", "10509002", "160903007",
)


# The large tables, with the key that spreads them.
FACTS = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # A generated table is one file with one row group, read by one task. Anything larger than
    # that already has a split per core and is left as it is.
    if name in FACTS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, FACTS[name])
    return df


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "date_add(DATE'1925-01-01', int(c_custkey * 7919 % 32000)) AS birthdate",
        "if(c_custkey % 9 = 0, date_add(DATE'1996-01-01', int(c_custkey * 31 % 2000)), NULL) AS deathdate",
        "if(c_custkey % 2 = 0, 'M', 'F') AS gender",
    )


def encounters(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    start = "timestamp(o_orderdate) + make_dt_interval(0, int(o_orderkey % 24))"
    stop = f"{start} + make_dt_interval(int(o_orderkey % 14 + 1))"
    return orders.selectExpr(
        "o_orderkey AS id",
        "o_custkey AS patient",
        f"{start} AS start",
        f"if(o_orderkey % 97 != 0, {stop}, NULL) AS stop",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'emergency' WHEN '2' THEN 'inpatient'"
        " WHEN '3' THEN 'inpatient' WHEN '4' THEN 'urgentcare' ELSE 'wellness' END AS encounter_class",
    )


def owned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the customer who placed the order."""
    owner = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").join(owner, "l_orderkey")


def medications(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    items = owned_items(spark, sf_dir) if items is None else items
    start = "timestamp(l_shipdate)"
    return items.selectExpr(
        "o_custkey AS patient",
        "l_orderkey AS encounter",
        "l_partkey AS code",
        f"{start} AS start",
        f"if(l_linestatus = 'O' AND l_quantity > 45, NULL, {start} + make_dt_interval(int(l_quantity - 3))) AS stop",
    )


def conditions(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    items = owned_items(spark, sf_dir) if items is None else items
    cycle = f"element_at(array({', '.join(repr(c) for c in CODE_CYCLE)}), int(l_partkey % 12 + 1))"
    return items.filter("l_returnflag = 'R'").selectExpr(
        "o_custkey AS patient",
        "l_orderkey AS encounter",
        "date(l_shipdate) AS start",
        "if(l_linestatus = 'O', NULL, date_add(date(l_shipdate), int(l_quantity * 10))) AS stop",
        "if(l_partkey % 20 = 0, 'ICD10', 'SNOMED-CT') AS system",
        f"CASE WHEN l_partkey % 40 = 0 THEN 'C50.9' WHEN l_partkey % 20 = 0 THEN 'J20.9' ELSE {cycle} END AS code",
        "concat('Record ', l_partkey, CASE l_partkey % 3 WHEN 0 THEN ' (disorder)' WHEN 1 THEN ' (finding)'"
        " ELSE ' (situation)' END) AS description",
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a generic timeline: entity, instant in microseconds, class, value."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("entity"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        "value",
    )


def population(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four typed tables."""
    items = owned_items(spark, sf_dir)
    return {
        "patients": patients(spark, sf_dir),
        "encounters": encounters(spark, sf_dir),
        "medications": medications(spark, sf_dir, items),
        "conditions": conditions(spark, sf_dir, items),
    }


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def instant_text(c: str) -> Column:
    return F.coalesce(iso(c), F.lit(""))


def encounter_cells(id: str, patient: str, encounter_class: Column, start: Column, stop: Column) -> dict[str, Column]:
    """The cells of a stay as text; ``start`` and ``stop`` are text already."""
    return {"Id": _text(id), "START": start, "STOP": stop, "PATIENT": _text(patient), "ENCOUNTERCLASS": _text(encounter_class)}


def _with_instants(df: DataFrame) -> DataFrame:
    """``_start`` and ``_stop`` as text, read from a generated row.

    Whatever compares, sorts or filters by an instant would otherwise write it out once more for each mention, until the
    code of the stage is too long to be compiled.
    """
    return df.select("*", F.inline(F.array(F.struct(instant_text("start").alias("_start"), instant_text("stop").alias("_stop")))))


def raw_population(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables as text with the export's column names, missing values empty."""
    text = _text
    frames = population(spark, sf_dir)
    for name in ("encounters", "medications"):
        frames[name] = _with_instants(frames[name])
    start, stop = F.col("_start"), F.col("_stop")
    return {
        "patients": frames["patients"].select(
            text("id").alias("Id"), text("birthdate").alias("BIRTHDATE"), text("deathdate").alias("DEATHDATE"),
            text("gender").alias("GENDER"),
        ),
        "encounters": frames["encounters"].select(
            *[c.alias(n) for n, c in encounter_cells("id", "patient", F.col("encounter_class"), start, stop).items()]
        ),
        "medications": frames["medications"].select(
            start.alias("START"), stop.alias("STOP"), text("patient").alias("PATIENT"),
            text("encounter").alias("ENCOUNTER"), text("code").alias("CODE"),
        ),
        "conditions": frames["conditions"].select(
            text("start").alias("START"), text("stop").alias("STOP"), text("patient").alias("PATIENT"),
            text("encounter").alias("ENCOUNTER"), text("system").alias("SYSTEM"), text("code").alias("CODE"),
            text("description").alias("DESCRIPTION"),
        ),
    }
