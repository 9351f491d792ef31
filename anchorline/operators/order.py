"""The total order of a population's event stream, its cursors, splices and schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.contracts import KIND_ORDER, TABLES, TableContract
from anchorline.operators.rank import with_row_number

# Letters sort behind digits, so keys that start like this come last.
OPEN_PREFIX = "open:"


def arrival(kind: str) -> Column:
    """The key of a raw row on the time axis: its known end for stays, its start for all else.

    Dates count from midnight. Stays that have not ended are put behind everything that has a time.
    """
    if kind == "encounter":
        return F.when(F.col("STOP") == "", F.concat(F.lit(OPEN_PREFIX), "START")).otherwise(F.col("STOP"))
    if kind == "medication":
        return F.col("START")
    if kind == "condition":
        return F.concat("START", F.lit("T00:00:00Z"))
    raise ValueError(f"{kind} rows carry no arrival instant")


def row_key(columns: tuple[str, ...]) -> Column:
    """The whole row as text, columns in name order: the last tie-break."""
    return F.concat_ws("\x1f", *[F.concat(F.lit(c), F.lit("="), F.col(c)) for c in sorted(columns)])


def event_rows(df: DataFrame, contract: TableContract) -> DataFrame:
    """One table as events: at, kind_order, row_key, kind, entity and the contract's payload."""
    leads = contract.kind == "patient"
    return df.select(
        (F.lit("") if leads else arrival(contract.kind)).alias("at"),
        F.lit(-1 if leads else KIND_ORDER[contract.kind]).alias("kind_order"),
        row_key(contract.payload).alias("row_key"),
        F.lit(contract.kind).alias("kind"),
        F.col(contract.entity).alias("entity"),
        F.create_map(*[x for c in contract.payload for x in (F.lit(c), F.col(c))]).alias("payload"),
    )


def event_stream(raw: dict[str, DataFrame], *, patients: bool = False) -> DataFrame:
    """The clinical tables as one event table; ``patients`` adds the demographics that lead it."""
    names = [n for n in TABLES if n in raw and (patients or n != "patients")]
    return reduce(DataFrame.unionByName, [event_rows(raw[n], TABLES[n]) for n in names])


ORDER = ["at", "kind_order", "row_key"]


def with_sequence(events: DataFrame, name: str = "seq") -> DataFrame:
    """The position of every event in the total order, from 1."""
    return with_row_number(events, ORDER, name)


def history_before(events: DataFrame, instant: str) -> DataFrame:
    return events.filter(F.col("at") < instant)


def replay_from(events: DataFrame, instant: str) -> DataFrame:
    return events.filter(F.col("at") >= instant)


def due_after(events: DataFrame, cursor: tuple[str, int, str] | None, now: str) -> DataFrame:
    """Events strictly after the cursor key and at or before ``now``."""
    due = events.filter(F.col("at") <= now)
    if cursor is None:
        return due
    key = F.struct(*ORDER)
    return due.filter(key > F.struct(F.lit(cursor[0]), F.lit(cursor[1]), F.lit(cursor[2])))


def due_between(schedule: DataFrame, after: str, at: str) -> DataFrame:
    """Labels that fell due after one instant and at or before another."""
    return schedule.filter((F.col("due_at") > after) & (F.col("due_at") <= at))


def merge_by_instant(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Labels and events in one order, a label before an event at the same instant.

    Both sides need ``at`` and ``idx``, their own order.
    """
    both = labels.select("at", F.lit(0).alias("side"), "idx").unionByName(
        events.select("at", F.lit(1).alias("side"), "idx")
    )
    return with_row_number(both, ["at", "side", "idx"], "position")


Switches = tuple[tuple[str, str], ...]


def owner(switches: Switches, at: Column) -> Column:
    """The population in charge at an instant: the one of the last switch at or before it, NULL before the first.

    Switches are configuration, so this is a plain expression that a scan can filter by.
    """
    latest = F.lit(None).cast("string")
    for instant, population in sorted(switches):
        latest = F.when(at >= instant, F.lit(population)).otherwise(latest)
    return latest


def spliced(streams: dict[str, DataFrame], switches: Switches, at: str = "at") -> DataFrame:
    """Rows of several populations in one table, each from the population in charge at its instant."""
    in_charge = owner(switches, F.col(at))
    mine = [df.filter(in_charge == name).withColumn("population", F.lit(name)) for name, df in streams.items()]
    return reduce(DataFrame.unionByName, mine)
