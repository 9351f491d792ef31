"""Strict checks of raw text rows, with every reason a row is refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from anchorline.contracts import BY_KIND, TableContract
from anchorline.functions.hashing import has_control_characters
from anchorline.functions.scalar import exact_format, major_minor


def row_errors(contract: TableContract, formed: dict[str, Column] | None = None) -> Column:
    """All reasons a row of this table is malformed, in a fixed order; empty when it is accepted.

    Required fields must be filled, times must print back as they were written, and a stop may
    not precede its start where the table demands order. U+0001, U+001F and U+007F are refused, since
    writers of canonical JSON disagree on them. ``formed`` says per time column whether its text
    is well formed, where that is known already.
    """
    formed = formed or {
        c: exact_format(F.col(c), contract.time_pattern) for c in (*contract.required_times, *contract.optional_times)
    }
    checks = [F.when(F.col(c) == "", F.lit(f"empty:{c}")) for c in contract.required]
    for c in contract.required_times:
        checks.append(F.when(~formed[c], F.lit(f"format:{c}")))
    for c in contract.optional_times:
        checks.append(F.when((F.col(c) != "") & ~formed[c], F.lit(f"format:{c}")))
    if contract.ordered_interval:
        checks.append(F.when(formed["START"] & formed["STOP"] & (F.col("STOP") < F.col("START")), F.lit("interval:STOP")))
    for c in contract.payload:
        checks.append(F.when(has_control_characters(F.col(c)), F.lit(f"control:{c}")))
    return F.array_compact(F.array(*checks))


def reversed_interval(contract: TableContract) -> Column:
    """Both ends are well formed and STOP precedes START; well-formed text sorts as time."""
    formed = [exact_format(F.col(c), contract.time_pattern) for c in ("START", "STOP")]
    return formed[0] & formed[1] & (F.col("STOP") < F.col("START"))


def with_errors(raw: DataFrame, contract: TableContract) -> DataFrame:
    """Rows with an ``errors`` array; a missing value reads as empty text."""
    times = (*contract.required_times, *contract.optional_times)
    filled = raw.na.fill("", list(contract.payload))
    # Each time is parsed once, and the error list stays small enough to compile.
    parsed = filled.withColumns({f"_ok_{c}": exact_format(F.col(c), contract.time_pattern) for c in times})
    errors = row_errors(contract, {c: F.col(f"_ok_{c}") for c in times})
    return parsed.withColumn("errors", errors).drop(*[f"_ok_{c}" for c in times])


def split_valid(raw: DataFrame, contract: TableContract) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and refused rows with their errors."""
    checked = with_errors(raw, contract)
    return (
        checked.filter(F.size("errors") == 0).drop("errors"),
        checked.filter(F.size("errors") > 0),
    )


def envelope_shape(kind: str) -> str:
    """The variant schema a well-shaped envelope of this kind has: exact fields, all text."""
    fields = ", ".join(f"{c}: STRING" for c in sorted(BY_KIND[kind].payload))
    return f"OBJECT<event_type: STRING, payload: OBJECT<{fields}>>"


def shape_error(line: Column) -> Column:
    """Why a JSON line is not an event envelope, NULL when it is one.

    Unknown, missing and non-text fields and unknown kinds are refused.
    """
    parsed = F.try_parse_json(line)
    kind = F.try_variant_get(parsed, "$.event_type", "string")
    shape = F.schema_of_variant(parsed)
    fits = reduce(lambda a, b: a | b, [(kind == k) & (shape == envelope_shape(k)) for k in BY_KIND])
    return (
        F.when(parsed.isNull(), "malformed_json")
        .when(kind.isNull() | ~kind.isin(*BY_KIND), "unknown_kind")
        .when(~fits, "wrong_fields")
    )


# Fixed value: what a registered model may be called.
MODEL_NAME_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def registered_model(name: Column, version: Column) -> Column:
    """A usable model reference: a plain name and a positive version."""
    return F.coalesce(name.rlike(MODEL_NAME_PATTERN) & (version > 0), F.lit(False))


def version_mismatches(logged: DataFrame, required: DataFrame) -> DataFrame:
    """Signals whose logged major.minor differs from the required one, or is absent.

    ``logged`` has ``signal`` and ``version``, ``required`` has ``signal`` and ``running``;
    unreadable versions never match.
    """
    joined = required.join(logged.select("signal", F.col("version").alias("pinned")), "signal", "left")
    return joined.filter(~same_series(F.col("pinned"), F.col("running"))).select("signal", "pinned", "running")


def same_series(pinned: Column, running: Column) -> Column:
    """Whether two three-part versions share major and minor; false when either is unreadable."""
    return F.coalesce(major_minor(pinned) == major_minor(running), F.lit(False))
