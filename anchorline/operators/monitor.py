"""Drift monitoring over sliding windows that end at fixed boundaries.

Boundaries lie at ``start + 7k`` days for k >= 1; each looks back 30 days, clipped at the start,
half-open on the event time. Every result depends on the boundary only, never on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from anchorline.contracts import LABEL_WINDOW_DAYS
from anchorline.functions.stats import kolmogorov_p, psi_term, two_proportion_z, two_sided_p
from anchorline.operators.metrics import ranking
from anchorline.operators.rank import exact_quantiles, running_totals
from anchorline.operators.validate import same_series

STEP_DAYS, SPAN_DAYS = 7, 30
_DAY = 86_400


def _seconds(instant: str) -> Column:
    return F.unix_timestamp(F.lit(instant).cast("timestamp"))


def grid(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every boundary up to ``end`` with the start of its window."""
    first = F.lit(start).cast("timestamp")
    steps = F.floor((_seconds(end) - _seconds(start)) / (STEP_DAYS * _DAY))
    ks = F.explode(F.when(steps >= 1, F.sequence(F.lit(1), steps.cast("int")))).alias("k")
    boundary = first + F.make_dt_interval(F.col("k") * STEP_DAYS)
    return spark.range(1).select(ks).select(
        boundary.alias("boundary"),
        F.greatest(first, boundary - F.make_dt_interval(F.lit(SPAN_DAYS))).alias("window_start"),
    )


def _age(at: Column, start: str) -> Column:
    return F.unix_micros(at) - F.unix_micros(F.lit(start).cast("timestamp"))


def _whole(age: Column) -> Column:
    """Whole steps in an age, exactly, also before the start."""
    step = F.lit(STEP_DAYS * _DAY * 1_000_000)
    return ((age - F.pmod(age, step)) / step).cast("long")


def _known_from(at: Column, start: str) -> Column:
    """The number of the first boundary at or after an instant."""
    return -_whole(-_age(at, start))


def reach(at: Column, start: str, end: str) -> tuple[Column, Column]:
    """Numbers of the first and the last boundary whose window holds an instant; the first is larger where none does."""
    age = _age(at, start)
    last = F.floor((_seconds(end) - _seconds(start)) / (STEP_DAYS * _DAY))
    held = age >= 0
    return F.when(held, _whole(age) + 1).otherwise(1), F.when(held, F.least(_whole(age + SPAN_DAYS * _DAY * 1_000_000), last)).otherwise(0)


def _boundary(k: Column, start: str) -> Column:
    return F.lit(start).cast("timestamp") + F.make_dt_interval((k * STEP_DAYS).cast("int"))


def in_windows(df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Each row once per boundary whose window holds it: at most five, found by arithmetic."""
    low, high = reach(F.col(at), start, end)
    ks = F.explode(F.when(high >= low, F.sequence(low, high))).alias("_k")
    return df.select("*", ks).withColumn("boundary", _boundary(F.col("_k"), start)).drop("_k")


def counted_in_windows(
    df: DataFrame, at: str, start: str, end: str, keys: list[str], *, known: str | None = None, only: tuple[int, int] | None = None
) -> DataFrame:
    """Rows per boundary and keys, as ``n``.

    Instants that the same windows hold make a pane: whole steps and the edge that the oldest step sticks out of a window.
    Rows are counted by pane before they are dealt to windows, so no row is copied. With ``known`` a row counts only at
    boundaries at or after that instant; ``only`` asks for the boundaries of these numbers.
    """
    low, high = reach(F.col(at), start, end)
    if known is not None:
        low = F.greatest(low, _known_from(F.col(known), start))
    if only is not None:
        low, high = F.greatest(low, F.lit(only[0])), F.least(high, F.lit(only[1]))
    size = F.sum("n") if "n" in df.columns else F.count("*")
    panes = df.withColumns({"_low": low, "_high": high}).filter("_low <= _high").groupBy(*keys, "_low", "_high").agg(size.alias("n"))
    dealt = panes.select(*keys, "n", F.explode(F.sequence("_low", "_high")).alias("_k"))
    return dealt.groupBy(*keys, _boundary(F.col("_k"), start).alias("boundary")).agg(F.sum("n").alias("n"))


def window_counts(
    predictions: DataFrame,
    labels: DataFrame,
    refusals: DataFrame,
    start: str,
    end: str,
    required_versions: dict[str, str],
) -> DataFrame:
    """Predictions, released labels, refusals and version mismatches per boundary; empty windows count 0.

    Predictions, mismatches and refusals count inside the window. A label counts toward every
    boundary at or after its release.
    """
    mismatch = F.lit(False)
    for column, running in required_versions.items():
        mismatch = mismatch | ~same_series(F.col(column), F.lit(running))
    marked = counted_in_windows(predictions.withColumn("_mismatch", mismatch), "event_time", start, end, ["_mismatch"])
    per = marked.groupBy("boundary").agg(
        F.sum("n").alias("prediction_count"), F.sum(F.when(F.col("_mismatch"), F.col("n")).otherwise(0)).alias("version_mismatch_count")
    )
    refused = counted_in_windows(refusals, "at", start, end, []).withColumnRenamed("n", "refusal_count")
    mine = predictions.filter(F.col("event_time") >= F.lit(start).cast("timestamp")).select("prediction_id")
    first = F.greatest(F.lit(1), F.ceil((F.unix_timestamp("released_at") - _seconds(start)) / (STEP_DAYS * _DAY)))
    released = labels.join(mine, "prediction_id").groupBy(
        (F.lit(start).cast("timestamp") + F.make_dt_interval((first * STEP_DAYS).cast("int"))).alias("boundary")
    ).agg(F.count("*").alias("_released"))
    counts = ("prediction_count", "label_count", "refusal_count", "version_mismatch_count")
    joined = grid(predictions.sparkSession, start, end)
    for table in (per, refused, released):
        joined = joined.join(table, "boundary", "left")
    # One row per boundary of the run.
    so_far = Window.orderBy("boundary").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("label_count", F.sum("_released").over(so_far)).select(
        "boundary", "window_start", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )


def long_form(rows: DataFrame, signals: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per signal: ``signal`` and a double ``value``."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals])
    return rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.signal", "p.value")


def _size(df: DataFrame) -> Column:
    """The number of rows; a column ``n`` says how many a row stands for."""
    return F.sum("n") if "n" in df.columns else F.count("*")


def ks_two_sample(reference: DataFrame, live: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov distance and p-value of each boundary's sample against the reference.

    ``reference`` has ``signal`` and ``value``, ``live`` also ``boundary``; ``n`` is optional (see ``counted_in_windows``). Between two live
    values only the reference's distribution moves, and it is monotone there, so the largest gap
    is found at or just before a live value: the reference is accumulated once, not per boundary.
    """
    ref = reference.groupBy("signal", "value").agg(_size(reference).alias("r"))
    seen = live.groupBy("boundary", "signal", "value").agg(_size(live).alias("l"))
    points = ref.unionByName(seen.select("signal", "value").distinct().withColumn("r", F.lit(0).cast("long")))
    steps = points.groupBy("signal", "value").agg(F.sum("r").alias("r"))
    ecdf = running_totals(steps, ["value"], {"f": F.col("r")}, ["signal"]).select(
        "signal", "value",
        (F.col("f_upto") / F.col("f_all")).alias("f_at"),
        ((F.col("f_upto") - F.col("r")) / F.col("f_all")).alias("f_before"),
        F.col("f_all").alias("n_reference"),
    )
    mine = running_totals(seen, ["value"], {"g": F.col("l")}, ["boundary", "signal"])
    gap = F.greatest(
        F.abs(F.col("f_at") - F.col("g_upto") / F.col("g_all")),
        F.abs(F.col("f_before") - (F.col("g_upto") - F.col("l")) / F.col("g_all")),
    )
    out = mine.join(ecdf, ["signal", "value"]).groupBy("boundary", "signal").agg(
        F.max(gap).alias("ks"), F.max("n_reference").alias("n_reference"), F.max("g_all").alias("n_live")
    )
    return out.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("n_reference"), F.col("n_live")))


def decile_edges(reference: DataFrame) -> DataFrame:
    """Nine inner decile edges per signal."""
    names = {f"e{i}": i / 10 for i in range(1, 10)}
    edges = exact_quantiles(reference, "value", names, ["signal"])
    return edges.select("signal", F.array(*names).alias("edges"))


def stability_index(reference: DataFrame, live: DataFrame, edges: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Population stability index per boundary and signal over the reference's decile bins.

    An empty bin's share is taken as ``floor``.
    """
    bin_ = F.size(F.filter("edges", lambda e: F.col("value") > e)).alias("bin")

    def share(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        sized = df if "n" in df.columns else df.withColumn("n", F.lit(1))
        binned = sized.join(edges, "signal").select(*keys, bin_, "n").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        # Ten rows per key.
        by_bin = binned.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total")
        )
        floored = F.transform(
            F.sequence(F.lit(0), F.lit(9)),
            lambda b: F.greatest(F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0)) / F.col("total"), F.lit(floor)),
        )
        return by_bin.select(*keys, floored.alias(name))

    joined = share(live, ["boundary", "signal"], "a").join(share(reference, ["signal"], "e"), "signal")
    terms = F.aggregate(F.arrays_zip("a", "e"), F.lit(0.0), lambda acc, t: acc + psi_term(t["a"], t["e"]))
    return joined.select("boundary", "signal", terms.alias("psi"))


def proportion_tests(reference: DataFrame, live: DataFrame) -> DataFrame:
    """Two-proportion z statistic and p-value of 0/1 signals against the reference."""
    one = lambda df: F.col("n") if "n" in df.columns else F.lit(1)
    counted = lambda df, keys, x, n: df.groupBy(*keys).agg(
        F.sum(F.when(F.col("value") == 1, one(df)).otherwise(0)).alias(x), _size(df).alias(n)
    )
    joined = counted(live, ["boundary", "signal"], "x2", "n2").join(counted(reference, ["signal"], "x1", "n1"), "signal")
    z = two_proportion_z(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))
    return joined.select("boundary", "signal", z.alias("z")).withColumn("p_value", two_sided_p(F.col("z")))


def realized_by_boundary(
    predictions: DataFrame, labels: DataFrame, start: str, end: str, lag_days: int = LABEL_WINDOW_DAYS,
    only: tuple[int, int] | None = None,
) -> DataFrame:
    """Count, prevalence and AUROC of the labels known at each boundary; NULL where undefined.

    A label is released a label window after its discharge at the earliest, so the discharge
    window ends ``lag_days`` before the boundary; with 0 it is the boundary's own window.
    ``only`` restricts the boundaries to those of these numbers.
    """
    run = predictions.filter(F.col("event_time") >= F.lit(start).cast("timestamp"))
    joined = run.join(labels.select("prediction_id", "label", "released_at"), "prediction_id").withColumn(
        "_matured", F.col("event_time") + F.make_dt_interval(F.lit(lag_days))
    )
    known = counted_in_windows(joined, "_matured", start, end, ["score", "label"], known="released_at", only=only)
    found = ranking(known, ["boundary"], weight="n")
    boundaries = grid(predictions.sparkSession, start, end)
    if only is not None:
        boundaries = boundaries.filter(F.col("boundary").between(*[_boundary(F.lit(k), start) for k in only]))
    return boundaries.join(found, "boundary", "left").select(
        "boundary", F.coalesce("rows", F.lit(0)).alias("count"), "prevalence", "auroc"
    )


def touched(released: DataFrame, start: str, end: str, lag_days: int = LABEL_WINDOW_DAYS) -> tuple[int, int] | None:
    """Numbers of the first and the last boundary that released labels (event_time, released_at) change; None for none."""
    low, high = reach(F.col("event_time") + F.make_dt_interval(F.lit(lag_days)), start, end)
    low = F.greatest(low, _known_from(F.col("released_at"), start))
    first, last = released.select(low.alias("low"), high.alias("high")).filter("low <= high").agg(F.min("low"), F.max("high")).first()
    return None if first is None else (int(first), int(last))


def all_statistics(psi: DataFrame, ks: DataFrame, z: DataFrame, realized: DataFrame, floor: float) -> DataFrame:
    """Every statistic of an evaluation in one table: boundary, signal (with the statistic's name), statistic.

    The larger, the more reason for an alert: ``z`` by its size, the realized AUROC by how far it is below ``floor``.
    """
    named = lambda df, kind, value: df.select("boundary", F.concat(F.lit(f"{kind}:"), "signal").alias("signal"), value.alias("statistic"))
    short = realized.select("boundary", F.lit("realized:auroc_shortfall").alias("signal"), (F.lit(floor) - F.col("auroc")).alias("statistic"))
    return named(psi, "psi", F.col("psi")).unionByName(named(ks, "ks", F.col("ks"))).unionByName(
        named(z, "z", F.abs("z"))).unionByName(short).filter("statistic IS NOT NULL")


def evaluation_rows(counts: DataFrame, statistics: DataFrame, thresholds_digest: str, reference_id: str) -> DataFrame:
    """One row a boundary: the window, the reference, the thresholds in force, the counts and all statistics as a map."""
    # A few statistics for each signal.
    packed = statistics.groupBy("boundary").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "statistic")))).alias("statistics")
    )
    return counts.join(packed, "boundary", "left").withColumns({
        "statistics": F.coalesce("statistics", F.create_map().cast("map<string,double>")),
        "thresholds_hash": F.lit(thresholds_digest), "reference": F.lit(reference_id),
    })


def alerts(statistics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per boundary and signal whose statistic is over its threshold; dated at the boundary."""
    return statistics.join(thresholds, "signal").filter(F.col("statistic") > F.col("threshold")).select(
        F.col("boundary").alias("sim_at"), "signal", "statistic", "threshold"
    )


def thresholds_hash(thresholds: DataFrame) -> DataFrame:
    """A digest of the thresholds in force: the sorted configuration as JSON."""
    # A handful of configuration rows.
    packed = F.to_json(F.sort_array(F.collect_list(F.struct("signal", "threshold"))))
    return thresholds.agg(F.sha2(packed, 256).alias("thresholds_hash"))


def evaluation_violations(evaluations: DataFrame) -> DataFrame:
    """Rows that break a rule of the evaluations table, with the rule's name."""
    single = F.array_compact(F.array(
        F.when(~(F.col("boundary") > F.col("window_start")), F.lit("boundary_after_window_start")),
        F.when(F.col("thresholds_hash") == "", F.lit("thresholds_hash_present")),
        *[F.when(F.col(c) < 0, F.lit(f"{c}_not_negative"))
          for c in ("prediction_count", "label_count", "refusal_count", "version_mismatch_count")],
    ))
    broken = evaluations.select("run_id", "boundary", F.explode(single).alias("rule"))
    twice = evaluations.groupBy("run_id", "boundary").agg(F.count("*").alias("_n")).filter("_n > 1")
    return broken.unionByName(twice.select("run_id", "boundary", F.lit("one_per_boundary").alias("rule")))


def label_violations(labels: DataFrame) -> DataFrame:
    """Labels that break a rule: 0/1 values, never released before due, one per prediction."""
    single = F.array_compact(F.array(
        F.when(~F.col("label").isin(0, 1), F.lit("label_is_binary")),
        F.when(F.col("released_at") < F.col("due_at"), F.lit("released_after_due")),
    ))
    broken = labels.select("prediction_id", F.explode(single).alias("rule"))
    twice = labels.groupBy("prediction_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    return broken.unionByName(twice.select("prediction_id", F.lit("one_per_prediction").alias("rule")))


def reference_violations(references: DataFrame) -> DataFrame:
    return references.groupBy("model_name", "model_version").agg(F.count("*").alias("references")).filter(
        F.col("references") > 1
    )
