"""As-of lookups over per-entity timelines.

Every temporal operator here is one question: what had accumulated for this entity by that
instant? A trailing range count is the difference of two such totals, an interval-contains
count is starts minus stops, "last before" is a running maximum, a forward existence test is
the difference of two totals ahead of the anchor.

The totals are prefix sums in two or more levels: events are dealt by entity and calendar slice,
reduced to one row per instant, summed inside the slice, then across slices. A window group is
never larger than the instants in one slice or the slices in one entity's history, so an entity
that holds a large share of all rows spreads over as many tasks as it has slices, and no row is
paired with another. Probed instants and slice totals are kept in a checkpoint between the levels,
so a call runs the job that reads the events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from anchorline.functions.scalar import DAY, MINUTE
from anchorline.session import materialize

ENTITY, AT, PROBE, LAST = "_entity", "_at", "_probe", "_last"


@dataclass(frozen=True)
class Measure:
    """What accumulates: ``sum`` of weights, ``max`` of values or ``bits`` set so far."""

    name: str
    how: str = "sum"

    @property
    def aggregate(self) -> str:
        return {"sum": "sum", "max": "max", "bits": "bit_or"}[self.how] + f"({self.name})"

    def merge(self, parts: list[str]) -> str:
        if self.how == "max":
            return f"greatest({', '.join(parts)})"
        return {"sum": " + ", "bits": " | "}[self.how].join(f"coalesce({p}, 0)" for p in parts)


@dataclass(frozen=True)
class Lookup:
    """One output column: a measure at ``anchor + offset``.

    ``inclusive`` decides whether events at that very instant are part of it.
    """

    name: str
    measure: str
    offset: int = 0
    inclusive: bool = False

    @property
    def total(self) -> str:
        return f"{self.measure}__{'upto' if self.inclusive else 'before'}"


# Whole-second clocks: at most 10,368,000 instants in a slice, about 300 slices in a century. A shorter slice leaves most
# events as the last of theirs, and the slices' totals are then as many as the events.
SEASONS = (120 * DAY,)
# Finer clocks: slices of a day, then of a minute.
FINE = (DAY, MINUTE)

FRAMES = {"before": "1 PRECEDING", "upto": "CURRENT ROW"}


def running(aggregate: str, keys: list[str], order: str, frame: str) -> str:
    """SQL of an aggregate over a growing frame."""
    return (
        f"{aggregate} OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND {FRAMES[frame]})"
    )


def totals_at(
    events: DataFrame, probes: DataFrame, measures: list[Measure], totals: set[str], slices: tuple[int, ...]
) -> DataFrame:
    """For each probed (entity, instant), the wanted totals of the measures.

    ``events`` has ``_entity``, ``_at`` (microseconds) and the measure columns; ``probes`` has
    ``_entity``, ``_at`` and ``_probe``, a bit set that is handed through. A total is named
    ``<measure>__before`` or ``<measure>__upto``.
    """
    levels = [f"_s{i}" for i in range(len(slices))]
    both = events.unionByName(probes, allowMissingColumns=True).selectExpr(
        "*", *[f"{AT} - pmod({AT}, {w}L) AS {s}" for s, w in zip(levels, slices)]
    )
    # Stated here, the joins below infer nothing new, and their sides share one exchange.
    both = both.filter(" AND ".join(f"{name} IS NOT NULL" for name in (ENTITY, *levels)))
    inner = [ENTITY, *levels]
    # Dealt by slice once: the sums by instant and the windows inside a slice both take the rows where they are.
    both = both.repartition(*inner)
    summed = [F.expr(f"{m.aggregate} AS {m.name}") for m in measures]
    probed = F.expr(f"bit_or({PROBE}) AS {PROBE}")
    instants = both.groupBy(ENTITY, *levels, AT).agg(*summed, probed)

    # One pass over the slices leaves the probed instants with what their slice holds so far, and each slice's last
    # instant with all of it. The rest is done with here, so events are read, exchanged and sorted once.
    by_name = {m.name: m for m in measures}
    inside = {f"{m.name}__upto": running(m.aggregate, inner, AT, "upto") for m in measures}
    for total in sorted(totals - set(inside)):
        inside[total] = running(by_name[total.rsplit("__", 1)[0]].aggregate, inner, AT, "before")
    last = f"lead({AT}) OVER (PARTITION BY {', '.join(inner)} ORDER BY {AT}) IS NULL AS {LAST}"
    kept = materialize(
        instants.selectExpr(*inner, AT, PROBE, last, *[f"{sql} AS {name}" for name, sql in inside.items()])
        .filter(f"{LAST} OR {PROBE} IS NOT NULL")
    )

    # What earlier slices carry into each slice.
    found = kept.filter(f"{PROBE} IS NOT NULL").drop(LAST)
    ends = kept.filter(LAST).selectExpr(*inner, *[f"{m.name}__upto AS {m.name}" for m in measures])
    for depth in range(len(levels), 0, -1):
        keys = [ENTITY, *levels[:depth]]
        whole = ends if depth == len(levels) else ends.groupBy(*keys).agg(*summed)
        carried = whole.selectExpr(
            *keys, *[f"{running(m.aggregate, keys[:-1], keys[-1], 'before')} AS {m.name}__carry{depth}" for m in measures]
        )
        found = found.join(carried, keys)

    merged = []
    for total in sorted(totals):
        name = total.rsplit("__", 1)[0]
        parts = [f"{name}__carry{d}" for d in range(1, len(levels) + 1)]
        merged.append(f"{by_name[name].merge([total, *parts])} AS {total}")
    return found.selectExpr(ENTITY, AT, PROBE, *merged)


def as_of(
    anchors: DataFrame,
    events: DataFrame,
    *,
    entity: str,
    at: str,
    measures: list[Measure],
    lookups: list[Lookup],
    slices: tuple[int, ...] = SEASONS,
) -> DataFrame:
    """Add one column per lookup to every anchor; anchors keep their rows and columns.

    ``anchors`` has ``entity`` and ``at``; ``events`` has the same two columns (``at`` in
    microseconds) and the measure columns. Counts and bit sets without any event are 0, maxima
    are NULL. With whole-second data one slice level is enough; finer clocks take two.
    """
    offsets = sorted({lookup.offset for lookup in lookups})
    present = f"{entity} IS NOT NULL AND {at} IS NOT NULL"
    shifted = ", ".join(f"struct({at} + {o}L AS at, {1 << i}L AS role)" for i, o in enumerate(offsets))
    probes = (
        anchors.filter(present)
        .selectExpr(f"{entity} AS {ENTITY}", f"explode(array({shifted})) AS p")
        .selectExpr(ENTITY, f"p.at AS {AT}", f"p.role AS {PROBE}")
    )
    timed = events.filter(present).selectExpr(
        f"{entity} AS {ENTITY}", f"{at} AS {AT}", *[m.name for m in measures]
    )
    totals = totals_at(timed, probes, measures, {k.total for k in lookups}, slices)

    # Each probed instant answers for the anchor instants it was shifted from.
    if len(offsets) == 1:
        answers = totals.selectExpr(
            f"{ENTITY} AS _answer_entity", f"{AT} - {offsets[0]}L AS _answer_at",
            *[f"{k.total} AS {k.name}" for k in lookups],
        )
    else:
        back = ", ".join(
            f"if({PROBE} & {1 << i}L != 0, struct({i} AS role, {AT} - {o}L AS at), NULL)"
            for i, o in enumerate(offsets)
        )
        answers = (
            totals.selectExpr("*", f"explode(array_compact(array({back}))) AS _r")
            .selectExpr("*", "_r.at AS _answer_at", "_r.role AS _role")
            .groupBy(F.col(ENTITY).alias("_answer_entity"), "_answer_at")
            .agg(*[F.expr(f"max({k.total}) FILTER (WHERE _role = {offsets.index(k.offset)}) AS {k.name}")
                   for k in lookups])
        )
    how = {m.name: m.how for m in measures}
    out = anchors.join(answers, F.expr(f"{entity} = _answer_entity AND {at} = _answer_at"), "left")
    return out.selectExpr(
        *[f"`{c}`" for c in anchors.columns],
        *[k.name if how[k.measure] == "max" else f"coalesce({k.name}, 0L) AS {k.name}" for k in lookups],
    )


def interval_edges(intervals: DataFrame, entity: str, start: str, stop: str, at: str, weight: str) -> DataFrame:
    """Half-open intervals as +1 at the start and -1 at the stop; an open one has no stop.

    An interval that ends at or before its start holds no instant and is dropped.
    """
    return (
        intervals.filter(f"{stop} IS NULL OR {stop} > {start}")
        .selectExpr(entity, f"explode(array(struct({start} AS at, 1 AS w), struct({stop} AS at, -1 AS w))) AS e")
        .filter("e.at IS NOT NULL")
        .selectExpr(entity, f"e.at AS {at}", f"e.w AS {weight}")
    )


def trailing_count(anchors, events, *, entity, at, span, counts, slices=SEASONS):
    """Events of the entity with ``anchor - span <= at < anchor``; far edge in, near edge out.

    ``counts`` maps an output column to a predicate over the events.
    """
    measures = [Measure(name) for name in counts]
    weighted = events.select(entity, at, *[p.cast("int").alias(n) for n, p in counts.items()])
    lookups = [Lookup(f"{n}__now", n) for n in counts] + [Lookup(f"{n}__floor", n, -span) for n in counts]
    out = as_of(anchors, weighted, entity=entity, at=at, measures=measures, lookups=lookups, slices=slices)
    return out.withColumns({n: F.col(f"{n}__now") - F.col(f"{n}__floor") for n in counts}).drop(
        *[k.name for k in lookups]
    )


def last_before(anchors, events, *, entity, at, name, slices=SEASONS):
    """The latest event instant strictly before the anchor, NULL without one."""
    return as_of(
        anchors, events.select(entity, at, F.col(at).alias(name)), entity=entity, at=at,
        measures=[Measure(name, "max")], lookups=[Lookup(f"{name}__v", name)], slices=slices,
    ).withColumnRenamed(f"{name}__v", name)


def active_count(anchors, intervals, *, entity, at, start, stop, name, slices=SEASONS):
    """Intervals of the entity with ``start <= anchor`` and no stop or ``stop > anchor``."""
    return as_of(
        anchors, interval_edges(intervals, entity, start, stop, at, name), entity=entity, at=at,
        measures=[Measure(name)], lookups=[Lookup(f"{name}__v", name, inclusive=True)], slices=slices,
    ).withColumnRenamed(f"{name}__v", name)


def forward_count(anchors, events, *, entity, at, span, name, slices=SEASONS):
    """Events of the entity with ``anchor < at <= anchor + span``."""
    out = as_of(
        anchors, events.select(entity, at, F.lit(1).alias(name)), entity=entity, at=at,
        measures=[Measure(name)],
        lookups=[Lookup("_now", name, inclusive=True), Lookup("_ahead", name, span, inclusive=True)],
        slices=slices,
    )
    return out.withColumn(name, F.col("_ahead") - F.col("_now")).drop("_now", "_ahead")


def next_at_or_after(anchors, events, *, entity, at, name, slices=SEASONS):
    """The earliest event instant at or after the anchor: "last before" on a mirrored axis."""
    mirrored = events.select(entity, (-F.col(at)).alias(at), (-F.col(at)).alias(name))
    out = as_of(
        anchors.withColumn(at, -F.col(at)), mirrored, entity=entity, at=at,
        measures=[Measure(name, "max")], lookups=[Lookup(f"{name}__v", name, inclusive=True)], slices=slices,
    )
    return out.withColumns({at: -F.col(at), name: -F.col(f"{name}__v")}).drop(f"{name}__v")
