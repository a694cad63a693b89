"""Exact quantiles of many columns at once, at any size."""

from __future__ import annotations

import math
import operator
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_number, batches, col, combine

# Up to this many values a quantile may hold them all in one task.
IN_TASK_VALUES = 200_000
# Bins one narrowing pass cuts each bracket into.
NARROW_BINS = 2_048
# Size of the rank sketch, and how far from a wanted rank its answer may lie
# (several standard errors). A bracket that misses is noticed and widened.
SKETCH_K = 4_000
SKETCH_MARGIN = 0.004


def exact_quantiles(column: Column, fractions) -> Column:
    """Linearly interpolated quantiles, for data already known to be small."""
    return F.percentile(column.cast("double"), F.array(*[F.lit(float(f)) for f in fractions]))


def sketch_quantiles(column: Column, fractions) -> Column:
    """Approximate quantiles: values of the column near the wanted ranks."""
    x = column.cast("double")
    sketch = F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
    ranks = F.array(*[F.lit(float(f)) for f in fractions])
    return F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def sketch_brackets(column: Column, fractions) -> Column:
    """For each fraction, two values that very likely bracket its rank."""
    return sketch_quantiles(column, [end for p in fractions
                                     for end in (max(0.0, p - SKETCH_MARGIN), min(1.0, p + SKETCH_MARGIN))])


@dataclass
class _Target:
    """One quantile being closed in on: two neighbouring 0-based ranks, and a
    bracket of values that holds both."""

    column: str
    first: int
    last: int
    lo: float
    hi: float
    below: int | None = None
    inside: int | None = None
    values: tuple[float, float] | None = None

    def holds(self, x: Column) -> Column:
        return x.between(F.lit(self.lo), F.lit(self.hi))

    @property
    def brackets_ranks(self) -> bool:
        return self.below <= self.first and self.last < self.below + self.inside


def quantiles(df: DataFrame, facts: dict[str, dict], fractions,
              in_task: int = IN_TASK_VALUES) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of number columns.

    ``facts`` gives each column's ``n`` (non-null count), ``min``, ``max`` and,
    optionally, ``brackets``: the values of ``sketch_brackets``.

    Up to ``in_task`` values: one aggregate. Many: count what lies below and inside each
    bracket, then cut the bracket into bins and keep the one that holds the
    rank, until it is known to be small enough for one task. Every scan moves
    counts, never rows, and reads only rows inside a bracket.
    """
    out: dict[str, list[float | None]] = {c: [None] * len(fractions) for c in facts}
    filled = {c: f for c, f in facts.items() if f["n"]}
    few = [c for c, f in filled.items() if f["n"] <= in_task]
    for batch in batches(few):
        row = df.agg(*[exact_quantiles(col(c), fractions).alias(f"q{i}") for i, c in enumerate(batch)]).first()
        for i, c in enumerate(batch):
            out[c] = list(row[i])

    targets: dict[tuple[str, int], _Target] = {}
    for c, f in filled.items():
        if c in few:
            continue
        for i, p in enumerate(fractions):
            at = int(p * (f["n"] - 1))
            lo, hi = f["brackets"][2 * i:2 * i + 2] if f.get("brackets") else (f["min"], f["max"])
            targets[(c, i)] = _Target(c, at, min(at + 1, f["n"] - 1), float(lo), float(hi))
    for batch in batches(targets.values()):
        _settle(df, batch, filled, in_task)
    for (c, i), t in targets.items():
        low, high = t.values
        part = fractions[i] * (filled[c]["n"] - 1) - t.first
        out[c][i] = low + (high - low) * part if low != high else low
    return out


def _settle(df: DataFrame, targets: list[_Target], facts: dict[str, dict], in_task: int) -> None:
    _measure(df, targets)
    for t in targets:
        if not t.brackets_ranks:    # the sketch missed: take the whole range
            f = facts[t.column]
            t.lo, t.hi, t.below, t.inside = float(f["min"]), float(f["max"]), 0, f["n"]
    while True:
        for t in targets:
            if t.values is None and t.lo == t.hi:
                t.values = (t.lo, t.lo)
        todo = [t for t in targets if t.values is None]
        if not todo:
            return
        small = [t for t in todo if t.inside <= in_task]
        if small:
            _read(df, small)
        wide = [t for t in todo if t.inside > in_task]
        if wide:
            _narrow(df, wide)


def _numbers(df: DataFrame, targets: list[_Target]) -> DataFrame:
    return df.select([as_number(c, df.schema[c].dataType).alias(c) for c in sorted({t.column for t in targets})])


def _measure(df: DataFrame, targets: list[_Target]) -> None:
    if not targets:
        return
    aggs = []
    for i, t in enumerate(targets):
        aggs += [F.count_if(col(t.column) < F.lit(t.lo)).alias(f"b{i}"),
                 F.count_if(t.holds(col(t.column))).alias(f"i{i}")]
    row = _numbers(df, targets).agg(*aggs).first()
    for i, t in enumerate(targets):
        t.below, t.inside = row[f"b{i}"], row[f"i{i}"]


def _inside(df: DataFrame, targets: list[_Target], entry) -> DataFrame:
    """One entry per row and target whose bracket the row's value is in."""
    numbers = _numbers(df, targets)
    near = combine(operator.or_, [t.holds(col(t.column)) for t in targets])
    entries = [F.when(t.holds(col(t.column)), entry(i, t, col(t.column))) for i, t in enumerate(targets)]
    return (numbers.filter(near).select(F.explode(F.array(*entries)).alias("e"))
            .filter(F.col("e").isNotNull()).select("e.*"))


def _place(t: _Target, x: Column) -> Column:
    """The bin of a value: the bracket's ends never share one, so every pass
    makes progress. Infinities and NaN have bins of their own."""
    lo, hi = max(t.lo, -sys.float_info.max), min(t.hi, sys.float_info.max)
    step = max(hi / NARROW_BINS - lo / NARROW_BINS, 5e-324)
    place = F.least(F.floor((x - F.lit(lo)) / F.lit(step)), F.lit(NARROW_BINS - 1)).cast("int")
    return (F.when(x == F.lit(-math.inf), F.lit(-1)).when(x == F.lit(math.inf), F.lit(NARROW_BINS))
            .when(F.isnan(x), F.lit(NARROW_BINS + 1)).otherwise(place))


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    def entry(i, t, x):
        return F.struct(F.lit(i).alias("t"), _place(t, x).alias("bin"), x.alias("x"))

    counted = (_inside(df, targets, entry).groupBy("t", "bin")
               .agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    bins: dict[int, list] = {}
    for row in counted.orderBy("t", "bin").collect():
        bins.setdefault(row["t"], []).append(row)
    for i, t in enumerate(targets):
        below = t.below
        for at, b in enumerate(bins[i]):
            if t.first < below + b["n"]:
                if t.last < below + b["n"]:
                    t.lo, t.hi, t.below, t.inside = b["lo"], b["hi"], below, b["n"]
                else:    # the two ranks are neighbours across two bins
                    t.values = (b["hi"], bins[i][at + 1]["lo"])
                break
            below += b["n"]


def _read(df: DataFrame, targets: list[_Target]) -> None:
    def entry(i, t, x):
        return F.struct(F.lit(i).alias("t"), x.alias("x"))

    def rank_of(name):
        return F.create_map(*[F.lit(v) for i, t in enumerate(targets)
                              for v in (i, getattr(t, name) - t.below)])[F.col("t")]

    end = F.sum("n").over(Window.partitionBy("t").orderBy("x"))
    start = F.col("end") - F.col("n")

    def at(name):
        return F.max(F.when((rank_of(name) >= start) & (rank_of(name) < F.col("end")), F.col("x")))

    rows = (_inside(df, targets, entry).groupBy("t", "x").agg(F.count("x").alias("n"))
            .withColumn("end", end).groupBy("t").agg(at("first").alias("low"), at("last").alias("high")))
    for row in rows.collect():
        targets[row["t"]].values = (row["low"], row["high"])
