"""Group-by operators: pivots, frequencies and distinct values."""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.columns import (BOOLEAN, INTEGERS, NUMBER, TEMPORAL, TEXT, as_micros, col, family,
                                 field, from_micros, nulls_last)
from ..session import written
from .rows import filter_rows

# The aggregates a pivot offers.
AGGREGATES = ("sum", "count", "avg", "min", "max", "median", "count_distinct", "stddev")
# Up to this many input rows a group's values fit one task's memory, whatever
# the skew; beyond it the median is found across tasks.
GROUP_VALUES_LIMIT = 5_000_000
PIVOT_COLUMNS_LIMIT = 10_000


def _need(found: T.StructField, agg: str, *allowed: str) -> None:
    if family(found.dataType) not in allowed:
        raise SpecError(f"cannot take the {agg} of {found.name!r}, "
                        f"which is {found.dataType.simpleString()}")


def exact_sum(c: Column, dtype: T.DataType) -> Column:
    """A sum that keeps whole numbers and decimals exact and does not overflow."""
    if isinstance(dtype, INTEGERS):
        return F.sum(c.cast("decimal(38,0)"))
    if isinstance(dtype, T.DecimalType):
        return F.sum(c.cast(T.DecimalType(38, dtype.scale)))
    return F.sum(c)


def _aggregate(found: T.StructField, agg: str) -> Column:
    c = col(found.name)
    if agg == "sum":
        _need(found, agg, NUMBER)
        return exact_sum(c, found.dataType)
    if agg in ("avg", "stddev"):
        _need(found, agg, NUMBER)
        return (F.avg if agg == "avg" else F.stddev_samp)(c.cast("double"))
    return {"count": F.count, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[agg](c)


def pivot(df: DataFrame, rows, value: str, agg: str = "sum", column_field: str | None = None,
          filters: dict | None = None) -> DataFrame:
    """Group by ``rows``; with ``column_field``, one output column per value of it.

    Without it the aggregate is named ``{agg}_{value}``. With it, columns are
    the field's distinct non-null values in value order, named by their text.
    """
    if not rows:
        raise SpecError("a pivot needs at least one row field")
    agg = str(agg).lower()
    if agg not in AGGREGATES:
        raise SpecError(f"unsupported aggregate: {agg!r}")
    keys = [field(df.schema, r).name for r in rows]
    found = field(df.schema, value)
    kept = filter_rows(df, filters)
    order = [nulls_last(col(k)) for k in keys]

    if column_field is None:
        name = f"{agg}_{value}"
        if agg == "median":
            grouped = median_by(kept, keys, value, name)
        else:
            grouped = kept.groupBy([col(k) for k in keys]).agg(_aggregate(found, agg).alias(name))
        return grouped.orderBy(order)

    across = field(df.schema, column_field)
    labels = _pivot_labels(kept, across)
    if not labels:
        return kept.select([col(k) for k in keys]).distinct().orderBy(order)
    kept = kept.withColumn("__across", col(across.name).cast("string"))
    cell = _aggregate(found, agg) if agg != "median" else F.first("__cell", ignorenulls=True)
    if agg == "median":
        kept = median_by(kept, keys + ["__across"], value, "__cell")
    wide = kept.groupBy([col(k) for k in keys]).pivot("__across", labels).agg(cell)
    if agg in ("count", "count_distinct"):
        added = [c for c in wide.columns if c not in keys]
        wide = wide.select([col(k) for k in keys]
                           + [F.coalesce(col(c), F.lit(0).cast("long")).alias(c) for c in added])
    return wide.orderBy(order)


def _pivot_labels(df: DataFrame, across: T.StructField) -> list[str]:
    """The field's distinct values as text, in value order."""
    c = col(across.name)
    values = (df.filter(c.isNotNull()).select(c.alias("v")).distinct().orderBy("v")
              .limit(PIVOT_COLUMNS_LIMIT + 1).select(F.col("v").cast("string")).collect())
    if len(values) > PIVOT_COLUMNS_LIMIT:
        raise SpecError(f"{across.name!r} has more than {PIVOT_COLUMNS_LIMIT:,} values, "
                        "too many to be columns")
    return list(dict.fromkeys(r.v for r in values))


# ---------------------------------------------------------------- medians

def median_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The exact median of ``value`` in each group: the mean of the middle two
    values of a number or a time, the lower of the two for text and booleans.

    Decimals and 64-bit integers never pass through a double on the way: the
    middle values are picked as they are. The median of a decimal has one more
    decimal place, if 38 digits leave room for it; that of integers is the
    double nearest to the exact mean.
    """
    found = field(df.schema, value)
    fam = family(found.dataType)
    _need(found, "median", NUMBER, TEMPORAL, TEXT, BOOLEAN)
    measured, back = col(value), (lambda m: m)
    wide = isinstance(found.dataType, (T.LongType, T.DecimalType))
    if wide:
        measured = measured.cast(found.dataType)
    elif fam == NUMBER:
        measured = measured.cast("double")
    elif fam == TEMPORAL:
        measured = as_micros(value, found.dataType).cast("double")
        back = functools.partial(from_micros, dtype=found.dataType)

    work = df.select([col(k) for k in keys] + [measured.alias("__v")])
    if wide:
        out = _median_across_tasks(work, keys, mean=True, joined_mean=_exact_middle(found.dataType))
    elif fam in (NUMBER, TEMPORAL) and df.count() <= GROUP_VALUES_LIMIT:
        out = work.groupBy([col(k) for k in keys]).agg(F.median("__v").alias("__m"))
    else:
        out = _median_across_tasks(work, keys, mean=fam in (NUMBER, TEMPORAL))
    return out.select([col(k) for k in keys] + [back(col("__m")).alias(name)])


def _exact_middle(dtype: T.DataType):
    """The mean of two decimals or integers, worked out in decimals."""
    if isinstance(dtype, T.LongType):
        wide = T.DecimalType(20, 0)
        return lambda low, high: ((low.cast(wide) + high.cast(wide)) * F.lit("0.5").cast("decimal(2,1)")).cast("double")
    room = dtype.precision < 38
    out = T.DecimalType(dtype.precision + 1, dtype.scale + 1) if room else dtype
    return lambda low, high: (low + ((high - low) * F.lit("0.5").cast("decimal(2,1)")).cast(out)).cast(out)


def _same(keys: list[str], left: str, right: str) -> Column:
    pairs = [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]
    return functools.reduce(lambda a, b: a & b, pairs)


def _median_across_tasks(work: DataFrame, keys: list[str], mean: bool, joined_mean=None) -> DataFrame:
    """Medians without ever holding a group in one task.

    Equal values are counted first, then the counts are range-partitioned by
    group and value, so a hot group spreads over many partitions. Running
    totals of partition sizes tell which partition holds each middle rank; only
    those (at most two per group) are ranked row by row.
    """
    group = [col(k) for k in keys]
    counted = work.groupBy(group + [col("__v")]).agg(F.count("__v").alias("__n"))
    # Written once: asking twice could cut the ranges differently.
    ranged = written(counted.repartitionByRange(*[nulls_last(c) for c in group], col("__v"))
                          .withColumn("__p", F.spark_partition_id()))
    present = ranged.filter(col("__v").isNotNull())
    parts = present.groupBy(group + [col("__p")]).agg(F.sum("__n").alias("__size"))
    per_group = Window.partitionBy(*group)
    before = per_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
             .withColumn("__total", F.sum("__size").over(per_group))
             .withColumn("__lo", F.expr("(__total - 1) div 2"))
             .withColumn("__hi", F.expr("__total div 2" if mean else "(__total - 1) div 2")))
    end = F.col("__before") + F.col("__size")
    parts = parts.filter((F.col("__lo") < end) & (F.col("__hi") >= F.col("__before")))
    middle = (present.alias("r").join(parts.alias("s"), _same(keys, "r", "s")
                                      & (F.col("r.__p") == F.col("s.__p")))
              .select([F.col(f"r.`{k}`") for k in keys]
                      + [F.col("r.__v"), F.col("r.__n"), F.col("r.__p"),
                         F.col("s.__before"), F.col("s.__lo"), F.col("s.__hi")]))
    in_part = Window.partitionBy(*group, col("__p")).orderBy("__v")
    middle = middle.withColumn("__end", F.col("__before") + F.sum("__n").over(in_part))
    start = F.col("__end") - F.col("__n")

    def at(rank):
        return F.max(F.when((start <= F.col(rank)) & (F.col(rank) < F.col("__end")), F.col("__v")))

    low, high = at("__lo"), at("__hi")
    found = joined_mean(low, high) if joined_mean else (low + high) / 2 if mean else low
    medians = middle.groupBy(group).agg(found.alias("__m"))
    every = ranged.select(group).distinct()
    return (every.alias("e").join(medians.alias("m"), _same(keys, "e", "m"), "left")
            .select([F.col(f"e.`{k}`") for k in keys] + [F.col("m.__m")]))


# ------------------------------------------------- frequencies and values

def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Every value of a column, null included, with its rows; commonest first."""
    c = col(field(df.schema, column).name)
    return (df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc_nulls_last("value")))


class Values(NamedTuple):
    rows: DataFrame
    distinct_total: int
    truncated: bool


def distinct_values(df: DataFrame, column: str, search: str = "", limit: int = 200) -> DataFrame:
    """The commonest non-null values, optionally only those containing a text."""
    if not 1 <= limit <= 1_000:
        raise SpecError("between 1 and 1,000 values can be listed")
    c = col(field(df.schema, column).name)
    kept = df.filter(c.isNotNull())
    if search:
        pattern = search.replace("\\", "\\\\")
        kept = kept.filter(c.cast("string").ilike(f"%{pattern}%"))
    return (kept.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc("value")).limit(limit))


def pick_values(df: DataFrame, column: str, search: str = "", limit: int = 200) -> Values:
    """The values to pick from, with how many there are in all."""
    listed = distinct_values(df, column, search, limit)
    total = df.agg(F.count_distinct(col(column))).first()[0]
    return Values(listed, total, total > limit and not search)
