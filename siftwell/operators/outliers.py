"""Outliers: what does not fit, each finding with the rows it counts.

A finding's count and its ``rows`` use one and the same predicate, so a
finding that says three opens three.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.columns import NUMBER, TEXT, batches, col, combine, families, field, group_key
from ..session import at_hand, written
from .profile import (KEY_UNIQUE_RATIO, RARE_MAX_DISTINCT, Bin, Counted, build_histogram, distinct_sketch,
                      histogram_counts, pct, seconds, short, value_counts)
from .quantiles import quantiles, sketch_brackets
from .rows import sort_rows

# Bounds and limits of the checks.
K_RANGE = (1.5, 3.0)
N_RANGE = (1, 100)
RARE_LIST_LIMIT = 200
MOSTLY_BLANK = 0.5
CHECKS = ("duplicates", "mostly_blank")

# A sketch decides only that a column is far from a gate; this much further
# out than the gate (over ten standard errors), the exact count is not needed.
SKETCH_SLACK = 0.10


@dataclass
class Finding:
    column: str | None
    count: int
    summary: str

    def rows(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class Extremes(Finding):
    below: int = 0
    above: int = 0
    q1: float = 0.0
    q3: float = 0.0
    k: float = 1.5
    low: float = 0.0
    high: float = 0.0
    histogram: list[Bin] = dc_field(default_factory=list)

    def rows(self, df):
        return extreme_rows(df, self.column, self.low, self.high)


@dataclass
class Rare(Finding):
    # The rarest, at most as many as were asked for.
    values: list[Counted] = dc_field(default_factory=list)
    total_values: int = 0
    # Every rare value; no more than RARE_MAX_DISTINCT, as the check needs.
    every: list[str] = dc_field(default_factory=list, repr=False)

    def rows(self, df):
        return rare_rows(df, self.column, self.every)


@dataclass
class Missing(Finding):
    pct: float = 0.0

    def rows(self, df):
        return df.filter(col(self.column).isNull())


@dataclass
class MostlyBlank(Finding):
    def rows(self, df):
        return mostly_blank_rows(df)


@dataclass
class Duplicates(Finding):
    values: int = 0
    worst: Counted | None = None

    def rows(self, df):
        return duplicate_rows(df, self.column)


@dataclass
class Outliers:
    rows: int
    k: float
    n: int
    extremes: list[Extremes]
    rare: list[Rare]
    missing: list[Missing]
    mostly_blank: MostlyBlank
    duplicates: list[Duplicates]

    def findings(self) -> list[Finding]:
        blank = [self.mostly_blank] if self.mostly_blank.count else []
        return [*self.extremes, *self.rare, *self.missing, *blank, *self.duplicates]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per finding."""
        kind = {Extremes: "extremes", Rare: "rare", Missing: "missing",
                MostlyBlank: "mostly_blank", Duplicates: "duplicates"}
        return spark.createDataFrame([(kind[type(f)], f.column, f.count, f.summary) for f in self.findings()],
                                     "check string, column string, count long, summary string")


# ------------------------------------------------------------- predicates

def below_fence(c: Column, low: float) -> Column:
    return c < F.lit(low)


def above_fence(c: Column, high: float) -> Column:
    return c > F.lit(high)


def mostly_blank(df: DataFrame) -> Column:
    blanks = [col(c).isNull().cast("int") for c in df.columns]
    return combine(operator.add, blanks) >= F.lit(MOSTLY_BLANK * len(blanks))


# ---------------------------------------------------- rows behind findings

def extreme_rows(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    c = col(field(df.schema, column).name)
    return df.filter(below_fence(c, low) | above_fence(c, high))


def rare_rows(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.filter(col(field(df.schema, column).name).isin(list(values)))


def mostly_blank_rows(df: DataFrame) -> DataFrame:
    return df.filter(mostly_blank(df)) if df.columns else df.limit(0)


def _key_counts(df: DataFrame, column: str) -> DataFrame:
    key = group_key(column, df.schema[column].dataType)
    return (df.filter(col(column).isNotNull()).groupBy(key.alias("__key"))
            .agg(F.count(F.lit(1)).alias("__n")))


def duplicate_rows(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """Rows whose value in ``column`` occurs more than once, ordered by it.

    The repeated values have one row each and are written first: a join of two
    plain exchanges is one that adaptive execution splits where a value holds
    a large part of the table.
    """
    found = field(df.schema, column)
    repeated = written(_key_counts(df, column).filter(F.col("__n") > 1).select(F.col("__key").alias("__repeated")))
    rows = (df.withColumn("__key", group_key(column, found.dataType))
            .join(repeated, F.col("__key") == F.col("__repeated"), "left_semi").drop("__key"))
    return sort_rows(rows, column) if ordered else rows


def check_rows(df: DataFrame, check: str, column: str | None = None) -> DataFrame:
    """The rows behind a finding that no filter tree can express."""
    if check not in CHECKS:
        raise SpecError(f"unknown check: {check!r}")
    return duplicate_rows(df, column) if check == "duplicates" else mostly_blank_rows(df)


# ----------------------------------------------------------------- checks

@dataclass
class _Facts:
    rows: int
    mostly_blank: int
    columns: dict[str, dict]


def _facts(df: DataFrame, fams) -> _Facts:
    """Counts, ranges and sketches of every column.

    One scan; a table wider than a batch gives its sketches in several, each
    over its own columns.
    """
    aggs = [F.count(F.lit(1)).alias("rows"), (F.count_if(mostly_blank(df)) if fams else F.lit(0)).alias("blank")]
    aggs += [F.count(col(name)).alias(f"n{i}") for i, (name, _) in enumerate(fams)]
    row: dict = {}
    for batch in batches(enumerate(fams)) or [[]]:
        for i, (name, fam) in batch:
            c = col(name)
            if fam in (TEXT, NUMBER):
                aggs.append(distinct_sketch(c).alias(f"d{i}"))
            if fam == NUMBER:
                aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                         sketch_brackets(c, (0.25, 0.75)).alias(f"b{i}")]
        if aggs:
            row.update(df.agg(*aggs).first().asDict())
            aggs = []
    columns = {}
    for i, (name, fam) in enumerate(fams):
        columns[name] = {"family": fam, "n": row[f"n{i}"], "distinct": row.get(f"d{i}"),
                         "min": row.get(f"lo{i}"), "max": row.get(f"hi{i}"), "brackets": row.get(f"b{i}")}
    return _Facts(row["rows"], row["blank"], columns)


def outliers(df: DataFrame, k: float = 1.5, n: int = 5, listed: int = RARE_LIST_LIMIT) -> Outliers:
    """Extremes, rare categories, missing values and repeating keys.

    Every count is exact whatever the table's size. The sketches of the first
    scan only rule out columns that are nowhere near a check's gate. ``listed``
    is how many rare values a finding spells out; it counts and opens them all.
    """
    if not K_RANGE[0] <= k <= K_RANGE[1]:
        raise SpecError(f"k lies between {K_RANGE[0]} and {K_RANGE[1]}")
    if not N_RANGE[0] <= n <= N_RANGE[1]:
        raise SpecError(f"n lies between {N_RANGE[0]} and {N_RANGE[1]}")
    with at_hand(df) as held:
        return _outliers(held, k, n, listed)


def _outliers(df: DataFrame, k: float, n: int, listed: int) -> Outliers:
    facts = _facts(df, families(df))
    share = f"{int(MOSTLY_BLANK * 100)}%"
    blank = MostlyBlank(None, facts.mostly_blank,
                        f"{facts.mostly_blank:,} rows have no value in {share} or more of their columns")
    return Outliers(facts.rows, k, n, _extremes(df, facts, k), _rare(df, facts, n, listed),
                    _missing(facts), blank, _duplicates(df, facts))


def _extremes(df: DataFrame, facts: _Facts, k: float) -> list[Extremes]:
    numbers = {c: f for c, f in facts.columns.items()
               if f["family"] == NUMBER and f["n"] and float(f["min"]) < float(f["max"])}
    fences = {}
    for c, (q1, q3) in quantiles(df, numbers, (0.25, 0.75)).items():
        low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        # min and max already tell whether anything lies outside.
        if q3 > q1 and (float(numbers[c]["min"]) < low or float(numbers[c]["max"]) > high):
            fences[c] = (q1, q3, low, high)
    if not fences:
        return []
    counts: dict = {}
    for batch in batches(fences.items()):
        counts.update(df.agg(*[agg for c, (_, _, low, high) in batch for agg in (
            F.count_if(below_fence(col(c), low)).alias(f"b:{c}"),
            F.count_if(above_fence(col(c), high)).alias(f"a:{c}"))]).first().asDict())
    spans = {c: (seconds(numbers[c]["min"]), seconds(numbers[c]["max"])) for c in fences}
    bins = histogram_counts(df, spans)
    out = []
    for c, (q1, q3, low, high) in fences.items():
        below, above = counts[f"b:{c}"], counts[f"a:{c}"]
        shape = _Shape(spans[c], numbers[c]["min"], numbers[c]["max"], numbers[c]["n"])
        out.append(Extremes(
            c, below + above,
            f"{c}: {below + above:,} values lie outside {short(low)} to {short(high)}, "
            f"{k:g} times the middle half beyond its ends",
            below, above, q1, q3, k, low, high, build_histogram(shape, bins.get(c, {}))))
    return out


@dataclass
class _Shape:
    span: tuple[float, float]
    min: object
    max: object
    non_null: int


def _rare(df: DataFrame, facts: _Facts, n: int, listed: int) -> list[Rare]:
    maybe = [c for c, f in facts.columns.items() if f["family"] == TEXT and f["n"]
             and f["distinct"] <= RARE_MAX_DISTINCT * (1 + SKETCH_SLACK)]
    if not maybe:
        return []
    # At most about RARE_MAX_DISTINCT values per column reach the windows, and
    # no more than that the driver.
    per_column = Window.partitionBy("column")
    seldom = (value_counts(df, maybe)
              .withColumn("distinct", F.count(F.lit(1)).over(per_column))
              .filter((F.col("n") <= F.lit(n)) & (F.col("distinct") <= RARE_MAX_DISTINCT)))
    found: dict[str, Rare] = {}
    for row in seldom.orderBy("column", "n", "value").collect():
        c, distinct = row["column"], row["distinct"]
        if distinct == 1 or distinct >= KEY_UNIQUE_RATIO * facts.columns[c]["n"]:
            continue
        f = found.setdefault(c, Rare(c, 0, ""))
        if len(f.values) < listed:
            f.values.append(Counted(row["value"], row["n"]))
        f.every.append(row["value"])
        f.count += row["n"]
        f.total_values += 1
    for f in found.values():
        more = f"; the {len(f.values)} rarest are listed" if f.total_values > len(f.values) else ""
        f.summary = f"{f.column}: {f.total_values:,} values occur {n} times or fewer{more}"
    return [found[c] for c in facts.columns if c in found]


def _missing(facts: _Facts) -> list[Missing]:
    out = []
    for c, f in facts.columns.items():
        blank = facts.rows - f["n"]
        if blank:
            out.append(Missing(c, blank, f"{c}: {blank:,} values are blank", pct(blank, facts.rows)))
    return sorted(out, key=lambda m: -m.count)


def _duplicates(df: DataFrame, facts: _Facts) -> list[Duplicates]:
    gate = KEY_UNIQUE_RATIO * (1 - SKETCH_SLACK)
    close = [c for c, f in facts.columns.items()
             if f["family"] in (TEXT, NUMBER) and f["n"] and f["distinct"] >= gate * f["n"]]
    out = []
    for batch in batches(close):
        for c, row in _repeats(df, batch).items():
            if row["distinct"] < KEY_UNIQUE_RATIO * facts.columns[c]["n"] or not row["values"]:
                continue
            key = next(v for k, v in row["worst"].asDict().items() if k != "n" and v is not None)
            worst = Counted(_value_of(df, c, key), -row["worst"]["n"])
            out.append(Duplicates(
                c, row["rows"],
                f"{c}: {row['values']:,} values repeat, over {row['rows']:,} rows; "
                f"{worst.value} occurs {worst.count:,} times", row["values"], worst))
    return out


def _repeats(df: DataFrame, columns: list[str]) -> dict:
    """Distinct and repeated values of several columns, counted in one shuffle.

    A row of it is (column, value), the value in the field of its own type, so
    values keep their order and equality whatever the other columns hold.
    """
    types = {c: df.schema[c].dataType for c in columns}
    kinds = list(dict.fromkeys(t.simpleString() for t in types.values()))
    slots = [f"k{i}" for i in range(len(kinds))]
    entries = [F.struct(F.lit(i).alias("i"), *(
        (group_key(c, types[c]) if types[c].simpleString() == kind else F.lit(None)).cast(kind).alias(slot)
        for slot, kind in zip(slots, kinds))) for i, c in enumerate(columns)]
    counted = (df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
               .filter(combine(operator.or_, [F.col(k).isNotNull() for k in slots]))
               .groupBy("i", *slots).agg(F.count(F.lit(1)).alias("n")))
    again = F.col("n") > 1
    found = counted.groupBy("i").agg(
        F.count(F.lit(1)).alias("distinct"), F.count_if(again).alias("values"), F.sum(F.when(again, F.col("n"))).alias("rows"),
        F.min(F.when(again, F.struct((-F.col("n")).alias("n"), *slots))).alias("worst"))
    return {columns[r["i"]]: r for r in found.orderBy("i").collect()}


def _value_of(df: DataFrame, column: str, key):
    """The value a group key stands for; looked up only for a digest."""
    if not (isinstance(key, str) and key.startswith("sha256:")):
        return key
    match = df.filter(group_key(column, df.schema[column].dataType) == F.lit(key))
    return match.select(col(column)).first()[0]
