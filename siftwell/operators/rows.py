"""Rows as they are: project, filter, sort, page and preview."""

from __future__ import annotations

import functools
import operator
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.columns import TEXT, col, combine, family, field, nulls_last, orderable
from ..functions.predicates import where
from ..session import written

MAX_PAGE = 5_000
# A page ending past this many rows is found by rank: keeping that many rows
# per task just to drop most of them would not scale.
DEEP_PAGE = 100_000
# Values a rank search cuts a column at, rows it draws them from, and how much
# of a text it looks at: first, then where that tells too little apart.
CUTS, DRAWN, TEXT_CUT, LONGEST_CUT = 63, 4_096, 32, 4_096


def project(df: DataFrame, columns=None) -> DataFrame:
    """The named columns, in the order given; all of them when none are."""
    if not columns:
        return df
    return df.select([col(field(df.schema, c).name) for c in columns])


def filter_rows(df: DataFrame, filters: dict | None) -> DataFrame:
    condition = where(filters, df.schema)
    return df if condition is None else df.filter(condition)


def sort_rows(df: DataFrame, sort: str | None, desc: bool = False, columns=None) -> DataFrame:
    """``columns`` of ``df`` ordered by one column, blanks last both ways.

    The kept columns, then the row's place in the plan, break ties. That makes
    the order the same from run to run, and lets the range partitioner cut a
    value held by a third of all rows into many tasks.
    """
    kept = [field(df.schema, c).name for c in (columns or df.columns)]
    if not sort:
        return df.select([col(c) for c in kept])
    lead = field(df.schema, sort)
    if not orderable(lead.dataType):
        raise SpecError(f"cannot sort by {sort!r}: {lead.dataType.simpleString()} has no order")
    place = "__place"
    wide = df.select([col(c) for c in dict.fromkeys(kept + [sort])])
    ties = [c for c in kept if c != sort and orderable(df.schema[c].dataType)]
    return (wide.withColumn(place, F.monotonically_increasing_id())
            .orderBy(nulls_last(col(sort), desc), *[nulls_last(col(c)) for c in ties], col(place))
            .select([col(c) for c in kept]))


def slice_rows(df: DataFrame, columns=None, filters: dict | None = None,
               sort: str | None = None, desc: bool = False) -> DataFrame:
    """Filter, then sort, then project; the sort column need not be kept."""
    return sort_rows(filter_rows(df, filters), sort, desc, columns)


def natural_key(c: Column) -> Column:
    """Text in the order people expect: case aside, and a2 before a10."""
    padded = F.regexp_replace(F.lower(c), r"(\d+)", "0" * 20 + "$1")
    return F.regexp_replace(padded, r"\d*(\d{20})(?!\d)", "$1")


def sort_shown(shown: DataFrame, column: str, desc: bool = False) -> DataFrame:
    """The rows of a page in another order: numbers by value, text naturally,
    blanks last both ways."""
    found = field(shown.schema, column)
    key = natural_key(col(column)) if family(found.dataType) == TEXT else col(column)
    return shown.orderBy(nulls_last(key, desc), nulls_last(col(column), desc))


class Page(NamedTuple):
    rows: DataFrame
    total: int
    pages: int
    number: int
    size: int


def page(df: DataFrame, number: int = 1, size: int = 500,
         sort: str | None = None, desc: bool = False) -> Page:
    """One page of ``df`` with the exact total.

    Unsorted pages are ordered by the columns themselves, so that two pages
    never share a row and together miss none.
    """
    if number < 1:
        raise SpecError("pages are numbered from 1")
    if not 1 <= size <= MAX_PAGE:
        raise SpecError(f"a page holds 1 to {MAX_PAGE} rows")
    total = df.count()
    lead = sort or next((f.name for f in df.schema.fields if orderable(f.dataType)), None)
    ordered = sort_rows(df, lead, desc)
    first = (number - 1) * size
    if first + size <= DEEP_PAGE:
        rows = ordered.offset(first).limit(size)
    elif first >= total:
        rows = ordered.limit(0)
    else:
        rows = _by_rank(df, lead, desc, first, min(size, total - first), total)
    return Page(rows, total, max(1, -(-total // size)), number, size)


def _by_rank(df: DataFrame, lead: str, desc: bool, first: int, size: int, total: int) -> DataFrame:
    """Rows [first, first+size) of a sorted frame, sorting only near them.

    The sort columns are searched one after another for the values between
    which the page lies; counts say exactly how many rows come before. What is
    left has at most ``DEEP_PAGE`` rows, or the page starts so early in it, that
    a plain top rows' sort does the rest. Nothing is written and no row moves
    that is not near the page.
    """
    ties = [c for c in df.columns if c != lead and orderable(df.schema[c].dataType)]
    found = _pieces(df, [(lead, desc), *((c, False) for c in ties)], 0, first, size, total, TEXT_CUT)
    return sort_rows(functools.reduce(DataFrame.unionByName, found), lead, desc)


def _pieces(df: DataFrame, keys, level: int, first: int, size: int, rows: int, width: int) -> list[DataFrame]:
    """The page as frames, one for each stretch of the sort order it touches.

    ``df`` holds ``rows`` rows that are equal in the first ``level`` keys.
    """
    ordered = sort_rows(df, *keys[0])
    if rows <= DEEP_PAGE or first + size <= DEEP_PAGE:
        return [ordered.offset(first).limit(size)]
    if level == len(keys) and len(keys) == len(df.columns):
        return [df.limit(size)]    # the same row over and over
    if level == len(keys) or isinstance(df.schema[keys[level][0]].dataType, (T.StructType, T.ArrayType)):
        return [_by_position(ordered, first, size)]
    name, desc = keys[level]
    out = []
    for held, skipped, wanted, n, alone in _stretches(df, name, desc, first, size, rows, width):
        part = df.filter(held)
        if n == rows and not alone and width >= LONGEST_CUT:
            out.append(_by_position(ordered, first, size))
        elif alone:
            out += _pieces(part, keys, level + 1, skipped, wanted, n, TEXT_CUT)
        else:
            out += _pieces(part, keys, level, skipped, wanted, n, width if n < rows else width * 8)
    return out


def _stretches(df: DataFrame, name: str, desc: bool, first: int, size: int, rows: int, width: int) -> list[tuple]:
    """(condition, rows to skip, rows to take, rows, one value only) of each
    stretch of a column's order that the page touches, in order.

    A drawn few values cut the column; each is a stretch of its own, and so is
    what lies between two of them, so a value held by a third of all rows is
    set apart at once. The draw only chooses the cuts: counts are exact.
    """
    dtype, c = df.schema[name].dataType, col(name)
    shown = F.substring(c, 1, width) if isinstance(dtype, (T.StringType, T.BinaryType)) else c
    drawn = (df.filter(c.isNotNull() & (F.rand(rows) < min(1.0, DRAWN / rows))).select(shown.alias("v"))
             .orderBy("v").collect())
    cuts = list(dict.fromkeys(bytes(v) if isinstance(v, bytearray) else v for v, in drawn[::max(1, len(drawn) // CUTS)]))
    cuts = [F.lit(v).cast(dtype) for v in cuts]
    if cuts:
        place = combine(operator.add, [(c >= v).cast("int") + (c > v).cast("int") for v in cuts])
    else:
        place = F.when(c.isNotNull(), F.lit(0))
    counted = df.groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(c).eqNullSafe(F.max(c)).alias("alone"))

    def held(at):
        if at is None:
            return c.isNull()
        if at % 2:
            return c == cuts[at // 2]
        sides = ([c > cuts[at // 2 - 1]] if at else []) + ([c < cuts[at // 2]] if at // 2 < len(cuts) else [])
        return combine(operator.and_, [c.isNotNull(), *sides])

    out, start = [], 0
    for r in sorted(counted.collect(), key=lambda r: (r["at"] is None, (-1 if desc else 1) * (r["at"] or 0))):
        lo, hi = max(first, start), min(first + size, start + r["n"])
        if lo < hi:
            before = out[-1] if out else None
            if before and before[3] + r["n"] <= DEEP_PAGE:    # small neighbours are sorted together
                out[-1] = (before[0] | held(r["at"]), before[1], before[2] + hi - lo, before[3] + r["n"], False)
            else:
                out.append((held(r["at"]), lo - start, hi - lo, r["n"], r["alone"]))
        start += r["n"]
    return out


def _by_position(ordered: DataFrame, first: int, size: int) -> DataFrame:
    """Rows [first, first+size) of a sorted frame, through its partition sizes.

    The sorted rows are written once, because sorting again may cut the ranges
    elsewhere. Only partition sizes reach the driver.
    """
    part, index = "__part", "__index"
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(ordered.withColumn(part, F.spark_partition_id()).withColumn(index, in_part))
    start, wanted = 0, F.lit(False)
    for row in placed.groupBy(part).count().orderBy(part).collect():
        lo, hi = max(first, start) - start, min(first + size, start + row["count"]) - start
        if lo < hi:
            wanted = wanted | ((col(part) == row[part]) & col(index).between(lo, hi - 1))
        start += row["count"]
    return placed.filter(wanted).orderBy(part, index).drop(part, index)


def _checked_size(size: int) -> int:
    if not 1 <= size <= MAX_PAGE:
        raise SpecError(f"a preview shows 1 to {MAX_PAGE} rows")
    return size


def preview_head(spark: SparkSession, path: str, size: int = 500) -> DataFrame:
    """The first rows of a Parquet relation, in stored order.

    Opens only as many files, in name order, as it takes to fill the preview.
    """
    _checked_size(size)
    whole = spark.read.parquet(path)
    files = sorted(whole.inputFiles())
    take = 1
    while True:
        part = _reading(whole, path, files[:take])
        if take >= len(files) or part.count() >= size:
            break
        take *= 4
    return (part.orderBy(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
            .limit(size).select([col(c) for c in whole.columns]))


def preview_sample(spark: SparkSession, path: str, size: int = 500, seed: int = 1) -> DataFrame:
    """Exactly ``size`` rows (or all, if fewer), the same ones for a seed.

    Rows are picked by a hash of their stored position. The first pass reads
    positions only, no column data; the second opens just the files holding a
    picked row. At most ``MAX_PAGE`` positions pass between the two.
    """
    _checked_size(size)
    whole = spark.read.parquet(path)
    total = whole.count()    # from the footers
    if not total:
        return whole.limit(0)
    file, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    drawn = (whole.select(file.alias("file"), index.alias("index"))
             .withColumn("draw", F.xxhash64("file", "index", F.lit(seed))))
    # Draws are even over all longs, so the smallest ones lie below a bound that
    # about twice as many rows fall under; no split sends up more than its share.
    bound = int(min(1.0, (2 * size + 100) / total) * (1 << 64)) - (1 << 63) - 1
    picked = drawn.filter(F.col("draw") <= F.lit(bound)).orderBy("draw", "file", "index").limit(size).collect()
    if len(picked) < min(size, total):
        picked = drawn.orderBy("draw", "file", "index").limit(size).collect()
    chosen = spark.createDataFrame([tuple(r) for r in picked], "__file string, __index long, __draw long")
    part = _reading(whole, path, sorted({r["file"] for r in picked}))
    return (part.withColumns({"__f": file, "__i": index})
            .join(F.broadcast(chosen), (F.col("__f") == F.col("__file")) & (F.col("__i") == F.col("__index")))
            .orderBy("__draw", "__file", "__index").select([col(c) for c in whole.columns]))


def _reading(whole: DataFrame, path: str, files: list[str]) -> DataFrame:
    if not files:
        return whole
    reader = whole.sparkSession.read.schema(whole.schema)
    if len(files) > 1 or unquote(files[0]).rstrip("/").split(":")[-1].lstrip("/") != path.strip("/"):
        reader = reader.option("basePath", path)
    return reader.parquet(*[unquote(f) for f in files])


def keyed_sample(df: DataFrame, key: str, size: int = 500, seed: int = 1) -> DataFrame:
    """A repeatable sample of rows that have a unique key, by md5 of key and seed."""
    _checked_size(size)
    name = field(df.schema, key).name
    draw = F.md5(F.concat(col(name).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(draw, nulls_last(col(name))).limit(size)
