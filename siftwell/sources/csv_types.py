"""Which type a column of text has, decided from every value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import batches, col

# How numbers, truth values, dates and times are written.
# A whole number with a leading zero is an ID, not a number.
WHOLE = r"^(0|[1-9][0-9]*|-[0-9]+)$"
REAL = r"^(-?((0|[1-9][0-9]*)(\.[0-9]*)?|-0[0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-0[0-9]+\.[0-9]*|[nN][aA][nN])$"
TRUTH = ("true", "false", "t", "f", "yes", "no")
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
CLOCK = r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?"
ZONE = r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)"
OTHER_DATE = r"([0-9]{1,4})([-/.])([0-9]{1,2})\2([0-9]{1,4})"
ORDERS = ("ymd", "dmy", "mdy")
SEPARATORS = ("-", "/", ".")

# One bit per type a value can be read as; a column has the types all of its
# values share.
BITS = {"boolean": 1, "bigint": 2, "decimal(38,0)": 4, "double": 8, "date": 16,
        "timestamp_ntz": 32, "timestamp": 64, "shaped date": 128, "shaped time": 256}


@dataclass(frozen=True)
class Kind:
    """A column's type, and for dates not written year-first, how to read them."""

    type: str
    order: str | None = None


TEXT_KIND = Kind("string")


def _bits(*names: str) -> Column:
    return F.lit(sum(BITS[n] for n in names))


def _moment_pattern(date: str, zone: str = "") -> str:
    return f"^{date}[ T]{CLOCK}{zone}$"


def readable_as(value: Column) -> Column:
    """The bits of the types one value can be read as; null for a null."""
    v = F.trim(value)
    iso = ISO_DATE.strip("^$")
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(v.rlike(WHOLE),
              F.when(v.try_cast("bigint").isNotNull(), _bits("bigint", "decimal(38,0)", "double"))
              .when(F.length(v) <= 38, _bits("decimal(38,0)", "double")).otherwise(_bits("double")))
        .when(v.rlike(REAL), _bits("double"))
        .when(F.lower(v).isin(*TRUTH), _bits("boolean"))
        .when(~v.rlike("^[0-9]"), F.lit(0))
        .when(v.rlike(ISO_DATE), F.when(v.try_cast("date").isNotNull(), _bits("date")).otherwise(F.lit(0)))
        .when(v.rlike(_moment_pattern(iso)),
              F.when(v.try_cast("timestamp_ntz").isNotNull(), _bits("timestamp_ntz")).otherwise(F.lit(0)))
        .when(v.rlike(_moment_pattern(iso, ZONE)),
              F.when(_zoned(v).isNotNull(), _bits("timestamp")).otherwise(F.lit(0)))
        .when(v.rlike(f"^{OTHER_DATE}$"), _bits("shaped date"))
        .when(v.rlike(_moment_pattern(OTHER_DATE)), _bits("shaped time"))
        .otherwise(F.lit(0)))


def _zoned(v: Column) -> Column:
    # Spark wants an offset as +hh:mm.
    full = F.regexp_replace(v, "([+-][0-9]{2})$", "$1:00")
    return F.regexp_replace(full, "([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp")


def _reordered(v: Column, order: str) -> Column:
    """A date written in some order, rewritten year first; its time kept."""
    parts = [F.regexp_extract(v, f"^{OTHER_DATE}", g) for g in (1, 3, 4)]
    by = dict(zip(order, parts))
    short_year = by["y"].try_cast("int") + F.when(by["y"].try_cast("int") < 69, 2000).otherwise(1900)
    year = F.when(F.length(by["y"]) == 4, by["y"]).when(F.length(by["y"]) == 2, short_year.cast("string"))
    tail = F.regexp_extract(v, rf"[ T]({CLOCK})$", 1)
    day = F.concat_ws("-", year, by["m"], by["d"])
    return F.when(year.isNotNull(), F.when(tail == "", day).otherwise(F.concat_ws(" ", day, tail)))


def typed(value: Column, kind: Kind) -> Column:
    """The value as its column's type; null where it cannot be read so."""
    if kind.type == "string":
        return value
    v = F.trim(value)
    if kind.type == "timestamp":
        return _zoned(v)
    if kind.order:
        v = _reordered(v, kind.order)
    if kind.type in ("bigint", "decimal(38,0)"):
        v = F.when(v.rlike(WHOLE), v)
    return v.try_cast(kind.type)


def infer_kinds(df: DataFrame, columns: list[str], force_text=()) -> dict[str, Kind]:
    """The type of each text column, from all of its values.

    One aggregate over all columns, laid out as (column, value) so that it is
    the same small expression however wide the file; a second one only for
    columns of dates that are not written year-month-day with dashes.
    """
    asked = [c for c in columns if c not in set(force_text)]
    if not asked:
        return {c: TEXT_KIND for c in columns}
    values = df.select(F.posexplode(F.array(*[col(c) for c in asked])).alias("at", "value"))
    shares = values.groupBy("at").agg(F.bit_and(readable_as(F.col("value"))).alias("bits"))
    found = {asked[r["at"]]: r["bits"] or 0 for r in shares.collect()}
    kinds = {c: TEXT_KIND for c in columns}
    shaped = {}
    for c in asked:
        shared = [name for name, bit in BITS.items() if found.get(c, 0) & bit]
        if shared and shared[0].startswith("shaped"):
            shaped[c] = "date" if shared[0] == "shaped date" else "timestamp_ntz"
        elif shared:
            kinds[c] = Kind(shared[0])
    for batch in batches(shaped.items()):
        kinds.update(_shaped_kinds(df, dict(batch)))
    return kinds


def _shaped_kinds(df: DataFrame, shaped: dict[str, str]) -> dict[str, Kind]:
    """Dates in other orders: the first order that reads every value."""
    aggs = []
    for i, (c, type_) in enumerate(shaped.items()):
        separator = F.regexp_extract(F.trim(col(c)), f"^{OTHER_DATE}", 2)
        aggs += [F.min(separator).alias(f"lo{i}"), F.max(separator).alias(f"hi{i}")]
        aggs += [F.bool_and(typed(col(c), Kind(type_, o)).isNotNull() | col(c).isNull()).alias(f"{o}{i}")
                 for o in ORDERS]
    row = df.agg(*aggs).first()
    out = {}
    for i, (c, type_) in enumerate(shaped.items()):
        fits = [o for o in ORDERS if row[f"{o}{i}"]]
        if fits and row[f"lo{i}"] == row[f"hi{i}"]:
            out[c] = Kind(type_, fits[0])
    return out
