"""Column lookup, type families and the value expressions operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError

TEXT, NUMBER, TEMPORAL, BOOLEAN = "text", "number", "temporal", "boolean"

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
UNORDERED = (T.MapType, T.VariantType)


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(schema: T.StructType, name) -> T.StructField:
    if not isinstance(name, str) or name not in schema.names:
        raise SpecError(f"unknown column: {name!r}")
    return schema[name]


def family(dtype: T.DataType) -> str:
    """Types that compare with each other without changing a value.

    Anything outside the four families only matches its own exact type.
    """
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    return dtype.simpleString()


def families(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, family(f.dataType)) for f in df.schema.fields]


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, UNORDERED):
        return False
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    return True


def as_number(name: str, dtype: T.DataType) -> Column:
    """The column as a double; dates and times as seconds since 1970."""
    if isinstance(dtype, T.DateType):
        return F.unix_date(col(name)) * F.lit(86400.0)
    if family(dtype) == TEMPORAL:
        return as_micros(name, dtype) / F.lit(1e6)
    return col(name).cast("double")


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def as_micros(name: str, dtype: T.DataType) -> Column:
    """A date or time as whole microseconds since 1970.

    A time without a zone counts on its own clock: the session zone and its
    summer-time changes play no part.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(name))
    return F.timestamp_diff("MICROSECOND", _epoch(), col(name).cast("timestamp_ntz"))


def from_micros(micros: Column, dtype: T.DataType) -> Column:
    """The way back: a zoned time for a zoned column, else a time without zone."""
    whole = micros.cast("long")
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(whole)
    return F.timestamp_add("MICROSECOND", whole, _epoch())


def nulls_last(c: Column, desc: bool = False) -> Column:
    return c.desc_nulls_last() if desc else c.asc_nulls_last()


# Values up to this many bytes group as they are; longer ones by digest, so
# that finding repeats among whole documents shuffles 71 bytes each.
KEY_BYTES = 64


def group_key(name: str, dtype: T.DataType) -> Column:
    """What to group a column by so that equal values meet.

    A digest key is longer than any plain key, so the two never collide.
    """
    c = col(name)
    if family(dtype) != TEXT:
        return c
    digest = F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))
    return F.when(F.octet_length(c) <= KEY_BYTES, c).when(c.isNotNull(), digest)


def combine(op, parts: list[Column]) -> Column:
    """Many columns joined by one operator, halved rather than chained: a wide
    table must not make a deep expression."""
    if len(parts) == 1:
        return parts[0]
    half = len(parts) // 2
    return op(combine(op, parts[:half]), combine(op, parts[half:]))


# Columns one job works on. A columnar file gives up each column once either
# way, so a wide table costs more jobs but no more reading.
COLUMN_BATCH = 48


def batches(items) -> list[list]:
    items = list(items)
    return [items[i:i + COLUMN_BATCH] for i in range(0, len(items), COLUMN_BATCH)]
