"""Making result values safe to hand out as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col


def plain_value(c: Column, dtype: T.DataType) -> Column:
    """One value in the form a result page carries.

    Integers, booleans and text stay as they are; a decimal leaves as its exact
    text; NaN and the infinities leave as null; bytes as lower-case hex; dates
    and times as ISO text; nested values as JSON with the same rules inside.
    """
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        wild = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        return F.when(~wild, c)
    if isinstance(dtype, T.DecimalType):
        return c.cast("string")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        text = F.when(micros.endswith(".000000"), whole).otherwise(micros)
        return F.concat(text, F.date_format(c, "xxx")) if isinstance(dtype, T.TimestampType) else text
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(_inner(c, dtype), {"ignoreNullFields": "false"})
    if isinstance(dtype, (T.StringType, T.BooleanType, T.IntegralType)):
        return c
    return c.cast("string")


def _inner(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _inner(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        keyed = F.transform_keys(c, lambda k, _: k.cast("string"))
        return F.transform_values(keyed, lambda _, v: _inner(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        parts = [_inner(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    return plain_value(c, dtype)


def plain_rows(df: DataFrame) -> DataFrame:
    """Every column of ``df`` in its plain form, names and order kept."""
    return df.select([plain_value(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
