"""What the operators share: words, bound expressions, packed rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"[\x20\x09-\x0D]+"
ROW = "__row"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_list(text: Column) -> Column:
    """The words of a text, parted by ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def words_of(text: bytes | None) -> list[bytes]:
    """As ``word_list``, in a task: bytes split at the same six characters."""
    return text.split() if text else []


def packed(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row (or its columns ``carry``) as one struct beside its text in bytes: no column name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in carry or docs.columns]).alias(ROW),
                       docs[f"`{text}`"].cast("binary").alias("__text"))


def unpacked(df: DataFrame, columns, *more: Column) -> DataFrame:
    return df.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in columns], *more)


def with_results(packed_df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([packed_df.schema[ROW], *fields])


def texts_in(batch: pa.RecordBatch, name: str = "__text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """What tells rows apart: the id, and the text's hash as ids may repeat or be null."""
    return [docs[f"`{doc_id}`"].alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("text_key")]
