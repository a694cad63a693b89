"""Writing results out: CSV and Parquet, after a look at their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Finding, Review, SpecError
from ..functions.columns import col
from ..functions.values import plain_value

# One spreadsheet's rows, and when an export is worth a warning
# or a confirmation.
SPREADSHEET_ROWS = 1_048_576
WARN_ROWS = 5_000_000
BLOCK_ROWS = 100_000_000
FORMATS = ("csv", "parquet", "xlsx")


def review_export(rows: int, format: str) -> Review:
    """Judge an export by its exact row count."""
    if format not in FORMATS:
        raise SpecError(f"unknown format: {format!r}")
    if format == "xlsx" and rows > SPREADSHEET_ROWS:
        raise SpecError(f"a spreadsheet holds {SPREADSHEET_ROWS:,} rows and this has {rows:,}; "
                        "export CSV or Parquet, or filter first")
    if rows >= BLOCK_ROWS:
        return Review((Finding("export_too_large", "block", f"{rows:,} rows is a very large export",
                               "All of them will be written.",
                               ("export only the part that is needed", "save it as a table instead")),), rows)
    if rows >= WARN_ROWS:
        types = " CSV keeps no types, so a reader may drop leading zeros." if format == "csv" else ""
        tips = () if format == "parquet" else ("Parquet is smaller and keeps the types",)
        return Review((Finding("export_large", "warn", f"{rows:,} rows is a large export",
                               f"All of them will be written.{types}",
                               tips + ("filter first if not every row is needed",)),), rows)
    return Review((), rows)


def export_parquet(df: DataFrame, path: str, confirm: bool = False) -> Review:
    review = review_export(df.count(), "parquet").enforce(confirm)
    df.write.option("compression", "zstd").parquet(path)
    return review


def export_csv(df: DataFrame, path: str, confirm: bool = False, single_file: bool = False) -> Review:
    """Every row, with a header; text is written as it is, zeros included.

    ``single_file`` puts all rows through one task, so it is for small results.
    """
    review = review_export(df.count(), "csv").enforce(confirm)
    if single_file and review.estimated_rows > WARN_ROWS:
        raise SpecError(f"{review.estimated_rows:,} rows do not go into a single file")
    nested = (T.ArrayType, T.StructType, T.MapType, T.BinaryType)
    flat = df.select([(plain_value(col(f.name), f.dataType) if isinstance(f.dataType, nested)
                       else col(f.name)).alias(f.name) for f in df.schema.fields])
    (flat.coalesce(1) if single_file else flat).write.options(
        header=True, escape='"', emptyValue='""', timestampFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]", dateFormat="yyyy-MM-dd",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return review


def export_lines(lines: DataFrame, header: str, path: str) -> None:
    """Ready-made text lines, with the header line on top of every file."""
    line = F.col(lines.columns[0]).alias(header)
    # A one-column CSV whose separator and quote never occur writes the
    # column's name, then the lines, untouched.
    lines.select(line).write.options(header=True, sep="\u0001", quote="\u0000", escape="\u0000", emptyValue="",
                                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
