"""CSV in and out of Parquet without losing zeros, blanks or bad rows."""

from __future__ import annotations

import csv as csv_text
from dataclasses import dataclass
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.columns import col
from ..session import discard, scratch_path
from . import csv_records as records
from .csv_types import TEXT_KIND, Kind, infer_kinds, typed

# Rows a detection looks at, and name parts that suggest an ID.
DETECT_ROWS = 20_480
ID_HINTS = ("number", "id", "code", "account", "ref", "sku", "isbn", "zip", "postal", "phone")
BLANK_MARKER = "\\N"

REJECT_SCHEMA = ("file string, line long, column_name string, error_type string, csv_line string, "
                 "error_message string")


def column_names(header: str, delim: str) -> list[str]:
    """Names from a header record; blank ones get a number, repeats a suffix."""
    # A delimiter of several characters is beyond the small reader used here.
    mark = "\x1f" if len(delim) > 1 else delim
    cells = next(csv_text.reader([header.removeprefix("\ufeff").replace(delim, mark)], delimiter=mark), [])
    names: list[str] = []
    seen: dict[str, int] = {}
    for i, cell in enumerate(cells):
        name = cell.strip() or f"column{i}"
        while name.lower() in seen:
            seen[name.lower()] += 1
            name = f"{name}_{seen[name.lower()]}"
        seen[name.lower()] = 0
        names.append(name)
    return names


def _cells(text: Column, width: int, delim: str) -> Column:
    """A record parsed by Spark's own CSV parser, every field as text."""
    schema = ", ".join([f"c{i} string" for i in range(width)] + ["broken string"])
    return F.from_csv(text, F.lit(schema), {
        "sep": delim, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "broken", "maxCharsPerColumn": "-1",
        "maxColumns": str(max(width + 1, 20_480))})


def _blank_to_null(value: Column, marker: str) -> Column:
    return F.when((value != "") & (value != marker), value)


@dataclass(frozen=True)
class Detected:
    columns: dict[str, Kind]
    suggested_text: list[str]


def looks_like_id(name: str, kind: Kind) -> bool:
    return kind != TEXT_KIND and any(hint in name.lower() for hint in ID_HINTS)


def detect_types(spark: SparkSession, path: str, delim: str = ",", marker: str = BLANK_MARKER,
                 rows: int = DETECT_ROWS) -> Detected:
    """Column names and types from the first ``rows`` rows, without loading the file.

    A preview: the load reads every value and may decide otherwise. Records
    that do not parse are left out. Of several files the first by name is read,
    and of that only the splits it takes to see so many rows.
    """
    header = _first_line(spark, path)
    names = column_names(header, delim)
    cells = _cells(F.col("text"), len(names), delim)
    first = min(spark.read.text(path).inputFiles())
    seen = [(r[0],) for r in spark.read.text(unquote(first)).head(rows + 1)]
    sample = (spark.createDataFrame(seen, "text string").filter(F.col("text") != header)
              .select(cells.alias("cells")).filter(F.col("cells.broken").isNull())
              .select([_blank_to_null(F.col(f"cells.c{i}"), marker).alias(n) for i, n in enumerate(names)]))
    kinds = infer_kinds(sample, names)
    return Detected(kinds, [n for n in names if looks_like_id(n, kinds[n])])


def _first_line(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0).head(1)
    if not found:
        raise SpecError(f"{path} is empty")
    return found[0][0]


class CsvLoad:
    """One CSV file, folder or pattern, split into records once.

    The records are written to the shared folder together with their place in
    the file, so that types, rows, rejects and line numbers all come from the
    same reading. ``close`` removes that copy.
    """

    def __init__(self, spark: SparkSession, path: str, delim: str = ",", marker: str = BLANK_MARKER,
                 force_text=(), max_record_chars: int = records.MAX_RECORD_CHARS):
        self.spark, self.path, self.delim, self.marker = spark, path, delim, marker
        self.limit = max_record_chars
        self._scratch: list[str] = []
        header = _first_line(spark, path)
        self.staged = self._stage(records.lines(spark, path).withColumn("number", F.lit(None).cast("long")),
                                  header, numbered=False)
        if not self.staged.filter("opens").isEmpty():
            header = self._stage_multiline()
        self._check_headers(header)
        unknown = [c for c in force_text if c not in self.names]
        if unknown:
            raise SpecError(f"unknown column: {unknown[0]!r}")
        good = self._good_text()
        self.kinds = infer_kinds(good, self.names, force_text)
        self.rows = good.select([typed(col(n), self.kinds[n]).alias(n) for n in self.names])

    def _write(self, df: DataFrame, label: str) -> DataFrame:
        target = scratch_path(self.spark, label)
        self._scratch.append(target)
        df.write.option("compression", "zstd").parquet(target)
        return self.spark.read.parquet(target)

    def _stage(self, found: DataFrame, header: str, numbered: bool) -> DataFrame:
        self.names = column_names(header, self.delim)
        width = len(self.names)
        if not numbered:
            found = found.withColumns({"oversize": F.length("text") > self.limit, "part": F.lit(1), "parts": F.lit(1)})
        is_head = ((F.col("number") == 1) if numbered else
                   (F.col("block") == 0) & (F.col("text") == F.lit(header)))
        # A file with one column may hold empty lines that mean a blank value.
        empty = F.lit(False) if width == 1 else F.length("text") == 0
        parsed = (found.withColumn("head", is_head).withColumn("empty", F.coalesce(empty, F.lit(False)))
                  .withColumn("opens", F.coalesce(records.ends_open(F.col("text"), self.delim), F.lit(False)))
                  .withColumn("cells", _cells(F.col("text"), width, self.delim)))
        bad = F.col("oversize") | F.col("opens") | (
            ~F.col("empty") & F.col("cells.broken").isNotNull() & (F.length("text") > 0))
        place = [c for c in ("file", "block", "pos", "number") if c in found.columns]
        keep_text = bad | F.col("head")
        return self._write(parsed.select(
            *place, "head", "empty", "opens", "oversize", "part", "parts", bad.alias("bad"),
            F.when(keep_text, F.col("text")).alias("text"),
            *[_blank_to_null(F.col(f"cells.c{i}"), self.marker).alias(f"c{i}") for i in range(width)]),
            "csv-records")

    def _stage_multiline(self) -> str:
        """Quoted line breaks: put physical lines together into records first."""
        raw = self._write(records.lines(self.spark, self.path), "csv-lines")
        found = self._write(records.assemble(raw, self.delim, self.limit), "csv-assembled")
        header = found.filter("number = 1").orderBy("file").first()["text"]
        self.staged = self._stage(found, header, numbered=True)
        return header

    def _check_headers(self, header: str) -> None:
        """Every file must begin with the same header, and only that line is one."""
        staged = self.staged
        if "pos" not in staged.columns:
            other = staged.filter(F.col("head") & ~F.col("text").eqNullSafe(F.lit(header)))
            if not other.isEmpty():
                raise SpecError("the files do not all have the same header")
            return
        first = staged.groupBy("file").agg(
            F.min(F.when(F.col("block") == 0, F.col("pos"))).alias("first"),
            F.min(F.when(F.col("head"), F.col("pos"))).alias("head_at"), F.count_if("head").alias("heads"))
        seen = first.agg(F.bool_and(F.col("first").eqNullSafe(F.col("head_at"))).alias("same"),
                         F.max("heads").alias("heads")).first()
        if not seen["same"]:
            raise SpecError("the files do not all have the same header")
        if seen["heads"] > 1:    # a row that repeats the header is a row
            self.staged = (staged.join(first.select("file", "head_at"), "file")
                           .withColumn("head", F.col("head") & (F.col("pos") == F.col("head_at"))).drop("head_at"))

    def _good_text(self) -> DataFrame:
        rows = self.staged.filter(~F.col("head") & ~F.col("empty") & ~F.col("bad"))
        return rows.select([F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)])

    def rejects(self) -> DataFrame:
        """One row per error: a field too many or too few, or one that does not
        read as its column's type, in the records that did not parse."""
        bad = self.staged.filter(F.col("bad") & ~F.col("head"))
        if "pos" in self.staged.columns:
            bad = records.with_line_numbers(bad, records.block_offsets(self.staged))
        else:
            bad = bad.withColumn("line", F.col("number"))
        width = len(self.names)
        found = F.size("fields")
        named = F.array(*[F.lit(n) for n in self.names])

        def error(column: Column, kind: str, message: Column) -> Column:
            return F.struct(column.alias("column_name"), F.lit(kind).alias("error_type"),
                            message.alias("error_message"))

        none = F.lit(None).cast("string")
        nothing = F.array().cast("array<struct<column_name:string,error_type:string,error_message:string>>")
        used = sorted({k for k in self.kinds.values() if k != TEXT_KIND}, key=str)
        kind_at = F.array(*[F.lit(used.index(self.kinds[n]) if self.kinds[n] != TEXT_KIND else -1)
                            for n in self.names])
        type_names = F.array(*[F.lit(k.type) for k in used]).cast("array<string>")

        def cast_error(cell: Column, i: Column) -> Column:
            value, kind_no = _blank_to_null(records.unquote(cell), self.marker), F.get(kind_at, i)
            read = F.lit(True)
            for j, kind in enumerate(used):
                read = F.when(kind_no == j, typed(value, kind).isNotNull()).otherwise(read)
            return F.when(value.isNotNull() & (kind_no >= 0) & ~read, error(
                F.get(named, i), "CAST", F.concat(F.lit("not a "), F.get(type_names, kind_no), F.lit(" value: "), value)))

        cast_errors = F.filter(F.transform("fields", cast_error), lambda e: e.isNotNull()) if used else nothing
        missing = F.when(found < width, F.transform(F.sequence(found + 1, F.lit(width)), lambda j: error(
            F.element_at(named, j), "MISSING COLUMNS",
            F.concat(F.lit(f"expected {width} columns, found "), (j - 1).cast("string"))))).otherwise(nothing)
        extra = F.when(found > width, F.transform(F.sequence(F.lit(width + 1), found), lambda j: error(
            none, "TOO MANY COLUMNS",
            F.concat(F.lit(f"expected {width} columns, found "), j.cast("string"))))).otherwise(nothing)
        oversize = F.array(error(none, "LINE SIZE OVER MAXIMUM", F.concat(
            F.lit(f"longer than {self.limit} characters; an unclosed quote? part "), F.col("part").cast("string"),
            F.lit(" of "), F.col("parts").cast("string"))))
        unclosed = F.array(error(none, "UNQUOTED VALUE", F.lit("a quoted field is not closed as expected")))
        errors = F.concat(cast_errors, missing, extra)
        errors = (F.when(F.col("oversize"), oversize).when(F.size(errors) == 0, unclosed).otherwise(errors))
        return (bad.withColumn("fields", F.coalesce(records.raw_fields(F.col("text"), self.delim),
                                                    F.array().cast("array<string>")))
                .select("file", "line", F.col("text").alias("csv_line"), F.explode(errors).alias("e"))
                .select("file", "line", "e.column_name", "e.error_type", "csv_line", "e.error_message"))

    def close(self) -> None:
        for target in self._scratch:
            discard(self.spark, target)
        self._scratch = []


@dataclass(frozen=True)
class Loaded:
    path: str
    rejects_path: str
    rows: int
    rejected: int
    rejected_lines: int
    kinds: dict[str, Kind]


def load_csv(spark: SparkSession, path: str, target: str, rejects_target: str, delim: str = ",",
             marker: str = BLANK_MARKER, force_text=(), max_record_chars: int = records.MAX_RECORD_CHARS) -> Loaded:
    """Convert CSV to zstd Parquet at ``target``, a path not yet in use.

    A record of more than ``max_record_chars`` characters, on one line or on
    several, is refused; its text is in the rejects, in parts of about that
    length if it has several lines.
    """
    load = CsvLoad(spark, path, delim, marker, force_text, max_record_chars)
    try:
        load.rows.write.option("compression", "zstd").parquet(target)
        load.rejects().write.option("compression", "zstd").parquet(rejects_target)
    finally:
        load.close()
    rejects = spark.read.schema(REJECT_SCHEMA).parquet(rejects_target)
    seen = rejects.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file", "line").alias("lines")).first()
    return Loaded(target, rejects_target, spark.read.parquet(target).count(), seen["n"], seen["lines"], load.kinds)


class Rejects(NamedTuple):
    rows: DataFrame
    total: int
    truncated: bool


def list_rejects(rejects: DataFrame, limit: int = 1_000) -> Rejects:
    """The refused records of a source in file order, and how many there are."""
    if not 1 <= limit <= 10_000:
        raise SpecError("between 1 and 10,000 rejects can be listed")
    total = rejects.count()
    rows = rejects.orderBy("file", "line", "column_name", "error_message").limit(limit)
    return Rejects(rows, total, total > limit)


def read_files(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Files by path, without registering them: parquet, csv, json or text."""
    name = path.lower().removesuffix(".gz").removesuffix(".zst").rstrip("/")
    guess = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "ndjson": "json", "jsonl": "json"}
    kind = format or guess.get(name.rsplit(".", 1)[-1], "parquet")
    if kind not in ("parquet", "csv", "json", "text"):
        raise SpecError(f"unknown format: {kind!r}")
    if kind == "csv":
        options = {"header": True, "escape": '"', "sep": "\t" if name.endswith(".tsv") else ",", **options}
    return spark.read.format(kind).options(**options).load(path)
