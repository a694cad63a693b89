"""CSV text as records: splitting, line numbers and quoted line breaks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A record longer than this is refused, however it is written: an unclosed
# quote would otherwise swallow the rest of its file. Its text goes to the rejects.
MAX_RECORD_CHARS = 1 << 24
# A quoted field up to, not including, its closing quote. Possessive, so that
# long fields need no backtracking stack.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def _unquoted(delim: str) -> str:
    """One character that is not the start of a delimiter."""
    if len(delim) == 1:
        return f"[^{re.escape(delim)}]"
    return f"(?:(?!{re.escape(delim)})[\\s\\S])"


def field_pattern(delim: str) -> str:
    """A delimiter and the field after it, quoted or not."""
    plain = _unquoted(delim)
    return f'{re.escape(delim)}({QUOTED}"{plain}*|{plain}*)'


def raw_fields(text: Column, delim: str) -> Column:
    """The fields of a record as written, quotes included."""
    return F.regexp_extract_all(F.concat(F.lit(delim), text), F.lit(field_pattern(delim)), F.lit(1))


def unquote(field: Column) -> Column:
    inner = F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when((F.length(field) >= 2) & field.startswith('"') & field.endswith('"'), inner).otherwise(field)


def ends_open(text: Column, delim: str) -> Column:
    """Whether a line that starts outside quotes ends inside them."""
    plain, mark = _unquoted(delim), re.escape(delim)
    not_quote = f'(?!"){plain}'
    whole = f'(?:{QUOTED}"{plain}*|{not_quote}{plain}*|)'
    pattern = f'^(?:{whole}{mark})*+{QUOTED}$'
    return F.when(F.contains(text, F.lit('"')), text.rlike(pattern)).otherwise(F.lit(False))


def stays_open(text: Column, delim: str) -> Column:
    """Whether a line that starts inside quotes ends inside them."""
    closing = r'^[^"]*+(?:""[^"]*+)*+"'
    rest = F.concat(F.lit('""'), F.regexp_replace(text, closing, ""))
    return F.when(text.rlike(closing), ends_open(rest, delim)).otherwise(F.lit(True))


def lines(spark: SparkSession, path) -> DataFrame:
    r"""Every physical line, its own terminator, and the block of the file it starts in.

    Files are split at ``\n`` alone; what ends in ``\r\n`` or holds a lone ``\r``
    is parted here, so that a record can be put together again as it was
    written. ``pos`` grows with the line's place inside its block. It has
    meaning only within one evaluation, so it is compared only after it has
    been written.
    """
    value = F.concat(F.col("value"), F.lit("\n"))
    parted = F.arrays_zip(*[F.regexp_extract_all(value, F.lit(r"([^\r\n]*+)(\r\n|\r|\n)"), F.lit(i)).alias(n)
                            for i, n in ((1, "text"), (2, "end"))])
    whole = F.array(F.struct(F.col("value").alias("text"), F.lit("\n").alias("end")))
    read = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.explode(F.when(F.contains("value", F.lit("\r")), parted).otherwise(whole)).alias("l"))
    return read.select("file", "block", F.monotonically_increasing_id().alias("pos"), "l.text", "l.end")


def block_offsets(staged: DataFrame) -> DataFrame:
    """How many lines of its file precede each block; one row per block."""
    sizes = staged.groupBy("file", "block").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def with_line_numbers(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows of a staged table with ``line``, counted from 1 in each file."""
    return (rows.join(offsets, ["file", "block"])
            .withColumn("line", F.col("before") + F.col("pos") - F.col("first") + 1).drop("before", "first"))


def _carried(state_window) -> tuple[Column, Column]:
    """What the lines so far do to the quote state: the last fixed outcome (null
    when there is none) and how many times it was flipped since."""
    fixed = F.when(F.col("opens") == F.col("stays"), F.col("opens"))
    flips = F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(state_window)
    flips = F.coalesce(flips, F.lit(0))
    last_fixed = F.last(fixed, ignorenulls=True).over(state_window)
    at_fixed = F.last(F.when(fixed.isNotNull(), F.col("flips_here")), ignorenulls=True).over(state_window)
    return last_fixed, flips - F.coalesce(at_fixed, F.lit(0))


def _state(last_fixed: Column, flips: Column, start: Column) -> Column:
    return F.coalesce(last_fixed, start) != (flips % 2 == 1)


def _put_together(rows: DataFrame, *key: str) -> DataFrame:
    """The lines of each record in order, with the terminators between them and none at the end."""
    parts = F.array_sort(F.collect_list(F.struct("block", "pos", "text", "end")))
    return rows.groupBy("file", "number", *key).agg(parts.alias("parts")).select("file", "number", *key, F.concat(
        F.array_join(F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.concat(p["text"], p["end"])), ""),
        F.element_at("parts", -1)["text"]).alias("text"), F.element_at("parts", -1)["end"].alias("end"))


def _too_long(rows: DataFrame, limit: int) -> DataFrame:
    """Records over the limit as several texts, each about as long as the limit: nothing is lost or held at once."""
    inside = Window.partitionBy("file", "number").orderBy("block", "pos")
    so_far = F.sum(F.length("text") + F.length("end")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    made = _put_together(rows.withColumn("piece", F.floor((so_far - 1) / limit)), "piece")
    pieces = Window.partitionBy("file", "number")
    part = F.row_number().over(pieces.orderBy("piece"))
    return made.select("file", "number", part.alias("part"), F.count(F.lit(1)).over(pieces).cast("int").alias("parts"), "text", "end").select(
        "file", "number", F.when(F.col("part") < F.col("parts"), F.concat("text", "end")).otherwise(F.col("text")).alias("text"),
        F.lit(True).alias("oversize"), "part", "parts")


def assemble(staged: DataFrame, delim: str, limit: int = MAX_RECORD_CHARS) -> DataFrame:
    """Records of files with quoted line breaks: (file, number, text, oversize, part, parts).

    Whether a line begins inside a quoted field depends on all lines before
    it. Each line either fixes that state, flips it or leaves it, so a block's
    effect is worked out on its own, the few blocks of a file are chained, and
    the result handed back to its lines by (file, block). Only records of
    several lines are regrouped, with the terminators that stood between their
    lines, and none longer than ``limit`` is put together: it comes in parts.
    """
    flagged = (staged.withColumn("opens", ends_open(F.col("text"), delim))
               .withColumn("stays", stays_open(F.col("text"), delim)))
    block = Window.partitionBy("file", "block").orderBy("pos")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = block.rowsBetween(Window.unboundedPreceding, -1)
    flagged = flagged.withColumn("flips_here", F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(upto))
    fixed, flips = _carried(prior)
    flagged = flagged.withColumn("fixed", fixed).withColumn("flips", flips)

    # What a whole block does, chained over the blocks of each file.
    open_if_out = F.when(F.coalesce(F.col("fixed"), F.lit(False)) != (F.col("flips") % 2 == 1),
                         F.col("stays")).otherwise(F.col("opens"))
    open_if_in = F.when(F.coalesce(F.col("fixed"), F.lit(True)) != (F.col("flips") % 2 == 1),
                        F.col("stays")).otherwise(F.col("opens"))
    blocks = flagged.groupBy("file", "block").agg(
        F.max_by(open_if_out, "pos").alias("opens"), F.max_by(open_if_in, "pos").alias("stays"))
    files = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("flips_here", F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(
        files.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fixed, flips = _carried(files.rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", _state(fixed, flips, F.lit(False)).alias("block_inside"))

    placed = (flagged.join(starts, ["file", "block"])
              .withColumn("inside", _state(F.col("fixed"), F.col("flips"), F.col("block_inside")))
              .withColumn("goes_on", F.when(F.col("inside"), F.col("stays")).otherwise(F.col("opens")))
              .withColumn("nth", F.sum((~F.col("inside")).cast("long")).over(upto)))

    # One row a block: the records before it, and what its file's last record is. A quote that is still open at
    # the end of its file quotes nothing: the lines of that record stand for themselves.
    sizes = placed.groupBy("file", "block").agg(
        F.max("nth").alias("n"), F.max_by("goes_on", "pos").alias("open_end"), F.min("pos").alias("first"),
        F.count(F.lit(1)).alias("lines"), F.max(F.when(~F.col("inside"), F.col("pos"))).alias("last_start"))
    earlier, whole_file = files.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    facts = sizes.select("file", "block", "first", "last_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                         F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"), F.sum("n").over(whole_file).alias("last"),
                         F.max_by("open_end", "block").over(whole_file).alias("cut_short"))
    starts_at = F.max(F.when(F.col("last_start").isNotNull(), F.col("lines_before") + F.col("last_start") - F.col("first"))).over(whole_file)
    facts = facts.withColumn("opened_at", starts_at)
    numbered = (placed.join(facts.drop("last_start"), ["file", "block"])
                .withColumn("number", F.col("before") + F.col("nth"))
                .withColumn("loose", F.col("cut_short") & (F.col("number") == F.col("last")))
                .withColumn("row", F.col("lines_before") + F.col("pos") - F.col("first") - F.col("opened_at"))
                .select("file", "block", "pos", "text", "end", "inside", "goes_on", "number", "loose", "row"))

    once = [F.lit(1).alias("part"), F.lit(1).alias("parts")]
    alone = F.col("loose") | (~F.col("inside") & ~F.col("goes_on"))
    at = F.when(F.col("loose"), F.col("number") + F.col("row")).otherwise(F.col("number"))
    single = numbered.filter(alone).select("file", at.alias("number"), "text", (F.length("text") > limit).alias("oversize"), *once)
    several = numbered.filter(~alone).select("file", "number", "block", "pos", "text", "end")
    sized = several.groupBy("file", "number").agg((F.sum(F.length("text") + F.length("end")) - F.length(F.max_by("end", F.struct("block", "pos")))).alias("chars"))
    small = _put_together(several.join(sized.filter(F.col("chars") <= limit), ["file", "number"]).drop("chars"))
    small = small.select("file", "number", "text", F.lit(False).alias("oversize"), *once)
    large = _too_long(several.join(sized.filter(F.col("chars") > limit), ["file", "number"]).drop("chars"), limit)
    return single.unionByName(small).unionByName(large.select("file", "number", "text", "oversize", "part", "parts"))
