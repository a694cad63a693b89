"""Profiles and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators.outliers import (check_rows, duplicate_rows, extreme_rows, mostly_blank_rows, outliers,
                                         rare_rows)
from siftwell.operators.profile import profile, summarize
from siftwell.operators.quantiles import quantiles, sketch_brackets

from .base import register, rounded, table

NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax")
TEXTS = ("l_returnflag", "l_linestatus")

# ----------------------------------------------------------------- profile


def _column_sql(name: str, family: str, source: str = "lineitem") -> str:
    def number(expr):
        return f"CAST({expr} AS DOUBLE)" if family == "number" else "CAST(NULL AS DOUBLE)"

    def moment(expr):
        return expr if family == "temporal" else "CAST(NULL AS TIMESTAMP)"

    return f"""
SELECT '{name}' AS name, '{family}' AS family, count(*) AS rows, count({name}) AS non_null,
  round(100.0 * (count(*) - count({name})) / count(*), 2) AS null_pct, count(DISTINCT {name}) AS distinct_values,
  {number(f'min({name})')} AS min, {number(f'max({name})')} AS max,
  {moment(f'min({name})')} AS earliest, {moment(f'max({name})')} AS latest,
  {number(f'round(avg({name}), 9)')} AS mean, {number(f'round(quantile_cont({name}, 0.25), 6)')} AS q1,
  {number(f'round(quantile_cont({name}, 0.5), 6)')} AS median, {number(f'round(quantile_cont({name}, 0.75), 6)')} AS q3
FROM {source}"""


_COLUMNS = [(n, "number") for n in NUMBERS] + [(n, "text") for n in TEXTS] + [("l_shipdate", "temporal")]


@register("profile_columns", " UNION ALL ".join(_column_sql(n, f) for n, f in _COLUMNS))
def profile_columns(spark, sf):
    return _profiled(spark, table(spark, sf, "lineitem"))


@register("profile_columns_of_five_copies", "SELECT * EXCLUDE (mean) FROM (" + " UNION ALL ".join(
    _column_sql(n, f, "(SELECT l.* FROM lineitem l, range(5))") for n, f in _COLUMNS) + ")")
def profile_columns_of_five_copies(spark, sf):
    """A table too long for one task's values: counts and quartiles are
    still exact. Means are left to ``profile_columns``: sums of so many doubles
    differ in the last digits, and some of these lie just between two roundings."""
    copies = table(spark, sf, "lineitem").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy")
    return _profiled(spark, copies).drop("mean")


@register("profile_means_of_five_copies", " UNION ALL ".join(f"""
SELECT '{n}' AS name, CAST(sum(CAST(round({n} * 100) AS HUGEINT)) AS BIGINT) AS hundredths, true AS mean_agrees
FROM lineitem, range(5)""" for n in NUMBERS))
def profile_means_of_five_copies(spark, sf):
    """The means that ``profile_columns_of_five_copies`` leaves out, beside whole
    sums: these do not depend on the order, and a mean agrees to 12 digits."""
    copies = table(spark, sf, "lineitem").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy")
    sums = copies.agg(F.count("*").alias("rows"), *[F.sum(F.round(F.col(n) * 100).cast("long")).alias(n) for n in NUMBERS]).first()
    means = {r["name"]: r["mean"] for r in profile(copies.select(*NUMBERS)).columns_frame(spark).collect()}
    return spark.createDataFrame(
        [(n, sums[n], abs(means[n] * 100 * sums["rows"] - sums[n]) <= 1e-12 * abs(sums[n])) for n in NUMBERS],
        "name string, hundredths long, mean_agrees boolean")


def _profiled(spark, df):
    found = profile(df).columns_frame(spark)
    found = rounded(found.withColumnRenamed("distinct", "distinct_values"), 9, "mean")
    return rounded(found, 6, "q1", "median", "q3").select(
        "name", "family", "rows", "non_null", "null_pct", "distinct_values", "min", "max", "earliest", "latest",
        "mean", "q1", "median", "q3")


def _gappy(spark, sf):
    """Orders with blanks, a nearly unique text and a rare category planted."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(k % 40 == 0, F.concat(F.lit("dup"), (k % 80).cast("string")))
        .otherwise(F.concat(F.lit("order "), k.cast("string"))).alias("label"),
        F.when(k.isin(7, 11, 13), F.lit("Z")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 500 == 0, F.col("o_totalprice") * 1000).otherwise(F.col("o_totalprice")).alias("price"))


GAPPY = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 40 = 0 THEN 'dup' || (o_orderkey % 80) ELSE 'order ' || o_orderkey END AS label,
  CASE WHEN o_orderkey IN (7, 11, 13) THEN 'Z' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS price FROM orders) g"""


@register("profile_leads", f"""
SELECT 'priority' AS "column", 'missing' AS "check" FROM {GAPPY}
  HAVING 100.0 * (count(*) - count(priority)) / count(*) >= 5
UNION ALL SELECT 'label', 'duplicates' FROM {GAPPY}
  HAVING count(DISTINCT label) >= 0.95 * count(label) AND count(label) > count(DISTINCT label)
UNION ALL SELECT 'status', 'rare' FROM (SELECT status, count(*) AS n, sum(count(*)) OVER () AS rows,
    count(*) OVER () AS d FROM {GAPPY} GROUP BY status)
  HAVING count(*) FILTER (n <= 5) > 0 AND max(d) > 1 AND max(d) <= 1000 AND max(d) < 0.95 * max(rows)
UNION ALL SELECT 'price', 'extremes' FROM (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3,
    min(price) AS lo, max(price) AS hi FROM {GAPPY})
  WHERE q3 > q1 AND (hi > q3 + 3 * (q3 - q1) OR lo < q1 - 3 * (q3 - q1))""")
def profile_leads(spark, sf):
    return profile(_gappy(spark, sf)).leads_frame(spark).select("column", "check")


@register("profile_histogram", " UNION ALL ".join(f"""
SELECT '{name}' AS name, CAST(b.i AS INTEGER) AS bin, count(h.bin) AS count,
       round(min(s.lo + b.i * (s.hi - s.lo) / 24), 3) AS lo
FROM (SELECT unnest(range(24)) AS i) b
CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi FROM events) s
LEFT JOIN (SELECT least(CAST(floor(({x} - s.lo) / ((s.hi - s.lo) / 24)) AS INTEGER), 23) AS bin
  FROM events, (SELECT min({x}) AS lo, max({x}) AS hi FROM events) s) h ON h.bin = b.i
GROUP BY b.i""" for name, x in (("ts", "epoch(ts)"), ("value", "value"))))
def profile_histogram(spark, sf):
    found = profile(table(spark, sf, "events").select("ts", "value")).histogram_frame(spark)
    return rounded(found.drop("hi"), 3, "lo")


@register("profile_top", " UNION ALL ".join(f"""
SELECT * FROM (SELECT '{c}' AS name, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS place,
  {c} AS value, count(*) AS count FROM part GROUP BY {c}) WHERE place <= 5""" for c in ("p_name", "p_brand", "p_type")))
def profile_top(spark, sf):
    return profile(table(spark, sf, "part")).top_frame(spark)


_GRADES = """(SELECT CASE WHEN o_orderkey < 30 THEN 'rare ' || (o_orderkey // 3) ELSE o_orderpriority END AS grade, o_orderstatus AS status
  FROM orders)"""


@register("profile_rare", f"""
SELECT 'grade' AS name, count(*) FILTER (n <= 5) AS rare FROM (SELECT count(*) AS n FROM {_GRADES} GROUP BY grade)
UNION ALL SELECT 'status', count(*) FILTER (n <= 5) FROM (SELECT count(*) AS n FROM {_GRADES} GROUP BY status)""")
def profile_rare(spark, sf):
    """How many values of a column occur five times or fewer."""
    k = F.col("o_orderkey")
    grade = F.when(k < 30, F.concat(F.lit("rare "), F.floor(k / 3).cast("string"))).otherwise(F.col("o_orderpriority"))
    found = profile(table(spark, sf, "orders").select(grade.alias("grade"), F.col("o_orderstatus").alias("status")))
    return spark.createDataFrame([(c.name, c.rare) for c in found.columns], "name string, rare long")


@register("profile_approximate", " UNION ALL ".join(f"""
SELECT '{c}' AS name, true AS labelled, true AS distinct_near, true AS median_near FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM lineitem)"""
                                                    for c in NUMBERS))
def profile_approximate(spark, sf):
    """Sketched distinct counts and quartiles are labelled, and near what is exact: an eighth of it, a hundredth of the rows."""
    lines = table(spark, sf, "lineitem").select(*NUMBERS)
    quick, exact = profile(lines, approximate=True), {c.name: c for c in profile(lines).columns}
    below = {c.name: F.count_if(F.col(c.name) < c.median) / c.non_null for c in quick.columns}
    upto = {c.name: F.count_if(F.col(c.name) <= c.median) / c.non_null for c in quick.columns}
    share = lines.agg(*(v.alias(f"b_{n}") for n, v in below.items()), *(v.alias(f"u_{n}") for n, v in upto.items())).first()
    return spark.createDataFrame([
        (c.name, c.distinct_approx and c.quartiles_approx, abs(c.distinct - exact[c.name].distinct) * 8 <= exact[c.name].distinct,
         share[f"b_{c.name}"] <= 0.51 and share[f"u_{c.name}"] >= 0.49) for c in quick.columns],
        "name string, labelled boolean, distinct_near boolean, median_near boolean")


@register("profile_all_columns_of_documents")
def profile_documents(spark, sf):
    return profile(table(spark, sf, "documents")).columns_frame(spark)


@register("summarize_orders", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS count, {low} AS lowest, {avg} AS avg, {std} AS std, 0.0::DOUBLE AS null_percentage
FROM orders""" for c, low, avg, std in (
    ("o_orderkey", "CAST(min(o_orderkey) AS VARCHAR)", "round(avg(o_orderkey), 6)", "round(stddev(o_orderkey), 6)"),
    ("o_custkey", "CAST(min(o_custkey) AS VARCHAR)", "round(avg(o_custkey), 6)", "round(stddev(o_custkey), 6)"),
    ("o_orderstatus", "min(o_orderstatus)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    ("o_totalprice", "CAST(min(o_totalprice) AS VARCHAR)", "round(avg(o_totalprice), 6)", "round(stddev(o_totalprice), 6)"),
    ("o_orderdate", "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S')", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    ("o_orderpriority", "min(o_orderpriority)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"))))
def summarize_orders(spark, sf):
    found = summarize(table(spark, sf, "orders")).withColumnRenamed("min", "lowest")
    return rounded(found, 6, "avg", "std").select("column_name", "count", "lowest", "avg", "std", "null_percentage")


@register("summarize_lineitem")
def summarize_lineitem(spark, sf):
    return summarize(table(spark, sf, "lineitem"))


_QUANTILED = ("l_quantity", "l_extendedprice", "l_orderkey", "l_discount")


@register("exact_quantiles", " UNION ALL ".join(f"""
SELECT '{c}' AS name, round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q1, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS q2,
  round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q3 FROM lineitem""" for c in _QUANTILED))
def exact_quantiles(spark, sf):
    """The way quartiles are found on tables too large for one task."""
    df, fractions = table(spark, sf, "lineitem"), (0.25, 0.5, 0.75)
    row = df.agg(*[a for i, c in enumerate(_QUANTILED) for a in (
        F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
        sketch_brackets(F.col(c), fractions).alias(f"b{i}"))]).first()
    facts = {c: {"n": row[f"n{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"], "brackets": row[f"b{i}"]}
             for i, c in enumerate(_QUANTILED)}
    found = quantiles(df, facts, fractions, in_task=100)
    return rounded(spark.createDataFrame([(c, *q) for c, q in found.items()],
                                         "name string, q1 double, q2 double, q3 double"), 6, "q1", "q2", "q3")


# ---------------------------------------------------------------- outliers

_FENCES = """(SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, q1, q3 FROM
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})) f"""


@register("outliers_extremes", f"""
SELECT 'value' AS "column", count(*) FILTER (value < low OR value > high) AS count,
  count(*) FILTER (value < low) AS below, count(*) FILTER (value > high) AS above,
  round(min(low), 6) AS low, round(min(high), 6) AS high
FROM events, {_FENCES.format(c='value', t='events')}""")
def outliers_extremes(spark, sf):
    found = outliers(table(spark, sf, "events").select("event_type", "value")).extremes
    out = spark.createDataFrame([(f.column, f.count, f.below, f.above, f.low, f.high) for f in found],
                                "column string, count long, below long, above long, low double, high double")
    return rounded(out, 6, "low", "high")


@register("outliers_extremes_rows", f"""
SELECT doc_id, n_chars FROM documents, {_FENCES.format(c='n_chars', t='documents')}
WHERE n_chars < low OR n_chars > high""")
def outliers_extremes_rows(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars")
    found = {f.column: f for f in outliers(df).extremes}["n_chars"]
    return extreme_rows(df, "n_chars", found.low, found.high)


_RARE = """(SELECT p_partkey, CASE WHEN p_partkey IN (7, 11, 13) THEN 'Brand#X' ELSE p_brand END AS brand FROM part)"""


def _branded(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(
        F.col("p_partkey").isin(7, 11, 13), F.lit("Brand#X")).otherwise(F.col("p_brand")).alias("brand"))


@register("outliers_rare", f"""
SELECT 'brand' AS "column", brand AS value, count(*) AS count FROM {_RARE} GROUP BY brand HAVING count(*) <= 5""")
def outliers_rare(spark, sf):
    found = outliers(_branded(spark, sf)).rare
    return spark.createDataFrame([(f.column, v.value, v.count) for f in found for v in f.values],
                                 "column string, value string, count long")


@register("outliers_rare_rows", f"""
SELECT p_partkey, brand FROM {_RARE} WHERE brand IN
  (SELECT brand FROM {_RARE} GROUP BY brand HAVING count(*) <= 5)""")
def outliers_rare_rows(spark, sf):
    df = _branded(spark, sf)
    values = [v for f in outliers(df).rare for v in f.every]
    return rare_rows(df, "brand", values)


@register("outliers_rare_capped", """
SELECT least(count(*) FILTER (n <= 5), 200) AS listed, CAST(sum(n) FILTER (n <= 5) AS BIGINT) AS rows,
  count(*) FILTER (n <= 5) AS total_values
FROM (SELECT count(*) AS n FROM documents GROUP BY text)
HAVING count(*) FILTER (n <= 5) > 0 AND count(*) > 1 AND count(*) <= 1000 AND count(*) < 0.95 * sum(n)""")
def outliers_rare_capped(spark, sf):
    """Only the list has an end; every rare value is counted."""
    found = outliers(table(spark, sf, "documents").select("text")).rare
    return spark.createDataFrame([(len(f.values), f.count, f.total_values) for f in found],
                                 "listed long, rows long, total_values long")


@register("outliers_missing", f"""
SELECT 'priority' AS "column", count(*) - count(priority) AS count,
  round(100.0 * (count(*) - count(priority)) / count(*), 2) AS pct FROM {GAPPY}""")
def outliers_missing(spark, sf):
    found = outliers(_gappy(spark, sf)).missing
    return spark.createDataFrame([(f.column, f.count, f.pct) for f in found], "column string, count long, pct double")


@register("outliers_missing_rows", f"SELECT o_orderkey, label FROM {GAPPY} WHERE priority IS NULL")
def outliers_missing_rows(spark, sf):
    df = _gappy(spark, sf)
    found = {f.column: f for f in outliers(df).missing}["priority"]
    return found.rows(df).select("o_orderkey", "label")


_BLANK = """(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS a,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS b,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS c FROM orders) g"""


def _blanks(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 7 != 0, F.col("o_orderpriority")).alias("a"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("b"), F.when(k % 3 != 0, F.col("o_totalprice")).alias("c"))


_MOSTLY = "(a IS NULL)::INTEGER + (b IS NULL)::INTEGER + (c IS NULL)::INTEGER >= 2"


@register("outliers_mostly_blank", f"SELECT count(*) AS count FROM {_BLANK} WHERE {_MOSTLY}")
def outliers_mostly_blank(spark, sf):
    return spark.createDataFrame([(outliers(_blanks(spark, sf)).mostly_blank.count,)], "count long")


@register("outliers_mostly_blank_rows", f"SELECT * FROM {_BLANK} WHERE {_MOSTLY}")
def outliers_mostly_blank_rows(spark, sf):
    return mostly_blank_rows(_blanks(spark, sf))


@register("outliers_duplicates", f"""
SELECT 'label' AS "column", count(*) AS repeated_values, CAST(sum(n) AS BIGINT) AS count,
  first(label ORDER BY n DESC, label) AS worst, max(n) AS worst_count
FROM (SELECT label, count(*) AS n FROM {GAPPY} GROUP BY label HAVING count(*) > 1)""")
def outliers_duplicates(spark, sf):
    found = outliers(_gappy(spark, sf).select("label", "priority")).duplicates
    return spark.createDataFrame([(f.column, f.values, f.count, f.worst.value, f.worst.count) for f in found],
                                 "column string, repeated_values long, count long, worst string, worst_count long")


@register("outliers_duplicates_rows", """
SELECT * FROM lineitem WHERE l_extendedprice IN
  (SELECT l_extendedprice FROM lineitem GROUP BY l_extendedprice HAVING count(*) > 1)""")
def outliers_duplicates_rows(spark, sf):
    return duplicate_rows(table(spark, sf, "lineitem"), "l_extendedprice")


@register("check_duplicate_documents", """
SELECT doc_id, lang FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def check_duplicate_documents(spark, sf):
    return check_rows(table(spark, sf, "documents"), "duplicates", "text").select("doc_id", "lang")


def _findings_sql() -> str:
    parts = []
    for c in NUMBERS:
        parts.append(f"""
SELECT 'extremes' AS "check", '{c}' AS "column", count(*) FILTER ({c} < low OR {c} > high) AS count
FROM lineitem, {_FENCES.format(c=c, t='lineitem')} GROUP BY q1, q3
HAVING q3 > q1 AND count(*) FILTER ({c} < low OR {c} > high) > 0""")
    for c in TEXTS:
        parts.append(f"""
SELECT 'rare', '{c}', CAST(sum(n) AS BIGINT) FROM (SELECT n, d, rows FROM (SELECT {c}, count(*) AS n,
  count(*) OVER () AS d, sum(count(*)) OVER () AS rows FROM lineitem GROUP BY {c}) WHERE n <= 5)
HAVING max(d) > 1 AND max(d) <= 1000 AND max(d) < 0.95 * max(rows)""")
    for c in NUMBERS + TEXTS:
        parts.append(f"""
SELECT 'duplicates', '{c}', CAST(sum(n) FILTER (n > 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem
  WHERE {c} IS NOT NULL GROUP BY {c}) HAVING count(*) >= 0.95 * sum(n) AND count(*) < sum(n)""")
    for c in NUMBERS + TEXTS + ("l_shipdate",):
        parts.append(f"SELECT 'missing', '{c}', count(*) - count({c}) FROM lineitem HAVING count(*) > count({c})")
    return " UNION ALL ".join(parts)


@register("outliers_findings", _findings_sql())
def outliers_findings(spark, sf):
    return outliers(table(spark, sf, "lineitem")).frame(spark).select("check", "column", "count")
