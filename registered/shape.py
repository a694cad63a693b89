"""Slices, pages, previews, pivots, frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions.values import plain_rows
from siftwell.operators.groups import distinct_values, frequencies, pick_values, pivot
from siftwell.operators.rows import (keyed_sample, page, preview_head, preview_sample, project, slice_rows,
                                      sort_shown)

from .base import cond, group, register, rounded, table

# ------------------------------------------------------------------ slices


@register("slice_in", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND l_quantity > 45""")
def slice_in(spark, sf):
    tree = group("AND", cond("l_returnflag", "IN", ["A", "R"]), cond("l_quantity", ">", 45))
    return slice_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], tree,
                      "l_quantity", desc=True)


@register("slice_and_or_not", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' OR o_totalprice >= 400000) AND NOT (o_orderpriority = '1-URGENT' AND o_totalprice < 200000)""")
def slice_and_or_not(spark, sf):
    tree = group("AND",
                 group("OR", cond("o_orderstatus", "=", "F"), cond("o_totalprice", ">=", "400000")),
                 group("AND", cond("o_orderpriority", "=", "1-URGENT"), cond("o_totalprice", "<", 200000), negate=True),
                 cond("o_custkey", "=", ""), group("OR"))
    return slice_rows(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"], tree, "o_orderkey")


@register("slice_between", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'
  AND NOT (o_totalprice BETWEEN 100000 AND 300000)""")
def slice_between(spark, sf):
    tree = group("AND", cond("o_orderdate", "BETWEEN", ["1997-01-01", "1997-12-31"]),
                 cond("o_totalprice", "NOT BETWEEN", [100000, 300000]), cond("o_custkey", "BETWEEN", ["", 5]))
    return slice_rows(table(spark, sf, "orders"), ["o_orderkey", "o_orderdate"], tree, "o_orderdate")


@register("slice_like", """
SELECT p_partkey, p_name, p_brand FROM part
WHERE p_name ILIKE '%RED%' AND p_brand ILIKE 'brand#1%' AND p_type LIKE '%A%'
  AND p_name NOT ILIKE '%bolt%' AND p_name ILIKE 'r_d%'""")
def slice_like(spark, sf):
    tree = group("AND", cond("p_name", "CONTAINS", "RED"), cond("p_brand", "STARTS WITH", "brand#1"),
                 cond("p_type", "LIKE", "A"), cond("p_name", "NOT ILIKE", "bolt"), cond("p_name", "ILIKE", "r_d%"))
    return slice_rows(table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand"], tree)


@register("slice_nulls", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders
WHERE CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END IS NULL
   OR CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END NOT IN ('1-URGENT', '2-HIGH')""")
def slice_nulls(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", priority())
    tree = group("OR", cond("priority", "IS NULL"), cond("priority", "NOT IN", ["1-URGENT", "2-HIGH"]))
    return slice_rows(df, None, tree, "priority", desc=True)


def priority():
    return F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority")


@register("project_columns", "SELECT c_name, c_custkey FROM customer")
def project_columns(spark, sf):
    return project(table(spark, sf, "customer"), ["c_name", "c_custkey"])


@register("page_2_of_sorted", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 500 OFFSET 500""")
def page_2_of_sorted(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return page(df, 2, 500, "o_totalprice", desc=True).rows


@register("page_deep", """
SELECT e.event_id, n.v FROM events e, (SELECT unnest([1,2,3,4,5,6,7,8,9,10,11,12]) AS v) n
ORDER BY e.event_id, n.v LIMIT 5000 OFFSET 110000""")
def page_deep(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.explode(F.array(*[F.lit(i) for i in range(1, 13)])).alias("v"))
    return page(df, 23, 5000, "event_id").rows


@register("page_deep_of_a_hot_value", """
SELECT l_returnflag, l_orderkey, l_linenumber, v FROM lineitem, (SELECT unnest([1,2,3,4,5,6,7,8]) AS v)
ORDER BY l_returnflag DESC, l_orderkey, l_linenumber, v LIMIT 5000 OFFSET 110000""")
def page_deep_of_a_hot_value(spark, sf):
    """Three values share the sort column; the page lies within one of them or across two."""
    v = F.explode(F.array(*[F.lit(i) for i in range(1, 9)])).alias("v")
    return page(table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", v), 23, 5000,
                "l_returnflag", desc=True).rows


@register("shown_rows_sorted", """
SELECT label, row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) - 1 AS place
FROM (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'a' ELSE 'B' END || o_orderkey || '/x' AS label FROM orders WHERE o_orderkey < 500)""")
def shown_rows_sorted(spark, sf):
    """A shown page in natural order: a2 before a10 before B1."""
    k = F.col("o_orderkey")
    label = F.concat(F.when(k % 2 == 0, "a").otherwise("B"), k.cast("string"), F.lit("/x"))
    shown = page(table(spark, sf, "orders"), 1, 500, "o_orderkey").rows.select(label.alias("label"))
    return sort_shown(shown, "label").limit(500).withColumn("place", F.monotonically_increasing_id())


@register("preview_sample_checked", """
SELECT least(500, count(*)) AS rows, least(500, count(*)) AS different, true AS all_stored, true AS again, count(*) <= 500 AS same_as_next
FROM orders""")
def preview_sample_checked(spark, sf):
    """A sample has its size, no row twice, only stored rows, and its seed's rows each time."""
    path, stored = f"{sf}/orders.parquet", table(spark, sf, "orders")
    one, two, other = (preview_sample(spark, path, 500, seed) for seed in (4, 4, 5))
    keys = [sorted(r["o_orderkey"] for r in s.select("o_orderkey").collect()) for s in (one, two, other)]
    known = one.join(stored, one["o_orderkey"] == stored["o_orderkey"], "left_semi").count()
    return spark.createDataFrame([(len(keys[0]), len(set(keys[0])), known == len(keys[0]), keys[0] == keys[1], keys[0] == keys[2])],
                                 "rows long, different long, all_stored boolean, again boolean, same_as_next boolean")


@register("page_totals", """
SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 500.0)) AS BIGINT) AS pages FROM orders""")
def page_totals(spark, sf):
    found = page(table(spark, sf, "orders"), 1, 500)
    return spark.createDataFrame([(found.total, found.pages)], "total long, pages long")


@register("row_count", "SELECT count(*) AS rows FROM lineitem WHERE l_quantity > 10")
def row_count(spark, sf):
    kept = slice_rows(table(spark, sf, "lineitem"), None, cond("l_quantity", ">", 10))
    return kept.agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- previews


@register("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 500")
def preview_first(spark, sf):
    return preview_head(spark, f"{sf}/orders.parquet", 500)


@register("preview_sample")
def preview_seeded(spark, sf):
    return preview_sample(spark, f"{sf}/lineitem.parquet", 500, seed=7)


@register("preview_sample_keyed", """
SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey LIMIT 500""")
def preview_keyed(spark, sf):
    return keyed_sample(table(spark, sf, "orders"), "o_orderkey", 500, seed=7)


# ------------------------------------------------------------------ pivots

FLAT = {
    "sum": ("round(sum(l_extendedprice), 2)", 2), "count": ("count(l_extendedprice)", None),
    "avg": ("round(avg(l_extendedprice), 6)", 6), "min": ("min(l_extendedprice)", None),
    "max": ("max(l_extendedprice)", None), "median": ("round(median(l_extendedprice), 6)", 6),
    "count_distinct": ("count(DISTINCT l_extendedprice)", None), "stddev": ("round(stddev(l_extendedprice), 6)", 6),
}


def _flat(agg, digits):
    def make(spark, sf):
        out = pivot(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", agg)
        return rounded(out, digits, f"{agg}_l_extendedprice") if digits else out
    return make


for _agg, (_sql, _digits) in FLAT.items():
    register(f"pivot_flat_{_agg}", f"""
SELECT l_returnflag, l_linestatus, {_sql} AS {_agg}_l_extendedprice
FROM lineitem GROUP BY l_returnflag, l_linestatus""")(_flat(_agg, _digits))


@register("pivot_sum_integers", """
SELECT l_returnflag, CAST(sum(l_partkey) AS BIGINT) AS sum_l_partkey FROM lineitem
WHERE l_quantity <= 30 GROUP BY l_returnflag""")
def pivot_sum_integers(spark, sf):
    out = pivot(table(spark, sf, "lineitem"), ["l_returnflag"], "l_partkey", "sum",
                filters=cond("l_quantity", "<=", 30))
    return out.withColumn("sum_l_partkey", F.col("sum_l_partkey").cast("long"))


@register("pivot_median_by_order", """
SELECT l_orderkey, median(l_extendedprice) AS median_l_extendedprice FROM lineitem GROUP BY l_orderkey""")
def pivot_median_by_order(spark, sf):
    return pivot(table(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", "median")


def _wide_values(spark, sf):
    """Order keys and cents in one number: far beyond 2^53, where a double has lost the last digits."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_orderkey") * 10_000_000_000 + cents + (1 << 60)).alias("big"),
        ((F.col("l_orderkey").cast("decimal(20,0)") * 10_000_000_000 + cents).cast("decimal(30,0)") * F.lit("0.01").cast("decimal(3,2)"))
        .cast("decimal(30,2)").alias("exact"))


_WIDE_MIDDLE = """WITH v AS (SELECT l_returnflag, CAST(l_orderkey AS HUGEINT) * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM v),
m AS (SELECT l_returnflag, min(v) AS low, max(v) AS high FROM r WHERE i IN ((n - 1) // 2, n // 2) GROUP BY l_returnflag)"""


@register("pivot_median_decimal", _WIDE_MIDDLE + """
SELECT l_returnflag, CAST((low + high) // 200 AS VARCHAR) || '.' || lpad(CAST((low + high) % 200 * 5 AS VARCHAR), 3, '0') AS median_exact FROM m""")
def pivot_median_decimal(spark, sf):
    """Every digit of the median of decimals, as text."""
    found = pivot(_wide_values(spark, sf), ["l_returnflag"], "exact", "median")
    return found.select("l_returnflag", F.col("median_exact").cast("string").alias("median_exact"))


@register("pivot_median_bigint", _WIDE_MIDDLE + """
SELECT l_returnflag, CAST((low + high) // 2 + 1152921504606846976 AS DOUBLE) AS median_big FROM m""")
def pivot_median_bigint(spark, sf):
    return pivot(_wide_values(spark, sf), ["l_returnflag"], "big", "median")


@register("pivot_median_dates", """
SELECT l_returnflag, median(l_shipdate) AS median_l_shipdate FROM lineitem GROUP BY l_returnflag""")
def pivot_median_dates(spark, sf):
    return pivot(table(spark, sf, "lineitem"), ["l_returnflag"], "l_shipdate", "median")


@register("pivot_median_text", """
SELECT c_nationkey, c_name AS median_c_name FROM (
  SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS place,
         count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
WHERE place = (n - 1) // 2 + 1""")
def pivot_median_text(spark, sf):
    return pivot(table(spark, sf, "customer"), ["c_nationkey"], "c_name", "median")


_STATUSES = ("F", "O", "P")


@register("pivot_wide_sum", "SELECT o_orderpriority, " + ", ".join(
    f"round(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 2) AS \"{s}\"" for s in _STATUSES)
    + " FROM orders GROUP BY o_orderpriority")
def pivot_wide_sum(spark, sf):
    out = pivot(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "sum", "o_orderstatus")
    return rounded(out, 2, *_STATUSES)


@register("pivot_wide_count", "SELECT o_custkey, " + ", ".join(
    f"count(CASE WHEN o_orderstatus = '{s}' THEN o_orderkey END) AS \"{s}\"" for s in _STATUSES)
    + " FROM orders GROUP BY o_custkey")
def pivot_wide_count(spark, sf):
    return pivot(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", "count", "o_orderstatus")


@register("pivot_wide_gaps", "SELECT c_nationkey, " + ", ".join(
    f"min(CASE WHEN segment = '{s}' THEN c_acctbal END) AS \"{s}\"" for s in ("BUILDING", "MACHINERY"))
    + """ FROM (SELECT c_nationkey, c_acctbal,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3 THEN c_mktsegment END AS segment
      FROM customer) GROUP BY c_nationkey""")
def pivot_wide_gaps(spark, sf):
    """A null column value gives no column, but its group keeps its row."""
    segment = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_nationkey") != 3),
                     F.col("c_mktsegment"))
    df = table(spark, sf, "customer").withColumn("segment", segment)
    return pivot(df, ["c_nationkey"], "c_acctbal", "min", "segment")


@register("pivot_wide_median", "SELECT l_linestatus, " + ", ".join(
    f"median(CASE WHEN l_returnflag = '{s}' THEN l_quantity END) AS \"{s}\"" for s in ("A", "N", "R"))
    + " FROM lineitem GROUP BY l_linestatus")
def pivot_wide_median(spark, sf):
    return pivot(table(spark, sf, "lineitem"), ["l_linestatus"], "l_quantity", "median", "l_returnflag")


# ------------------------------------------------- frequencies and values


@register("frequencies", """
SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS value, count(*) AS rows FROM orders GROUP BY 1""")
def frequencies_with_null(spark, sf):
    return frequencies(table(spark, sf, "orders").select("o_orderkey", priority()), "priority")


@register("distinct_values_search", """
SELECT p_name AS value, count(*) AS rows FROM part WHERE p_name ILIKE '%red%'
GROUP BY 1 ORDER BY rows DESC, value LIMIT 20""")
def distinct_values_search(spark, sf):
    return distinct_values(table(spark, sf, "part"), "p_name", "RED", 20)


@register("distinct_values_total", """
SELECT count(DISTINCT p_name) AS distinct_total, count(DISTINCT p_name) > 10 AS truncated FROM part""")
def distinct_values_total(spark, sf):
    found = pick_values(table(spark, sf, "part"), "p_name", limit=10)
    return spark.createDataFrame([(found.distinct_total, found.truncated)], "distinct_total long, truncated boolean")


@register("plain_values", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS price,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, lower(hex(o_orderstatus)) AS bytes,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS wild
FROM orders""")
def plain_values(spark, sf):
    wild = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderdate",
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").cast("binary").alias("bytes"),
        wild.alias("wild"))
    return plain_rows(df)
