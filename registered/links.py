"""Joins, key probes, lineage and hand-written SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.errors import Refused, SpecError
from siftwell.operators.lineage import dependents, reasons, roots, staleness
from siftwell.plans.joins import build_join, chain_rows, checked_join, plan_join, probe_frame, probe_join
from siftwell.plans.spec import rerun
from siftwell.plans.sqlmode import run_sql

from .base import cond, register, rounded, table, tables

# ------------------------------------------------------------------- joins


def _input(relation, alias, columns=(), kind=None, onto=None, on=()):
    item = {"relation": relation, "alias": alias, "columns": list(columns)}
    if kind:
        item["join"] = {"type": kind, "with": onto, "on": [list(p) for p in on]}
    return item


def _joined(spark, sf, *inputs, **options):
    names = {i["relation"] for i in inputs}
    plan = plan_join({"inputs": list(inputs)}, tables(spark, sf, *names))
    return checked_join(plan, confirm=True, **options).rows


@register("join_inner", """
SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_orderstatus, o.o_totalprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def join_inner(spark, sf):
    return _joined(spark, sf, _input("lineitem", "l", ["l_orderkey", "l_linenumber", "l_quantity"]),
                   _input("orders", "o", ["o_orderstatus", "o_totalprice"], "inner", "l",
                          [("l_orderkey", "o_orderkey")]))


@register("join_left", """
SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def join_left(spark, sf):
    return _joined(spark, sf, _input("orders", "o", ["o_orderkey"]),
                   _input("lineitem", "l", ["l_linenumber", "l_quantity"], "left", "o",
                          [("o_orderkey", "l_orderkey")]))


_GAP_ORDERS = """(SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey + 100 END AS custkey FROM orders)"""


def _gap_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 9 != 0, F.col("o_custkey") + 100).alias("custkey"))


def _gap_plan(spark, sf, kind, columns=()):
    relations = {"orders": _gap_orders(spark, sf), "customer": table(spark, sf, "customer")}
    return plan_join({"inputs": [_input("orders", "o", ["o_orderkey", "custkey"]),
                                 _input("customer", "c", columns, kind, "o", [("custkey", "c_custkey")])]}, relations)


@register("join_full", f"""
SELECT o.o_orderkey, o.custkey, c.c_custkey, c.c_name
FROM {_GAP_ORDERS} o FULL OUTER JOIN customer c ON o.custkey = c.c_custkey""")
def join_full(spark, sf):
    return checked_join(_gap_plan(spark, sf, "full", ["c_custkey", "c_name"]), confirm=True).rows


@register("join_anti", f"""
SELECT o.o_orderkey, o.custkey FROM {_GAP_ORDERS} o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.custkey)""")
def join_anti(spark, sf):
    return checked_join(_gap_plan(spark, sf, "anti")).rows


@register("join_three_way", """
SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def join_three_way(spark, sf):
    return _joined(spark, sf, _input("orders", "o", ["o_orderkey"]),
                   _input("customer", "c", ["c_name"], "inner", "o", [("o_custkey", "c_custkey")]),
                   _input("nation", "n", ["n_name"], "left", "c", [("c_nationkey", "n_nationkey")]))


@register("join_four_way", """
SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey)""")
def join_four_way(spark, sf):
    return _joined(spark, sf, _input("customer", "c", ["c_custkey"]),
                   _input("nation", "n", ["n_name"], "inner", "c", [("c_nationkey", "n_nationkey")]),
                   _input("region", "r", ["r_name"], "inner", "n", [("n_regionkey", "r_regionkey")]),
                   _input("supplier", "s", [], "anti", "c", [("c_custkey", "s_suppkey")]))


@register("join_self", """
SELECT a.o_orderkey AS a_o_orderkey, b.o_orderkey AS b_o_orderkey, b.o_totalprice FROM orders a
JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate""")
def join_self(spark, sf):
    return _joined(spark, sf, _input("orders", "a", ["o_orderkey"]),
                   _input("orders", "b", ["o_orderkey", "o_totalprice"], "inner", "a",
                          [("o_custkey", "o_custkey"), ("o_orderdate", "o_orderdate")]))


@register("join_composite", """
SELECT a.l_orderkey AS a_l_orderkey, a.l_quantity, b.l_tax FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def join_composite(spark, sf):
    rows = _joined(spark, sf, _input("lineitem", "a", ["l_orderkey", "l_quantity"]),
                   _input("lineitem", "b", ["l_tax", "l_orderkey"], "inner", "a",
                          [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]))
    return rows.drop("b_l_orderkey")


@register("join_filtered_sorted", """
SELECT l.l_orderkey, l.l_quantity, o.o_orderpriority FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderpriority = '1-URGENT' AND l.l_quantity > 40""")
def join_filtered_sorted(spark, sf):
    tree = {"kind": "group", "combiner": "AND", "children": [
        cond("o_orderpriority", "=", "1-URGENT"), cond("l_quantity", ">", 40)]}
    return _joined(spark, sf, _input("lineitem", "l", ["l_orderkey", "l_quantity"]),
                   _input("orders", "o", ["o_orderpriority"], "inner", "l", [("l_orderkey", "o_orderkey")]),
                   filters=tree, sort="l_quantity", desc=True)


def _probe_sql(left, lk, right, rk):
    """Both sides grouped by key and laid side by side; a null key meets none."""
    whole = {"left_rows": "sum(a)", "right_rows": "sum(b)",
             "left_distinct": "count(a) FILTER (k IS NOT NULL)", "right_distinct": "count(b) FILTER (k IS NOT NULL)",
             "left_nulls": "sum(a) FILTER (k IS NULL)", "right_nulls": "sum(b) FILTER (k IS NULL)",
             "left_max_dup": "max(a) FILTER (k IS NOT NULL)", "right_max_dup": "max(b) FILTER (k IS NOT NULL)",
             "matched_left": "sum(a) FILTER (b > 0)", "matched_right": "sum(b) FILTER (a > 0)",
             "max_fanout": "max(b) FILTER (a > 0)", "pairs": "sum(a * b)"}
    numbers = ", ".join(f"CAST(coalesce({sql}, 0) AS BIGINT) AS {name}" for name, sql in whole.items())
    return f"""
SELECT {numbers}
FROM (SELECT {lk} AS k, count(*) AS a FROM {left} AS l GROUP BY ALL)
FULL JOIN (SELECT {rk} AS k, count(*) AS b FROM {right} AS r GROUP BY ALL) USING (k)"""


def _probed(left, right, keys):
    return probe_frame(left, right, keys).withColumn("pairs", F.col("pairs").cast("long"))


@register("join_probe_orders_lineitem", _probe_sql("orders", "o_orderkey", "lineitem", "l_orderkey"))
def join_probe_orders_lineitem(spark, sf):
    return _probed(table(spark, sf, "orders"), table(spark, sf, "lineitem"), [("o_orderkey", "l_orderkey")])


@register("join_probe_lineitem_orders", _probe_sql("lineitem", "l_orderkey", "orders", "o_orderkey"))
def join_probe_lineitem_orders(spark, sf):
    return _probed(table(spark, sf, "lineitem"), table(spark, sf, "orders"), [("l_orderkey", "o_orderkey")])


@register("join_probe_with_nulls", _probe_sql(_GAP_ORDERS, "custkey", "customer", "c_custkey"))
def join_probe_with_nulls(spark, sf):
    return _probed(_gap_orders(spark, sf), table(spark, sf, "customer"), [("custkey", "c_custkey")])


@register("join_estimates", f"""
SELECT 'inner' AS kind, (SELECT count(*) FROM {_GAP_ORDERS} o JOIN customer c ON o.custkey = c.c_custkey) AS rows
UNION ALL SELECT 'left', (SELECT count(*) FROM {_GAP_ORDERS} o LEFT JOIN customer c ON o.custkey = c.c_custkey)
UNION ALL SELECT 'full', (SELECT count(*) FROM {_GAP_ORDERS} o FULL JOIN customer c ON o.custkey = c.c_custkey)
UNION ALL SELECT 'anti', (SELECT count(*) FROM {_GAP_ORDERS} o ANTI JOIN customer c ON o.custkey = c.c_custkey)""")
def join_estimates(spark, sf):
    """The rows the probe foretells are the rows the join gives."""
    kinds = ("inner", "left", "full", "anti")
    probe = probe_join(_gap_plan(spark, sf, "inner")).steps[0].probe
    return spark.createDataFrame([(k, probe.estimated_rows(k)) for k in kinds], "kind string, rows long")


@register("join_estimates_chain", """
SELECT 'inner' AS kind, (SELECT count(*) FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey) AS rows
UNION ALL SELECT 'left', (SELECT count(*) FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
  LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey)
UNION ALL SELECT 'same key', (SELECT count(*) FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey JOIN orders c ON c.o_custkey = a.o_custkey)""")
def join_estimates_chain(spark, sf):
    """The rows of whole chains, foretold from counts alone."""
    names = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem", "nation")}
    found = []
    for kind in ("inner", "left"):
        found.append((kind, chain_rows(plan_join({"inputs": [
            _input("customer", "c", ["c_custkey"]), _input("orders", "o", ["o_orderkey"], kind, "c", [("c_custkey", "o_custkey")]),
            _input("lineitem", "l", ["l_linenumber"], kind, "o", [("o_orderkey", "l_orderkey")]),
            _input("nation", "n", ["n_name"], "inner", "c", [("c_nationkey", "n_nationkey")])]}, names))))
    found.append(("same key", chain_rows(plan_join({"inputs": [
        _input("orders", "a", ["o_orderkey"]), _input("orders", "b", [], "inner", "a", [("o_custkey", "o_custkey")]),
        _input("orders", "c", [], "inner", "a", [("o_custkey", "o_custkey")])]}, names))))
    return spark.createDataFrame(found, "kind string, rows long")


@register("join_findings", f"""
WITH lg AS (SELECT o_orderkey AS k, 1 AS n FROM orders),
     rg AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
     m AS (SELECT lg.n AS ln, rg.n AS rn FROM lg JOIN rg ON lg.k = rg.k),
     g AS (SELECT count(*) AS n, count(custkey) AS keyed FROM {_GAP_ORDERS} o),
     gm AS (SELECT count(*) AS n FROM {_GAP_ORDERS} o JOIN customer c ON o.custkey = c.c_custkey),
     s AS (SELECT count(*) AS n FROM lineitem WHERE l_quantity > 48),
     sm AS (SELECT count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)),
     sp AS (SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48)
SELECT 'orders_lineitem' AS pair, 'fanout' AS rule, 'block' AS severity FROM m
  HAVING sum(ln * rn) > sum(ln)
UNION ALL SELECT 'gaps', 'null_keys', 'warn' FROM g WHERE n > keyed
UNION ALL SELECT 'gaps', 'low_match_rate', 'warn' FROM g, gm WHERE gm.n > 0 AND gm.n * 2 < g.n
UNION ALL SELECT 'some', 'fanout', 'block' FROM sp, sm WHERE sp.n > sm.n
UNION ALL SELECT 'some', 'low_match_rate', 'warn' FROM sm, (SELECT count(*) AS n FROM orders) t WHERE sm.n * 2 < t.n
UNION ALL SELECT 'nothing', 'no_matches', 'warn' FROM (SELECT 1) WHERE NOT EXISTS (
  SELECT 1 FROM orders JOIN lineitem ON o_orderkey = -1 - l_orderkey)""")
def join_findings(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    key = [["o_orderkey", "l_orderkey"]]

    def plan(right, columns=("l_quantity",)):
        return plan_join({"inputs": [_input("orders", "o", ["o_orderkey"]),
                                     _input("lines", "l", columns, "inner", "o", key)]},
                         {"orders": orders, "lines": right})

    pairs = {"orders_lineitem": plan(lines), "gaps": _gap_plan(spark, sf, "inner"),
             "some": plan(lines.filter("l_quantity > 48")),
             "nothing": plan(lines.select((-1 - F.col("l_orderkey")).alias("l_orderkey"), "l_quantity"))}
    found = [(name, f.rule, f.severity) for name, p in pairs.items() for f in probe_join(p).findings]
    return spark.createDataFrame(found, "pair string, rule string, severity string")


_FAMILY = """CASE WHEN column_type = 'VARCHAR' THEN 'text' WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'temporal'
  WHEN column_type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END"""


@register("join_key_families", f"""
SELECT a.column_name AS left_key, b.column_name AS right_key, a.family = b.family AS accepted
FROM (SELECT column_name, {_FAMILY} AS family FROM (DESCRIBE SELECT * FROM orders)) a,
     (SELECT column_name, {_FAMILY} AS family FROM (DESCRIBE SELECT * FROM customer)) b""")
def join_key_families(spark, sf):
    """Which columns of two tables may be a key together; the others are refused before anything is read."""
    relations = tables(spark, sf, "orders", "customer")

    def accepted(left, right):
        try:
            plan_join({"inputs": [_input("orders", "o"), _input("customer", "c", (), "inner", "o", [(left, right)])]}, relations)
        except SpecError:
            return False
        return True

    pairs = [(a, b) for a in relations["orders"].columns for b in relations["customer"].columns]
    return spark.createDataFrame([(a, b, accepted(a, b)) for a, b in pairs], "left_key string, right_key string, accepted boolean")


@register("join_unconfirmed", """
SELECT 'lineitem' AS joined, true AS refused, count(*) AS rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'customer', false, count(*) FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_unconfirmed(spark, sf):
    """A join that grows is refused, with its exact rows, until it is confirmed; one that does not grow runs."""
    relations, found = tables(spark, sf, "orders", "lineitem", "customer"), []
    for other, key in (("lineitem", ("o_orderkey", "l_orderkey")), ("customer", ("o_custkey", "c_custkey"))):
        plan = plan_join({"inputs": [_input("orders", "o", ["o_orderkey"]), _input(other, "x", (), "inner", "o", [key])]}, relations)
        try:
            found.append((other, False, checked_join(plan).rows.count()))
        except Refused as refused:
            found.append((other, True, refused.review.estimated_rows))
    return spark.createDataFrame(found, "joined string, refused boolean, rows long")


@register("join_unprobed", """
SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_unprobed(spark, sf):
    plan = plan_join({"inputs": [_input("orders", "o", ["o_orderkey"]),
                                 _input("customer", "c", ["c_name"], "inner", "o", [("o_custkey", "c_custkey")])]},
                     tables(spark, sf, "orders", "customer"))
    return build_join(plan)


# ----------------------------------------------------------------- lineage
# Orders stand for slices, customers for sources: each order reads its
# customer and an earlier order, some read a source that is gone, and a few
# read each other.

_SLICES = """(SELECT 'o' || o_orderkey AS name, CASE WHEN o_orderkey % 11 <> 0 THEN
  TIMESTAMP '1995-01-01' + to_days(CAST((o_orderkey // 2 * 37 + o_orderkey // 2 // 50) % 2400 AS INTEGER)) END AS cut_at
  FROM orders)"""
_SOURCES = """(SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 17 <> 0 THEN
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey * 13 % 700 AS INTEGER)) END AS loaded_at FROM customer)"""
_EDGES = """(SELECT 'o' || o_orderkey AS child, 'c' || (o_custkey + CASE WHEN o_orderkey % 90 = 1 THEN 1000000 ELSE 0 END)
    AS parent FROM orders WHERE o_orderkey % 13 <> 5
  UNION SELECT 'o' || o_orderkey, 'o' || (o_orderkey // 8) FROM orders WHERE o_orderkey >= 8 AND o_orderkey % 13 <> 5
  UNION SELECT 'o' || o_orderkey, 'o' || (o_orderkey + 1) FROM orders WHERE o_orderkey % 100 = 50
  UNION SELECT 'o' || (o_orderkey + 1), 'o' || o_orderkey FROM orders WHERE o_orderkey % 100 = 50)"""


def _graph(spark, sf):
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    k = F.col("o_orderkey")

    def day(n):
        return F.date_add(F.lit("1995-01-01").cast("date"), n.cast("int")).cast("timestamp_ntz")

    def named(prefix, c):
        return F.concat(F.lit(prefix), c.cast("string"))

    half = F.floor(k / 2)
    slices = orders.select(named("o", k).alias("name"), F.when(
        k % 11 != 0, day((half * 37 + F.floor(half / 50)) % 2400)).alias("cut_at"))
    c = F.col("c_custkey")
    sources = customers.select(named("c", c).alias("name"), F.when(c % 17 != 0, day(c * 13 % 700)).alias("loaded_at"))
    gone = F.when(k % 90 == 1, 1000000).otherwise(0)
    kept, pair = orders.filter(k % 13 != 5), orders.filter(k % 100 == 50)
    edges = (kept.select(named("o", k).alias("child"), named("c", F.col("o_custkey") + gone).alias("parent"))
             .unionByName(kept.filter(k >= 8).select(named("o", k).alias("child"),
                                                     named("o", F.floor(k / 8)).alias("parent")))
             .unionByName(pair.select(named("o", k).alias("child"), named("o", k + 1).alias("parent")))
             .unionByName(pair.select(named("o", k + 1).alias("child"), named("o", k).alias("parent"))))
    return slices, sources, edges


_STATES = f"""
WITH RECURSIVE s AS (SELECT * FROM {_SLICES}), l AS (SELECT * FROM {_SOURCES}), e AS (SELECT * FROM {_EDGES}),
known AS (SELECT name, loaded_at AS changed_at, false AS is_slice FROM l UNION ALL SELECT name, cut_at, true FROM s),
f AS (SELECT e.child, e.parent, s.cut_at, k.changed_at, coalesce(k.is_slice, false) AS is_slice, k.name IS NULL AS gone
      FROM e JOIN s ON s.name = e.child LEFT JOIN known k ON k.name = e.parent WHERE s.cut_at IS NOT NULL),
stale AS (SELECT child AS name FROM f WHERE changed_at > cut_at
          UNION SELECT f.child FROM f JOIN stale ON f.is_slice AND f.parent = stale.name),
doubtful AS (SELECT name FROM s WHERE cut_at IS NULL OR name NOT IN (SELECT child FROM e)
          UNION SELECT child FROM f WHERE gone OR changed_at IS NULL
          UNION SELECT a.child FROM f a JOIN f b ON a.child = b.parent AND a.parent = b.child
          UNION SELECT f.child FROM f JOIN doubtful ON f.is_slice AND f.parent = doubtful.name),
states AS (SELECT s.name, CASE WHEN s.name IN (SELECT name FROM stale) THEN 'stale'
             WHEN s.name IN (SELECT name FROM doubtful) THEN 'unknown' ELSE 'fresh' END AS state FROM s)"""


@register("staleness", _STATES + " SELECT name, state FROM states")
def staleness_of_orders(spark, sf):
    return staleness(*_graph(spark, sf))


@register("staleness_reasons", _STATES + """
SELECT state, count(*) AS slices, count(DISTINCT CASE WHEN state <> 'fresh' THEN name END) AS explained
FROM states GROUP BY state""")
def staleness_reasons(spark, sf):
    """Every slice that is not fresh has a reason, and no fresh one has."""
    slices, sources, edges = _graph(spark, sf)
    states = staleness(slices, sources, edges)
    why = reasons(slices, sources, edges, states).select("name").distinct().withColumn("told", F.col("name"))
    return (states.join(why, "name", "left").groupBy("state")
            .agg(F.count("name").alias("slices"), F.count("told").alias("explained")))


@register("staleness_roots", _STATES.replace("\ndoubtful AS", """
roots AS (SELECT child AS name, parent AS root FROM f WHERE changed_at > cut_at
          UNION SELECT f.child, roots.root FROM f JOIN roots ON f.is_slice AND f.parent = roots.name),
doubtful AS""") + " SELECT name, root FROM roots")
def staleness_roots(spark, sf):
    """Every stale slice with each input whose change made it so."""
    return roots(*_graph(spark, sf))


@register("dependents", f"""
WITH RECURSIVE e AS (SELECT * FROM {_EDGES}),
d AS (SELECT child AS name FROM e WHERE parent = 'o1' UNION SELECT e.child FROM e JOIN d ON e.parent = d.name)
SELECT name FROM d WHERE name <> 'o1'""")
def dependents_of_one(spark, sf):
    return dependents(_graph(spark, sf)[2], "o1")


# --------------------------------------------------------------------- SQL


@register("sql_cte", """
WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT n, count(*) AS customers FROM big GROUP BY n""")
def sql_cte(spark, sf):
    return run_sql(spark, """
        WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT n, count(*) AS customers FROM big GROUP BY n  -- a closing comment;""", tables(spark, sf, "orders"))


@register("sql_window", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events""")
def sql_window(spark, sf):
    return run_sql(spark, """
        SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS place
        FROM events;""", tables(spark, sf, "events"))


@register("sql_setops", """
(SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax = 0)
EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""")
def sql_setops(spark, sf):
    return run_sql(spark, """
        (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49
         INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax = 0)
        EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal < 0""", tables(spark, sf, "lineitem", "supplier"))


@register("sql_grouping_sets", """
SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus),
(l_returnflag), ())""")
def sql_grouping_sets(spark, sf):
    return run_sql(spark, """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", tables(spark, sf, "lineitem"))


@register("sql_cross_confirmed", """
SELECT n.n_name, r.r_name, count(*) AS n FROM nation n, region r JOIN customer c ON c.c_nationkey % 5 = r.r_regionkey
GROUP BY n.n_name, r.r_name""")
def sql_cross_confirmed(spark, sf):
    return run_sql(spark, """
        SELECT n_name, r_name, CAST(sum(c.n) AS BIGINT) AS n FROM nation, region
        JOIN (SELECT c_nationkey % 5 AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = r_regionkey
        GROUP BY n_name, r_name""", tables(spark, sf, "nation", "region", "customer"), confirm=True)


@register("sql_summarize", """
SELECT 'p_size' AS column_name, CAST(min(p_size) AS VARCHAR) AS min, CAST(max(p_size) AS VARCHAR) AS max,
  round(avg(p_size), 6) AS avg, count(*) AS count FROM part""")
def sql_summarize(spark, sf):
    found = run_sql(spark, "SUMMARIZE SELECT p_size FROM part", tables(spark, sf, "part"))
    return rounded(found, 6, "avg").select("column_name", "min", "max", "avg", "count")


@register("saved_query_rerun", """
SELECT o_orderstatus, round(avg(o_totalprice), 6) AS avg_o_totalprice FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus""")
def saved_query_rerun(spark, sf):
    spec = {"mode": "pivot", "relation": "orders", "rows": ["o_orderstatus"], "value": "o_totalprice", "agg": "avg",
            "filters": cond("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]), "page": 4}
    return rounded(rerun(spark, "urgent averages", spec, tables(spark, sf, "orders")).rows, 6, "avg_o_totalprice")
