import pytest
from pyspark.sql import functions as F

from siftwell import Refused, SpecError
from siftwell.operators import lineage as L
from siftwell.plans.sqlmode import run_sql


@pytest.fixture(scope="module")
def relations(spark):
    df = spark.range(20).selectExpr("id", "id % 3 as g")
    return {"things": df, "others": df.selectExpr("id as oid", "g as og"), "_sources": df}


@pytest.mark.parametrize("text, rows", [
    ("SELECT * FROM things;", 20), ("SELECT * FROM things -- note", 20), ("SELECT g, count(*) FROM things GROUP BY g", 3),
    ("WITH a AS (SELECT 1 AS x) SELECT * FROM a", 1), ("SELECT id FROM things UNION ALL SELECT oid FROM others", 40),
    ("SELECT * FROM things WHERE id = 5 OR 1 = 1", 20), ("SELECT 'O''Brien -- x; y' AS t", 1),
    ("SELECT * FROM things t JOIN others o ON t.id = o.oid", 20), ("SUMMARIZE things", 2),
    ("summarize SELECT g FROM things;", 1),
])
def test_selects_run(spark, relations, text, rows):
    assert run_sql(spark, text, relations).count() == rows


@pytest.mark.parametrize("text, rule", [
    ("DROP TABLE things", "not_a_single_select"), ("SELECT 1; SELECT 2", "not_a_single_select"),
    ("CREATE TABLE x AS SELECT 1", "not_a_single_select"), ("INSERT INTO things SELECT 1, 2", "not_a_single_select"),
    ("SET spark.x = 1", "not_a_single_select"), ("SELECT 1) t; DROP TABLE things; --", "not_a_single_select"),
    ("SELECT * FROM _sources", "registry_table_access"),
    ("WITH a AS (SELECT * FROM _lineage) SELECT * FROM a", "registry_table_access"),
    ("SELECT * FROM csv.`/etc/passwd`", "file_access"), ("SELECT * FROM parquet.`/tmp`", "file_access"),
    ("SELECT reflect('java.lang.System', 'getenv')", "not_a_single_select"),
])
def test_refusals_cannot_be_confirmed_away(spark, relations, text, rule):
    with pytest.raises(Refused) as refused:
        run_sql(spark, text, relations, confirm=True)
    assert refused.value.review.verdict == "deny" and refused.value.review.findings[0].rule == rule


@pytest.mark.parametrize("text", ["SELECT * FROM things, others", "SELECT * FROM things CROSS JOIN others",
                                  "SELECT * FROM things JOIN others ON id < oid"])
def test_products_need_confirmation(spark, relations, text):
    with pytest.raises(Refused) as refused:
        run_sql(spark, text, relations)
    assert refused.value.review.overridable
    assert run_sql(spark, text, relations, confirm=True).count() > 20


def test_mistakes(spark, relations):
    for text in ("", "  ;", "SELECT nope FROM things", "SELECT * FROM missing"):
        with pytest.raises(SpecError):
            run_sql(spark, text, relations)


def day(c):
    return F.col(c).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def graph(spark):
    slices = [("a", "2024-01-02"), ("b", "2024-01-03"), ("c", None), ("d", "2024-01-05"), ("e", "2024-01-05"),
              ("f", "2024-01-06"), ("g", "2024-01-06"), ("h", "2024-01-06"), ("same", "2024-01-04"), ("x", "2024-01-06"),
              ("y", "2024-01-06"), ("self", "2024-01-06"), ("z", "2024-01-06"), ("over", "2024-01-07"), ("mix", "2024-01-07")]
    sources = [("s1", "2024-01-01"), ("s2", "2024-01-04"), ("s3", None)]
    edges = [("a", "s1"), ("b", "s2"), ("c", "s2"), ("d", "b"), ("d", "s1"), ("e", "c"), ("f", "gone"), ("h", "s3"),
             ("same", "s2"), ("x", "y"), ("y", "x"), ("self", "self"), ("z", "a"), ("z", "s1"), ("over", "x"),
             ("mix", "d"), ("mix", "gone"), ("z", "a")]
    return (spark.createDataFrame(slices, "name string, t string").select("name", day("t").alias("cut_at")),
            spark.createDataFrame(sources, "name string, t string").select("name", day("t").alias("loaded_at")),
            spark.createDataFrame(edges, "child string, parent string"))


def test_staleness(graph):
    states = L.staleness(*graph)
    assert {r.name: r.state for r in states.collect()} == {
        "a": "fresh", "b": "stale", "c": "unknown", "d": "stale", "e": "unknown", "f": "unknown", "g": "unknown",
        "h": "unknown", "same": "fresh", "x": "unknown", "y": "unknown", "self": "unknown", "z": "fresh",
        "over": "unknown", "mix": "stale"}
    why = {(r.name, r.input) for r in L.reasons(*graph, states).collect()}
    assert why == {("b", "s2"), ("c", None), ("d", "b"), ("e", "c"), ("f", "gone"), ("g", None), ("h", "s3"), ("x", "y"),
                   ("y", "x"), ("self", "self"), ("over", "x"), ("mix", "d"), ("mix", "gone")}
    assert {tuple(r) for r in L.roots(*graph).collect()} == {("b", "s2"), ("d", "s2"), ("mix", "s2")}


def test_reasons_of_two_roots_and_of_a_recut_input(spark):
    slices = spark.createDataFrame([("x", "2024-01-05"), ("y", "2024-01-03"), ("p", "2024-01-09"), ("q", "2024-01-09")],
                                   "name string, t string").select("name", day("t").alias("cut_at"))
    sources = spark.createDataFrame([("orders", "2024-01-06"), ("prices", "2024-01-08"), ("old", "2024-01-01")],
                                    "name string, t string").select("name", day("t").alias("loaded_at"))
    # p and q read each other, and p reads what is stale.
    edges = spark.createDataFrame([("x", "orders"), ("x", "prices"), ("x", "old"), ("y", "x"), ("p", "q"), ("q", "p"), ("p", "x")],
                                  "child string, parent string")
    roots = {tuple(r) for r in L.roots(slices, sources, edges).collect()}
    assert roots == {(n, r) for n in "xypq" for r in ("orders", "prices")} | {("y", "x")}
    why = {tuple(r) for r in L.reasons(slices, sources, edges, L.staleness(slices, sources, edges)).collect()}
    assert {w for w in why if w[0] in "xy"} == {
        ("x", "orders", "orders changed after this was cut"), ("x", "prices", "prices changed after this was cut"),
        ("y", "x", "x changed after this was cut"), ("y", "x", "x is stale itself, as orders changed"),
        ("y", "x", "x is stale itself, as prices changed")}


def test_dependents(graph):
    def of(name):
        return sorted(r.name for r in L.dependents(graph[2], name).collect())

    assert of("s2") == ["b", "c", "d", "e", "mix", "same"]
    assert of("x") == ["over", "y"] and of("mix") == [] and of("nobody") == []


def test_long_chains(spark, monkeypatch):
    monkeypatch.setattr(L, "MERGE_ROUNDS", 2)
    n = 7
    slices = spark.range(n).select(F.concat(F.lit("p"), "id").alias("name"),
                                   F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2024-01-02").cast("timestamp_ntz")).alias("cut_at"))
    edges = spark.range(n).select(F.concat(F.lit("p"), "id").alias("child"), F.when(F.col("id") > 0, F.concat(
        F.lit("p"), (F.col("id") - 1).cast("string"))).otherwise("s").alias("parent"))
    for loaded, state in (("2024-01-01", "fresh"), ("2024-01-03", "stale")):
        sources = spark.createDataFrame([("s", loaded)], "name string, t string").select("name", day("t").alias("loaded_at"))
        assert {r.state for r in L.staleness(slices, sources, edges).collect()} == {state}
    assert L.dependents(edges, "s").count() == n


@pytest.mark.parametrize("text", [
    "SELECT `reflect`('java.lang.Math', 'abs', -3)", "SELECT reflect/**/('java.lang.Math', 'abs', -3)",
    "SELECT 1 WHERE EXISTS (SELECT java_method('java.lang.Math', 'abs', -3))",
    "WITH a AS (SELECT try_reflect('java.lang.Math', 'abs', -3) AS x) SELECT * FROM a"])
def test_calls_out_are_refused_however_written(spark, text):
    with pytest.raises(Refused):
        run_sql(spark, text)


def test_a_text_that_only_speaks_of_calls_is_harmless(spark):
    assert run_sql(spark, "SELECT 'the reflect (x)' AS t").first()["t"] == "the reflect (x)"
