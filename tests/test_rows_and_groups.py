import collections
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siftwell import SpecError
from siftwell.functions.values import plain_rows
from siftwell.operators import groups, rows


def test_slice_sorts_by_an_unselected_column_with_blanks_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0), (4, None)], "id int, x double")
    assert [r.id for r in rows.slice_rows(df, ["id"], sort="x").collect()] == [2, 3, 1, 4]
    assert [r.id for r in rows.slice_rows(df, ["id"], sort="x", desc=True).collect()] == [3, 2, 1, 4]
    assert rows.slice_rows(df, ["x", "id"]).columns == ["x", "id"]
    for bad in (dict(columns=["nope"]), dict(sort="nope")):
        with pytest.raises(SpecError):
            rows.slice_rows(df, **bad)


def test_sort_splits_a_hot_value(spark):
    """A value held by most rows must not end up in one partition."""
    spread = spark.range(20_000).withColumn("x", F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = rows.sort_rows(spread.select("x"), "x").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 12_000


def test_pages_cover_everything_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3) for i in range(25)], "id int, g int")
    seen = []
    for limit in (100_000, 5):
        monkeypatch.setattr(rows, "DEEP_PAGE", limit)
        got = [rows.page(df, p, 10, "g") for p in (1, 2, 3, 4)]
        assert got[0].total == 25 and got[0].pages == 3
        seen.append([(r.g, r.id) for p in got for r in p.rows.collect()])
    assert seen[0] == seen[1] == sorted((i % 3, i) for i in range(25))
    assert rows.page(df.limit(0), 1, 10).pages == 1
    for bad in ((0, 10), (1, 0), (1, 5001)):
        with pytest.raises(SpecError):
            rows.page(df, *bad)


def test_deep_pages_by_rank(spark, monkeypatch, tmp_path):
    """Hot values, blanks, NaN, texts alike for longer than a cut, repeated rows and a column without an order."""
    long = "x" * 5_000
    made = [(i, "hot" if i % 3 else None if i % 5 == 0 else f"{long}{i % 7}", float("nan") if i % 11 == 0 else i % 4 / 2, i % 2 == 0)
            for i in range(600)] + [(7, "hot", 0.5, True)] * 300
    path = str(tmp_path / "rows")
    spark.createDataFrame(made, "i int, t string, x double, b boolean").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(rows, "CUTS", 5)
    monkeypatch.setattr(rows, "written", lambda d: pytest.fail("a rank search writes nothing"))
    for lead, desc in (("t", True), ("t", False), ("x", True), ("i", False)):
        whole = [str(r) for r in rows.sort_rows(df, lead, desc).collect()]
        monkeypatch.setattr(rows, "DEEP_PAGE", 40)
        for number in (3, 8):
            assert [str(r) for r in rows.page(df, number, 100, lead, desc).rows.collect()] == whole[100 * number - 100:100 * number]


def test_shown_rows_sort_naturally(spark):
    df = spark.createDataFrame([("a10", 2), ("B1", None), ("a2", 10), (None, 1), ("a2b3", 5), ("a02", 7)], "t string, n int")

    def order(column, desc=False):
        return [r[column] for r in rows.sort_shown(df, column, desc).collect()]

    assert order("t") == ["a02", "a2", "a2b3", "a10", "B1", None]
    assert order("t", True) == ["B1", "a10", "a2b3", "a2", "a02", None]
    assert order("n") == [1, 2, 5, 7, 10, None] and order("n", True) == [10, 7, 5, 2, 1, None]


def test_previews(spark, tmp_path):
    path = str(tmp_path / "nums")
    spark.range(2000).repartition(6).withColumn("v", F.col("id") * 2).write.parquet(path)
    head = rows.preview_head(spark, path, 300).collect()
    stored = (spark.read.parquet(path).select("id", "_metadata.file_path", "_metadata.row_index")
              .orderBy("file_path", "row_index").limit(300).collect())
    assert [r.id for r in head] == [r.id for r in stored]
    one = rows.preview_sample(spark, path, 500, seed=3).collect()
    assert len({r.id for r in one}) == 500
    assert one == rows.preview_sample(spark, path, 500, seed=3).collect()
    assert one != rows.preview_sample(spark, path, 500, seed=4).collect()
    assert rows.preview_sample(spark, path, 5000).count() == 2000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")    # many more tasks
    try:
        assert one == rows.preview_sample(spark, path, 500, seed=3).collect()
        assert head == rows.preview_head(spark, path, 300).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sample_reads_no_columns_to_pick(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(10).withColumn("v", F.lit("x")).write.parquet(path)
    whole = spark.read.parquet(path)
    plan = whole.select("_metadata.file_path", "_metadata.row_index")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<_tmp_metadata_row_index:bigint>" in plan    # made up by the reader


@pytest.fixture(scope="module")
def sales(spark):
    data = [("a", "x", 1, 1.0), ("a", "y", 2, None), ("a", None, 3, 4.0), ("b", "x", 4, 8.0), (None, "x", 5, 2.0),
            ("c", None, None, None)]
    return spark.createDataFrame(data, "g string, h string, n int, x double")


def test_flat_pivots(sales):
    def run(agg, value="n"):
        return {r.g: r[1] for r in groups.pivot(sales, ["g"], value, agg).collect()}

    assert run("sum") == {"a": 6, "b": 4, None: 5, "c": None}
    assert run("count") == {"a": 3, "b": 1, None: 1, "c": 0}
    assert run("avg") == {"a": 2.0, "b": 4.0, None: 5.0, "c": None}
    assert run("median", "x") == {"a": 2.5, "b": 8.0, None: 2.0, "c": None}
    assert run("count_distinct") == {"a": 3, "b": 1, None: 1, "c": 0}
    assert run("stddev") == {"a": 1.0, "b": None, None: None, "c": None}
    assert run("min") == {"a": 1, "b": 4, None: 5, "c": None}
    out = groups.pivot(sales, ["g"], "n", "sum")
    assert out.columns == ["g", "sum_n"] and [r.g for r in out.collect()] == ["a", "b", "c", None]


def test_wide_pivots(sales):
    out = groups.pivot(sales, ["g"], "n", "sum", "h")
    assert out.columns == ["g", "x", "y"]
    assert [tuple(r) for r in out.collect()] == [("a", 1, 2), ("b", 4, None), ("c", None, None), (None, 5, None)]
    assert [tuple(r) for r in groups.pivot(sales, ["g"], "n", "count", "h").collect()] == [
        ("a", 1, 1), ("b", 1, 0), ("c", 0, 0), (None, 1, 0)]
    by_number = groups.pivot(sales, ["g"], "x", "max", "n")
    assert by_number.columns == ["g", "1", "2", "3", "4", "5"]


def test_bad_pivots(sales, spark, monkeypatch):
    for args in (([], "n", "sum"), (["g"], "n", "mode"), (["g"], "nope", "sum"), (["g"], "h", "sum"), (["g"], "h", "avg")):
        with pytest.raises(SpecError):
            groups.pivot(sales, *args)
    monkeypatch.setattr(groups, "PIVOT_COLUMNS_LIMIT", 3)
    with pytest.raises(SpecError):
        groups.pivot(sales, ["g"], "x", "max", "n")


def test_big_sums_do_not_overflow(spark):
    df = spark.createDataFrame([("a", 2**62), ("a", 2**62), ("a", 2**62)], "g string, n long")
    assert groups.pivot(df, ["g"], "n", "sum").first()[1] == 3 * 2**62


def test_median_across_tasks_agrees(spark, monkeypatch):
    """One group holds most rows and one value most of that group."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < .8 else rng.choice("abc"),
             7.0 if rng.random() < .4 else rng.choice([None, rng.uniform(-5, 20)])) for _ in range(3000)]
    data += [("empty", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, x double")
    want = collections.defaultdict(list)
    for g, x in data:
        want[g] += [] if x is None else [x]
    want = {g: statistics.median(v) if v else None for g, v in want.items()}
    for limit in (10**9, 0):
        monkeypatch.setattr(groups, "GROUP_VALUES_LIMIT", limit)
        got = {r.g: r[1] for r in groups.pivot(df, ["g"], "x", "median").collect()}
        assert got.keys() == want.keys()
        assert all(got[g] == pytest.approx(want[g]) for g in want if want[g] is not None) and got["empty"] is None


def test_frequencies_and_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("a_c",), ("A%",)], "v string")
    assert [tuple(r) for r in groups.frequencies(df, "v").collect()] == [
        ("b", 2), ("A%", 1), ("a", 1), ("a_c", 1), (None, 1)]
    assert [tuple(r) for r in groups.distinct_values(df, "v", "A").collect()] == [("A%", 1), ("a", 1), ("a_c", 1)]
    found = groups.pick_values(df, "v", limit=2)
    assert found.distinct_total == 4 and found.truncated and found.rows.count() == 2
    assert not groups.pick_values(df, "v", "a", limit=2).truncated
    with pytest.raises(SpecError):
        groups.distinct_values(df, "v", limit=1001)


def test_plain_values(spark):
    df = spark.sql("""SELECT CAST('12345678901234567.89' AS DECIMAL(19,2)) AS d, double('NaN') AS n, double('inf') AS i,
        X'00FF' AS b, DATE '2024-01-02' AS day, TIMESTAMP_NTZ '2024-01-02 03:04:05.5' AS t,
        TIMESTAMP '2024-01-02 03:04:05+02:00' AS z, array(double('NaN'), 1.5D) AS a,
        named_struct('d', CAST(1.10 AS DECIMAL(5,2)), 'x', CAST(NULL AS INT)) AS s, map(1, X'AB') AS m, true AS ok""")
    r = plain_rows(df).first()
    assert r.asDict() == {
        "d": "12345678901234567.89", "n": None, "i": None, "b": "00ff", "day": "2024-01-02",
        "t": "2024-01-02T03:04:05.500000", "z": "2024-01-02T01:04:05+00:00", "a": "[null,1.5]",
        "s": '{"d":"1.10","x":null}', "m": '{"1":"ab"}', "ok": True}
