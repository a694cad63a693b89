import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell import SpecError
from siftwell.operators import outliers as O
from siftwell.operators import profile as P
from siftwell.operators import quantiles as Q


@pytest.fixture(scope="module")
def things(spark):
    """40 rows: one ref twice, one far amount, one rare kind, memo 75% blank."""
    data = [(f"r{7 if i == 8 else i:03d}", 5000 if i == 20 else 10 + i % 5, "zz" if i == 3 else "ab"[i % 2] * 2,
             f"m{i}" if i % 4 == 0 else None, f"2024-01-{1 + i % 28:02d}") for i in range(40)]
    return spark.createDataFrame(data, "ref string, amount long, kind string, memo string, day string").withColumn(
        "day", F.col("day").cast("date"))


def test_profile_counts_by_hand(things):
    p = P.profile(things, rejected=1)
    by = {c.name: c for c in p.columns}
    assert (p.rows, p.rejected, p.approx) == (40, 1, False)
    assert by["ref"].distinct == 39 and by["memo"].non_null == 10 and by["memo"].null_pct == 75.0
    assert (by["amount"].min, by["amount"].max) == (10, 5000)
    assert by["amount"].q1 == 11 and by["amount"].q3 == 13
    assert sum(b.count for b in by["amount"].histogram) == 40 and len(by["amount"].histogram) == 24
    assert by["amount"].histogram[0].lo == 10 and by["amount"].histogram[-1].hi == 5000
    assert by["amount"].histogram[-1].count == 1 and by["amount"].histogram[5].count == 0
    assert sum(b.count for b in by["day"].histogram) == 40
    assert by["kind"].top[0].count == 20 and by["kind"].top[-1].value == "zz" and by["kind"].rare == 1
    assert by["ref"].min is None and by["day"].mean is None and by["kind"].histogram is None
    assert {(x.column, x.check) for x in p.leads} == {("memo", "missing"), ("ref", "duplicates"),
                                                      ("amount", "extremes"), ("kind", "rare")}


def test_constant_and_empty_columns(spark):
    p = P.profile(spark.range(5).select(F.lit(3).alias("same"), F.lit(None).cast("double").alias("none")))
    same, none = p.columns
    assert [(b.lo, b.hi, b.count) for b in same.histogram] == [(3, 3, 5)]
    assert none.histogram is None and none.q1 is None and none.null_pct == 100.0
    empty = P.profile(spark.range(0))
    assert empty.rows == 0 and empty.columns[0].null_pct == 0.0 and empty.leads == []


def test_a_large_profile_is_exact_unless_asked(spark):
    """One column 95.1 % different: a sketch may put it on either side of the gate."""
    rows = 210_000
    df = spark.range(rows).select(F.when(F.col("id") < int(rows * .951), F.col("id")).otherwise(7).cast("string").alias("k"),
                                  F.col("id").alias("n"))
    p = P.profile(df)
    k, n = p.columns
    assert not p.approx and (k.distinct, n.distinct) == (int(rows * .951), rows)
    assert (n.q1, n.median, n.q3) == ((rows - 1) * .25, (rows - 1) * .5, (rows - 1) * .75)
    assert {x.check: x.extra for x in p.leads if x.column == "k"} == {"duplicates": rows - int(rows * .951)}


def test_rare_values_are_all_counted_and_opened(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 300, F.col("id")).otherwise(-1).cast("string").alias("t"))
    (r,) = O.outliers(df, listed=10).rare
    assert (r.count, r.total_values, len(r.values)) == (300, 300, 10) and r.rows(df).count() == 300


def test_sketches_are_labelled_and_close(spark):
    df =spark.range(30_000).select((F.col("id") % 10_000).alias("a"), (F.col("id") % 7).cast("string").alias("t"),
                                    F.when(F.col("id") < 29_990, F.col("id")).otherwise(1).cast("string").alias("k"))
    p = P.profile(df, approximate=True)
    a, t, k = p.columns
    assert p.approx and a.distinct_approx and a.quartiles_approx and not t.quartiles_approx
    assert a.distinct == pytest.approx(10_000, rel=.03) and t.distinct == 7
    for got, want in ((a.q1, 2500), (a.median, 5000), (a.q3, 7500)):
        assert got == pytest.approx(want, abs=60)
    assert [x.count for x in t.top] == [4286, 4286, 4286, 4286, 4286]
    assert {x.check: x.extra for x in p.leads if x.column == "k"} == {"duplicates": 10}


def test_nested_columns_pass_through(tables):
    p = P.profile(tables["embeddings"])
    assert {c.name: c.family for c in p.columns}["embedding"] == "array<float>"


def test_summarize(spark):
    df = spark.createDataFrame([(1, "b"), (3, None), (None, "a")], "n int, s string")
    n, s = P.summarize(df).collect()
    assert (n["min"], n["max"], n["avg"], n["count"], n["null_percentage"]) == ("1", "3", 2.0, 3, 33.33)
    assert (s["min"], s["max"], s["avg"], s["q50"], s["approx_unique"]) == ("a", "b", None, None, 2)


@pytest.mark.parametrize("shape", ["uniform", "hot", "heavy", "few", "infinite"])
def test_exact_quantiles_at_any_threshold(spark, shape):
    rng = random.Random(shape)
    make = {"uniform": lambda: rng.uniform(0, 1), "hot": lambda: 5.0 if rng.random() < .5 else rng.uniform(0, 9),
            "heavy": lambda: rng.paretovariate(.3), "few": lambda: float(rng.randint(1, 3)),
            "infinite": lambda: rng.choice([float("inf"), -float("inf"), rng.uniform(-1, 1)])}[shape]
    values = [make() for _ in range(5001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = df.agg(F.min("x"), F.max("x"), Q.sketch_brackets(F.col("x"), (.25, .5, .75))).first()
    want = [sorted(values)[int(p * 5000)] for p in (.25, .5, .75)]     # 5000 divides evenly
    for brackets in (row[2], None):
        for in_task in (10**6, 50, 1):
            got = Q.quantiles(df, {"x": {"n": 5001, "min": row[0], "max": row[1], "brackets": brackets}},
                              (.25, .5, .75), in_task)["x"]
            assert got == want


def test_quantiles_interpolate(spark):
    values = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for in_task in (100, 1):
        got = Q.quantiles(df, {"x": {"n": 6, "min": 1.0, "max": 32.0}}, (.25, .5, .75), in_task)["x"]
        assert got == pytest.approx(list(np.quantile(values, [.25, .5, .75])))
    assert statistics.median(values) == got[1]


@pytest.fixture(scope="module")
def odd(spark):
    """112 rows: two extremes, two rare values over three rows, 79 blank memos,
    d1 three times and d2 twice, two mostly blank rows."""
    data = [[f"x{i}", 10 + i % 10, "common", f"m{i}" if i < 33 else None] for i in range(112)]
    data[0][1], data[1][1] = 900, -900
    data[2][2] = data[3][2] = "rare-a"
    data[4][2] = "rare-b"
    for i in (10, 11, 12):
        data[i][0] = "d1"
    for i in (13, 14):
        data[i][0] = "d2"
    for i in (110, 111):
        data[i][1] = data[i][2] = None
    return spark.createDataFrame([tuple(r) for r in data], "ref string, amount long, kind string, memo string")


def test_outliers_by_hand(odd):
    found = O.outliers(odd)
    (e,), (r,), (d,) = found.extremes, found.rare, found.duplicates
    assert (e.column, e.count, e.below, e.above) == ("amount", 2, 1, 1) and sum(b.count for b in e.histogram) == 110
    assert (r.column, r.count, [(v.value, v.count) for v in r.values]) == ("kind", 3, [("rare-b", 1), ("rare-a", 2)])
    assert [(m.column, m.count) for m in found.missing] == [("memo", 79), ("amount", 2), ("kind", 2)]
    assert found.missing[0].pct == 70.54 and found.mostly_blank.count == 2
    assert (d.column, d.values, d.count, d.worst.value, d.worst.count) == ("ref", 2, 5, "d1", 3)
    assert O.outliers(odd, n=1).rare[0].count == 1
    for bad in (dict(k=1.0), dict(k=3.5), dict(n=0), dict(n=101)):
        with pytest.raises(SpecError):
            O.outliers(odd, **bad)


def test_every_count_is_the_rows_it_opens(odd, tables):
    for df in (odd, tables["documents"], tables["events"], tables["part"], tables["conversations"], tables["customer"]):
        for f in O.outliers(df).findings():
            assert f.rows(df).count() == f.count, f.summary


def test_duplicate_rows_are_ordered_and_whole(odd):
    assert [r.ref for r in O.check_rows(odd, "duplicates", "ref").collect()] == ["d1"] * 3 + ["d2"] * 2
    assert O.check_rows(odd, "mostly_blank").count() == 2
    for args in (("nope",), ("duplicates", "nope"), ("duplicates", None)):
        with pytest.raises(SpecError):
            O.check_rows(odd, *args)


def test_long_values_group_by_digest(spark):
    long = "z" * 500
    df = spark.createDataFrame([(f"{i}" * 80,) for i in range(10, 99)] + [(long,), (long,), ("short",)], "t string")
    (d,) = O.outliers(df).duplicates
    assert (d.values, d.count, d.worst.value) == (1, 2, long)
    assert O.duplicate_rows(df, "t").count() == 2


def test_exact_checks_with_small_task_limits(odd, monkeypatch):
    monkeypatch.setattr(Q, "IN_TASK_VALUES", 5)
    whole = O.outliers(odd)
    assert (whole.extremes[0].q1, whole.extremes[0].count) == (12.0, 2)
