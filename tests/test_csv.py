import pytest
from pyspark.sql import functions as F

from siftwell import SpecError
from siftwell.sources import csv as C
from siftwell.sources import csv_records, samples, sinks


@pytest.fixture
def load(spark, tmp_path, csv_file):
    count = iter(range(1000))

    def run(text, **options):
        i = next(count)
        path = csv_file(f"f{i}.csv", text)
        done = C.load_csv(spark, path, f"{tmp_path}/p{i}", f"{tmp_path}/r{i}", **options)
        rows = [tuple(r) for r in spark.read.parquet(done.path).collect()]
        rejects = [tuple(r) for r in spark.read.parquet(done.rejects_path)
                   .select("line", "column_name", "error_type", "csv_line").collect()]
        return done, rows, sorted(rejects, key=str)
    return run


def types(done):
    return {n: k.type for n, k in done.kinds.items()}


def test_one_pass_over_many_shapes(load):
    """Each column holds two values; the type must fit both."""
    cases = {
        ("1", "2.5"): "double", ("1", "2"): "bigint", ("01", "2"): "string", ("007.5", "2"): "string",
        ("+5", "6"): "string", ("-05", "6"): "bigint", ("1e5", "2"): "double", (".5", "1."): "double",
        ("99999999999999999999", "1"): "decimal(38,0)", ("t", "F"): "boolean", ("yes", "no"): "boolean",
        ("true", "1"): "string", ("y", "n"): "string", ("2024-1-2", "2024-02-03"): "date",
        ("2024/01/02", "2024/01/03"): "date", ("31.12.2024", "01.02.2024"): "date", ("12/31/2024", "01/02/2024"): "date",
        ("01/02/2024", "01-02-2024"): "string", ("2023-02-30", "2024-01-01"): "string",
        ("2024-01-02 10:11:12", "2024-01-02T10:11"): "timestamp_ntz", ("2024-01-02T10:11:12Z", "2024-01-02 10:11:12+02"): "timestamp",
        ("2024-01-02", "2024-01-02 10:11:12"): "string", ("10:11", "10:12"): "string", ("nan", "1"): "double",
        ("inf", "1"): "string", (" 1", "2 "): "bigint", ("\\N", ""): "string", ("", "3"): "bigint", ("12d", "1"): "string",
        ("2024", "2025"): "bigint", ("2024-01", "2024-02"): "string", ("x", "2024-01-01"): "string"}
    header = ",".join(f"n{i}" for i in range(len(cases)))
    body = "\n".join(",".join(pair[j] for pair in cases) for j in (0, 1))
    done, rows, rejects = load(f"{header}\n{body}\n")
    assert list(types(done).values()) == list(cases.values()) and rejects == []
    at = {pair: [r[i] for r in rows] for i, pair in enumerate(cases)}
    assert [str(v) for v in at[("31.12.2024", "01.02.2024")]] == ["2024-12-31", "2024-02-01"]
    assert [str(v) for v in at[("12/31/2024", "01/02/2024")]] == ["2024-12-31", "2024-01-02"]
    assert at[("01", "2")] == ["01", "2"] and at[(" 1", "2 ")] == [1, 2]


def test_a_wide_row_is_refused_and_recorded(load):
    done, rows, rejects = load("account,amount,name\n000123,10,alpha\n000456,20,beta\nBADROW,30,gamma,EXTRA\n000789,40,d\n")
    assert [r[0] for r in rows] == ["000123", "000456", "000789"]
    assert rejects == [(4, None, "TOO MANY COLUMNS", "BADROW,30,gamma,EXTRA")]
    assert (done.rows, done.rejected, done.rejected_lines) == (3, 1, 1)


def test_one_record_per_error(load):
    text = "a,b,c,d,e,f\n" + "".join(f"r{i},{i},x,{i}.5,2024-01-01,q\n" for i in range(5))
    done, rows, rejects = load(text + "BAD,1\nBAD,zzz,x,2.5,2024-01-01,q,r,s\n")
    assert [(r[0], r[1], r[2]) for r in rejects] == [
        (7, "c", "MISSING COLUMNS"), (7, "d", "MISSING COLUMNS"), (7, "e", "MISSING COLUMNS"),
        (7, "f", "MISSING COLUMNS"), (8, "b", "CAST"), (8, None, "TOO MANY COLUMNS"), (8, None, "TOO MANY COLUMNS")]
    assert (len(rows), done.rejected, done.rejected_lines) == (5, 7, 2)


def test_padding_seen_only_by_a_full_scan(load, spark, csv_file):
    text = "account\n" + "\n".join(str(i) for i in range(1, 30_001)) + "\n000123\n000456\n"
    assert C.detect_types(spark, csv_file("mixed.csv", text)).columns["account"].type == "bigint"
    done, rows, _ = load(text)
    assert types(done) == {"account": "string"} and ("000123",) in rows and len(rows) == 30_002


def test_forced_text_and_suggestions(load, spark, csv_file):
    text = "Account_No,amount,zip,note\n123,1,2,x\n"
    done, rows, _ = load(text, force_text=["Account_No"])
    assert rows == [("123", 1, 2, "x")]
    assert C.detect_types(spark, csv_file("s.csv", text)).suggested_text == ["Account_No", "zip"]
    with pytest.raises(SpecError):
        load(text, force_text=["nope"])


def test_detect_survives_bad_rows(spark, csv_file):
    path = csv_file("bad.csv", "a,b\n1,2\n1,2,3\n4\n")
    assert {n: k.type for n, k in C.detect_types(spark, path).columns.items()} == {"a": "bigint", "b": "bigint"}


def test_blanks_markers_and_quotes(load):
    _, rows, _ = load('a,b\n1,2\n3,\\N\n,\n"",""\n')
    assert rows == [(1, 2), (3, None), (None, None), (None, None)]
    _, rows, _ = load("a;b\nNA;x\n5;NA\n", delim=";", marker="NA")
    assert rows == [(None, "x"), (5, None)]
    _, rows, _ = load('a,b\n1,"x""y"\n2,"q, r"\n3," p "\n4,5" pipe\n5,"q"z\n6,back\\slash\n')
    assert [r[1] for r in rows] == ['x"y', "q, r", " p ", '5" pipe', '"q"z', "back\\slash"]


def test_names(load):
    done, _, _ = load("a,a,b,\n1,2,3,4\n")
    assert list(done.kinds) == ["a", "a_1", "b", "column3"]
    done, _, _ = load("﻿a b,B,b\n1,2,3\n")
    assert list(done.kinds) == ["a b", "B", "b_1"]


def test_blank_lines_and_line_numbers(load):
    _, rows, rejects = load("a,b\r\n1,2\r\n\r\n\r\n3,4,5\r\n6,7\r\n")
    assert rows == [(1, 2), (6, 7)] and rejects[0][0] == 5
    _, rows, _ = load("a\n1\n\n3\n")
    assert rows == [(1,), (None,), (3,)]


def test_quoted_line_breaks(load):
    _, rows, rejects = load('a,b\n1,"x\ny"\n2,z\n1,2,3\n4,"p\n\n""q"", r\ns"\n')
    assert sorted(rows) == [(1, "x\ny"), (2, "z"), (4, 'p\n\n"q", r\ns')]
    assert rejects == [(4, None, "TOO MANY COLUMNS", "1,2,3")]


def test_a_quote_never_closed_takes_no_rows_along(load):
    done, rows, rejects = load('a,b\n0,"fine"\n1,"open\n2,z\n3,w\n')
    assert sorted(rows) == [(0, "fine"), (2, "z"), (3, "w")]
    assert [(r[0], r[2]) for r in rejects] == [(3, "UNQUOTED VALUE")]


def test_records_across_many_blocks(spark, csv_file, tmp_path):
    """Records with line breaks, cut into tasks of a few hundred bytes."""
    want = [(i, f"line {i}\nand \"more\"\n{'x' * (i % 50)}" if i % 3 == 0 else f"plain {i}") for i in range(400)]
    quoted = ['%d,"%s"' % (i, t.replace('"', '""')) if "\n" in t else f"{i},{t}" for i, t in want]
    quoted.insert(200, "bad,row,here")
    path = csv_file("blocks.csv", "n,t\n" + "\n".join(quoted) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "700")
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        done = C.load_csv(spark, path, f"{tmp_path}/p", f"{tmp_path}/r")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in spark.read.parquet(done.path).collect()) == want
    assert {r.line for r in spark.read.parquet(done.rejects_path).collect()} == {202}


def test_line_numbers_across_blocks(spark, csv_file, tmp_path):
    lines = [f"{i},v{i}" if i % 97 else f"{i}" for i in range(1, 3001)]
    path = csv_file("plain.csv", "n,t\n" + "\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        done = C.load_csv(spark, path, f"{tmp_path}/p", f"{tmp_path}/r")
    finally:
        spark.conf.set(key, before)
    got = {(r.line, r.csv_line) for r in spark.read.parquet(done.rejects_path).collect()}
    assert got == {(i + 1, str(i)) for i in range(97, 3001, 97)} and done.rows + done.rejected_lines == 3000


def test_oversize_records_are_refused_with_their_text(load):
    long = '2,"' + "long line\r\n" * 5 + 'end"'
    wide = "4," + "w" * 40
    _, rows, rejects = load(f'a,b\n1,"x\ny"\n{long}\n3,z\n{wide}\n', max_record_chars=30)
    assert sorted(rows) == [(1, "x\ny"), (3, "z")]
    assert {(r[0], r[2]) for r in rejects} == {(3, "LINE SIZE OVER MAXIMUM"), (5, "LINE SIZE OVER MAXIMUM")}
    texts = [r[3] for r in rejects]
    assert wide in texts and sorted(len(t) for t in texts if t != wide)[0] > 0
    assert sum(map(len, texts)) == len(long) + len(wide) and all(t in long for t in texts if t != wide)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_terminators_inside_quotes_stay(load, end):
    texts = ["x\ry", "x\r\ny", "x\ny", "\r", "\r\n\r", "a\r\r\nb", "say \"\"hi\"\"\r", "\\N in", "plain"]
    body = end.join(f'{i},"{t}",z' for i, t in enumerate(texts))
    _, rows, rejects = load(f"n,t,u{end}{body}{end}")
    assert sorted(rows) == [(i, t.replace('""', '"'), "z") for i, t in enumerate(texts)] and not rejects


def test_no_file_meets_in_one_task(spark, csv_file):
    """One file in 18 splits: no partition of the records holds more than three splits' rows."""
    text = "n,t\n" + "".join(f'{i},"line\r\n{i}"\n' if i % 4 == 0 else f"{i},row {i}\n" for i in range(9000))
    path = csv_file("splits.csv", text)
    conf = {"spark.sql.files.maxPartitionBytes": str(len(text) // 18 + 1), "spark.sql.files.openCostInBytes": "1",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64",
            "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        load = C.CsvLoad.__new__(C.CsvLoad)
        load.spark, load._scratch = spark, []
        raw = load._write(csv_records.lines(spark, path), "csv-lines")
        assert raw.select("block").distinct().count() >= 18
        found = csv_records.assemble(raw, ",")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        load.close()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 9001 and max(sizes) <= 3 * 9001 / 18


def test_folders_need_one_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_text("x,y\n1,2\nx,y\n")
    done = C.load_csv(spark, str(folder), f"{tmp_path}/p", f"{tmp_path}/r")
    assert done.rows == 4 and types(done) == {"x": "string", "y": "string"}
    (folder / "c.csv").write_text("x,z\n1,2\n")
    with pytest.raises(SpecError, match="header"):
        C.load_csv(spark, str(folder), f"{tmp_path}/p2", f"{tmp_path}/r2")


def test_no_copy_is_left_behind(spark, csv_file, tmp_path):
    load = C.CsvLoad(spark, csv_file("x.csv", 'a,b\n1,"x\ny"\n'))
    kept = list(load._scratch)
    assert load.rows.count() == 1 and len(kept) == 4
    load.close()
    for path in kept:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)


def test_rejects_are_listed_in_order(spark):
    df = spark.createDataFrame([("f", i, None, "X", "", "") for i in (3, 1, 2)], C.REJECT_SCHEMA)
    listed = C.list_rejects(df, 2)
    assert [r.line for r in listed.rows.collect()] == [1, 2] and (listed.total, listed.truncated) == (3, True)
    with pytest.raises(SpecError):
        C.list_rejects(df, 0)


def test_export_and_reload_keep_zeros(spark, tmp_path):
    df = spark.createDataFrame([("000123", 'a "b", c', None), ("000456", "x\ny", 1.5)], "id string, t string, x double")
    assert sinks.export_csv(df, f"{tmp_path}/out", single_file=True).verdict == "allow"
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.startswith('id,t,x\n000123,"a ""b"", c",')
    done = C.load_csv(spark, f"{tmp_path}/out", f"{tmp_path}/p", f"{tmp_path}/r")
    assert sorted(map(tuple, spark.read.parquet(done.path).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    sinks.export_parquet(df, f"{tmp_path}/pq")
    assert C.read_files(spark, f"{tmp_path}/pq").count() == 2
    assert C.read_files(spark, f"{tmp_path}/out", "csv", multiLine=True).columns == ["id", "t", "x"]


def test_export_review():
    assert sinks.review_export(10, "csv").verdict == "allow"
    warn = sinks.review_export(5_000_000, "csv")
    assert warn.verdict == "warn" and "zeros" in warn.findings[0].detail and any("Parquet" in s for s in warn.findings[0].suggestions)
    assert not any("Parquet" in s for s in sinks.review_export(5_000_000, "parquet").findings[0].suggestions)
    assert sinks.review_export(100_000_000, "parquet").overridable
    assert sinks.review_export(1_048_576, "xlsx").verdict == "allow"
    for args in ((1_048_577, "xlsx"), (1, "pdf")):
        with pytest.raises(SpecError):
            sinks.review_export(*args)


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sample")
    samples.generate_orders(spark, f"{root}/orders", 3000)
    samples.generate_later_extract(spark, f"{root}/later", 3000)
    samples.generate_customers(spark, f"{root}/customers", samples.customers_for(3000))
    return {n: (C.load_csv(spark, f"{root}/{n}", f"{root}/{n}-p", f"{root}/{n}-r")) for n in ("orders", "later", "customers")}


def test_sample_files(spark, sample):
    orders = spark.read.parquet(sample["orders"].path)
    assert types(sample["orders"]) == {
        "order_id": "string", "customer_id": "string", "order_date": "date", "product_code": "string",
        "quantity": "bigint", "unit_price": "double", "amount": "double", "promo_code": "string"}
    assert (sample["orders"].rows, sample["orders"].rejected_lines) == (3000, 3)
    assert orders.filter("quantity = 4000").count() == orders.filter("product_code = 'P999'").count() == 3
    assert orders.filter("promo_code is null").count() == 3000 - 3000 // 7
    assert orders.filter("unit_price is null").count() == 1
    first = orders.filter("order_id = '00000001'").first()
    assert tuple(map(str, first)) == ("00000001", "000060", "2025-02-07", "P032", "5", "5.97", "29.85", "None")
    assert sample["later"].rows == 3000 + 3000 // 11 and sample["customers"].rows == 61
    later = spark.read.parquet(sample["later"].path)
    assert later.filter("order_date >= '2025-12-01'").count() == 272
    assert later.join(orders, orders.columns, "left_semi").count() <= 3000
