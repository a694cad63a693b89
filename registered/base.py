"""How a query is registered: a callable, and where possible the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = make
        if sql:
            ORACLE[name] = sql
        return make
    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark, sf_dir: str, *names: str) -> dict:
    return {n: table(spark, sf_dir, n) for n in names}


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def cond(column, op, value=None) -> dict:
    return {"kind": "cond", "column": column, "op": op, "value": value}


def group(combiner, *children, negate=False) -> dict:
    return {"kind": "group", "combiner": combiner, "children": list(children), "negate": negate}
