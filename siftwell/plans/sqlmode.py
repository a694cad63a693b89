"""Hand-written SQL: one read-only SELECT over the registered relations.

The text is Spark SQL. Spark's own parser decides what it is: the text becomes
a subquery, where only a query can stand.
"""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Mapping

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import Finding, Refused, Review, SpecError
from ..operators.profile import summarize

_SUMMARIZE = re.compile(r"\s*SUMMARIZE\s+(.+)", re.IGNORECASE | re.DOTALL)
_NAME = re.compile(r"[\w`\"]+")
# Expressions of an analysed plan that call arbitrary code in the driver, however they were written.
_REACHES_OUT = ("CallMethodViaReflection", "TryReflect")
_PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
# Physical operators that pair every row with every row.
_PAIRS_ALL = re.compile(r"^[\s:+\-*()0-9]*(CartesianProduct|BroadcastNestedLoopJoin)\b", re.MULTILINE)


def _deny(rule: str, title: str, detail: str = "") -> Refused:
    return Refused(Review((Finding(rule, "deny", title, detail),)))


def run_sql(spark: SparkSession, text: str, relations: Mapping[str, DataFrame] | None = None,
            confirm: bool = False) -> DataFrame:
    """The rows of one SELECT.

    Anything else, a registry table (its name begins with ``_``) or a file path
    is refused for good. A product of every row with every row is refused
    unless ``confirm`` is set.
    """
    text = (text or "").strip().rstrip(";").strip()
    if not text:
        raise SpecError("no SQL given")
    for name, df in (relations or {}).items():
        if not name.startswith("_"):
            df.createOrReplaceTempView(name)
    asked = _SUMMARIZE.fullmatch(text)
    if asked:
        what = asked.group(1)
        return summarize(_select(spark, f"SELECT * FROM {what}" if _NAME.fullmatch(what) else what))
    rows = _select(spark, text)
    if not confirm:
        _check_product(rows)
    return rows


@contextlib.contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _reaches_out(rows: DataFrame) -> bool:
    """Whether the analysed plan holds, at any depth, an expression that calls a method by its name."""
    gateway = rows.sparkSession.sparkContext._gateway

    def each(found):
        walk = found.iterator()
        while walk.hasNext():
            yield walk.next()

    waiting = [rows._jdf.queryExecution().analyzed()]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() in _REACHES_OUT:
            return True
        waiting.extend(each(node.children()))
        if is_instance_of(gateway, node, _PLAN):
            waiting.extend(each(node.expressions()))
        elif is_instance_of(gateway, node, _SUBQUERY):
            waiting.append(node.plan())
    return False


def _select(spark: SparkSession, text: str) -> DataFrame:
    rows = _analysed(spark, text)
    if _reaches_out(rows):
        raise _deny("not_a_single_select", "calls out of SQL are not run here")
    return rows


def _analysed(spark: SparkSession, text: str) -> DataFrame:
    try:
        # The line breaks keep a closing "--" comment from hiding the bracket.
        with _conf(spark, "spark.sql.runSQLOnFiles", "false"):
            return spark.sql(f"SELECT * FROM (\n{text}\n) AS asked")
    except ParseException as e:
        raise _deny("not_a_single_select", "only a single read-only SELECT runs here",
                    str(e).splitlines()[0]) from None
    except AnalysisException as e:
        missing = re.search(r"table or view `([^`]+)`", str(e), re.IGNORECASE)
        if missing and missing.group(1).startswith("_"):
            raise _deny("registry_table_access", f"{missing.group(1)} is internal") from None
        if re.search(r"(`?\b(parquet|csv|json|text|orc|avro|binaryfile)`?\s*\.\s*`)", text, re.IGNORECASE):
            raise _deny("file_access", "files are not read by path here",
                        "load the file, or read it with read_files") from None
        raise SpecError(str(e).splitlines()[0]) from None


def _check_product(rows: DataFrame) -> None:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        rows.explain()
    if _PAIRS_ALL.search(shown.getvalue()):
        Review((Finding(
            "cartesian_join", "block", "every row would be paired with every row",
            "Two relations are joined without an equality between their columns.",
            ("join on a key: FROM a JOIN b ON a.key = b.key",
             "to put rows below each other, use UNION ALL")),)).enforce()
