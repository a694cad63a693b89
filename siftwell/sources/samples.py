"""Generated sample files: orders and customers with planted oddities.

Every value is arithmetic on the row's number, so the files are the same
wherever and however often they are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import export_lines

# Fixed values of the sample.
ORDER_COLUMNS = ("order_id", "customer_id", "order_date", "product_code", "quantity", "unit_price", "amount",
                 "promo_code")
CUSTOMER_COLUMNS = ("customer_id", "customer_name", "segment", "country")
SEGMENTS = ("Consumer", "Business", "Public")
COUNTRIES = ("Norway", "Chile", "Kenya", "Japan", "Canada", "India", "Brazil", "Spain")
FIRST_DAY, LAST_MONTH = "2025-01-01", "2025-12-01"
EXTREME_QUANTITY, RARE_PRODUCT = 4000, "P999"


def customers_for(rows: int) -> int:
    return max(60, rows // 50)


def extra_rows(rows: int) -> int:
    return max(1, rows // 11)


def _padded(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _money(cents: Column) -> Column:
    return F.concat((cents / 100).cast("decimal(20,2)").cast("string"))


def order_columns(numbers: DataFrame, rows: int, customers: int) -> DataFrame:
    """One order per row number ``i``; a blank price is null.

    Numbers beyond ``rows`` are the extra month of a later extract and carry
    no planted oddity.
    """
    i = F.col("i")

    def planted(*places: int) -> Column:
        return (i <= rows) & i.isin(*places)

    extreme = planted(*[k * rows // 7 for k in (1, 2, 5)])
    rare = planted(*[k * rows // 5 + 1 for k in (1, 2, 4)])
    quantity = F.when(extreme, EXTREME_QUANTITY).otherwise(i * 13 % 9 + 1)
    cents = F.when(i % 2500 != 0, i * 97 % 9500 + 500)
    day = F.when(i <= rows, F.date_add(F.lit(FIRST_DAY).cast("date"), (i * 37 % 334).cast("int"))).otherwise(
        F.date_add(F.lit(LAST_MONTH).cast("date"), (i * 37 % 31).cast("int")))
    return numbers.select(
        _padded(i, 8).alias("order_id"), _padded(i * 7919 % customers + 1, 6).alias("customer_id"),
        day.alias("order_date"),
        F.when(rare, RARE_PRODUCT).otherwise(F.concat(F.lit("P"), _padded(i * 31 % 120 + 1, 3))).alias("product_code"),
        quantity.cast("long").alias("quantity"), _money(cents).alias("unit_price"),
        _money(cents * quantity).alias("amount"),
        F.when(i % 7 == 0, F.concat(F.lit("PROMO"), _padded(i % 12 + 1, 2))).alias("promo_code"))


def order_lines(numbers: DataFrame, rows: int, customers: int) -> DataFrame:
    """The orders as CSV lines, a malformed one after each quarter of the rows."""
    orders = order_columns(numbers, rows, customers)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ORDER_COLUMNS]
    line = F.concat_ws(",", *fields)
    number = F.col("order_id").cast("long")
    broken = F.concat(F.col("order_id"), F.lit("X,000001,2025-06-01,P001,1,9.99,9.99,PROMO01,EXTRA"))
    after = number.isin(*[k * rows // 4 for k in (1, 2, 3)]) & (number <= rows)
    return orders.select(F.explode(F.when(after, F.array(line, broken)).otherwise(F.array(line))).alias("line"))


def customer_columns(numbers: DataFrame) -> DataFrame:
    """One customer per row number ``k``; now and then one is filed twice."""
    k = F.col("k")

    def choose(names, at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (at % len(names) + 1).cast("int"))

    filed = F.when(k % 997 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return numbers.select(k, F.explode(filed).alias("again")).select(
        _padded(k, 6).alias("customer_id"), F.concat(F.lit("Customer "), _padded(k, 6)).alias("customer_name"),
        choose(SEGMENTS, k + F.col("again")).alias("segment"), choose(COUNTRIES, k).alias("country"))


def generate_orders(spark: SparkSession, path: str, rows: int, customers: int | None = None,
                    extra_month: int = 0) -> None:
    """Write the orders file; with ``extra_month`` rows, its later extract."""
    numbers = spark.range(1, rows + extra_month + 1).withColumnRenamed("id", "i")
    export_lines(order_lines(numbers, rows, customers or customers_for(rows)), ",".join(ORDER_COLUMNS), path)


def generate_later_extract(spark: SparkSession, path: str, rows: int) -> None:
    generate_orders(spark, path, rows, extra_month=extra_rows(rows))


def generate_customers(spark: SparkSession, path: str, customers: int) -> None:
    made = customer_columns(spark.range(1, customers + 1).withColumnRenamed("id", "k"))
    export_lines(made.select(F.concat_ws(",", *CUSTOMER_COLUMNS).alias("line")), ",".join(CUSTOMER_COLUMNS), path)
