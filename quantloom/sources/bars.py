"""Bars and snapshots derived from the driver's tables.

OHLCV bars are aggregates without ties (max, min, sums of cents rounded to cents; the close is amount over volume), so
that they don't depend on the order in which rows are added. A bar table has a row for each symbol and period, whatever the number of trades below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def weekly_brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol`` (brand), ``trade_date`` (Monday), ``open, high, low, close, volume, amount``. ``open`` is the last close."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    week = F.date_trunc("week", F.col("l_shipdate")).cast("date")
    bars = rows.groupBy(F.col("p_brand").alias("symbol"), week.alias("trade_date")).agg(
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )
    bars = bars.withColumn("close", F.col("amount") / F.col("volume"))
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    return bars.select("symbol", "trade_date", F.coalesce(before, "close").alias("open"), "high", "low", "close", "volume", "amount")


#: The same bars for DuckDB, as a common table expression.
BARS = """bars AS (
    SELECT symbol, trade_date, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), close) AS open, high, low, close, volume, amount
    FROM (SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::DATE AS trade_date, max(l_extendedprice / l_quantity) AS high,
                 min(l_extendedprice / l_quantity) AS low, round(sum(l_extendedprice), 2) / sum(l_quantity) AS close,
                 sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""


def daily_type_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns for event types by day; open and close are the first and last value of the day."""
    at = F.struct("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return rows.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("trade_date")).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.count("*").alias("volume"),
        F.round(F.sum("value"), 4).alias("amount"),
    )


TYPE_BARS = """tbars AS (
    SELECT event_type AS symbol, ts::DATE AS trade_date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, (ts, event_id)) AS close, count(*) AS volume, round(sum(value), 4) AS amount
    FROM events GROUP BY 1, 2)"""


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, name, industry, area, balance, total_mv, pe, pb, n_orders``: a screening universe of customers."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("code")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total_mv"), F.round(F.avg("o_totalprice") / 9973, 6).alias("pe"), F.count("*").alias("n_orders")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    cust = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    base = cust.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), "area", F.col("c_acctbal").alias("balance"))
    return base.join(orders, "code", "left").withColumn("pb", F.col("balance") / 1000)


SNAPSHOT = """snap AS (
    SELECT c_custkey AS code, c_name AS name, c_mktsegment AS industry, n_name AS area, c_acctbal AS balance, total_mv, pe, n_orders,
           c_acctbal / 1000 AS pb
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total_mv, round(avg(o_totalprice) / 9973, 6) AS pe, count(*) AS n_orders
               FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
