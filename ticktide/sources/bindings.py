"""Bars and dimensions out of the star-schema tables.

stock   a supplier is an instrument, its line items of a day are its trades
sector  a nation of suppliers, index a region of suppliers: bars are the sums of their members' trades
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: supplier, trade_date, order of the trade, price, quantity and amount. The order is one long, of order,
    line and part in 40, 3 and 20 bits, so that a bar's open and close come from a hash aggregate."""
    place = F.shiftleft(F.col("l_orderkey").cast("long"), 23) + F.shiftleft(F.col("l_linenumber").cast("long"), 20) + F.col("l_partkey") % (1 << 20)
    return read(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"),
        place.alias("at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("value"),
    )


def _bars(traded: DataFrame, family: str, code) -> DataFrame:
    return (
        traded.groupBy(code.alias("code"), "trade_date")
        .agg(
            F.min_by("price", "at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "at").alias("close"),
            F.sum("quantity").cast("double").alias("volume"),
            F.sum("value").cast("double").alias("amount"),
        )
        .select(F.lit(family).alias("data_type"), "code", "trade_date", "open", "high", "low", "close", "volume", "amount")
    )


def stock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades are dealt out by code, so that bars and windows over an instrument's bars share one exchange: a date has few trades of a
    stock, and sums before the exchange would save nothing. Sectors and indices have few codes and many trades, so theirs go first."""
    traded = trades(spark, sf_dir).withColumn("code", F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    return _bars(traded.drop("l_suppkey").repartition("code"), "stock", F.col("code"))


def _of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", "s_name", "s_acctbal", "n_nationkey", "n_name", "n_regionkey")


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with their supplier's nation and region. Suppliers are joined before nations: Spark takes a join's size for the product of
    both sides, and would deal out all trades to meet suppliers that are joined already."""
    supplier, nation = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    held = trades(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return held.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(_owned(spark, sf_dir), "sector", F.concat(F.lit("8803"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(_owned(spark, sf_dir), "index", F.concat(F.lit("99990"), F.col("n_regionkey").cast("string")))


def month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide cross-section: parts by month, trade_date the month's first day."""
    items = read(spark, sf_dir, "lineitem").select("l_partkey", F.date_format(F.trunc("l_shipdate", "month"), "yyyyMMdd").alias("trade_date"), F.col("l_extendedprice").cast("decimal(18,4)").alias("value"))
    return items.groupBy(F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("code"), "trade_date").agg(F.sum("value").cast("double").alias("amount")).select(F.lit("stock").alias("data_type"), "code", "trade_date", "amount")


def stock_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_code, stock_name, market, list_date (the first trade's), is_st."""
    first = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.date_format(F.min("l_shipdate"), "yyyyMMdd").alias("list_date"))
    named = _of_suppliers(spark, sf_dir)
    return named.join(first, named["s_suppkey"] == first["l_suppkey"], "left").select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"), F.col("s_name").alias("stock_name"), F.col("n_name").alias("market"), "list_date", F.col("s_name").contains("ST").alias("is_st")
    )


def sector_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, stock_count, stock_codes: nations and regions, so a stock is in two sectors."""
    held = _of_suppliers(spark, sf_dir).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    stock = F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock")
    members = held.select(F.concat(F.lit("8803"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("name"), stock).unionByName(
        held.select(F.concat(F.lit("8809"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("code"), F.col("r_name").alias("name"), stock)
    )
    return members.groupBy("code", "name").agg(F.sort_array(F.collect_list("stock")).alias("stock_codes")).select("code", "name", F.size("stock_codes").alias("stock_count"), "stock_codes")


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt aren't synced, ranked or displayed."""
    return read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.col("s_name").alias("name"), F.lit("stock").alias("category"), F.lit(True).alias("exclude_sync"), F.lit(True).alias("exclude_rps"), F.lit(True).alias("exclude_display")
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, ts, event_id, price, volume of the events stream."""
    return read(spark, sf_dir, "events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), "ts", "event_id", F.col("value").alias("price"))
