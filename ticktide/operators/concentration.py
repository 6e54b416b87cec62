"""How much of a date's turnover the largest instruments hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.functions.columns import by_date, rounded


def top_share(bars: DataFrame, percent: float = 5, least: int = 100, places: int = 6) -> DataFrame:
    """share of the floor(n * percent / 100) largest amounts, one at least, on dates with at least `least` rows."""
    held = bars.where("close > 0 AND amount > 0" if "close" in bars.columns else "amount > 0")
    place = F.row_number().over(by_date(F.desc("amount"), "code"))
    ranked = held.withColumn("place", place)
    per_date = ranked.withColumn("n", F.count("*").over(by_date())).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(percent / 100))))
    sums = per_date.groupBy("data_type", "trade_date").agg(F.max("n").alias("n"), F.sum(F.when(F.col("place") <= F.col("k"), F.col("amount").cast("decimal(28,4)"))).alias("top"), F.sum(F.col("amount").cast("decimal(28,4)")).alias("total"))
    return sums.where(F.col("n") >= least).select("data_type", "trade_date", "n", rounded(F.col("top").cast("double") / F.col("total").cast("double") * 100, places).alias("share"))


def threshold_share(bars: DataFrame, percentile: float = 95, least: int = 100, places: int = 4) -> DataFrame:
    """share of the amounts that reach the interpolated percentile of their date, on dates with at least `least` rows.
    One sort of a date's rows places both neighbours of the level."""
    at = (F.count("*").over(by_date()) - 1) * F.lit(percentile / 100)
    placed = bars.where("amount > 0").withColumn("n", F.count("*").over(by_date())).withColumn("at", at).withColumn("place", F.row_number().over(by_date("amount", "code")) - 1)
    neighbour = lambda i: F.max(F.when(F.col("place") == i, F.col("amount"))).over(by_date())
    low, high = neighbour(F.floor("at")), neighbour(F.ceil("at"))
    level = low + (F.col("at") - F.floor("at")) * (high - low)
    met = placed.where(F.col("n") >= least).withColumn("level", level)
    exact = F.col("amount").cast("decimal(28,4)")
    sums = met.groupBy("data_type", "trade_date", "n").agg(F.sum(F.when(F.col("amount") >= F.col("level") - F.abs("level") * 1e-9, exact)).alias("top"), F.sum(exact).alias("total"))
    return sums.select("data_type", "trade_date", "n", rounded(F.col("top").cast("double") / F.col("total").cast("double") * 100, places).alias("share"))


def with_index(shares: DataFrame, index: DataFrame) -> DataFrame:
    """A concentration series and a scaled index by date. index: trade_date, scaled."""
    return shares.join(index.select("trade_date", F.col("scaled").alias("index_scaled")), "trade_date", "left")
