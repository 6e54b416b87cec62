"""Tables of a date's cross-section: bins, groups, breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.functions.columns import by_date, rounded


def rps_bins(ranked: DataFrame, column: str = "rps_20") -> DataFrame:
    """Fifty bins two wide, (0, 2] to (98, 100]: how many rows and their mean chg_pct."""
    lower = (F.greatest(F.ceil(F.col(column) / 2), F.lit(1)) - 1) * 2
    held = ranked.where((F.col(column) > 0) & F.col("chg_pct").isNotNull())
    return held.groupBy("trade_date", lower.cast("int").alias("lower")).agg(F.count("*").alias("n"), rounded(F.avg("chg_pct")).alias("avg_chg"))


def quantile_groups(bars: DataFrame, column: str, groups: int = 50, exact: bool = False) -> DataFrame:
    """Rows in the order of a column cut at int(i * n / groups), the quotient a double unless exact: count and mean chg_pct."""
    held = bars.where(F.col("chg_pct").isNotNull())
    placed = held.withColumn("r", F.row_number().over(by_date(column, "code")) - 1).withColumn("n", F.count("*").over(by_date()))
    bound = lambda k: (F.floor(k * F.col("n") / groups) if exact else F.floor(k * (F.col("n").cast("double") / F.lit(float(groups))))).cast("long")
    near = F.ceil((F.col("r") + 1) * groups / F.col("n")) - 1  # the first group that ends behind r, or one beside it: quotients are rounded
    group = F.when(F.col("r") < bound(F.col("i")), F.col("i") - 1).when(F.col("r") >= bound(F.col("i") + 1), F.col("i") + 1).otherwise(F.col("i"))
    met = placed.withColumn("i", near).withColumn("i", group).where(F.col("i").between(0, groups - 1))
    return met.groupBy("trade_date", (F.col("i") * 2).cast("int").alias("lower")).agg(F.count("*").alias("n"), rounded(F.avg("chg_pct")).alias("avg_chg"))


def breadth(bars: DataFrame) -> DataFrame:
    """Percent of a date's rows with close above ma50 and above ma20, of those that have ma50."""
    held = bars.where("close > 0 AND ma50 > 0")
    percent = lambda c: rounded(F.avg(F.coalesce((F.col("close") > F.col(c)).cast("double"), F.lit(0.0))) * 100, 1)
    return held.groupBy("data_type", "trade_date").agg(F.count("*").alias("n"), percent("ma50").alias("above_ma50"), percent("ma20").alias("above_ma20"))


def rescaled(series: DataFrame, column: str, low: float = 20, high: float = 80) -> DataFrame:
    """A column stretched to [low, high] over the whole series, 1 decimal; the two extremes are the only rows broadcast."""
    ends = series.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return series.join(F.broadcast(ends)).withColumn("rescaled", rounded(low + (high - low) * (F.col(column) - F.col("_lo")) / span, 1)).drop("_lo", "_hi")


def freshness(bars: DataFrame) -> DataFrame:
    """Whether all of a date's bars are final, when the last was written, and from which sources they are."""
    return bars.groupBy("trade_date").agg(F.bool_and("is_final").alias("all_final"), F.max("update_time").alias("last_update"), F.array_join(F.sort_array(F.collect_set("data_source")), ",").alias("sources"))


def completeness(ranked: DataFrame, column: str) -> DataFrame:
    return ranked.groupBy("trade_date").agg(F.count("*").alias("n_rows"), F.count_if(F.col(column) >= 0).alias("n_ranked"))
