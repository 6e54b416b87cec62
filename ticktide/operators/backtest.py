"""What trades cost, what holding them is worth by date, and figures over such equity. Everything is a DataFrame over all runs;
a simulator that lets one trade's cash decide on the next is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.operators.windows import drawdowns

#: Rates and least fee of the market's charges.
COMMISSION, LEAST_COMMISSION, TRANSFER, STAMP = 3e-4, 5.0, 2e-5, 5e-4
LOT, SLIP = 100, 0.01
#: Runs that are sent to every task, at most.
MOST_RUNS = 10_000


def fees(direction, amount):
    """Commission, transfer fee (buying) and stamp duty (selling) of an amount; columns or numbers."""
    if isinstance(amount, (int, float)):
        return max(amount * COMMISSION, LEAST_COMMISSION), amount * TRANSFER if direction == "BUY" else 0.0, amount * STAMP if direction == "SELL" else 0.0
    return F.greatest(amount * COMMISSION, F.lit(LEAST_COMMISSION)), F.when(direction == "BUY", amount * TRANSFER).otherwise(0.0), F.when(direction == "SELL", amount * STAMP).otherwise(0.0)


def first_purchases(prices: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run buys its lots of each instrument on its first bar: run_id, trade_date, code, direction, quantity, price, fees.
    prices: trade_date, code, close. runs: run_id, lots, at most MOST_RUNS rows; more are an error."""
    if runs.limit(MOST_RUNS + 1).count() > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs")
    first = prices.groupBy("code").agg(F.min_by("close", "trade_date").alias("close"), F.min("trade_date").alias("trade_date"))
    every = runs.agg(F.collect_list(F.struct("run_id", "lots")).alias("runs"))
    held = first.withColumn("run", F.explode(every.scalar()))
    made = held.select("run.run_id", "trade_date", "code", F.lit("BUY").alias("direction"), (F.col("run.lots") * LOT).cast("long").alias("quantity"), (F.col("close") + SLIP).alias("price"))
    commission, transfer, stamp = fees(F.col("direction"), F.col("price") * F.col("quantity"))
    return made.withColumn("fees", commission + transfer + stamp)


def equity(trades: DataFrame, prices: DataFrame, capital: float) -> DataFrame:
    """run_id, trade_date, equity on each run's trading days: the capital, less what trades cost, with what is held at its last
    close. Each day's gain is summed over instruments before the running sum, so a run's instruments are never gathered."""
    by_code = Window.partitionBy("code").orderBy("trade_date")
    moved = prices.select("code", "trade_date", "close", F.lag("close").over(by_code).alias("before"))
    paid = F.when(F.col("direction") == "BUY", F.col("price") * F.col("quantity") + F.col("fees")).otherwise(F.col("fees") - F.col("price") * F.col("quantity"))
    signed = F.when(F.col("direction") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    orders = trades.groupBy("run_id", "code", "trade_date").agg(F.sum(signed).alias("quantity"), F.sum(paid).alias("paid"))
    runs = trades.select("run_id", "code").distinct()
    daily = runs.join(moved, "code").join(orders, ["run_id", "code", "trade_date"], "left")
    held = F.coalesce(F.sum("quantity").over(Window.partitionBy("run_id", "code").orderBy("trade_date")), F.lit(0))
    old = held - F.coalesce("quantity", F.lit(0))
    gain = old * (F.col("close") - F.coalesce("before", F.col("close"))) + F.coalesce("quantity", F.lit(0)) * F.col("close") - F.coalesce("paid", F.lit(0.0))
    summed = daily.withColumn("gain", F.bround(gain, 8).cast("decimal(28,8)")).groupBy("run_id", "trade_date").agg(F.sum("gain").alias("gain"))
    so_far = F.sum("gain").over(Window.partitionBy("run_id").orderBy("trade_date"))
    return summed.select("run_id", "trade_date", (capital + so_far.cast("double")).alias("equity"))


def metrics(equity: DataFrame, rate: float = 0.03, days: int = 252) -> DataFrame:
    """Total and annual return, largest drawdown (negative) and Sharpe ratio of each run, from its equity by date."""
    w = Window.partitionBy("run_id").orderBy("trade_date")
    daily = drawdowns(equity).withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    sums = daily.groupBy("run_id").agg(
        F.count("*").alias("n_days"), F.min_by("equity", "trade_date").alias("first"), F.max_by("equity", "trade_date").alias("last"), F.min("drawdown").alias("max_drawdown"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r")
    )
    total = F.col("last") / F.col("first") - 1
    six = lambda c: F.bround(c, 6)
    sharpe = F.when(F.col("sd_r") > 0, (F.col("mean_r") - rate / days) / F.col("sd_r") * days**0.5).otherwise(0.0)
    return sums.select("run_id", "n_days", six(total).alias("total_return"), six(F.pow(1 + total, F.lit(float(days)) / F.col("n_days")) - 1).alias("annual_return"), six("max_drawdown").alias("max_drawdown"), six(sharpe).alias("sharpe"))


def quick_metrics(equity: DataFrame) -> DataFrame:
    """The short form: linear annual return over 365 days, positive drawdown, population deviation."""
    w = Window.partitionBy("run_id").orderBy("trade_date")
    daily = drawdowns(equity).withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1)
    sums = daily.groupBy("run_id").agg(F.count("*").alias("n"), F.min_by("equity", "trade_date").alias("first"), F.max_by("equity", "trade_date").alias("last"), F.max(-F.col("drawdown")).alias("dd"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    total = F.col("last") / F.col("first") - 1
    six = lambda c: F.bround(c, 6)
    return sums.select("run_id", six(total).alias("total_return"), six(total * 365 / F.col("n")).alias("annual_return"), six("dd").alias("max_drawdown"), six(F.col("m") / (F.col("s") + 1e-6) * F.sqrt(F.lit(252.0))).alias("sharpe"))
