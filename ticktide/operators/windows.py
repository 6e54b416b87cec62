"""Factors over an instrument's own bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions.columns import by_code, change_from, rounded

CHANGES = (5, 10, 20, 50, 120, 250)
PRICE_MEANS = (10, 20, 50, 120)
VOLUME_MEANS = (5, 10, 20, 50)


def valid(bars: DataFrame) -> DataFrame:
    """Bars with a price; others take part in no factor."""
    return bars.where("close > 0")


def period_changes(bars: DataFrame, periods: tuple[int, ...] = CHANGES, daily: bool = True) -> DataFrame:
    """chg_pct from the row before, chg_<n>d from the row n before."""
    close = F.col("close")
    made = {f"chg_{p}d": change_from(close, F.lag("close", p).over(by_code())) for p in periods}
    return bars.withColumns(({"chg_pct": change_from(close, F.lag("close").over(by_code()))} if daily else {}) | made)


def trailing_mean(column: str, n: int, full: bool = True, places: int = 2):
    """Mean of the last n rows; null before there are n, or of those there are."""
    mean = rounded(F.avg(column).over(by_code().rowsBetween(1 - n, 0)), places)
    return F.when(F.row_number().over(by_code()) >= n, mean) if full else mean


def moving_averages(bars: DataFrame, price: tuple[int, ...] = PRICE_MEANS, volume: tuple[int, ...] = VOLUME_MEANS, guard: str = "current", full: bool = True) -> DataFrame:
    """ma<n> and vol_ma<n>. guard: a volume mean needs the current volume above 0, the window's sum above 0, or nothing."""
    made = {f"ma{n}": trailing_mean("close", n, full) for n in price}
    for n in volume:
        mean = trailing_mean("volume", n, full)
        ok = {"current": F.col("volume") > 0, "sum": F.sum("volume").over(by_code().rowsBetween(1 - n, 0)) > 0, "none": F.lit(True)}[guard]
        made[f"vol_ma{n}"] = F.when(ok, mean)
    return bars.withColumns(made)


def calculate_ma(bars: DataFrame, code: str, trade_date: str, window: int) -> DataFrame:
    """ma of one instrument on one date; no row without enough bars."""
    return batch_calculate_ma(bars, [code], trade_date, trade_date, window)


def batch_calculate_ma(bars: DataFrame, codes: list[str] | None, start: str | None, end: str | None, window: int) -> DataFrame:
    """ma of instruments between two dates; None: all codes, or no bound."""
    wanted = F.col("code").isin(codes) if codes is not None else F.lit(True)
    until = F.col("trade_date") <= end if end is not None else F.lit(True)
    since = F.col("trade_date") >= start if start is not None else F.lit(True)
    held = valid(bars).where(wanted & until)
    return held.withColumn("ma", trailing_mean("close", window)).where(since & F.col("ma").isNotNull()).select("code", "trade_date", "ma")


def adjusted_closes(bars: DataFrame) -> DataFrame:
    """adj_close by code and trade_date. Stored bars are adjusted already, so it is the close; no row without a price that day."""
    return valid(bars).select("code", "trade_date", F.col("close").alias("adj_close"))


def get_adj_close(bars: DataFrame, code: str, trade_date: str) -> DataFrame:
    """The adjusted close of one instrument on one date; no row without one."""
    return adjusted_closes(bars).where((F.col("code") == code) & (F.col("trade_date") == trade_date))


def first_value_scaled(bars: DataFrame) -> DataFrame:
    """Closes as 50 plus the percent change since an instrument's first bar."""
    first = F.first("close").over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("scaled", rounded((F.col("close") / first - 1) * 100 + 50))


def horizon(bars: DataFrame, first: str, rows: int) -> DataFrame:
    """What an incremental run from `first` on must read: the bars since then and each instrument's last `rows` before."""
    old = F.col("trade_date") < first
    place = F.row_number().over(Window.partitionBy("data_type", "code", old).orderBy(F.desc("trade_date")))
    return bars.withColumn("_n", place).where(~old | (F.col("_n") <= rows)).drop("_n")


def changes_on(bars: DataFrame, trade_date: str, periods: tuple[int, ...] = CHANGES) -> DataFrame:
    """chg_pct and chg_<n>d of one date, from no more history than they need."""
    held = horizon(valid(bars).where(F.col("trade_date") <= trade_date), trade_date, max(periods))
    return period_changes(held, periods).where(F.col("trade_date") == trade_date)


def calendar_of(bars: DataFrame) -> DataFrame:
    """data_type, trade_date, at: a family's dates, numbered from 0; newest: the last number. As many rows as trading days."""
    w = Window.partitionBy("data_type")
    dates = bars.select("data_type", "trade_date").distinct()
    return dates.withColumn("at", F.row_number().over(w.orderBy("trade_date")) - 1).withColumn("newest", F.count("*").over(w).cast("int") - 1)


def densified(bars: DataFrame, since: str | None = None, before: int = 0) -> DataFrame:
    """A row for each instrument with a close and each date of its family, closes carried forward; observed says whether there
    was a bar. since: only that date, `before` dates before it, and later ones. Each bar makes the rows up to the next one."""
    dates = calendar_of(bars)
    start = F.lit(0)
    if since is not None:
        dates = dates.withColumn("start", F.min(F.when(F.col("trade_date") >= since, F.col("at"))).over(Window.partitionBy("data_type")) - before)
        start = F.coalesce("start", F.col("newest") + 1)
    placed = bars.where("close IS NOT NULL").select("data_type", "code", "trade_date", "close").join(F.broadcast(dates), ["data_type", "trade_date"])
    w = Window.partitionBy("data_type", "code").orderBy("at")
    own = F.greatest(F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("at")), start)
    spans = placed.withColumn("own", own).withColumn("last", F.coalesce(F.lead("at").over(w) - 1, F.col("newest"))).where("own <= last")
    rows = spans.select("data_type", "code", "close", F.col("at").alias("bar"), F.explode(F.sequence("own", "last")).alias("at"))
    close = F.when(F.col("at") >= F.col("bar"), F.col("close"))
    named = rows.join(F.broadcast(dates.select("data_type", "at", "trade_date")), ["data_type", "at"])
    return named.select("data_type", "code", "trade_date", close.alias("close"), (F.col("at") == F.col("bar")).alias("observed"))


def calendar_changes(bars: DataFrame, periods: tuple[int, ...], since: str | None = None) -> DataFrame:
    """chg<n> over n dates of the family's calendar with closes carried forward, unrounded; one column a period."""
    dense = densified(bars, since, max(periods))
    made = {}
    for p in periods:
        before = F.lag("close", p).over(by_code())
        made[f"chg{p}"] = F.when(before > 0, F.col("close") / before - 1)
    return dense.withColumns(made)


#: Values that a running mean appends to one array; arrays of so many are then joined, so that no step copies a long one.
BLOCK = 64


def ema(ordered, span: int, seed_rows: int = 1):
    """Exponential means of an array of doubles. The seed is the value at place seed_rows; places before it are null."""
    k = 2.0 / (span + 1)
    nulls = F.array_repeat(F.lit(None).cast("double"), seed_rows - 1)
    rest = F.slice(ordered, seed_rows + 1, F.greatest(F.size(ordered) - seed_rows, F.lit(0)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(rest) - 1) / BLOCK), F.lit(0)).cast("int")), lambda i: F.slice(rest, i * BLOCK + 1, BLOCK))
    empty = F.array().cast("array<array<double>>")
    first = F.try_element_at(ordered, F.lit(seed_rows))

    def taken(made, block):
        step = lambda m, x: F.concat(m, F.array(x * k + F.element_at(m, -1) * (1 - k)))
        both = lambda m: F.struct(F.element_at(m, -1).alias("last"), F.concat(made["made"], F.array(F.slice(m, 2, BLOCK))).alias("made"))
        return F.aggregate(block, F.array(made["last"]), step, both)

    means = F.aggregate(blocks, F.struct(first.alias("last"), empty.alias("made")), taken, lambda m: F.flatten(m["made"]))
    return F.when(F.size(ordered) >= seed_rows, F.concat(nulls, F.array(first), means)).otherwise(F.transform(ordered, lambda _: F.lit(None).cast("double")))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, seed: str = "first") -> DataFrame:
    """ema_fast, ema_slow, dif, dea, hist. seed "first": means start at the first close. "period": each starts at its period-th
    value, the signal's counted from where dif begins. An instrument's bars are one array: as many as it has dates."""
    at = (lambda span: 1) if seed == "first" else (lambda span: span)
    rows = bars.groupBy("data_type", "code").agg(F.sort_array(F.collect_list(F.struct("trade_date", "close"))).alias("rows"))
    rows = rows.withColumn("closes", F.col("rows")["close"])
    rows = rows.withColumns({"fast": ema(F.col("closes"), fast, at(fast)), "slow": ema(F.col("closes"), slow, at(slow))})
    rows = rows.withColumn("dif", F.zip_with("fast", "slow", lambda a, b: a - b))
    known = F.filter("dif", lambda x: x.isNotNull())
    rows = rows.withColumn("known", known).withColumn("late", F.size("dif") - F.size("known"))
    rows = rows.withColumn("dea", F.concat(F.array_repeat(F.lit(None).cast("double"), F.col("late")), ema(F.col("known"), signal, at(signal))))
    zipped = F.arrays_zip("rows", "fast", "slow", "dif", "dea")
    out = rows.select("data_type", "code", F.explode(zipped).alias("x"))
    six = lambda c: rounded(c, 6)
    return out.select("data_type", "code", F.col("x.rows.trade_date").alias("trade_date"), six(F.col("x.fast")).alias("ema_fast"), six(F.col("x.slow")).alias("ema_slow"), six(F.col("x.dif")).alias("dif"), six(F.col("x.dea")).alias("dea"), six(2 * (F.col("x.dif") - F.col("x.dea"))).alias("hist"))


def drawdowns(equity: DataFrame, by: str = "run_id") -> DataFrame:
    """peak and drawdown of an equity column along trade_date."""
    w = Window.partitionBy(by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))
