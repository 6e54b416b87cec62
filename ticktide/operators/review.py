"""The market in review: new highs, strong stocks, index overview, and what is said of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions.columns import by_code, day, rounded, signed

DAYS = 365


#: What the largest value in the days up to a bar is called, by column.
HIGHS = {"close": "year_high", "high": "year_top"}


def year_high(bars: DataFrame, *columns: str) -> DataFrame:
    """year_high of closes and year_top of highs, as asked for (of closes alone, if nothing is): the largest value in the 365 calendar days up to each bar, never later
    ones. Bars that have them stored beside them stay as they are."""
    wanted = [c for c in columns or ("close",) if HIGHS[c] not in bars.columns]
    if not wanted:
        return bars
    days = F.datediff(day(F.col("trade_date")), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("data_type", "code").orderBy("_day").rangeBetween(-DAYS, 0)
    return bars.withColumn("_day", days).withColumns({HIGHS[c]: F.max(c).over(w) for c in wanted}).drop("_day")


def new_highs(bars: DataFrame) -> DataFrame:
    """Bars that close at their year's high."""
    return year_high(bars, "close").where("close >= year_high")


def strong_by_high(bars: DataFrame, share: float = 0.9, touch: float = 0.99, top: int = 50) -> DataFrame:
    """The stocks of each date closest to their year's highest price, from `share` of it on."""
    ratio = F.col("close") / F.col("year_top")
    held = year_high(bars, "high").withColumn("_r", ratio).where(F.col("_r") >= share)
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("_r"), "code"))
    return held.withColumn("place", place).where(F.col("place") <= top).select("trade_date", "code", "place", rounded(F.col("_r") * 100, 1).alias("ratio"), (F.col("_r") >= touch).alias("touches"))


def strong_by_rank(ranked: DataFrame, basics: DataFrame, above: int = 270, days: int = 30, top: int = 50) -> DataFrame:
    """The highest rps_sum of each date above a bound, of stocks listed for more than `days`; unknown listing dates pass."""
    listed = ranked.join(basics.select(F.col("stock_code").alias("code"), "list_date"), "code", "left")
    age = F.coalesce(F.datediff(day(F.col("trade_date")), day(F.col("list_date"))), F.lit(9999))
    held = listed.where((F.col("rps_sum") > above) & (age > days))
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("rps_sum"), "code"))
    return held.withColumn("place", place).where(F.col("place") <= top).select("trade_date", "code", "place", "rps_sum")


def above_own_mean(bars: DataFrame, n: int = 50) -> DataFrame:
    """Bars that close above the mean of their last n closes, or as many as there are: a window instead of a subquery per row. Means are
    rounded as doubles, half-even: bround() rounds their shortest decimals, which is another number beside a half."""
    mean = F.avg("close").over(by_code().rowsBetween(1 - n, 0))
    return bars.withColumn("mean_close", F.rint(mean * 1e6) / 1e6).where(F.col("close") > F.coalesce(F.col("mean_close"), F.lit(0.0)))


def market_summary(bars: DataFrame) -> DataFrame:
    """Rows, those above ma50 in number and percent of all, and new highs, by date. bars: close, ma50."""
    marked = year_high(bars, "close")
    return marked.groupBy("trade_date").agg(
        F.count("*").alias("n"), F.count_if(F.col("close") > F.col("ma50")).alias("n_above"), rounded(F.count_if(F.col("close") > F.col("ma50")) * 100.0 / F.count("*"), 1).alias("percent_above"), F.count_if(F.col("close") >= F.col("year_high")).alias("n_new_high")
    )


def new_high_clusters(highs: DataFrame, top: int = 5, shown: int = 4, places: int = 2) -> DataFrame:
    """New highs by sector: count, percent of the date's new highs, mean change, the best by change and the core stocks.
    Core: the two best by chg_20d, the two best by chg_20d of the five largest amounts, each once, topped up to `shown`. Stocks are
    only listed once they are among the first of their sector. highs: trade_date, code, sector_name, chg_pct, chg_20d, amount."""
    of_sector = Window.partitionBy("trade_date", "sector_name")
    by_20 = [F.col("chg_20d").desc_nulls_last(), F.col("code")]
    ranked = highs.withColumns(
        {
            "by_20": F.row_number().over(of_sector.orderBy(*by_20)),
            "by_amount": F.row_number().over(of_sector.orderBy(F.col("amount").desc_nulls_last(), *by_20)),
            "by_change": F.row_number().over(of_sector.orderBy(F.col("chg_pct").desc_nulls_last(), "code")),
        }
    )
    listed = lambda where, by: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(F.col(by).alias("o"), "code")))), lambda x: x["code"])
    n_all = highs.groupBy("trade_date").agg(F.countDistinct("code").alias("n_all"))
    per = ranked.groupBy("trade_date", "sector_name").agg(
        F.count("*").alias("n"), rounded(F.avg("chg_pct"), places).alias("avg_chg"), listed(F.col("by_20") <= shown, "by_20").alias("first"), listed(F.col("by_amount") <= 5, "by_20").alias("of_largest"), listed(F.col("by_change") <= shown, "by_change").alias("best")
    )
    core = F.slice(F.array_union(F.array_union(F.slice("first", 1, 2), F.slice("of_largest", 1, 2)), F.col("first")), 1, shown)
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("n"), "sector_name"))
    joined = per.withColumn("place", place).where(F.col("place") <= top).join(n_all, "trade_date")
    return joined.select("trade_date", "sector_name", "place", "n", rounded(F.col("n") * 100.0 / F.col("n_all"), 1).alias("percent"), "avg_chg", F.array_join("best", ",").alias("representative"), F.array_join(core, ",").alias("core"))


#: What is said of an index by its change in percent, above each bound, and of the first and the last of a date.
COMMENTS = ((2.0, "大涨"), (1.0, "偏强"), (0.5, "小幅上涨"), (0.0, "窄幅震荡"), (-0.5, "小幅回调"), (-1.0, "偏弱"))
LOWEST, BEST, WORST = "大跌", "表现最强，领先全场", "表现最弱，明显落后"
#: States of the market by the percent of stocks above their 50-day mean, from each bound on.
STATES = ((70, "强势"), (50, "偏强"), (35, "分化"))
WEAKEST = "弱势"
#: Percent of the new highs in one sector, and number of new highs, above which they count as an effect.
BLOCK_PERCENT, MANY_HIGHS = 10, 100


#: Percent above which an index of technology, growth or the whole market counts as strong, and by how much the best
#: rises and the worst falls on a day on which the market is split.
STRONG, SPLIT = 1.0, 0.5


def index_overview(bars: DataFrame, technology: str | None = None, growth: str | None = None, market: str | None = None) -> DataFrame:
    """Each date's indices with their change since their date before, the best and worst of them, a comment on each and the day's
    style: led by technology or growth and not by the whole market, by that and not by them, all up, all down, split, or neither.
    technology, growth, market: codes of the indices that stand for these; one that is missing or has no bar that day counts as 0."""
    before = F.lag("close").over(by_code())
    pct = F.when(before > 0, rounded((F.col("close") - before) / before * 100))
    held = bars.withColumn("pct", pct).where("pct IS NOT NULL")
    per_date = Window.partitionBy("trade_date")
    held = held.withColumns(
        {
            "place": F.row_number().over(per_date.orderBy(F.desc("pct"), "code")),
            "leader": F.first("code").over(per_date.orderBy(F.desc("pct"), "code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "laggard": F.last("code").over(per_date.orderBy(F.desc("pct"), "code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "all_up": F.bool_and(F.col("pct") > 0).over(per_date),
            "all_down": F.bool_and(F.col("pct") < 0).over(per_date),
            "highest": F.max("pct").over(per_date),
            "lowest": F.min("pct").over(per_date),
            **{name: F.coalesce(F.max(F.when(F.col("code") == code, F.col("pct"))).over(per_date), F.lit(0.0)) for name, code in (("tech", technology), ("growth", growth), ("market", market))},
            "n": F.count("*").over(per_date),
        }
    )
    comment = F.when(F.col("place") == 1, BEST).when(F.col("place") == F.col("n"), WORST)
    for bound, word in COMMENTS:
        comment = comment.when(F.col("pct") > bound, word)
    comment = comment.otherwise(LOWEST)
    led, broad = (F.col("tech") > STRONG) | (F.col("growth") > STRONG), F.col("market") > STRONG
    style = F.when(led & ~broad, F.when(F.col("tech") > F.col("growth"), "国产科技主导").otherwise("海外链领涨")).when(broad & ~led, "价值回归")
    style = style.when(F.col("all_up"), "全面做多").when(F.col("all_down"), "全面承压").when((F.col("highest") > SPLIT) & (F.col("lowest") < -SPLIT), "结构分化").otherwise("窄幅震荡")
    return held.select("trade_date", "code", "place", "pct", "leader", "laggard", comment.alias("comment"), style.alias("style"))


def market_state(percent: Column) -> Column:
    found = F.lit(WEAKEST)
    for bound, word in reversed(STATES):
        found = F.when(percent >= bound, word).otherwise(found)
    return found


def market_signals(summary: DataFrame, strong: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each date's breadth, strong stocks and new highs with what they mean: the market's state, and whether new highs gather in
    one sector (block), are many (many) or few. summary: market_summary(); strong: strong_by_rank(); clusters: new_high_clusters()."""
    n_strong = strong.groupBy("trade_date").agg(F.count("*").alias("n_strong"))
    first = clusters.where("place = 1").select("trade_date", F.col("sector_name").alias("top_sector"), F.col("n").alias("top_n"), F.col("percent").alias("top_percent"))
    made = summary.join(n_strong, "trade_date", "left").join(first, "trade_date", "left").withColumn("n_strong", F.coalesce("n_strong", F.lit(0)))
    return interpretation(made)


def interpretation(signals: DataFrame) -> DataFrame:
    """state and effect of each date, and a line with both. signals: trade_date, percent_above, top_percent, n_new_high."""
    effect = F.when(F.col("top_percent") > BLOCK_PERCENT, "block").when(F.col("n_new_high") > MANY_HIGHS, "many").otherwise("few")
    made = signals.withColumn("state", market_state(F.col("percent_above"))).withColumn("effect", effect)
    return made.withColumn("text", F.concat_ws(" ", "state", signed(F.col("percent_above")), F.col("n_new_high").cast("string"), "effect"))


def full_review(overview: DataFrame, strong: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a date: its indices, strong stocks and sectors of strong stocks as arrays in their order. Each is short: indices are
    few, stocks and sectors are cut to their places before."""
    ordered = lambda df, name, *columns: df.groupBy("trade_date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", *columns))), lambda x: x[columns[0]]), ",").alias(name))
    made = ordered(overview, "indices", "code").join(ordered(strong, "stocks", "code"), "trade_date", "full")
    return made.join(ordered(clusters, "sectors", "sector_name"), "trade_date", "full")


def response(signals: DataFrame, strong: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row a date with what a page shows as nested columns: signal (a struct), strong (an array of code, place and rps_sum) and
    clusters (an array of sector_name, place, n, percent and arrays of codes), in their order, empty where there are none.
    signals: market_signals(); strong: strong_by_rank(); clusters: new_high_clusters()."""

    def listed(df: DataFrame, name: str, *columns) -> DataFrame:
        return df.groupBy("trade_date").agg(F.sort_array(F.collect_list(F.struct("place", *columns))).alias(name))

    codes = lambda c: F.split(c, ",").alias(c)
    made = signals.select("trade_date", F.struct(*[c for c in signals.columns if c != "trade_date"]).alias("signal"))
    made = made.join(listed(strong, "strong", "code", "rps_sum"), "trade_date", "left").join(listed(clusters, "clusters", "sector_name", "n", "percent", codes("representative"), codes("core")), "trade_date", "left")
    return made.withColumns({c: F.coalesce(c, F.array().cast(made.schema[c].dataType)) for c in ("strong", "clusters")})


def market_page(trade_date: str, tables: DataFrame, bubbles: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row with all that a page shows of a date: the three tables of its stocks and its bubbles as arrays of structs, and its
    freshness. tables: market_tables(). bubbles: of stocks or of sectors, with a place or by code. fresh: of tables.freshness()."""
    on = lambda df: df.where(F.col("trade_date") == trade_date)
    order = "place" if "place" in bubbles.columns else "code"
    kinds = ("rps", "amount", "price")
    listed = on(tables).groupBy("trade_date").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("lower", "n", "avg_chg")))).alias(f"{k}_stats") for k in kinds])
    rest = [c for c in bubbles.columns if c not in ("trade_date", order)]
    nodes = on(bubbles).groupBy("trade_date").agg(F.count("*").alias("n_nodes"), F.sort_array(F.collect_list(F.struct(order, *rest))).alias("nodes"))
    return listed.join(nodes, "trade_date", "full").join(on(fresh), "trade_date", "left")


def market_tables(bins: DataFrame, amounts: DataFrame, prices: DataFrame) -> DataFrame:
    """The three tables of a date's stocks as one: by rank, by amount and by price. Each: trade_date, lower, n, avg_chg."""
    marked = [df.withColumn("kind", F.lit(kind)) for kind, df in (("rps", bins), ("amount", amounts), ("price", prices))]
    return marked[0].unionByName(marked[1]).unionByName(marked[2])
