"""Queries of sectors, reviews, pools, ingest, simulation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticktide.functions import columns
from ticktide.functions.columns import rounded
from ticktide.operators import backtest, ingest, pool, ranks, resample, review, sectors, tables, windows
from ticktide.plans import factors, sql
from ticktide.sources import bindings, store

TODAY = "20010101"
#: Numbers by which demonstrations pick rows.
CODE_PICK, DATE_PICK = "CAST(code AS INT)", "CAST(trade_date AS INT)"


def _highs(spark, d):
    return review.new_highs(factors.stored(spark, d))


def active_pool(spark, d):
    return pool.active_pool(factors.stored(spark, d), bindings.exclusions(spark, d), bindings.stock_basics(spark, d))


def strong_by_high(spark, d):
    return review.strong_by_high(factors.stored(spark, d))


def strong_by_rps(spark, d):
    return review.strong_by_rank(factors.stored(spark, d), bindings.stock_basics(spark, d))


def lateral_ma50(spark, d):
    return review.above_own_mean(bindings.stock_bars(spark, d)).select("code", "trade_date", "mean_close")


def market_summary(spark, d):
    return review.market_summary(factors.stored(spark, d))


def new_high(spark, d):
    return _highs(spark, d).select("code", "trade_date", rounded(F.col("year_high"), 8).alias("year_high"))


def new_high_clusters(spark, d):
    return review.new_high_clusters(sectors.with_all_sectors(_highs(spark, d).select("trade_date", "code", "chg_pct", "chg_20d", "amount"), bindings.sector_basics(spark, d)), places=6)


def _strong_stocks(spark, d):
    strong = pool.named(strong_by_high(spark, d), bindings.stock_basics(spark, d))
    return sectors.with_main_sector(strong.select("trade_date", "code", "name", F.col("place").alias("order")), bindings.sector_basics(spark, d))


def industry_cluster(spark, d):
    return sectors.clusters(_strong_stocks(spark, d))


def top_industry(spark, d):
    return sectors.most_common(_strong_stocks(spark, d))


def index_overview(spark, d):
    return _overview(spark, d)


def _overview(spark, d):
    return review.index_overview(bindings.index_bars(spark, d), "999901", "999902", "999903")


def main_industry(spark, d):
    return sectors.main_sector(bindings.sector_basics(spark, d))


def all_industries(spark, d):
    return sectors.with_all_sectors(bindings.stock_basics(spark, d).select(F.col("stock_code").alias("code")), bindings.sector_basics(spark, d))


def sector_index(spark, d):
    """Closes here jump about by whole multiples; a thousandth of each change is chained, so that prices stay finite."""
    return sectors.equal_weight_index(factors.changed(spark, d).withColumn("chg_pct", F.col("chg_pct") / 1000), bindings.sector_basics(spark, d), places=8).select("sector", "trade_date", "n", "change", rounded(F.log("price"), 4).alias("log_price"), rounded(F.col("price"), 0).alias("price"))


def sector_breadth(spark, d):
    return sectors.sector_breadth(ranks.rps_from_changes(factors.changed(spark, d), (20,)), bindings.sector_basics(spark, d))


def exclusion_anti(spark, d):
    return pool.without_excluded(bindings.stock_bars(spark, d), bindings.exclusions(spark, d), "exclude_rps").groupBy("code").agg(F.count("*").alias("n"))


def enabled_semi(spark, d):
    """Rows of the codes on a list, here that of the excluded."""
    return pool.only_excluded(bindings.stock_bars(spark, d), bindings.exclusions(spark, d), "exclude_sync").groupBy("code").agg(F.count("*").alias("n"))


def new_listings(spark, d):
    return ingest.not_yet_loaded(bindings.stock_basics(spark, d).select(F.col("stock_code").alias("code"), "list_date"), bindings.stock_bars(spark, d).where("trade_date < '19950106'"), ("code",))


def name_lookup(spark, d):
    return pool.named(pool.latest_date(bindings.stock_bars(spark, d)).join(bindings.stock_bars(spark, d), "trade_date"), bindings.stock_basics(spark, d)).select("code", "name", "trade_date")


def union_families(spark, d):
    every = bindings.stock_bars(spark, d).unionByName(bindings.sector_bars(spark, d)).unionByName(bindings.index_bars(spark, d))
    return every.select("data_type", "code", "trade_date", "volume")


def latest_common_date(spark, d):
    return pool.latest_common_date(bindings.stock_bars(spark, d).unionByName(bindings.sector_bars(spark, d)))


def previous_date(spark, d):
    return pool.latest_date(bindings.stock_bars(spark, d), before=TODAY)


def last_bars(spark, d):
    return pool.last_bars(bindings.stock_bars(spark, d), 260).select("code", "trade_date", "volume")


def bubbles(spark, d):
    return pool.bubbles(factors.stored(spark, d), bindings.stock_basics(spark, d))


def sector_bubbles(spark, d):
    held = ranks.percentiles(ranks.rps_from_changes(windows.period_changes(windows.valid(bindings.sector_bars(spark, d)), (10, 20, 50)), (10, 20, 50)), least=5)
    gone = bindings.read(spark, d, "nation").where("n_nationkey % 8 = 5").select(F.lit("sector").alias("category"), F.concat(F.lit("8803"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.lit(True).alias("exclude_display"))
    return pool.sector_bubbles(held, bindings.sector_basics(spark, d), exclusions=gone)


def rps_at_least(spark, d):
    return pool.at_least(factors.stored(spark, d), 90, ("rps_20", "rps_50", "rps_120", "rps_250")).select("code", "trade_date", "rps_20", "rps_250")


def search(spark, d):
    return pool.search(bindings.stock_basics(spark, d), "0007").select("stock_code", "stock_name", "market")


def sector_page(spark, d):
    return pool.page(bindings.sector_basics(spark, d).where("stock_count >= 5").select("code", "name", "stock_count"), ("code",), 2, 3)


def code_normalise(spark, d):
    raw = bindings.stock_basics(spark, d).select("stock_code", F.concat(F.element_at(F.array(F.lit("sh"), F.lit("sz."), F.lit("1#"), F.lit("SECTOR_")), (F.col("stock_code").cast("int") % 4 + 1)), "stock_code").alias("raw"))
    bare = columns.bare_code(F.col("raw"))
    return raw.select("stock_code", bare.alias("bare"), columns.with_suffix(bare).alias("suffixed"), columns.family_of(bare).alias("family"), columns.is_listed_share(bare).alias("listed"))


def _marked(spark, d):
    """Each bar twice: provisional, and final on most days."""
    bars = bindings.stock_bars(spark, d).select("data_type", "code", "trade_date", "close", "volume")
    stamp = F.to_timestamp("trade_date", "yyyyMMdd")
    first = bars.select("*", F.lit(False).alias("is_final"), (stamp + F.expr("INTERVAL 14 HOURS")).alias("update_time"))
    return first, _finals(first)


def _finals(first):
    """The final ones of provisional bars."""
    return first.where(F.expr(DATE_PICK) % 3 != 0).withColumns({"close": F.col("close") + 1, "is_final": F.lit(True), "update_time": F.col("update_time") + F.expr("INTERVAL 2 HOURS")})


def upsert_latest(spark, d):
    return ingest.upsert(*_marked(spark, d)).select("code", "trade_date", rounded(F.col("close"), 8).alias("close"), "is_final")


def partial_update(spark, d):
    bars = bindings.stock_bars(spark, d).select("data_type", "code", "trade_date", "volume")
    updates = bars.where(F.expr(CODE_PICK) % 2 == 0).select("data_type", "code", "trade_date", (F.col("volume") * 2).alias("volume"))
    return ingest.patched(bars, updates, ("volume",)).select("code", "trade_date", "volume")


def is_final_patch(spark, d):
    return ingest.with_final_flags(_marked(spark, d)[0], TODAY).select("code", "trade_date", "is_final", "changed")


def freshness(spark, d):
    first, final = _marked(spark, d)
    return tables.freshness(ingest.upsert(first, final).withColumn("data_source", F.when(F.col("is_final"), "b").otherwise("a")))


def sync_start(spark, d):
    return ingest.resume_dates(ingest.upsert(*_marked(spark, d))).drop("data_type")


def source_priority(spark, d):
    bars = bindings.stock_bars(spark, d).select("code", "trade_date", "volume")
    of = lambda name, rest: bars.where((F.expr(CODE_PICK) + F.expr(DATE_PICK)) % 4 >= rest).withColumn("data_source", F.lit(name))
    best = ingest.first_source(of("tdx", 2).unionByName(of("akshare", 1)).unionByName(of("yfinance", 0)), {"tdx": 1, "akshare": 2, "baostock": 3, "yfinance": 4})
    return best.select("code", "trade_date", "volume", "data_source")


def source_counts(spark, d):
    return ingest.source_counts(source_priority(spark, d))


def _holidays(spark):
    return spark.createDataFrame([(y, ["01-01", "05-01", "10-01"]) for y in range(1990, 2010)], "year int, dates array<string>")


def workdays(spark, d):
    """Workdays from the first order's year to the last order's."""
    years = bindings.read(spark, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-01-01").alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-12-31").alias("last")).first()
    return ingest.calendar(spark, years.first, years.last, _holidays(spark)).select("trade_date")


def bars_on_workdays(spark, d):
    kept = ingest.on_workdays(bindings.stock_bars(spark, d), ingest.calendar(spark, "1990-01-01", "2009-12-31", _holidays(spark)))
    return kept.groupBy("code").agg(F.count("*").alias("n"))


def suspended(spark, d):
    bars = bindings.stock_bars(spark, d)
    return ingest.suspended(bars.where("trade_date <= '19981215'"), ingest.calendar(spark, "1990-01-01", "2009-12-31", _holidays(spark)), "19981215").drop("data_type")


def listed_long_enough(spark, d):
    return ingest.listed_long_enough(bindings.stock_bars(spark, d).select("code").distinct(), bindings.stock_basics(spark, d), "19960105", 365)


def quality_filter(spark, d):
    return ingest.in_bounds(bindings.stock_bars(spark, d).withColumn("close", F.when(F.expr(CODE_PICK) % 5 == 0, -F.col("close")).otherwise(F.col("close")))).groupBy("code").agg(F.count("*").alias("n"))


def volume_fill(spark, d):
    bars = bindings.stock_bars(spark, d).withColumn("volume", F.when(F.expr(DATE_PICK) % 2 == 0, 0.0).otherwise(F.col("volume")))
    return ingest.normalised(bars).select("code", "trade_date", "volume")


def _held(spark, d):
    """Equity of holding one of each instrument's index: a run per instrument."""
    return bindings.index_bars(spark, d).select(F.col("code").alias("run_id"), "trade_date", F.col("close").alias("equity"))


def drawdown(spark, d):
    return windows.drawdowns(_held(spark, d)).select("run_id", "trade_date", rounded(F.col("drawdown"), 6).alias("drawdown"))


def sharpe_annual(spark, d):
    return backtest.metrics(_held(spark, d))


def quick_metrics(spark, d):
    return backtest.quick_metrics(_held(spark, d))


def fee_table(spark, d):
    amount = F.col("o_totalprice")
    side = F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL")
    commission, transfer, stamp = backtest.fees(side, amount)
    return bindings.read(spark, d, "orders").select("o_orderkey", rounded(commission, 6).alias("commission"), rounded(transfer, 6).alias("transfer"), rounded(stamp, 6).alias("stamp"))


def _runs(spark):
    return spark.createDataFrame([(f"lots{n}", n) for n in (1, 2, 5)], "run_id string, lots int")


def backtest_equity(spark, d):
    prices = bindings.index_bars(spark, d)
    one = spark.createDataFrame([("one", 1)], "run_id string, lots int")
    made = backtest.equity(backtest.first_purchases(prices, one), prices, 1e9)
    return made.select("trade_date", rounded(F.col("equity"), 2).alias("equity"))


def backtest_equity_stocks(spark, d):
    prices = bindings.stock_bars(spark, d)
    return backtest.equity(backtest.first_purchases(prices, _runs(spark)), prices, 1e9).select("run_id", "trade_date", rounded(F.col("equity"), 2).alias("equity"))


def backtest_trades(spark, d):
    made = backtest.first_purchases(bindings.stock_bars(spark, d), _runs(spark))
    return made.select("run_id", "trade_date", "code", "direction", "quantity", rounded(F.col("price"), 6).alias("price"), rounded(F.col("fees"), 6).alias("fees"))


def market_analysis(spark, d):
    held = pool.without_excluded(factors.stored(spark, d), bindings.exclusions(spark, d), "exclude_display").where("amount > 0")
    return review.market_tables(tables.rps_bins(held), tables.quantile_groups(held, "amount"), tables.quantile_groups(held, "close"))


def market_signals(spark, d):
    return _signals(spark, d).select("trade_date", "n", "percent_above", "n_new_high", "n_strong", "top_sector", "top_n", "state", "effect", "text")


def _signals(spark, d):
    strong = review.strong_by_rank(factors.stored(spark, d), bindings.stock_basics(spark, d))
    return review.market_signals(market_summary(spark, d), strong, new_high_clusters(spark, d))


def review_response(spark, d):
    """The nested response of a date as JSON."""
    strong = review.strong_by_rank(factors.stored(spark, d), bindings.stock_basics(spark, d))
    made = review.response(_signals(spark, d).select("trade_date", "n", "n_new_high", "n_strong", "state", "effect"), strong, new_high_clusters(spark, d))
    return made.select("trade_date", F.to_json(F.struct("signal", "strong", "clusters")).alias("body"))


def full_review(spark, d):
    return review.full_review(_overview(spark, d), strong_by_high(spark, d), industry_cluster(spark, d))


def day_table(spark, d):
    """Written ahead, date by date, and read back."""
    path = store.fresh_folder(spark, "days")
    breadth = tables.breadth(windows.moving_averages(factors.changed(spark, d), volume=())).drop("data_type")
    ingest.write_days(breadth, path)
    return ingest.read_days(spark, path, "n long, above_ma50 double, above_ma20 double, trade_date string")


def chg_on_date(spark, d):
    bars = bindings.stock_bars(spark, d)
    return windows.changes_on(bars, pool.latest_date(bars).first()[0]).select("code", "trade_date", "chg_pct", "chg_20d", "chg_250d")


def recompute_horizon(spark, d):
    return windows.horizon(bindings.stock_bars(spark, d), TODAY, 250).select("code", "trade_date")


def index_list(spark, d):
    known = bindings.read(spark, d, "region").select(F.concat(F.lit("99990"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"))
    listed = bindings.read(spark, d, "nation").select(F.concat(F.lit("9999"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("name"), F.lit("index").alias("category"), (F.col("n_nationkey") % 3 == 0).alias("exclude_sync"))
    return pool.index_list(known, listed)


def sector_list(spark, d):
    ranked = ranks.rps_from_changes(windows.period_changes(windows.valid(bindings.sector_bars(spark, d)), (10, 20, 50)), (10, 20, 50))
    return pool.sector_list(bindings.sector_basics(spark, d), ranked)


def first_by_name(spark, d):
    region = bindings.read(spark, d, "region").select(F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("code"))
    nation = bindings.read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("code"))
    return pool.first_by_name(region, nation)


def supported_codes(spark, d):
    enabled = bindings.read(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_nationkey").alias("code"))
    return pool.supported(enabled, bindings.read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("code")))


def exclusions_changed(spark, d):
    held = bindings.exclusions(spark, d).select("category", "code", "name", "exclude_sync")
    added = bindings.read(spark, d, "nation").select(F.lit("sector").alias("category"), F.concat(F.lit("8803"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.col("n_name").alias("name"), F.lit(False).alias("exclude_sync"))
    return pool.changed_exclusions(held, added, held.where(F.expr("CAST(code AS INT) % 2 = 0")))


def price_earnings(spark, d):
    value = F.get_json_object("props", "$.k").cast("double") / 7
    one = F.concat(F.lit('{"pe_ttm": '), value.cast("string"), F.lit("}"))
    body = F.when(F.col("event_id") % 2 == 0, one).otherwise(F.concat(F.lit('[{"pe_ttm": 1.5}, '), one, F.lit("]")))
    return ingest.price_earnings(bindings.read(spark, d, "events").select(F.col("event_id").alias("code"), body.alias("body")))


def stock_history(spark, d):
    return pool.daily(bindings.stock_bars(spark, d), "000003", "19960101", "20001231").select("trade_date", rounded(F.col("close"), 8).alias("close"))


def stored_dates(spark, d):
    return pool.stored_dates(bindings.stock_bars(spark, d), "000003", "19960101", "19961231")


def one_ma(spark, d):
    bars = bindings.stock_bars(spark, d)
    return windows.calculate_ma(bars, "000003", pool.latest_date(bars.where("code = '000003'")).first()[0], 20)


def abnormal_share(spark, d):
    bars = bindings.stock_bars(spark, d)
    return ingest.abnormal_share(bars.withColumn("close", F.when(F.expr(f"CAST({CODE_PICK} AS BIGINT) * {DATE_PICK}") % 3 == 0, -F.col("close")).otherwise(F.col("close")))).drop("data_type")


def emptied_ranks(spark, d):
    return ingest.without_ranks(factors.ranked(spark, d)).select("code", "trade_date", "chg_pct", "chg_20d", "rps_20")


def row_counts(spark, d):
    return ingest.row_counts(bindings.stock_bars(spark, d).unionByName(bindings.index_bars(spark, d)))


def completeness(spark, d):
    return tables.completeness(ranks.rps_from_changes(factors.changed(spark, d), (250,)), "rps_250")


def largest_amounts(spark, d):
    return pool.largest(bindings.stock_bars(spark, d), "amount", 3).select("trade_date", "place", "code", "amount")


def last_tick_a_day(spark, d):
    ticks = bindings.event_ticks(spark, d).withColumn("trade_date", F.date_format("ts", "yyyyMMdd"))
    return resample.one_per_time(ticks, ("code", "trade_date"), "event_id", "last").select("code", "trade_date", "event_id", "price")


def amounts_in_units(spark, d):
    return bindings.read(spark, d, "orders").select("o_orderkey", columns.in_units(F.floor(F.col("o_totalprice") / 1000) * 1e6).alias("amount"), columns.unified_volume(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")), F.col("o_custkey")).alias("volume"))


def stored_bars(spark, d):
    """Written by family and year and read back."""
    path = store.fresh_folder(spark, "bars")
    ingest.write_bars(bindings.stock_bars(spark, d).unionByName(bindings.index_bars(spark, d)), path)
    return ingest.read_bars(spark, path, "stock").select("code", "trade_date", "volume", "amount")


def closed_market(spark, d):
    return bindings.read(spark, d, "events").select("event_id", ingest.final_now(F.col("ts").cast("timestamp")).alias("closed"))


def renamed_sectors(spark, d):
    """Sectors after a file that renames those of even nations and adds one."""
    rows = bindings.read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("8803"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"), F.concat(F.lit("new "), "n_name").alias("name"))
    return sectors.import_codes(rows.unionByName(spark.createDataFrame([("881999", "added"), ("123", "bad")], "code string, name string")), bindings.sector_basics(spark, d))


_YH = sql.YEAR_HIGH.format("chg", "close")
_STRONG = f"""{sql.CHANGES}, strong AS (SELECT trade_date, code, row_number() OVER (PARTITION BY trade_date ORDER BY "close" / year_high DESC, code) AS place, round_even("close" / year_high * 100, 1) AS ratio, "close" / year_high >= 0.99 AS touches
  FROM {sql.YEAR_HIGH.format('chg', 'high')} WHERE "close" / year_high >= 0.9 QUALIFY place <= 50)"""
_MAIN = f"{sql.SECTORS}, main AS (SELECT code, sector_name FROM member QUALIFY row_number() OVER (PARTITION BY code ORDER BY stock_count DESC, sector) = 1)"
_STRONG_MAIN = f"{_STRONG}, {_MAIN}, {sql.BASICS}, ss AS (SELECT trade_date, code, coalesce(stock_name, code) AS name, place, coalesce(sector_name, '其他') AS sector_name FROM strong LEFT JOIN main USING (code) LEFT JOIN basics ON code = stock_code)"
_CODE, _DATE = "CAST(code AS INTEGER)", "CAST(trade_date AS INTEGER)"
_MERGED = f"""{sql.BARS}, merged AS (SELECT code, trade_date, volume, CASE WHEN {_DATE} % 3 <> 0 THEN "close" + 1 ELSE "close" END AS "close", {_DATE} % 3 <> 0 AS is_final, strptime(trade_date, '%Y%m%d') + CASE WHEN {_DATE} % 3 <> 0 THEN INTERVAL 16 HOURS ELSE INTERVAL 14 HOURS END AS update_time FROM bars)"""
_SOURCE = f"CASE WHEN ({_CODE} + {_DATE}) % 4 >= 2 THEN 'tdx' WHEN ({_CODE} + {_DATE}) % 4 >= 1 THEN 'akshare' ELSE 'yfinance' END"
_UPSERTED = f'WITH {_MERGED} SELECT code, trade_date, round_even("close", 8) AS "close", is_final FROM merged'
_CAL = "cal AS (SELECT strftime(x, '%Y%m%d') AS trade_date FROM generate_series(DATE '1990-01-01', DATE '2009-12-31', INTERVAL 1 DAY) AS g(x) WHERE isodow(x) <= 5 AND strftime(x, '%m-%d') NOT IN ('01-01', '05-01', '10-01'))"
_EQUITY = f"""{sql.INDEX_BARS}, eq AS (SELECT code AS run_id, trade_date, "close" AS equity FROM ibars),
  dd AS (SELECT *, equity / lag(equity) OVER (PARTITION BY run_id ORDER BY trade_date) - 1 AS r, (equity - max(equity) OVER (PARTITION BY run_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) / max(equity) OVER (PARTITION BY run_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS drawdown FROM eq),
  sums AS (SELECT run_id, count(*) AS n, arg_min(equity, trade_date) AS f, arg_max(equity, trade_date) AS l, min(drawdown) AS dd, avg(r) AS m, stddev_samp(r) AS s, stddev_pop(r) AS sp FROM dd GROUP BY 1)"""
_TICKS = f"ticks AS (SELECT {sql.CODE.format('user_id')} AS code, ts, event_id, value AS price FROM events)"
_TICK_BARS = """first(price ORDER BY ts, event_id) AS "open", max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS "close", count(*) AS n_ticks"""

_CLUSTERS = f"""h AS (SELECT DISTINCT c.trade_date, c.code, chg_pct, chg_20d, amount, coalesce(m.sector_name, '其他') AS sector_name FROM {_YH} c LEFT JOIN (SELECT * FROM member WHERE stock_count >= 5) m ON c.code = m.code WHERE "close" >= year_high),
      p AS (SELECT *, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY chg_20d DESC NULLS LAST, code) AS r20, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY amount DESC, chg_20d DESC NULLS LAST, code) AS ra, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY chg_pct DESC NULLS LAST, code) AS rc FROM h),
      q AS (SELECT *, CASE WHEN ra <= 5 THEN row_number() OVER (PARTITION BY trade_date, sector_name, ra <= 5 ORDER BY chg_20d DESC NULLS LAST, code) END AS rl FROM p),
      o AS (SELECT *, CASE WHEN r20 <= 2 THEN r20 WHEN rl <= 2 THEN 10 + rl ELSE 100 + r20 END AS pick FROM q),
      s AS (SELECT *, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY pick) AS pr FROM o),
      g AS (SELECT trade_date, sector_name, count(*) AS n, round_even(avg(chg_pct), 6) AS avg_chg, string_agg(code, ',' ORDER BY rc) FILTER (rc <= 4) AS representative, string_agg(code, ',' ORDER BY pr) FILTER (pr <= 4) AS core FROM s GROUP BY 1, 2),
      a AS (SELECT trade_date, count(DISTINCT code) AS n_all FROM h GROUP BY 1),
      clusters AS (SELECT trade_date, sector_name, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, sector_name) AS place, n, round_even(n * 100.0::DOUBLE / n_all, 1) AS percent, avg_chg, representative, core FROM g JOIN a USING (trade_date) QUALIFY place <= 5)"""
_OVERVIEW = """p AS (SELECT *, CASE WHEN lag("close") OVER (PARTITION BY code ORDER BY trade_date) > 0 THEN round_even(("close" - lag("close") OVER (PARTITION BY code ORDER BY trade_date)) / lag("close") OVER (PARTITION BY code ORDER BY trade_date) * 100, 2) END AS pct FROM ibars),
      overview AS (SELECT trade_date, code, row_number() OVER (PARTITION BY trade_date ORDER BY pct DESC, code) AS place FROM p WHERE pct IS NOT NULL)"""


def _equity_sql(bars, runs, columns):
    """Each run's purchases on first bars, daily gains rounded to eight places, and their running sum."""
    return f"""WITH {bars}, runs(run_id, lots) AS (VALUES {runs}), m AS (SELECT code, trade_date, "close" AS c, lag("close") OVER w AS b, row_number() OVER w AS i FROM bars_ WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
      d AS (SELECT run_id, trade_date, lots * 100 AS q, i, c, b, (c + 0.01::DOUBLE) * (lots * 100) AS cost FROM m, runs),
      g AS (SELECT run_id, trade_date, sum(CAST(round_even(CASE WHEN i = 1 THEN q * c - (cost + greatest(cost * 3e-4::DOUBLE, 5) + cost * 2e-5::DOUBLE) ELSE q * (c - b) END, 8) AS DECIMAL(28,8))) AS gain FROM d GROUP BY 1, 2)
      SELECT {columns}, round_even(1e9 + CAST(sum(gain) OVER (PARTITION BY run_id ORDER BY trade_date) AS DOUBLE), 2) AS equity FROM g"""


def _analysis_group(column):
    return f"""SELECT '{"price" if column == "close" else column}' AS kind, trade_date, CAST(i * 2 AS INTEGER) AS "lower", count(*) AS n, round_even(avg(chg_pct), 2) AS avg_chg FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY "{column}", code) - 1 AS r, count(*) OVER (PARTITION BY trade_date) AS m FROM shown WHERE chg_pct IS NOT NULL), range(50) AS g(i)
      WHERE r >= CAST(floor(i * (CAST(m AS DOUBLE) / 50.0)) AS BIGINT) AND r < CAST(floor((i + 1) * (CAST(m AS DOUBLE) / 50.0)) AS BIGINT) GROUP BY 2, 3"""


QUERIES = {
    "active_pool": (active_pool, f"""WITH {sql.RANKED}, {sql.EXCLUDED}, {sql.BASICS} SELECT trade_date, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY chg_pct DESC, code) AS INTEGER) AS place, code, coalesce(stock_name, code) AS name, chg_pct, rps_sum, count(*) OVER (PARTITION BY trade_date) AS total
      FROM strength LEFT JOIN basics ON code = stock_code WHERE is_active AND amount > 0 AND code NOT IN (SELECT code FROM excluded) QUALIFY place <= 50"""),
    "strong_by_high": (strong_by_high, f"WITH {_STRONG} SELECT * FROM strong"),
    "strong_by_rps": (strong_by_rps, f"""WITH {sql.RANKED}, {sql.BASICS} SELECT trade_date, code, row_number() OVER (PARTITION BY trade_date ORDER BY rps_sum DESC, code) AS place, rps_sum FROM strength LEFT JOIN basics ON code = stock_code
      WHERE rps_sum > 270 AND coalesce(date_diff('day', strptime(list_date, '%Y%m%d'), strptime(trade_date, '%Y%m%d')), 9999) > 30 QUALIFY place <= 50"""),
    "lateral_ma50": (lateral_ma50, f"""WITH {sql.BARS}, m AS (SELECT *, round_even(avg("close") OVER (PARTITION BY code ORDER BY trade_date ROWS 49 PRECEDING), 6) AS mean_close FROM bars) SELECT code, trade_date, mean_close FROM m WHERE "close" > coalesce(mean_close, 0)"""),
    "market_summary": (market_summary, f"""WITH {sql.CHANGES}, {sql.MEANS} SELECT trade_date, count(*) AS n, count(*) FILTER ("close" > ma50) AS n_above, round_even(count(*) FILTER ("close" > ma50) * 100.0::DOUBLE / count(*), 1) AS percent_above, count(*) FILTER ("close" >= year_high) AS n_new_high FROM {sql.YEAR_HIGH.format('ma', 'close')} GROUP BY 1"""),
    "new_high": (new_high, f"""WITH {sql.CHANGES} SELECT code, trade_date, round_even(year_high, 8) AS year_high FROM {_YH} WHERE "close" >= year_high"""),
    "new_high_clusters": (new_high_clusters, f"""WITH {sql.CHANGES}, {sql.SECTORS}, h AS (SELECT DISTINCT c.trade_date, c.code, chg_pct, chg_20d, amount, coalesce(m.sector_name, '其他') AS sector_name FROM {_YH} c LEFT JOIN (SELECT * FROM member WHERE stock_count >= 5) m ON c.code = m.code WHERE "close" >= year_high),
      p AS (SELECT *, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY chg_20d DESC NULLS LAST, code) AS r20, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY amount DESC, chg_20d DESC NULLS LAST, code) AS ra, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY chg_pct DESC NULLS LAST, code) AS rc FROM h),
      q AS (SELECT *, CASE WHEN ra <= 5 THEN row_number() OVER (PARTITION BY trade_date, sector_name, ra <= 5 ORDER BY chg_20d DESC NULLS LAST, code) END AS rl FROM p),
      o AS (SELECT *, CASE WHEN r20 <= 2 THEN r20 WHEN rl <= 2 THEN 10 + rl ELSE 100 + r20 END AS pick FROM q),
      s AS (SELECT *, row_number() OVER (PARTITION BY trade_date, sector_name ORDER BY pick) AS pr FROM o),
      g AS (SELECT trade_date, sector_name, count(*) AS n, round_even(avg(chg_pct), 6) AS avg_chg, string_agg(code, ',' ORDER BY rc) FILTER (rc <= 4) AS representative, string_agg(code, ',' ORDER BY pr) FILTER (pr <= 4) AS core FROM s GROUP BY 1, 2),
      a AS (SELECT trade_date, count(DISTINCT code) AS n_all FROM h GROUP BY 1)
      SELECT trade_date, sector_name, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, sector_name) AS place, n, round_even(n * 100.0::DOUBLE / n_all, 1) AS percent, avg_chg, representative, core FROM g JOIN a USING (trade_date) QUALIFY place <= 5"""),
    "industry_cluster": (industry_cluster, f"""WITH {_STRONG_MAIN}, g AS (SELECT trade_date, sector_name, count(*) AS n, array_to_string(list(name ORDER BY place, name)[1:10], ',') AS names FROM ss GROUP BY 1, 2), a AS (SELECT trade_date, count(DISTINCT code) AS n_all FROM ss GROUP BY 1)
      SELECT trade_date, sector_name, n, names, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, sector_name) AS place, round_even(n * 100.0::DOUBLE / n_all, 1) AS percent FROM g JOIN a USING (trade_date) QUALIFY place <= 10"""),
    "top_industry": (top_industry, f"WITH {_STRONG_MAIN} SELECT trade_date, sector_name, count(*) AS n FROM ss GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY count(*) DESC, min(place)) = 1"),
    "index_overview": (index_overview, f"""WITH {sql.INDEX_BARS}, p AS (SELECT *, CASE WHEN lag("close") {sql.W} > 0 THEN round_even(("close" - lag("close") {sql.W}) / lag("close") {sql.W} * 100, 2) END AS pct FROM ibars),
      q AS (SELECT trade_date, code, pct, row_number() OVER (PARTITION BY trade_date ORDER BY pct DESC, code) AS place, bool_and(pct > 0) OVER d AS up, bool_and(pct < 0) OVER d AS down, max(pct) OVER d AS best, min(pct) OVER d AS worst, coalesce(max(pct) FILTER (code = '999901') OVER d, 0) AS t, coalesce(max(pct) FILTER (code = '999902') OVER d, 0) AS g, coalesce(max(pct) FILTER (code = '999903') OVER d, 0) AS m, count(*) OVER d AS n FROM p WHERE pct IS NOT NULL WINDOW d AS (PARTITION BY trade_date))
      SELECT trade_date, code, place, pct, max(CASE WHEN place = 1 THEN code END) OVER (PARTITION BY trade_date) AS leader, max(CASE WHEN place = n THEN code END) OVER (PARTITION BY trade_date) AS laggard,
      CASE WHEN place = 1 THEN '表现最强，领先全场' WHEN place = n THEN '表现最弱，明显落后' WHEN pct > 2 THEN '大涨' WHEN pct > 1 THEN '偏强' WHEN pct > 0.5 THEN '小幅上涨' WHEN pct > 0 THEN '窄幅震荡' WHEN pct > -0.5 THEN '小幅回调' WHEN pct > -1 THEN '偏弱' ELSE '大跌' END AS comment, CASE WHEN (t > 1 OR g > 1) AND m <= 1 AND t > g THEN '国产科技主导' WHEN (t > 1 OR g > 1) AND m <= 1 THEN '海外链领涨' WHEN m > 1 AND t <= 1 AND g <= 1 THEN '价值回归' WHEN up THEN '全面做多' WHEN down THEN '全面承压' WHEN best > 0.5 AND worst < -0.5 THEN '结构分化' ELSE '窄幅震荡' END AS style FROM q"""),
    "main_industry": (main_industry, f"WITH {_MAIN} SELECT * FROM main"),
    "all_industries": (all_industries, f"WITH {sql.SECTORS}, {sql.BASICS} SELECT DISTINCT stock_code AS code, coalesce(sector_name, '其他') AS sector_name FROM basics LEFT JOIN (SELECT * FROM member WHERE stock_count >= 5) ON code = stock_code"),
    "sector_index": (sector_index, f"""WITH {sql.CHANGES}, {sql.SECTORS}, s AS (SELECT sector, trade_date, count(*) AS n, avg(chg_pct / 1000) AS c FROM chg JOIN member USING (code) WHERE chg_pct IS NOT NULL GROUP BY 1, 2),
      x AS (SELECT sector, trade_date, n, round_even(c, 8) AS change, round_even(1000 * exp(sum(ln(greatest(1 + c / 100, 1e-9))) OVER (PARTITION BY sector ORDER BY trade_date ROWS UNBOUNDED PRECEDING)), 2) AS p FROM s)
      SELECT sector, trade_date, n, change, round_even(ln(p), 4) AS log_price, round_even(p, 0) AS price FROM x"""),
    "sector_breadth": (sector_breadth, f"""WITH {sql.CHANGES}, {sql.RPS.format('chg')}, {sql.SECTORS} SELECT sector, trade_date, round_even(avg(rps_20), 2) AS avg_rps, count(*) FILTER (chg_pct > 0) AS n_up, count(*) FILTER (chg_pct < 0) AS n_down, count(*) FILTER (chg_pct >= 9.8) AS n_limit_up, count(*) FILTER (chg_pct <= -9.8) AS n_limit_down FROM rps JOIN member USING (code) GROUP BY 1, 2"""),
    "exclusion_anti": (exclusion_anti, f"WITH {sql.BARS}, {sql.EXCLUDED} SELECT code, count(*) AS n FROM bars WHERE code NOT IN (SELECT code FROM excluded) GROUP BY 1"),
    "enabled_semi": (enabled_semi, f"WITH {sql.BARS}, {sql.EXCLUDED} SELECT code, count(*) AS n FROM bars WHERE code IN (SELECT code FROM excluded) GROUP BY 1"),
    "new_listings": (new_listings, f"WITH {sql.BARS}, {sql.BASICS} SELECT stock_code AS code, list_date FROM basics WHERE stock_code NOT IN (SELECT code FROM bars WHERE trade_date < '19950106')"),
    "name_lookup": (name_lookup, f"WITH {sql.BARS}, {sql.BASICS} SELECT code, coalesce(stock_name, code) AS name, trade_date FROM bars LEFT JOIN basics ON code = stock_code WHERE trade_date = (SELECT max(trade_date) FROM bars)"),
    "union_families": (union_families, f"WITH {sql.BARS}, {sql.OWNED}, {sql.SECTOR_BARS.removeprefix(f'{sql.TRADES}, {sql.OWNED}, ')}, {sql.INDEX_BARS.removeprefix(f'{sql.TRADES}, {sql.OWNED}, ')} SELECT data_type, code, trade_date, volume FROM bars UNION ALL SELECT data_type, code, trade_date, volume FROM sbars UNION ALL SELECT data_type, code, trade_date, volume FROM ibars"),
    "latest_common_date": (latest_common_date, f"WITH {sql.BARS}, {sql.OWNED}, {sql.SECTOR_BARS.removeprefix(f'{sql.TRADES}, {sql.OWNED}, ')} SELECT least((SELECT max(trade_date) FROM bars), (SELECT max(trade_date) FROM sbars)) AS trade_date"),
    "previous_date": (previous_date, f"WITH {sql.BARS} SELECT max(trade_date) AS trade_date FROM bars WHERE trade_date < '{TODAY}'"),
    "last_bars": (last_bars, f"WITH {sql.BARS} SELECT code, trade_date, volume FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 260"),
    "bubbles": (bubbles, f"WITH {sql.ALL}, {sql.BASICS}, d AS (SELECT *, " + ", ".join(f'CAST(round_even({sql.average_place(f'"{c}"', "count(*) OVER (PARTITION BY trade_date)")} * 100, 0) AS INTEGER) AS {c}_pct' for c in ("close", "amount")) + " FROM strength) SELECT trade_date, code, coalesce(stock_name, code) AS name, rps_20 AS rps, close_pct, amount_pct, chg_pct FROM d LEFT JOIN basics ON code = stock_code WHERE rps_20 IS NOT NULL AND chg_pct IS NOT NULL"),
    "sector_bubbles": (sector_bubbles, f"""WITH {sql.SECTOR_BARS}, chg AS (SELECT *, {sql.change(1)} AS chg_pct, {', '.join(f'{sql.change(p)} AS chg_{p}d' for p in (10, 20, 50))} FROM sbars), r AS (SELECT *, {', '.join(f'{sql.rps(p)} AS rps_{p}' for p in (10, 20, 50))} FROM chg), c AS (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM r QUALIFY n >= 5),
      d AS (SELECT *, """ + ", ".join(f'CAST(round_even({sql.average_place(f'"{c}"', "n")} * 100, 0) AS INTEGER) AS {c}_pct' for c in ("close", "amount")) + """ FROM c) SELECT trade_date, code, coalesce(n_name, code) AS name, coalesce(nullif(CAST(rps_20 AS DOUBLE), 0), 50) AS rps, coalesce(nullif(CAST(close_pct AS DOUBLE), 0), 50) AS close_pct, coalesce(nullif(CAST(amount_pct AS DOUBLE), 0), 50) AS amount_pct, coalesce(chg_pct, 0) AS chg_pct, rps_10, rps_20, rps_50, row_number() OVER (PARTITION BY trade_date ORDER BY coalesce(nullif(CAST(amount_pct AS DOUBLE), 0), 50), code) AS place FROM d LEFT JOIN nation ON code = '8803' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') WHERE n_nationkey % 8 <> 5"""),
    "rps_at_least": (rps_at_least, f"WITH {sql.CHANGES}, {sql.RPS.format('chg')} SELECT code, trade_date, rps_20, rps_250 FROM rps WHERE greatest(rps_20, rps_50, rps_120, rps_250) >= 90"),
    "search": (search, f"WITH {sql.BASICS} SELECT stock_code, stock_name, market FROM basics WHERE contains(stock_code, '0007') OR contains(lower(stock_name), '0007') ORDER BY 1 LIMIT 50"),
    "sector_page": (sector_page, f"WITH {sql.SECTORS}, s AS (SELECT sector AS code, sector_name AS name, CAST(count(*) AS INTEGER) AS stock_count FROM member GROUP BY 1, 2 HAVING count(*) >= 5) SELECT *, (SELECT count(*) FROM s) AS total FROM s ORDER BY code OFFSET 3 LIMIT 3"),
    "code_normalise": (code_normalise, f"WITH {sql.BASICS} SELECT stock_code, stock_code AS bare, stock_code || CASE WHEN stock_code[1] IN ('6', '9') THEN '.SH' WHEN stock_code[1] IN ('4', '8') THEN '.BJ' ELSE '.SZ' END AS suffixed, CASE WHEN stock_code[1:2] = '88' THEN 'sector' WHEN stock_code[1:2] IN ('00', '30', '60', '68') THEN 'stock' ELSE 'index' END AS family, length(stock_code) = 6 AND stock_code[1:2] IN ('00', '30', '60', '68') AS listed FROM basics"),
    "upsert_latest": (upsert_latest, _UPSERTED),
    "partial_update": (partial_update, f"WITH {sql.BARS} SELECT code, trade_date, CASE WHEN {_CODE} % 2 = 0 THEN volume * 2 ELSE volume END AS volume FROM bars"),
    "is_final_patch": (is_final_patch, f"WITH {sql.BARS} SELECT code, trade_date, trade_date < '{TODAY}' AS is_final, trade_date < '{TODAY}' AS changed FROM bars"),
    "freshness": (freshness, f"WITH {_MERGED} SELECT trade_date, bool_and(is_final) AS all_final, max(update_time) AS last_update, CASE WHEN bool_and(is_final) THEN 'b' ELSE 'a' END AS sources FROM merged GROUP BY 1"),
    "sync_start": (sync_start, f"WITH {_MERGED}, l AS (SELECT code, max(trade_date) AS last_date FROM merged GROUP BY 1) SELECT code, last_date, strftime(strptime(last_date, '%Y%m%d') + CASE WHEN CAST(last_date AS INTEGER) % 3 <> 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END, '%Y%m%d') AS resume_date FROM l"),
    "source_priority": (source_priority, f"WITH {sql.BARS} SELECT code, trade_date, volume, {_SOURCE} AS data_source FROM bars"),
    "source_counts": (source_counts, f"WITH {sql.BARS} SELECT {_SOURCE} AS data_source, count(*) AS n FROM bars GROUP BY 1"),
    "workdays": (workdays, f"WITH {_CAL} SELECT trade_date FROM cal WHERE trade_date[:4] BETWEEN (SELECT strftime(min(o_orderdate), '%Y') FROM orders) AND (SELECT strftime(max(o_orderdate), '%Y') FROM orders)"),
    "bars_on_workdays": (bars_on_workdays, f"WITH {sql.BARS}, {_CAL} SELECT code, count(*) AS n FROM bars JOIN cal USING (trade_date) GROUP BY 1"),
    "suspended": (suspended, f"WITH {sql.BARS}, {_CAL}, l AS (SELECT code, max(trade_date) AS last_date FROM bars WHERE trade_date <= '19981215' GROUP BY 1), m AS (SELECT code, last_date, (SELECT count(*) FROM cal WHERE trade_date <= '19981215') - coalesce((SELECT count(*) FROM cal WHERE trade_date <= last_date AND last_date IN (SELECT trade_date FROM cal)), 0) AS missed FROM l) SELECT * FROM m WHERE missed >= 3"),
    "listed_long_enough": (listed_long_enough, f"WITH {sql.BARS}, {sql.BASICS} SELECT DISTINCT code FROM bars JOIN basics ON code = stock_code WHERE coalesce(date_diff('day', strptime(list_date, '%Y%m%d'), DATE '1996-01-05'), 9999) >= 365"),
    "quality_filter": (quality_filter, f'WITH {sql.BARS} SELECT code, count(*) AS n FROM bars WHERE {_CODE} % 5 <> 0 AND trade_date >= \'20000101\' AND high <= 100000 AND low > 0 GROUP BY 1'),
    "volume_fill": (volume_fill, f'WITH {sql.BARS} SELECT code, trade_date, CASE WHEN {_DATE} % 2 = 0 THEN round_even(amount / "close", 2) ELSE volume END AS volume FROM bars'),
    "drawdown": (drawdown, f"WITH {_EQUITY} SELECT run_id, trade_date, round_even(drawdown, 6) AS drawdown FROM dd"),
    "sharpe_annual": (sharpe_annual, f"WITH {_EQUITY} SELECT run_id, n AS n_days, round_even(l / f - 1, 6) AS total_return, round_even(pow(1 + (l / f - 1), 252.0::DOUBLE / n) - 1, 6) AS annual_return, round_even(dd, 6) AS max_drawdown, round_even(CASE WHEN s > 0 THEN (m - 0.03::DOUBLE / 252) / s * sqrt(252.0::DOUBLE) ELSE 0 END, 6) AS sharpe FROM sums"),
    "quick_metrics": (quick_metrics, f"WITH {_EQUITY} SELECT run_id, round_even(l / f - 1, 6) AS total_return, round_even((l / f - 1) * 365 / n, 6) AS annual_return, round_even(-dd, 6) AS max_drawdown, round_even(m / (sp + 1e-6) * sqrt(252.0::DOUBLE), 6) AS sharpe FROM sums"),
    "fee_table": (fee_table, "SELECT o_orderkey, round_even(greatest(o_totalprice * 3e-4::DOUBLE, 5), 6) AS commission, round_even(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2e-5::DOUBLE ELSE 0 END, 6) AS transfer, round_even(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice * 5e-4::DOUBLE ELSE 0 END, 6) AS stamp FROM orders"),
    "backtest_equity": (backtest_equity, f"""WITH {sql.INDEX_BARS}, b AS (SELECT *, first_value("close") {sql.W} + 0.01 AS p FROM ibars), first AS (SELECT code, min(trade_date) AS f, arg_min("close", trade_date) + 0.01 AS p FROM ibars GROUP BY 1),
      days AS (SELECT DISTINCT trade_date FROM ibars), grid AS (SELECT d.trade_date, f.code, f.f, f.p, last_value(b."close" IGNORE NULLS) OVER (PARTITION BY f.code ORDER BY d.trade_date ROWS UNBOUNDED PRECEDING) AS c FROM days d CROSS JOIN first f LEFT JOIN ibars b ON b.code = f.code AND b.trade_date = d.trade_date)
      SELECT trade_date, round_even(1e9 + sum(CASE WHEN trade_date >= f THEN 100 * c - (100 * p + greatest(100 * p * 3e-4::DOUBLE, 5) + 100 * p * 2e-5::DOUBLE) ELSE 0 END), 2) AS equity FROM grid GROUP BY 1"""),
    "backtest_equity_stocks": (backtest_equity_stocks, _equity_sql(f"{sql.BARS}, bars_ AS (SELECT * FROM bars)", "('lots1', 1), ('lots2', 2), ('lots5', 5)", "run_id, trade_date")),
    "backtest_trades": (backtest_trades, f"""WITH {sql.BARS}, f AS (SELECT code, min(trade_date) AS trade_date, arg_min("close", trade_date) + 0.01::DOUBLE AS price FROM bars GROUP BY 1)
      SELECT run_id, trade_date, code, 'BUY' AS direction, CAST(lots * 100 AS BIGINT) AS quantity, round_even(price, 6) AS price, round_even(greatest(price * (lots * 100) * 3e-4::DOUBLE, 5) + price * (lots * 100) * 2e-5::DOUBLE, 6) AS fees FROM f, (VALUES ('lots1', 1), ('lots2', 2), ('lots5', 5)) AS r(run_id, lots)"""),
    "market_analysis": (market_analysis, f"""WITH {sql.CHANGES}, {sql.RPS.format('chg')}, {sql.EXCLUDED}, shown AS (SELECT * FROM rps WHERE code NOT IN (SELECT code FROM excluded) AND amount > 0)
      SELECT 'rps' AS kind, trade_date, CAST((greatest(ceil(rps_20 / 2), 1) - 1) * 2 AS INTEGER) AS "lower", count(*) AS n, round_even(avg(chg_pct), 2) AS avg_chg FROM shown WHERE rps_20 > 0 AND chg_pct IS NOT NULL GROUP BY 2, 3
      UNION ALL {_analysis_group("amount")} UNION ALL {_analysis_group("close")}"""),
    "market_signals": (market_signals, f"""WITH {sql.ALL}, {sql.SECTORS}, {sql.BASICS}, {_CLUSTERS}, m AS (SELECT trade_date, count(*) AS n, round_even(count(*) FILTER ("close" > ma50) * 100.0::DOUBLE / count(*), 1) AS percent_above, count(*) FILTER ("close" >= year_high) AS n_new_high FROM {sql.YEAR_HIGH.format('ma', 'close')} GROUP BY 1),
      t AS (SELECT trade_date, least(count(*), 50) AS n_strong FROM strength LEFT JOIN basics ON code = stock_code WHERE rps_sum > 270 AND coalesce(date_diff('day', strptime(list_date, '%Y%m%d'), strptime(trade_date, '%Y%m%d')), 9999) > 30 GROUP BY 1)
      SELECT trade_date, m.n, percent_above, n_new_high, coalesce(n_strong, 0) AS n_strong, c.sector_name AS top_sector, c.n AS top_n, CASE WHEN percent_above >= 70 THEN '强势' WHEN percent_above >= 50 THEN '偏强' WHEN percent_above >= 35 THEN '分化' ELSE '弱势' END AS state, CASE WHEN c.percent > 10 THEN 'block' WHEN n_new_high > 100 THEN 'many' ELSE 'few' END AS effect, concat_ws(' ', state, format('{{:+.1f}}', percent_above), n_new_high, effect) AS text
      FROM m LEFT JOIN t USING (trade_date) LEFT JOIN (SELECT * FROM clusters WHERE place = 1) c USING (trade_date)"""),
    "review_response": (review_response, f"""WITH {sql.ALL}, {sql.SECTORS}, {sql.BASICS}, {_CLUSTERS}, m AS (SELECT trade_date, count(*) AS n, round_even(count(*) FILTER ("close" > ma50) * 100.0::DOUBLE / count(*), 1) AS percent_above, count(*) FILTER ("close" >= year_high) AS n_new_high FROM {sql.YEAR_HIGH.format('ma', 'close')} GROUP BY 1),
      t AS (SELECT trade_date, code, row_number() OVER (PARTITION BY trade_date ORDER BY rps_sum DESC, code) AS place, rps_sum FROM strength LEFT JOIN basics ON code = stock_code WHERE rps_sum > 270 AND coalesce(date_diff('day', strptime(list_date, '%Y%m%d'), strptime(trade_date, '%Y%m%d')), 9999) > 30 QUALIFY place <= 50),
      st AS (SELECT trade_date, count(*) AS n_strong, list({{'place': place, 'code': code, 'rps_sum': rps_sum}} ORDER BY place) AS strong FROM t GROUP BY 1),
      sc AS (SELECT trade_date, list({{'place': place, 'sector_name': sector_name, 'n': n, 'percent': percent, 'representative': string_split(representative, ','), 'core': string_split(core, ',')}} ORDER BY place) AS clusters FROM clusters GROUP BY 1),
      e AS (SELECT m.*, coalesce(n_strong, 0) AS n_strong, CASE WHEN percent_above >= 70 THEN '强势' WHEN percent_above >= 50 THEN '偏强' WHEN percent_above >= 35 THEN '分化' ELSE '弱势' END AS state, CASE WHEN c.percent > 10 THEN 'block' WHEN n_new_high > 100 THEN 'many' ELSE 'few' END AS effect, coalesce(strong, []) AS strong, coalesce(sc.clusters, []) AS clusters
        FROM m LEFT JOIN st USING (trade_date) LEFT JOIN (SELECT * FROM clusters WHERE place = 1) c USING (trade_date) LEFT JOIN sc USING (trade_date))
      SELECT trade_date, CAST(to_json({{'signal': {{'n': n, 'n_new_high': n_new_high, 'n_strong': n_strong, 'state': state, 'effect': effect}}, 'strong': strong, 'clusters': clusters}}) AS VARCHAR) AS body FROM e"""),
    "full_review": (full_review, f"""WITH {_STRONG_MAIN}, {sql.OWNED}, {sql.INDEX_BARS.removeprefix(f'{sql.TRADES}, {sql.OWNED}, ')}, {_OVERVIEW},
      c AS (SELECT trade_date, sector_name, count(*) AS n FROM ss GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY n DESC, sector_name) AS place FROM c QUALIFY place <= 10)
      SELECT coalesce(x.trade_date, y.trade_date, z.trade_date) AS trade_date, indices, stocks, sectors FROM (SELECT trade_date, string_agg(code, ',' ORDER BY place) AS indices FROM overview GROUP BY 1) x
      FULL JOIN (SELECT trade_date, string_agg(code, ',' ORDER BY place) AS stocks FROM strong GROUP BY 1) y USING (trade_date) FULL JOIN (SELECT trade_date, string_agg(sector_name, ',' ORDER BY place) AS sectors FROM g GROUP BY 1) z USING (trade_date)"""),
    "day_table": (day_table, f"WITH {factors._BREADTH} SELECT * FROM breadth"),
    "chg_on_date": (chg_on_date, f"WITH {sql.CHANGES} SELECT code, trade_date, chg_pct, chg_20d, chg_250d FROM chg WHERE trade_date = (SELECT max(trade_date) FROM bars)"),
    "recompute_horizon": (recompute_horizon, f"WITH {sql.BARS} SELECT code, trade_date FROM bars QUALIFY trade_date >= '{TODAY}' OR row_number() OVER (PARTITION BY code, trade_date < '{TODAY}' ORDER BY trade_date DESC) <= 250"),
    "index_list": (index_list, "WITH k AS (SELECT '99990' || CAST(r_regionkey AS VARCHAR) AS code, r_name AS name, 0 AS o FROM region UNION ALL SELECT '9999' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), n_name, 1 FROM nation) SELECT code, arg_min(name, o) AS name FROM k WHERE code NOT IN (SELECT '9999' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation WHERE n_nationkey % 3 = 0) GROUP BY 1"),
    "sector_list": (sector_list, f"""WITH {sql.SECTOR_BARS}, {sql.SECTORS}, chg AS (SELECT *, {', '.join(f'{sql.change(p)} AS chg_{p}d' for p in (10, 20, 50))} FROM sbars WHERE "close" > 0), rps AS (SELECT *, {', '.join(f'{sql.rps(p)} AS rps_{p}' for p in (10, 20, 50))} FROM chg),
      s AS (SELECT sector AS code, sector_name AS name, CAST(count(*) AS INTEGER) AS stock_count FROM member GROUP BY 1, 2) SELECT code, name, stock_count, r.trade_date, rps_10, rps_20, rps_50 FROM s LEFT JOIN (SELECT * FROM rps QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1) r USING (code)"""),
    "first_by_name": (first_by_name, """SELECT n_name AS name, coalesce(r_name, CAST(n_nationkey AS VARCHAR)) AS code, CAST(CASE WHEN r_name IS NULL THEN 1 ELSE 0 END AS INTEGER) AS "list" FROM nation LEFT JOIN region ON n_name = 'NATION_' || CAST(r_regionkey AS VARCHAR)"""),
    "supported_codes": (supported_codes, "SELECT s_nationkey AS code FROM supplier WHERE s_acctbal >= 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0"),
    "exclusions_changed": (exclusions_changed, f"SELECT 'stock' AS category, {sql.CODE.format('s_suppkey')} AS code, s_name AS name, TRUE AS exclude_sync FROM supplier WHERE s_acctbal < 0 AND s_suppkey % 2 = 1 UNION ALL SELECT 'sector', '8803' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), n_name, FALSE FROM nation"),
    "price_earnings": (price_earnings, "SELECT event_id AS code, round_even(CAST(props->>'$.k' AS DOUBLE) / 7, 2) AS pe_ttm FROM events"),
    "stock_history": (stock_history, f"""WITH {sql.BARS} SELECT trade_date, round_even("close", 8) AS "close" FROM bars WHERE code = '000003' AND trade_date BETWEEN '19960101' AND '20001231'"""),
    "stored_dates": (stored_dates, f"WITH {sql.BARS} SELECT count(*) > 0 AS has_bars FROM bars WHERE code = '000003' AND trade_date BETWEEN '19960101' AND '19961231'"),
    "one_ma": (one_ma, f"WITH {sql.CHANGES}, {sql.MEANS} SELECT code, trade_date, ma20 AS ma FROM ma WHERE code = '000003' QUALIFY row_number() OVER (ORDER BY trade_date DESC) = 1"),
    "abnormal_share": (abnormal_share, f"""WITH {sql.BARS} SELECT code, round_even(avg(CASE WHEN {_CODE} * {_DATE} % 3 = 0 OR "close" > 100000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS abnormal, avg(CASE WHEN {_CODE} * {_DATE} % 3 = 0 OR "close" > 100000 THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AS fetch_again FROM bars GROUP BY 1"""),
    "emptied_ranks": (emptied_ranks, f"WITH {sql.CHANGES} SELECT code, trade_date, chg_pct, CAST(NULL AS DOUBLE) AS chg_20d, CAST(NULL AS INTEGER) AS rps_20 FROM chg"),
    "row_counts": (row_counts, f"WITH {sql.BARS}, {sql.OWNED}, {sql.INDEX_BARS.removeprefix(f'{sql.TRADES}, {sql.OWNED}, ')} SELECT data_type, count(*) AS n_rows, count(DISTINCT code) AS n_codes FROM (SELECT data_type, code FROM bars UNION ALL SELECT data_type, code FROM ibars) GROUP BY 1"),
    "completeness": (completeness, f"WITH {sql.CHANGES}, {sql.RPS.format('chg')} SELECT trade_date, count(*) AS n_rows, count(*) FILTER (rps_250 >= 0) AS n_ranked FROM rps GROUP BY 1"),
    "largest_amounts": (largest_amounts, f"WITH {sql.BARS} SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, code) AS place, code, amount FROM bars QUALIFY place <= 3"),
    "last_tick_a_day": (last_tick_a_day, f"WITH {_TICKS} SELECT code, strftime(ts, '%Y%m%d') AS trade_date, event_id, price FROM ticks QUALIFY row_number() OVER (PARTITION BY code, strftime(ts, '%Y%m%d') ORDER BY event_id DESC) = 1"),
    "amounts_in_units": (amounts_in_units, "WITH o AS (SELECT *, floor(o_totalprice / 1000) * 1e6::DOUBLE AS v FROM orders) SELECT o_orderkey, CASE WHEN v >= 1e8 THEN printf('%.2f亿', v / 1e8) WHEN v >= 1e4 THEN printf('%.2f万', v / 1e4) ELSE printf('%.2f', v) END AS amount, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey * 100 END AS volume FROM o"),
    "stored_bars": (stored_bars, f"WITH {sql.BARS} SELECT code, trade_date, volume, amount FROM bars"),
    "closed_market": (closed_market, "SELECT event_id, hour(ts + INTERVAL 8 HOURS) * 60 + minute(ts + INTERVAL 8 HOURS) >= 900 AS closed FROM events"),
    "renamed_sectors": (renamed_sectors, f"""WITH {sql.SECTORS}, s AS (SELECT sector AS code, sector_name AS name, CAST(count(*) AS INTEGER) AS stock_count FROM member GROUP BY 1, 2), e AS (SELECT '8803' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, 'new ' || n_name AS name FROM nation WHERE n_nationkey % 2 = 0)
      SELECT code, coalesce(e.name, s.name) AS name, stock_count FROM s LEFT JOIN e USING (code) UNION ALL SELECT code, name, 0 FROM e WHERE code NOT IN (SELECT code FROM s) UNION ALL SELECT '881999', 'added', 0"""),
}
