"""Sources, holidays, code forms, ranks of pages and periods against plain loops; empty tables give no rows."""

import pytest
from pyspark.sql import functions as F

from ticktide.functions import columns
from ticktide.operators import backtest, ingest, pool, resample, review, tables

BAR = "data_type string, code string, trade_date string, open double, high double, low double, close double, volume double, amount double"


def bars(spark, rows):
    return spark.createDataFrame([("stock", c, d, p, p, p, p, 1.0, 1.0) for c, d, p in rows], BAR)


def test_an_unsound_batch_makes_room_for_the_next_source(spark):
    of = lambda name, *prices: bars(spark, [("600001", f"2024010{i}", p) for i, p in enumerate(prices, 1)]).withColumn("data_source", F.lit(name))
    batches = of("tdx", -1.0, None, 3.0).unionByName(of("akshare", 5.0, -1.0)).unionByName(of("other", 7.0, 8.0))
    found = ingest.first_sound(batches, {"tdx": 1, "akshare": 2})
    assert [(r.data_source, r.close) for r in found.collect()] == [("akshare", 5.0)]  # half may be wrong; what is wrong goes
    assert ingest.first_sound(of("tdx", -1.0, -2.0), {"tdx": 1}).count() == 0 and ingest.first_sound(batches.limit(0), {"tdx": 1}).count() == 0


def test_holidays_of_the_first_table_that_has_a_year(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "year int, dates array<string>")
    found = ingest.first_holidays(table((2023, ["05-01", "01-01"]), (2024, [])), table((2023, ["10-01"]), (2024, ["02-10"]), (2025, None)))
    assert {r.year: r.dates for r in found.collect()} == {2023: ["01-01", "05-01"], 2024: ["02-10"]}


def test_a_tables_codes_are_brought_together(spark):
    rows = [("sh600001", "20240102", 1.0, False, 1), ("600001.SH", "20240102", 2.0, True, 0), ("1#600001", "20240103", 3.0, False, 5), ("600001", "20240103", 4.0, False, 6), ("SECTOR_880301", "20240102", 5.0, True, 1), ("avg_price", "20240102", 6.0, True, 1), ("399001", "20240102", 7.0, True, 1)]
    table = spark.createDataFrame(rows, "code string, trade_date string, close double, is_final boolean, update_time long")
    assert {(r.data_type, r.code, r.trade_date, r.close) for r in ingest.unified(table).collect()} == {("stock", "600001", "20240102", 2.0), ("stock", "600001", "20240103", 4.0), ("sector", "880301", "20240102", 5.0), ("sector", "880003", "20240102", 6.0), ("index", "399001", "20240102", 7.0)}
    assert ingest.unified(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def shown(spark):
    stock = spark.createDataFrame([("stock", "600001", "20240102", 91, 5, 1.0), ("stock", "600001", "20240105", 10, 6, 2.0), ("stock", "600001", "20240108", 20, 7, 3.0), ("stock", "000002", "20240102", 3, 90, None)], "data_type string, code string, trade_date string, rps_20 int, rps_250 int, chg_20d double")
    sector = spark.createDataFrame([("sector", "880301", "20240102", 95, 1)], "data_type string, code string, trade_date string, rps_10 int, rps_20 int")
    return pool.shown_ranks(stock, sector)


def test_ranks_of_a_date(shown):
    assert {(r.code, r.total) for r in pool.ranks_on(shown, "20240102", 90).collect()} == {("600001", 3), ("000002", 3), ("880301", 3)}
    assert {r.code for r in pool.ranks_on(shown, "20240102", 92).collect()} == {"880301"} and pool.ranks_on(shown, "20200101").count() == 0


def test_ranks_of_a_code(shown):
    of = lambda *a: [(r.trade_date, r.rps_20) for r in pool.ranks_of(shown, *a).collect()]
    assert of("600001") == [("20240102", 91), ("20240105", 10), ("20240108", 20)]
    assert of("600001", "week") == [("20240102", 10), ("20240108", 20)] and of("600001", "month") == [("20240102", 20)]
    assert of("600001", "day", "20240103", "20240106") == [("20240105", 10)] and of("600999", "week") == []


def test_recent_dates(spark):
    table = bars(spark, [("1", f"202401{d:02d}", None if d == 20 else 1.0) for d in range(1, 21)])
    assert [(r.trade_date, r.place) for r in pool.recent_dates(table, 3).orderBy("place").collect()] == [("20240119", 1), ("20240118", 2), ("20240117", 3)]


@pytest.mark.parametrize(("period", "ends"), [("day", ["20240229", "20241230", "20241231"]), ("week", ["20240303", "20250105", "20250105"]), ("month", ["20240229", "20241231", "20241231"]), ("quarter", ["20240331", "20241231", "20241231"]), ("year", ["20241231"] * 3)])
def test_ends_of_periods(spark, period, ends):
    df = spark.createDataFrame([("20240229",), ("20241230",), ("20241231",)], "trade_date string")
    assert [r.e for r in df.select(columns.period_end(F.col("trade_date"), period).alias("e")).collect()] == ends


def test_periods_are_in_the_order_of_their_ends(spark):
    series = spark.createDataFrame([("s", d, float(i)) for i, d in enumerate(["20241220", "20241230", "20250102", "20250110"])], "data_type string, trade_date string, share double")
    found = resample.in_order(resample.last_of_period(series, "week", "share"), "week")
    assert sorted((r.nth, r.period, r.share) for r in found.collect()) == [(1, "2024W51", 0.0), (2, "2025W01", 2.0), (3, "2025W02", 3.0)]


def test_a_page_of_a_date(spark):
    held = spark.createDataFrame([("stock", c, "20240102", 10.0 + i, 100.0 * i, 1.0, 2 * i + 1) for i, c in enumerate("abc")] + [("stock", "a", "20240101", 1.0, 1.0, 1.0, 1)], "data_type string, code string, trade_date string, close double, amount double, chg_pct double, rps_20 int")
    parts = review.market_tables(tables.rps_bins(held), tables.quantile_groups(held, "amount"), tables.quantile_groups(held, "close"))
    bubbles = held.select("trade_date", "code", F.col("rps_20").alias("rps"))
    fresh = tables.freshness(held.withColumns({"is_final": F.lit(True), "update_time": F.lit(5), "data_source": F.lit("x")}))
    (page,) = review.market_page("20240102", parts, bubbles, fresh).collect()
    assert page.n_nodes == 3 and [x.code for x in page.nodes] == ["a", "b", "c"] and page.all_final and page.sources == "x"
    assert [(x.lower, x.n) for x in page.rps_stats] == [(0, 1), (2, 1), (4, 1)] and sum(x.n for x in page.amount_stats) == 3
    assert review.market_page("20300101", parts, bubbles, fresh).count() == 0


def test_too_many_runs_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(backtest, "MOST_RUNS", 2)
    prices = bars(spark, [("1", "20240102", 2.0)])
    runs = lambda n: spark.range(n).select(F.col("id").cast("string").alias("run_id"), F.lit(1).alias("lots"))
    assert backtest.first_purchases(prices, runs(2)).count() == 2
    with pytest.raises(ValueError, match="more than 2"):
        backtest.first_purchases(prices, runs(3))
