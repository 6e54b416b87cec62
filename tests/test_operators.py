"""Hand-computed figures, edge cases and properties of the bar operators."""

import struct

import pytest
from pyspark.sql import functions as F

from ticktide.functions import columns, parsing
from ticktide.operators import backtest, concentration, ingest, pool, ranks, resample, review, sectors, tables, windows
from ticktide.streaming import bars as streams

BAR = "data_type string, code string, trade_date string, open double, high double, low double, close double, volume double, amount double"


def bars(spark, closes, code="000001", family="stock"):
    """Daily bars from 2024-01-01 on; None leaves a date out."""
    import datetime as dt

    rows = [(family, code, (dt.date(2024, 1, 1) + dt.timedelta(i)).strftime("%Y%m%d"), c, c, c, c, 100.0, 100.0 * c) for i, c in enumerate(closes) if c is not None]
    return spark.createDataFrame(rows, BAR)


def one(df, *names):
    rows = df.orderBy("trade_date").collect()
    return [r[names[0]] if len(names) == 1 else tuple(r[n] for n in names) for r in rows]


def test_changes(spark):
    assert one(windows.period_changes(bars(spark, [10.0, 11.0, 9.9]), (2,)), "chg_pct", "chg_2d") == [(None, None), (10.0, None), (-10.0, -1.0)]


def test_means_need_full_windows(spark):
    made = windows.moving_averages(bars(spark, [float(i) for i in range(1, 11)]), (10,), ())
    assert one(made, "ma10") == [None] * 9 + [5.5]
    assert one(windows.moving_averages(bars(spark, [1.0, 3.0]), (10,), (), full=False), "ma10") == [1.0, 2.0]


def test_volume_mean_guards(spark):
    some = bars(spark, [1.0] * 5).withColumn("volume", F.when(F.col("trade_date") == "20240105", 0.0).otherwise(F.col("volume")))
    assert one(windows.moving_averages(some, (), (5,)), "vol_ma5")[-1] is None
    assert one(windows.moving_averages(some, (), (5,), "sum"), "vol_ma5")[-1] == 80.0


def on_a_date(spark, column, values):
    return spark.createDataFrame([("stock", f"{i:06d}", "20240101", v) for i, v in enumerate(values)], f"data_type string, code string, trade_date string, {column} double")


def test_ordinal_rps(spark):
    made = ranks.rps_from_changes(on_a_date(spark, "chg_20d", [-5.0, 1.0, 3.0, 10.0, 0.0, None]), (20,))
    assert [r.rps_20 for r in made.orderBy("code").collect()] == [25, 50, 75, 100, None, None]
    assert [r.rps_20 for r in ranks.rps_from_changes(on_a_date(spark, "chg_20d", [0.0, 2.0]), (20,), invalid=1).orderBy("code").collect()] == [1, 100]


def test_percentiles_with_ties(spark):
    of = on_a_date(spark, "close", [1.0, 2.0, 2.0, 4.0])
    assert [r.close_pct for r in ranks.percentiles(of, ("close",), 1).orderBy("code").collect()] == [25, 62, 62, 100]
    assert ranks.percentiles(of, ("close",)).count() == 0


def test_top_share(spark):
    made = concentration.top_share(on_a_date(spark, "amount", [10.0] * 5 + [1.0] * 95), places=4).first()
    assert made.share == 34.4828
    assert concentration.top_share(on_a_date(spark, "amount", [1.0] * 99)).count() == 0


def test_strength(spark):
    made = ranks.strength_sum(spark.createDataFrame([(95, 90, 80, 92, 5.5), (95, 90, None, None, 9.0)], "rps_20 int, rps_50 int, rps_120 int, rps_250 int, chg_pct double")).collect()
    assert [(r.rps_sum, r.is_active) for r in made] == [(277, True), (None, False)]


def test_calendar_changes_carry_closes(spark):
    both = bars(spark, [5.0, None, 6.0]).unionByName(bars(spark, [1.0, 1.0, 1.0], "000002"))
    made = windows.calendar_changes(both, (1,)).where("code = '000001'")
    assert [None if x is None else round(x, 9) for x in one(made, "chg1")] == [None, 0.0, 0.2]


def test_scaled_index_and_rescale(spark):
    assert one(windows.first_value_scaled(bars(spark, [100.0, 110.0])), "scaled") == [50.0, 60.0]
    assert one(tables.rescaled(bars(spark, [1.0, 2.0, 3.0]), "close"), "rescaled") == [20.0, 50.0, 80.0]
    assert one(tables.rescaled(bars(spark, [2.0, 2.0]), "close"), "rescaled") == [20.0, 20.0]


def test_period_keys(spark):
    df = spark.createDataFrame([("20241230",)], "d string")
    keys = df.select(*[columns.period_key(F.col("d"), p).alias(p) for p in ("day", "week", "month", "quarter", "year")]).first()
    assert tuple(keys) == ("20241230", "2025W01", "2024-12", "2024Q4", "2024")


def test_resampled_days_are_the_bars(spark):
    some = bars(spark, [1.0, 3.0, 2.0])
    assert one(resample.ohlc(some, "day"), "open", "high", "low", "close") == [(c, c, c, c) for c in (1.0, 3.0, 2.0)]
    assert one(resample.ohlc(some, "year"), "open", "high", "low", "close", "volume") == [(1.0, 3.0, 1.0, 2.0, 300.0)]


def test_scaling_prices_changes_no_factor(spark):
    closes = [1.0 + (i * 7 % 13) / 10 for i in range(30)]
    a, b = (windows.period_changes(bars(spark, [c * k for c in closes]), (5,)) for k in (1, 8))
    assert one(a, "chg_pct", "chg_5d") == one(b, "chg_pct", "chg_5d")


def test_macd_seeds(spark):
    closes = [float(i % 5 + 1) for i in range(40)]
    first = one(windows.macd(bars(spark, closes)), "ema_fast", "dif")
    e = closes[0]
    for c, (got, _) in zip(closes[1:], first[1:]):
        e = c * 2 / 13 + e * 11 / 13
        assert got == pytest.approx(e, abs=1e-6)
    later = one(windows.macd(bars(spark, closes), seed="period"), "ema_fast", "dif", "dea")
    assert [x[0] for x in later[:11]] == [None] * 11 and later[11][0] == closes[11] and later[24][1] is None and later[25][1] is not None and later[32][2] is None and later[33][2] is not None


def test_year_high_looks_back_only(spark):
    assert one(review.year_high(bars(spark, [3.0, 1.0, 5.0])), "year_high") == [3.0, 3.0, 5.0]


def test_upsert_keeps_final_rows(spark):
    key = "data_type string, code string, trade_date string, close double, is_final boolean, update_time int"
    old = spark.createDataFrame([("stock", "1", "20240101", 1.0, False, 1), ("stock", "1", "20240102", 1.0, True, 5)], key)
    new = spark.createDataFrame([("stock", "1", "20240101", 2.0, True, 2), ("stock", "1", "20240102", 9.0, False, 9)], key)
    assert one(ingest.upsert(old, new), "close", "is_final") == [(2.0, True), (1.0, True)]
    assert one(ingest.patched(old, new, ("close",)), "close") == [2.0, 9.0]


def test_bars_on_disk(spark, tmp_path):
    path = str(tmp_path / "bars")
    ingest.write_bars(bars(spark, [1.0, 2.0]).unionByName(bars(spark, [3.0], "880301", "sector")), path)
    assert ingest.read_bars(spark, path, "stock").count() == 2 and ingest.read_bars(spark, path).count() == 3
    with pytest.raises(ValueError):
        ingest.read_bars(spark, path, "all")


def test_calendar_and_flags(spark):
    off = spark.createDataFrame([(2024, ["01-01", "13-77"])], "year int, dates array<string>")
    assert [r.trade_date for r in ingest.calendar(spark, "2023-12-30", "2024-01-03", off).orderBy("d").collect()] == ["20240102", "20240103"]
    at = spark.createDataFrame([("2024-01-01 06:59:00",), ("2024-01-01 07:00:00",)], "t string").select(ingest.final_now(F.to_timestamp("t")).alias("f"))
    assert [r.f for r in at.collect()] == [False, True]


def test_source_order(spark):
    rows = spark.createDataFrame([("1", "d", "b"), ("1", "d", "a"), ("2", "d", "zzz"), ("2", "d", "b")], "code string, trade_date string, data_source string")
    assert {(r.code, r.data_source) for r in ingest.first_source(rows, {"a": 1, "b": 2}).collect()} == {("1", "a"), ("2", "b")}


def test_names_match_in_tiers(spark):
    wanted = spark.createDataFrame([("煤炭",), ("银行概念",), ("白酒(新)",), ("芯片",), ("没有",)], "name string")
    known = spark.createDataFrame([("煤炭", "880301"), ("银行", "880471"), ("白酒", "880380"), ("半导体", "880491")], "name string, code string")
    aliases = spark.createDataFrame([("芯片", "半导体")], "alias string, name string")
    found = {r.name: (r.code, r.tier) for r in sectors.match_names(wanted, known, aliases).collect()}
    assert found == {"煤炭": ("880301", 1), "银行概念": ("880471", 4), "白酒(新)": ("880380", 3), "芯片": ("880491", 2), "没有": (None, None)}


def test_import_of_codes(spark):
    held = spark.createDataFrame([("880301", "煤", 5), ("880999", "银行", 7)], "code string, name string, stock_count int")
    rows = spark.createDataFrame([("880301", "煤炭"), ("880471", "银行"), ("880800", "新"), ("123456", "x")], "code string, name string")
    assert {(r.code, r.name, r.stock_count) for r in sectors.import_codes(rows, held).collect()} == {("880301", "煤炭", 5), ("880471", "银行", 7), ("880800", "新", 0)}


def test_block_files(spark, tmp_path):
    block = lambda name, *codes, flags=b"\x05\x00\x02\x00\x00\x00", gap=0: name.encode("gbk") + b"\0" + flags + b"".join(c.encode() + b"\0" * (1 + gap) for c in codes) + bytes(40)
    whole = bytes(0x140) + block("银行", "600000", "000001") + block("5G概念", "300001", gap=16, flags=b"\x01\x00\x02\x00") + block("三个代码", "600001", "600002", "600003", gap=3)
    damaged = bytes(0x140) + block("煤炭", "600010") + b"\xb0\xe5junk\x00\x07\x07" + block("没有代码") + b"\xff\xff\x01" + bytes(5) + block("煤" * 17, "600011") + block("石油", "600012", "60001", "600013") + block("医药", "600014", "600015")
    cut = bytes(0x140) + bytes(300) + block("白酒", "600020", "600021")[:-45]
    for name, data in (("a", whole + bytes(200)), ("b", damaged + bytes(200)), ("c", cut), ("d", b"short"), ("e", b""), ("f", bytes(0x140) + block("太短", "600001"))):
        (tmp_path / f"{name}.dat").write_bytes(data)
    found = {}
    for r in parsing.block_members(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path", "name", "nth").collect():
        found.setdefault((r.path[-5], r.name), []).append(r.stock_code)
    assert {k[1]: v for k, v in found.items() if k[0] == "a"} == {"银行": ["600000", "000001"], "5G概念": ["300001"], "三个代码": ["600001", "600002", "600003"]}
    assert {k[1]: v for k, v in found.items() if k[0] == "b"} == {"煤炭": ["600010"], "煤" * 16: ["600011"], "石油": ["600012"], "医药": ["600014", "600015"]}
    assert {k[1]: v for k, v in found.items() if k[0] == "c"} == {"白酒": ["600020"]} and not any(k[0] in "def" for k in found)


def test_initials(spark):
    df = spark.createDataFrame([("平安银行",), ("TCL科技",), (None,)], "n string")
    assert [r.i for r in df.select(parsing.initials(F.col("n"), dict(zip("平安银行科技", ("ping", "an", "yin", "hang", "ke", "ji")))).alias("i")).collect()] == ["PAYH", "TCLKJ", None]


def test_fees():
    assert [round(x, 6) for x in backtest.fees("BUY", 10_000.0)] == [5.0, 0.2, 0.0]
    assert [round(x, 6) for x in backtest.fees("SELL", 100_000.0)] == [30.0, 0.0, 50.0]


def test_equity_adds_up(spark):
    prices = bars(spark, [10.0, 11.0, 8.0, 8.0]).unionByName(bars(spark, [5.0], "000009"))
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, lots int")
    trades = backtest.first_purchases(prices, runs)
    assert {(r.run_id, r.code, r.quantity) for r in trades.collect()} == {(x, c, n) for x, n in (("a", 100), ("b", 200)) for c in ("000009", prices.first().code)}
    made = backtest.equity(trades, prices, 10_000.0)
    got = [r.equity for r in made.where("run_id = 'a'").orderBy("trade_date").collect()]
    spent = 1001 + 5 + 1001 * 2e-5 + 501 + 5 + 501 * 2e-5
    assert got == pytest.approx([10_000 - spent + 500 + 100 * c for c in (10, 11, 8, 8)], abs=1e-3)
    assert backtest.metrics(made).where("max_drawdown < 0").count() == 2
    assert backtest.quick_metrics(made).where("max_drawdown > 0").count() == 2


def test_sales_lower_what_is_held(spark):
    prices = bars(spark, [10.0, 12.0, 20.0])
    days = [r.trade_date for r in prices.orderBy("trade_date").collect()]
    rows = [("a", days[0], prices.first().code, "BUY", 100, 10.0, 5.0), ("a", days[1], prices.first().code, "SELL", 60, 12.0, 6.0)]
    trades = spark.createDataFrame(rows, "run_id string, trade_date string, code string, direction string, quantity long, price double, fees double")
    got = [r.equity for r in backtest.equity(trades, prices, 2000.0).orderBy("trade_date").collect()]
    assert got == pytest.approx([1995.0, 995 + 720 - 6 + 480, 995 + 720 - 6 + 800], abs=1e-6)


def test_windows_of_ticks(spark):
    ticks = spark.createDataFrame([("a", "2024-01-01 09:00:00", 1, 5.0), ("a", "2024-01-01 09:30:00", 2, 7.0), ("a", "2024-01-02 09:00:00", 3, 1.0)], "code string, ts string, event_id long, price double").withColumn("ts", F.to_timestamp("ts"))
    found = streams.windowed(ticks, "1 day").orderBy("window_start").collect()
    assert [(r.open, r.high, r.close, r.n_ticks) for r in found] == [(5.0, 7.0, 7.0, 2), (1.0, 1.0, 1.0, 1)]
    assert streams.sessions(ticks, "1 hour").count() == 2


def test_pages_and_searches(spark):
    basics = spark.createDataFrame([(f"{i:06d}", f"Name{i}") for i in range(25)], "stock_code string, stock_name string")
    assert [r.stock_code for r in pool.page(basics, ("stock_code",), 3, 10).orderBy("stock_code").collect()] == [f"{i:06d}" for i in range(20, 25)]
    assert pool.search(basics, "NAME2").count() == 6
    assert pool.latest_date(bars(spark, [1.0, 0.0])).first().trade_date == "20240101"


def test_empty_bars_give_empty_results(spark):
    none = bars(spark, [1.0]).limit(0)
    for made in (ranks.derived(none), concentration.threshold_share(none), tables.quantile_groups(windows.period_changes(none), "close"), review.strong_by_high(none), windows.macd(none), resample.ohlc(none, "week")):
        assert made.count() == 0
