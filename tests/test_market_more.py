"""Calendar fill, quantile groups, day tables, names and equity against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ticktide.operators import concentration, ingest, pool, sectors, tables, windows

BARS = "data_type string, code string, trade_date string, close double, amount double, chg_pct double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    days = [f"2024{m:02d}{d:02d}" for m in (1, 2, 3) for d in range(1, 21)]
    made = []
    for family, n in (("stock", 7), ("index", 3)):
        for c in range(n):
            for i, day in enumerate(days):
                if r.random() < 0.6 and i >= 3 * c:
                    made.append((family, f"{family[0]}{c}", day, None if r.random() < 0.05 else 1 + 9 * r.random(), 100 * r.random(), r.random() - 0.5))
    return made


def plain_grid(rows):
    held, dates = defaultdict(dict), defaultdict(set)
    for family, code, day, close, *_ in rows:
        dates[family].add(day)
        if close is not None:
            held[family, code][day] = close
    for (family, code), closes in held.items():
        last = None
        for day in sorted(dates[family]):
            last = closes.get(day, last)
            yield family, code, day, last, day in closes


def test_calendar_fill_equals_a_grid(spark, rows):
    bars, want = spark.createDataFrame(rows, BARS), sorted(plain_grid(rows), key=str)
    assert sorted(map(tuple, windows.densified(bars).collect()), key=str) == want
    late = windows.densified(bars, "20240215", 2)
    dates = {f: sorted({x[2] for x in want if x[0] == f}) for f in ("stock", "index")}
    first = {f: d[max(0, next(i for i, x in enumerate(d) if x >= "20240215") - 2)] for f, d in dates.items()}
    assert sorted(map(tuple, late.collect()), key=str) == [x for x in want if x[2] >= first[x[0]]]
    assert windows.densified(bars, "20250101").count() == 0


def test_horizon_keeps_what_changes_need(spark, rows):
    bars = spark.createDataFrame(rows, BARS)
    day = "20240310"
    every = {(r.code, r.chg_pct, r.chg_5d, r.chg_20d) for r in windows.period_changes(windows.valid(bars), (5, 20)).where(F.col("trade_date") == day).collect()}
    assert {(r.code, r.chg_pct, r.chg_5d, r.chg_20d) for r in windows.changes_on(bars, day, (5, 20)).collect()} == every and every
    assert windows.horizon(bars, day, 3).where(F.col("trade_date") < day).groupBy("data_type", "code").count().agg(F.max("count")).first()[0] == 3


@pytest.mark.parametrize("groups", [50, 7, 3, 1])
def test_groups_equal_their_bounds(spark, rows, groups):
    bars = spark.createDataFrame(rows, BARS).where("data_type = 'stock' AND amount IS NOT NULL")
    by_day, want = defaultdict(list), set()
    for _, code, day, _, amount, chg in rows:
        if code[0] == "s":
            by_day[day].append((amount, code, chg))
    for day, held in by_day.items():
        held.sort()
        for i in range(groups):
            some = held[int(i * (len(held) / groups)) : int((i + 1) * (len(held) / groups))]
            if some:
                want.add((day, 2 * i, len(some)))
    assert {(r.trade_date, r.lower, r.n) for r in tables.quantile_groups(bars, "amount", groups).collect()} == want


def test_threshold_share_with_ties(spark):
    held = spark.createDataFrame([("s", f"{i}", "d", None, float(v), 0.0) for i, v in enumerate([1, 1, 2, 2, 2, 10])], BARS)
    assert concentration.threshold_share(held, 50, 1).first().share == pytest.approx(16 / 18 * 100, abs=1e-4)
    assert concentration.threshold_share(held, 95, 7).count() == 0


def test_day_tables_replace_dates(spark, tmp_path):
    path, days = str(tmp_path / "days"), lambda *x: spark.createDataFrame(x, "trade_date string, n long")
    ingest.write_days(days(("20240101", 1), ("20240102", 2), ("20240201", 3)), path)
    ingest.write_days(days(("20240102", 9), ("20240103", 4)), path)
    got = lambda *x: {(r.trade_date, r.n) for r in ingest.read_days(spark, path, "n long, trade_date string", *x).collect()}
    assert got() == {("20240101", 1), ("20240102", 9), ("20240103", 4), ("20240201", 3)}
    assert got("20240102", "20240131") == {("20240102", 9), ("20240103", 4)}


def test_endings_are_tried_one_at_a_time(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    known = spark.createDataFrame([("X100", "1"), ("银行", "2"), ("新能源车", "3")], "name string, code string")
    none = spark.createDataFrame([], "alias string, name string")
    found = {r.name: (r.code, r.tier) for r in sectors.match_names(names("X100概念", "银行板块", "能源", "银", "能源车厂"), known, none).collect()}
    assert found == {"X100概念": ("1", 4), "银行板块": ("2", 4), "能源": ("3", 5), "银": (None, None), "能源车厂": (None, None)}


def test_broad_indices_are_no_sectors(spark):
    held = spark.createDataFrame([("d", c, 1.0, 5, 5, 5, 0.1) for c in "abc"], "trade_date string, code string, amount double, rps_20 int, close_pct int, amount_pct int, chg_pct double")
    names = spark.createDataFrame([("a", "通达信88"), ("b", "上证金融"), ("c", "沪深300指数")], "code string, name string")
    assert [r.code for r in pool.sector_bubbles(held, names).collect()] == ["b"]


def test_price_earnings(spark):
    rows = spark.createDataFrame([("a", '[{"pe_ttm": 1}, {"pe_ttm": 12.345}]'), ("b", '{"pe_ttm": 7.5}'), ("c", "oops"), ("d", None), ("e", "[]")], "code string, body string")
    assert {r.code: r.pe_ttm for r in ingest.price_earnings(rows).collect()} in ({"a": a, "b": 7.5, "c": None, "d": None, "e": None} for a in (12.34, 12.35))


def test_short_series_have_no_means(spark):
    bars = spark.createDataFrame([("stock", "a", f"202401{d:02d}", float(d), 1.0, 0.0) for d in range(1, 31)] + [("stock", "b", "20240101", 1.0, 1.0, 0.0)], BARS)
    found = {(r.code, r.trade_date): r for r in windows.macd(bars, seed="period").collect()}
    assert len(found) == 31 and found["b", "20240101"].ema_fast is None and found["a", "20240112"].ema_fast == 12.0 and found["a", "20240126"].dif is not None and found["a", "20240130"].dea is None
