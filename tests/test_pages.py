"""Day tables, searches, names and sector files against plain loops; empty tables give no rows."""

import random

import pytest
from pyspark.sql import functions as F

from ticktide.operators import concentration, daytables, lookup, review, sectors
from ticktide.sources.store import Snapshots

BAR = "data_type string, code string, trade_date string, amount double"


def bars(spark, rows):
    return spark.createDataFrame([("stock", *r) for r in rows], BAR)


def shares(df):
    return concentration.threshold_share(df, 80, 3).drop("data_type")


def held(table):
    return sorted(tuple(r) for r in table.read().where("share IS NOT NULL").select("trade_date", "n", "share").collect())


def test_only_missing_and_changed_dates_are_computed(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"c{c}", f"{y}010{d}", float(r.randrange(1, 900))) for y in (2022, 2023, 2024) for d in range(1, 6) for c in range(6)]
    table = Snapshots(spark, str(tmp_path))
    fill = lambda rows: daytables.fill(table, bars(spark, rows), ("code", "amount"), shares)
    want = lambda rows: sorted(tuple(r) for r in shares(bars(spark, rows)).select("trade_date", "n", "share").collect())
    assert fill(rows[:60]) == 10 and held(table) == want(rows[:60])
    assert fill(rows[:60]) == 0
    assert fill(rows) == 5 and held(table) == want(rows)  # a year is new
    changed = [(c, d, a + 1 if (c, d) == ("c3", "20230102") else a) for c, d, a in rows]
    folders = table.parts()
    assert fill(changed) == 1 and held(table) == want(changed)
    assert {y for y in folders if folders[y] != table.parts()[y]} == {"2023"}  # the other years aren't written
    fewer = [x for x in changed if x[1] != "20220103" and not x[1].startswith("2024")] + [("c0", "20240103", 5.0)]
    assert fill(fewer) == 1 and held(table) == want(fewer)  # too few rows on the last date: none, and not computed again
    assert fill(fewer) == 0
    assert fill([]) == 0 and table.parts() == {}


def test_pages_look_back_and_take_last_values(spark):
    stocks = spark.createDataFrame([("20230630", 9.0), ("20231229", 1.0), ("20240131", 2.0), ("20240201", 3.0), ("20240229", 4.0)], "trade_date string, share double")
    index = spark.createDataFrame([("i", "20231228", 5.0), ("i", "20231229", 10.0), ("i", "20240201", 11.0), ("i", "20240229", 12.0)], "code string, trade_date string, close double")
    found = daytables.concentration_page(stocks, stocks.limit(0), index, "day", "20240229")
    assert sorted((r.series, r.trade_date, r.value) for r in found.collect()) == [("index", "20231229", 50.0), ("index", "20240201", 60.0), ("index", "20240229", 70.0), ("stocks", "20231229", 1.0), ("stocks", "20240131", 2.0), ("stocks", "20240201", 3.0), ("stocks", "20240229", 4.0)]
    found = daytables.concentration_page(stocks, stocks.limit(0), index, "month", "20240229", "20240101")
    assert sorted((r.series, r.period, r.value) for r in found.collect()) == [("index", "2024-02", 59.0909), ("stocks", "2024-01", 2.0), ("stocks", "2024-02", 4.0)]
    assert daytables.look_back("year", "20240229") == "20140303"
    assert daytables.concentration_page(stocks.limit(0), stocks.limit(0), index, "week", "20240229").count() == 0


def test_breadth_is_stretched_by_daily_extremes(spark):
    breadth = spark.createDataFrame([("20240131", 10.0, 20.0), ("20240201", 30.0, 40.0), ("20240301", 50.0, 60.0)], "trade_date string, above_ma50 double, above_ma20 double")
    index = spark.createDataFrame([("20240110", 100.0), ("20240131", 200.0), ("20240215", 300.0)], "trade_date string, close double")
    found = {r.period: (r.above_ma50, r.index_value) for r in daytables.breadth_page(breadth, index, "month").collect()}
    assert found == {"2024-01": (10.0, 50.0), "2024-02": (30.0, 80.0), "2024-03": (50.0, None)}
    flat = daytables.breadth_page(breadth, index.withColumn("close", F.lit(7.0)), "year").collect()
    assert [r.index_value for r in flat] == [20.0]


def test_contained_names_equal_all_pairs(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("概念板块银行ab") for _ in range(n))
    known = list({word(r.randrange(1, 6)) for _ in range(150)} | {"概念", "银行概念"})
    texts = list({word(r.randrange(1, 8)) for _ in range(150)} | {"概念", "xx", "x概念", "概念板块银行ab概念", "😀概念"})
    found = sectors.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(k,) for k in known], "known_name string"))
    want = {(t, k) for t in texts for k in known if len(t) > 1 and len(k) > 1 and (t in k or k in t)}
    assert {(x.text, x.known_name) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_common_piece_isnt_paired(spark):
    """Names that share an ending alone never meet: each is listed under its rarest piece."""
    names = spark.range(3000).select(F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("概念")).alias("known_name"))
    found = sectors.contained(names.select(F.col("known_name").alias("text")), names)
    assert found.count() == 3000


def test_names_without_a_rare_pair_of_characters_meet_few(spark):
    """Any two characters of these names are in a hundred of them or more, longer pieces in few."""
    name = F.concat(F.lit("large ring "), F.lpad((F.col("id") * 7919 % 10007).cast("string"), 5, "0"))
    pairs = sectors._candidates(spark.range(4000).select(name.alias("within")), spark.range(4000).select(name.alias("around")))
    assert pairs.where("within = around").count() == 4000 and pairs.count() < 20_000


def test_names_are_never_broadcast(spark):
    names = spark.range(50).select(F.concat(F.lit("ring "), F.col("id").cast("string")).alias("name"), F.lit("1").alias("code"), F.lit("x").alias("alias"))
    plan = sectors.match_names(names.select("name"), names.select("name", "code"), names.select("alias", "name"))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("BroadcastHashJoin") <= 4 and plan.count("SortMergeJoin") >= 6  # the lengths of pieces alone are broadcast, twice each way


@pytest.mark.parametrize(("heading", "kept"), [("序号,板块名称,TDX_Code", ("name", "code")), ("a,b", ("code", "name")), (" Code ,NAME ", ("code", "name"))])
def test_sector_files(spark, tmp_path, heading, kept):
    order = {"序号,板块名称,TDX_Code": "1,{name},{code}"}.get(heading, "{code},{name}")
    lines = [heading, *(order.format(code=c, name=n) for c, n in (("880301", "煤炭"), (" 880302 ", " 石油 "), ("", "x"), ("880301", "新煤"), ("123456", "不")))]
    (tmp_path / "a.csv").write_bytes("\n".join(lines).encode())
    found = sectors.sector_file(spark, f"{tmp_path}/a.csv")
    assert [(r.code, r.name) for r in found.orderBy(F.desc("nth")).collect()] == [("880301", "煤炭"), ("880302", "石油"), ("880301", "新煤"), ("123456", "不")]
    old = spark.createDataFrame([("880301", "煤", 5), ("880999", "石油", 7)], "code string, name string, stock_count int")
    assert {(r.code, r.name) for r in sectors.import_codes(found, old).collect()} == {("880301", "新煤"), ("880302", "石油")}
    (tmp_path / "b.csv").write_text("only\n1\n")
    with pytest.raises(ValueError, match="no columns"):
        sectors.sector_file(spark, f"{tmp_path}/b.csv")


READINGS = dict(zip("平安银行科技大厦", ("ping", "an", "yin", "hang", "ke", "ji", "da", "xia")))


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(3)
    rows = [(f"{c:06d}", r.choice(["平安银行", "银行科技", "TCL科技", "大厦", "A", "x y z"]) + str(c % 7), None if c % 11 == 0 else "sz") for c in range(0, 900, 3)]
    table = spark.createDataFrame(rows, "stock_code string, stock_name string, market string").withColumn("initials", lookup.initials(F.col("stock_name"), READINGS))
    columns = ("stock_code", "stock_name", "initials")
    lookup.write_index(table, f"{tmp_path}/i", columns)
    plain = {row.stock_code: [row.stock_code, row.stock_name, row.initials or ""] for row in table.collect()}
    for word in ("payh", "银行", "0003", "tcl科", "9", "y z", "", "none at all", "KJ", "000"):
        want = sorted(c for c, texts in plain.items() if any(word.lower() in t.lower() for t in texts))[:50]
        assert [x.stock_code for x in lookup.search(spark, f"{tmp_path}/i", word, columns, "stock_code").collect()] == want
    plan = lookup.search(spark, f"{tmp_path}/i", "银行", columns, "stock_code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "folder#").replace("PartitionFilters: [(folder", "PartitionFilters: [folder") or "folder" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert plain["000000"][2].startswith(("PAYH", "YHKJ", "TCLKJ", "DS", "DX", "A", "XYZ"))
    assert [x.stock_code for x in lookup.matching(table, "^00000[36]$|none", columns, "stock_code").collect()] == ["000003", "000006"]


def test_sector_pages(spark):
    basics = spark.createDataFrame([("880301", "煤炭", 5), ("880302", "平安", 1), ("880303", "科技", 9)], "code string, name string, stock_count int")
    ranked = spark.createDataFrame([("880301", "20240101", 1, 2, 3), ("880303", "20240102", 4, 5, 6)], "code string, trade_date string, rps_10 int, rps_20 int, rps_50 int")
    gone = spark.createDataFrame([("sector", "880301", True), ("stock", "880303", True), ("sector", "880302", False)], "category string, code string, exclude_sync boolean")
    page = lambda *a, **k: [tuple(r) for r in lookup.page_of_sectors(basics, ranked, gone, *a, **k).collect()]
    assert page(1, 2) == [("880301", "煤炭", 5, None, None, None, 3), ("880302", "平安", 1, None, None, None, 3)]
    assert page(2, 2) == [("880303", "科技", 9, 4, 5, 6, 3)]
    assert [r[0] for r in page(1, 9, mode="enabled")] == ["880302", "880303"] and [r[0] for r in page(1, 9, mode="disabled")] == ["880301"]
    assert [r[0] for r in page(1, 9, keyword="KJ", readings=READINGS)] == ["880303"] and [r[0] for r in page(1, 9, least=5)] == ["880301", "880303"]


INDEX = "data_type string, code string, trade_date string, close double"


@pytest.mark.parametrize(("changes", "style"), [
    ({"t": 2.0, "g": 1.5, "m": 0.5}, "国产科技主导"), ({"t": 1.0, "g": 1.5, "m": -3.0}, "海外链领涨"), ({"t": 0.5, "g": -0.5, "m": 1.2}, "价值回归"),
    ({"t": 2.0, "g": 0.1, "m": 1.2}, "全面做多"), ({"t": -0.1, "g": -1.0, "m": -2.0}, "全面承压"), ({"t": 0.6, "g": -0.7, "m": 0.0}, "结构分化"),
    ({"t": 0.98, "g": -0.1, "m": 0.2}, "窄幅震荡"), ({"x": 2.98, "m": -0.1}, "窄幅震荡"), ({"x": 0.4, "m": 0.3}, "全面做多"),
])
def test_styles(spark, changes, style):
    rows = [("index", c, day, close) for c, p in changes.items() for day, close in (("20240101", 100.0), ("20240102", 100.0 + p))]
    found = review.index_overview(spark.createDataFrame(rows, INDEX), "t", "g", "m").collect()
    assert {r.style for r in found} == {style}


def test_responses_are_nested(spark):
    signals = spark.createDataFrame([("d1", 5, "强势"), ("d2", 6, "弱势")], "trade_date string, n long, state string")
    strong = spark.createDataFrame([("d1", "b", 2, 280), ("d1", "a", 1, 290)], "trade_date string, code string, place int, rps_sum int")
    clusters = spark.createDataFrame([("d1", "煤", 1, 3, 50.0, "a,b", "b")], "trade_date string, sector_name string, place int, n long, percent double, representative string, core string")
    one, two = review.response(signals, strong, clusters).orderBy("trade_date").collect()
    assert one.signal.state == "强势" and [(x.place, x.code, x.rps_sum) for x in one.strong] == [(1, "a", 290), (2, "b", 280)]
    assert [(x.sector_name, x.representative, x.core) for x in one.clusters] == [("煤", ["a", "b"], ["b"])]
    assert two.strong == [] and two.clusters == []
