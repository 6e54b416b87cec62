"""What only larger tables bring: long keys, many instruments, many files."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ticktide.operators import corrections, ranks, review
from ticktide.plans import factors, market, pages
from ticktide.sources import bindings, landed


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """A folder with line items of suppliers whose number times a date needs more than 32 bits."""
    folder = str(tmp_path_factory.mktemp("larger"))
    rows = [(n, n, supplier, 1, 2.0, 10.0 + n, datetime.datetime(1998, 12, n % 28 + 1)) for n, supplier in enumerate((1, 999, 59_999) * 20)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_abnormal_share_of_long_codes(spark, items):
    found = {r.code: r.abnormal for r in market.abnormal_share(spark, items).collect()}
    bars = {(f"{s:06d}", 19981201 + n % 28) for n, s in enumerate((1, 999, 59_999) * 20)}
    wanted = {c: sum(int(c) * d % 3 == 0 for k, d in bars if k == c) / sum(k == c for k, _ in bars) for c in found}
    assert found == pytest.approx(wanted, abs=1e-6) and len(found) == 3


def test_means_beside_a_half_are_rounded_as_in_sql(spark):
    """Closes of a larger table whose means have a 5 at the seventh place."""
    rows = [("a", "19950102", 133.2428125), ("b", "19950110", 2077.6090625), ("c", "19950103", 2769.1004374999998 * 2 - 5476.374), ("c", "19950109", 5476.374)]
    found = review.above_own_mean(spark.createDataFrame([("stock", *r) for r in rows], "data_type string, code string, trade_date string, close double"))
    con = duckdb.connect()
    con.execute("CREATE TABLE bars (code VARCHAR, trade_date VARCHAR, close DOUBLE)")
    con.executemany("INSERT INTO bars VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT * FROM (SELECT code, trade_date, round_even(avg(close) OVER (PARTITION BY code ORDER BY trade_date ROWS 49 PRECEDING), 6) AS m, close FROM bars) WHERE close > m").fetchall()
    assert {(r.code, r.trade_date, r.mean_close) for r in found.collect()} == {w[:3] for w in want}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange hashpartitioning"), plan.count("Sort [")


def test_derived_fields_need_an_exchange_by_code_and_one_by_date(spark, items):
    assert exchanges(ranks.derived(bindings.stock_bars(spark, items))) == (2, 2)


def test_corrections_deal_bars_out_once_by_code_and_once_by_date(spark, items, tmp_path):
    bars = bindings.stock_bars(spark, items)
    ranks.derived(bars).write.parquet(f"{tmp_path}/stored")
    bars.where("code = '000999'").withColumn("close", F.col("close") + 1).write.parquet(f"{tmp_path}/rows")
    stored, rows = spark.read.parquet(f"{tmp_path}/stored"), spark.read.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where a batch has many instruments
    try:
        assert exchanges(corrections.changed_fields(stored, rows))[0] == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    fresh = corrections.changed_fields(stored, rows)
    fresh.write.parquet(f"{tmp_path}/fresh")
    fresh = spark.read.parquet(f"{tmp_path}/fresh")
    corrections.changed_dates(stored, rows, fresh).write.parquet(f"{tmp_path}/days")
    assert exchanges(corrections.patch(stored, rows, fresh, spark.read.parquet(f"{tmp_path}/days")))[0] == 1


def test_small_day_files_share_a_task(tmp_path):
    for n in range(50):
        made = np.zeros(3, landed.RECORD)
        made["date"] = [20240102, 20240103, 20240104]
        made["close"] = n
        (tmp_path / f"{n:06d}.day").write_bytes(made.tobytes())
    for reader, parts in ((r := landed.DayReader({"path": str(tmp_path)}), r.partitions()), (s := landed.DayStream({"path": str(tmp_path)}), s.partitions({}, s.latestOffset()))):
        assert len(parts) == 1
        batches = [b for p in parts for b in reader.read(p)]
        assert len(batches) == 1 and batches[0].num_rows == 150 and len(set(batches[0]["code"].to_pylist())) == 50


def test_pages_of_highs_read_them_stored(spark, items):
    """Pages deal stored bars out by date alone, and the highs are those of the bars."""
    for query, n in ((market.strong_by_high, 1), (market.market_summary, 1), (market.new_high, 0)):
        assert exchanges(query(spark, items))[0] == n
    held, bars = factors.stored(spark, items), bindings.stock_bars(spark, items)
    at = lambda df: {(r.code, r.trade_date): (r.year_high, r.year_top) for r in df.select("code", "trade_date", "year_high", "year_top").collect()}
    assert at(held) == at(review.year_high(bars, "close", "high"))


def test_shared_places_need_no_codes(spark):
    """Ties share the mean of their places, NaNs theirs after all numbers; instruments needn't be put in order for that."""
    values = [3.0, 1.0, 3.0, None, float("nan"), -0.0, 0.0, float("nan")]
    rows = spark.createDataFrame([("stock", "d", v) for v in values], "data_type string, trade_date string, v double")
    found = [(r.v, r.p) for r in ranks.placed(rows, {"p": ("v", "average")}).collect()]
    want = [(3.0, 4.5), (1.0, 3.0), (3.0, 4.5), (None, None), (float("nan"), 6.5), (0.0, 1.5), (0.0, 1.5), (float("nan"), 6.5)]
    assert sorted(map(str, found)) == sorted(str((v if v != 0 else f[0], p and p / 7)) for (v, p), f in zip(want, found))
    assert not ranks.placed(rows.where("v IS NULL"), {"p": ("v", "average")}).where("p IS NOT NULL").count()


def test_cr_page_reads_indices_stored(spark):
    """The five periods share one table of index bars instead of adding up all trades for each."""
    assert not [f for f in pages.cr_page(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_breadth_pages_read_a_row_a_date(spark):
    """No page reads the fields of every bar, or adds up trades again."""
    files = pages.breadth_pages(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "/derived-" in f]


def test_index_bars_deal_out_sums_alone(spark, tmp_path):
    """Trades meet suppliers without an exchange also where suppliers times nations would be too many to broadcast."""
    for name in ("lineitem", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    first = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(1).drop("s_suppkey")
    spark.range(2_000).withColumnRenamed("id", "s_suppkey").join(first).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 50_000)  # more than suppliers take, less than line items
    try:
        for bars in (bindings.index_bars, bindings.sector_bars):
            assert exchanges(bars(spark, str(tmp_path)))[0] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
