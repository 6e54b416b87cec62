"""Vendors' files: what is written is read back, in parts, with what is cut off or damaged left out."""

import sqlite3

import numpy as np
import pytest

from ticktide.sources import landed

BAR = "data_type string, code string, trade_date string, open double, high double, low double, close double, volume double, amount double"


def bars(spark, codes, days):
    return spark.createDataFrame([("stock", c, f"2024{1 + d // 28:02d}{1 + d % 28:02d}", 1.25 + d, 2.5 + d, 0.75, 1.5 + d, 100.0 * d, 64.0 * d) for c in codes for d in days], BAR)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_day_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "PAGE", 10)
    monkeypatch.setattr(landed, "PAGES", 2)
    table = bars(spark, ["600001", "000002", "300003"], range(90))
    landed.write_day_files(table, str(tmp_path))
    found = spark.read.format("day_files").load(str(tmp_path))
    assert rows_of(found) == rows_of(table.drop("data_type").select(found.columns))
    some = found.where("trade_date >= '20240210' AND trade_date < '20240301' AND code = '000002'")
    assert rows_of(some) == rows_of(table.where("trade_date >= '20240210' AND trade_date < '20240301' AND code = '000002'").select(found.columns))
    reader = landed.DayReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 15  # 90 records, 20 to a task, three files
    list(reader.pushFilters([landed.EqualTo(("code",), "600001"), landed.GreaterThan(("trade_date",), "20240215")]))
    assert len(reader.partitions()) == 5 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 90 - 42


def test_day_files_of_other_tools(spark, tmp_path):
    made = np.zeros(3, landed.RECORD)
    made["date"], made["close"], made["volume"], made["amount"] = [20240102, 0, 20240103], [1234, 1, 1250], [7, 8, 9], [10.5, 1, 11.5]
    (tmp_path / "sh600519.day").write_bytes(made.tobytes() + b"cut off")
    (tmp_path / "sz000001.day").write_bytes(b"")
    (tmp_path / "readme.txt").write_text("no bars")
    landed.register(spark)
    found = spark.read.format("day_files").load(str(tmp_path))
    assert rows_of(found.select("code", "trade_date", "close", "volume", "amount")) == [("600519", "20240102", 12.34, 7.0, 10.5), ("600519", "20240103", 12.5, 9.0, 11.5)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("day_files").load(str(empty)).count() == 0


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    landed.register(spark)
    path = str(tmp_path)
    (tmp_path / "in").mkdir()

    def run():
        rows = spark.readStream.format("day_files").load(f"{path}/in")
        query = rows.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/table")

    landed.write_day_files(bars(spark, ["600001"], range(5)), f"{path}/in")
    assert run().count() == 5
    (file,) = (tmp_path / "in").glob("*.day")
    made = np.zeros(2, landed.RECORD)
    made["date"] = [20240301, 20240302]
    with file.open("ab") as f:
        f.write(made.tobytes() + b"half a record")  # the file grows
    landed.write_day_files(bars(spark, ["000002"], range(4)), f"{path}/in")
    assert run().count() == 11 and run().count() == 11


def test_a_lost_writer_leaves_no_bars(spark, tmp_path):
    landed.register(spark)
    from pyspark.sql import functions as F

    bad = bars(spark, ["600001"], range(5)).withColumn("volume", F.when(F.col("trade_date") == "20240104", F.raise_error(F.lit("lost"))).otherwise(F.col("volume")))
    with pytest.raises(Exception, match="lost"):
        landed.write_day_files(bad, f"{tmp_path}/in")
    assert spark.read.format("day_files").load(f"{tmp_path}/in").count() == 0


def test_sqlite_files_in_ranges_of_rows(spark, tmp_path):
    table = bars(spark, ["a", "b"], range(60)).drop("data_type", "high", "low")
    n = landed.write_sqlite(table.repartition(3), str(tmp_path / "s"), "stock_daily").agg({"n_rows": "sum"}).first()[0]
    found = landed.legacy_rows(spark, str(tmp_path / "s"), "stock_daily", n, rows=7)
    assert found.rdd.getNumPartitions() >= 17 and found.dtypes == table.dtypes and rows_of(found) == rows_of(table)
    assert rows_of(found.select("close").where("code = 'a'")) == rows_of(table.select("close").where("code = 'a'"))
    with pytest.raises(ValueError, match="has 120 rows"):
        landed.legacy_rows(spark, str(tmp_path / "s"), "stock_daily", n + 1)


def test_sqlite_files_with_gaps_and_nulls(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.sqlite") as made:
        made.execute("CREATE TABLE t (code TEXT, n INTEGER, x REAL)")
        made.executemany("INSERT INTO t VALUES (?, ?, ?)", [("a", 1, None), (None, 2, 2.5), ("c", None, 3.5)])
        made.execute("INSERT INTO t (rowid, code) VALUES (100, 'far')")
        made.execute("CREATE TABLE empty_one (code TEXT)")
    found = landed.legacy_rows(spark, str(tmp_path), "t", 4, rows=2)
    assert sorted(map(str, found.collect())) == sorted(map(str, [*spark.createDataFrame([("a", 1, None), (None, 2, 2.5), ("c", None, 3.5), ("far", None, None)], found.schema).collect()]))
    assert landed.legacy_rows(spark, str(tmp_path), "empty_one", 0).count() == 0


def test_many_small_ranges_of_rows_share_tasks(spark, tmp_path):
    """The number of tasks doesn't grow with the rows where ranges are small, and every row is read once."""
    with sqlite3.connect(tmp_path / "a.sqlite") as made:
        made.execute("CREATE TABLE t (n INTEGER, s TEXT)")
        made.executemany("INSERT INTO t VALUES (?, ?)", [(n, str(n)) for n in range(4000)])
    found = landed.legacy_rows(spark, str(tmp_path), "t", rows=1)
    assert found.rdd.getNumPartitions() == landed.TASKS
    assert sorted((r.n, r.s) for r in found.collect()) == [(n, str(n)) for n in range(4000)]
