"""Snapshots through crashes, tables that are filled once, layouts without exchanges, and derived fields kept up under late corrections."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ticktide.operators import corrections, ingest, ranks, windows
from ticktide.sources import store

BAR = "data_type string, code string, trade_date string, open double, high double, low double, close double, volume double, amount double"


def bars(spark, rows):
    return spark.createDataFrame([(family, code, day, close, close, close, close, volume, close and volume * close) for family, code, day, close, volume in rows], BAR)


@pytest.fixture(scope="module")
def history():
    r = random.Random(3)
    days = [(date(2020, 1, 1) + timedelta(n)).strftime("%Y%m%d") for n in range(700)]
    return [("stock", f"{c:06d}", day, round(5 + 20 * r.random(), 2), float(r.randrange(0, 900))) for c in range(5) for i, day in enumerate(days) if i >= 40 * c and r.random() < 0.9]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("pick", ["late", "wrong", "gone", "new code", "nothing"])
def test_corrections_equal_a_full_run(spark, tmp_path, history, pick):
    known = {(r[1], r[2]): r for r in history}
    before, batch = dict(known), []
    if pick == "late":
        batch = [before.pop(k) for k in sorted(known) if k[0] == "000002" and k[1] in ("20200710", "20200712", "20200801")]
    elif pick == "wrong":
        for k in [k for k in sorted(known) if k[0] in ("000001", "000003")][300:302]:
            before[k] = (*known[k][:3], known[k][3] * 2, 1.0)
            batch.append(known[k])
    elif pick == "gone":
        for k in [("000000", "20200630X"), ("000004", "20210101X")]:
            real = k[0], k[1][:8]
            batch.append(("stock", *real, None, 0.0))
            known.pop(real, None)
    elif pick == "new code":
        batch = [("stock", "000009", f"202012{d:02d}", 3.0 + d, 10.0) for d in range(1, 20)]
        known |= {(r[1], r[2]): r for r in batch}
    assert batch or pick == "nothing"
    table, first = store.Snapshots(spark, str(tmp_path)), ranks.derived(bars(spark, list(before.values())))
    table.replace(first, store.by_family_and_year())
    corrections.apply(table, first.schema, bars(spark, batch))
    assert rows_of(table.read(first.schema)) == rows_of(ranks.derived(bars(spark, list(known.values()))))


def test_corrections_read_what_a_batch_can_change(spark, history):
    stored = ranks.derived(bars(spark, history))
    row = next(r for r in history if r[1] == "000001" and r[2] >= "20201001")
    batch = bars(spark, [(*row[:3], row[3] + 1, row[4])])
    held = corrections.dirty_bars(stored, batch)
    of_code = [r for r in history if r[1] == "000001"]
    earlier, later = sum(r[2] < row[2] for r in of_code), sum(r[2] > row[2] for r in of_code)
    got = {(r.dirty, r.trade_date < row[2]): r.n for r in held.groupBy("dirty", "trade_date").count().groupBy("dirty", (F.col("trade_date") < row[2]).alias("e")).agg(F.sum("count").alias("n"), F.min("trade_date").alias("trade_date")).collect()}
    assert sum(got.values()) == min(earlier, corrections.REACH) + 1 + min(later, corrections.REACH) < len(history) / 5
    dates = {r[0] for r in corrections.patch(stored, batch).select("trade_date").distinct().collect()}
    assert row[2] in dates and len(dates) <= 1 + min(later, corrections.REACH)
    assert all(d >= row[2] for d in dates)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_corrections_leave_no_exchanges_on_disk(spark, tmp_path, history, monkeypatch):
    """Fields come for a share of the instruments at a time, and ranks for a year: as from one run, with nothing left behind."""
    monkeypatch.setattr(store, "ROUND", 1, raising=False)
    table, first = store.Snapshots(spark, str(tmp_path)), ranks.derived(bars(spark, history))
    table.replace(first, store.by_family_and_year())
    put = {("000001", "20200710"): 3.5, ("000004", "20210203"): None, ("000003", "20211120"): 9.0, ("000007", "20191230"): 4.0}
    batch, held = bars(spark, [("stock", *k, close, 7.0) for k, close in put.items()]), shuffle_files(spark)
    corrections.apply(table, first.schema, batch)
    assert not shuffle_files(spark) - held
    known = [r for r in history if r[1:3] not in put] + [("stock", *k, close, 7.0) for k, close in put.items()]
    assert rows_of(table.read(first.schema)) == rows_of(ranks.derived(bars(spark, known)))
    assert os.listdir(f"{tmp_path}/staged") == []


def test_a_first_fill_leaves_no_exchanges_on_disk(spark, tmp_path, history, monkeypatch):
    monkeypatch.setattr(store, "ROUND", 1, raising=False)
    rows, held = bars(spark, history).repartition("data_type", "code"), shuffle_files(spark)
    table, want = store.Snapshots(spark, str(tmp_path)), ranks.derived(rows)
    table.fill(ranks.own(rows), ranks.compared)
    assert not shuffle_files(spark) - held and len(table.parts()) == 2
    assert rows_of(table.read(want.schema)) == rows_of(want) and os.listdir(f"{tmp_path}/staged") == []


def test_empty_tables(spark, tmp_path):
    table, first = store.Snapshots(spark, str(tmp_path)), ranks.derived(bars(spark, []))
    table.replace(first, store.by_family_and_year())
    assert table.read(first.schema).count() == 0
    rows = [("stock", "000001", "20240102", 2.0, 5.0)]
    corrections.apply(table, first.schema, bars(spark, rows))
    assert rows_of(table.read(first.schema)) == rows_of(ranks.derived(bars(spark, rows)))


def test_a_write_that_ends_half_way_leaves_the_table(spark, tmp_path):
    path = str(tmp_path)
    ingest.write_bars(bars(spark, [("stock", "1", "20230102", 1.0, 1.0), ("stock", "1", "20240102", 2.0, 1.0)]), path)
    want = rows_of(ingest.read_bars(spark, path))
    half = spark.range(3).select(F.lit("stock").alias("data_type"), F.lit("2").alias("code"), F.lit("20240105").alias("trade_date"), F.raise_error(F.lit("lost")).cast("double").alias("close"))
    with pytest.raises(Exception, match="lost"):
        ingest.write_bars(half, path)  # data without a manifest
    assert rows_of(ingest.read_bars(spark, path)) == want
    with open(f"{path}/manifests/1", "w") as f:
        f.write('{"stock/2024": "da')  # the driver was lost while it wrote
    assert rows_of(ingest.read_bars(spark, path)) == want
    ingest.write_bars(bars(spark, [("stock", "1", "20240103", 3.0, 1.0)]), path)
    assert [r.trade_date for r in ingest.read_bars(spark, path, "stock").orderBy("trade_date").collect()] == ["20230102", "20240103"]
    assert ingest.read_bars(spark, path, start="20230101", end="20230301").count() == 1


def test_old_snapshots_are_forgotten(spark, tmp_path):
    path = str(tmp_path)
    for n in range(4):
        ingest.write_bars(bars(spark, [("stock", "1", f"202{n}0102", float(n + 1), 1.0)]), path)
    table = store.Snapshots(spark, path)
    table.forget(1)
    assert ingest.read_bars(spark, path).count() == 4 and len(os.listdir(f"{path}/manifests")) == len([n for n in os.listdir(f"{path}/manifests") if n.endswith(".crc")]) + 1
    ingest.write_bars(bars(spark, [("stock", "1", "20200103", 9.0, 1.0)]), path)
    table.forget(1)
    assert ingest.read_bars(spark, path).where("close = 9").count() == 1 and len(os.listdir(f"{path}/data")) == 4


def test_windows_over_laid_out_bars_need_no_exchange(spark, tmp_path, history):
    table = bars(spark, history)
    store.lay_out(table, f"{tmp_path}/laid", 4)
    held = store.laid_out(spark, f"{tmp_path}/laid", table.schema, 4)
    made = lambda df: windows.moving_averages(windows.period_changes(windows.valid(df)))
    plan = made(held)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "Sort " not in plan
    assert rows_of(made(held)) == rows_of(made(table))


def test_filled_once_for_the_same_files(spark, tmp_path, history):
    table, asked = bars(spark, history), []
    source = f"{tmp_path}/bars.parquet"
    table.write.parquet(source)

    def build():
        asked.append(1)
        return spark.read.parquet(source)

    first = store.filled(spark, "test", [source], build)
    again = store.filled(spark, "test", [source], build)
    assert rows_of(first) == rows_of(again) == rows_of(table) and set(first.inputFiles()) == set(again.inputFiles())
    table.limit(7).write.mode("append").parquet(source)
    assert store.filled(spark, "test", [source], build).count() == table.count() + 7
