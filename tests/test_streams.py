"""Streams of several batches give what a table gives, keep nothing in the driver, treat late ticks alike and go on after a restart."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from ticktide.operators import ingest, ranks
from ticktide.plans import upkeep
from ticktide.sources.store import Snapshots
from ticktide.streaming import bars as streams

SHAPES = {"tumbling": lambda x: streams.windowed(x, "1 day"), "sliding": lambda x: streams.windowed(x, "2 days", "1 day"), "sessions": lambda x: streams.sessions(x, "1 hour")}


def ticks(spark, rows):
    return spark.createDataFrame(rows, "code string, at string, event_id long, price double").select("code", F.to_timestamp("at").alias("ts"), "event_id", "price")


@pytest.mark.parametrize("shape", SHAPES)
def test_batches_equal_a_table_but_for_late_ticks(spark, tmp_path, shape):
    made, path = SHAPES[shape], str(tmp_path)
    rows = [("a" if n % 3 else "b", f"2024-01-{1 + n // 12:02d} {n * 5 % 24:02d}:{n % 60:02d}:00", n, float(n * 7 % 31)) for n in range(96)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(ticks(spark, rows).schema).parquet(f"{path}/in")
    for part in range(4):  # batches, each a restart from the checkpoint
        ticks(spark, rows[24 * part : 24 * part + 24]).coalesce(1).write.mode("append").parquet(f"{path}/in")
        found = streams.landed(made(stream), f"{path}/table", f"{path}/state")
    seen = found.count()
    late = ticks(spark, [("a", "2024-01-01 03:00:00", 900, 99.0)])
    late.write.mode("append").parquet(f"{path}/in")
    streams.landed(made(stream), f"{path}/table", f"{path}/state")
    ticks(spark, [("end", "2034-01-01 00:00:00", 999, 0.0)]).write.mode("append").parquet(f"{path}/in")
    found = streams.landed(made(stream), f"{path}/table", f"{path}/state")
    assert 0 < seen < found.count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, made(ticks(spark, rows)).collect()))


BAR = "data_type string, code string, trade_date string, close double, is_final boolean, update_time timestamp"


def bars(spark, rows):
    return spark.createDataFrame([("stock", code, day, close, final, at) for code, day, close, final, at in rows], "data_type string, code string, trade_date string, close double, is_final boolean, at string").withColumn("update_time", F.to_timestamp("at")).drop("at")


BATCHES = [
    [("1", "20240102", 1.0, False, "2024-01-02 10:00:00"), ("1", "20240102", 1.5, False, "2024-01-02 11:00:00"), ("2", "20240102", 5.0, True, "2024-01-02 16:00:00"), ("3", "20240102", 7.0, False, "2024-01-02 09:00:00")],
    [("1", "20240102", 2.0, True, "2024-01-02 16:00:00"), ("1", "20240102", 1.7, False, "2024-01-02 12:00:00"), ("2", "20240102", 4.0, False, "2024-01-02 12:00:00"), ("3", "20240102", 6.0, False, "2024-01-02 08:00:00")],
    [("2", "20240103", 5.5, False, "2024-01-03 10:00:00"), ("9", "20240109", 0.5, True, "2024-01-09 16:00:00")],
]
END = [("end", "20300101", 0.0, False, "2030-01-01 00:00:00")]


def test_bars_wait_for_their_final_one(spark, tmp_path):
    path, given = str(tmp_path), []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(bars(spark, END).schema).parquet(f"{path}/in")
    for rows in [*BATCHES, [("3", "20240102", 8.0, True, "2024-01-02 16:00:00")], END]:
        bars(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        found = streams.landed(streams.awaited(stream), f"{path}/table", f"{path}/state")
        given.append({(r.code, r.trade_date, r.close, r.is_final) for r in found.collect()})
        assert found.count() == len(given[-1])  # each once
    assert given[0] == {("2", "20240102", 5.0, True)} and given[1] == given[0] | {("1", "20240102", 2.0, True)}
    assert given[2] == given[1] | {("9", "20240109", 0.5, True), ("3", "20240102", 7.0, False), ("2", "20240103", 5.5, False)}
    assert given[3] == given[4] == given[2]  # a final bar that comes when its day is over and given out is late


def test_upserts_go_on_after_a_lost_batch(spark, tmp_path, monkeypatch):
    path, every = str(tmp_path), [r for rows in BATCHES for r in rows]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(bars(spark, END).schema).parquet(f"{path}/in")
    for n, rows in enumerate(BATCHES):
        bars(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if n == 1:  # the batch's files are written, its manifest isn't
            with monkeypatch.context() as lost:
                lost.setattr(Snapshots, "numbers", lambda self: 1 / 0)
                with pytest.raises(Exception):
                    streams.upsert_stream(stream, f"{path}/table", f"{path}/state").awaitTermination()
            assert streams.merged(spark, f"{path}/table", bars(spark, END).schema).count() == 3
        streams.upsert_stream(stream, f"{path}/table", f"{path}/state").awaitTermination()
    found = streams.merged(spark, f"{path}/table", bars(spark, END).schema)
    assert sorted(map(str, found.collect())) == sorted(map(str, ingest.newest(bars(spark, every)).collect()))


def test_many_batches_write_a_few_times_their_rows(spark, tmp_path):
    """Not each of them the whole table: twelve batches of bars of one year, each with corrections of the first."""
    path, n = str(tmp_path), 12
    for k in range(n):
        at = F.lit(f"2024-01-{1 + k:02d} 10:00:00").cast("timestamp").alias("update_time")
        bar = lambda day, final: (F.lit("stock").alias("data_type"), F.col("id").cast("string").alias("code"), F.lit(day).alias("trade_date"), F.rand(k).alias("close"), F.lit(final).alias("is_final"), at)
        new, corrected = spark.range(5000).select(*bar(f"202401{1 + k:02d}", False)), spark.range(k * 100, k * 100 + 300).select(*bar("20240101", True))
        new.unionByName(corrected).coalesce(1).write.mode("append").parquet(f"{path}/in")
    rows = spark.read.parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.upsert_stream(stream, f"{path}/table", f"{path}/state", keep=1000).awaitTermination()
    found = streams.merged(spark, f"{path}/table", rows.schema)
    want = ingest.newest(rows)
    assert found.count() == n * 5000 and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert spark.read.parquet(f"{path}/table/data/*/*/*").count() <= 4 * rows.count()


def test_derived_fields_follow_a_stream(spark, tmp_path):
    """Batches with corrections, stale rows, a new instrument, a day of rest and an empty batch, one of them run twice."""
    columns = "data_type string, code string, trade_date string, open double, high double, low double, close double, volume double, amount double, is_final boolean, at string"
    day = lambda i: f"2024{1 + i // 28:02d}{1 + i % 28:02d}"
    bar = lambda c, i, p, final, hour: ("stock", c, day(i), p, p, p, p, 10.0 + i, p * 10, final, f"2024-{1 + i // 28:02d}-{1 + i % 28:02d} {hour}:00:00")
    batches = [
        [bar(c, i, 5.0 + i % 7 + n, i % 2 == 0, 12) for n, c in enumerate("abc") for i in range(40) if (i + n) % 9],
        [bar("a", 5, 50.0, True, 16), bar("a", 6, 60.0, False, 9), bar("b", 30, 9.0, True, 16), bar("b", 30, 8.0, True, 15)],
        [bar("d", i, 3.0 + i, True, 16) for i in range(10, 25)] + [bar("c", 55, 4.0, True, 16)],
        [bar("a", 5, 1.0, False, 17)],
    ]
    frame = lambda rows: spark.createDataFrame(rows, columns).withColumn("update_time", F.to_timestamp("at")).drop("at")
    workdays = spark.createDataFrame([(day(i),) for i in range(80) if i != 7], "trade_date string")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(frame(batches[0]).schema).parquet(f"{tmp_path}/in")
    for n, rows in enumerate(batches):
        frame(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n == 2:  # the table is written, the batch isn't ticked off
            with monkeypatched(Snapshots, "forget"), pytest.raises(Exception):
                streams.derive_stream(stream, f"{tmp_path}/table", f"{tmp_path}/state", workdays).awaitTermination()
        streams.derive_stream(stream, f"{tmp_path}/table", f"{tmp_path}/state", workdays).awaitTermination()
    every = ingest.newest(ingest.on_workdays(frame([r for rows in batches for r in rows]), workdays))
    want = ranks.derived(every)
    found = Snapshots(spark, f"{tmp_path}/table").read(want.schema)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


@contextmanager
def monkeypatched(owner, name):
    """A method that fails for a while."""
    held = getattr(owner, name)
    setattr(owner, name, lambda *a: 1 / 0)
    try:
        yield
    finally:
        setattr(owner, name, held)


@pytest.mark.parametrize("query", [upkeep.stream_tumbling, upkeep.stream_sliding, upkeep.stream_session, upkeep.stream_awaited])
def test_stream_queries_are_streams_into_files(spark, query):
    found = query(spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all("/table/" in f for f in found.inputFiles())
