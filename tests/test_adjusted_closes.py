from ticktide.operators import windows


def test_adjusted_close_of_a_date(spark):
    rows = [("a", "20240101", 2.5), ("a", "20240102", 0.0), ("a", "20240103", None), ("b", "20240101", 7.0)]
    bars = spark.createDataFrame(rows, "code string, trade_date string, close double")
    assert sorted(map(tuple, windows.adjusted_closes(bars).collect())) == [("a", "20240101", 2.5), ("b", "20240101", 7.0)]
    assert [r.adj_close for r in windows.get_adj_close(bars, "a", "20240101").collect()] == [2.5]
    assert not windows.get_adj_close(bars, "a", "20240102").collect() and not windows.get_adj_close(bars, "c", "20240101").collect()
