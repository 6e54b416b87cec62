"""Average costs, gains and exits against plain loops."""

import random

import pytest

from ticktide.operators import backtest, positions

TRADE = "run_id string, code string, trade_date string, nth long, direction string, quantity long, price double"


def plain_costs(trades):
    out, state = [], {}
    for run, code, day, nth, side, quantity, price in sorted(trades, key=lambda t: (t[0], t[1], t[2], t[3])):
        held, cost = state.get((run, code), (0, 0.0))
        ok, gain = price is not None and quantity is not None and quantity > 0, None
        done = 0 if not ok else quantity if side == "BUY" else min(quantity, held)
        if done and side == "BUY":
            cost, held = (cost * held + price * done) / (held + done), held + done
        elif done:
            gain = (price - cost) * done - sum(backtest.fees("SELL", price * done))
            held -= done
        state[run, code] = held, cost if held else 0.0
        out.append((run, code, day, nth, side, done, price, held, cost if held else None, gain))
    return sorted(out, key=str)


def test_average_costs(spark):
    r = random.Random(1)
    trades = [(f"r{r.randrange(2)}", f"c{r.randrange(3)}", f"202401{r.randrange(10, 30)}", n, r.choice(["BUY", "SELL"]), r.randrange(-1, 9) * 100, round(r.uniform(1, 9), 2)) for n in range(300)]
    trades += [("r0", "c0", "20240131", 900, "BUY", None, 2.0), ("r0", "c0", "20240131", 901, "SELL", 100, None), ("r9", "c9", "20240101", 1, "SELL", 100, 5.0)]
    found = positions.average_costs(spark.createDataFrame(trades, TRADE))
    assert sorted(map(tuple, found.collect()), key=str) == plain_costs(trades)
    counts = {x.run_id: x for x in positions.trade_counts(found).collect()}
    want = [x for x in plain_costs(trades) if x[0] == "r0"]
    sold = [x[-1] for x in want if x[-1] is not None]
    assert counts["r0"].n_sells == len(sold) and counts["r0"].n_buys == sum(x[4] == "BUY" and x[5] > 0 for x in want)
    assert counts["r0"].win_rate == pytest.approx(sum(g > 0 for g in sold) / len(sold), abs=1e-6) and counts["r0"].gain == pytest.approx(sum(sold), abs=1e-3)
    assert (counts["r9"].total_trades, counts["r9"].win_rate) == (0, 0.0)
    assert positions.average_costs(spark.createDataFrame([], TRADE)).collect() == []


def plain_exits(purchases, bars, stop, trail, locked):
    out = []
    for p, code, day, price in purchases:
        found, high = (None, None, None), price
        for _, at, close in sorted(b for b in bars if b[0] == code and b[1] > day and b[2] and b[2] > 0):
            if price is None or price <= 0:
                break
            high = max(high, close)
            reason = "market" if at in locked else "stop" if (close - price) / price <= -stop else "trail" if (high - close) / high >= trail else None
            if reason:
                found = at, close - 0.01, reason
                break
        out.append((p, code, day, price, *found))
    return sorted(out, key=str)


@pytest.mark.parametrize(("stop", "trail", "at_once"), [(0.08, 0.08, 200_000), (0.05, 0.2, 10), (0.3, 0.1, 7)])
def test_exits(spark, monkeypatch, stop, trail, at_once):
    monkeypatch.setattr(positions, "AT_ONCE", at_once)
    r, days = random.Random(at_once), [f"2024{m:02d}{d:02d}" for m in range(1, 5) for d in range(1, 21)]
    bars, price = [], {c: 10.0 for c in "abc"}
    for day in days:
        for c in price:
            price[c] = round(price[c] * r.choice([0.9, 0.96, 0.98, 1.0, 1.02, 1.03, 1.08]), 2)
            if r.random() < 0.9:
                bars.append((c, day, price[c] if r.random() < 0.97 else None))
    at = {(c, d): p for c, d, p in bars}
    purchases = [(n, c, d, at.get((c, d)) or round(r.uniform(5, 15), 2)) for n, (c, d) in enumerate((r.choice("abc"), r.choice(days)) for _ in range(400))]
    purchases += [(900, "a", days[3], None), (901, "a", days[3], 0.0), (902, "zz", days[0], 3.0), (903, "b", days[-1], 4.0)]
    locked = {days[40]} if at_once == 10 else set()
    found = positions.exits(spark.createDataFrame(purchases, "position_id long, code string, trade_date string, price double"), spark.createDataFrame(bars, "code string, trade_date string, close double"), stop, trail, spark.createDataFrame([(d,) for d in locked], "trade_date string"))
    assert sorted(map(tuple, found.collect()), key=str) == plain_exits(purchases, bars, stop, trail, locked)


def test_exits_of_many_batches(spark):
    """Bars and purchases of an instrument that come in several batches; one without a date is never left; rows are dealt out once."""
    r, days = random.Random(3), [f"2024{m:02d}{d:02d}" for m in range(1, 5) for d in range(1, 21)]
    bars = [(c, d, round(r.uniform(5, 15), 2)) for c in "abcd" for d in days if r.random() < 0.9]
    purchases = [(n, r.choice("abcde"), r.choice(days), round(r.uniform(5, 15), 2)) for n in range(200)] + [(900, "a", days[0], float("nan"))]
    undated = [(901, "a", None, 20.0, None, None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where there are many instruments
    try:
        found = positions.exits(spark.createDataFrame(purchases + [u[:4] for u in undated], "position_id long, code string, trade_date string, price double"), spark.createDataFrame(bars, "code string, trade_date string, close double"), 0.3, 0.4)
        rows = sorted(str(tuple(r)) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted(map(str, [*plain_exits(purchases[:-1], bars, 0.3, 0.4, set()), (*purchases[-1], None, None, None), *undated]))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
