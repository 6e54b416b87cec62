"""MACD of every stock against a plain loop, and means of all codes and dates."""

from collections import defaultdict

import pytest

from ticktide.plans import registry
from ticktide.sources import bindings

TABLES = "/root/testdata/sf0.001"


def means(values, span, seed):
    made, last = [None] * len(values), None
    for i, x in enumerate(values):
        if i + 1 >= seed:
            last = x if last is None else x * 2 / (span + 1) + last * (1 - 2 / (span + 1))
            made[i] = last
    return made


@pytest.mark.parametrize("name, seeds", [("macd_stocks_first", (1, 1, 1)), ("macd_stocks_p", (12, 26, 9))])
def test_macd_of_all_stocks(spark, name, seeds):
    bars, got = defaultdict(list), {}
    for r in bindings.stock_bars(spark, TABLES).where("close > 0").select("code", "trade_date", "close").orderBy("code", "trade_date").collect():
        bars[r.code].append((r.trade_date, r.close))
    for r in registry.QUERIES[name](spark, TABLES).collect():
        got[r.code, r.trade_date] = (r.ema_fast, r.ema_slow, r.dif, r.dea, r.hist)
    assert len(bars) > 5 and len(got) == sum(map(len, bars.values()))
    for code, rows in bars.items():
        closes = [c for _, c in rows]
        fast, slow = means(closes, 12, seeds[0]), means(closes, 26, seeds[1])
        dif = [a - b if a is not None and b is not None else None for a, b in zip(fast, slow)]
        late = dif.count(None)
        dea = [None] * late + means(dif[late:], 9, seeds[2])
        for i, (day, _) in enumerate(rows):
            hist = None if dea[i] is None else 2 * (dif[i] - dea[i])
            for want, found in zip((fast[i], slow[i], dif[i], dea[i], hist), got[code, day]):
                assert found is None if want is None else found == pytest.approx(want, abs=2e-6)


def test_means_of_all_codes_hold_the_chosen_ones(spark):
    every = {(r.code, r.trade_date): r.ma for r in registry.QUERIES["batch_ma_all"](spark, TABLES).collect()}
    some = {(r.code, r.trade_date): r.ma for r in registry.QUERIES["batch_ma"](spark, TABLES).collect()}
    assert some and some.items() <= every.items() and len({c for c, _ in every}) > 2
