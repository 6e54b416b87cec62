"""Positions of given trades: what they cost on average, what selling them gained, and when a bought one would have been left.

Trades of a position are folded in date order, one row after the other as a task reads its sorted partition, so a task holds what is
open and no more, however long a position's history is. Exits are looked up in an instrument's bars. No cash is kept and no trade depends on another position's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktide.operators.backtest import SLIP, fees

#: Purchases of one instrument that are followed by one task; those of more are dealt to several, each with the instrument's bars.
AT_ONCE = 200_000


def folded(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], begin: Callable[[], Callable[[dict], list]], schema: str) -> DataFrame:
    """What a fold over each key's rows gives. begin() starts a key and returns a function from a row to rows of the result, which is
    called with None when the key's rows are at an end."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]

    def batch_of(made: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, lambda row: []
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    made += step(None)
                    key, step = own, begin()
                made += step(row)
            yield batch_of(made)
        yield batch_of(step(None))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def average_costs(trades: DataFrame) -> DataFrame:
    """Each trade with what it did to its position: quantity (a sale's at most what is held), holding and avg_cost after it, and the
    gain of a sale, net of its fees, or null. A purchase adds to the average; a sale leaves it; at nothing held it is null.
    trades: run_id, code, trade_date, nth (order within a date), direction (BUY or SELL), quantity, price. Sales of nothing held and
    rows without a quantity above 0 or a price stay, with quantity 0."""
    schema = "run_id string, code string, trade_date string, nth long, direction string, quantity long, price double, holding long, avg_cost double, gain double"

    def begin():
        held, cost = 0, 0.0

        def step(row):
            nonlocal held, cost
            if row is None:
                return []
            wanted, price, gain = max(row["quantity"] or 0, 0) if row["price"] is not None else 0, row["price"], None
            if row["direction"] == "BUY":
                done = wanted
                if done:
                    cost, held = (cost * held + price * done) / (held + done), held + done
            else:
                done = min(wanted, held)
                if done:
                    gain = (price - cost) * done - sum(fees("SELL", price * done))
                    held -= done
                    cost = cost if held else 0.0
            return [(row["run_id"], row["code"], row["trade_date"], row["nth"], row["direction"], done, price, held, cost if held else None, gain)]

        return step

    columns = trades.select("run_id", "code", "trade_date", F.col("nth").cast("long").alias("nth"), "direction", F.col("quantity").cast("long").alias("quantity"), F.col("price").cast("double").alias("price"))
    return folded(columns, ("run_id", "code"), ("trade_date", "nth"), begin, schema)


def trade_counts(costed: DataFrame) -> DataFrame:
    """Of each run how many trades were done, bought and sold, the larger of the two (total_trades), the share of sales that gained
    (win_rate, 0 without sales) and what they gained in all. costed: average_costs()."""
    done = F.col("quantity") > 0
    bought, sold, won = (F.count_if(done & (F.col("direction") == "BUY")), F.count_if(F.col("gain").isNotNull()), F.count_if(F.col("gain") > 0))
    gains = F.sum(F.bround("gain", 6).cast("decimal(28,6)")).cast("double")
    made = costed.groupBy("run_id").agg(bought.alias("n_buys"), sold.alias("n_sells"), won.alias("n_won"), F.coalesce(gains, F.lit(0.0)).alias("gain"))
    rate = F.when(F.col("n_sells") > 0, F.col("n_won") / F.col("n_sells")).otherwise(0.0)
    return made.select("run_id", "n_buys", "n_sells", F.greatest("n_buys", "n_sells").alias("total_trades"), F.bround(rate, 6).alias("win_rate"), "gain")


class Closes:
    """An instrument's closes in date order, and where the first of them is that lies a share below a price."""

    def __init__(self, days: np.ndarray, closes: np.ndarray, locked: np.ndarray, trail: float):
        self.days, self.closes, self.locked, n = days, closes, locked, len(closes)
        self.lows = [closes]  # the k-th: the lowest of 2**k closes from a place on
        while 2 ** len(self.lows) <= n:
            low, half = self.lows[-1], 2 ** (len(self.lows) - 1)
            self.lows.append(np.fmin(low[:-half], low[half:]))
        fallen = np.append(self.below(np.arange(n), closes, trail), n)
        self.trailed = np.minimum.accumulate(fallen[::-1])[::-1]  # where a high since a place is first undercut by that much
        shut = np.append(np.where(locked, np.arange(n), n), n)
        self.shut = np.minimum.accumulate(shut[::-1])[::-1]

    def below(self, at: np.ndarray, price: np.ndarray, share: float) -> np.ndarray:
        """Of each price the first place from at on whose close is so much below it; the number of closes if there is none."""
        at = at.copy()
        for k in range(len(self.lows) - 1, -1, -1):
            low = self.lows[k]
            inside = at < len(low)
            least = low[np.where(inside, at, 0)] if len(low) else price
            at += np.where(inside & ~((price - least) / price >= share), 1 << k, 0)
        return at


def exits(purchases: DataFrame, bars: DataFrame, stop: float = 0.08, trail: float = 0.08, locked: DataFrame | None = None) -> DataFrame:
    """Of each purchase the first later date on which it is left: all on a date on which the market is locked (reason market), else if
    the close is `stop` or more below its price (stop), or `trail` or more below the highest of its price and the closes since (trail);
    sold at the close less a slip. Open ones have null there. purchases: position_id, code, trade_date, price (above 0; others are
    never left). bars: code, trade_date, close. locked: trade_date.

    A task reads an instrument's bars, then its purchases as they come, a batch at a time; it holds the bars."""
    schema = "position_id long, code string, trade_date string, price double, exit_date string, exit_price double, reason string"
    shares = purchases.groupBy("code").agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("shares")).where("shares > 1")  # one code in AT_ONCE purchases at most
    dealt = lambda df: df.join(F.broadcast(shares), "code", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    bought = dealt(purchases.select(F.col("position_id").cast("long").alias("position_id"), "code", "trade_date", F.col("price").cast("double").alias("price")))
    bought = bought.withColumn("share", F.pmod(F.xxhash64("position_id"), F.col("shares")).cast("int")).drop("shares")
    priced = bars.where("close > 0 AND code IS NOT NULL AND trade_date IS NOT NULL").select("code", "trade_date", F.col("close").cast("double").alias("price"))
    flagged = priced.withColumn("locked", F.lit(False)) if locked is None else priced.join(F.broadcast(locked.select("trade_date").distinct().withColumn("locked", F.lit(True))), "trade_date", "left")
    moved = dealt(flagged).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    rows = moved.withColumn("bought", F.lit(False)).unionByName(bought.withColumn("bought", F.lit(True)), allowMissingColumns=True)
    reasons = pa.array(["market", "stop", "trail"])

    def left(own: Closes, days: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the bar at which each purchase is left, and the reason's."""
        n, held = len(own.closes), (price > 0) & (days != "")
        at = np.where(held, np.searchsorted(own.days, days, "right"), n)
        paid = np.where(held, price, 1.0)
        at = np.minimum(np.minimum(own.below(at, paid, min(stop, trail)), own.trailed[at]), own.shut[at])
        met = np.minimum(at, n - 1)
        return at, np.where(own.locked[met], 0, np.where((own.closes[met] - paid) / paid <= -stop, 1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, own = None, [], None  # the instrument's bars, and these in one once purchases come
        for batch in batches:
            if not batch.num_rows:
                continue
            code, share, kind = (batch.column(c) for c in ("code", "share", "bought"))
            price = batch.column("price").to_numpy(zero_copy_only=False).astype(float)
            days = batch.column("trade_date").fill_null("").to_numpy(zero_copy_only=False).astype(str)
            shut = batch.column("locked").fill_null(False).to_numpy(zero_copy_only=False)
            differs = lambda c: pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, differs(code) | differs(share) | differs(kind)))
            dates, closes, why = [], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if (code[a].as_py(), share[a].as_py()) != key:
                    key, pieces, own = (code[a].as_py(), share[a].as_py()), [], None
                if not kind[a].as_py():
                    pieces.append((days[a:b], price[a:b], shut[a:b]))
                    continue
                if own is None and pieces:
                    own = Closes(*map(np.concatenate, zip(*pieces)), trail)
                if own is None:
                    dates.append(np.full(b - a, None)), closes.append(np.zeros(b - a)), why.append(np.zeros(b - a, np.int64))
                    continue
                at, reason = left(own, days[a:b], price[a:b])
                met = np.minimum(at, len(own.closes) - 1)
                dates.append(np.where(at < len(own.closes), own.days[met], None))
                closes.append(own.closes[met] - SLIP), why.append(reason)
            if not dates:
                continue
            when = pa.array(np.concatenate(dates), pa.string())
            open_ = pc.is_null(when).to_numpy(zero_copy_only=False)
            given = batch.filter(kind)
            yield pa.RecordBatch.from_arrays([*(given.column(c) for c in ("position_id", "code", "trade_date", "price")), when, pa.array(np.concatenate(closes), mask=open_), reasons.take(pa.array(np.concatenate(why), mask=open_))], [f.split()[0] for f in schema.split(", ")])

    return rows.repartition("code", "share").sortWithinPartitions("code", "share", "bought", "trade_date").mapInArrow(run, schema)
