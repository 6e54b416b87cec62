"""Tables with a row a date that are computed for the dates that are missing or out of date, and what a page reads from them."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticktide.functions.columns import period_key, rounded
from ticktide.sources.store import Snapshots, year_of

#: Days that a page looks back if it isn't told from when, by period.
LOOK_BACK = {"day": 120, "week": 365, "month": 3 * 365, "quarter": 5 * 365, "year": 10 * 365}


def marks(bars: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """trade_date, mark: of each date how many rows it has and a sum of their hashes, whatever their order."""
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return bars.groupBy("trade_date").agg(F.concat_ws(":", F.count("*").cast("string"), total.cast("string")).alias("mark"))


def stale(held: DataFrame, marked: DataFrame) -> DataFrame:
    """trade_date, mark of the dates that a stored table lacks or has from other rows."""
    return marked.join(held.select("trade_date", "mark"), ["trade_date", "mark"], "left_anti")


def fill(table: Snapshots, bars: DataFrame, columns: tuple[str, ...], compute: Callable[[DataFrame], DataFrame]) -> int:
    """Brings a stored table up to date with bars and says for how many dates it computed rows. compute: from the bars of some dates a
    row for each date, or none. columns: what it depends on. Dates that have no bars any more go. The years that change are written
    in one new snapshot, so a reader has the table as it was or as it is now."""
    spark, marked = table.spark, marks(bars, columns)
    marked = spark.createDataFrame(marked.collect(), marked.schema)  # a row for each trading day: bars are read once for it
    schema = StructType([*marked.schema.fields, *[f for f in compute(bars.limit(0)).schema.fields if f.name != "trade_date"]])
    held = table.read(schema)
    wanted, gone = stale(held, marked), held.select("trade_date").join(marked, "trade_date", "left_anti")
    touched = {r.year: r.n for r in wanted.withColumn("w", F.lit(1)).select("trade_date", "w").unionByName(gone.withColumn("w", F.lit(0))).groupBy(year_of().alias("year")).agg(F.sum("w").alias("n")).collect()}
    if not touched:
        return 0
    fresh = wanted.join(compute(bars.join(wanted.select("trade_date"), "trade_date", "left_semi")), "trade_date", "left").select(schema.fieldNames())
    kept = table.read(schema, lambda partition: partition in touched).join(marked, ["trade_date", "mark"], "left_semi").select(schema.fieldNames())
    table.replace(kept.unionByName(fresh), {"year": year_of()}, emptied=touched, sort=("trade_date",))
    return sum(touched.values())


def look_back(period: str, until: str) -> str:
    """The date from which a page shows a period if it isn't told."""
    first = datetime.datetime.strptime(until, "%Y%m%d") - datetime.timedelta(days=LOOK_BACK.get(period, LOOK_BACK["day"]))
    return first.strftime("%Y%m%d")


def concentration_page(stocks: DataFrame, sectors: DataFrame, indices: DataFrame, period: str, until: str, since: str | None = None) -> DataFrame:
    """series, code, period, trade_date, value of the dates between two: shares of stocks and of sectors, and every index from 50 plus
    its change in percent since its first bar shown; of each period the last date's value. stocks, sectors: trade_date, share, from
    stored day tables. indices: bars. since: by look_back() if it isn't given."""
    shown = F.col("trade_date").between(look_back(period, until) if since is None else since, until)
    share = lambda df, name: df.where(shown & F.col("share").isNotNull()).select(F.lit(name).alias("series"), F.lit("").alias("code"), "trade_date", F.col("share").alias("value"))
    shares = share(stocks, "stocks").unionByName(share(sectors, "sectors"))
    ends = shares.where("series = 'stocks'").agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_b"))
    held = indices.where(shown).join(F.broadcast(ends), F.col("trade_date").between(F.col("_a"), F.col("_b")))
    first = held.groupBy("code").agg(F.min_by("close", "trade_date").alias("first"))
    scaled = held.join(first, "code").select(F.lit("index").alias("series"), "code", "trade_date", ((F.col("close") / F.col("first") - 1) * 100 + 50).alias("value"))
    key = period_key(F.col("trade_date"), period).alias("period")
    last = shares.unionByName(scaled).groupBy("series", "code", key).agg(F.max("trade_date").alias("trade_date"), F.max_by("value", "trade_date").alias("value"))
    return last.withColumn("value", rounded(F.col("value"), 4))


def breadth_page(breadth: DataFrame, index: DataFrame, period: str, low: float = 20, high: float = 80) -> DataFrame:
    """period, trade_date, above_ma50, above_ma20 of the last date of each period, and index_value, the index's last close in it
    stretched to [low, high] between its lowest and highest close of all days, also where periods are longer than days.
    breadth: trade_date, above_ma50, above_ma20. index: trade_date, close of one index."""
    key = period_key(F.col("trade_date"), period).alias("period")
    rows = breadth.groupBy(key).agg(F.max("trade_date").alias("trade_date"), *[F.max_by(c, "trade_date").alias(c) for c in ("above_ma50", "above_ma20")])
    ends = index.agg(F.min("close").alias("_lo"), F.max("close").alias("_hi"))
    last = index.groupBy(key).agg(F.max_by("close", "trade_date").alias("close"))
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    value = rounded(low + (F.col("close") - F.col("_lo")) / span * (high - low), 1)
    return rows.join(last, "period", "left").join(F.broadcast(ends)).select("period", "trade_date", "above_ma50", "above_ma20", value.alias("index_value"))
