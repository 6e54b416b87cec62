"""Bars on their way in: sources, calendars, upserts, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktide.functions.columns import bare_code, clean, day, family_of, filled_volume
from ticktide.sources.store import Snapshots, by_family_and_year

KEYS = ("data_type", "code", "trade_date")


def calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame) -> DataFrame:
    """Workdays as d and trade_date: Monday to Friday, no holidays. holidays: year, dates (MM-dd)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d"))
    off = holidays.select(F.explode("dates").alias("md"), "year").select(F.try_to_date(F.concat_ws("-", F.col("year").cast("string"), "md"), "yyyy-MM-dd").alias("d"))
    return days.where(F.weekday("d") < 5).join(off, "d", "left_anti").select("d", F.date_format("d", "yyyyMMdd").alias("trade_date"))


def first_holidays(*tables: DataFrame) -> DataFrame:
    """year, dates (MM-dd) of each year from the first table that has any dates of it, as one is stored, another fetched."""
    every = None
    for i, t in enumerate(tables):
        held = t.where(F.size("dates") > 0).select("year", F.struct(F.lit(i).alias("tier"), F.sort_array("dates").alias("dates")).alias("f"))
        every = held if every is None else every.unionByName(held)
    return every.groupBy("year").agg(F.min("f").alias("f")).select("year", F.col("f.dates").alias("dates"))


def on_workdays(bars: DataFrame, workdays: DataFrame) -> DataFrame:
    """Bars of workdays; what isn't a date is none."""
    return bars.join(workdays.select("trade_date"), "trade_date", "left_semi")


def in_bounds_condition(first_year: int = 2000, latest_year: int = 2050) -> Column:
    year = F.year(day(F.col("trade_date")))
    prices = F.lit(True)
    for c in ("open", "high", "low", "close"):
        prices = prices & (F.col(c) > 0) & (F.col(c) <= 100_000)
    return year.between(first_year, latest_year) & prices & (F.col("volume") <= 1e15) & (F.col("amount") <= 1e20)


def in_bounds(bars: DataFrame, latest_year: int = 2050) -> DataFrame:
    """Bars of sane years, prices in (0, 100000], volume up to 1e15 and amount up to 1e20."""
    return bars.where(in_bounds_condition(latest_year=latest_year))


def abnormal_share(bars: DataFrame) -> DataFrame:
    """How much of each instrument's batch is out of bounds; over half means that it should be fetched again."""
    bad = ~((F.col("close") > 0) & (F.col("close") <= 100_000) & (F.col("volume") <= 1e15) & (F.col("amount") <= 1e20))
    share = F.avg(F.coalesce(bad, F.lit(True)).cast("double"))
    return bars.groupBy("data_type", "code").agg(F.bround(share, 6).alias("abnormal"), (share > 0.5).alias("fetch_again"))


def normalised(bars: DataFrame) -> DataFrame:
    """NaN as null, missing volumes filled from amounts."""
    values = [c for c, t in bars.dtypes if t == "double"]
    cleaned = bars.withColumns({c: clean(F.col(c)) for c in values})
    return cleaned.withColumn("volume", filled_volume(F.col("volume"), F.col("amount"), F.col("close")))


def first_source(candidates: DataFrame, priority: dict[str, int], keys: tuple[str, ...] = ("code", "trade_date")) -> DataFrame:
    """For each key the row of the source with the lowest number; sources without one come last, by name."""
    rank = F.coalesce(*[F.when(F.col("data_source") == s, p) for s, p in priority.items()], F.lit(1 << 30))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "data_source"))
    return candidates.withColumn("_n", best).where("_n = 1").drop("_n")


def first_sound(candidates: DataFrame, priority: dict[str, int], most: float = 0.5, first_year: int = 2000) -> DataFrame:
    """Of each instrument the rows within bounds of one source: the first, by priority and then by name, of whose batch at most a
    share is out of bounds. An instrument that every source has wrong gets no rows."""
    bad = ~in_bounds_condition(first_year)
    rank = F.coalesce(*[F.when(F.col("data_source") == s, p) for s, p in priority.items()], F.lit(1 << 30))
    batches = candidates.groupBy("data_type", "code", "data_source").agg(F.avg(F.coalesce(bad, F.lit(True)).cast("double")).alias("share"))
    sound = batches.where(F.col("share") <= most).groupBy("data_type", "code").agg(F.min_by("data_source", F.struct(rank, "data_source")).alias("data_source"))
    return candidates.join(sound, ["data_type", "code", "data_source"], "left_semi").where(~bad)


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("data_source").agg(F.count("*").alias("n"))


def newest(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per key: final before provisional, then the last written."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("is_final"), F.desc("update_time")))
    return rows.withColumn("_n", order).where("_n = 1").drop("_n")


def upsert(table: DataFrame, rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """table with rows put in: of equal keys the newest stays."""
    return newest(table.unionByName(rows, allowMissingColumns=True), keys)


def patched(table: DataFrame, updates: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """table with the listed columns of updates where those aren't null."""
    new = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(new, list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", F.col(c) if c in table.columns else F.lit(None)) for c in columns}).drop(*[f"_{c}" for c in columns])


def with_final_flags(bars: DataFrame, today: str) -> DataFrame:
    """is_final: bars before today are final, others not; changed marks the rows that it alters."""
    final = F.col("trade_date") < today
    return bars.withColumn("changed", ~F.col("is_final").eqNullSafe(final)).withColumn("is_final", final)


def final_now(written: Column, hour: int = 15, minute: int = 0) -> Column:
    """Whether a UTC time is after the close in Shanghai."""
    local = F.from_utc_timestamp(written, "Asia/Shanghai")
    return F.hour(local) * 60 + F.minute(local) >= hour * 60 + minute


def resume_dates(bars: DataFrame) -> DataFrame:
    """The date from which each instrument is to be fetched: the day after its last final bar, or its last provisional one."""
    last = bars.groupBy("data_type", "code").agg(F.max_by("is_final", "trade_date").alias("is_final"), F.max("trade_date").alias("last_date"))
    d = day(F.col("last_date"))
    return last.select("data_type", "code", "last_date", F.date_format(F.when(F.col("is_final"), F.date_add(d, 1)).otherwise(d), "yyyyMMdd").alias("resume_date"))


def suspended(bars: DataFrame, workdays: DataFrame, today: str, least: int = 3) -> DataFrame:
    """Instruments with at least `least` workdays between their last bar and today. Workdays are numbered, so no range join."""
    numbered = workdays.where(F.col("trade_date") <= today).withColumn("n", F.row_number().over(Window.orderBy("trade_date")))
    all_days = numbered.agg(F.max("n").alias("n_all"))
    last = bars.groupBy("data_type", "code").agg(F.max("trade_date").alias("last_date"))
    met = last.join(F.broadcast(numbered), F.col("last_date") == F.col("trade_date"), "left").join(F.broadcast(all_days))
    missed = F.col("n_all") - F.coalesce("n", F.lit(0))
    return met.withColumn("missed", missed).where(F.col("missed") >= least).select("data_type", "code", "last_date", "missed")


def not_yet_loaded(rows: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("code", "trade_date")) -> DataFrame:
    return rows.join(table.select(*keys).distinct(), list(keys), "left_anti")


def listed_long_enough(rows: DataFrame, basics: DataFrame, today: str, least: int) -> DataFrame:
    """Codes listed for `least` days or more by today; unknown or unreadable dates pass."""
    age = F.coalesce(F.datediff(day(F.lit(today)), day(F.col("list_date"))), F.lit(9999))
    return rows.join(basics.where(age >= least).select(F.col("stock_code").alias("code")), "code", "left_semi")


def without_ranks(bars: DataFrame) -> DataFrame:
    """Stored ranks and changes emptied."""
    gone = [c for c in bars.columns if c.startswith("rps_") or (c.startswith("chg_") and c.endswith("d"))]
    return bars.withColumns({c: F.lit(None).cast(bars.schema[c].dataType) for c in gone})


#: A code that stands for the mean price of the market, and the sector code that it gets.
MEAN_PRICE = ("avg_price", "880003")


def unified(rows: DataFrame) -> DataFrame:
    """A table with codes of all spellings, with market prefixes or suffixes, brought to plain codes, each row's family told by its
    code; of rows that then share a key the newest stays. rows: code, trade_date, is_final, update_time and any others."""
    code = F.when(F.col("code") == MEAN_PRICE[0], MEAN_PRICE[1]).otherwise(bare_code(F.col("code")))
    named = rows.withColumn("code", code)
    return newest(named.withColumn("data_type", family_of(F.col("code"))))


def row_counts(bars: DataFrame) -> DataFrame:
    return bars.groupBy("data_type").agg(F.count("*").alias("n_rows"), F.countDistinct("code").alias("n_codes"))


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by family and year, in a snapshot; a later write replaces the partitions that it has."""
    Snapshots(bars.sparkSession, path).replace(bars, by_family_and_year())


def read_bars(spark: SparkSession, path: str, data_type: str | None = None, start: str = "0", end: str = "9") -> DataFrame:
    """The stored bars of a family, or all, between two dates, from the folders of their years alone."""
    if data_type not in (None, "stock", "sector", "index"):
        raise ValueError(f"unknown family: {data_type}")
    asked = lambda family, year: data_type in (None, family) and start[:4] <= year <= end[:4]
    return Snapshots(spark, path).read(wanted=lambda partition: asked(*partition.split("/"))).where(F.col("trade_date").between(start, end))


def write_days(days: DataFrame, path: str) -> None:
    """Day tables written ahead, Parquet by month, in a snapshot. A later write replaces the dates that it has; the others of its
    months stay."""
    table, month = Snapshots(days.sparkSession, path), F.substring("trade_date", 1, 6)
    touched = {r[0] for r in days.select(month).distinct().collect()}  # months
    old = table.read(days.schema, lambda partition: partition in touched).join(days.select("trade_date"), "trade_date", "left_anti")
    table.replace(days.unionByName(old), {"month": month}, sort=("trade_date",))


def read_days(spark: SparkSession, path: str, schema: str, start: str = "0", end: str = "9") -> DataFrame:
    """The stored rows of the dates between two, from the folders of their months alone."""
    held = Snapshots(spark, path).read(T.StructType.fromDDL(schema), lambda partition: start[:6] <= partition <= end[:6])
    return held.where(F.col("trade_date").between(start, end))


def price_earnings(responses: DataFrame) -> DataFrame:
    """code, pe_ttm (two decimals) from responses (code, body): a JSON list of objects, of which the last counts, or one object."""
    listed = F.try_element_at(F.from_json("body", "array<struct<pe_ttm: double>>"), F.lit(-1))["pe_ttm"]
    single = F.from_json("body", "struct<pe_ttm: double>")["pe_ttm"]
    value = F.when(F.ltrim("body").startswith("["), listed).otherwise(single)
    return responses.select("code", F.bround(value, 2).alias("pe_ttm"))
