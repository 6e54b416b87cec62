"""What a page shows: pools, bubbles, lists, searches, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktide.functions.columns import by_date, family_of, or_default, period_key

#: Names of broad indices; a sector whose name holds one of them is none.
BROAD = ("沪深300", "中证500", "上证50", "创业板指", "科创50", "上证180", "深证成指", "上证指数", "通达信88")


def without_excluded(rows: DataFrame, exclusions: DataFrame, flag: str, code: str = "code") -> DataFrame:
    """Rows whose code isn't excluded."""
    gone = exclusions.where(F.col(flag)).select(F.col("code").alias(code)).distinct()
    return rows.join(gone, code, "left_anti")


def only_excluded(rows: DataFrame, exclusions: DataFrame, flag: str, code: str = "code") -> DataFrame:
    return rows.join(exclusions.where(F.col(flag)).select(F.col("code").alias(code)).distinct(), code, "left_semi")


def named(rows: DataFrame, basics: DataFrame, code: str = "code") -> DataFrame:
    """name of each code; the code itself where none is known."""
    names = basics.select(F.col("stock_code").alias(code), F.col("stock_name").alias("name"))
    return rows.join(names, code, "left").withColumn("name", F.coalesce("name", F.col(code)))


def active_pool(ranked: DataFrame, exclusions: DataFrame, basics: DataFrame, top: int = 50) -> DataFrame:
    """Of each date the active stocks that rose most: place, name, chg_pct, rps_sum and how many there are in all."""
    held = without_excluded(ranked.where("is_active AND close > 0 AND amount > 0"), exclusions, "exclude_display")
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("chg_pct"), "code"))
    counted = held.withColumn("total", F.count("*").over(Window.partitionBy("trade_date"))).withColumn("place", place).where(F.col("place") <= top)
    return named(counted, basics).select("trade_date", "place", "code", "name", "chg_pct", "rps_sum", "total")


def bubbles(derived: DataFrame, basics: DataFrame, period: int = 20) -> DataFrame:
    """Stocks: rank, close and amount percentiles, change, name; those without a rank are left out."""
    rps = f"rps_{period if period in (20, 50, 120, 250) else 20}"
    held = named(derived.where(F.col(rps).isNotNull() & F.col("chg_pct").isNotNull()), basics)
    return held.select("trade_date", "code", "name", F.col(rps).alias("rps"), "close_pct", "amount_pct", "chg_pct")


def sector_bubbles(derived: DataFrame, names: DataFrame, period: int = 20, exclusions: DataFrame | None = None) -> DataFrame:
    """Sectors with turnover, other than broad indices and those not to be displayed; missing percentiles and a missing rank of the
    period are 50, the ranks of all periods are as they are. place: by amount_pct on each date."""
    held = derived if exclusions is None else without_excluded(derived, exclusions.where("category = 'sector'"), "exclude_display")
    held = held.where("amount > 0").join(names.select("code", "name"), "code", "left").withColumn("name", F.coalesce("name", "code"))
    held = held.where(~F.col("name").rlike("|".join(BROAD)))
    whole = lambda c: or_default(F.col(c).cast("double"), 50.0)
    made = held.select("trade_date", "code", "name", whole(f"rps_{period}").alias("rps"), whole("close_pct").alias("close_pct"), whole("amount_pct").alias("amount_pct"), F.coalesce("chg_pct", F.lit(0.0)).alias("chg_pct"), *[c for c in ("rps_10", "rps_20", "rps_50") if c in held.columns])
    return made.withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy("amount_pct", "code")))


#: Ranks and changes that pages show of any family; what a family lacks is null.
SHOWN = ("rps_10", "rps_20", "rps_50", "rps_120", "rps_250", "chg_20d", "chg_50d", "chg_120d", "chg_250d")


def shown_ranks(*families: DataFrame) -> DataFrame:
    """data_type, code, trade_date and all of SHOWN of several families as one table."""
    held = [df.select("data_type", "code", "trade_date", *[F.col(c) if c in df.columns else F.lit(None).cast("int" if c.startswith("rps") else "double").alias(c) for c in SHOWN]) for df in families]
    every = held[0]
    for df in held[1:]:
        every = every.unionByName(df)
    return every


def ranks_on(shown: DataFrame, trade_date: str, least: int | None = None) -> DataFrame:
    """The ranks of all families on a date, or those of which any is at least so high, and how many there are."""
    held = shown.where(F.col("trade_date") == trade_date)
    if least is not None:
        held = held.where(F.greatest(*[c for c in SHOWN if c.startswith("rps")]) >= least)
    return held.withColumn("total", F.count("*").over(Window.partitionBy("trade_date")))


def ranks_of(shown: DataFrame, code: str, period: str = "day", start: str = "0", end: str = "9") -> DataFrame:
    """The ranks of one code, of the family that its code tells, between two dates in their order: of each week or month the last
    row's, dated by the first."""
    held = shown.where((F.col("code") == code) & (F.col("data_type") == family_of(F.lit(code))) & F.col("trade_date").between(start, end))
    if period in ("week", "month"):
        key = period_key(F.col("trade_date"), period).alias("period")
        held = held.groupBy("data_type", "code", key).agg(F.min("trade_date").alias("first"), *[F.max_by(c, "trade_date").alias(c) for c in SHOWN]).withColumnRenamed("first", "trade_date").drop("period")
    return held.select("code", "trade_date", *SHOWN).orderBy("trade_date")


def at_least(ranked: DataFrame, least: int, columns: tuple[str, ...]) -> DataFrame:
    """Rows with any of the ranks at a minimum."""
    return ranked.where(F.greatest(*columns) >= least)


def search(rows: DataFrame, keyword: str, code: str = "stock_code", name: str = "stock_name", initials: str | None = None, top: int = 50) -> DataFrame:
    """Rows whose code, name or initials contain a word, whatever its case, first by code."""
    word = keyword.lower()
    hit = F.lower(code).contains(word) | F.lower(name).contains(word)
    if initials:
        hit = hit | F.lower(initials).contains(word)
    return rows.where(hit).orderBy(code).limit(top)


def page(rows: DataFrame, order: tuple[str, ...], number: int, size: int) -> DataFrame:
    """A page, counted from 1, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def latest_date(bars: DataFrame, upto: str | None = None, before: str | None = None) -> DataFrame:
    """trade_date: the newest with a price, of those up to a date or before one."""
    held = bars.where("close > 0")
    if upto:
        held = held.where(F.col("trade_date") <= upto)
    if before:
        held = held.where(F.col("trade_date") < before)
    return held.agg(F.max("trade_date").alias("trade_date"))


def recent_dates(bars: DataFrame, n: int = 30) -> DataFrame:
    """trade_date, place: the newest n dates that have a price, the newest first."""
    dates = bars.where("close > 0").select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)
    return dates.withColumn("place", F.row_number().over(Window.orderBy(F.desc("trade_date"))))  # n rows


def latest_common_date(bars: DataFrame, families: tuple[str, ...] = ("stock", "sector")) -> DataFrame:
    """The newest date that each of the families has reached."""
    per = bars.where(F.col("data_type").isin(*families)).groupBy("data_type").agg(F.max("trade_date").alias("trade_date"))
    return per.agg(F.min("trade_date").alias("trade_date"))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of every instrument."""
    place = F.row_number().over(Window.partitionBy("data_type", "code").orderBy(F.desc("trade_date")))
    return bars.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def daily(bars: DataFrame, code: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One instrument's bars in date order."""
    held = bars.where(F.col("code") == code)
    if start:
        held = held.where(F.col("trade_date") >= start)
    if end:
        held = held.where(F.col("trade_date") <= end)
    return held.orderBy("trade_date")


def largest(bars: DataFrame, column: str, k: int) -> DataFrame:
    """The k rows of each date with the largest values, by code among equals."""
    place = F.row_number().over(by_date(F.desc(column), "code"))
    return bars.withColumn("place", place).where(F.col("place") <= k)


def index_list(basics: DataFrame, exclusions: DataFrame) -> DataFrame:
    """code, name of the indices known and of those that exclusions add, without the disabled. The known name comes first."""
    listed = exclusions.where("category = 'index' AND code <> ''")
    every = basics.select("code", "name", F.lit(0).alias("o")).unionByName(listed.select("code", F.coalesce("name", "code").alias("name"), F.lit(1).alias("o")))
    first = every.groupBy("code").agg(F.min(F.struct("o", "name")).alias("f")).select("code", F.col("f.name").alias("name"))
    return first.join(listed.where("exclude_sync").select("code").distinct(), "code", "left_anti")


def sector_list(sectors: DataFrame, ranked: DataFrame, columns: tuple[str, ...] = ("rps_10", "rps_20", "rps_50")) -> DataFrame:
    """Every sector with the ranks of its own newest date, null without any."""
    newest = ranked.groupBy("code").agg(F.max("trade_date").alias("trade_date"), *[F.max_by(c, "trade_date").alias(c) for c in columns])
    return sectors.select("code", "name", "stock_count").join(newest, "code", "left")


def first_by_name(*lists: DataFrame) -> DataFrame:
    """The union of lists of (name, code), one row a name: of the first list that has it, its smallest code."""
    every = None
    for i, rows in enumerate(lists):
        held = rows.select("name", F.struct(F.lit(i).alias("list"), "code").alias("f"))
        every = held if every is None else every.unionByName(held)
    return every.groupBy("name").agg(F.min("f").alias("f")).select("name", "f.code", "f.list")


def supported(enabled: DataFrame, known: DataFrame) -> DataFrame:
    """The enabled codes that are known, each once."""
    return enabled.select("code").intersect(known.select("code"))


def stored_dates(bars: DataFrame, code: str, start: str, end: str) -> DataFrame:
    """has_bars: whether an instrument has any bar between two dates."""
    return bars.where((F.col("code") == code) & F.col("trade_date").between(start, end)).limit(1).agg((F.count("*") > 0).alias("has_bars"))


def changed_exclusions(exclusions: DataFrame, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Exclusions after rows are put in by (category, code) and those in gone (category, code) are taken out."""
    keys = ["category", "code"]
    kept = exclusions.join(rows.select(*keys), keys, "left_anti").unionByName(rows.dropDuplicates(keys))
    return kept.join(gone.select(*keys), keys, "left_anti")
