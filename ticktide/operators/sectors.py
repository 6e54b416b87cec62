"""Sectors: membership, clusters of their stocks, their own indices, their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticktide.functions.columns import plain_names, rounded

OTHER = "其他"


def members(sectors: DataFrame, least: int = 0) -> DataFrame:
    """A row per sector and stock, of sectors with at least `least`."""
    return sectors.where(F.col("stock_count") >= least).select(F.col("code").alias("sector"), F.col("name").alias("sector_name"), "stock_count", F.explode("stock_codes").alias("code")).dropDuplicates(["sector", "code"])


def main_sector(sectors: DataFrame, prefix: str | None = None) -> DataFrame:
    """A stock's largest sector, the smallest code among equals."""
    held = members(sectors if prefix is None else sectors.where(F.col("code").startswith(prefix)))
    first = Window.partitionBy("code").orderBy(F.desc("stock_count"), "sector")
    return held.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("code", "sector_name")


def with_main_sector(stocks: DataFrame, sectors: DataFrame) -> DataFrame:
    return stocks.join(main_sector(sectors), "code", "left").withColumn("sector_name", F.coalesce("sector_name", F.lit(OTHER)))


def with_all_sectors(stocks: DataFrame, sectors: DataFrame, least: int = 5) -> DataFrame:
    """A row per stock and sector of enough stocks; one with the other sector where there is none."""
    return stocks.join(members(sectors, least).select("code", "sector_name"), "code", "left").withColumn("sector_name", F.coalesce("sector_name", F.lit(OTHER))).distinct()


def clusters(stocks: DataFrame, top: int = 10, names: int = 10) -> DataFrame:
    """Counts and shares of stocks by sector, the first names of each by order, the largest sectors of a date. Names are only listed
    once they are among the first of their sector. stocks: trade_date, code, name, order, sector_name."""
    among = F.row_number().over(Window.partitionBy("trade_date", "sector_name").orderBy("order", "name"))
    stocks = stocks.withColumn("among", among)
    first = F.transform(F.sort_array(F.collect_list(F.when(F.col("among") <= names, F.struct("order", "name")))), lambda x: x["name"])
    n_all = stocks.groupBy("trade_date").agg(F.countDistinct("code").alias("n_all"))
    per = stocks.groupBy("trade_date", "sector_name").agg(F.count("*").alias("n"), F.array_join(first, ",").alias("names"))
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("n"), "sector_name"))
    return per.join(n_all, "trade_date").withColumn("place", place).where(F.col("place") <= top).withColumn("percent", rounded(F.col("n") * 100.0 / F.col("n_all"), 1)).drop("n_all")


def most_common(stocks: DataFrame) -> DataFrame:
    """The most common sector of a date's stocks; the one met first in order among equals."""
    per = stocks.groupBy("trade_date", "sector_name").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("n"), "first"))
    return per.withColumn("_n", place).where("_n = 1").select("trade_date", "sector_name", "n")


def equal_weight_index(bars: DataFrame, sectors: DataFrame, base: float = 1000.0, places: int = 4) -> DataFrame:
    """A sector's mean member change by date and the price chained from it. bars: code, trade_date, chg_pct."""
    held = bars.where("chg_pct IS NOT NULL").join(members(sectors), "code")
    daily = held.groupBy("sector", "sector_name", "trade_date").agg(F.avg("chg_pct").alias("change"), F.count("*").alias("n"))
    w = Window.partitionBy("sector").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.greatest(1 + F.col("change") / 100, F.lit(1e-9))
    return daily.select("sector", "sector_name", "trade_date", "n", rounded(F.col("change"), places).alias("change"), rounded(base * F.exp(F.sum(F.log(growth)).over(w)), 2).alias("price"))


def sector_breadth(bars: DataFrame, sectors: DataFrame, limit: float = 9.8) -> DataFrame:
    """Mean rank, and how many members rose, fell and moved to the limit. bars: code, trade_date, chg_pct, rps_20."""
    held = bars.join(members(sectors), "code")
    chg = F.col("chg_pct")
    return held.groupBy("sector", "trade_date").agg(
        rounded(F.avg("rps_20")).alias("avg_rps"), F.count_if(chg > 0).alias("n_up"), F.count_if(chg < 0).alias("n_down"), F.count_if(chg >= limit).alias("n_limit_up"), F.count_if(chg <= -limit).alias("n_limit_down")
    )


#: Lengths of the pieces by which names are looked for within others: a name by those of the greatest length that it has.
PIECES = (2, 4, 8, 16)


def _pieces(text: Column, length: Column) -> Column:
    """Hashes of the distinct pieces of a length of a text that is no shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.xxhash64(F.substr(text, i, length))))


def _candidates(short: DataFrame, long: DataFrame) -> DataFrame:
    """within, around: pairs of a text and another that may hold it. within is looked for in the texts that have its rarest piece alone, and not at
    all if there is one that none has. Pieces are as long as the text allows, so few texts share them. short: within; long: around."""
    length = F.array_max(F.filter(F.array(*[F.lit(n) for n in PIECES]), lambda n: n <= F.length("within")))
    asked = short.where(F.length("within") > 1).distinct().withColumn("length", length)
    lengths = F.broadcast(asked.select("length").distinct())  # four rows at most
    each = F.explode(F.filter(F.array(*[F.lit(n) for n in PIECES]), lambda n: n <= F.length("around")))
    listed = long.distinct().withColumn("length", each).join(lengths, "length").select("around", F.explode(_pieces(F.col("around"), F.col("length"))).alias("piece"))
    counts = listed.groupBy("piece").agg(F.count("*").alias("n"))
    cut = asked.select("within", F.explode(_pieces(F.col("within"), F.col("length"))).alias("piece"))
    rarest = F.min_by("piece", F.struct("n", "piece")).alias("piece")
    asks = cut.join(counts.hint("merge"), "piece", "left").groupBy("within").agg(rarest, F.bool_and(F.col("n").isNotNull()).alias("all")).where("all")
    return asks.select("within", "piece").join(listed.hint("merge"), "piece").select("within", "around")


def contained(texts: DataFrame, known: DataFrame) -> DataFrame:
    """text, known_name: pairs of which one holds the other, both of two characters or more. texts: text; known: known_name."""
    holds = F.col("around").contains(F.col("within"))
    inside = _candidates(texts.select(F.col("text").alias("within")), known.select(F.col("known_name").alias("around"))).where(holds)
    outside = _candidates(known.select(F.col("known_name").alias("within")), texts.select(F.col("text").alias("around"))).where(holds)
    return inside.select(F.col("within").alias("text"), F.col("around").alias("known_name")).unionByName(outside.select(F.col("around").alias("text"), F.col("within").alias("known_name"))).distinct()


def match_names(wanted: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """Codes for names in tiers, the first that finds one: the name itself, an alias, without brackets, without one ending (in
    their order), a known name within it or it within a known one, the same with an alias's target. Of several the smallest known
    name counts. wanted: name; known: name, code; aliases: alias, name. No side of a join is broadcast: a small file holds many names
    whose parts repeat, so Spark's estimate of their size is far too low."""
    alias = aliases.groupBy("alias").agg(F.min("name").alias("target")).hint("merge")
    codes = known.groupBy(F.col("name").alias("known_name")).agg(F.min("code").alias("code")).hint("merge")
    bare = F.regexp_replace("name", "[（(].*?[)）]", "")
    base = wanted.select("name").distinct().join(alias, F.col("name") == F.col("alias"), "left").select("name", "target", bare.alias("bare"))
    plain = base.select("name", F.posexplode(plain_names(F.col("name"))).alias("nth", "text"))
    keyed = base.select("name", F.inline(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(0).alias("nth"), F.col(c).alias("text")) for t, c in ((1, "name"), (2, "target"), (3, "bare"))])))
    exact = keyed.unionByName(plain.select("name", F.lit(4).alias("tier"), "nth", "text")).join(codes, F.col("text") == F.col("known_name"))
    loose = base.select("name", F.inline(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(0).alias("nth"), F.col(c).alias("text")) for t, c in ((5, "bare"), (6, "target"))]))).where(F.length("text") > 1)
    first = contained(loose, codes).groupBy("text").agg(F.min("known_name").alias("known_name"))
    within = loose.join(first.hint("merge"), "text").join(codes, "known_name")
    best = exact.unionByName(within.select(*exact.columns)).groupBy("name").agg(F.min(F.struct("tier", "nth", "known_name", "code")).alias("b"))
    return wanted.join(best.hint("merge"), "name", "left").select("name", F.col("b.code").alias("code"), F.col("b.tier").alias("tier"))


#: What the columns of a sector file may be called, in lower case.
CODE_NAMES = ("code", "代码", "板块代码", "tdx_code", "数字代码")
NAME_NAMES = ("name", "名称", "板块名称", "板块名")


def sector_file(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """nth, code, name out of a CSV file of sectors, trimmed, for import_codes(). Columns are found by their usual names, whatever their
    case, or else are the first two; fewer than two are an error. nth: later rows of a code come first, so that they count."""
    rows = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path)
    named = lambda names: next((c for c in rows.columns if c.strip().lower() in names), None)
    code, name = named(CODE_NAMES), named(NAME_NAMES)
    if code is None or name is None:
        if len(rows.columns) < 2:
            raise ValueError(f"{path} has no columns for codes and names")
        code, name = rows.columns[:2]
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    return rows.select((-F.monotonically_increasing_id()).alias("nth"), text(code).alias("code"), text(name).alias("name")).where("code <> '' AND name <> ''")


def import_codes(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sectors after a file of (code, name) is imported: by code or else by name it renames or recodes a sector, or adds one. Of
    rows with one code the first counts, by a column nth, without it by name."""
    first = F.row_number().over(Window.partitionBy("code").orderBy("nth" if "nth" in rows.columns else "name"))
    kept = rows.where(F.col("code").rlike("^88[01]")).withColumn("_n", first).where("_n = 1").select("code", "name")
    by_code = kept.join(sectors.select("code"), "code", "left_semi").select(F.col("code").alias("was"), "code", "name")
    fresh = kept.join(by_code.select("code"), "code", "left_anti")
    by_name = fresh.join(sectors.select(F.col("code").alias("was"), "name"), "name").select("was", "code", "name")
    change = by_code.unionByName(by_name).groupBy("was").agg(F.min(F.struct("code", "name")).alias("to"))
    moved = sectors.join(change, sectors["code"] == change["was"], "left")
    changed = moved.select(F.coalesce("to.code", "code").alias("code"), F.coalesce("to.name", "name").alias("name"), "stock_count")
    added = fresh.join(by_name.select("code"), "code", "left_anti").select("code", "name", F.lit(0).alias("stock_count"))
    return changed.unionByName(added)
