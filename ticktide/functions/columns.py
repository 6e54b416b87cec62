"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("data_type", "code")


def by_code() -> WindowSpec:
    """An instrument's bars in date order."""
    return Window.partitionBy(*KEY).orderBy("trade_date")


def by_date(*order: Column | str) -> WindowSpec:
    """All instruments of a family on a date."""
    spec = Window.partitionBy("data_type", "trade_date")
    return spec.orderBy(*order) if order else spec


def rounded(value: Column, places: int = 2) -> Column:
    """Half-even, as every published figure is."""
    return F.bround(value, places)


def change_from(value: Column, before: Column, places: int = 2) -> Column:
    """Percent change; null unless the earlier value is positive."""
    return F.when(before > 0, rounded((value - before) / before * 100, places))


def day(trade_date: Column) -> Column:
    """The date of a yyyyMMdd string; null if it isn't one."""
    return F.try_to_date(trade_date, "yyyyMMdd")


def period_key(trade_date: Column, period: str) -> Column:
    """2024W05, 2024-01, 2024Q1; day gives the date itself, anything else the year."""
    d = day(trade_date)
    year = F.date_format(d, "yyyy")
    if period == "day":
        return trade_date
    if period == "week":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"), F.lit("W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    if period == "month":
        return F.date_format(d, "yyyy-MM")
    if period == "quarter":
        return F.concat(year, F.lit("Q"), F.quarter(d).cast("string"))
    return year


def period_end(trade_date: Column, period: str) -> Column:
    """The last day of a date's week (its Sunday), month, quarter or year as yyyyMMdd, by which periods are put in order."""
    d = day(trade_date)
    if period == "day":
        return trade_date
    end = {
        "week": lambda: F.date_add(d, 6 - F.weekday(d)),
        "month": lambda: F.last_day(d),
        "quarter": lambda: F.last_day(F.add_months(F.trunc(d, "quarter"), 2)),
    }.get(period, lambda: F.make_date(F.year(d), F.lit(12), F.lit(31)))()
    return F.date_format(end, "yyyyMMdd")


def family_of(code: Column) -> Column:
    """Which family a code belongs to by how it starts."""
    return F.when(code.startswith("88"), "sector").when(code.rlike("^(00|30|60|68)"), "stock").otherwise("index")


def is_listed_share(code: Column) -> Column:
    """Six characters, of a share board, not marked."""
    return (F.length(code) == 6) & code.rlike("^(00|60|30|68)") & ~code.startswith("*")


def bare_code(code: Column) -> Column:
    """A code without market prefix or suffix: sh600519, 600519.SH, 1#600519 and SECTOR_880301 give their digits."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(code, "^SECTOR_", ""), "^(?i)(sh|sz|bj)\\.?|^[01]#", ""), "(?i)\\.(sh|sz|ss|bj)$", "")


def with_suffix(code: Column) -> Column:
    """600519.SH for boards that start with 6 or 9, .BJ for 4 and 8, else .SZ."""
    return F.concat(code, F.when(code.rlike("^[69]"), ".SH").when(code.rlike("^[48]"), ".BJ").otherwise(".SZ"))


def filled_volume(volume: Column, amount: Column, close: Column) -> Column:
    """A volume that isn't positive becomes amount / close where both are positive, else 0."""
    return F.when(volume > 0, volume).when((amount > 0) & (close > 0), rounded(amount / close)).otherwise(0.0)


def unified_volume(volume: Column, lots: Column) -> Column:
    """Shares: as given, else lots of a hundred."""
    return F.coalesce(volume, lots * 100)


def clean(value: Column) -> Column:
    """NaN as null: Spark orders NaN above every number."""
    return F.when(~F.isnan(value), value)


def or_default(value: Column, default: float) -> Column:
    """Null and 0 as the default."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("double")), F.lit(default))


def signed(value: Column, places: int = 1) -> Column:
    return F.format_string(f"%+.{places}f", value)


def in_units(value: Column) -> Column:
    """Hundred millions and ten thousands with their signs."""
    two = lambda v: F.format_string("%.2f", v)
    return F.when(F.abs(value) >= 1e8, F.concat(two(value / 1e8), F.lit("亿"))).when(F.abs(value) >= 1e4, F.concat(two(value / 1e4), F.lit("万"))).otherwise(two(value))


#: Endings of sector names that are tried one at a time.
ENDINGS = ("概念", "板块", "指数", "50", "100", "300", "A")


def plain_names(name: Column) -> Column:
    """Array of a sector's name without bracketed parts and without one of the usual endings, in their order, each once."""
    bare = F.regexp_replace(name, "[（(].*?[)）]", "")
    made = F.array(*[F.trim(F.replace(bare, F.lit(ending), F.lit(""))) for ending in ENDINGS])
    return F.filter(F.array_distinct(made), lambda x: (x != "") & (x != F.trim(bare)))


def plain_name(name: Column) -> Column:
    """A sector's name without bracketed parts and the usual endings."""
    bare = F.regexp_replace(name, "[（(].*?[)）]", "")
    for ending in ENDINGS:
        bare = F.replace(bare, F.lit(ending), F.lit(""))
    return F.trim(bare)
