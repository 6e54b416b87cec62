"""Ranks and percentiles across a date's instruments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ticktide.functions.columns import by_date
from ticktide.operators import windows

RPS_PERIODS = {"stock": (20, 50, 120, 250), "sector": (10, 20, 50)}


def _hundredths(share: Column) -> Column:
    """A share as a whole number of hundredths from 1 to 100."""
    return F.when(share.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(100), F.bround(share * 100, 0).cast("int"))))


def placed(rows: DataFrame, wanted: dict[str, tuple[str, str]], least: int = 1) -> DataFrame:
    """rows with shares of 1 by name: the place of a column's value among its date's values over a number; null for null. wanted:
    {name: (column, how)}. moved: ordinal places, by code among ties, over the number of values, all but those that are 0;
    average: ties share their mean place, over the number of values; of_rows: the same over the number of rows. Dates with fewer than
    `least` rows are left out. A date's rows are dealt to one task and sorted there once, whatever the number of names."""

    def shares(table: pa.Table) -> pa.Table:
        if len(table) < least:
            table = table.slice(0, 0)
        made = {}
        if any(how == "moved" for _, how in wanted.values()):
            by_code = pc.sort_indices(table["code"]).to_numpy()
        for name, (column, how) in wanted.items():
            known = pc.is_valid(table[column]).to_numpy()
            value = pc.fill_null(table[column].cast("float64"), 0.0).to_numpy()
            known &= (value != 0) | (how != "moved")
            share = np.full(len(table), np.nan)
            if how == "moved":
                at = by_code[known[by_code]]
                share[at[np.argsort(value[at], kind="stable")]] = np.arange(1, len(at) + 1) / len(at)
            else:
                at = np.flatnonzero(known)
                at = at[np.argsort(value[at], kind="stable")]
                held = value[at]
                first = np.flatnonzero(np.append(True, (held[1:] != held[:-1]) & ~(np.isnan(held[1:]) & np.isnan(held[:-1])))[: len(held)])  # NaNs are ties
                ties = np.diff(np.append(first, len(held)))
                share[at] = np.repeat(first + (ties + 1) / 2, ties) / (len(table) if how == "of_rows" else max(len(held), 1))
            made[name] = pa.array(share, mask=~known)
        return pa.Table.from_arrays([*table.columns, *made.values()], [*table.column_names, *made])

    schema = StructType([*rows.schema.fields, *[StructField(name, DoubleType()) for name in wanted]])
    return rows.groupBy("data_type", "trade_date").applyInArrow(shares, schema)


def _by_rank(periods: tuple[int, ...]) -> dict[str, tuple[str, str]]:
    return {f"rps_{p}": (f"chg_{p}d", "moved") for p in periods}


def _ranked(shares: DataFrame, periods: tuple[int, ...], invalid: int | None = None) -> DataFrame:
    return shares.withColumns({f"rps_{p}": F.coalesce(_hundredths(F.col(f"rps_{p}")), F.lit(invalid).cast("int")) for p in periods})


def rps_from_changes(changes: DataFrame, periods: tuple[int, ...] = (20, 50, 120, 250), invalid: int | None = None) -> DataFrame:
    """rps_<n>: the ordinal place, by code among ties, of chg_<n>d among its date's values that are neither null nor 0."""
    return _ranked(placed(changes, _by_rank(periods)), periods, invalid)


def _from_prices(bars: DataFrame, periods: tuple[int, ...], least: int, dates: DataFrame | None = None, since: str | None = None) -> DataFrame:
    counted = bars.withColumn("n_closes", F.count("close").over(Window.partitionBy("data_type", "code")))
    changes = windows.calendar_changes(counted.where(F.col("n_closes") >= least), periods, since)
    if dates is not None:
        changes = changes.join(dates.select("trade_date").distinct(), "trade_date", "left_semi")
    shares = placed(changes, {f"rps_{p}": (f"chg{p}", "average") for p in periods})
    return shares.withColumns({f"rps_{p}": _hundredths(F.col(f"rps_{p}")) for p in periods}).drop(*[f"chg{p}" for p in periods])


def rps_from_prices(bars: DataFrame, periods: tuple[int, ...] = (20, 50, 120, 250), least: int = 120) -> DataFrame:
    """rps_<n> over calendar dates with carried closes, for instruments with at least `least` closes."""
    return _from_prices(bars, periods, least)


def rps_incremental(bars: DataFrame, dates: DataFrame, periods: tuple[int, ...] = (20, 50, 120, 250), least: int = 120) -> DataFrame:
    """rps_from_prices on some dates, from the dates and closes that these need; dates without bars give no rows."""
    since = dates.agg(F.min("trade_date")).first()[0]
    return _from_prices(bars, periods, least, dates, since or "")


def incomplete_dates(bars: DataFrame, check: str = "rps_250", newest: int = 30) -> DataFrame:
    """Of the newest dates those on which not every row has the check column: what an incremental run computes."""
    per_date = bars.where("close > 0").groupBy("data_type", "trade_date").agg(F.count("*").alias("n_rows"), F.count_if(F.col(check) >= 0).alias("n_ranked"))
    return per_date.orderBy(F.desc("trade_date")).limit(newest).where("n_ranked < n_rows")


def _percents(shares: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return shares.withColumns({f"{c}_pct": F.bround(F.col(f"{c}_pct") * 100, 0).cast("int") for c in columns})


def percentiles(bars: DataFrame, columns: tuple[str, ...] = ("close", "amount"), least: int = 10, kind: str = "average") -> DataFrame:
    """<column>_pct on dates with enough rows. kind: average ties as whole numbers; share: the same, not rounded; percent_rank;
    left: share of smaller values; ordinal: place from 0, by code among ties, over the number."""
    six = lambda x: F.bround(x * 100, 6)
    if kind in ("average", "share"):
        shares = placed(bars, {f"{c}_pct": (c, "of_rows") for c in columns}, least)
        return _percents(shares, columns) if kind == "average" else shares.withColumns({f"{c}_pct": six(F.col(f"{c}_pct")) for c in columns})
    n = F.count("*").over(by_date())
    held = bars.withColumn("n_rows", n).where(F.col("n_rows") >= least)
    total = F.col("n_rows")
    made = {}
    for c in columns:
        made[f"{c}_pct"] = {
            "percent_rank": lambda: six(F.percent_rank().over(by_date(c))),
            "left": lambda: six((F.rank().over(by_date(c)) - 1) / total),
            "ordinal": lambda: six((F.row_number().over(by_date(c, "code")) - 1) / total),
        }[kind]()
    return held.withColumns(made).drop("n_rows")


def strength_sum(ranked: DataFrame, third_needed: bool = True) -> DataFrame:
    """rps_sum of rps_20, rps_50 and the larger of the long ones, where all are above 0; is_active above 270 on a day up by over 5."""
    third = F.coalesce(F.greatest("rps_120", "rps_250"), F.lit(0))
    ok = (F.col("rps_20") > 0) & (F.col("rps_50") > 0) & ((third > 0) if third_needed else F.lit(True))
    total = F.when(ok, F.col("rps_20") + F.col("rps_50") + third)
    return ranked.withColumn("rps_sum", total).withColumn("is_active", F.coalesce((F.col("rps_sum") > 270) & (F.col("chg_pct") > 5), F.lit(False)))


def beside(bars: DataFrame, ranked: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Bars with columns of a table of ranks, which may lack dates: null there."""
    keys = ["data_type", "code", "trade_date"]
    return bars.join(ranked.select(*keys, *columns), keys, "left")


def compared(rows: DataFrame, periods: tuple[int, ...] = (20, 50, 120, 250), columns: tuple[str, ...] = ("close", "amount")) -> DataFrame:
    """What derived() computes of a date's instruments, from one pass over them: ranks, their sum, percentiles."""
    shares = placed(rows, _by_rank(periods) | {f"{c}_pct": (c, "of_rows") for c in columns})
    made = _percents(strength_sum(_ranked(shares, periods)), columns)
    percents = [f"{c}_pct" for c in columns]
    return made.select(*[c for c in made.columns if c not in percents], *percents)


def own(bars: DataFrame) -> DataFrame:
    """What derived() computes of an instrument's own bars."""
    return windows.moving_averages(windows.period_changes(windows.valid(bars)))


def derived(bars: DataFrame) -> DataFrame:
    """Everything that is stored beside a bar: changes, means, ranks, their sum, percentiles; in the order they need each other."""
    return compared(own(bars))
