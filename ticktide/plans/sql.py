"""Pieces of the SQL counterparts: common table expressions that queries share."""

from __future__ import annotations

CODE = "lpad(CAST({0} AS VARCHAR), 6, '0')"
_TRADE_ORDER = "l_orderkey, l_linenumber, l_partkey, px"


def _bars(family: str, code: str, source: str) -> str:
    return f"""SELECT '{family}' AS data_type, {code} AS code, trade_date,
      first(px ORDER BY {_TRADE_ORDER}) AS "open", max(px) AS high, min(px) AS low, last(px ORDER BY {_TRADE_ORDER}) AS "close",
      CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS amount
    FROM {source} GROUP BY 2, 3"""


TRADES = "trades AS (SELECT *, strftime(l_shipdate, '%Y%m%d') AS trade_date, l_extendedprice / l_quantity AS px FROM lineitem)"
OWNED = "owned AS (SELECT * FROM trades JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
BARS = f"{TRADES}, bars AS ({_bars('stock', CODE.format('l_suppkey'), 'trades')})"
SECTOR_BARS = f"{TRADES}, {OWNED}, sbars AS ({_bars('sector', "'8803' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')", 'owned')})"
INDEX_BARS = f"{TRADES}, {OWNED}, ibars AS ({_bars('index', "'99990' || CAST(n_regionkey AS VARCHAR)", 'owned')})"
MONTH_BARS = f"""mbars AS (SELECT {CODE.format('l_partkey')} AS code, strftime(date_trunc('month', l_shipdate), '%Y%m%d') AS trade_date,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1, 2)"""
BASICS = f"""basics AS (SELECT {CODE.format('s_suppkey')} AS stock_code, s_name AS stock_name, n_name AS market, list_date FROM supplier
  JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, strftime(min(l_shipdate), '%Y%m%d') AS list_date FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
EXCLUDED = f"excluded AS (SELECT {CODE.format('s_suppkey')} AS code FROM supplier WHERE s_acctbal < 0)"
SECTORS = f"""members AS (SELECT '8803' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sector, n_name AS sector_name, {CODE.format('s_suppkey')} AS code
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT '8809' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0'), r_name, {CODE.format('s_suppkey')}
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  member AS (SELECT *, count(*) OVER (PARTITION BY sector) AS stock_count FROM members)"""
W = "OVER (PARTITION BY code ORDER BY trade_date)"


def change(n: int) -> str:
    before = f'lag("close", {n}) {W}'
    return f"CASE WHEN {before} > 0 THEN round_even((\"close\" - {before}) / {before} * 100, 2) END"


def mean(column: str, n: int, guard: str = "TRUE") -> str:
    return f"CASE WHEN row_number() {W} >= {n} AND {guard} THEN round_even(avg(\"{column}\") OVER (PARTITION BY code ORDER BY trade_date ROWS {n - 1} PRECEDING), 2) END"


PERIODS = (5, 10, 20, 50, 120, 250)
CHANGES = f"{BARS}, chg AS (SELECT *, {change(1)} AS chg_pct, {', '.join(f'{change(p)} AS chg_{p}d' for p in PERIODS)} FROM bars WHERE \"close\" > 0)"
MEANS = "ma AS (SELECT *, " + ", ".join([*(f"{mean('close', n)} AS ma{n}" for n in (10, 20, 50, 120)), *(f"{mean('volume', n, 'volume > 0')} AS vol_ma{n}" for n in (5, 10, 20, 50))]) + " FROM chg)"


def rps(p: int) -> str:
    v = f"CASE WHEN chg_{p}d <> 0 THEN chg_{p}d END"
    return f"CASE WHEN chg_{p}d <> 0 THEN CAST(greatest(1, least(100, round_even(row_number() OVER (PARTITION BY trade_date ORDER BY {v} ASC NULLS LAST, code) / count({v}) OVER (PARTITION BY trade_date) * 100, 0))) AS INTEGER) END"


RPS = "rps AS (SELECT *, " + ", ".join(f"{rps(p)} AS rps_{p}" for p in (20, 50, 120, 250)) + " FROM {0})"
_THIRD = "coalesce(greatest(rps_120, rps_250), 0)"
STRENGTH = f"strength AS (SELECT *, coalesce(rps_sum > 270 AND chg_pct > 5, FALSE) AS is_active FROM (SELECT *, CASE WHEN rps_20 > 0 AND rps_50 > 0 AND {_THIRD} > 0 THEN rps_20 + rps_50 + {_THIRD} END AS rps_sum FROM rps))"
RANKED = f"{CHANGES}, {RPS.format('chg')}, {STRENGTH}"
ALL = f"{CHANGES}, {MEANS}, {RPS.format('ma')}, {STRENGTH}"


def average_place(column: str, n: str, by: str = "trade_date") -> str:
    return f"((rank() OVER (PARTITION BY {by} ORDER BY {column} ASC NULLS LAST) + (count({column}) OVER (PARTITION BY {by}, {column}) - 1) / 2) / {n})"


YEAR_HIGH = """(SELECT *, max("{1}") OVER (PARTITION BY code ORDER BY strptime(trade_date, '%Y%m%d')::DATE RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS year_high FROM {0})"""


def period(p: str, d: str = "strptime(trade_date, '%Y%m%d')") -> str:
    return {
        "day": "trade_date",
        "week": f"lpad(CAST(isoyear({d}) AS VARCHAR), 4, '0') || 'W' || lpad(CAST(week({d}) AS VARCHAR), 2, '0')",
        "month": f"strftime({d}, '%Y-%m')",
        "quarter": f"strftime({d}, '%Y') || 'Q' || CAST(quarter({d}) AS VARCHAR)",
        "year": f"strftime({d}, '%Y')",
    }[p]
