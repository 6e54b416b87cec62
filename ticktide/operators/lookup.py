"""Search in a stored index of pieces of codes, names and initials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a piece, and folders that pieces are dealt to by their first character.
PIECE, FOLDERS = 2, 64


def initials(name: Column, readings: dict[str, str]) -> Column:
    """Upper-case first letters of a name's characters by a table of readings; ASCII letters and digits stand for themselves, other
    characters for nothing. One-character keys; a plain expression, so it needs no Python worker."""
    letters = {c: r[:1].upper() for c, r in readings.items() if len(c) == 1}
    read = F.translate(name, "".join(letters), "".join(letters.values())) if letters else name
    return F.upper(F.regexp_replace(read, "[^A-Za-z0-9]", ""))


def _folder(piece: Column) -> Column:
    return F.ascii(piece) % FOLDERS


def write_index(rows: DataFrame, path: str, columns: tuple[str, ...]) -> None:
    """Stores rows once for each piece that a column has in lower case, by the piece's first character, sorted: a search reads the
    folders of its word's pieces, and there the pages that hold them. rows: the columns searched and those that are shown."""
    texts = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in columns])
    cut = F.flatten(F.transform(texts, lambda t: F.when(F.length(t) >= PIECE, F.transform(F.sequence(F.lit(1), F.length(t) - PIECE + 1), lambda i: F.substring(t, i, PIECE))).otherwise(F.array())))
    pieces = rows.withColumn("piece", F.explode(F.array_distinct(cut)))
    dealt = pieces.withColumn("folder", _folder(F.col("piece"))).hint("rebalance", "folder")
    dealt.sortWithinPartitions("folder", "piece").write.partitionBy("folder").parquet(f"{path}/pieces")
    rows.write.parquet(f"{path}/rows")


def search(spark: SparkSession, path: str, keyword: str, columns: tuple[str, ...], order: str, top: int = 50) -> DataFrame:
    """The first rows by `order` of which a column holds a word, whatever its case; from the piece of the word with the fewest rows,
    or for a word shorter than a piece from all rows."""
    word = keyword.lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(word)
    pieces = sorted({word[i : i + PIECE] for i in range(len(word) - PIECE + 1)})
    if not pieces:
        return spark.read.parquet(f"{path}/rows").where(hit).orderBy(order).limit(top)
    stored = spark.read.parquet(f"{path}/pieces")
    of = lambda some: stored.where(F.col("folder").isin(sorted({_ascii(p) % FOLDERS for p in some})) & F.col("piece").isin(list(some)))
    counts = {r.piece: r["count"] for r in of(pieces).groupBy("piece").count().collect()}  # as many as the word has pieces
    rarest = min(pieces, key=lambda p: (counts.get(p, 0), p))
    return of([rarest]).where(hit).drop("piece", "folder").orderBy(order).limit(top)


def _ascii(piece: str) -> int:
    return ord(piece[0]) if ord(piece[0]) < 0x10000 else 0xD800 + (ord(piece[0]) - 0x10000 >> 10)


def matching(rows: DataFrame, pattern: str, columns: tuple[str, ...], order: str, top: int = 50) -> DataFrame:
    """The first rows of which a column matches a regular expression, whatever its case: a scan, as no piece need be in all matches."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c), F.lit("")).rlike(f"(?i){pattern}")
    return rows.where(hit).orderBy(order).limit(top)


def page_of_sectors(sectors: DataFrame, ranked: DataFrame, exclusions: DataFrame, number: int, size: int, keyword: str | None = None, mode: str | None = None, least: int = 0, readings: dict[str, str] | None = None, columns: tuple[str, ...] = ("rps_10", "rps_20", "rps_50")) -> DataFrame:
    """A page, counted from 1, of sectors by code: code, name, stock_count, their ranks on the newest date that any sector has, and
    total, how many there are on all pages. mode: enabled or disabled, by the exclusions of sectors from syncing; otherwise all.
    keyword: in code, name or initials, whatever its case. least: stocks that a sector must have."""
    newest = ranked.join(F.broadcast(ranked.agg(F.max("trade_date").alias("trade_date"))), "trade_date").select("code", *columns)
    held = sectors.where(F.col("stock_count") >= least).select("code", "name", "stock_count")
    if mode in ("enabled", "disabled"):
        gone = exclusions.where("category = 'sector' AND exclude_sync").select("code").distinct()
        held = held.join(gone, "code", "left_anti" if mode == "enabled" else "left_semi")
    if keyword:
        word = keyword.lower()
        texts = F.lower("code"), F.lower("name"), F.lower(initials(F.col("name"), readings or {}))
        held = held.where(texts[0].contains(word) | texts[1].contains(word) | texts[2].contains(word))
    total = held.agg(F.count("*").alias("total"))
    return held.join(newest, "code", "left").orderBy("code").offset((number - 1) * size).limit(size).join(F.broadcast(total))
