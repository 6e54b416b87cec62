"""Sources that vendors' tools leave behind: binary day files and SQLite stores, read in parts by many tasks.

Tasks open files by pyarrow.fs, so a folder may be local, or in any store that it knows. Register with register(spark), then

    spark.read.format("day_files").load(folder)        spark.readStream.format("day_files").load(folder)
    spark.read.format("sqlite_files").option("table", "stock_daily").load(folder)
"""

from __future__ import annotations

import re
import sqlite3
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed values of day files: a record's fields, little-endian; prices are in hundredths.
RECORD = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("rest", "<u4")])
PRICES = ("open", "high", "low", "close")
DAY_SCHEMA = "code string, trade_date string, open double, high double, low double, close double, volume double, amount double"
#: Records of a page, and pages that a task reads of one file. Small files are read together, as many as have so many bytes or files.
PAGE, PAGES = 800, 64
TASK_BYTES, TASK_FILES = 16 << 20, 2000
#: Files that are moved into place at the same time.
RENAMES = 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", re.sub("^s3[an]:", "s3:", path)))


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files in a folder that end so, or the file itself."""
    files, at = opened(path)
    info = files.get_file_info(at)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(ending))


def day_rows(data: bytes, code: str, first: int = 0, last: int = 99_999_999) -> pa.RecordBatch:
    """Records as bars; those of no date, or outside of the dates, are left out, as is what is cut off at the end."""
    rows = np.frombuffer(data, RECORD, len(data) // RECORD.itemsize)
    rows = rows[(rows["date"] >= max(first, 19000101)) & (rows["date"] <= min(last, 99991231))]
    columns = [pa.array([code] * len(rows), pa.string()), pa.array(rows["date"].astype(str).tolist(), pa.string())]
    columns += [pa.array(rows[c] / 100.0) for c in PRICES] + [pa.array(rows[c].astype(float)) for c in ("volume", "amount")]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in DAY_SCHEMA.split(", ")])


def code_of(path: str) -> str:
    """sh600519.day, 600519.day and 600519-<any>.day are of 600519."""
    return re.sub("^(sh|sz|bj)", "", path.rsplit("/", 1)[-1].removesuffix(".day").split("-")[0])


@dataclass
class Pages:
    path: str
    offset: int
    size: int


@dataclass
class Together(InputPartition):
    """What one task reads."""

    pages: list[Pages]


def together(pages: list[Pages]) -> list[Together]:
    """Parts of files in their order, dealt to tasks: each part of a file of several is a task of its own, whole small ones share one."""
    made, held, size = [], [], 0
    n_parts = Counter(p.path for p in pages)
    for p in pages:
        if n_parts[p.path] > 1:
            made.append(Together([p]))
            continue
        if held and (size + p.size > TASK_BYTES or len(held) == TASK_FILES):
            made.append(Together(held))
            held, size = [], 0
        held.append(p)
        size += p.size
    return made + ([Together(held)] if held else [])


class _DayPages:
    """Reads parts of day files."""

    def __init__(self, options: dict):
        self.folder, self.first, self.last, self.codes = options["path"], 0, 99_999_999, None

    def parts(self, since: dict[str, int], until: dict[str, int] | None = None) -> list[Pages]:
        """Parts of what files hold beyond the bytes that are known of them."""
        step, made = PAGE * PAGES * RECORD.itemsize, []
        for path, size in listed(self.folder, ".day"):
            if self.codes is not None and code_of(path) not in self.codes:
                continue
            end = size // RECORD.itemsize * RECORD.itemsize if until is None else until.get(path, 0)
            made += [Pages(path, at, min(step, end - at)) for at in range(since.get(path, 0), end, step)]
        return made

    def read(self, partition: Together) -> Iterator[pa.RecordBatch]:
        """Batches of at least a page, as far as there are more rows."""
        files, _ = opened(self.folder)
        held, n = [], 0
        for pages in partition.pages:
            with files.open_input_file(pages.path) as file:
                for at in range(pages.offset, pages.offset + pages.size, PAGE * RECORD.itemsize):
                    rows = day_rows(file.read_at(min(PAGE * RECORD.itemsize, pages.offset + pages.size - at), at), code_of(pages.path), self.first, self.last)
                    held, n = [*held, rows], n + len(rows)
                    if n >= PAGE:
                        yield pa.concat_batches(held)
                        held, n = [], 0
        if n:
            yield pa.concat_batches(held)


class DayReader(_DayPages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of trade_date and a code are applied where pages are read; all are checked again by Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("trade_date",) and isinstance(value, str) and re.fullmatch(r"\d{8}", value):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first, int(value))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.last = min(self.last, int(value))
            elif column == ("code",) and isinstance(f, EqualTo):
                self.codes = {value} if self.codes is None else self.codes & {value}
            yield f

    def partitions(self) -> list[Together]:
        return together(self.parts({})) or [Together([])]


class DayStream(_DayPages, DataSourceStreamReader):
    """New records of growing files; an offset is how many bytes of each file are known."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: size // RECORD.itemsize * RECORD.itemsize for path, size in listed(self.folder, ".day")}

    def partitions(self, start: dict, end: dict) -> list[Together]:
        return together(self.parts(start, end))


@dataclass
class Written(WriterCommitMessage):
    staged: list[str]


class DayWriter(DataSourceArrowWriter):
    """A file for each code that a task has, staged under the task's own names and moved into place when all tasks are done. Deal the
    rows out by code, in order of code and date."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.folder)
        files.create_dir(f"{at}/staged", recursive=True)
        staged, code, out = [], None, None
        for batch in batches:
            frame = batch.to_pandas()
            for own, rows in frame.groupby("code", sort=False):
                if own != code:
                    if out is not None:
                        out.close()
                    code = own
                    staged.append(f"{at}/staged/{own}-{uuid.uuid4().hex}.day")
                    out = files.open_output_stream(staged[-1])
                made = np.zeros(len(rows), RECORD)
                made["date"] = rows["trade_date"].astype("int64")
                for c in PRICES:
                    made[c] = (rows[c] * 100).round()
                made["amount"], made["volume"] = rows["amount"], rows["volume"].round()
                out.write(made.tobytes())
        if out is not None:
            out.close()
        return Written(staged)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.folder)
        with ThreadPoolExecutor(RENAMES) as at_once:  # a rename for each file
            list(at_once.map(lambda path: files.move(path, f"{at}/{path.rsplit('/', 1)[-1]}"), [p for m in messages if m for p in m.staged]))
        files.delete_dir(f"{at}/staged")

    def abort(self, messages: list[Written | None]) -> None:
        files, at = opened(self.folder)
        files.delete_dir(f"{at}/staged")


class DayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return DAY_SCHEMA

    def reader(self, schema) -> DayReader:
        return DayReader(self.options)

    def streamReader(self, schema) -> DayStream:
        return DayStream(self.options)

    def writer(self, schema, overwrite: bool) -> DayWriter:
        return DayWriter(self.options)


#: Rows of a table that one task reads, ranges from which on small ones share a task, and rows of a batch.
ROWS, TASKS, AT_ONCE = 100_000, 200, 10_000
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_KINDS = {"INTEGER": "long", "INT": "long", "BIGINT": "long", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "TEXT": "string"}


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def connected(folder: str, path: str) -> sqlite3.Connection:
    """A read-only connection: to the file where it is local, else to its bytes."""
    files, _ = opened(folder)
    if isinstance(files, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    made = sqlite3.connect(":memory:")
    with files.open_input_file(path) as file:
        made.deserialize(file.read())
    return made


@dataclass
class Rows(InputPartition):
    path: str
    ranges: list[tuple[int, int]]


class SqliteReader(DataSourceReader):
    """A table of all SQLite files in a folder, in ranges of rowids; of more than TASKS, ranges of fewer than ROWS rows share a
    task. What a task that is lost has read is read again, from its ranges alone."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.table, self.columns = options["path"], options["table"], schema.fieldNames()
        self.kinds = [_ARROW[f.dataType.typeName()] for f in schema.fields]
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[Rows]:
        found = []
        for path, _ in listed(self.folder, ".sqlite"):
            with connected(self.folder, path) as source:
                first, last = source.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            if first is not None:
                found.append((path, [(at, min(at + self.rows - 1, last)) for at in range(first, last + 1, self.rows)]))
        n = max(min(sum(len(ranges) for _, ranges in found) // TASKS, ROWS // self.rows), 1)
        return [Rows(path, ranges[at : at + n]) for path, ranges in found for at in range(0, len(ranges), n)] or [Rows("", [])]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = ", ".join(f'"{c}"' for c in self.columns)
        with connected(self.folder, partition.path) as source:
            for bounds in partition.ranges:
                found = source.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', bounds)
                while rows := found.fetchmany(AT_ONCE):
                    made = [pa.array(map(_text, c) if k == pa.string() else c, k) for c, k in zip(zip(*rows), self.kinds)]
                    yield pa.RecordBatch.from_arrays(made, self.columns)


class SqliteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def _fields(self) -> list[tuple[str, str]]:
        path = listed(self.options["path"], ".sqlite")[0][0]
        with connected(self.options["path"], path) as source:
            return [(name, _KINDS.get(kind.upper(), "string")) for _, name, kind, *_ in source.execute(f'PRAGMA table_info("{self.options["table"]}")')]

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self._fields())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DayFiles)
    spark.dataSource.register(SqliteFiles)


def write_day_files(bars: DataFrame, folder: str) -> None:
    """Bars as day files in a folder: prices to hundredths, whole volumes, amounts as single floats."""
    register(bars.sparkSession)
    columns = [f.split()[0] for f in DAY_SCHEMA.split(", ")]
    bars.select(*columns).repartition("code").sortWithinPartitions("code", "trade_date").write.format("day_files").mode("append").save(folder)


def write_sqlite(rows: DataFrame, folder: str, table: str) -> DataFrame:
    """Rows as SQLite files in a folder, one for each task: path and n_rows of each, from which a later reading is checked. A task holds
    its file in memory."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}
    columns = ", ".join(f'"{c}" {kinds.get(t, "TEXT")}' for c, t in rows.dtypes)
    marks = ", ".join("?" * len(rows.columns))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = opened(folder)
        files.create_dir(at, recursive=True)
        made, n = sqlite3.connect(":memory:"), 0
        made.execute(f'CREATE TABLE "{table}" ({columns})')
        for batch in batches:
            made.executemany(f'INSERT INTO "{table}" VALUES ({marks})', zip(*(c.to_pylist() if c.null_count or not pa.types.is_floating(c.type) else c.to_numpy().tolist() for c in batch.columns)))
            n += len(batch)
        made.commit()
        path = f"{at}/{uuid.uuid4().hex}.sqlite"
        with files.open_output_stream(path) as out:
            out.write(made.serialize())
        yield pa.RecordBatch.from_pydict({"path": [path], "n_rows": [n]})

    return rows.mapInArrow(written, "path string, n_rows long")


def legacy_rows(spark: SparkSession, folder: str, table: str, n_rows: int | None = None, rows: int = ROWS) -> DataFrame:
    """A table of SQLite files; n_rows: how many rows there must be, others are an error."""
    register(spark)
    found = spark.read.format("sqlite_files").option("table", table).option("rows", rows).load(folder)
    if n_rows is not None and (n := found.agg(F.count("*")).first()[0]) != n_rows:
        raise ValueError(f"{table} has {n} rows, its source {n_rows}")
    return found
