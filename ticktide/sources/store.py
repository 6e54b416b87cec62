"""Stored tables: snapshots that outlive a crash, tables filled when first asked for, bars laid out for windows."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Part of the name of filled tables: another number after a change of what they hold.
FORMAT = 2
#: Bytes of files that a round of partitions reads, if it is more than one partition.
ROUND = 128 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where that is unset and all runs on one machine (tests) a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ticktide-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


@contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a job's shuffle files go when the job ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Snapshots:
    """A table as Parquet folders, one a partition, and numbered manifests that say which folders make it up.

    A write makes new folders and then a manifest, in one file that is created and never changed. Readers take the newest manifest
    that is whole, so a job that ends at any point before leaves the table as it was, and a second writer of the same number fails.
    A manifest has a line for each partition: families times years or months. It lists a partition's folders with their bytes; those
    after the first were added to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, inner: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inner}" if inner else self.path)

    def _listed(self, inner: str) -> list[str]:
        at = self._at(inner)
        return [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []

    def numbers(self) -> list[int]:
        """All numbers taken, newest first, also those of manifests that aren't whole."""
        return sorted((int(n) for n in self._listed("manifests") if n.isdigit()), reverse=True)

    def _manifest(self, number: int) -> dict[str, list] | None:
        stream = self._files.open(self._at(f"manifests/{number}"))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            return {k: [[v, 0]] if isinstance(v, str) else v for k, v in held.items()}  # older ones name one folder
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def parts(self) -> dict[str, list] | None:
        """The folders of each partition, with their bytes, in the newest whole manifest; None before the first."""
        return next((m for n in self.numbers() if (m := self._manifest(n)) is not None), None)

    def read(self, schema: StructType | None = None, wanted: Callable[[str], bool] = lambda partition: True) -> DataFrame:
        """The rows of the partitions that are wanted; partitions are named by their values, joined by /. schema: read from the files
        if it isn't given, which a table without any doesn't allow."""
        folders = [f"{self.path}/{folder}" for partition, held in sorted((self.parts() or {}).items()) if wanted(partition) for folder, _ in held]
        if not folders:
            if schema is None:
                raise ValueError(f"nothing is stored in {self.path}")
            return self.spark.createDataFrame([], schema)
        return (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(*folders)

    def replace(self, rows: DataFrame | Iterable[DataFrame], by: dict[str, Column], emptied: Iterable[str] = (), sort: tuple[str, ...] = ("code", "trade_date"), dealt: bool = False) -> None:
        """Puts rows in the place of the partitions that they are of, and leaves out those listed as emptied; the others stay. by: what
        the partition columns are called and made of. Spark deals a partition's rows to as many files as its size asks for. dealt: the
        rows are large parts already, as of a shuffle by date, and a task writes a file for each partition that it has rows of. Several
        tables are written one after the other, each before the next is asked for, and then listed together."""
        new: dict[str, list] = {}
        for table in [rows] if isinstance(rows, DataFrame) else rows:
            for k, v in self._written(table, by, sort, dealt).items():
                new[k] = new.get(k, []) + v
        self._list({k: v for k, v in (self.parts() or {}).items() if k not in set(emptied)} | new)

    def add(self, rows: DataFrame, by: dict[str, Column], sort: tuple[str, ...] = ("code", "trade_date")) -> list[str]:
        """Puts rows beside those of the partitions that they are of. Gives the partitions to which as much was added as was in them at
        first: merging these whenever they are given costs a few times the writing of what was added, however many additions there are."""
        new = self._written(rows, by, sort, False)
        if not new:
            return []
        held = self.parts() or {}
        new = {k: held.get(k, []) + v for k, v in new.items()}
        self._list(held | new)
        return [k for k, (first, *added) in new.items() if added and sum(n for _, n in added) >= first[1]]

    def fill(self, rows: DataFrame, compare: Callable[[DataFrame], DataFrame], sort: tuple[str, ...] = ("code", "trade_date")) -> None:
        """Stores by family and year what compare makes of rows, of which it needs whole dates. Rows are staged as files and compared a
        round of partitions at a time, so that the exchanges before and in compare don't lie on disk together, nor those of all dates."""
        staged = Snapshots(self.spark, f"{self.path}/staged/{uuid.uuid4().hex}")

        def made() -> Iterator[DataFrame]:
            for some in rounds(staged):
                yield compare(staged.read(rows.schema, some.__contains__))
                staged.drop(some)

        with exchanges_dropped(self.spark):
            staged.replace(rows, by_family_and_year(), dealt=True)
            self.replace(made(), by_family_and_year(), sort=sort, dealt=True)
        self.remove(staged.path)

    def drop(self, partitions: Iterable[str]) -> None:
        """Removes the files of partitions, of a staged table that nobody else reads."""
        held = self.parts() or {}
        for partition in partitions:
            for folder, _ in held.get(partition, []):
                self.remove(f"{self.path}/{folder}")

    def _written(self, rows: DataFrame, by: dict[str, Column], sort: tuple[str, ...], dealt: bool) -> dict[str, list]:
        """The new folder of each partition that rows are of."""
        folder = f"data/{uuid.uuid4().hex}"
        keys = [f"_{name}" for name in by]
        named = rows.withColumns({f"_{name}": value for name, value in by.items()})
        (named if dealt else named.hint("rebalance", *keys)).sortWithinPartitions(*keys, *sort).write.option("compression", "zstd").partitionBy(*keys).parquet(f"{self.path}/{folder}")
        found = [""]
        for _ in keys:
            found = [f"{a}/{b}" for a in found for b in self._listed(folder + a) if "=" in b]
        size = lambda at: self._files.getContentSummary(self._at(folder + at)).getLength()
        return {"/".join(step.split("=", 1)[1] for step in at[1:].split("/")): [[folder + at, size(at)]] for at in found if at}

    def _list(self, parts: dict[str, list]) -> None:
        """Writes the next manifest."""
        number = max(self.numbers(), default=-1) + 1
        out = self._files.create(self._at(f"manifests/{number}"), False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()

    def remove(self, path: str) -> None:
        self._files.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)

    def forget(self, keep: int = 2) -> None:
        """Removes all manifests but the newest and the folders that none of these has. Not while another job reads old ones."""
        numbers = self.numbers()
        held = {folder.split("/")[1] for n in numbers[:keep] for folders in (self._manifest(n) or {}).values() for folder, _ in folders}
        for n in numbers[keep:]:
            self.remove(f"{self.path}/manifests/{n}")
        for name in self._listed("data"):
            if name not in held:
                self.remove(f"{self.path}/data/{name}")


def rounds(*tables: Snapshots, beside: Snapshots | None = None) -> Iterator[set[str]]:
    """The partitions of some tables in groups of as many bytes as a round reads, or of one partition. beside: a table that is read
    with them."""
    sizes: dict[str, int] = {}
    for table in tables:
        for partition, held in (table.parts() or {}).items():
            sizes[partition] = sizes.get(partition, 0) + sum(n for _, n in held)
    for partition, held in ((beside.parts() if beside else None) or {}).items():
        if partition in sizes:
            sizes[partition] += sum(n for _, n in held)
    some, total = set(), 0
    for partition, n in sorted(sizes.items()):
        if some and total + n > ROUND:
            yield some
            some, total = set(), 0
        some, total = some | {partition}, total + n
    if some:
        yield some


def year_of(trade_date: str = "trade_date") -> Column:
    return F.substring(trade_date, 1, 4)


def by_family_and_year() -> dict[str, Column]:
    return {"family": F.col("data_type"), "year": year_of()}


def filled(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], sort: tuple[str, ...] = ("code", "trade_date"), compare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A table of bars and what is derived from them, stored by family and year: built when first asked for, read after that, as long
    as the inputs are the same files (paths, lengths, times) and the same folder is shared. compare: what is made of whole dates of
    what build gives, if anything."""
    marks = []
    for path in inputs:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in [files.getFileStatus(at), *(files.listStatus(at) if files.getFileStatus(at).isDirectory() else [])]:
            marks.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    mark = hashlib.sha256(json.dumps([FORMAT, sorted(marks)]).encode()).hexdigest()[:24]
    table = Snapshots(spark, f"{shared_folder(spark)}/filled/{name}-{mark}")
    if table.parts() is None:
        if compare is None:
            table.replace(build(), by_family_and_year(), sort=sort, dealt=True)
        else:
            table.fill(build(), compare, sort)
    return table.read(None if table.parts() else (compare or (lambda rows: rows))(build()).schema)


#: Columns by which stored bars are dealt to buckets, and their order there: that of every window over an instrument.
BUCKETED, SORTED = ("data_type", "code"), ("data_type", "code", "trade_date")


def lay_out(bars: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes bars at path in buckets by instrument, a sorted file for each, so that windows over instruments need no exchange and
    no sort. More rows want more buckets: a bucket is one task's work."""
    name = f"laid_out_{uuid.uuid4().hex}"
    dealt = bars.repartition(buckets, *BUCKETED)
    dealt.write.format("parquet").bucketBy(buckets, *BUCKETED).sortBy(*SORTED).option("path", path).saveAsTable(name)
    bars.sparkSession.sql(f"DROP TABLE {name}")


def laid_out(spark: SparkSession, path: str, schema: StructType, buckets: int = 64) -> DataFrame:
    """The bars that lay_out() wrote at path, with as many buckets. Sets the session to trust that buckets are sorted files."""
    name = f"laid_out_{hashlib.sha256(f'{path} {buckets}'.encode()).hexdigest()[:24]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({', '.join(BUCKETED)}) SORTED BY ({', '.join(SORTED)}) INTO {buckets} BUCKETS")
    return spark.table(name)
