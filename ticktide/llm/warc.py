"""WARC archives of pages: written as whole-file gzip streams, normalised to a gzip member for each record, read by offsets.

write() gives each row of pages a record, a task's records in one gzip stream after another of at most ARCHIVE_BYTES inflated.
normalise() inflates each such stream once, from its first byte to its last, writes every record as a gzip member of its own and
beside each archive a sidecar, <archive>.cdx, with a line for each record: offset, length, type and id. read() takes the lines,
deals them out by archive and offset, reads the ranges that they name and checks what it finds there.

Of pages whose payloads (html in UTF-8) are equal and have at least LEAST_BYTES bytes, that with the smallest page_id is a response
and the others are revisits: records without payload that name the response. Payloads are equal if their SHA-256 digests are.

Tasks open files by pyarrow.fs (file, hdfs, viewfs, s3, gs, abfs). Each attempt of a task writes names of its own, and a table that
Spark commits lists those that count, so what a lost executor has written is never read. Records pass in pieces; what is held in
memory is a member as it is stored, never an archive.

Null html: an empty payload. Null url: no target address. Null page_id: no such field; it comes after every other id. Rows that
share the smallest page_id of equal payloads are all responses. Texts of any length are written whole; blanks and control
characters in an address are escaped. An empty table gives no archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktide.llm import common

#: Bytes of the smallest payload that is stored once, inflated bytes of an archive, bytes that are inflated at once, and bytes of
#: members that a task reads back.
LEAST_BYTES, ARCHIVE_BYTES, PIECE, RANGE_BYTES = 100, 1 << 28, 1 << 20, 8 << 20
#: Fixed values of the format.
BLANK_LINE = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARCHIVES = "archive string, n_records long, n_bytes long"
_LINES = "offset long, length long, record_type string, record_id string"
_FOUND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full address, as tasks open it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", full))


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    return files, root


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> list[bytes]:
    """The parts of a page's record: a response, or a revisit of the page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + BLANK_LINE
    body = [http] if refers_to is not None else [http, payload]
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date}
    fields |= {"WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)} if url is not None else {}
    fields |= {"Page-Id": page_id} if page_id is not None else {}
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "Refers-To-Page-Id": refers_to}
    fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": sum(map(len, body))}
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items())]).encode("utf-8", "surrogateescape") + BLANK_LINE
    return [head, *body, BLANK_LINE]


def fields_of(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case."""
    first, *lines = head.decode("utf-8", "surrogateescape").rstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not the start of a record: {first[:80]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def gzip(level: int):
    return zlib.compressobj(level, zlib.DEFLATED, 31)


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of one gzip stream, or of several that follow each other, in pieces; a stream that ends too early is an error."""
    z, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            begun = True
            if out := z.decompress(piece, PIECE):
                yield out
            piece = z.unconsumed_tail
            if z.eof:
                piece, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        if out := z.flush():
            yield out
        if not z.eof:
            raise ValueError("the archive is cut off")


class Records:
    """The records of a stream of inflated bytes, one after another."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.held, self.at = self.held[self.at :] + piece, 0
        return piece is not None

    def head(self) -> bytes | None:
        """The next record's fields with the blank line after them; None at the end."""
        searched = 0
        while (end := self.held.find(BLANK_LINE, self.at + searched)) < 0:
            searched = max(0, len(self.held) - self.at - len(BLANK_LINE) + 1)
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("the last record is cut off")
                return None
        found, self.at = self.held[self.at : end + len(BLANK_LINE)], end + len(BLANK_LINE)
        return found

    def body(self, size: int) -> Iterator[bytes]:
        """The next bytes, in pieces."""
        while size > 0:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the last record is cut off")
            piece = self.held[self.at : self.at + size]
            self.at += len(piece)
            size -= len(piece)
            yield piece

    def rest(self) -> Iterator[bytes]:
        yield self.held[self.at :]
        yield from self.pieces

    def end(self) -> None:
        if b"".join(self.body(len(BLANK_LINE))) != BLANK_LINE:
            raise ValueError("a record isn't as long as it says")


def _pieces(stream: pa.NativeFile) -> Iterator[bytes]:
    return iter(lambda: stream.read(PIECE), b"")


def told(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest of each page, and in refers_to the page that its record revisits."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    named = named.withColumn("digest", F.sha2("html", 256))
    copies = named.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = common.looked_up(named, "digest", common.stored(copies, "copies"), "n")
    return met.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write(pages: DataFrame, folder: str, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """archive, n_records, n_bytes (inflated) of the archives that it has written in folder, each one gzip stream."""
    root = qualified(pages.sparkSession, folder)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _opened(root)
        out = None

        def closed() -> pa.RecordBatch:
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name, n, size, z = f"{uuid.uuid4().hex}.warc.gz", 0, 0, gzip(level)
                    out = files.open_output_stream(f"{at}/{name}", compression=None)
                for part in record(page_id.as_py(), _text(url), html.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py(), date):
                    out.write(z.compress(part))
                    size += len(part)
                n += 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = told(pages).withColumns({"url": F.col("url").cast("binary"), "html": F.col("html").cast("binary")})
    return common.stored(rows.mapInArrow(written, _ARCHIVES), "archives")


def _text(value: pa.BinaryScalar) -> str | None:
    return value.as_buffer().to_pybytes().decode("utf-8", "surrogateescape") if value.is_valid else None


def normalise(archives: DataFrame, folder: str, into: str, level: int = 6) -> DataFrame:
    """archive, n_records, n_bytes (of its members) of the archives in `into`, for the listed ones in folder. An archive is one task's
    work, as a gzip stream can be read from its start alone."""
    spark = archives.sparkSession
    source, target = qualified(spark, folder), qualified(spark, into)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _opened(source)
        out_files, out_at = _opened(target)
        for batch in batches:
            for old in batch.column("archive").to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                with files.open_input_stream(f"{at}/{old}", compression=None) as stream, out_files.open_output_stream(f"{out_at}/{name}", compression=None) as out, out_files.open_output_stream(f"{out_at}/{name}.cdx", compression=None) as sidecar:
                    n, offset, records = 0, 0, Records(inflated(_pieces(stream)))
                    while (head := records.head()) is not None:
                        fields, z, begin = fields_of(head), gzip(level), offset
                        offset += out.write(z.compress(head))
                        for piece in records.body(int(fields["content-length"])):
                            offset += out.write(z.compress(piece))
                        records.end()
                        offset += out.write(z.compress(BLANK_LINE) + z.flush())
                        sidecar.write(f"{begin}\t{offset - begin}\t{fields['warc-type']}\t{fields['warc-record-id']}\n".encode())
                        n += 1
                yield pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n], "n_bytes": [offset]})

    n_archives = max(1, archives.count())
    made = common.stored(archives.select("archive").repartition(n_archives).mapInArrow(rewritten, _ARCHIVES), "members")
    total = lambda df: df.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    if total(made) != total(archives):
        raise ValueError("the normalised archives hold another number of records")
    return made


def index(archives: DataFrame, folder: str) -> DataFrame:
    """archive, offset, length, record_type, record_id out of the sidecars of the listed archives."""
    lines = archives.sparkSession.read.schema(_LINES).option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.cdx").csv(folder)
    named = lines.withColumn("archive", F.regexp_replace(F.col("_metadata.file_name"), r"\.cdx$", ""))
    return named.join(archives.select("archive"), "archive", "left_semi")


def read(archives: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the records of normalised archives, by their sidecars;
    payload: with the payload itself, null for revisits. Payloads are checked against their digests, revisits against responses."""
    spark, root = archives.sparkSession, qualified(archives.sparkSession, folder)
    sums = archives.agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_records").alias("n_records")).first()
    schema = _FOUND + (", payload binary" if payload else "")
    if not sums.n_records:
        return spark.createDataFrame([], schema)
    columns = [(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns)})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _opened(root)
        name, stream, rows, size = None, None, [], 0
        for batch in batches:
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if stream is not None:
                        stream.close()
                    name, stream = archive, files.open_input_file(f"{at}/{archive}")
                rows.append(_parsed(Records(inflated(iter([stream.read_at(length, offset)]))), payload))
                size += rows[-1][2] if payload else 64
                if size >= 16 * PIECE:
                    yield batch_of(rows)
                    rows, size = [], 0
        if stream is not None:
            stream.close()
        yield batch_of(rows)

    ranges = index(archives, folder).select("archive", "offset", "length").repartitionByRange(max(1, -(-sums.n_bytes // RANGE_BYTES)), "archive", "offset")
    records = common.stored(ranges.sortWithinPartitions("archive", "offset").mapInArrow(found, schema), "records")
    if records.count() != sums.n_records:
        raise ValueError("records are missing from the sidecars")
    what = ["payload_digest", "payload_bytes"]
    asked = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *what).distinct()
    if not asked.join(records.where("record_type = 'response'").select("page_id", *what), ["page_id", *what], "left_anti").isEmpty():
        raise ValueError("a revisit's response is missing")
    return records


def _parsed(records: Records, payload: bool) -> tuple:
    """A row of read() out of the only record of a member."""
    fields = fields_of(records.head())
    http, digest, size, kept = Records(records.body(int(fields["content-length"]))), hashlib.sha256(), 0, []
    head = http.head()
    for piece in http.rest():
        digest.update(piece)
        size += len(piece)
        if payload:
            kept.append(piece)
    records.end()
    kind, said, number = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), lambda x: None if x is None else int(x)
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
    if kind == "response" and (digest.hexdigest() != said or size != length):
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't as its record says")
    url = fields.get("warc-target-uri")
    url = url and url.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    row = number(fields.get("page-id")), url, length, said, kind, number(fields.get("refers-to-page-id"))
    return (*row, b"".join(kept) if kind == "response" else None) if payload else row

