"""WARC archives against the pages that they were written from, and the formats against zlib and plain parsing."""

import gzip
import hashlib
import zlib

import pytest

from ticktide.llm import common, warc

LONG = "x\r\n\r\n<p>é" * 400_000
PAGES = [
    (1, "http://a/1", "a" * 99), (2, "http://a/2", "a" * 99), (3, "http://a/3", "é" * 50), (4, "http://a/4\r\nX: y", "é" * 50), (5, None, "é" * 50),
    (6, "http://a/6", ""), (7, "http://a/é 7", None), (8, "http://a/8", LONG), (9, "http://a/9", LONG), (3, "http://a/3b", "é" * 50),
    (None, "http://a/n", "é" * 50), (None, "http://a/m", "n" * 200), (None, "http://a/m", "n" * 200), (12, "http://a/12", "WARC/1.1\r\n\r\n" * 20),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, first long, digest string")


def round_trip(spark, df, name):
    folder = common.fresh_path(spark, name)
    streams = warc.write(df, f"{folder}/streams")
    members = warc.normalise(streams, f"{folder}/streams", f"{folder}/members")
    return folder, streams, members


def plain(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        revisit = first is not None and first != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_read_back_equals_pages(spark):
    folder, _, members = round_trip(spark, pages(spark, PAGES), "warc-test")
    found = warc.read(members, f"{folder}/members", payload=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str) == plain(PAGES)
    want = {(p, (h or "").encode()) for p, _, h in PAGES}
    assert {(r.page_id, bytes(r.payload)) for r in found if r.record_type == "response"} <= want
    assert {r.payload is None for r in found if r.record_type == "revisit"} == {True}
    urls = {r.page_id: r.url for r in found}
    assert urls[5] is None and urls[7] == "http://a/é%207" and urls[4] == "http://a/4%0D%0AX:%20y"


def test_streams_are_whole_and_members_stand_alone(spark):
    folder, streams, members = round_trip(spark, pages(spark, PAGES).coalesce(1), "warc-files")
    local = lambda part: warc.qualified(spark, f"{folder}/{part}").removeprefix("file://")
    (stream,) = streams.collect()
    data = open(f"{local('streams')}/{stream.archive}", "rb").read()
    z = zlib.decompressobj(31)
    whole = z.decompress(data)
    assert z.eof and not z.unused_data and len(whole) == stream.n_bytes and stream.n_records == len(PAGES)
    (archive,) = members.collect()
    data = open(f"{local('members')}/{archive.archive}", "rb").read()
    assert gzip.decompress(data) == whole and len(data) == archive.n_bytes
    at = 0
    for line in open(f"{local('members')}/{archive.archive}.cdx"):
        offset, length, kind, name = line.rstrip("\n").split("\t")
        assert int(offset) == at
        at += int(length)
        text = gzip.decompress(data[int(offset) : at])
        fields = warc.fields_of(text.split(warc.BLANK_LINE)[0])
        assert fields["warc-type"] == kind and fields["warc-record-id"] == name and text.endswith(warc.BLANK_LINE)
        assert len(text) == text.index(warc.BLANK_LINE) + 4 + int(fields["content-length"]) + 4
    assert at == len(data)


def test_groups_and_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE_BYTES", 4_000)
    monkeypatch.setattr(common, "SENT_KEYS", 3)
    rows = [(i, f"http://h/{i}", "copy " * 100 if i % 3 == 0 else f"pair {i // 7} " * 30) for i in range(400, 0, -1)]
    folder, streams, members = round_trip(spark, pages(spark, rows).repartition(5), "warc-many")
    assert streams.count() == members.count() > 5
    found = warc.read(members, f"{folder}/members")
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()], key=str) == plain(rows)


def test_empty_table(spark):
    folder, _, members = round_trip(spark, pages(spark, []), "warc-empty")
    assert warc.read(members, f"{folder}/members").collect() == []


def test_damage_is_an_error(spark):
    folder, streams, members = round_trip(spark, pages(spark, PAGES).coalesce(1), "warc-damage")
    local = warc.qualified(spark, folder).removeprefix("file://")
    (stream,), (archive,) = streams.collect(), members.collect()
    path = f"{local}/streams/{stream.archive}"
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.normalise(streams, f"{folder}/streams", f"{folder}/again")
    sidecar = f"{local}/members/{archive.archive}.cdx"
    lines = open(sidecar).read().splitlines(keepends=True)
    open(sidecar, "w").writelines(lines[:-1])
    with pytest.raises(ValueError, match="missing"):
        warc.read(members, f"{folder}/members")


def test_streams_of_several_members_and_small_pieces():
    records = [warc.record(i, f"http://a/{i}", b"\r\n\r\n" * i, hashlib.sha256(b"\r\n\r\n" * i).hexdigest(), None, "1970-01-01T00:00:00Z") for i in range(30)]
    whole = b"".join(b"".join(r) for r in records)
    data = gzip.compress(whole[:1000]) + gzip.compress(whole[1000:])
    for step in (1, 7, 1000, len(data)):
        found = warc.Records(warc.inflated(data[i : i + step] for i in range(0, len(data), step)))
        for r in records:
            head = found.head()
            assert head == r[0]
            assert b"".join(found.body(int(warc.fields_of(head)["content-length"]))) == b"".join(r[1:-1])
            found.end()
        assert found.head() is None
