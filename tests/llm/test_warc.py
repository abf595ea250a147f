import gzip
import hashlib
from pathlib import Path

import pytest

from eventloom.llm import warc


def page_rows():
    long = "<p>é</p>" * 200
    return [
        (1, "http://a/1", long, 0), (9, "http://a/9", long, 0), (5, "http://a/5", long, 0), (None, "http://a/n", long, 0),
        (2, "http://b\r\nX: y", "short", 0), (3, None, "short", 0), (4, "http://c/ü", None, 0), (6, "http://d", "", 0),
        (7, "http://e", "x" * 3_000_000, 0), (8, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n" * 100, 0), (8, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n" * 100, 0),
    ]


def expected(rows, least=1000):
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = [k for k, _, h, _ in rows if (h or "").encode() == data and k is not None]
        last = max(same, default=None) if len(data) >= least else i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), *(("revisit", last) if last != i else ("response", None))))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def archive(spark):
    return warc.archived(spark.createDataFrame(page_rows(), "page_id long, url string, html string, Payload int").repartition(3))


def test_round_trip(spark, archive):
    got = warc.records(archive).collect()
    as_long = lambda x: None if x is None else int(x)
    assert sorted(str((as_long(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, as_long(r.refers_to))) for r in got) == expected(page_rows())
    full = sorted((str(r.page_id), bytes(r.payload)) for r in warc.restored(warc.records(archive)).collect())
    assert full == sorted((str(i), (h or "").encode()) for i, _, h, _ in page_rows())
    assert {r.page_id: r.url for r in got if r.page_id in ("2", "3", "4")} == {"2": "http://b%0D%0AX:%20y", "3": None, "4": "http://c/ü"}


def test_any_shuffle_gives_the_same_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    got = warc.records(warc.archived(spark.createDataFrame(page_rows(), "page_id long, url string, html string, n int"), file_bytes=100)).collect()
    assert len({r.file for r in got}) > 1
    assert sorted(str((r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to))) for r in got) == expected(page_rows())


def test_chosen_records_and_index_of_files(spark, archive):
    got = warc.records(archive.where("page_id in ('7', '9')"), gap=0, most=1).collect()
    assert {(r.page_id, len(r.payload)) for r in got} == {("7", 3_000_000), ("9", 1800)}
    again = warc.indexed(spark, sorted({r.file for r in archive.select("file").collect()}))
    assert sorted(map(str, again.collect())) == sorted(map(str, archive.collect()))


def test_archives_are_gzip_files_of_records(archive):
    for file in {r.file for r in archive.collect()}:
        assert gzip.decompress(Path(file.removeprefix("file://")).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_a_wrong_payload_is_an_error():
    raw = gzip.decompress(warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + "A" * 32), ("Payload-Length", 1)], b"HTTP/1.1 200 OK\r\n\r\nx"))
    with pytest.raises(ValueError, match="digest"):
        warc._record("f", 0, raw)
    with pytest.raises(ValueError, match="WARC"):
        warc.parsed(b"HTTP/1.1 200 OK\r\n\r\n")


def test_ranges_are_joined_up_to_their_bounds():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 40, 100), ("b", 0, 1)]
    assert [len(g) for g in warc.ranges(iter(rows), 5, 1000)] == [3, 1, 1]
    assert [len(g) for g in warc.ranges(iter(rows), 5, 20)] == [2, 1, 1, 1]
    assert [len(g) for g in warc.ranges(iter(rows), 0, 1000)] == [2, 1, 1, 1]
    assert list(warc.ranges(iter([]), 0, 1)) == []


def test_no_pages(spark):
    index = warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.records(index).count() == 0
