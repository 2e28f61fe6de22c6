"""WARC archives: round trips, revisits, coalesced reads, what a failed task leaves."""

import gzip

import pytest
from pyspark.sql import functions as F

from chromagrid.llm import warc

SCHEMA = "page_id bigint, url string, html string, file string, length int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], SCHEMA)


def odd_rows():
    big = "ü<p>" * 400
    rows = [(1, "http://a/1", None), (2, None, ""), (3, "http://a/\r\nX: 1", "x"), (4, "http://a/4", "x"), (5, "u", big), (6, "v", big), (9, None, big), (None, "w", big), (None, "w", "z" * 5000), (None, "q", "z" * 5000)]
    return rows + [(20, "t", "t" * 1000), (20, "t", "t" * 1000), (19, "t", "t" * 1000), (30, "s", "s" * 999), (31, "s", "s" * 999), (40, "l", "\r\n\r\n long " * 200_000)]


def test_records_and_revisits(spark):
    rows = odd_rows()
    index = warc.write(frame(spark, rows))
    got = {}
    for r in warc.read(index).collect():
        got.setdefault((r.page_id, r.payload_digest), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    one = lambda i: next(r for (p, _), rs in got.items() if p == i for r in rs)
    assert [(one(i).record_type, one(i).refers_to) for i in (1, 2, 3, 4, 9, 5, 6, 20, 19, 30, 31)] == [*[("response", None)] * 5, ("revisit", 9), ("revisit", 9), ("response", None), ("revisit", 20), *[("response", None)] * 2]
    assert sorted((r.record_type, r.refers_to) for (p, _), rs in got.items() if p is None for r in rs if r.payload_bytes == 5000) == [("response", None)] * 2
    assert all(bytes(r.payload) == b"" for rs in got.values() for r in rs if r.record_type == "revisit")
    assert {(r.page_id, r.payload_bytes) for rs in got.values() for r in rs} == {(i, len((h or "").encode())) for i, _, h in rows}


def test_payloads_come_back(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    index = warc.write(frame(spark, rows))
    back = {(r.page_id, bytes(r.payload).decode()) for r in warc.pages(index, index).collect()}
    assert back == {(i, h or "") for i, _, h in rows}
    some = {r.page_id: bytes(r.payload).decode() for r in warc.pages(index.where("page_id in (5, 40)"), index).collect()}
    assert some == {i: h for i, _, h in rows if i in (5, 40)}


def test_archives_are_gzip_members_of_bounded_files(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write(frame(spark, [(i, "u", f"text {i} " * 90) for i in range(40)]).coalesce(1), folder=folder, archive_bytes=4000)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 1
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: response") == 40 and whole.count(b"WARC-Type: warcinfo") == len(files)
    (tmp_path / "w" / "left-by-a-lost-task.warc.gz").write_bytes(b"half a rec")
    assert warc.read(index).count() == 40


def test_damage_is_found(spark, tmp_path):
    index = warc.write(frame(spark, [(1, "u", "abc" * 500)]), folder=str(tmp_path / "w"))
    raw = warc.record("response", [("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc")
    file = next((tmp_path / "w").glob("*.gz"))
    file.write_bytes(raw)
    with pytest.raises(Exception, match="the payload is not what its header says"):
        warc.read(index.withColumns({"offset": F.lit(0).cast("bigint"), "length": F.lit(len(raw)).cast("bigint")})).collect()


def test_spans_join_neighbours():
    near, far = [("a", 0, 10), ("a", 10, 5), ("a", 100, 10)], [("a", 10 + warc.GAP * 2, 7), ("b", 0, 3), ("b", 3, warc.SPAN), ("b", 3 + warc.SPAN, 1)]
    assert [(f, b, e, n) for f, b, e, n in warc.spans(near + far)] == [("a", 0, 110, [0, 1, 2]), ("a", 10 + warc.GAP * 2, 17 + warc.GAP * 2, [3]), ("b", 0, 3, [4]), ("b", 3, 3 + warc.SPAN, [5]), ("b", 3 + warc.SPAN, 4 + warc.SPAN, [6])]


def test_no_pages(spark):
    index = warc.write(frame(spark, []))
    assert index.count() == 0 and warc.read(index).count() == 0 and warc.pages(index, index).count() == 0
