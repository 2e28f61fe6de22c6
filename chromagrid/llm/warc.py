"""WARC archives with an index: written once, read back by byte ranges.

Each record is a gzip member of its own.  Writing puts a row per record into the index: file, offset, length,
URL and digest.  Reading starts from rows of the index: they are dealt by ranges of (file, offset),
sorted, and records that lie close together are fetched by one read of SPAN bytes at most, so a task holds
one span and never a file.

Equal payloads of ``least_bytes`` bytes or more are stored once: the record of the largest page id is the
response, the others are revisits that name it.  Smaller payloads are all responses.  Equality is by SHA-256,
the digest in the record is SHA-1.  A revisit keeps the HTTP header of its page, hence the length of
its payload too.

A task writes files of names that no other attempt has, and only the rows of tasks that ended well reach the
index: what a lost executor left is in no index and is never read.

Nulls: a null text is an empty payload, a null url gives a record without target, a null page id a record
without page; among equal payloads it counts as smallest.  Rows that share the largest page id of their
payload are all responses.  Line ends in a url are percent-encoded in the record; the index holds it as it was.
Further columns are not read.  An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, mapped, new_path, partitions, stored

#: Bytes of an archive after which a task begins the next.
ARCHIVE_BYTES = 1 << 30
#: Bytes between two records that are read along, and bytes of one read, at most (a longer record is read whole).
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes from which equal payloads are stored once.
LEAST = 1000
#: Bytes of a row of the table of repeated payloads: two digests, an id and a url.
GROUP_BYTES = 512

INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RECORD = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
NAMESPACE = uuid.UUID("6f1c2d0e-6f0b-5d55-9a43-7d5f0c2a9b11")


def _record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}{salt}')}>"


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines)]).encode() + b"\r\n\r\n"


def _target(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = _header([("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))], "WARC/1.1")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id: int | None, url: str | None, html: str | None, n_bytes: int, sha1: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    revisit = html is None
    ids = [("WARC-Record-ID", _record_id(page_id, ":revisit" * revisit)), ("WARC-Date", date)]
    ids += [("WARC-Target-URI", _target(url))] if url is not None else []
    ids += [("Page-Id", str(page_id))] if page_id is not None else []
    ids += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        ids += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to)), ("Refers-To-Page-Id", str(refers_to))]
        ids += [("WARC-Refers-To-Target-URI", _target(refers_url))] if refers_url is not None else []
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(n_bytes))], "HTTP/1.1 200 OK")
    return record("revisit" if revisit else "response", ids, http + (b"" if revisit else html.encode()))


def _writer(folder: str, date: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, n_bytes, sha1, refers_to, refers_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or at >= most:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        info = record("warcinfo", [("WARC-Record-ID", _record_id(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    member = page_record(page_id, url, html, n_bytes, sha1, refers_to, refers_url, date)
                    out.write(member)
                    rows.append((page_id, url, f"{folder}/{name}", at, len(member), n_bytes, sha1, "response" if html is not None else "revisit", refers_to))
                    at += len(member)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                if rows:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, least_bytes: int = LEAST, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and gives their index (INDEX), itself stored."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("bigint"))
    key = F.when(F.col("n_bytes") >= least_bytes, F.sha2("html", 256))
    newest = F.max(F.struct(F.col("page_id"), F.col("url")))
    groups = rows.select("page_id", "url", key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(newest.alias("newest"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1").select(F.col("key").alias("k"), F.col("newest.page_id").alias("to_id"), F.col("newest.url").alias("to_url")), "warc-repeated")
    # beyond the bound the same join shuffles, and hot payloads are split
    small = groups.count() * GROUP_BYTES <= BROADCAST_BYTES and (groups.agg(F.max(F.length("to_url"))).first()[0] or 0) < GROUP_BYTES // 2
    joined = rows.withColumn("key", key).join(F.broadcast(groups) if small else groups, F.col("key") == F.col("k"), "left")
    joined = joined.withColumn("revisit", F.col("k").isNotNull() & F.col("to_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("to_id")))
    sent = joined.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "n_bytes", F.sha1("html").alias("sha1"), F.when(F.col("revisit"), F.col("to_id")).alias("refers_to"), F.when(F.col("revisit"), F.col("to_url")).alias("refers_url"))
    return stored(mapped(sent, _writer(folder or new_path(pages.sparkSession, "warc"), date, archive_bytes), INDEX), "warc-index")


def parsed(member: bytes) -> tuple[int | None, str, int | None, int, str, bytes]:
    """The values of RECORD; of a response, length and digest are checked against its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload is not what its header says")
    page, to = (int(v) if (v := fields.get(k)) is not None else None for k in ("Page-Id", "Refers-To-Page-Id"))
    return page, fields["WARC-Type"], to, size, sha1, payload


def spans(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[int]]]:
    """Sorted (file, offset, length) -> (file, begin, end, numbers of the records within): neighbours share a read."""
    at: tuple[str, int, int, list[int]] | None = None
    for i, (file, offset, length) in enumerate(places):
        if at and file == at[0] and offset - at[2] <= GAP and offset + length - at[1] <= SPAN:
            at = (file, at[1], max(at[2], offset + length), at[3])
            at[3].append(i)
        else:
            if at:
                yield at
            at = (file, offset, offset + length, [i])
    if at:
        yield at


def _reader(payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for b in batches:
            places = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for file, begin, end, inside in spans(places):
                if file != name:
                    store, path = fs.FileSystem.from_uri(file)
                    name, source = file, store.open_input_file(path)
                source.seek(begin)
                raw = source.read(end - begin)
                rows = [parsed(raw[places[i][1] - begin : places[i][1] - begin + places[i][2]]) for i in inside]
                cols = list(zip(*rows, strict=True))
                if not payloads:
                    cols[5] = [None] * len(rows)
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    return run


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD of each row of ``index`` (its columns file, offset, length), from the archives."""
    places = index.select("file", "offset", "length")
    dealt = places.repartitionByRange(partitions(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return mapped(dealt, _reader(payloads), RECORD)


def pages(selected: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, payload) of the selected rows of ``index``; for revisits, from the response that they name."""
    wanted = selected.select("page_id", F.coalesce("refers_to", "page_id").alias("source"), "payload_digest")
    sources = index.where("record_type = 'response'").withColumnRenamed("page_id", "p").withColumnRenamed("payload_digest", "d")
    here = F.col("p").eqNullSafe(F.col("source")) & (F.col("d") == F.col("payload_digest"))
    found = read(sources.join(wanted.select("source", "payload_digest"), here, "left_semi")).dropDuplicates(["page_id", "payload_digest"])
    found = found.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), "payload")
    return wanted.join(found, here).select("page_id", "payload")
