"""Substring dedup over a De Bruijn graph in minimizer space.

Token k-mers are edges of the graph; of each window of words only its smallest-hashed
k-mer (the leftmost of equals) is kept as an anchor.  Equal windows have equal anchors at
equal places, so nothing repeated is missed, and anchors are a small part of all k-mers.
Consecutive windows with one anchor form a span, one row.  Joins on anchors and spans then decide

* an anchor in one document only: nothing here is repeated;
* a span that begins in a smaller document: all its windows are repeated;
* the first occurrence of a span whose anchor has other spans too (a branching
  place): its windows are hashed one by one and looked up among the windows of all
  other such spans.

Each of these carries the coordinates of its origin (document, row, word).  Spans and windows that
follow one another both here and at their origin are compacted to one path.  Paths are
verified: the words at the origin's coordinates are read again and their SHA-256 is compared
with that of the words of the copy; a path whose words differ (equal hashes of other words)
removes nothing.  Verified windows are mapped to the words of their documents, where they
are cut and what is left is hashed.

A null text has no words; a text shorter than a window has no windows.  Rows with equal ids
are parts of one document and each keeps its own words; a null id is larger than
all others, and rows with it are not repeats of each other.  Copies of a window in one
document only are kept.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_BYTES, mapped, stored, text_of

WINDOW = 50
#: Words of a token k-mer.
K = 16


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` numbers the place of its smallest, the leftmost of equals.

    Runs of powers of two are combined, so the work grows with log(width)."""
    n = len(h) - width + 1
    at, size = np.arange(len(h)), 1
    while size * 2 <= width:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(h[b] < h[a], b, a)
        size *= 2
    a, b = at[:n], at[width - size : width - size + n]
    return np.where(h[b] < h[a], b, a)


def prefix_sums(h: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of mixed hashes times powers, for hashes of any run of words."""
    n = len(h)
    up, down = W._powers(n + 1)
    out = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(W.mix(h + np.uint64(salt)) * up[:n], dtype=np.uint64, out=out[1:])
    return out, down


def run_hash(sums: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    s, down = sums
    with np.errstate(over="ignore"):
        return W.mix((s[hi] - s[lo]) * down[lo] + (hi - lo).astype(np.uint64)).view(np.int64)


def spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(row, id, anchor, span, lo, n): windows lo .. lo + n - 1 of a row share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                h, first = W.hashed(part.column(2))
                cols: list[list[np.ndarray]] = [[] for _ in range(5)]
                for i in range(part.num_rows):
                    own = h[first[i] : first[i + 1]]
                    if len(own) < window:
                        continue
                    mers = W.rolling(own, k)
                    where = smallest(mers, window - k + 1)
                    lo = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                    n = np.diff(np.concatenate([lo, [len(where)]]))
                    span = run_hash(prefix_sums(own, 1), lo, lo + n + window - 1)
                    for c, v in zip(cols, (np.full(len(lo), i), mers[where[lo]].view(np.int64), span, lo, n), strict=True):
                        c.append(v)
                if cols[0]:
                    i, anchor, span, lo, n = map(np.concatenate, cols)
                    pick = pa.array(i)
                    yield pa.record_batch([part.column(0).take(pick), part.column(1).take(pick), pa.array(anchor), pa.array(span), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["row", "id", "anchor", "span", "lo", "n"])

    return mapped(docs, run, "row bigint, id bigint, anchor bigint, span bigint, lo int, n int")


def window_hashes(rows: DataFrame, window: int) -> DataFrame:
    """(row, id, text, spans: array of (anchor, lo, n)) -> (anchor, hash, row, id, lo) per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                h, first = W.hashed(part.column(2))
                lists = part.column(3)
                flat, offs = lists.flatten(), lists.offsets.to_numpy()
                offs = offs - offs[0]
                anchor, lo, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                cols: list[list[np.ndarray]] = [[] for _ in range(4)]
                for i in range(part.num_rows):
                    own, m = h[first[i] : first[i + 1]], slice(offs[i], offs[i + 1])
                    sizes = n[m].astype(np.int64)
                    at_word = np.repeat(lo[m] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                    of = run_hash(prefix_sums(own, 3), at_word, at_word + window)
                    for c, v in zip(cols, (np.full(len(at_word), i), np.repeat(anchor[m], sizes), of, at_word), strict=True):
                        c.append(v)
                i, anchors, of, los = map(np.concatenate, cols)
                pick = pa.array(i)
                yield pa.record_batch([pa.array(anchors), pa.array(of), part.column(0).take(pick), part.column(1).take(pick), pa.array(los.astype(np.int32))], names=["anchor", "hash", "row", "id", "lo"])

    return mapped(rows, run, "anchor bigint, hash bigint, row bigint, id bigint, lo int")


def paths(pieces: DataFrame) -> DataFrame:
    """(id, row, lo, n, origin): pieces that go on where the one before ends, here and at their origin, become one."""
    shifted = pieces.withColumn("shift", F.col("lo") - F.col("origin.lo"))
    along = Window.partitionBy("id", "row", "origin.id", "origin.row", "shift").orderBy("lo")
    opens = F.coalesce((F.lag(F.col("lo") + F.col("n")).over(along) < F.col("lo")).cast("int"), F.lit(0))
    # a run of windows of one document at a time
    numbered = shifted.withColumn("opens", opens).withColumn("path", F.sum("opens").over(along))
    path = numbered.groupBy("id", "row", F.col("origin.id").alias("o_id"), F.col("origin.row").alias("o_row"), "shift", "path").agg(F.min("lo").alias("lo"), F.max(F.col("lo") + F.col("n")).alias("end"))
    return path.select("id", "row", "lo", (F.col("end") - F.col("lo")).alias("n"), "o_id", "o_row", (F.col("lo") - F.col("shift")).alias("o_lo"))


def words_hash(data: bytes, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> bytes:
    """SHA-256 of the words lo .. hi - 1 of a text, joined by one blank."""
    return hashlib.sha256(b" ".join(data[starts[lo] : ends[hi - 1]].split())).digest()


def proofs(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(o_id, o_row, o_lo, n, sha): hashes of the words at the coordinates that ``wanted`` names."""
    asked = stored(wanted.select("o_id", "o_row", "o_lo", "n").distinct(), "substr-origins-asked")
    asked = stored(asked.groupBy(F.col("o_id").alias("id"), F.col("o_row").alias("row")).agg(F.collect_list(F.struct(F.col("o_lo").alias("lo"), "n")).alias("spans")), "substr-asked")
    ids = stored(asked.select("id").distinct(), "substr-asked-ids")
    few = docs.join(F.broadcast(ids) if ids.count() * 32 <= BROADCAST_BYTES else ids, "id", "left_semi")
    few = few.join(asked, ["id", "row"]).select("id", "row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            raw, offs = W.utf8(part.column(2))
            starts, ends, first = W.bounds(raw, offs)
            data, lists = raw.tobytes(), part.column(3)
            rows = [(i, x["lo"], x["n"], words_hash(data, starts, ends, first[i] + x["lo"], first[i] + x["lo"] + x["n"] + window - 1)) for i, spans in enumerate(lists.to_pylist()) for x in spans]
            i, lo, n, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            pick = pa.array(i, pa.int64())
            yield pa.record_batch([part.column(0).take(pick), part.column(1).take(pick), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(sha, pa.binary())], names=["o_id", "o_row", "o_lo", "n", "sha"])

    # rows with equal id and text give equal hashes
    return stored(mapped(few, run, "o_id bigint, o_row bigint, o_lo int, n int, sha binary").distinct(), "substr-proofs")


def repeated(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs: (row, id, text) -> (id, row, cuts: array of (lo, n, sha)): n windows from word lo on
    begin in a document of a smaller id, if their words have the hash ``sha``."""
    parts = stored(spans(docs, window, k), "substr-spans")
    # Aggregates are written before they are joined: a join of two plain exchanges, with nothing
    # on top that needs its keys together, is one that Spark can split at a hot anchor or span.
    shared = parts.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("span").alias("p"), F.max("span").alias("q")).where("a < b")
    shared = stored(shared.select("anchor", (F.col("p") < F.col("q")).alias("branches")), "substr-anchors")
    of = stored(parts.join(shared, "anchor"), "substr-repeated")
    place = F.struct("id", "row", "lo")
    first = stored(of.groupBy("anchor", "span").agg(F.min(place).alias("origin")), "substr-origins")
    known = stored(of.join(first, ["anchor", "span"]).select("row", "id", "anchor", "lo", "n", "branches", "origin"), "substr-shared")
    whole = known.where("origin.id < id").select("id", "row", "lo", "n", "origin")
    open_ = known.where("origin.id = id AND branches").groupBy("id", "row").agg(F.collect_list(F.struct("anchor", "lo", "n")).alias("spans"))
    each = window_hashes(docs.join(open_, ["id", "row"]).select("row", "id", "text", "spans"), window)
    each = stored(each, "substr-windows")
    least = stored(each.groupBy("anchor", "hash").agg(F.min(place).alias("origin"), F.max("id").alias("top")).where("origin.id < top").drop("top"), "substr-least")
    single = each.join(least, ["anchor", "hash"]).where("origin.id < id").select("id", "row", "lo", F.lit(1).alias("n"), "origin")
    found = stored(paths(whole.unionByName(single)), "substr-paths")
    proven = found.join(proofs(docs, found, window), ["o_id", "o_row", "o_lo", "n"])
    return proven.groupBy("id", "row").agg(F.collect_set(F.struct("lo", "n", "sha")).alias("cuts"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """id, n_words, n_removed, kept_text of each row."""
    top = F.lit((1 << 63) - 1)
    own = F.col(id_col).cast("bigint")
    # a row is known by id and text, which any second reading finds again
    rows = docs.select(F.xxhash64(text_of(text_col)).alias("row"), F.coalesce(own, top).alias("id"), text_of(text_col).alias("text"), own.alias("own"))
    cuts = repeated(rows.drop("own"), window, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw, offs = W.utf8(part.column(1))
                starts, ends, first = W.bounds(raw, offs)
                data, total, gone, kept = raw.tobytes(), [], [], []
                for i, cuts_of in enumerate(part.column(2).to_pylist()):
                    a, b = int(first[i]), int(first[i + 1])
                    depth = np.zeros(b - a + 1, np.int64)
                    for x in cuts_of or []:
                        hi = x["lo"] + x["n"] + window - 1
                        if words_hash(data, starts, ends, a + x["lo"], a + hi) == x["sha"]:
                            depth[x["lo"]] += 1
                            depth[hi] -= 1
                    stay = np.flatnonzero(np.cumsum(depth[:-1]) == 0) + a
                    total.append(b - a)
                    gone.append(b - a - len(stay))
                    if not gone[-1]:
                        kept.append(b" ".join(data[offs[i] : offs[i + 1]].split()).decode())
                    else:
                        kept.append(b" ".join([data[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]).decode())
                yield pa.record_batch([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    joined = rows.join(cuts, ["id", "row"], "left").select("own", "text", "cuts")
    out = mapped(joined, run, "id bigint, n_words bigint, n_removed bigint, kept_text string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    return cleaned(docs, id_col, text_col, window, k).select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
