"""Alignment of the tokens of two tokenizers over a corpus, by a dictionary of groups.

Where a token of A and a token of B end at the same byte, a text is cut; what lies between two
cuts is a group, and its ids alone tell how its tokens overlap.  So the corpus is a dictionary of distinct
groups and, for each document, how often it has each of them:

1. Texts are encoded once, in blocks of BLOCK_BYTES.  A block is stored as its list of distinct groups and, for each
   document, places in that list with counts.
2. Distinct groups are interned across blocks; each is expanded into its links once.
3. Documents that hold a pair of ids linked: a pair of one group only takes that group's number of
   documents.  A pair of several groups takes the number of distinct documents of them all, counted in its blocks,
   as a document lies in one block.
4. The values of a group (links, links whose count is the highest of their A id, sum of counts) go back to the blocks by the
   group's key, and the documents add them up by their counts.

No row is made for an occurrence of a link or for a pair of a document and a group: rows are blocks, distinct groups of a
block, distinct groups, and distinct pairs.  The joins are on the group's exact key and on blocks; a group that is in every block is a row a block.

Nulls: a null or empty text has no tokens.  Repeated rows are documents of their own.  A null id stays.  An
empty table gives no rows.  Further columns are not read.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import mapped, stored

#: Bytes of text of a block, at most (a longer text is a block of its own), and documents.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
#: Formatted groups that a worker remembers.
REMEMBERED = 400_000
#: B's sign for a space (fixed value).
SPACE_SIGN = "▁"


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.ranks = vocab.byte_encoding(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        spelled = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(size))]
        self.b_bytes = spelled
        self.a_size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for t, i in self.ranks.items():
            self.a_size[i] = len(t)
        self.b_size = np.array([len(x) for x in spelled], np.int64)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and B; none where the bytes of either are not those of a space and the text."""
        if not text:
            return [], []
        whole = " " + text
        raw = whole.encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], []
        a = self.a.encode_ordinary(whole)
        return (a, b) if self.a.decode_bytes(a) == raw else ([], [])

    def cuts(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of A and of B lie before each place where both end."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        marks = np.zeros((2, max(ends_a[-1], ends_b[-1]) + 1), bool)
        marks[0, ends_a] = marks[1, ends_b] = True
        return np.flatnonzero(marks[1, ends_a]) + 1, np.flatnonzero(marks[0, ends_b]) + 1

    def links(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Pairs of ids whose bytes overlap, for each pair of tokens of one group."""
        ends_a, ends_b = np.cumsum(self.a_size[a]).tolist(), np.cumsum(self.b_size[b]).tolist()
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            out.append((a[i], b[j]))
            ea, eb = ends_a[i], ends_b[j]
            i, j = i + (ea <= eb), j + (eb <= ea)
        return out


@functools.cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def key_ids(key: str) -> tuple[list[int], list[int]]:
    a, b = key.split("|")
    return list(map(int, a.split(","))), list(map(int, b.split(",")))


class Groups:
    """Keys of the groups of texts: ``a1,a2|b1``.  Most groups have one token on each side."""

    def __init__(self, tokens: Pair):
        self.tokens, self.one = tokens, {}
        self.names = list(map(str, range(max(len(tokens.a_size), len(tokens.b_size)))))

    def keys(self, text: str | None) -> tuple[int, int, list[str]]:
        a, b = self.tokens.tokens(text)
        if not a:
            return 0, 0, []
        upto_a, upto_b = self.tokens.cuts(a, b)
        from_a, from_b = np.concatenate([[0], upto_a[:-1]]), np.concatenate([[0], upto_b[:-1]])
        single = (upto_a - from_a == 1) & (upto_b - from_b == 1)
        ids_a, ids_b = np.array(a), np.array(b)
        codes = np.where(single, ids_a[from_a] << 32 | ids_b[from_b], -1 - np.arange(len(upto_a))).tolist()
        one, out = self.one, list(map(self.one.get, codes))
        name_a, name_b = list(map(self.names.__getitem__, a)), list(map(self.names.__getitem__, b))
        lo_a, hi_a, lo_b, hi_b = (x.tolist() for x in (from_a, upto_a, from_b, upto_b))
        for g in [g for g, key in enumerate(out) if key is None]:
            out[g] = key = f"{','.join(name_a[lo_a[g] : hi_a[g]])}|{','.join(name_b[lo_b[g] : hi_b[g]])}"
            if codes[g] >= 0:
                one[codes[g]] = key
        return len(a), len(b), out

    def trim(self) -> None:
        if len(self.one) > REMEMBERED:
            self.one.clear()


BLOCK = "block bigint, keys array<string>, distinct array<int>, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, shas array<string>, docs binary, at binary, times binary"


def packed(values) -> bytes:
    """Numbers below 2**32, their bytes of equal weight together, compressed."""
    return zlib.compress(np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def numbered() -> dict[str, int]:
    """A dictionary that numbers its keys as they are first asked for."""
    out: collections.defaultdict[str, int] = collections.defaultdict()
    out.default_factory = out.__len__
    return out


def _encoder(a_path: str, b_path: str):
    """Texts -> blocks: the distinct groups, and per document how many of ``at`` (places) and ``times`` are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(pair(a_path, b_path))
        place = numbered()
        docs: list[tuple] = []
        ats, times, size = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal place, docs, ats, times, size
            at, n = np.concatenate(ats), np.concatenate(times)
            has = np.bincount(at, minlength=len(place)).tolist()
            ids, n_a, n_b, shas = ([d[i] for d in docs] for i in range(1, 5))
            lists = [list(place), has, ids, n_a, n_b, shas]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array([docs[0][0]]), *(pa.array([v], pa.list_(k)) for v, k in zip(lists, kinds, strict=True)), *(pa.array([packed(v)]) for v in ([len(x) for x in ats], at, n))]
            place, docs, ats, times, size = numbered(), [], [], [], 0
            groups.trim()
            return pa.record_batch(arrays, names=[x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            for row, number, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n_a, n_b, keys = groups.keys(text)
                sha = hashlib.sha256(";".join(keys).encode()).hexdigest() if keys else ""
                mine = np.fromiter(map(place.__getitem__, keys), np.int32, len(keys))
                at, n = np.unique(mine, return_counts=True)
                docs.append((row, number, n_a, n_b, sha))
                ats.append(at.astype(np.int32))
                times.append(n.astype(np.int32))
                size += len(text or "") + 64
                if size >= BLOCK_BYTES or len(docs) >= BLOCK_DOCS:
                    yield block()
        if docs:
            yield block()

    return run


LINK = "key string, n_docs bigint, a int, b int, times bigint"


def _linked(a_path: str, b_path: str):
    """Distinct groups -> their links, a row for each different pair of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair(a_path, b_path)
        for b in batches:
            rows = []
            for key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found: dict[tuple[int, int], int] = {}
                for x in tokens.links(*key_ids(key)):
                    found[x] = found.get(x, 0) + 1
                rows += [(key, n, *x, times) for x, times in found.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], strict=True)], names=[x.split()[0] for x in LINK.split(", ")])

    return run


def _documents_of_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block, and (place, a, b) of pairs that several groups share -> documents of the block that hold each pair."""
    names, empty = ["a", "b", "n"], [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.int64())]
    if not left.num_rows or not right.num_rows:
        return pa.table(empty, names=names)
    sizes, at = unpacked(left.column("docs")[0].as_py()), unpacked(left.column("at")[0].as_py())
    doc = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(at, kind="stable")]
    n_at = np.bincount(at)
    first = np.concatenate([[0], np.cumsum(n_at)])
    place = right.column("place").to_numpy()
    codes, which = np.unique(right.column("a").to_numpy().astype(np.int64) << 32 | right.column("b").to_numpy(), return_inverse=True)
    many = n_at[place]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    held = np.unique(np.repeat(which, many) * len(sizes) + doc[np.repeat(first[place], many) + inside])
    n = np.bincount(held // len(sizes), minlength=len(codes))
    return pa.table([pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], names=names)


RESULT = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block, and the values of its groups by place -> RESULT of its documents."""
    fields = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    if not left.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=fields)
    sizes, at, times = (unpacked(left.column(c)[0].as_py()) for c in ("docs", "at", "times"))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = right.column("place").to_numpy()
    sums = [np.bincount(doc, times, len(sizes)).astype(np.int64)]
    for c in ("n_links", "n_best", "count_sum"):
        of_place = np.zeros(len(place), np.int64)
        of_place[place] = right.column(c).to_numpy()
        total = np.zeros(len(sizes), np.int64)
        np.add.at(total, doc, of_place[at] * times)
        sums.append(total)
    ids, n_a, n_b, shas = (left.column(c)[0].as_py() for c in ("ids", "n_a", "n_b", "shas"))
    return pa.table([pa.array(list(v), k) for v, k in zip([ids, n_a, n_b, *sums, shas], kinds, strict=True)], names=fields)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """RESULT of each row of ``docs``."""
    a_path, b_path = a_path or vocab.place("byte_bpe_50k.json"), b_path or vocab.place("piece_bpe_32k.model")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(mapped(rows, _encoder(a_path, b_path), BLOCK), "align-blocks")
    # the dictionary of groups
    entry = F.posexplode(F.arrays_zip("keys", "distinct")).alias("place", "x")
    keyed = blocks.select("block", entry).select("block", "place", F.col("x.keys").alias("key"), F.col("x.distinct").alias("n"))
    groups = keyed.groupBy("key").agg(F.sum("n").cast("bigint").alias("n_docs"))
    links = stored(mapped(groups, _linked(a_path, b_path), LINK), "align-links")
    # documents of each pair
    pairs = stored(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_docs").alias("n")), "align-pairs")
    several = links.join(pairs.where("n_groups > 1").select("a", "b"), ["a", "b"]).select("key", "a", "b")
    asked = keyed.select("block", "place", "key").join(several, "key").select(F.col("block").alias("of"), "place", "a", "b")
    shared = blocks.select("block", "docs", "at").groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(_documents_of_pairs, "a int, b int, n bigint")
    counts = pairs.where("n_groups = 1").select("a", "b", "n").unionByName(shared.groupBy("a", "b").agg(F.sum("n").alias("n")))
    counts = stored(counts, "align-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    ranked = counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("best")).alias("is_best"))
    # values of each group, and back to the documents
    value = links.join(ranked, ["a", "b"]).groupBy("key").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    values = stored(value, "align-values")
    back = keyed.select("block", "place", "key").join(values, "key").select(F.col("block").alias("of"), "place", "n_links", "n_best", "count_sum")
    out = blocks.drop("keys", "distinct").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_summed, RESULT)
    return out.withColumnRenamed("id", id_col)
