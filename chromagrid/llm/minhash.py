"""MinHash near-dedup by one-permutation hashing.

One hash of each word shingle falls into one of BINS bins, the smallest of a bin is its
value; an empty bin takes the value of a filled bin found by its own fixed random
sequence (optimal densification).  Four bins make a band, classes (documents with equal
sets) that share a band lie in one bucket.  Candidates come in three rounds, each confirmed
on the full shingle sets before the next:

1. a star with one edge a class: to the smallest id in any of its buckets;
2. stars of the buckets that still hold two components: from every member outside of the
   component of the bucket's smallest id to that id;
3. what is open then is compared within its bucket, block against block, inside of a task:
   only pairs of different components, and only in the first bucket that both share.  A
   task puts out no pair but those links that join two of its components.

So a bucket of m classes makes at most 2 m edges and m rows for each of its m / BLOCK blocks, and no
pair that shares a band is lost: rounds end with every such pair compared, or in one component.
Connected components follow by spreading smallest ids and following pointers.

A null or empty text, or one without words, has no shingles, is linked with nothing and
stays.  A text with fewer words than a shingle is one shingle.  Rows with a null id stay
alone, with a null component.  Rows with equal ids are one document for links.  Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_BYTES, free_name, mapped, stored, text_of

BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Members and shingles of a block, about, when the members of a bucket are compared.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Members of a block of a star, about.
STAR = 128
_SEQ = np.random.default_rng(71).integers(0, BINS, (BINS, 96))
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(h):
        return h
    return np.unique(W.rolling(h, size) if len(h) >= size else W.rolling(h, len(h), salt=len(h)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The value of each bin after densification."""
    v = np.sort(W.mix(shingles + np.uint64(0x51ED2701)))
    at = np.searchsorted(v, _EDGES)
    full = np.diff(np.concatenate([at, [len(v)]])) > 0
    out = v[np.minimum(at, len(v) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[_SEQ[empty]]
        pick = _SEQ[empty, hit.argmax(axis=1)]
        lost = ~hit.any(axis=1)  # a long sequence of empty bins: the next full one
        if lost.any():
            filled = np.flatnonzero(full)
            pick[lost] = filled[np.searchsorted(filled, empty[lost]) % len(filled)]
        out[empty] = out[pick]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)
        for c in range(ROWS):
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + values.reshape(BANDS, ROWS)[:, c])
    return key.view(np.int64)


def sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    h, first = W.hashed(column, lower=True)
    for i in range(len(first) - 1):
        yield shingle_set(h[first[i] : first[i + 1]], size)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, k1, k2, bands): set size, 128-bit set hash, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            n, k1, k2, bands = [], [], [], []
            for s in sets(part.column(1), size):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    k1.append(int(W.mix(s + np.uint64(5)).sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(W.mix(s + np.uint64(9)).sum(dtype=np.uint64).astype(np.int64)))
                bands.append(band_keys(sketch(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "bands"])

    return mapped(docs, run, "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def small(df: DataFrame, row_bytes: int = 48) -> DataFrame:
    """A stored table, hinted for a broadcast only if its counted rows prove it small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def buckets(reps: DataFrame) -> DataFrame:
    """(key, band, id, n, low, low_n): members of the buckets of two classes or more; low: the smallest id."""
    rows = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    many = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.max("id").alias("high")).where("low.id < high")
    many = stored(many.select("key", F.col("low.id").alias("low"), F.col("low.n").alias("low_n")), "near-keys")
    return rows.join(small(many), "key").select("key", "band", "id", "n", "low", "low_n")


def fits(a: str, b: str, share: float) -> Column:
    """Sets of these sizes can reach ``share``."""
    return F.least(a, b) >= F.lit(share) * F.greatest(a, b)


def with_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of buckets that hold two components or more, with ``comp``."""
    named = rows.join(small(roots).select(F.col("node").alias("id"), "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    open_ = stored(named.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("key"), "near-open-keys")
    return named.join(small(open_), "key")


def star_groups(edges: DataFrame) -> DataFrame:
    """(center, id, n) -> rows (g, i, j, own, band, comp, id): a center and a block of its members are a group."""
    sizes = edges.groupBy("center").agg(blocks_of(STAR).alias("k"))
    dealt = edges.join(sizes, "center").select("center", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("j"), "id")
    dealt = stored(dealt, "near-stars")
    sides = dealt.select("center", "j", F.col("j").alias("own"), "id").unionByName(dealt.select("center", "j").distinct().select("center", "j", F.lit(-1).alias("own"), F.col("center").alias("id")))
    return sides.select(F.col("center").alias("g"), F.lit(-1).alias("i"), "j", "own", F.lit(0).alias("band"), F.col("id").alias("comp"), "id")


def blocks_of(members: int) -> Column:
    """Number of blocks of a group, by members and by shingles."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / members, F.sum("n") / BLOCK_SHINGLES)).cast("int")


def block_groups(rest: DataFrame) -> DataFrame:
    """(key, band, id, n, comp) -> rows (g, i, j, own, band, comp, id): each pair of blocks of a bucket is a group."""
    sizes = stored(rest.groupBy("key").agg(blocks_of(BLOCK).alias("k")), "near-blocks")
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    dealt = rest.join(small(sizes), "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.select(F.col("key").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "comp", "id")


def joined(own: np.ndarray, ids: np.ndarray, comp: np.ndarray, bands: list[np.ndarray | None], band: int, held: list[np.ndarray], first: int, other: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links of one group between its blocks ``first`` and ``other`` that join two components."""
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == other)
    n = np.array([len(s) for s in held])
    keys = np.stack([b[:band] for b in bands]) if band else None
    edge, codes = np.concatenate([[0], np.cumsum(n)]), None
    out: list[tuple[int, int]] = []
    for x in left:
        to = right[right > x] if first == other else right
        to = to[(comp[to] != comp[x]) & (ids[to] != ids[x]) & (den * np.minimum(n[to], n[x]) >= num * np.maximum(n[to], n[x]))]
        if keys is not None and len(to):
            to = to[~(keys[to] == keys[x]).any(axis=1)]  # compared in an earlier bucket
        if not len(to):
            continue
        if len(to) <= 8:
            common = np.array([len(np.intersect1d(held[x], held[t], assume_unique=True)) for t in to])
        else:
            if codes is None:
                codes = np.unique(np.concatenate(held), return_inverse=True)[1]
            mark = np.zeros(int(codes.max()) + 1, np.int64)
            mark[codes[edge[x] : edge[x + 1]]] = 1
            common = np.add.reduceat(mark[codes], edge[:-1])[to]
        for t in to[den * common >= num * (n[x] + n[to] - common)]:
            if comp[t] != comp[x]:
                out.append((int(min(ids[x], ids[t])), int(max(ids[x], ids[t]))))
                comp[comp == comp[t]] = comp[x]
    return out


def compared(groups: DataFrame, reps: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(a, b), a < b: links within groups, den * intersection >= num * union on full shingle sets.

    Links are left out only where others join the same two documents."""
    groups = stored(groups, "near-groups")
    ids = stored(groups.select("id").distinct(), "near-ids")
    some = small(ids)
    prints = reps.join(some, "id", "left_semi").groupBy("id").agg(F.first("bands").alias("bands"))
    rows = groups.where("band > 0").join(prints, "id").unionByName(groups.where("band = 0").withColumn("bands", F.lit(None).cast("array<bigint>")))
    rows = rows.join(texts.join(some, "id", "left_semi"), "id").select("g", "i", "j", "own", "band", "comp", "id", "bands", "text")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "own", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def settled() -> list[tuple[int, int]]:
            if not group:
                return []
            own, ids, comp, band, bands, held = zip(*group, strict=True)
            return joined(np.array(own), np.array(ids), np.array(comp), list(bands), band[0], list(held), key[1], key[2], num, den)

        def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for part in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            links: list[tuple[int, int]] = []
            g, i, j, own, band, comp, ids = (part.column(c).to_pylist() for c in range(7))
            for r, s in enumerate(sets(part.column(8), size)):
                if (g[r], i[r], j[r]) != key:
                    links += settled()
                    key, group = (g[r], i[r], j[r]), []
                of = part.column(7)[r]
                group.append((own[r], ids[r], comp[r], band[r], of.values.to_numpy() if band[r] else None, s))
            yield table(links)
        yield table(settled())

    return mapped(rows, run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node with a link.

    A round takes the smallest label of the neighbours, then the label's label; the
    number of rounds grows with the logarithm of the longest path."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        best = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(best, labels["node"] == best["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = stored(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "near-labels")
        labels = step.select("node", "root")
        if not step.where("old <> root").limit(1).count():
            return labels


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of ``docs``.  Links: den * intersection >= num * union."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    prints = stored(sketches(texts, size), "near-sketches")
    keys = ["k1", "k2", "n"]
    classes = stored(prints.where("n > 0 AND id IS NOT NULL").groupBy(*keys).agg(F.min("id").alias("class")), "near-classes")
    heads = classes.select(F.col("class").alias("id")).distinct()
    reps = stored(prints.where("n > 0").join(heads, "id").select("id", "n", "bands"), "near-reps")
    known, share = texts.where("id IS NOT NULL"), num / den
    shared = stored(buckets(reps), "near-buckets")
    outer = shared.where("id <> low").where(fits("n", "low_n", share))
    first = stored(outer.groupBy("id").agg(F.min("low").alias("center"), F.min("n").alias("n")), "near-first")
    links = stored(compared(star_groups(first), reps, known, size, num, den), "near-links")
    roots = components(links)
    open_ = stored(with_components(shared, roots), "near-open")
    if open_.limit(1).count():
        low = roots.select(F.col("node").alias("low"), F.col("root").alias("low_root"))
        second = open_.where("id <> low").where(fits("n", "low_n", share)).join(small(low), "low", "left").where("comp <> coalesce(low_root, low)")
        second = second.groupBy("id", F.col("low").alias("center")).agg(F.min("n").alias("n")).join(first.select("id", "center"), ["id", "center"], "left_anti")
        links = stored(links.unionByName(compared(star_groups(second), reps, known, size, num, den)), "near-links")
        roots = components(links)
        rest = stored(with_components(shared.where("id <> low"), roots), "near-rest")
        if rest.limit(1).count():
            links = links.unionByName(compared(block_groups(rest), reps, known, size, num, den))
            roots = components(links)
    named = classes.join(roots, classes["class"] == roots["node"], "left").select(*keys, F.coalesce("root", "class").alias("component"))
    thin = prints.select("id", *keys)
    out = thin.where("n > 0 AND id IS NOT NULL").join(named, keys).select("id", "n", "component")
    alone = thin.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the documents whose group keeps another one; all columns pass through."""
    gone_id = free_name(docs, "near_gone")
    gone = stored(grouped(docs, id_col, text_col, size, num, den).where("NOT kept").select(F.col(id_col).alias(gone_id)).distinct(), "near-gone")
    bound = gone.count() * 16
    return docs.join(F.broadcast(gone) if bound <= BROADCAST_BYTES else gone, docs[id_col] == gone[gone_id], "left_anti")
