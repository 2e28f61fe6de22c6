"""Language-model scores by deleted interpolation of a bigram model.

P(w | v) = L(b) c(v w) / c(v) + (1 - L(b)) P1(w),  P1(w) = M c(w) / N + (1 - M) / (V + 1),
with b the power-of-two bucket of the context's count c(v).  All counts are over every
training document.  The weights L and M are learned by expectation-maximisation on a part
of the training documents (DELETED of each MODULUS) whose counts are left out of the
estimates while learning; afterwards the counts of all training documents are used.

Counts are exchanged in blocks.  Documents are dealt into batches; a batch sends the sorted
distinct hashes of its words and word pairs, split by leading bits, with its counts; whoever
gathers a range of hashes adds them up and answers each batch in its own order.  So a pair
that is frequent costs one number per batch, and no table of counts has to fit anywhere.
Hashes keep all their 64 bits.  For learning, only histograms of ratios (bounded: a bin per 2 %) reach the driver.

A text's tokens are its lower-cased (A-Z) words and one end.  A null or empty text is the
end alone.  A row without id belongs to the training rows.  Repeated rows count each.  An
empty table gives an empty result.  Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import stored, text_of

MODULUS, HELD_OUT, DELETED = 7, 2, 5
#: UTF-8 bytes of a batch of documents, about.
BATCH_BYTES = 8 << 20
START, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5A1E38B93)
#: Histogram bins per unit of a natural logarithm.
FINE = 50
MIDDLE = 4000


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows with their ends, the token before each, and where each row begins."""
    h, first = W.hashed(column, lower=True)
    rows = len(first) - 1
    tokens = np.full(len(h) + rows, END, np.uint64)
    begins = first[:-1] + np.arange(rows)
    stay = np.ones(len(tokens), bool)
    stay[first[1:] + np.arange(rows)] = False
    tokens[stay] = h
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins] = START
    return tokens, before, begins


def keys(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return W.mix(tokens), W.mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def packed(sorted_keys: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane: the high planes are nearly all zero."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    d = np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


ANSWER = "batch bigint, part int, kind int, cls int, total binary, kept binary, bins array<bigint>, sums array<bigint>"


def asked(batches: DataFrame, part_bits: int) -> DataFrame:
    """What each batch wants counted: (part, kind, batch, cls, keys, counts)."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        batch, cls = key[0].as_py(), t.column("cls")[0].as_py()
        tokens, before, _ = stream(t.column("text"))
        out: list[tuple] = []
        for kind, k in enumerate(keys(tokens, before)):
            u, n = np.unique(k, return_counts=True)
            edges = np.append(np.searchsorted(u, np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits)), len(u))
            for p in np.flatnonzero(np.diff(edges)):
                s = slice(edges[p], edges[p + 1])
                out.append((int(p), kind, batch, cls, packed(u[s]), b"" if cls == 2 else n[s].astype(np.uint32).tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "kind", "batch", "cls", "keys", "counts"])

    return batches.groupBy("batch").applyInArrow(run, "part int, kind int, batch bigint, cls int, keys binary, counts binary")


def answered(asks: DataFrame) -> DataFrame:
    """Counts of all training rows (and of those kept while learning) for each batch's keys,
    and for words a histogram of deleted tokens by kept count, with totals in negative bins."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        part, kind = key[0].as_py(), key[1].as_py()
        cls = t.column("cls").to_numpy()
        parts = [unpacked(b) for b in t.column("keys").to_pylist()]
        sizes = [len(p) for p in parts]
        counts = np.concatenate([np.frombuffer(c, np.uint32).astype(np.float64) if k != 2 else np.zeros(n) for c, k, n in zip(t.column("counts").to_pylist(), cls, sizes, strict=True)])
        uniq, inv = np.unique(np.concatenate(parts), return_inverse=True)
        rest = np.repeat(cls == 0, sizes)
        total = np.bincount(inv, counts, len(uniq)).astype(np.int64)
        kept = np.bincount(inv, counts * rest, len(uniq)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        whole, held = total[inv].astype(np.uint32), kept[inv].astype(np.uint32)
        out = [(b, part, kind, int(k), whole[edges[i] : edges[i + 1]].tobytes(), held[edges[i] : edges[i + 1]].tobytes() if k == 1 else b"", None, None) for i, (b, k) in enumerate(zip(t.column("batch").to_pylist(), cls, strict=True))]
        if kind == 0:
            gone = total - kept
            bins = np.where(kept > 0, 1 + (np.log(np.maximum(kept, 1)) * FINE).astype(np.int64), 0)
            sums = np.bincount(bins, gone).astype(np.int64)
            at = np.flatnonzero(sums)
            out.append((-1, part, 9, 9, b"", b"", [*at.tolist(), -1, -2, -3, -4], [*sums[at].tolist(), int((total > 0).sum()), int(total.sum()), int((kept > 0).sum()), int(kept.sum())]))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["batch", "part", "kind", "cls", "total", "kept", "bins", "sums"])

    return asks.groupBy("part", "kind").applyInArrow(run, ANSWER)


def mixture(ratios: np.ndarray, counts: np.ndarray, rounds: int = 60) -> float:
    """Weight of the first of two estimates, by EM; ratios: first over second."""
    if not counts.sum():
        return 0.5
    x = 0.5
    for _ in range(rounds):
        x = float((counts * (x * ratios / (x * ratios + 1 - x))).sum() / counts.sum())
        x = min(max(x, 1e-6), 1 - 1e-6)
    return x


def replies(t: pa.Table, kind: int, column: str) -> np.ndarray:
    rows = sorted((p, b) for p, k, b in zip(t.column("part").to_pylist(), t.column("kind").to_pylist(), t.column(column).to_pylist(), strict=True) if k == kind)
    return np.concatenate([np.frombuffer(b, np.uint32) for _, b in rows]).astype(np.float64)


def token_counts(tokens: np.ndarray, before: np.ndarray, begins: np.ndarray, right: pa.Table, column: str, starts: float) -> tuple[np.ndarray, ...]:
    """For every token: c(word), c(word before), c(pair)."""
    uni, pair = keys(tokens, before)
    _, at = np.unique(uni, return_inverse=True)
    one = replies(right, 0, column)[at]
    _, at = np.unique(pair, return_inverse=True)
    two = replies(right, 1, column)[at]
    context = np.empty_like(one)
    context[1:] = one[:-1]
    context[begins] = starts
    return one, context, two


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(np.int64), 0)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    turn = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % MODULUS, F.lit(0))
    cls = F.when(turn == HELD_OUT, 2).when(turn == DELETED, 1).otherwise(0)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), cls.cast("int").alias("cls"))
    sizes = {r.cls: r for r in rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    per, many = {k: r.n for k, r in sizes.items()}, {k: max(1, -(-r.size // BATCH_BYTES)) for k, r in sizes.items()}
    part_bits = max(4, (sum(many.values()) - 1).bit_length())
    # each class has batches of its own, so that the deleted rows can be read alone
    of_cls = F.element_at(F.array(*(F.lit(many.get(k, 1)) for k in range(3))), F.col("cls") + 1)
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), of_cls) * 3 + F.col("cls"))
    answers = stored(answered(asked(rows, part_bits)), "lm-counts")
    sums = dict(answers.where("batch < 0").select(F.explode(F.arrays_zip("bins", "sums")).alias("x")).groupBy(F.col("x.bins").alias("bin")).agg(F.sum("x.sums").alias("s")).collect())
    v, big_n, v_kept, n_kept = (float(sums.get(-i, 0)) for i in (1, 2, 3, 4))
    bins = np.array(sorted(b for b in sums if b >= 0), np.int64)
    kept_count = np.where(bins > 0, np.exp((bins - 0.5) / FINE), 0.0)
    unigram = mixture(kept_count / max(n_kept, 1) * (v_kept + 1), np.array([sums[b] for b in bins], np.float64))
    docs_all, docs_kept = float(per.get(0, 0) + per.get(1, 0)), float(per.get(0, 0))

    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, before, begins = stream(left.column("text"))
        one, context, two = token_counts(tokens, before, begins, right, "kept", docs_kept)
        base = unigram * one / max(n_kept, 1) + (1 - unigram) / (v_kept + 1)
        b = bucket(context)
        with np.errstate(divide="ignore"):
            ratio = np.where(two > 0, MIDDLE + np.floor(np.log(np.maximum(two, 1) / np.maximum(context, 1) / base) * FINE), 0).astype(np.int64)
        key, count = np.unique(b * 100_000 + ratio, return_counts=True)
        return pa.table([pa.array(key // 100_000), pa.array(key % 100_000), pa.array(count)], names=["bucket", "bin", "n"])

    wanted = answers.where("batch >= 0").select("batch", "part", "kind", "cls", "total", "kept")
    hist = rows.where("cls = 1").groupBy("batch").cogroup(wanted.where("cls = 1").groupBy("batch")).applyInArrow(learn, "bucket bigint, bin bigint, n bigint")
    got = hist.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect()
    by_bucket = np.zeros(72)
    for k in {r.bucket for r in got}:
        x = [(r.bin, r.n) for r in got if r.bucket == k]
        at = np.array([b for b, _ in x], np.float64)
        by_bucket[k] = mixture(np.where(at > 0, np.exp((at - MIDDLE + 0.5) / FINE), 0.0), np.array([c for _, c in x], np.float64)) if k else 0.0
    seen = {r.bucket for r in got}
    for k in range(1, 72):  # a bucket that learning never saw takes its neighbour's weight
        if k not in seen:
            by_bucket[k] = by_bucket[k - 1]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, before, begins = stream(left.column("text"))
        one, context, two = token_counts(tokens, before, begins, right, "total", docs_all)
        floor = unigram * one / max(big_n, 1) + (1 - unigram) / (v + 1)
        share = by_bucket[bucket(context)]
        logs = np.log10(share * two / np.maximum(context, 1) + (1 - share) * floor)
        base = np.log10((one + 1) / (big_n + v + 1))
        sizes = np.diff(np.concatenate([begins, [len(tokens)]]))
        cols = [left.column("id"), pa.array(np.full(len(begins), left.column("cls")[0].as_py() == 2)), pa.array(sizes), pa.array(np.add.reduceat(one > 0, begins, dtype=np.int64)), pa.array(np.full(len(begins), int(big_n))), pa.array(np.add.reduceat(base, begins)), pa.array(np.add.reduceat(logs, begins))]
        return pa.table(cols, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = rows.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(score, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
