"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 4 and 5 bytes (words are
lower-cased for A-Z and end at blanks and ASCII punctuation).  Filters of several widths
slide over the words, each filter's largest response over the whole text enters a logistic
output.

Training takes every labelled row, whole texts, long ones in slices, and the driver holds the model only.  Up to PART rows
and PART_BYTES they meet in one task.  More are dealt into parts of that size on average: words are counted over all rows,
each part goes on from the start that follows from these counts, and the models are averaged, a word's vector over the parts
that have moved it.  Thresholds are calibrated by language on
held-out rows, a fifth of all.  The language is told from the text itself by its most common
short words, learned from the labelled rows, never read from a column, so that label, language,
source and id are no inputs of a score.  A score is the output moved along the logit axis so
that the language's threshold comes to lie at ``cut``.

Where the rows to learn from hold one label only, no text comes to ``cut``; where only the held-out
ones do, a text must score higher than the clean ones of them.  A null or empty text has no words and scores as the output's bias does.  Rows without a
label only get a score.  Repeated rows score alike; further columns are carried along.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import BROADCAST_BYTES, mapped, stored, text_of

BUCKETS = 1 << 17
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Rows and bytes of text of a part of the training, on average.
PART, PART_BYTES = 4500, 48 << 20
#: Buckets of a block in which parts hand over what they have learned; units of its sums, whole numbers so that no order matters.
BLOCK, UNIT = 256, float(1 << 32)
#: Steps of an output in which held-out rows of many parts are counted.
STEPS = 128
#: Words that training looks at at a time.
SLICE = 4096
PREFIXES = (4, 5)
CUT = 0.7
#: A threshold that no output comes to.
NEVER = 1e6
#: Buckets of short words that tell languages apart.
LANG_BUCKETS = 1 << 12


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word: buckets of word and prefixes, the language bucket; first word of each row."""
    raw, at = W.utf8(column)
    raw = W.LOWER[raw]
    starts, ends, first = W.bounds(raw, at, W.NOT_ALNUM)
    if not len(starts):
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(0, np.int32), first
    *pre, full = W.hashes(raw, starts, *[np.minimum(ends, starts + p) for p in PREFIXES], ends)
    b = np.stack([full % BUCKETS, *[W.mix(h + np.uint64(i + 1)) % BUCKETS for i, h in enumerate(pre)]], axis=1).astype(np.int32)
    short = (full >> np.uint64(20)) % np.uint64(LANG_BUCKETS)
    return b, np.where(ends - starts <= 4, short.astype(np.int32), -1), first


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    by_language: np.ndarray | None = None
    shifts: np.ndarray | None = None

    def pooled(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest response of every filter (0 at least) over the words of each text."""
        n, texts = len(b), len(first) - 1
        out = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        full = np.flatnonzero(first[1:] > first[:-1])
        if not n:
            return out
        flat = np.concatenate([k[j] for k in self.kernels for j in range(len(k))], axis=1)
        every = np.empty((n, flat.shape[1]), np.float32)
        for lo in range(0, n, 4096):
            part = b[lo : lo + 4096]
            e = self.table[part[:, 0]]
            for c in range(1, part.shape[1]):
                e += self.table[part[:, c]]
            np.matmul(e, flat, out=every[lo : lo + 4096])
        at = 0
        for q, width in enumerate(WIDTHS):
            r = every[:, at : at + FILTERS].copy()
            for j in range(1, width):
                r[: n - j] += every[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            r += self.biases[q]
            for j in range(1, width):  # windows that would reach beyond their text
                ends = first[1:][full] - j
                r[ends[ends >= first[:-1][full]]] = 0
            out[full, q * FILTERS : (q + 1) * FILTERS] = np.maximum(np.maximum.reduceat(r, first[:-1][full], axis=0), 0)
            at += width * FILTERS
        return out

    def strongest(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width: place and value of every filter's largest response over one text, in slices."""
        out = []
        for k, bias in zip(self.kernels, self.biases, strict=True):
            w, place, value = len(k), np.zeros(FILTERS, np.int64), np.full(FILTERS, -np.inf, np.float32)
            for lo in range(0, len(x) - w + 1, SLICE):
                e = self.table[x[lo : lo + SLICE + w - 1]].sum(axis=1)
                r = sum(e[j : len(e) - w + 1 + j] @ k[j] for j in range(w)) + bias
                a = r.argmax(axis=0)
                v = r[a, np.arange(FILTERS)]
                place, value = np.where(v > value, a + lo, place), np.maximum(v, value)
            out.append((place, value))
        return out

    def languages_of(self, short: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of each text by its short words."""
        logs = np.concatenate([self.by_language.T, np.zeros((1, len(self.languages)))])
        sums = np.zeros((len(first) - 1, len(self.languages)))
        full = np.flatnonzero(first[1:] > first[:-1])
        if len(full):
            sums[full] = np.add.reduceat(logs[short], first[:-1][full], axis=0)
        return sums.argmax(axis=1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.bias

    def dense(self) -> list[np.ndarray]:
        """All parameters but table and bias."""
        return [self.out, *self.kernels, *self.biases]

    def scores(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        z = logits - self.shifts[language] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def started(rng: np.random.Generator, seen: np.ndarray, totals: np.ndarray) -> Model:
    """A model before training.  seen: for each label (0, 1) the training rows that have a bucket; totals: those rows."""
    m = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    # how much oftener a bucket is in toxic texts
    share = max(1.0, totals[1]), max(1.0, totals[0])
    prior = 6 * np.array([share[1], share[0]]) / sum(share)
    odds = np.log((seen[1] + prior[1]) / share[0]) - np.log((seen[0] + prior[0]) / share[1])
    m.table[:, 0] = np.where(seen[1] >= 3, np.clip(odds, 0, 3) / 3, 0)
    for k in m.kernels:
        k[:, 0, :] = np.abs(k[:, 0, :]) + 0.3
    m.out[:] = np.abs(m.out)
    return m


def descend(m: Model, rows: list[np.ndarray], labels: np.ndarray, fit: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Fits ``m`` to rows ``fit``, one at a time."""
    square = [np.full_like(p, 1e-3) for p in (m.out, *m.kernels, *m.biases)]
    sq_table, sq_bias, rate = np.full(BUCKETS, 1e-3, np.float32), 1e-3, 0.05
    for _ in range(epochs):
        for i in rng.permutation(fit):
            x, y = rows[i], float(labels[i])
            if not len(x):
                continue
            pooled, where = [], []
            for a, v in m.strongest(x):
                pooled.append(np.maximum(v, 0))
                where.append((a, v > 0))
            h = np.concatenate(pooled)
            g = 1 / (1 + np.exp(-np.clip(h @ m.out + m.bias, -30, 30))) - y
            grads = [g * h]
            back = (g * m.out).reshape(len(WIDTHS), FILTERS)
            gk, gb, moves = [], [], []
            for q, (k, hit) in enumerate(zip(m.kernels, where, strict=True)):
                a, on = hit
                gw, gv = np.zeros_like(k), (back[q] * on).astype(np.float32)
                if on.any():
                    for j in range(len(k)):
                        at = x[np.minimum(a + j, len(x) - 1)]
                        gw[j] = (m.table[at].sum(axis=1) * gv[:, None]).T
                        moves.append((at, gv[:, None] * k[j].T))
                gk.append(gw)
                gb.append(gv)
            for p, s, d in zip((m.out, *m.kernels, *m.biases), square, grads + gk + gb, strict=True):
                s += d * d
                p -= rate * d / np.sqrt(s)
            sq_bias += g * g
            m.bias -= rate * g / np.sqrt(sq_bias)
            for at, d in moves:
                size = (d * d).mean(axis=1)
                for c in range(at.shape[1]):
                    np.add.at(sq_table, at[:, c], size)
                    np.add.at(m.table, at[:, c], -rate * d / np.sqrt(sq_table[at[:, c]])[:, None])


def featured(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the buckets of its words, and their language buckets."""
    rows, shorts = [], []
    for lo in range(0, len(texts), 64):
        b, short, first = features(pa.array(texts[lo : lo + 64], pa.string()))
        rows += [b[i:j].copy() for i, j in zip(first, first[1:], strict=False)]
        shorts += [short[i:j].copy() for i, j in zip(first, first[1:], strict=False)]
    return rows, shorts


def train(texts: list[str], labels: np.ndarray, languages: list[str], epochs: int = 4, seed: int = 11) -> Model:
    """A model fit to the given rows; every fifth row calibrates thresholds only."""
    rng = np.random.default_rng(seed)
    n = len(texts)
    rows, shorts = featured(texts)
    fit_rows = [i for i in range(n) if i % 5]
    seen = np.zeros((2, BUCKETS))
    for i in fit_rows:
        seen[int(labels[i])][np.unique(rows[i])] += 1
    m = started(rng, seen, np.array([sum(1 - labels[i] for i in fit_rows), sum(labels[i] for i in fit_rows)]))
    fit = np.array(fit_rows, np.int64)
    held = np.arange(0, n, 5)
    descend(m, rows, labels, fit, epochs, rng)
    m.languages = sorted(set(languages)) or ["?"]
    counts = np.full((len(m.languages), LANG_BUCKETS), 0.5)
    for i, s in enumerate(shorts):
        np.add.at(counts[m.languages.index(languages[i])], s[s >= 0], 1)
    m.by_language = np.log(counts / counts.sum(axis=1, keepdims=True))
    logits, lang = np.zeros(len(held)), np.zeros(len(held), np.int64)
    for k, i in enumerate(held):
        edge = np.array([0, len(rows[i])])
        logits[k] = m.logits(m.pooled(rows[i], edge))[0]
        lang[k] = m.languages_of(shorts[i], edge)[0]
    y = labels[held]
    learned = labels[fit]
    # with rows of one label only, nothing was learned to tell them apart
    every = best_threshold(logits, y) if len(learned) and learned.min() < learned.max() else NEVER
    m.shifts = np.array([best_threshold(logits[lang == k], y[lang == k], every) if every < NEVER else NEVER for k in range(len(m.languages))])
    return m


def best_threshold(logits: np.ndarray, y: np.ndarray, otherwise: float | None = None, counts: np.ndarray | None = None) -> float:
    """The middle of the gap that separates the labels with the fewest errors.  Without both labels
    ``otherwise``, or else a place above all clean rows, or without such rows where no text comes to.  ``counts``: rows that
    each place stands for."""
    if not len(y) or y.min() == y.max():
        above = float(logits.max()) + 1 if len(y) and not y.max() else NEVER
        return above if otherwise is None else otherwise
    s = np.argsort(logits)
    z, t, c = logits[s], y[s], np.ones(len(y)) if counts is None else counts[s]
    errors = np.concatenate([[0], np.cumsum(t * c)]) + np.concatenate([np.cumsum(((1 - t) * c)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    # no place lies between equal ones
    apart = np.concatenate([[True], z[1:] > z[:-1], [True]])
    low = np.flatnonzero(apart & (errors == errors[apart].min()))
    return float(edges[low[len(low) // 2]])


def labelled(docs: DataFrame, labels: DataFrame, rows: Column | None, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(h, y_id, t, l, y) of every labelled row for which ``rows`` holds."""
    y = labels.where(F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("y_id"), F.col("toxic").alias("y")).groupBy("y_id").agg(F.max("y").alias("y"))
    y = y.withColumn("h", F.xxhash64("y_id")).where(rows if rows is not None else F.lit(True))
    few = 64 * labels.count() <= BROADCAST_BYTES
    got = docs.join(F.broadcast(y) if few else y, docs[id_col] == y["y_id"])
    got = got.select("h", "y_id", text_of(text_col).alias("t"), F.coalesce(F.col(lang_col), F.lit("?")).alias("l"), F.col("y").cast("double").alias("y"))
    # texts that were shuffled for the join are read several times
    return got if few else stored(got, "labelled")


def sampled(docs: DataFrame, labels: DataFrame, rows: Column | None, sample: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(h, y_id, t, l, y) of at most ``sample`` rows of each label (twice as many clean ones), for which ``rows`` holds, in order."""
    y = labels.where(F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("y_id"), F.col("toxic").alias("y")).groupBy("y_id").agg(F.max("y").alias("y"))
    y = y.withColumn("h", F.xxhash64("y_id")).where(rows if rows is not None else F.lit(True))
    # the smallest hashes of each label: two bounded top-k, no group in one task
    few = y.where("y = 1").orderBy("h", "y_id").limit(sample).unionByName(y.where("y = 0").orderBy("h", "y_id").limit(2 * sample))
    return docs.join(F.broadcast(few), docs[id_col] == few["y_id"]).select("h", "y_id", text_of(text_col).alias("t"), F.coalesce(F.col(lang_col), F.lit("?")).alias("l"), F.col("y").cast("double").alias("y")).orderBy("h", "y_id", "t").limit(3 * sample)


def in_one_task(rows: DataFrame) -> Model:
    """The model of rows (h, y_id, t, l, y), which are one partition and in order; only it comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, lang, y = [], [], []
        for b in batches:
            for to, c in zip((texts, lang, y), b.columns[2:], strict=True):
                to += c.to_pylist()
        yield pa.record_batch([pa.array([pickle.dumps(train(texts, np.array(y, np.float64), lang))], pa.binary())], names=["model"])

    got = mapped(rows, run, "model binary").collect()
    # a plan that Spark knows to be empty has no task
    return pickle.loads(got[0].model) if got else train([], np.zeros(0), [])


def _counted(rows: DataFrame) -> pa.Table:
    """(kind, key, n): rows to fit by label ("fit"), those that have a bucket ("0" and "1", by label), and of all rows the language
    buckets of words ("l" and the language) and the rows ("r" and the language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                c = b.slice(lo, 64)
                words, shorts = featured(c.column(0).to_pylist())
                for row, short, lang, y, fit in zip(words, shorts, *(c.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    if fit:
                        sums.setdefault(str(int(y)), np.zeros(BUCKETS, np.int64))[np.unique(row)] += 1
                        sums.setdefault("fit", np.zeros(2, np.int64))[int(y)] += 1
                    np.add.at(sums.setdefault(f"l{lang}", np.zeros(LANG_BUCKETS, np.int64)), short[short >= 0], 1)
                    # so that a language without short words is known
                    sums.setdefault(f"r{lang}", np.zeros(1, np.int64))[0] += 1
        for kind, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["kind", "key", "n"])

    return mapped(rows.select("t", "l", "y", "fit"), run, "kind string, key int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()


def _moved(rows: DataFrame, start: Model, parts: int, epochs: int, seed: int) -> Model:
    """``start`` moved by the mean of what the parts of the rows to fit have learned."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(start))
    sizes = [p.size for p in start.dense()]

    def learn(part: int, texts: list[str], y: list[float]) -> Iterator[pa.RecordBatch]:
        before, m = pickle.loads(sent.value), pickle.loads(sent.value)
        descend(m, featured(texts)[0], np.array(y, np.float64), np.arange(len(texts)), epochs, np.random.default_rng([seed, part]))
        moved = m.table - before.table
        at = np.flatnonzero(moved.any(axis=1))
        cuts = np.flatnonzero(np.diff(at // BLOCK)) + 1
        blocks = [(int(a[0]) // BLOCK, a % BLOCK, moved[a]) for a in np.split(at, cuts) if len(a)]
        rest = np.concatenate([*((p - q).ravel() for p, q in zip(m.dense(), before.dense(), strict=True)), [m.bias - before.bias]])
        blocks.append((-1, np.zeros(1, np.int32), rest))
        yield pa.record_batch([pa.array([b for b, _, _ in blocks], pa.int32()), *(pa.array([v.astype(k).tobytes() for v in c], pa.binary()) for k, c in (("<i4", [a for _, a, _ in blocks]), ("<f4", [v for *_, v in blocks])))], names=["block", "at", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, texts, y = -1, [], []
        for b in batches:
            for p, text, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part and texts:
                    yield from learn(part, texts, y)
                    texts, y = [], []
                part = p
                texts.append(text)
                y.append(label)
        if texts:
            yield from learn(part, texts, y)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, sums = None, None, None

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(n)
            v = sums[at] / UNIT / n[at][:, None]
            return pa.record_batch([pa.array([block], pa.int32()), pa.array([at.astype("<i4").tobytes()]), pa.array([v.astype("<f4").tobytes()])], names=["block", "at", "v"])

        for b in batches:
            for now, a, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != block:
                    if block is not None:
                        yield out()
                    block, n = now, np.zeros(BLOCK if now >= 0 else 1, np.int64)
                    sums = np.zeros((len(n), DIM if now >= 0 else sum(sizes) + 1), np.int64)
                a = np.frombuffer(a, "<i4")
                n[a] += 1
                sums[a] += np.rint(np.frombuffer(v, "<f4").astype(np.float64) * UNIT).astype(np.int64).reshape(len(a), -1)
        if block is not None:
            yield out()

    dealt = rows.where("fit").withColumn("part", F.pmod(F.xxhash64("y_id", "t"), F.lit(parts)).cast("int"))
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "h", "y_id", "t").select("part", "t", "y")
    schema = "block int, at binary, v binary"
    # what the parts learned is written first: a lost executor costs a part, not all of them
    learned = stored(mapped(dealt, run, schema), "toxicity-parts")
    m = pickle.loads(pickle.dumps(start))
    for row in mapped(learned.repartition("block").sortWithinPartitions("block"), mean, schema).collect():
        at, v = np.frombuffer(row.at, "<i4"), np.frombuffer(row.v, "<f4")
        if row.block >= 0:
            m.table[row.block * BLOCK + at] += v.reshape(-1, DIM)
        else:
            for p, d in zip(m.dense(), np.split(v, np.cumsum(sizes)), strict=False):
                p += d.reshape(p.shape)
            m.bias += float(v[-1])
    return m


def _calibrated(rows: DataFrame, m: Model, both: bool) -> Model:
    """``m`` with thresholds from the rows that are not fit, counted by steps of the output."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = pickle.loads(sent.value), Counter()
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                c = b.slice(lo, 64)
                words, short, first = features(c.column(0))
                step = np.rint(model.logits(model.pooled(words, first)) * STEPS).astype(np.int64)
                sums.update(zip(model.languages_of(short, first).tolist(), step.tolist(), c.column(1).to_pylist(), strict=True))
        keys = list(zip(*sums, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.float64()), pa.array(list(sums.values()), pa.int64())], names=["lang", "step", "y", "n"])

    got = mapped(rows.where("NOT fit").select("t", "y"), run, "lang int, step long, y double, n long").groupBy("lang", "step", "y").agg(F.sum("n").alias("n")).orderBy("lang", "step", "y").toArrow()
    lang, step, y, n = (got.column(k).to_numpy() for k in range(4))
    every = best_threshold(step / STEPS, y, None, n) if both else NEVER
    m.shifts = np.array([best_threshold(step[lang == k] / STEPS, y[lang == k], every, n[lang == k]) if every < NEVER else NEVER for k in range(len(m.languages))])
    return m


def in_parts(rows: DataFrame, parts: int, epochs: int = 4, seed: int = 11) -> Model:
    """The model of any number of rows (h, y_id, t, l, y), each part of which is a task."""
    rows = rows.withColumn("fit", F.pmod(F.shiftright("h", 8), F.lit(5)) != 0)
    got = _counted(rows)
    kind, key, n = got.column(0).to_pylist(), got.column(1).to_numpy(), got.column(2).to_numpy()
    kinds = np.array(kind, object)
    seen, totals = np.zeros((2, BUCKETS)), np.zeros(2)
    for k in range(2):
        seen[k][key[kinds == str(k)]] = n[kinds == str(k)]
    totals[key[kinds == "fit"]] = n[kinds == "fit"]
    m = _moved(rows, started(np.random.default_rng(seed), seen, totals), parts, epochs, seed)
    m.languages = sorted({k[1:] for k in set(kind) if k[0] == "r"}) or ["?"]
    counts = np.full((len(m.languages), LANG_BUCKETS), 0.5)
    for i, lang in enumerate(m.languages):
        counts[i][key[kinds == f"l{lang}"]] += n[kinds == f"l{lang}"]
    m.by_language = np.log(counts / counts.sum(axis=1, keepdims=True))
    return _calibrated(rows, m, bool(totals.all()))


def fitted(docs: DataFrame, labels: DataFrame, rows: Column | None = None, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """``rows``: a condition on column y_id that training rows must meet.  ``sample``: only so many rows of each label, for trials."""
    if sample is not None:
        return in_one_task(sampled(docs, labels, rows, sample, id_col, text_col, lang_col))
    every = labelled(docs, labels, rows, id_col, text_col, lang_col)
    n, size = every.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(-(-n // PART), -(-size // PART_BYTES))
    if parts > 1:
        return in_parts(every, parts)
    return in_one_task(every.repartition(1).sortWithinPartitions("h", "y_id", "t"))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a column of the output's name is replaced."""
    docs = docs.select(*(c for c in docs.columns if c == text_col or c.lower() != out_col.lower()))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        for batch in (x.slice(lo, 1024) for x in batches for lo in range(0, x.num_rows, 1024)):
            scores = []
            for lo in range(0, batch.num_rows, 64):
                b, short, first = features(batch.column(at).slice(lo, 64))
                scores.append(m.scores(m.logits(m.pooled(b, first)), m.languages_of(short, first)))
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names, out_col])

    return mapped(docs, run, schema)
