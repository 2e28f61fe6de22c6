"""Plain loops for what SQL can't express: fingerprints, toxicity scores, and the pipeline's near-duplicates and windows."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chromagrid.llm import packing, registry, simhash, toxicity, vocab

GAPS = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chained_hash(parts):
    """Spark's xxhash64 of several strings: each hash seeds the next, nulls are passed over."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64(p.encode(), seed=h).intdigest()
    return h


def fingerprint(text):
    words = GAPS.split(text.lower())
    votes = [0] * 64
    for i, w in enumerate(words):
        h = chained_hash([w, *(words[j] if j < len(words) else None for j in (i + 1, i + 2))])
        for bit in range(64):
            votes[bit] += len(w) if h >> bit & 1 else -len(w)
    got = sum(1 << bit for bit, v in enumerate(votes) if v > 0)
    return got - (1 << 64) if got >> 63 else got


def test_fingerprints_equal_a_loop_of_votes(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(spark.createDataFrame([(-1, ""), (-2, " a  b "), (-3, "É x"), (-4, "one")], "doc_id bigint, text string"))
    got = {r.doc_id: r.fp for r in simhash.fingerprints(rows, ["doc_id"], "text").collect()}
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert got == {i: fingerprint(t) for i, t in texts.items()}


def test_toxicity_scores_equal_windows_one_by_one(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fitted(docs, labels, F.crc32(F.col("y_id").cast("string").cast("binary")) % 3 != 1)
    got = {r.doc_id: r for r in registry.op8_toxicity(spark, sf_dir).collect()}
    for r in docs.collect():
        buckets, short, first = toxicity.features(pa.array([r.text or ""]))
        word = [sum(model.table[b] for b in row).astype(np.float64) for row in buckets]
        pooled = []
        for q, width in enumerate(toxicity.WIDTHS):
            best = np.zeros(toxicity.FILTERS)
            for i in range(len(word) - width + 1):
                best = np.maximum(best, sum(word[i + j] @ model.kernels[q][j] for j in range(width)) + model.biases[q])
            pooled += list(best)
        z = float(np.array(pooled) @ model.out + model.bias - model.shifts[model.languages_of(short, first)[0]]) + np.log(0.7 / 0.3)
        want = 1 / (1 + np.exp(-min(40, max(-40, z))))
        assert abs(got[r.doc_id].score - want) < 1e-3 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_one_document_of_each_group_of_near_duplicates_stays(spark, docs, sf_dir):
    rows = docs.select("doc_id", "text").collect()
    near = docs.where("text IS NOT NULL").limit(20).withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.concat("text", F.lit(" tail words")))
    every = docs.unionByName(near)
    rows = every.select("doc_id", "text").collect()
    sets, holders = {}, collections.defaultdict(list)
    for r in rows:
        w = [x for x in GAPS.split(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[r.doc_id]:
            holders[s].append(r.doc_id)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    shared = collections.Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            top[find(a)] = find(b)
    left = collections.Counter(find(r.doc_id) for r in corpus_pipeline.drop_near(spark, every, sf_dir).select("doc_id").collect())
    assert left == collections.Counter({find(i) for i in sets}) and len(left) < len(rows)


def test_windows_of_the_pipeline_hold_all_tokens_in_order(spark, docs, sf_dir):
    """Two copies of each document, as mixing may give them."""
    from tokenizers import Tokenizer

    few = docs.limit(40)
    rows = corpus_pipeline.pack(spark, few.unionByName(few), sf_dir).collect()
    library = Tokenizer.from_file(vocab.place("word_bpe_49k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in few.collect()}
    held = collections.Counter()
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.start + r.length <= r.doc_tokens
        held.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    assert held == collections.Counter({(d, i): 2 for d, t in ids.items() for i in range(len(t))})
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert sum(sum(n for _, n in p) < packing.WINDOW for p in windows.values()) <= 1
