"""Operators of the llm folder: brute force, edge cases, round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromagrid.llm import exact_dedup, html_extract, lm_score, minhash, mixing, packing, registry, simhash, substring_dedup, token_counts, toxicity, vocab
from chromagrid.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sha string, kept string"


def frame(spark, rows):
    """Documents with two further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


def edge_rows():
    long = " ".join(f"w{i % 900}" for i in range(60_000))
    return [(1, None, "a"), (2, "", "a"), (3, "Some text here", None), (4, "Some  text\there", "b"), (5, "Some text here", "b"), (None, "Some text here", "b"), (6, long, "a"), (7, "x", "a"), (8, "x", "a"), (9, "ünï ☃ 漢字 \x1c odd", "c"), (9, "same id", "c")]


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, edge_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).cache()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, compare):
    compare(registry.QUERIES[name](spark, sf_dir), registry.SQL[name])


# exact dedup


def test_exact_dedup_edges(edge, empty):
    rows = exact_dedup.decisions(edge).collect()
    assert len(rows) == len(edge_rows())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    group = by[hashlib.sha256(b"Sometexthere").hexdigest()]
    assert sorted(str(r.doc_id) for r in group) == ["3", "4", "5", "None"]
    assert {r.keep_id for r in group} == {4} and {r.group_size for r in group} == {4}  # the longest original
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    assert exact_dedup.decisions(empty).count() == 0
    kept = exact_dedup.keep_first(edge)
    assert kept.columns == edge.columns and kept.count() == len(by)


def test_exact_dedup_of_identical_rows(spark):
    d = frame(spark, [(1, "a b", "s")] * 5 + [(2, "ab", "s")])
    assert [r.doc_id for r in exact_dedup.keep_first(d).collect()] == [1]
    assert sum(r.kept for r in exact_dedup.decisions(d).collect()) == 1


def flagged_by(d, key):
    dealt = exact_dedup.blocks_of(d.count())
    return exact_dedup.flagged(stored(d.withColumn("part", dealt.range(F.col(key))), "test-exact", "part"), key, "part", "maybe", dealt)


def test_filter_never_misses_a_repeat(spark):
    d = spark.range(3000).select(F.col("id").alias("i"), F.concat(F.lit("k"), (F.col("id") % 2900).cast("string")).alias("key"))
    flags = {r.i: r.maybe for r in flagged_by(d, "key").collect()}
    assert all(flags[i] for i in [*range(100), *range(2900, 3000)])
    assert sum(flags.values()) < 400


def test_filter_in_ranges_shuffles_no_row_and_changes_nothing(spark, edge, monkeypatch):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("k "), (F.col("id") % 2900).cast("string")).alias("text"))
    whole, edges = set(exact_dedup.decisions(d).collect()), {r.doc_id for r in exact_dedup.keep_first(edge).collect()}
    monkeypatch.setattr(exact_dedup, "TEXTS_A_BLOCK", 100)
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 8 * exact_dedup.BLOCK_BYTES)
    dealt = exact_dedup.blocks_of(3000)
    assert (dealt.blocks, dealt.ranges) == (30, 4)
    rows = d.withColumn("part", dealt.range(F.col("text")))
    maps = exact_dedup.twice_filter(d, "text", dealt)
    for i in range(4):  # a job holds the filter of one range
        plan = exact_dedup.probe_plan(rows, "text", "part", "maybe", dealt, maps, i)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    marked = flagged_by(d, "text")
    assert "Broadcast" not in marked._jdf.queryExecution().executedPlan().toString()
    flags = {r.doc_id: r.maybe for r in marked.collect()}
    assert len(flags) == 3000 and all(flags[i] for i in [*range(100), *range(2900, 3000)]) and sum(flags.values()) < 400
    assert set(exact_dedup.decisions(d).collect()) == whole
    assert len(exact_dedup.keep_first(d).collect()) == 2900
    monkeypatch.setattr(exact_dedup, "TEXTS_A_BLOCK", 2)
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", exact_dedup.BLOCK_BYTES)
    assert {r.doc_id for r in exact_dedup.keep_first(edge).collect()} == edges


def test_share_of_single_texts_that_the_filter_holds(spark):
    d = spark.range(200_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    assert flagged_by(d, "key").where("maybe").count() < 8000  # 3 % expected


# HTML


def test_pages_of_the_table(spark, sf_dir):
    got = {r.page_id: r for r in registry.op2_html_extract(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(</article>|$)", p.html or "", re.S)
        want = re.sub(r"<(?:/?p|/?h1|br)>", " ", m[1]) if m else ""
        want = " ".join(__import__("html").unescape(re.sub(r"<[^>]*>", "", want)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>Welcome, to, our, site, with, many, commas, here.</p></header><div id="cookie-notice"><p>We use cookies, and more cookies, and so on.</p></div>
<div class="wrap"><div class="content"><h2>A title</h2><div><p>First long paragraph, with commas, and enough length to be scored well by anyone who reads it &amp; likes it.<p>Second one, a bit shorter, still fine.</div>
<ul><li>point one<li>point two</ul><script>if (a < b) document.write("</p>")</script><ul class="related"><li><a href=x>Link one</a></ul></div><div class="sidebar"><p>Sidebar text, that is long, and has, many, commas, in, it, to, fool, the, scorer.</p></div></div>
<section id="comments"><article class="comment"><p>I liked it, really, really, a lot, so, so, much.</p></article></section><form><p>Your name, your mail, your wishes, please, now.</p></form><footer>foot"""


def test_page_with_all_kinds_of_clutter():
    assert html_extract.main_text(PAGE) == "A title First long paragraph, with commas, and enough length to be scored well by anyone who reads it & likes it. Second one, a bit shorter, still fine. point one point two"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>short", "short"), ("<div>a<br>b &lt;x&gt; <b>c</b>d</div>", "a b <x> cd"), ("<p" * 50, ""), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"), ("<!-- a", ""), ("</p></div>x", "x")])
def test_odd_pages(page, want):
    assert html_extract.main_text(page) == want


@given(st.text(alphabet="<>/pdivbaul &;\"'=!-x ,", max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_page_has_some_text(page):
    assert isinstance(html_extract.main_text(page), str)


LONG = "A paragraph of some length, with commas, and words enough to be scored as part of an article, surely."


@pytest.mark.parametrize(
    ("piece", "text"),
    [
        ("<p><a href=x>A paragraph that is one link</a></p>", "A paragraph that is one link"),
        ("<ul><li><a href=x>Reference one</a><li><a href=y>Reference two</a></ul>", "Reference one Reference two"),
        ('<div class="legal">Legal part of the story</div>', "Legal part of the story"),
        ('<section class="discussion"><p>The authors discuss.</p></section>', "The authors discuss."),
        ('<div class="entry-header"><h2>Heading</h2></div>', "Heading"),
        ('<div class="share"><a href=x>Share on one</a> <a href=y>Share on two</a></div>', ""),
        ('<div class="comments"><p>I agree, fully.</p></div>', ""),
        ("<nav><a href=x>Home</a></nav>", ""),
    ],
)
def test_pieces_of_an_article(piece, text):
    page = f"<html><body><nav><a href=h>Home</a></nav><article><p>{LONG}</p>{piece}<p>{LONG}</p></article><footer>foot</footer></body></html>"
    assert html_extract.main_text(page) == " ".join(filter(None, [LONG, text, LONG]))


def test_empty_and_repeated_pages(spark):
    schema = "page_id bigint, url string, html string"
    assert html_extract.extracted(spark.createDataFrame([], schema)).count() == 0
    d = spark.createDataFrame([(1, "u", "<p>same page</p>")] * 3 + [(None, None, "<p>x</p>")], schema)
    assert sorted(r.text for r in html_extract.extracted(d).collect()) == ["same page"] * 3 + ["x"]


def test_extra_columns_pass(spark):
    d = spark.createDataFrame([(1, "u", "<p>hello there</p>", "old"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    assert [(r.page_id, r.text) for r in html_extract.extracted(d).orderBy("page_id").collect()] == [(1, "hello there"), (2, "")]


# SimHash


def test_simhash_digest(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in registry.op3_simhash(spark, sf_dir).collect()}
    order = sorted(documents)
    for k, i in enumerate(order):
        x, y = documents[i], documents[order[(k + 1) % len(order)]]
        e = x[: len(x) - len(x) // 4] + y[: len(x) // 4]
        assert rows[i].n_chars == len(x) and rows[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        other = rows[order[(k + 1) % len(order)]]
        bits = (int(rows[i].fingerprint, 16) ^ int(other.fingerprint, 16)).bit_count()
        assert abs(rows[i].near_next - (1 - bits / (4 * len(other.fingerprint)))) < 1e-9
    near, far = [r.near_edited for r in rows.values()], [r.near_next for r in rows.values()]
    assert np.mean(np.array(near)[:, None] > np.array(far)[None]) > 0.97


def test_simhash_edges(edge, empty):
    rows = simhash.digest(edge.where("doc_id <> 9")).collect()
    assert len(rows) == 8  # a null id isn't unequal to 9
    same = {r.fingerprint for r in rows if r.doc_id in (7, 8)}
    assert len(same) == 1
    assert simhash.digest(empty).count() == 0
    every = simhash.digest(edge).collect()
    assert len(every) == len(edge_rows())
    assert [(r.edited_sha256, r.near_edited, r.near_next) for r in every if r.doc_id is None] == [(None, None, None)]


def test_simhash_of_repeated_rows(spark):
    d = frame(spark, [(1, "some words of a text", "s")] * 3 + [(2, "other words", "s"), (2, "other words", "s"), (3, None, "s")])
    rows = simhash.digest(d).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 1, 2, 2, 3]
    one = {(r.edited_sha256, r.fingerprint) for r in rows if r.doc_id == 1}
    assert one == {(r.edited_sha256, r.fingerprint) for r in simhash.digest(d.dropDuplicates()).collect() if r.doc_id == 1}


def test_simhash_query_counts_neighbours(spark):
    rows = registry.op3_simhash(spark, "/root/testdata/sf0.01").collect()
    u = sorted({int(r.fingerprint, 16) for r in rows})
    near = {a: sum(0 < (a ^ b).bit_count() <= simhash.RADIUS for b in u) for a in u}
    assert all(r.n_near == near[int(r.fingerprint, 16)] for r in rows) and sum(near.values()) > 0


def test_neighbours_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 4)  # several groups of a key
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(40)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(0, 6))) for b in base for _ in range(6)] + base
    got = {(r.a, r.b): r.distance for r in simhash.neighbours(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()}
    u = sorted(set(prints))
    assert got == {(a, b): (a ^ b).bit_count() for i, a in enumerate(u) for b in u[i + 1 :] if (a ^ b).bit_count() <= 3}
    rows = simhash.neighbours(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    assert rows.count() == len(got)  # each pair once


# packing


def check_pieces(rows, texts):
    """Exact round trip of ids, gapless windows."""
    lib, by, seq = vocab.library(vocab.place("word_bpe_49k.json")), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids, at = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    fills = []
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert sum(f < 4096 for f in fills) <= 1 and max(fills) <= 4096
    return seq


def test_packing_round_trip_and_mixture(spark, sf_dir, documents):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    seq = check_pieces(rows, documents)
    total = collections.Counter()
    for r in rows:
        total[r.source] += r.length
    all_ = sum(total.values())
    for s in [s for s in seq if s < max(seq)]:
        here = collections.Counter()
        for r in seq[s]:
            here[r.source] += r.length
        for k, n in total.items():
            assert abs(here[k] - 4096 * n / all_) <= 2 * packing.QUANTUM


def test_packing_edges(spark, edge, empty):
    d = edge.where("doc_id < 9")
    check_pieces(packing.pack(d).collect(), {i: t for i, t, _ in edge_rows() if i and i < 9})
    assert packing.pack(empty).count() == 0
    w = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    assert packing.pack(edge, weights=w).agg(F.sum("length")).first()[0] == packing.pack(edge).agg(F.sum("length")).first()[0]


def test_packing_of_null_and_repeated_ids(spark):
    """A multiset of whole documents comes back, whatever their ids."""
    lib = vocab.library(vocab.place("word_bpe_49k.json"))
    rows = [(None, "first text", "a"), (None, "second text here", "a"), (9, "same id", "b"), (9, "same id", "b"), (9, None, None)]
    got = packing.pack(frame(spark, rows)).collect()
    assert sorted(r.offset for r in got)[0] == 0 and sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((i, crc(t)) for i, t, _ in rows)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_chunk_ids_equal_the_library(text):
    path = vocab.place("word_bpe_49k.json")
    want = vocab.library(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(vocab.word_ids(path).ids(text), "<u2").tolist() == want


# substring dedup


def brute_substring(docs, window):
    seen, out = {}, {}
    for i, t in sorted(docs):
        w = WORD.findall(t or "")
        cover, new = [False] * len(w), []
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key not in seen:
                new.append(key)
            elif seen[key] < i:
                cover[j : j + window] = [True] * window
        for k in new:
            seen.setdefault(k, i)
        kept = [a for a, c in zip(w, cover, strict=True) if not c]
        out[i] = (len(w), sum(cover), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup_of_the_table(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.op5_substring_dedup(spark, sf_dir).collect()}
    assert got == brute_substring(documents.items(), 50)


def test_substring_dedup_of_shared_passages(spark):
    rng = random.Random(5)
    passages = [" ".join(f"p{k}w{rng.randrange(50)}" for _ in range(rng.randrange(8, 40))) for k in range(6)]
    docs = []
    for i in range(60):
        parts = [" ".join(f"d{i}x{rng.randrange(4)}" for _ in range(rng.randrange(0, 30))) for _ in range(3)]
        docs.append((i, " ".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages), parts[2]]) if i % 7 else "a " * rng.randrange(30)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(frame(spark, [(i, t, "s") for i, t in docs]), window=10, k=4).collect()}
    assert got == brute_substring(docs, 10)


def test_words_decide_where_hashes_are_equal(spark, monkeypatch):
    """With word hashes of two values, nearly everything looks repeated; only equal words go."""
    rng = random.Random(7)
    common = " ".join(f"c{rng.randrange(9)}" for _ in range(14))
    docs = [(i, " ".join([f"d{i}x{rng.randrange(3)}" for _ in range(12)]) + (f" {common}" if i % 3 == 0 else "")) for i in range(12)]
    want = brute_substring(docs, 10)
    real = substring_dedup.repeated

    def wrong(rows, window, k):
        cuts = real(rows, window, k)
        # a false path in every document: words 0 .. 10, with the hash of other words
        false = rows.select("id", "row", F.array(F.struct(F.lit(0).alias("lo"), F.lit(1).alias("n"), F.lit(b"no").alias("sha"))).alias("cuts"))
        return cuts.unionByName(false).groupBy("id", "row").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))

    monkeypatch.setattr(substring_dedup, "repeated", wrong)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(frame(spark, [(i, t, "s") for i, t in docs]), window=10, k=4).collect()}
    assert got == want and any(n for _, n, _ in want.values())


def test_paths_compact_what_follows_at_both_ends(spark):
    rows = [(2, 0, 5, 3, (1, 0, 15)), (2, 0, 8, 1, (1, 0, 18)), (2, 0, 9, 2, (1, 0, 40)), (2, 0, 20, 1, (1, 0, 30))]
    d = spark.createDataFrame(rows, "id bigint, row bigint, lo int, n int, origin struct<id:bigint,row:bigint,lo:int>")
    assert sorted((r.lo, r.n, r.o_lo) for r in substring_dedup.paths(d).collect()) == [(5, 4, 15), (9, 2, 40), (20, 1, 30)]


def test_largest_id_is_no_null(spark):
    d = frame(spark, [((1 << 63) - 1, "a b", "s"), (None, "c", "s")])
    assert {r.doc_id for r in substring_dedup.digest(d).collect()} == {(1 << 63) - 1, None}


def test_substring_dedup_edges(edge, empty):
    assert substring_dedup.digest(edge).count() == len(edge_rows())
    assert substring_dedup.digest(empty).count() == 0


# MinHash


def brute_near(docs, size, num, den):
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_docs():
    rng, out = random.Random(9), []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([6, 20, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
            out.append((len(out), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    return [*out, (len(out), ""), (len(out) + 1, None), (len(out) + 2, "one"), (len(out) + 3, "One"), (len(out) + 4, "one two")]


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_minhash_equals_all_pairs(spark, size, num):
    docs = near_docs()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.grouped(frame(spark, [(i, t, "s") for i, t in docs]), size=size, num=num).collect()}
    assert got == brute_near(docs, size, num, 100)


def family(n=320, words=400, edits=10):
    """A base text with the middle id; its copies reach 0.85 with the base and about 0.74 with each other."""
    rng = random.Random(4)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in range(edits if i != n // 2 else 0):
            w[(k * words // edits) + rng.randrange(5, words // edits - 5)] = f"e{i}x{k}"
        out.append((i, " ".join(w)))
    return out


def test_minhash_of_a_family_around_its_middle_text(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)  # several blocks in a bucket
    docs = family()
    want = {i: c for i, (_, c, _) in brute_near(docs, 3, 85, 100).items()}
    assert len(set(want.values())) == 1
    got = minhash.grouped(frame(spark, [(i, t, "s") for i, t in docs]), size=3, num=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def near_threshold(seed, groups=6, members=120, words=120):
    """Variants with 1 to 4 words changed: similarities on both sides of 0.85."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minhash_of_groups_near_the_threshold(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    docs = near_threshold(seed)
    got = minhash.grouped(frame(spark, [(i, t, "s") for i, t in docs]), size=3, num=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(docs, 3, 85, 100)


def test_minhash_query_equals_all_pairs(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.op6_minhash(spark, sf_dir).collect()}
    assert got == brute_near(documents.items(), 3, 85, 100)


def test_minhash_blocks_put_out_no_more_than_a_tree_of_links():
    s = [np.arange(100, dtype=np.uint64)] * 40
    links = minhash.joined(np.zeros(40, int), np.arange(40), np.arange(40), [None] * 40, 0, s, 0, 0, 85, 100)
    assert len(links) == 39


def test_minhash_edges(edge, empty):
    rows = minhash.grouped(edge).collect()
    assert len(rows) == len(edge_rows()) and all(r.kept for r in rows if r.doc_id is None)
    assert minhash.grouped(empty).count() == 0
    kept = minhash.keep_one(edge)
    assert kept.columns == edge.columns


def test_sketch_of_one_shingle():
    assert len(set(minhash.sketch(np.array([7], np.uint64)).tolist())) == 1


# language model


def test_lm_scores(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in registry.op7_lm_score(spark, sf_dir).collect()}
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in documents.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert sum(rows[i].score for i in rows if out[i]) > sum(rows[i].base_score for i in rows if out[i])


def test_lm_scores_equal_a_dictionary_model(spark, sf_dir, documents):
    """The same model with dictionaries of words; its weights are learned without histograms."""
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in documents.items()}
    turn = {i: zlib.crc32(str(i).encode()) % 7 for i in tokens}

    def counted(ids):
        one, two = collections.Counter(), collections.Counter()
        for i in ids:
            one.update(tokens[i])
            two.update(zip([0, *tokens[i]], tokens[i], strict=False))
        one[0] = len(ids)  # the start
        return one, two, sum(one.values()) - len(ids), len(one) - 1

    def em(ratios):
        x, r = 0.5, np.array(ratios)
        for _ in range(60):
            x = float((x * r / (x * r + 1 - x)).mean())
        return x

    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    one, two, n, v = counted([i for i in tokens if turn[i] not in (2, 5)])
    pairs = [p for i in tokens if turn[i] == 5 for p in zip([0, *tokens[i]], tokens[i], strict=False)]
    mix = em([one[w] / n * (v + 1) for _, w in pairs])
    ratios = collections.defaultdict(list)
    for a, w in pairs:
        ratios[bucket(one[a])].append(two[a, w] / max(one[a], 1) / (mix * one[w] / n + (1 - mix) / (v + 1)))
    weight = {k: em(r) if k else 0.0 for k, r in ratios.items()}
    for k in range(1, 40):
        weight.setdefault(k, weight.get(k - 1, 0.0))
    one, two, n, v = counted([i for i in tokens if turn[i] != 2])
    for r in registry.op7_lm_score(spark, sf_dir).collect():
        want = 0.0
        for a, w in zip([0, *tokens[r.doc_id]], tokens[r.doc_id], strict=False):
            x = weight.get(bucket(one[a]), 0.0)
            want += math.log10(x * two[a, w] / max(one[a], 1) + (1 - x) * (mix * one[w] / n + (1 - mix) / (v + 1)))
        assert math.isclose(r.score, want, rel_tol=0.01)


def test_lm_edges(edge, empty):
    rows = lm_score.scored(edge).collect()
    assert len(rows) == len(edge_rows()) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert lm_score.scored(empty).count() == 0


def test_mixture_weight_is_the_likeliest():
    r, n = np.array([0.0, 5.0]), np.array([3.0, 7.0])
    best = max(np.linspace(0.001, 0.999, 999), key=lambda x: (n * np.log(x * r + 1 - x)).sum())
    assert abs(lm_score.mixture(r, n) - best) < 0.002


# toxicity


def toxic_docs(n=400):
    rng, rows = random.Random(2), []
    for i in range(n):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))]
        y = int(rng.random() < 0.3)
        if y:
            w[rng.randrange(len(w))] = rng.choice(["zorkan", "zorkit", "zorkum"])
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_held_out():
    rows = toxic_docs()
    m = toxicity.train([t for _, t, _ in rows[:300]], np.array([y for *_, y in rows[:300]], float), ["en"] * 300)
    import pyarrow as pa

    b, short, first = toxicity.features(pa.array([t for _, t, _ in rows[300:]]))
    s = m.scores(m.logits(m.pooled(b, first)), m.languages_of(short, first))
    y = np.array([y for *_, y in rows[300:]])
    assert ((s >= toxicity.CUT) == (y == 1)).mean() > 0.95


def test_filters_see_the_order_of_words():
    """Both words are in texts of both labels; only side by side are they toxic."""
    import pyarrow as pa

    rng, texts, labels = random.Random(5), [], []
    for i in range(1500):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(8, 30))]
        at = rng.randrange(1, len(w) - 4)
        w[at:at] = ["zor", "kan"] if i % 2 else ["zor", w[0], w[1], "kan"]
        texts.append(" ".join(w))
        labels.append(i % 2)
    m = toxicity.train(texts[:1200], np.array(labels[:1200], float), ["en"] * 1200)
    b, short, first = toxicity.features(pa.array(texts[1200:]))
    hit = (m.scores(m.logits(m.pooled(b, first)), m.languages_of(short, first)) >= toxicity.CUT) == np.array(labels[1200:])
    assert hit.mean() > 0.8  # any score by words alone is right in one half of the cases


def test_training_reads_the_end_of_long_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 64)
    rng = np.random.default_rng(3)
    m = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [np.zeros(toxicity.FILTERS, np.float32) for _ in toxicity.WIDTHS], np.zeros(0), 0.0)
    x = rng.integers(0, toxicity.BUCKETS, (1000, 3)).astype(np.int32)
    got = np.concatenate([np.maximum(v, 0) for _, v in m.strongest(x)])
    assert np.allclose(got, m.pooled(x, np.array([0, 1000]))[0], atol=1e-3)
    assert max(a.max() for a, _ in m.strongest(x)) > 900


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.op8_toxicity(spark, sf).collect() if r.held_out and r.doc_id in y]
    toxic, clean = [r.predicted for r in rows if y[r.doc_id] == 1], [r.predicted for r in rows if y[r.doc_id] == 0]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.04 * len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_pooled_equals_a_plain_loop():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    m = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], np.zeros(0), 0.0)
    b, _, first = toxicity.features(pa.array(["a b c d e", "", "x", "one two", None, "p q r"]))
    got = m.pooled(b, first)
    for i in range(6):
        e = m.table[b[first[i] : first[i + 1]]].sum(axis=1)
        want = []
        for k, bias in zip(m.kernels, m.biases, strict=True):
            best = np.zeros(toxicity.FILTERS)
            for at in range(len(e) - len(k) + 1):
                best = np.maximum(best, sum(e[at + j] @ k[j] for j in range(len(k))) + bias)
            want.append(best)
        assert np.allclose(got[i], np.concatenate(want), atol=1e-3)


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(3, 1), (6, 0), (7, 0), (None, 1)], "doc_id bigint, toxic int")
    m = toxicity.fitted(edge, labels)
    rows = toxicity.scored(edge, m).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(empty, toxicity.fitted(empty, labels)).count() == 0


# token counts


def test_token_counts_equal_the_library(edge, empty):
    lib = vocab.library(vocab.place("byte_bpe_50k.json"))
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in edge_rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.counts(edge).collect()) == want
    assert token_counts.counts(empty).count() == 0


TEXTS = st.text(alphabet=st.sampled_from("ab'st the\n\t 12é☃<|endoftext|>.,"), max_size=24) | st.sampled_from(["a<|endoftext|>b", "don't  stop   now", "x  \n y", "'ll're"])


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_every_prefix_count_is_exact(text):
    path = vocab.place("byte_bpe_50k.json")
    lib, c = vocab.library(path), token_counts.counter(path)
    want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert c.prefix_counts(text) == want
    n = token_counts.longest_prefix(c.table(text), 3)
    assert want[n] <= 3 and all(w > 3 for w in want[n + 1 :])
    d = c.table(text)
    assert token_counts.decoded(token_counts.encoded(d), len(text)).tolist() == d.tolist()


def test_tables_with_wide_differences():
    d = np.array([1, -300, 5])
    assert token_counts.decoded(token_counts.encoded(d), 3).tolist() == d.tolist()


@pytest.mark.parametrize("text", ["ab" * 300, "\n" * 300 + "x", " " * 140 + "y  z", "a\xa0\u2028 b\u3000\u3000c", "漢字 'll 'Re é́x  \n\n y"])
def test_prefix_counts_of_odd_texts(text):
    path = vocab.place("byte_bpe_50k.json")
    lib = vocab.library(path)
    assert token_counts.counter(path).prefix_counts(text) == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_token_count_query_equals_the_library(spark, sf_dir, documents):
    lib = vocab.library(vocab.place("byte_bpe_50k.json"))
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rows = registry.op9_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    rng = random.Random(6)
    for r in rows:
        t = documents[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), size(t), size(t) > 512)
        counts = np.cumsum(token_counts.decoded(r.prefix_table, len(t)), dtype=np.int64)
        for i in rng.sample(range(len(t)), min(len(t), 5)):
            assert counts[i] == size(t[: i + 1])
        if r.over_limit:
            assert size(t[: r.fits]) <= 512 < min(size(t[:i]) for i in range(r.fits + 1, min(len(t), r.fits + 40) + 1))
        else:
            assert r.fits == max([0, *np.flatnonzero(counts <= 512) + 1])


# mixing


def test_mixing_edges(spark, edge, empty):
    rows = mixing.copies(edge).collect()
    assert len(rows) == len(edge_rows()) and all(r.n_copies <= 3 for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    assert mixing.copies(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(edge).columns == edge.columns
    assert mixing.mixed(edge).count() == sum(r.n_copies for r in rows)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
@settings(max_examples=15, deadline=None)
def test_targets_share_all_and_stay_below_their_limits(spark, sizes):
    got = {r.source: r for r in mixing.targets(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size bigint")).collect()}
    assert sum(r.target for r in got.values()) == pytest.approx(sum(sizes))
    left, open_, target = float(sum(sizes)), set(range(len(sizes))), {}
    weight = {i: (5, 2, 1)[i % 3] for i in open_}
    while open_:
        share = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if share * weight[i] > 3 * sizes[i]}
        for i in full or open_:
            target[i] = 3.0 * sizes[i] if full else share * weight[i]
        left -= sum(target[i] for i in full)
        open_ = open_ - full if full else set()
    for i in target:
        assert got[f"s{i}"].target == pytest.approx(target[i], abs=1e-6)


def test_taken_words_come_near_their_targets(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"))
    per = mixing.copies(d).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("t"), F.max("target").alias("target")).collect()
    assert all(abs(r.t - r.target) < 0.05 * r.target for r in per)


def test_sources_of_uneven_documents_come_near_their_targets(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for cell in (mixing.CELL, 20):
        monkeypatch.setattr(mixing, "CELL", cell)
        rows = mixing.copies(docs).collect()
        per = collections.defaultdict(list)
        for r in rows:
            per[r.source].append(r)
        for group in per.values():
            taken, rate = sum(r.size * r.n_copies for r in group), group[0].target / max(1, group[0].source_size)
            assert abs(taken - group[0].target) <= 2 * max(r.size for r in group)
            assert abs(sum(r.n_copies for r in group) - rate * len(group)) <= 1
        assert len({r.n_copies for r in rows}) > 1
        assert mixing.mixed(docs).count() == sum(r.n_copies for r in rows)


def test_each_document_is_drawn_with_the_probability_of_the_fraction(spark):
    """900 sources of equal sizes stand for as many seeds; rates are 1.875, 0.75 and 0.375 in turn."""
    sizes = [1, 1, 2, 3, 3, 5, 8, 13, 21, 34, 55, 200]
    rows = [(100 * i + j, " ".join(["w"] * n), f"s{i:04d}") for i in range(900) for j, n in enumerate(sizes)]
    got = {r.id: r.n_copies for r in mixing.copies(frame(spark, rows)).collect()}
    for turn, rate in enumerate((1.875, 0.75, 0.375)):
        for j in range(len(sizes)):
            n = [got[100 * i + j] for i in range(turn, 900, 3)]
            f = rate % 1
            assert set(n) <= {int(rate), int(rate) + 1} and abs(sum(n) / 300 - rate) < 3.5 * (f * (1 - f) / 300) ** 0.5


def test_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once, again = (sorted((r.id, r.n_copies) for r in mixing.copies(d).collect()) for d in (docs, docs.repartition(7)))
    assert once == again


def test_toxicity_replaces_a_column_of_its_name(spark):
    m = toxicity.train(["good words", "zork zork"] * 20, np.array([0.0, 1.0] * 20), ["en"] * 40)
    d = spark.createDataFrame([("good words", "old", 1)], "text string, Score string, label int")
    assert toxicity.scored(d, m).columns == ["text", "label", "score"]


# html extraction: what stays in and beside an article

STORY = "Some long paragraph text, with a comma, that goes on for more than one hundred characters so that it counts as text."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{STORY}</p></div><p>Short para.</p><div><p>{STORY}</p></div>", f"{STORY} Short para. {STORY}"),
        (f"<div><article><p>{STORY} One</p></article></div><div><article><p>{STORY} Two</p><p>{STORY}</p></article></div>", f"{STORY} One {STORY} Two {STORY}"),
        (f"<article><p>{STORY}</p><p class='disclaimer'><a href=x>Linked words</a></p></article>", f"{STORY} Linked words"),
        (f"<article><p>{STORY}</p><section id='related'><h2>Related work</h2><p>Body.</p></section><div class='widget-text'>Wid.</div><p class='alert'>Al.</p></article>", f"{STORY} Related work Body. Wid. Al."),
        (f"<article><p>{STORY}</p><div class='related'><a href=1>Other page</a></div><div class='ad'>Buy.</div><div class='comments'><p>{STORY}</p></div></article>", STORY),
        (f"<nav>n</nav><h1>Title</h1><div><p>{STORY}</p><p>{STORY}</p></div><footer>f</footer>", f"Title {STORY} {STORY}"),
        (f"<header>site</header><article><header><h1>Head</h1><span>by me</span></header><p>{STORY}</p></article>", f"Head {STORY}"),
        (f"<main><article><p>{STORY}</p></article><div class='related'><a href=1>Other page</a></div></main>", STORY),
    ],
)
def test_text_of_an_article_stays(page, want):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == want


def test_training_sends_only_the_model_to_the_driver(spark, monkeypatch):
    rows = toxic_docs(60)
    docs, labels = frame(spark, [(i, t, "a") for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    few = toxicity.sampled(docs, labels, None, 50, "doc_id", "text", "lang").collect()
    sent, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(self.columns) or real(self))
    got = toxicity.fitted(docs, labels, sample=50)
    want = toxicity.train([r.t for r in few], np.array([r.y for r in few]), [r.l for r in few])
    assert sent == [["model"]]
    assert (got.table == want.table).all() and (got.shifts == want.shifts).all()


@given(st.lists(st.text(alphabet=st.sampled_from("ab'stmdrevlSTL 12é²ª\xad!\n\t_<|☃\x00\x1cÀµ"), max_size=20) | st.text(max_size=8), max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_of_many_texts_equal_the_library(texts):
    path = vocab.place("word_bpe_49k.json")
    want = [e.ids for e in vocab.library(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in vocab.word_ids(path).many(texts)] == want


def test_latin_texts_are_encoded_together(monkeypatch):
    """No text below U+0100 is cut into chunks, but for very long ones."""
    words = vocab.WordIds(vocab.place("word_bpe_49k.json"))
    texts = ["it's Été, 12 x", "", "two\nlines", "we'll  'reside'", "ü" * 50] * 3
    want = [words.ids(t) for t in texts]
    monkeypatch.setattr(vocab, "AT_ONCE", 40)
    assert words.many(texts) == want
    monkeypatch.setattr(words, "ids", None)
    assert words.many(texts[:4]) == want[:4]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A word that none of the 1500 toxic rows of the least hashes has, in parts whose order doesn't matter."""
    monkeypatch.setattr(toxicity, "PART", 1500, raising=False)
    words = [f"w{i}" for i in range(60)]
    rng = np.random.default_rng(5)
    ids = spark.range(5000).withColumn("h", F.xxhash64("id")).orderBy("h").collect()
    toxic = [r.id for r in ids if r.id % 2]
    bad = dict.fromkeys(toxic[:1500], "zork") | dict.fromkeys(toxic[1500:], "blick")
    rows = [(r.id, " ".join([*rng.choice(words, 8), bad.get(r.id, "w0"), *rng.choice(words, 3)]), "en") for r in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r.id, r.id % 2) for r in ids], "doc_id long, toxic int")
    m = toxicity.fitted(docs, labels)
    b, short, first = toxicity.features(pa.array([f"w1 w2 {w} w3 w4 w5" for w in ("zork", "blick", "w7", "w9")]))
    got = m.scores(m.logits(m.pooled(b, first)), m.languages_of(short, first)) >= toxicity.CUT
    assert got.tolist() == [True, True, False, False]
    again = toxicity.fitted(docs.repartition(7), labels.repartition(3))
    assert all((p == q).all() for p, q in zip([m.table, m.shifts, m.by_language, *m.dense()], [again.table, again.shifts, again.by_language, *again.dense()], strict=True)) and m.bias == again.bias


def test_toxicity_thresholds_of_counts():
    rng = np.random.default_rng(2)
    y, z = rng.integers(0, 2, 400).astype(float), rng.integers(-40, 40, 400) / 8
    every = np.array(sorted({(a, b) for a, b in zip(z, y, strict=True)}))
    n = np.array([((z == a) & (y == b)).sum() for a, b in every])
    cut = toxicity.best_threshold(every[:, 0], every[:, 1], None, n)
    errors = lambda t: ((z > t) != (y == 1)).sum()
    assert errors(cut) == min(errors(t) for t in np.arange(-6, 6, 1 / 16))
