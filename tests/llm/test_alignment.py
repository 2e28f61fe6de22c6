"""Token alignment against the two libraries, occurrence by occurrence."""

import collections
import hashlib

import pytest

from chromagrid.llm import alignment, vocab


def plain(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, to_byte = Tokenizer.from_file(vocab.place("byte_bpe_50k.json")), vocab.byte_alphabet()
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=vocab.place("piece_bpe_32k.model"))

    def spans(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((at, at + len(raw), i))
            at += len(raw)
        return out

    docs, held = [], collections.defaultdict(set)
    for n, text in enumerate(texts):
        raw = b" " + (text or "").encode()
        e = a_side.encode(" " + (text or ""), add_special_tokens=False)
        ids = b_side.encode(text or "")
        pieces = [b_side.id_to_piece(i) for i in ids]
        ta = [(i, bytes(to_byte[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        tb = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids, pieces, strict=True)]
        if not text or b"".join(x for _, x in ta) != raw or b"".join(x for _, x in tb) != raw:
            docs.append(None)
            continue
        sa, sb = spans(ta), spans(tb)
        links, j = [], 0
        for lo, hi, i in sa:
            while sb[j][1] <= lo:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < hi:
                links.append((i, sb[k][2]))
                k += 1
        cuts = sorted({x[1] for x in sa} & {x[1] for x in sb})
        inside = lambda side, lo, hi: ",".join(str(i) for s, e, i in side if lo <= s and e <= hi)
        groups = [f"{inside(sa, lo, hi)}|{inside(sb, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)] if len(raw) < 20_000 else None
        docs.append((len(sa), len(sb), len(cuts), links, groups))
        for x in set(links):
            held[x].add(n)
    count = {x: len(v) for x, v in held.items()}
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d in docs:
        sha = None if d is None or d[4] is None else hashlib.sha256(";".join(d[4]).encode()).hexdigest()
        out.append((0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[x] == best[x[0]] for x in d[3]), sum(count[x] for x in d[3]), sha))
    return out


def same(got, want):
    return got[:6] == want[:6] and want[6] in (None, got[6])


@pytest.mark.parametrize("docs_a_block", [1 << 16, 7])
def test_documents_equal_the_libraries(spark, sf_dir, docs_a_block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_DOCS", docs_a_block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(spark.createDataFrame(rows, docs.schema)).collect()}
    for r, want in zip(rows, plain([r.text for r in rows]), strict=True):
        assert same(got[r.doc_id], want)


def test_odd_texts(spark):
    texts = [None, "", " ", "a▁b", "x", "x", "<|endoftext|> and </s> <0x41>", "ünï ☃ 漢字 \x1c odd\n\n  two", "  lead", "nul \x00 here", "é ﬁ", "wort " * 3000, "\U0001f600\U0001f601"]
    rows = [(None if i == 4 else i, t, "k", 1) for i, t in enumerate(texts)] + [(5, "x", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, block int")
    got = sorted((tuple(r) for r in alignment.aligned(docs).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, plain([t for _, t, *_ in rows]), strict=True)), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(same(g[1:], w[1:]) for g, w in zip(got, want, strict=True))
    assert next(g for g in got if g[0] == 3)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert next(g for g in got if g[0] == 8)[1] > 0


def test_no_documents(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_links_of_a_group():
    p = alignment.pair(vocab.place("byte_bpe_50k.json"), vocab.place("piece_bpe_32k.model"))
    a, b = p.tokens("hyperbolic zyxwvut")
    pairs = p.links(a, b)
    assert pairs[0] == (a[0], b[0]) and pairs[-1] == (a[-1], b[-1]) and max(len(a), len(b)) <= len(pairs) < len(a) + len(b)


def test_numbers_are_packed():
    values = [0, 1, 255, 256, 70_000, 2**31]
    assert alignment.unpacked(alignment.packed(values)).tolist() == values and alignment.unpacked(alignment.packed([])).tolist() == []


def test_cuts_are_where_both_sides_end(monkeypatch):
    """Found without a sort."""
    p = alignment.pair(vocab.place("byte_bpe_50k.json"), vocab.place("piece_bpe_32k.model"))
    a, b = p.tokens("hyperbolic zyxwvut, ünï 漢字 and and")
    ends = [[sum(size[x] for x in side[: i + 1]) for i in range(len(side))] for side, size in ((a, p.a_size), (b, p.b_size))]
    both = sorted(set(ends[0]) & set(ends[1]))
    monkeypatch.setattr(alignment.np, "intersect1d", None)
    upto_a, upto_b = p.cuts(a, b)
    assert [ends[0][i - 1] for i in upto_a] == both == [ends[1][j - 1] for j in upto_b]
