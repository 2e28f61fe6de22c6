"""SimHash fingerprints of documents, in DataFrame operations only.

Terms are the runs of three consecutive words (the last two are shorter runs), weighted by
occurrence times the code points of their first word.  Each term's 64-bit hash votes
with its weight on 64 signed bits; a bit of the fingerprint is set if the votes for it
outweigh those against.  Votes for bits j and j + 32 are summed in the two halves of one
64-bit number: the weights of a text sum to at most its length, so a half never overflows.

``neighbours`` finds all fingerprints within a Hamming radius r by permuted block tables:
64 bits are cut into blocks, of which at least (blocks - r) agree between two such
fingerprints; one table per choice of that many blocks holds them first, and equal
leading blocks make candidates, which are verified on all bits.  Equal fingerprints are
one class; only classes are compared.  More blocks make more tables with longer leading
keys, hence fewer candidates that aren't neighbours.  The classes of one leading key are cut into
groups of about GROUP, each class meets each group as one array, and a pair counts in the first
table only in which both stand together: no candidate pair is ever a row, and no key's classes
come together in one task.

A null text is empty; a text without words has the fingerprint of no votes (all zero).
Words are lower-cased and taken between blanks and U+0009-U+000D.  Rows with a null id
have no place in the order of documents: their edited text and what follows from it is null.
Repeated rows (id and text) give a row each; their votes add up, which changes no sign (halves
hold 2**32 code points of rows with one id and text).  Of several texts of one id, the one that is largest lends
its head to the document before, and the least fingerprint counts as the next one's.  Further
columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACES, partitions, stored, text_of

LANES = 0x0000000100000001
RADIUS, BLOCKS = 3, 6
#: Classes of a leading key that meet a class at a time, about.
GROUP = 256


def terms(words: Column) -> Column:
    """Array of (hash, weight) of the terms of a text, from its words."""

    def term(w: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), F.char_length(w).cast("bigint").alias("w"))

    return F.transform(words, term)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys + votes summed: one row per distinct ``keys`` with its fingerprint ``fp`` and its number of ``copies``."""
    split = texts.select(*keys, F.split(F.lower(F.col(text_col)), SPACES).alias("sh_words"))
    each = split.select(*keys, F.size("sh_words").alias("sh_n"), F.explode_outer(terms(F.col("sh_words"))).alias("t")).select(*keys, "sh_n", F.col("t.h").alias("h"), F.when(F.col("t.w") > 0, F.col("t.w")).otherwise(F.lit(0)).cast("bigint").alias("w"))
    h = F.coalesce(F.col("h"), F.lit(0).cast("bigint"))
    lanes = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{j}") for j in range(32)]
    votes = each.groupBy(*keys).agg(F.sum("w").alias("total"), (F.count(F.lit(1)) / F.max("sh_n")).cast("bigint").alias("copies"), *lanes)
    one, half = F.lit(1).cast("bigint"), F.lit(0xFFFFFFFF)
    fp = F.lit(0).cast("bigint")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(half), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        for bit, n in ((j, low), (j + 32, high)):
            fp = fp.bitwiseOR(F.when(2 * n > F.col("total"), F.call_function("shiftleft", one, F.lit(bit))).otherwise(F.lit(0).cast("bigint")))
    return votes.select(*keys, "copies", fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return (F.lit(64) - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def next_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, next): the next larger id, after the largest the smallest.  Ids are dealt
    out by ranges; each range also learns the first id of the range after it."""
    ids = stored(docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().repartitionByRange(partitions(docs.sparkSession), "id").select("id", F.spark_partition_id().alias("part")), "simhash-ids")
    # one row per range
    firsts = ids.groupBy("part").agg(F.min("id").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"))
    within = Window.partitionBy("part").orderBy("id")
    return ids.withColumn("next", F.lead("id").over(within)).join(F.broadcast(firsts), "part").select("id", F.coalesce("next", "after").alias("next"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, next): the last quarter of each text is replaced by as many
    first code points of the next document, or all it has."""
    every = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    base, n = every.where("id IS NOT NULL"), F.char_length("text").cast("bigint").alias("n_chars")
    rest = every.where("id IS NULL").select("id", n, "text", F.lit(None).cast("string").alias("edited"), F.col("id").alias("next"))
    order = next_ids(docs, id_col)
    lengths = docs.select(F.col(id_col).alias("id"), F.floor(F.char_length(text_of(text_col)) / 4).cast("int").alias("quarter")).where("id IS NOT NULL").groupBy("id").agg(F.max("quarter").alias("quarter"))
    wants = order.join(lengths, "id").select(F.col("next").alias("id"), F.col("id").alias("before"), "quarter")
    heads = base.join(wants, "id").select("before", F.expr("substring(text, 1, quarter)").alias("head"))
    heads = heads.groupBy(F.col("before").alias("id")).agg(F.max("head").alias("head"))
    keep = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))")
    head = F.expr("substring(coalesce(head, ''), 1, cast(floor(char_length(text) / 4) as int))")
    return base.join(heads, "id", "left").select("id", n, "text", F.concat(keep, head).alias("edited")).join(order, "id", "left").unionByName(rest)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near (other
    fingerprints of the table within RADIUS)."""
    both = edited(docs, id_col, text_col)
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    rows = both.select("id", "next", "n_chars", F.xxhash64("text").alias("th"), F.sha2("edited", 256).alias("sha"), kinds.alias("x"))
    rows = rows.select("id", "next", "n_chars", "th", "sha", F.col("x.kind").alias("kind"), F.col("x.t").alias("t")).where("t IS NOT NULL")
    fps = fingerprints(rows, ["id", "next", "n_chars", "th", "sha", "kind"], "t")
    fps = stored(fps.groupBy("id", "next", "n_chars", "th").agg(F.max("sha").alias("sha"), F.max("copies").alias("copies"), F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp")), "simhash-prints")
    after = fps.where("id IS NOT NULL").groupBy(F.col("id").alias("next")).agg(F.min("fp").alias("next_fp"))
    after = stored(after, "simhash-next")
    near = stored(near_counts(fps.select("fp")), "simhash-near")
    out = fps.join(after, "next", "left").join(_small(near, 48), "fp", "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    text = lambda c: F.lpad(F.lower(F.hex(F.col(c))), 16, "0")
    return out.select(F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))


def block_tables(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each choice of (blocks - radius) of the blocks: their (first bit, width)."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(spans, blocks - radius)]


def _key(fp: Column, spans: list[tuple[int, int]]) -> Column:
    key, at = F.lit(0).cast("bigint"), 0
    for first, width in spans:
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        key = key.bitwiseOR(F.call_function("shiftleft", part, F.lit(at)))
        at += width
    return key


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, hinted for a broadcast only if its counted rows prove it small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def meetings(prints: DataFrame, radius: int, blocks: int, fp_col: str) -> DataFrame:
    """(fp, near): for a class and a group of classes with an equal leading key, those within ``radius``
    that meet it in no earlier table."""
    classes = prints.select(F.col(fp_col).alias("fp")).where("fp IS NOT NULL").distinct()
    tables = block_tables(blocks, radius)
    masks = [sum(((1 << width) - 1) << first for first, width in spans) for spans in tables]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    keys = F.array(*[_key(F.col("fp"), s) for s in tables])
    dealt = stored(classes.select("fp", F.posexplode(keys).alias("t", "k")), "simhash-tables")
    many = dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    many = stored(many.select("t", "k", F.ceil(F.col("m") / GROUP).cast("int").alias("groups")), "simhash-keys")
    members = dealt.join(_small(many, 64), ["t", "k"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int"))
    members = stored(members, "simhash-members")
    groups = stored(members.groupBy("t", "k", F.col("own").alias("g")).agg(F.collect_list("fp").alias("others")), "simhash-groups")
    asks = members.select("fp", "t", "k", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))

    def close(other: Column) -> Column:
        differing = F.col("fp").bitwiseXOR(other)
        before = F.exists(F.slice(masks, F.lit(1), F.col("t")), lambda m: differing.bitwiseAND(m) == 0)
        return (differing != 0) & (F.bit_count(differing) <= radius) & ~before

    return asks.join(groups, ["t", "k", "g"]).select("fp", F.filter("others", close).alias("near"))


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, fp_col: str = "fp") -> DataFrame:
    """(a, b, distance), a < b: all pairs of different fingerprints within ``radius``.

    With 6 blocks and radius 3 there are 20 tables, each led by 3 blocks (32 bits)."""
    pairs = meetings(prints, radius, blocks, fp_col).select(F.col("fp").alias("a"), F.explode("near").alias("b")).where("a < b")
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, fp_col: str = "fp", out_col: str = "n_near") -> DataFrame:
    """(fp, n_near) of the fingerprints that have others within ``radius``."""
    met = meetings(prints, radius, blocks, fp_col).select("fp", F.size("near").alias("n")).where("n > 0")
    return met.groupBy(F.col("fp").alias(fp_col)).agg(F.sum("n").cast("bigint").alias(out_col))
