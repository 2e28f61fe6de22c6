"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one sets three bits per text hash within one block of 32768 bits and keeps, of
the filter, only the bits that were set at least twice.  Pass two probes that
filter: a row whose bits were all set twice may be repeated, every other
row is certainly alone and passes straight through.  Only the possibly repeated
rows are shuffled by their SHA-256 and grouped exactly, so false positives of
the filter (3 % of the single texts) cost time and never change the result.

The filter grows with the table, eight bits a text.  It is cut into ranges of blocks that
each fit into a broadcast of FILTER_BYTES (some 65 million texts).  The rows are written once
by range, without a shuffle, and the ranges are probed one after the other, each by a job of its own that ends
before the next begins: at any size the driver holds the part of one range.

Texts are equal when they are identical without white space (blank and
U+0009-U+000D).  Of equal texts the one with the most code points stays, then
the smallest id (null ids last), then any one of the remaining identical rows.
A null text counts as empty; empty texts are equal to each other.  Further
columns are carried along and never read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACES, free_name, new_path, stored, text_of

#: Bits of a block of the filter (as many as a bitmap aggregate holds), and of a text in it.
BLOCK_BITS = 1 << 15
BITS_A_TEXT = 3
#: Texts that share a block, on average.
TEXTS_A_BLOCK = BLOCK_BITS // 8
#: Bytes that a block takes in a broadcast relation, at most, and those of a broadcast.
BLOCK_BYTES = BLOCK_BITS // 8 + 128
FILTER_BYTES = BROADCAST_BYTES


class Blocks(NamedTuple):
    """How texts are dealt to the blocks of the filter, and blocks to ranges."""

    blocks: int
    a_range: int

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    def range(self, key: Column) -> Column:
        return F.floor(self.block(key) / self.a_range).cast("int")

    @property
    def ranges(self) -> int:
        return -(-self.blocks // self.a_range)


def blocks_of(n: int) -> Blocks:
    """For ``n`` texts."""
    return Blocks(max(1, -(-n // TEXTS_A_BLOCK)), max(1, FILTER_BYTES // BLOCK_BYTES))


def text_key(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space."""
    return F.sha2(F.regexp_replace(text, SPACES, ""), 256)


def _places(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit(7))
    return [F.shiftrightunsigned(spread, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(BITS_A_TEXT)]


def _is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, (place % 8).cast("int")) == 1


def twice_filter(keys: DataFrame, key: str, dealt: Blocks) -> DataFrame:
    """Stored rows (range, block, twice): the bits of all ``keys`` that are set twice."""
    seen = keys.select(dealt.block(F.col(key)).alias("block"), F.explode(F.array_distinct(F.array(*_places(F.col(key))))).alias("place"))
    twice = seen.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # dealt by block before the bitmaps are made: a bitmap per task and block would be far more than its bits
    maps = twice.repartition("block").groupBy("block").agg(F.bitmap_construct_agg("place").alias("twice"))
    return stored(maps.withColumn("range", F.floor(F.col("block") / dealt.a_range).cast("int")), "exact-filter")


def probe_plan(rows: DataFrame, key: str, part: str, flag: str, dealt: Blocks, maps: DataFrame, i: int) -> DataFrame:
    """The rows of range ``i`` with ``flag``: false only where ``key`` surely is unique.  No row is shuffled."""
    block, twice = (free_name(rows, x) for x in ("bf_block", "bf_twice"))
    held = F.broadcast(maps.where(F.col("range") == i).select(F.col("block").alias(block), F.col("twice").alias(twice)))
    probed = rows.where(F.col(part) == i).withColumn(block, dealt.block(F.col(key))).join(held, block, "left")
    sure = F.lit(True)
    for place in _places(F.col(key)):
        sure = sure & _is_set(F.col(twice), place)
    return probed.withColumn(flag, F.coalesce(sure, F.lit(False))).select(*(c for c in rows.columns if c != part), flag)


def flagged(rows: DataFrame, key: str, part: str, flag: str, dealt: Blocks) -> DataFrame:
    """``rows`` (stored by range in ``part``) with ``flag``, stored; one range after the other."""
    maps = twice_filter(rows.select(key), key, dealt)
    path = new_path(rows.sparkSession, "exact-flagged")
    schema = None
    for i in range(dealt.ranges):
        probed = probe_plan(rows, key, part, flag, dealt, maps, i)
        schema = probed.schema
        probed.write.option("compression", "zstd").parquet(f"{path}/{i}")
    return rows.sparkSession.read.schema(schema).parquet(*(f"{path}/{i}" for i in range(dealt.ranges)))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    text, dealt = text_of(text_col), blocks_of(docs.count())
    thin = docs.select(F.col(id_col).cast("bigint").alias("id"), F.char_length(text).cast("bigint").alias("len"), text_key(text).alias("sha"), F.monotonically_increasing_id().alias("row"))
    thin = stored(thin.withColumn("part", dealt.range(F.col("sha"))), "exact-keys", "part")
    marked = flagged(thin, "sha", "part", "maybe", dealt)
    order = F.struct((-F.col("len")).alias("l"), F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("row").alias("r"))
    # written first: a join of two plain exchanges is one that Spark can split at a hot text
    groups = stored(marked.where("maybe").groupBy("sha").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")), "exact-groups")
    again = marked.where("maybe").join(groups, "sha").select("id", F.col("best.i").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.r")).alias("kept"), "sha")
    alone = marked.where("NOT maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(again).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its repeated texts; all columns pass through."""
    sha, own, part, flag, best = (free_name(docs, x) for x in ("ex_sha", "ex_own", "ex_part", "ex_maybe", "ex_best"))
    text, dealt = text_of(text_col), blocks_of(docs.count())
    order = F.struct((-F.char_length(text)).alias("l"), F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"))
    keyed = docs.withColumns({sha: text_key(text), own: order}).withColumn(part, dealt.range(F.col(sha)))
    marked = flagged(stored(keyed, "exact-texts", part), sha, part, flag, dealt)
    groups = stored(marked.where(flag).groupBy(sha).agg(F.min(own).alias(best)), "exact-groups")
    kept = marked.where(flag).join(groups, sha).where(F.col(own).eqNullSafe(F.col(best))).dropDuplicates([sha])
    return marked.where(~F.col(flag)).select(*docs.columns).unionByName(kept.select(*docs.columns))
