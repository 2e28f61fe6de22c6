"""Mixing sources to target weights.

The words of each source are summed; a target number of words for each source
follows from the weights, never above ``most`` times what the source holds, with
the excess shared again by weight until no source is above its limit.  A document
of a source with rate r = target / size is emitted floor(r) times and once more with the
probability r - floor(r) = f.  The draw is hashed from seed, source and id, so any rerun draws the same copies, and it is systematic:
the documents of a source are ordered by size class (four to a doubling) and hash, and of the first k
of them floor(u + k f) are taken, u being uniform by the source's hash.  Each document's probability is f, as with
independent draws, but every class gives its share, so a source misses its target by few of its documents and not by
sqrt(n) of them.

The order is never made: documents are counted by cell (source, class, range of hashes), a cell knows how many it gives from
the counts before it, and these are its documents of the least hashes.  A cell holds CELL documents on average, at most.

A null text has no words, a null source is a source of its own (last in order),
a null id draws like the string of that name.  A source without words has rate 0.
Rows with equal ids and sizes draw alike, so at the border of a cell's share they are all taken.  Further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, free_name, stored, text_of

WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also target, one row per source.

    Sources take ``weights`` in turn by code point order, null last.  Sorted by
    limit / weight, the sources before some place stand at their limit and share
    out the rest by weight; the first place where the share fits is the answer."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("lim", (F.col("source_size") * most).cast("double"))
    every = Window.partitionBy()
    by_limit = Window.orderBy(F.col("lim") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("lim").over(before), F.lit(0.0))
    share = ranked.withColumns({"level": left / F.sum("w").over(after), "place": F.row_number().over(by_limit)})
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("lim"), F.struct("place", "level"))).over(every)["level"]
    return share.withColumn("top", level).select("source", "source_size", F.coalesce(F.least(F.col("lim"), F.col("top") * F.col("w")), F.lit(0.0)).alias("target"))


#: Bytes that one row of the table of sources takes in a broadcast relation, about.
SOURCE_ROW_BYTES = 256


def proven_small(per: DataFrame) -> bool:
    """Whether the rows of a stored table of sources and its longest name fit into a broadcast."""
    n, longest = per.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("source")), F.lit(0))).first()
    return n * (SOURCE_ROW_BYTES + longest) <= BROADCAST_BYTES


#: Documents of a cell, on average over all cells of a class.
CELL = 1 << 20
#: Hex digits of a hash that make a draw.
DIGITS = 13


def size_class(size: Column) -> Column:
    """Text that orders sizes by their highest bit and the two below it."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 2), 2, "0"))


def hashed(seed: str, *parts: Column) -> Column:
    """Uniform among 0 .. 16 ** DIGITS - 1."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")


def with_cells(docs: DataFrame, n: int, seed: str, id_col: Column, source: Column, size: Column, names: dict[str, str]) -> DataFrame:
    """``docs`` with size, draw, class and range of hashes under ``names``."""
    ranges = 1 << max(0, -(-n // CELL) - 1).bit_length()
    out = docs.withColumns({names["size"]: size, names["draw"]: hashed(seed, id_col)})
    return out.withColumns({names["kind"]: size_class(F.col(names["size"])), names["range"]: F.floor(F.col(names["draw"]) / (16**DIGITS // ranges)).cast("int")})


def cells(thin: DataFrame, seed: str, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, kind, range, source_size, target, times, cut), stored, from rows of (source, size, draw, kind, range): a
    document of a cell is taken times times, and once more if its draw is ``cut`` or less.  Broadcast if proven small, so that no document moves."""
    sums = stored(thin.groupBy("source", "kind", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-cells")
    per = stored(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("times", F.floor(rate)).withColumn("f", rate - F.col("times")).withColumn("u", hashed(f"{seed}:source", F.col("source")) / F.lit(float(16**DIGITS))).withColumnRenamed("source", "s")
    near = F.broadcast if proven_small(per.withColumnRenamed("s", "source")) else (lambda df: df)
    before = Window.partitionBy("source").orderBy("kind", "range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("k", F.coalesce(F.sum("n").over(before), F.lit(0))).join(near(per), F.col("source").eqNullSafe(F.col("s")))
    upto = lambda k: F.floor(F.col("u") + k * F.col("f"))
    placed = stored(placed.select("source", "kind", "range", "source_size", "target", "times", (upto(F.col("k") + F.col("n")) - upto(F.col("k"))).cast("int").alias("m")), "mix-shares")
    draws = thin.groupBy("source", "kind", "range").agg(F.sort_array(F.collect_list("draw")).alias("draws")).select(F.col("source").alias("s"), F.col("kind").alias("q"), F.col("range").alias("v"), "draws")
    small = proven_small(placed)
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("kind") == F.col("q")) & (F.col("range") == F.col("v"))
    cut = F.when(F.col("m") > 0, F.element_at("draws", F.greatest(F.col("m"), F.lit(1)))).otherwise(F.lit(-1)).cast("bigint")
    out = stored(draws.join(F.broadcast(placed) if small else placed, same).select("source", "kind", "range", "source_size", "target", "times", cut.alias("cut")), "mix-cuts")
    return F.broadcast(out) if small else out


NAMES = {c: c for c in ("size", "draw", "kind", "range")}


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, source, size, source_size, target, n_copies) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    thin = stored(with_cells(rows, docs.count(), seed, F.col("id"), F.col("source"), word_count(text_of("text")), NAMES).drop("text"), "mix-sizes")
    per = cells(thin, seed, weights, most).select(*(F.col(c).alias(f"c_{c}") for c in ("source", "kind", "range")), "source_size", "target", "times", "cut")
    joined = thin.join(per, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("kind") == F.col("c_kind")) & (F.col("range") == F.col("c_range")), "left")
    return joined.select("id", "source", "size", "source_size", "target", (F.col("times") + (F.col("draw") <= F.col("cut")).cast("bigint")).alias("n_copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row repeated as the mix asks; columns unchanged."""
    names = {c: free_name(docs, f"mix_{c}") for c in NAMES}
    own = with_cells(docs, docs.count(), seed, F.col(id_col), F.col(source_col), word_count(text_of(text_col)), names)
    thin = stored(own.select(F.col(source_col).alias("source"), *(F.col(names[c]).alias(c) for c in NAMES)), "mix-sizes")
    per = cells(thin, seed, weights, most).select(*(F.col(c).alias(free_name(docs, f"mix_of_{c}")) for c in ("source", "kind", "range", "times", "cut")))
    source, kind, hashes, times, cut = per.columns
    joined = own.join(per, F.col(source_col).eqNullSafe(F.col(source)) & (F.col(names["kind"]) == F.col(kind)) & (F.col(names["range"]) == F.col(hashes)), "left")
    n = F.col(times) + (F.col(names["draw"]) <= F.col(cut)).cast("bigint")
    return joined.withColumn(free_name(joined, "mix_n"), F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*docs.columns)
