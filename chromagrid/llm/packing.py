"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens (order: id, then arrival), cut into
quanta.  At virtual time v a source of target weight w has earned w * v tokens; its
deficit is what it earned and wasn't yet sent, and it is served a quantum as soon as the
deficit reaches half of one.  So quantum k of a source is due at (k + 1/2) * quantum / w,
deficits carry over from window to window and from partition to partition, and the order
of all quanta is a sort by due time.  The stream of quanta is cut into full windows, so
that only the last window of all is padded.  Without given targets a source weighs what
it holds, and then all queues end together.

Running sums are taken in range partitions with one total per partition, never in one
task.  A null text is a document of its end token alone; a null source is a source; rows
with equal or null ids are documents of their own.  Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import mapped, partitions, stored

WINDOW = 4096
QUANTUM = 256
END = 2
#: Quanta that one row expands to at a time.
BLOCK = 10_000


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, end: int = END) -> DataFrame:
    """row, id, source, n, ids (little-endian unsigned 16-bit) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = vocab.word_ids(path), end.to_bytes(2, "little")
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            ids = [x + tail for x in words.many([t or "" for t in batch.column(3).to_pylist()])]
            words.trim()
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "id", "source", "n", "ids"])

    cols = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return mapped(cols, run, "row bigint, id bigint, source string, n bigint, ids binary")


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over all rows before it in ``order``.

    Rows are dealt out by ranges of ``order`` and summed within; the sums of the
    partitions (one number each) are then added."""
    at = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(v) + total
            yield pa.record_batch([*b.columns, pa.array(np.full(len(v), part), pa.int32()), pa.array(sums - v, pa.int64())], names=[*b.schema.names, "run_part", "run_local"])
            total = int(sums[-1]) if len(v) else total

    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", run_part int, run_local bigint"
    ranges = df.repartitionByRange(partitions(df.sparkSession), *[F.col(c).asc_nulls_last() for c in order])
    local = ranges.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order]).mapInArrow(run, schema)
    local = stored(local, name)
    # one row per partition
    totals = sorted(local.groupBy("run_part").agg(F.sum(value).alias("s")).collect())
    base, sums = 0, []
    for part, s in totals:
        sums.append((part, base))
        base += s
    bases = df.sparkSession.createDataFrame(sums, "run_part int, run_base bigint")
    return local.join(F.broadcast(bases), "run_part").withColumn("before", F.col("run_local") + F.col("run_base")).drop("run_part", "run_local", "run_base")


def layout(docs: DataFrame, weights: DataFrame | None, window: int, quantum: int) -> DataFrame:
    """(row, source, id, n) -> (row, pieces): of each document, array of (start, length, at)
    with ``at`` the place in the packed stream.  weights: (source, weight)."""
    queue = running(docs, ["source", "id", "row"], "n", "pack-queue")
    per = queue.groupBy("source").agg(F.min("before").alias("base"), F.sum("n").alias("held"))
    per = per.join(weights.select(F.col("source").alias("s"), F.col("weight").cast("double")), per["source"].eqNullSafe(F.col("s")), "left").drop("s") if weights is not None else per.withColumn("weight", F.col("held").cast("double"))
    per = per.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    per = stored(per.select("source", "base", "held", "weight"), "pack-sources")
    q = F.lit(quantum)
    blocks = per.withColumn("n_quanta", F.ceil(F.col("held") / q).cast("bigint")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_quanta") - 1) / BLOCK).cast("bigint"))))
    blocks = blocks.repartition(partitions(docs.sparkSession), "block", "base")
    quanta = blocks.withColumn("k", F.explode(F.sequence(F.col("block") * BLOCK, F.least(F.col("n_quanta"), (F.col("block") + 1) * BLOCK) - 1)))
    # sources without weight come after all others
    due = F.when(F.col("weight") > 0, (F.col("k") + 0.5) * q / F.col("weight")).otherwise(F.lit(float("inf")))
    quanta = quanta.select("base", "k", due.alias("due"), F.least(q.cast("bigint"), F.col("held") - F.col("k") * q).alias("size"))
    placed = running(quanta, ["due", "base", "k"], "size", "pack-quanta").select("base", "k", F.col("before").alias("sent"))
    mine = queue.join(per.select(F.col("source").alias("s"), "base"), queue["source"].eqNullSafe(F.col("s"))).withColumn("a", F.col("before") - F.col("base"))
    cut = mine.select("row", "base", "a", "n", F.explode(F.sequence(F.floor(F.col("a") / q).cast("bigint"), F.floor((F.col("a") + F.col("n") - 1) / q).cast("bigint"))).alias("k"))
    cut = cut.join(placed, ["base", "k"])
    lo, hi = F.greatest(F.col("a"), F.col("k") * q), F.least(F.col("a") + F.col("n"), (F.col("k") + 1) * q)
    pieces = cut.select("row", (lo - F.col("a")).alias("start"), (hi - lo).alias("length"), (F.col("sent") + lo - F.col("k") * q).alias("at"))
    return pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "at"))).alias("pieces"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, window: int = WINDOW, quantum: int = QUANTUM, path: str | None = None) -> DataFrame:
    """One row per piece: id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    path = path or vocab.place("word_bpe_49k.json")
    tokens = stored(tokenized(docs, id_col, text_col, source_col, path), "pack-tokens")
    where = layout(tokens.select("row", "source", "id", "n"), weights, window, quantum)
    both = tokens.select("row", "id", "source", "ids").join(where, "row").select("id", "source", "ids", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            lists = b.column(3)
            flat, offs = lists.flatten(), lists.offsets.to_numpy()
            offs = offs - offs[0]
            start, length, at = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i, ids in enumerate(b.column(2)):
                wide = memoryview(np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")).cast("B")
                n, merged = len(wide) // 4, []
                for j in range(offs[i], offs[i + 1]):
                    if merged and merged[-1][2] + merged[-1][1] == at[j]:
                        merged[-1][1] += int(length[j])
                    else:
                        merged.append([int(start[j]), int(length[j]), int(at[j])])
                for s, ln, p in merged:
                    while ln:
                        here = min(ln, window - p % window)
                        rows.append((i, s, here, zlib.crc32(wide[4 * s : 4 * (s + here)]), n, p // window, p % window))
                        s, ln, p = s + here, ln - here, p + here
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            pick = pa.array(cols[0], pa.int64())
            yield pa.record_batch([b.column(0).take(pick), b.column(1).take(pick), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = mapped(both, run, "id bigint, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
