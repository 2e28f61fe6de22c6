"""From documents to packed training sequences.

Five stages, each a thin call of an operator: toxic documents go; of equal texts one
stays; of near-duplicates (five-word shingles, similarity 0.8) one stays; sources are mixed
to their target weights; the tokens are packed into windows.  Every stage takes
(spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns
of ``docs``.  Nulls: a null text counts as empty, a null source is a source of its own, rows
with a null id stay in the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromagrid.llm import exact_dedup, minhash, mixing, packing, toxicity
from chromagrid.llm.common import free_name, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the calibrated cut."""
    score = free_name(docs, "toxicity")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, out_col=score).where(f"{score} < {toxicity.CUT}").drop(score)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs, size=5, num=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the target weights of their sources ask."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a packed window."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_equal), ("near-duplicates", drop_near), ("mixing", mix), ("packing", pack)]

#: SQL can't express the classifier, the tokenizer or the near-duplicate stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
    return docs
