"""The pipeline's stages against plain versions on a small table."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from chromagrid.llm import packing, toxicity
from chromagrid.llm.common import stored


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == cols
        seen.append(docs.cache())
    toxic, equal, near, mixed = ([(r.doc_id, r.text or "", r.source) for r in d.collect()] for d in seen)
    groups = collections.defaultdict(list)
    for i, t, _ in toxic:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    assert sorted(i for i, *_ in equal) == sorted(min(g)[1] for g in groups.values())
    assert {i for i, *_ in near} <= {i for i, *_ in equal} and {i for i, *_ in mixed} <= {i for i, *_ in near}
    assert max(collections.Counter(i for i, *_ in mixed).values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], sf_dir)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.WINDOW


def test_toxic_labels_mostly_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    toxic, clean = [i for i, y in labels.items() if y == 1], [i for i, y in labels.items() if y == 0]
    assert sum(i not in left for i in toxic) > 0.7 * len(toxic)
    assert sum(i in left for i in clean) > 0.97 * len(clean)
    assert toxicity.CUT == 0.7


def test_run_on_null_empty_and_repeated_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    long = " ".join(f"w{i % 700}" for i in range(20_000))
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, "one text of some words", "en", None, 22), (3, "one text of some words", "en", None, 22), (None, "another text of other words", None, "a", 27), (4, long, "en", "b", len(long)), (5, long + " more", "en", "b", len(long) + 5), (6, "last one", "de", "c", 8)]
    labels = spark.createDataFrame([(2, 0, 0), (6, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for name, held in (("edge", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(held, schema).write.parquet(f"{sf}/documents.parquet")
        labels.where("true" if held else "false").write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        seen = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf), "test-edge")
            assert docs.columns == schema.replace(",", "").split()[::2]
            seen.append(docs.collect())
        if held:
            assert len(seen[1]) == 6 - (len(rows) - len(seen[0])) and sum(r.doc_id == 3 for r in seen[1]) == 1
            assert [r.doc_id for r in seen[2] if r.doc_id in (4, 5)] == [4] and any(r.doc_id is None for r in seen[2])
        got = corpus_pipeline.run(spark, sf).collect()
        assert (len(got) > 0) == bool(held)
        assert {r.doc_id for r in got} == {r.doc_id for r in (seen[3])}
