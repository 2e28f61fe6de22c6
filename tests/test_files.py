"""Files in and out: images, catalogs, logs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromagrid.plans import scalars
from chromagrid.sources import catalogs, rasters, sinks
from chromagrid.streaming import logs


def test_png_round_trip(spark, tmp_path):
    px = spark.createDataFrame([(7, y, x, 10 * x, 20 * y, 5 * x + y) for y in range(4) for x in range(6)], "img int, y int, x int, r int, g int, b int")
    for r in sinks.png_files(px).collect():
        (tmp_path / r.name).write_bytes(r.content)
    got = rasters.read_images(spark, str(tmp_path)).select("y", "x", "r", "g", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, px.select("y", "x", "r", "g", "b").collect()))


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    rgb = np.random.default_rng(how).integers(0, 256, (5, 7, 3)).astype(int)
    body, none = b"", np.zeros(3, int)
    for y in range(5):
        body += bytes([how])
        for x in range(7):
            a, b, c = (rgb[y, x - 1] if x else none), (rgb[y - 1, x] if y else none), (rgb[y - 1, x - 1] if x and y else none)
            paeth = [min((abs(i + j - k - v), n, v) for n, v in enumerate((i, j, k)))[2] for i, j, k in zip(a, b, c, strict=True)]
            guess = [none, a, b, (a + b) // 2, np.array(paeth)][how]
            body += ((rgb[y, x] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert (rasters.png_plane(data) == rgb).all()


def test_png_pixels_of_null_and_odd_files(spark):
    assert rasters.png_pixels(spark.createDataFrame([(1, None)], "img int, content binary")).count() == 0
    with pytest.raises(ValueError, match="depth 16"):
        rasters.png_plane(b"\0" * 16 + struct.pack(">IIBBBBB", 1, 1, 16, 2, 0, 0, 0))


def test_large_images_are_sampled_down(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(sinks.png(np.zeros((40, 60, 3), np.uint8)))
    dims = rasters.sizes(rasters.read_images(spark, str(tmp_path), cap=600)).first()
    assert (dims.w, dims.h) == (30, 20)


def test_catalog_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id":"","colors":[{"code":"1","name":"n","rgb":"#0A0B0C"},{"code":"1","name":"m","rgb":"010203"},{"code":"2","rgb":"zz"}]}')
    (tmp_path / "bad.json").write_text("{")
    cats = catalogs.catalogs(catalogs.documents(spark, str(tmp_path)))
    assert [tuple(r) for r in catalogs.colors(cats).collect()] == [("ONE", "1", "m", 1, 2, 3)]
    assert [r.brand for r in catalogs.brands(cats.where("false")).collect()] == ["DMC"]


def test_log_stream(spark, tmp_path, sf_dir):
    src = tmp_path / "in"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").limit(20)
    events = e.select("ts", F.when(F.col("event_id") % 2 == 0, "WARN").otherwise("DEBUG").alias("level"), F.col("event_type").alias("category"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("session"), F.create_map(F.lit("k"), F.lit("v")).alias("data"))
    events.write.parquet(str(src))
    q = logs.log_sink(spark.readStream.schema(events.schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == events.where("level = 'WARN'").count()


def test_image_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(sinks.png(np.zeros((2, 2, 3), np.uint8)))
    q = logs.image_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("images").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("images").count() == 1


def test_plans_stay_in_the_jvm_and_prune(spark, sf_dir):
    plan = scalars.QUERIES["p20_p21_p22_p25_p35_tones"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan
