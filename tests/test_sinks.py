"""Raster files: committed together, read by bands, scaled down to a cap."""

import io
import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromagrid.sources import files, rasters


def frame(spark, planes):
    rows = [(i, y, x, *map(int, p[y, x])) for i, p in planes.items() for y, x in np.ndindex(p.shape[:2])]
    return spark.createDataFrame(rows, "img int, y int, x int, r int, g int, b int")


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(2)
    return {i: rng.integers(0, 256, (*rng.integers(1, 30, 2), 3)) for i in range(6)}


def names(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith((".", "_")))


def test_images_come_back_from_files(spark, planes, tmp_path, monkeypatch):
    files.write_files(frame(spark, planes), str(tmp_path / "a"), prefix="p")
    assert files.listed(str(tmp_path / "a")) == names(tmp_path / "a") == [f"p{i}.png" for i in range(6)]
    got = {n: np.full((*p.shape[:2], 3), -1) for n, p in planes.items()}
    for r in files.scan_png(spark, f"file://{tmp_path}/a").collect():
        assert (r.h, r.w) == planes[int(r.file[1])].shape[:2]
        got[int(r.file[1])][r.y, r.x] = r.r, r.g, r.b
    assert all((got[n] == p).all() for n, p in planes.items())
    assert files.scan_png(spark, str(tmp_path / "a" / "p3.png")).count() == planes[3].shape[0] * planes[3].shape[1]


def test_a_job_that_fails_leaves_no_file(spark, planes, tmp_path):
    px = frame(spark, planes)
    folder = tmp_path / "b"
    files.write_files(px.where("img < 2"), str(folder), prefix="p")
    before = {n: (folder / n).read_bytes() for n in names(folder)}
    lacking = px.where("NOT (img = 4 AND y = 0 AND x = 0)").unionByName(px.where("img = 4").limit(1).selectExpr("img", "y + 900 AS y", "x", "r", "g", "b"))
    with pytest.raises(Exception, match="lacks"):
        files.write_files(lacking, str(folder), prefix="p")
    assert {n: (folder / n).read_bytes() for n in names(folder)} == before
    assert files.listed(str(folder)) == ["p0.png", "p1.png"] and not any(f.startswith("_pending") for f in os.listdir(folder))


def test_overwriting_and_adding(spark, planes, tmp_path):
    px, folder = frame(spark, planes), str(tmp_path / "c")
    files.write_files(px.where("img < 3"), folder)
    files.write_files(px.where("img = 5"), folder, overwrite=False)
    assert files.listed(folder) == ["0.png", "1.png", "2.png", "5.png"]
    files.write_files(px.where("img = 1"), folder)
    assert files.listed(folder) == names(folder) == ["1.png"]
    files.write_files(px.where("false"), folder)
    assert files.listed(folder) == [] and files.scan_png(spark, folder).count() == 0


def test_index_files_are_clamped(spark, tmp_path):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, -1), (1, 1, 0, 1), (1, 1, 1, 2)], "img int, y int, x int, idx int")
    files.write_files(px, str(tmp_path / "d"), "index", k=3)
    assert (tmp_path / "d" / "1.bin").read_bytes() == b"\2\0\1\2"


@given(st.integers(1, 6), st.integers(1, 6), st.sampled_from([(0, 1), (2, 3), (4, 2), (6, 4)]), st.integers(0, 2**31))
@settings(max_examples=80, deadline=None)
def test_lines_of_every_filter(h, w, kind, seed):
    code, wide = kind
    rng = np.random.default_rng(seed)
    want = rng.integers(0, 256, (h, w * wide))
    raw, up = b"", np.zeros(w * wide, int)
    for row in want:
        how = int(rng.integers(0, 5))
        left, corner = np.concatenate([np.zeros(wide, int), row[:-wide]])[: len(row)], np.concatenate([np.zeros(wide, int), up[:-wide]])[: len(row)]
        p = left + up - corner
        far = np.abs(np.stack([p - left, p - up, p - corner]))
        guess = [0 * row, left, up, (left + up) // 2, np.choose(far.argmin(axis=0), [left, up, corner])][how]
        raw += bytes([how]) + bytes(((row - guess) & 255).tolist())
        up = row
    packed = zlib.compress(raw)
    cut = len(packed) // 2
    data = files.SIGNATURE + files.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, code, 0, 0, 0)) + files.chunk(b"IDAT", packed[:cut]) + files.chunk(b"IDAT", packed[cut:]) + files.chunk(b"IEND", b"")
    got = [line for _, _, line in files.png_lines(io.BytesIO(data))]
    cells = want.reshape(h, w, wide)
    assert (np.stack(got) == (cells[..., :3] if wide > 2 else np.repeat(cells[..., :1], 3, axis=2))).all()


def test_what_is_no_such_png_is_an_error():
    with pytest.raises(ValueError, match="no PNG"):
        list(files.png_lines(io.BytesIO(b"GIF89a..")))
    head = files.SIGNATURE + files.chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 16, 2, 0, 0, 0))
    with pytest.raises(ValueError, match="depth 16"):
        list(files.png_lines(io.BytesIO(head)))


def test_scaling_takes_the_square_root_of_the_cap(spark):
    rng = np.random.default_rng(4)
    plane = rng.integers(0, 256, (23, 31))
    px = spark.createDataFrame([(7, 31, 23, y, x, int(plane[y, x]), 0, 255) for y in range(23) for x in range(31)] + [(8, 1, 1, 0, 0, 9, 9, 9)], "img int, w int, h int, y int, x int, r int, g int, b int")
    rows = rasters.area_fitted(px, 200).collect()
    w, h = int(31 * (200 / 713) ** 0.5), int(23 * (200 / 713) ** 0.5)
    assert {(r.w, r.h) for r in rows if r.img == 7} == {(w, h)} and sum(r.img == 7 for r in rows) == w * h
    assert [(r.w, r.h, r.r) for r in rows if r.img == 8] == [(1, 1, 9)]
    cover = lambda n, m: np.array([[max(0.0, min((t + 1) / m, (x + 1) / n) - max(t / m, x / n)) for x in range(n)] for t in range(m)])
    want = cover(23, h) @ plane @ cover(31, w).T * w * h
    assert all(abs(r.r - want[r.y, r.x]) <= 0.5 + 1e-9 and r.b == 255 for r in rows if r.img == 7)
