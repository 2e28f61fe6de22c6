"""Raster files as Spark data sources: a scan that yields rows of cells and sinks that commit.

``scan_png`` reads PNG files, a task each, and yields bands of cells: no row holds an image and a task holds two lines of
pixels and a band.  ``write_files`` lets each task stream its images into files under a folder of its own; the driver moves them to
their names only when all tasks have ended well, and writes the list of them last, so readers see all files or none.  What a
lost task or a failed job has left is removed, or is in no list."""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .rasters import sizes

LIST = "_files.json"
#: Cells of a band, about.
BAND = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# scan


def png_lines(source) -> Iterator[tuple[int, int, np.ndarray]]:
    """(width, height, line (w, 3)) for each line of a PNG of 8-bit gray, RGB or either with alpha (dropped), without interlace
    or palette; ``source`` is read in order."""
    if source.read(8) != SIGNATURE:
        raise ValueError("no PNG file")
    unpack, held, w = zlib.decompressobj(), b"", 0
    up = np.zeros(0, np.uint8)
    while head := source.read(8):
        size, tag = struct.unpack(">I4s", head)
        body = source.read(size)
        source.read(4)
        if tag == b"IHDR":
            w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
            wide = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind, 0)
            if depth != 8 or interlace or not wide:
                raise ValueError(f"PNG of depth {depth}, kind {kind}, interlace {interlace}")
            up = np.zeros(w * wide, np.uint8)
        elif tag == b"IDAT":
            held += unpack.decompress(body)
            line = 1 + w * wide
            whole = len(held) // line
            for i in range(whole):
                up = unfiltered(held[i * line], np.frombuffer(held, np.uint8, line - 1, i * line + 1), up, wide)
                cells = up.reshape(w, wide)
                yield w, h, cells[:, :3] if wide > 2 else np.repeat(cells[:, :1], 3, axis=1)
            held = held[whole * line :]


def unfiltered(how: int, line: np.ndarray, up: np.ndarray, wide: int) -> np.ndarray:
    """The bytes of a line from its differences."""
    if how == 0:
        return line.copy()
    if how == 1:
        return line.reshape(-1, wide).cumsum(axis=0, dtype=np.uint8).ravel()
    if how == 2:
        return line + up
    out, above, left, corner = line.tolist(), up.tolist(), [0] * wide, [0] * wide
    for i, (d, b) in enumerate(zip(out, above, strict=True)):
        k = i % wide
        a = left[k]
        if how == 3:
            guess = a + b >> 1
        else:
            c = corner[k]
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
            corner[k] = b
        out[i] = left[k] = d + guess & 255
    return np.array(out, np.uint8)


class PngScan(DataSource):
    """format("png_cells"): option path, a folder (its list of files, or else all its .png files) or a file."""

    @classmethod
    def name(cls) -> str:
        return "png_cells"

    def schema(self) -> str:
        return "file string, w int, h int, y int, x int, r int, g int, b int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PngReader(self.options["path"])


@dataclass
class OneFile(InputPartition):
    path: str


class PngReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, root = _at(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [OneFile(self.path)]
        names = listed(self.path)
        if names is None:
            names = [f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.is_file]
        # Spark wants a partition at least
        return [OneFile(posixpath.join(self.path, n)) for n in sorted(names) if n.endswith(".png")] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = _at(partition.path)
        with store.open_input_stream(path) as source:
            band: list[np.ndarray] = []
            y0 = 0
            for y, (w, h, line) in enumerate(png_lines(source)):
                band.append(line)
                if len(band) * w >= BAND or y == h - 1:
                    yield _cells(posixpath.basename(partition.path), w, h, y0, np.stack(band))
                    band, y0 = [], y + 1


def _cells(name: str, w: int, h: int, y0: int, band: np.ndarray) -> pa.RecordBatch:
    n = band.shape[0] * w
    rgb = band.reshape(n, 3).astype(np.int32)
    at = np.arange(n, dtype=np.int32)
    ints = [np.full(n, w, np.int32), np.full(n, h, np.int32), at // w + y0, at % w, *rgb.T]
    return pa.record_batch([pa.array([name] * n, pa.string()), *(pa.array(v.astype(np.int32)) for v in ints)], names=["file", "w", "h", "y", "x", "r", "g", "b"])


def scan_png(spark: SparkSession, path: str) -> DataFrame:
    """(file, w, h, y, x, r, g, b) of the PNG files under ``path``."""
    spark.dataSource.register(PngScan)
    return spark.read.format("png_cells").option("path", path).load()


# sinks


def chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


class PngFile:
    """A PNG written line by line."""

    suffix = "png"

    def __init__(self, out, row):
        self.out, self.pack, self.line, self.left = out, zlib.compressobj(6), bytearray(b"\0"), row["w"] * row["h"]
        self.w = row["w"]
        out.write(SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", row["w"], row["h"], 8, 2, 0, 0, 0)))

    def add(self, row) -> None:
        self.line += bytes((row["r"], row["g"], row["b"]))
        self.left -= 1
        if len(self.line) == 1 + 3 * self.w:
            if body := self.pack.compress(bytes(self.line)):
                self.out.write(chunk(b"IDAT", body))
            self.line = bytearray(b"\0")

    def close(self) -> None:
        if self.left:
            raise ValueError(f"an image lacks {self.left} cells")
        self.out.write(chunk(b"IDAT", self.pack.flush()) + chunk(b"IEND", b""))
        self.out.close()


class IndexFile:
    """One byte a cell, clamped to 0..255 or to the palette's range."""

    suffix = "bin"

    def __init__(self, out, row):
        self.out, self.most, self.held, self.left = out, min(255, row["k"] - 1), bytearray(), row["w"] * row["h"]

    def add(self, row) -> None:
        self.held.append(min(self.most, max(0, row["idx"])))
        self.left -= 1
        if len(self.held) >= BAND:
            self.out.write(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        if self.left:
            raise ValueError(f"an index map lacks {self.left} cells")
        self.out.write(bytes(self.held))
        self.out.close()


KINDS = {"png": PngFile, "index": IndexFile}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # under which name it lies, and which it gets


class RasterSink(DataSource):
    """format("raster_files"): options path, kind (png or index) and prefix; rows come by image, y and x."""

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RasterWriter(self.options["path"], self.options["kind"], self.options.get("prefix", ""), overwrite)


class RasterWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, prefix: str, overwrite: bool):
        self.path, self.kind, self.prefix, self.overwrite = path, kind, prefix, overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, root = _at(self.path)
        mine = posixpath.join(root, self.pending, uuid.uuid4().hex)
        make, now, file, files = KINDS[self.kind], None, None, []
        try:
            for row in iterator:
                if file is None or row["img"] != now:
                    if file is not None:
                        file.close()
                    if not files:
                        store.create_dir(mine, recursive=True)
                    now, name = row["img"], f"{self.prefix}{row['img']}.{make.suffix}"
                    files.append((f"{mine}/{name}", name))
                    file = make(store.open_output_stream(files[-1][0]), row)
                file.add(row)
            if file is not None:
                file.close()
        except BaseException:
            if files:
                store.delete_dir(mine)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _at(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        names = sorted(name for _, name in files)
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an image came in two parts: repartition by img first")
        old = listed(self.path) or []
        for at, name in files:
            store.move(at, posixpath.join(root, name))
        keep = names if self.overwrite else sorted({*old, *names})
        draft = posixpath.join(root, f"{self.pending}.json")
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(keep).encode())
        store.move(draft, posixpath.join(root, LIST))
        for name in set(old) - set(keep):
            store.delete_file(posixpath.join(root, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _at(self.path)
        if store.get_file_info(posixpath.join(root, self.pending)).type == fs.FileType.Directory:
            store.delete_dir(posixpath.join(root, self.pending))


def listed(path: str) -> list[str] | None:
    """The committed files of a folder; None if nothing was ever committed."""
    store, root = _at(path)
    at = posixpath.join(root, LIST)
    if store.get_file_info(at).type != fs.FileType.File:
        return None
    with store.open_input_stream(at) as source:
        return json.loads(source.read())


def write_files(px: DataFrame, path: str, kind: str = "png", prefix: str = "", k: int = 256, overwrite: bool = True) -> None:
    """px(img, y, x, r, g, b) as PNG files, or px(img, y, x, idx) as index files for a palette of ``k`` colors: one per image,
    ``prefix`` and img its name.  A task writes its images one after the other and holds a line or a band of one."""
    px.sparkSession.dataSource.register(RasterSink)
    cols = ["r", "g", "b"] if kind == "png" else ["idx"]
    whole = px.select("img", "y", "x", *(F.col(c).cast("int").alias(c) for c in cols)).join(sizes(px).select("img", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h")), "img").withColumn("k", F.lit(k))
    in_order = whole.repartition("img").sortWithinPartitions("img", "y", "x")
    in_order.write.format("raster_files").option("path", path).option("kind", kind).option("prefix", prefix).mode("overwrite" if overwrite else "append").save()
