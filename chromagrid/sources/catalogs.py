"""Brand catalogs, legends and index maps as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import rgb_of_hex

COLOR = "array<struct<code:string,name:string,rgb:string>>"
CATALOG = f"id string, name string, type string, colors {COLOR}"
ENTRY = "struct<idx:int,type:string,code:string,codeA:string,codeB:string>"
MATCHES = f"brand string, entries array<{ENTRY}>"
LEGEND = "entries array<struct<idx:int,rgb:string,symbol:string,brand:string,type:string,code:string,codeA:string,codeB:string,name:string>>, overrides map<string,string>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of each JSON file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def catalogs(docs: DataFrame) -> DataFrame:
    """(path, brand, name, type, colors); malformed files are skipped, a missing id is the file's stem."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    c = docs.withColumn("c", F.from_json("json", CATALOG)).where("c.colors IS NOT NULL")
    return c.select("path", F.upper(F.coalesce(F.nullif(F.trim("c.id"), F.lit("")), stem)).alias("brand"), "c.name", "c.type", "c.colors")


def colors(cats: DataFrame) -> DataFrame:
    """(brand, code, name, r, g, b): of equal codes the last wins; colors that aren't six hex digits are left out."""
    each = cats.select("brand", F.posexplode("colors").alias("pos", "c"))
    last = each.groupBy("brand", F.col("c.code").alias("code")).agg(F.max_by("c", "pos").alias("c"))
    r, g, b = rgb_of_hex(F.col("c.rgb"))
    return last.select("brand", "code", F.col("c.name").alias("name"), r.alias("r"), g.alias("g"), b.alias("b")).where("r IS NOT NULL")


def strict_colors(cats: DataFrame) -> DataFrame:
    """``colors``; a brand without any is an error when the result is read."""
    found = colors(cats)
    names = cats.select("brand").distinct().withColumnRenamed("brand", "named")
    every = names.join(found, F.col("named") == F.col("brand"), "left")
    code = F.when(F.col("brand").isNull(), F.raise_error(F.concat(F.lit("empty palette of brand "), F.col("named"))).cast("string")).otherwise(F.col("code"))
    return every.select(F.col("named").alias("brand"), code.alias("code"), "name", "r", "g", "b")


def brands(cats: DataFrame) -> DataFrame:
    """Distinct brands in order; DMC if there is none."""
    found = cats.select("brand").distinct()
    none = cats.sparkSession.range(1).select(F.lit("DMC").alias("brand")).join(found.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti")
    return found.unionByName(none).orderBy("brand")


def resolved_path(docs: DataFrame, brand: str, strict: bool = False) -> DataFrame:
    """The file of a brand: stem in lower case, in upper case, with a capital, in any case, then by id.

    ``strict``: if there is none, an error that lists the stems tried and the files at hand."""
    title = brand[:1].upper() + brand[1:]
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    ident = F.get_json_object("json", "$.id")
    rank = F.when(stem == brand.lower(), 0).when(stem == brand.upper(), 1).when(stem == title, 2).when(F.lower(stem) == brand.lower(), 3).when(F.lower(ident) == brand.lower(), 4)
    best = F.min_by("path", F.when(rank.isNotNull(), F.struct(rank, F.col("path"))))
    if strict:
        tried = f"no file of brand {brand}; tried {brand.lower()}, {brand.upper()}, {title}; at hand: "
        best = F.coalesce(best, F.raise_error(F.concat(F.lit(tried), F.array_join(F.sort_array(F.collect_set("path")), ", "))).cast("string"))
    return docs.agg(best.alias("path"))


def matches(docs: DataFrame) -> DataFrame:
    """(path, brand, idx, type, code_a, code_b) of catalog matches; a malformed text has no rows."""
    m = docs.select("path", F.from_json("json", MATCHES).alias("m")).select("path", "m.brand", F.explode("m.entries").alias("e"))
    return m.select("path", "brand", "e.idx", "e.type", F.coalesce("e.code", "e.codeA").alias("code_a"), F.col("e.codeB").alias("code_b"))


def legends(docs: DataFrame) -> DataFrame:
    """(path, idx, rgb, symbol, shown, brand, type, code, code_b): shown is the override or the first
    character of the symbol."""
    m = docs.select("path", F.from_json("json", LEGEND).alias("m")).select("path", F.col("m.overrides").alias("o"), F.explode("m.entries").alias("e"))
    return m.select("path", "e.idx", "e.rgb", "e.symbol", F.coalesce(F.col("o")[F.col("e.idx").cast("string")], F.nullif(F.substring("e.symbol", 1, 1), F.lit("")), F.lit("?")).alias("shown"), "e.brand", "e.type", F.coalesce("e.code", "e.codeA").alias("code"), F.col("e.codeB").alias("code_b"))


def index_map(files: DataFrame, lenient: bool = False) -> DataFrame:
    """files: (img, w, h, content binary) -> px(img, y, x, idx).

    Elements of 1, 2 or 4 little-endian bytes by the length of the content; any other length is an
    error.  ``lenient``: single bytes, what follows w * h is ignored."""

    def run(batches):
        for b in batches:
            for img, w, h, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                n = w * h
                size = 1 if lenient else len(data) // n if n and len(data) % n == 0 else 0
                if n and (size not in (1, 2, 4) or len(data) < n):
                    raise ValueError(f"index map of {len(data)} bytes for {w} x {h} cells")
                v = np.frombuffer(data, {1: "<u1", 2: "<u2", 4: "<i4"}.get(size, "<u1"), n).astype(np.int32)
                at = np.arange(n, dtype=np.int32)
                yield pa.record_batch([pa.array([img] * n, pa.int64()), pa.array(at // max(w, 1)), pa.array(at % max(w, 1)), pa.array(v)], names=["img", "y", "x", "idx"])

    return files.select(F.col("img").cast("bigint"), F.col("w").cast("int"), F.col("h").cast("int"), "content").mapInArrow(run, "img bigint, y int, x int, idx int")


def paired_index(files: DataFrame) -> DataFrame:
    """(color, index): paths quant_color_<id>.png with their index_<id>.bin."""
    one = files.select(F.regexp_extract("path", r"quant_color_(.+)\.png$", 1).alias("id"), F.col("path").alias("color")).where("id <> ''")
    two = files.select(F.regexp_extract("path", r"index_(.+)\.bin$", 1).alias("id"), F.col("path").alias("index")).where("id <> ''")
    return one.join(two, "id", "left").select("id", "color", "index")


def newest(df: DataFrame, key: str, order: Column, keep: int, by: list[str] | None = None) -> DataFrame:
    """The ``keep`` newest of distinct keys (of each ``by``)."""
    once = df.groupBy(*(by or []), key).agg(F.max(order).alias("at"))
    w = Window.partitionBy(*(by or [])).orderBy(F.desc("at"), key)
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
