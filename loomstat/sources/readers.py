"""Sources: tables, CSV, JSON documents and lines, folders of files, binary formats. Schemas are declared, not inferred."""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import key_parts
from . import png

METRICS = "file string, content string, `set` string, style int, seed int, fg_frac double, purity double, palette_de double, flatness double, interior_de double, cut_residual double, fragments int, chroma double, edge_p double, edge_r double, edge_f1 double, sil_iou double, clip_style double, clip_text double, dino_styleref double, dino_gt double, clip_gt double, palette_js double"
LAYERED = "pieces int, layers int, base_pieces int, depth2 int, depth3 int, depth4plus int, decoration_share double, colours int, base_colours int, base_area_share double, largest_piece_mm2 double, median_piece_mm2 double, cut_length_flat_mm double, cut_length_layered_mm double, holes_flat int, file string, content string"
RECORD = "name string, content string, style int, seed int, prompt string, seconds double, guide_trace array<struct<step:int,pal:double,flat:double,edge:double,ground:double>>"
SURVEY = "version string, form string, rater struct<id:string,role:string,years:string,fam:string,hands:string>, started string, finished string, `order` array<string>, ratings array<struct<code:string,style:int,faith:int,cut:int,sec:double,comment:string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Values that one part of a table holds once its rows are expanded.
PART = 1 << 18


def dealt(rows: DataFrame, key: str, each: int) -> DataFrame:
    """``rows`` dealt by ``key`` into parts of about ``PART`` values, before each of them is expanded into ``each``. A file of few bytes is one part, which one
    task would expand. What is grouped by ``key`` afterwards isn't shuffled again."""
    parts = max(-(-rows.count() * each // PART), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, key)


def csv(spark: SparkSession, path: str, schema: str, keep_empty: bool = False) -> DataFrame:
    """By header name, in any column order; columns that the file lacks are null, and so are empty fields, which stay empty text with
    ``keep_empty``. A byte order mark is dropped."""
    raw = spark.read.csv(path, header=True, inferSchema=False, escape='"')
    if keep_empty:
        raw = raw.fillna("")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    want = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    return raw.select(*[(F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, with ``file_name``."""
    return spark.read.schema(schema).json(path, multiLine=True).select("*", F.col("_metadata.file_name").alias("file_name"))


def files(spark: SparkSession, path: str, glob: str = "*", ignored: tuple[str, ...] = (".DS_Store", "Thumbs.db"), content: bool = True) -> DataFrame:
    """Files under ``path``, recursively, with paths relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    root = re.sub(r"^[a-z][a-z0-9+.-]*:(?=/)", "", path.rstrip("/")) + "/"
    relative = F.substring_index("path", root, -1)
    cols = [relative.alias("path"), F.col("length").alias("bytes"), *([F.col("content")] if content else [])]
    return found.where(~name.isin(*ignored) & ~name.startswith("._")).select(*cols)


def keyed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    found = files(spark, path, glob, content=False)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return found.withColumns({"file": stem, **key_parts(stem)})


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV at ``path``, or no rows where there is none."""
    try:
        return csv(spark, path, schema)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def expected(found: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows for every expected name, in order (``pos``), with nulls where nothing was found."""
    dim = found.sparkSession.createDataFrame(list(enumerate(names)), f"pos int, {key} string")
    return dim.join(found, key, "left")


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``; made by ``make()`` and written first where it is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


HEADER = T.StructType().add("tensors", T.LongType()).add("blocks", T.LongType()).add("ranks", T.ArrayType(T.LongType()))


@F.pandas_udf(HEADER)
def tensor_header(content: pd.Series) -> pd.DataFrame:
    """Of a safetensors file: tensors, distinct block numbers and LoRA ranks. Null where the header is broken or over 16 MiB."""
    out = []
    for raw in content:
        try:
            (n,) = struct.unpack("<Q", raw[:8])
            if n > 16 << 20 or len(raw) < 8 + n:
                raise ValueError(n)
            names = {k: v for k, v in json.loads(raw[8 : 8 + n]).items() if k != "__metadata__"}
            blocks = {".".join(p.split(".")[: i + 1]) for p in names for i, x in enumerate(p.split(".")) if x.isdigit()}
            out.append((len(names), len(blocks), sorted({min(v["shape"]) for k, v in names.items() if "lora" in k.lower() and v.get("shape")})))
        except (ValueError, KeyError, struct.error, AttributeError, TypeError):
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["tensors", "blocks", "ranks"])


def label_maps(found: DataFrame) -> DataFrame:
    """Pixel rows (``path``, ``y``, ``x``, ``label``) of ``.npy`` files of small integers."""
    def run(batches):
        import io

        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                m = np.load(io.BytesIO(raw), allow_pickle=False)
                y, x = np.indices(m.shape)
                yield pd.DataFrame({"path": path, "y": y.ravel(), "x": x.ravel(), "label": m.ravel().astype(np.int32)})

    return found.select("path", "content").mapInPandas(run, "path string, y int, x int, label int")


def svg_pixels(pictures: DataFrame) -> DataFrame:
    """Pixel rows (``img``, ``y``, ``x``, ``fill``) of pictures (``img``, ``svg``) whose paths are boxes one pixel high, as ``sinks.svg`` draws
    them. A picture without paths has no rows."""
    path = pictures.select("img", F.explode(F.regexp_extract_all("svg", F.lit('<path fill="[^"]*" d="[^"]*"/>'), F.lit(0))).alias("p"))
    box = path.select("img", F.regexp_extract("p", 'fill="([^"]*)"', 1).alias("fill"), F.explode(F.regexp_extract_all("p", F.lit(r"M\d+ \d+h\d+v1h-\d+z"), F.lit(0))).alias("b"))
    x, y, n = (F.regexp_extract("b", r"M(\d+) (\d+)h(\d+)", i).cast("int") for i in (1, 2, 3))
    return box.select("img", "fill", y.alias("y"), F.explode(F.sequence(x, x + n - 1)).alias("x")).select("img", "y", "x", "fill")


def pictures(found: DataFrame, size: int | None = None) -> DataFrame:
    """(``path``, ``height``, ``width``, ``rgb``) of ``.png`` files (``path``, ``content``): values from 0 to 1 in reading order, red, green and blue, on
    white; with a ``size`` in the middle of a square of so many pixels. All null but the path where a file can't be read."""
    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rgb = png.on_white(png.decode(bytes(content)))
                    if size is not None:
                        rgb = png.resized(png.squared(rgb), size)
                    out.append((path, *rgb.shape[:2], rgb.ravel().astype(np.float32)))
                except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error):
                    out.append((path, None, None, None))
            made = pd.DataFrame(out, columns=["path", "height", "width", "rgb"])
            yield made.astype({"height": "Int32", "width": "Int32"})

    return found.select("path", "content").mapInPandas(run, "path string, height int, width int, rgb array<float>")
