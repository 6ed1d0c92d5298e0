"""Files as relations: typed CSV, key=value sidecars, layouts, decks, listings, and a data source for raw rasters."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tilewright.functions.text import key_values, number_or_null, strip_bom

#: Schemas that the evaluation's steps hand to one another.
SCHEMAS = {
    "tile_index": "tile_id string, y int, x int, size int, tissue double",
    "tile_index_fov": "tile_id string, y int, x int, size int, tissue double, fov string, fov_y int, fov_x int, paired_ncc double, paired_ok int",
    "crop_scale": "source string, id string, src_mpp double, out_mpp double, out_w int, out_h int",
    "hv_instances": "source string, id string, inst_id string, type int, type_name string, area_px double, cx double, cy double, prob double",
    "nuc_subset": "id string, sample string, stage string, keep int, hole_depth double, tissue_frac double, mask_cov double, he_cov double, ratio double",
    "coverage": "sample string, n_links int, n_tiles_inside int, n_tiles_total int, cover_mm2 double, tissue_mm2 double, cover_pct double",
    "tpaf_links": "id string, sample string, n int, tier int, tile_id string, y_mm double, x_mm double, structures string, n_fov int, fov_i int, tpaf_file string, tpaf_path string",
    "offsets": "well string, tile int, dy double, dx double, dist double, ncc double",
    "he_artifacts": "slide string, tile string, artifact_px int, blobs int, tissue_px int",
    "summary": "structure string, zh string, ecm int, mean double, std double, top_z double, top_tiles string",
}


def csv(spark: SparkSession, path: str, schema: str | None = None, text_columns: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header, with or without a byte order mark. With a schema its columns are typed (what does not parse
    is NULL); without, all but text_columns become doubles, and a file without rows is an error."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if schema is None:
        if raw.limit(1).count() == 0:
            raise ValueError(f"{path} has no rows")
        return raw.select(*[F.col(c) if c in text_columns else number_or_null(c).alias(c) for c in raw.columns])
    want = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    kinds = {f.name: f.dataType.simpleString() for f in want}
    null = F.lit(None)

    def typed(name: str, kind: str):
        if name not in raw.columns:
            return null.cast(kind).alias(name)
        if kind == "string":
            return F.col(name)
        number = number_or_null(name)
        return (number if kind == "double" else number.cast(kind)).alias(name)

    return raw.select(*[typed(n, k) for n, k in kinds.items()])


def write_csv(df: DataFrame, path: str, columns: list[str], digits: dict[str, int] | None = None) -> None:
    """The named columns in this order, others left out, some rounded."""
    digits = digits or {}
    df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def samples(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The file of this name in every sample's folder, with the folder as `sample`; folders without it are not there."""
    raw = spark.read.option("header", True).csv(f"{root}/*/{name}")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.withColumn("sample", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a key=value file."""
    return key_values(spark.read.text(path))


def upsert_keys(lines: DataFrame, prefix: str, fresh: DataFrame) -> DataFrame:
    """Lines of a sidecar without those of a prefix, and the fresh ones."""
    return lines.where(~F.startswith("value", F.lit(prefix))).unionByName(fresh)


def layout(spark: SparkSession, path: str) -> DataFrame:
    """name, y, x of a layout file: tabs or spaces, comments and blank lines skipped."""
    line = F.trim(strip_bom(F.col("value")))
    got = spark.read.text(path).select(line.alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    place = lambda k: F.regexp_extract("value", rf"\b{k}=\s*(-?[0-9.]+)", 1).cast("double")
    return got.where(F.rlike("value", F.lit(r"\by=.*\bx="))).select(F.trim(F.regexp_extract("value", r"^(.*?)\s+y=", 1)).alias("name"), place("y").alias("y"), place("x").alias("x"))


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, name, bytes of all files below root, without reading them. Order by path where order matters."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def first_paths(files: DataFrame) -> DataFrame:
    """One path per file name: the first in order."""
    return files.groupBy("name").agg(F.min("path").alias("path"))


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_path, b_path of files with equal contents: sizes are joined first. a, b: binaryFile tables."""
    one = lambda f, p: f.select(F.col("path").alias(f"{p}_path"), F.col("length").alias("n"), F.md5("content").alias("h"))
    return one(a, "a").join(one(b, "b"), ["n", "h"]).select("a_path", "b_path")


#: Names of the drawing and relationship parts of a presentation file.
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def deck_pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, slide, picture, x, y, cx, cy (EMU): where a presentation shows its pictures."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, raw in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for part in sorted(n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")):
                        rel = f"ppt/slides/_rels/{part.rsplit('/', 1)[1]}.rels"
                        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(rel))} if rel in z.namelist() else {}
                        for pic in ElementTree.fromstring(z.read(part)).iter(f"{_SLIDE}pic"):
                            blip, off, ext = pic.find(f".//{_DRAW}blip"), pic.find(f".//{_DRAW}off"), pic.find(f".//{_DRAW}ext[@cx]")
                            if blip is not None and off is not None and ext is not None:
                                picture = target.get(blip.get(f"{_REL}embed"), "").rsplit("/", 1)[-1]
                                rows.append((name, part.rsplit("/", 1)[1], picture, *(int(e.get(k)) for e, k in ((off, "x"), (off, "y"), (ext, "cx"), (ext, "cy")))))
            yield pd.DataFrame(rows, columns=["path", "slide", "picture", "x", "y", "cx", "cy"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, slide string, picture string, x long, y long, cx long, cy long")


class _Band(InputPartition):
    def __init__(self, top: int, rows: int):
        self.top, self.rows = top, rows


class _RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.h, self.w, self.band = (int(options[k]) for k in ("height", "width", "band"))
        self.kind, self.skip = options.get("dtype", "uint8"), int(options.get("offset", "0"))

    def partitions(self) -> list[_Band]:
        return [_Band(y, min(self.band, self.h - y)) for y in range(0, self.h, self.band)]

    def read(self, part: _Band):
        a = np.memmap(self.path, self.kind, "r", self.skip, (self.h, self.w))[part.top : part.top + part.rows]
        for y in range(part.rows):
            yield (part.top + y, a[y].astype("<f4").tobytes(), float(a[y].mean()), int(a[y].max()))


class RasterSource(DataSource):
    """Raw rasters of a known shape on a file system that all workers mount, one partition per band of rows.

    Options: path, height, width, band, dtype (uint8), offset (0). A row of the raster is a row: y, its values as
    little-endian 32-bit floats, their mean and their maximum.
    """

    @classmethod
    def name(cls) -> str:
        return "raster_rows"

    def schema(self) -> str:
        return "y int, values binary, mean double, top long"

    def reader(self, schema) -> DataSourceReader:
        return _RasterReader({k.lower(): v for k, v in self.options.items()})


def windows(h: int, w: int, top: int, left: int, height: int, width: int, turn: int = 0) -> tuple[int, int, int, int]:
    """The window of the unturned image that shows as (top, left, height, width) once it is turned by 0, 90, 180 or 270
    degrees clockwise; ValueError if it leaves the image."""
    hh, ww = (h, w) if turn % 180 == 0 else (w, h)
    if top < 0 or left < 0 or top + height > hh or left + width > ww or turn % 90:
        raise ValueError("the window leaves the image")
    return {0: (top, left, height, width), 90: (h - left - width, top, width, height), 180: (h - top - height, w - left - width, height, width), 270: (left, w - top - height, width, height)}[turn % 360]
