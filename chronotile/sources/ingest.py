"""Archived scenes as observations: harmonised scenes in folders, analysis-ready and Collection 2 scenes in tar files.

Python unpacks the images of a scene and nothing else; what bits of the quality word mean, scale factors, clear
shares, days and clipping are column functions. A scene is one task's work; a scene that can't be read, or lacks a band,
gives no rows. Files are read by Spark's binary reader, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.operators import scenes
from chronotile.schema import BANDS, FILL, OBS, Grid
from chronotile.sources import tiff

_TM = {"blue": "B1", "green": "B2", "red": "B3", "nir": "B4", "swir1": "B5", "swir2": "B7", "thermal": "B6"}
_OLI = {"blue": "B2", "green": "B3", "red": "B4", "nir": "B5", "swir1": "B6", "swir2": "B7", "thermal": "B10"}
_HLS = {"L30": ("B02", "B03", "B04", "B05", "B06", "B07"), "S30": ("B02", "B03", "B04", "B8A", "B11", "B12")}
#: Files of a scene by their names; the scene's name; where in it the day is, and how it is written.
KINDS = {
    "hls": (r"[^/]*\.tif$", r"(HLS\.[LS]30\.[^/]*?)\.[A-Za-z0-9]+\.tif$", r"^HLS\.[LS]30\.[^.]+\.(\d{7})", "yearday"),
    "ard": (r"_(SR|BT)\.tar$", r"([^/]*)_(?:SR|BT)\.tar$", r"^.{15}(\d{8})", "date"),
    "collection2": (r"\.tar$", r"([^/]*)\.tar$", r"_(\d{8})_", "date"),
}
_RAW = f"scene string, row int, col int, x double, y double, {', '.join(f'{b} int' for b in BANDS)}, word int"


def names(scene: str, kind: str) -> dict[str, tuple[str, ...]]:
    """The endings of a scene's files by band; `word` is the quality."""
    if kind == "hls":
        sensor = scene.split(".")[1]
        return {b: (f".{n}.tif",) for b, n in zip(BANDS, _HLS[sensor], strict=False)} | {"word": (".Fmask.tif",)}
    of = _OLI if scene[3] in "89" else _TM
    if kind == "ard":
        return {b: ((f"_BTB{n[1:]}.tif", f"_BT{n}.tif", f"_BT_{n}.tif") if b == "thermal" else (f"_SR{n}.tif", f"_SR_{n}.tif", f"_SR{n}.TIF")) for b, n in of.items()} | {"word": ("_PIXELQA.tif", "_QA_PIXEL.TIF")}
    return {b: (f"_ST_{n}.TIF" if b == "thermal" else f"_SR_{n}.TIF",) for b, n in of.items()} | {"word": ("_QA_PIXEL.TIF",)}


def unpack(scene: str, kind: str, contents: dict[str, bytes]) -> tuple[dict[str, np.ndarray], tiff.Place | None] | None:
    """The images of a scene by band, from its files or what its tar files hold; None if one is missing or broken."""
    files = {}
    try:
        for name, content in contents.items():
            if name.lower().endswith(".tar"):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    files |= {m.name.rsplit("/", 1)[-1]: tar.extractfile(m).read() for m in tar.getmembers() if m.isfile()}
            else:
                files[name] = content
        out, place = {}, None
        for band, ends in names(scene, kind).items():
            found = next((c for n, c in files.items() if n.endswith(ends)), None)
            if found is None:
                return None
            out[band], own = tiff.read(found)
            place = place or own
        if "thermal" not in out:
            out["thermal"] = np.zeros_like(out["word"])
        if len({a.shape for a in out.values()}) != 1:
            return None
        return out, place
    except (ValueError, KeyError, IndexError, tarfile.TarError, OSError, struct.error, zlib.error):
        return None


def raw_scenes(spark: SparkSession, path: str, kind: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(scene, row, col, x, y, bands, word, date) of every pixel of the scenes below path, as stored, fill left out. low, high: days that bound
    the scenes, both included, by their names, before contents are read."""
    which, scene, day, form = KINDS[kind]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("path").rlike(which))
    files = files.withColumn("scene", F.regexp_extract("path", scene, 1)).filter("scene <> ''")
    digits = F.regexp_extract("scene", day, 1)
    date = F.make_date(F.substring(digits, 1, 4).cast("int"), F.lit(1), F.lit(1)) if form == "yearday" else F.try_to_date(digits, "yyyyMMdd")
    n = C.ordinal(date) + (F.substring(digits, 5, 3).cast("int") - 1 if form == "yearday" else 0)
    files = files.filter(digits != "").withColumn("date", n.cast("int"))
    if low is not None:
        files = files.filter(F.col("date") >= low)
    if high is not None:
        files = files.filter(F.col("date") <= high)

    def of_scene(table: pa.Table) -> pa.Table:
        name = table.column("scene")[0].as_py()
        contents = {p.rsplit("/", 1)[-1]: c for p, c in zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True)}
        got = unpack(name, kind, contents)
        a, place = got if got else ({b: np.zeros((0, 0), np.int32) for b in (*BANDS, "word")}, None)
        word = a["word"].astype(np.int32)
        r, c = np.nonzero(word != FILL if kind == "hls" else word & 1 == 0)  # the lowest bit is fill; harmonised scenes have 255
        x, y = (place.x + (c + 0.5) * place.width, place.y - (r + 0.5) * place.height) if place else (c + 0.5, -(r + 0.5))
        columns = [pa.array([name] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(x, pa.float64()), pa.array(y, pa.float64()), *(pa.array(a[b][r, c].astype(np.int32)) for b in (*BANDS, "word"))]
        return pa.Table.from_arrays([*columns, pa.array([table.column("date")[0].as_py()] * len(r), pa.int32())], names=["scene", "row", "col", "x", "y", *BANDS, "word", "date"])

    return files.select("scene", "path", "content", "date").groupBy("scene").applyInArrow(of_scene, f"{_RAW}, date int")


def read_scenes(spark: SparkSession, path: str, kind: str, grid: Grid, low: int | None = None, high: int | None = None, clear_threshold: float = 0.0, bounds: tuple[float, float, float, float] | None = None, collection2: bool | None = None) -> DataFrame:
    """Observations (schema.OBS) of the scenes below path. kind: hls, ard or collection2. bounds: (least x, least y, largest x, largest y)
    of the pixels' centres to keep; the tile's first row and column are then those of the first pixels within. clear_threshold: scenes
    whose clear share isn't above it are left out. collection2: whether ard scenes are of that collection (their
    quality words and scale factors)."""
    scaled = kind == "collection2" if collection2 is None else collection2
    rows = raw_scenes(spark, path, kind, low, high)
    if bounds is not None:
        least_x, least_y, most_x, most_y = bounds
        rows = rows.filter(F.col("x").between(least_x, most_x) & F.col("y").between(least_y, most_y))
        first = rows.agg(F.min("row").alias("r0"), F.min("col").alias("c0"))
        rows = rows.join(F.broadcast(first)).withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")}).drop("r0", "c0")
    qa = C.qa_hls(F.col("word")) if kind == "hls" else C.qa_c2(F.col("word")) if scaled else C.qa_c1(F.col("word"))
    rows = rows.filter((F.col("row") < grid.n_rows) & (F.col("col") < grid.n_cols)).withColumn("qa", qa)
    if clear_threshold > 0:
        kept = scenes.clear_ratio(rows.select(F.col("scene").alias("date"), "qa"), clear_threshold).select(F.col("date").alias("scene"))
        rows = rows.join(F.broadcast(kept), "scene")  # a row a scene
    order = rows.select("scene", "date").distinct().withColumn("seq", F.row_number().over(Window.partitionBy("date").orderBy("scene")))
    rows = rows.join(F.broadcast(order.select("scene", "seq")), "scene")
    value = {b: (C.scale_temperature(F.col(b)) if b == "thermal" else C.scale_reflectance(F.col(b))).cast("int") if scaled else F.col(b) for b in BANDS}
    pos = F.col("row").cast("long") * grid.n_cols + F.col("col") + 1
    return rows.select(pos.alias("pos"), "seq", "date", *[value[b].alias(b) for b in BANDS], F.col("qa").cast("int").alias("qa")).to(spark.createDataFrame([], OBS).schema)


def shapes(shp: bytes) -> list[list[tuple[float, float]]]:
    """The points of each record of a file of lines or polygons, its parts one after another."""
    out, at = [], 100
    while at + 8 <= len(shp):
        size = struct.unpack(">I", shp[at + 4 : at + 8])[0] * 2
        body = shp[at + 8 : at + 8 + size]
        if struct.unpack("<I", body[:4])[0] in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack("<II", body[36:44])
            flat = np.frombuffer(body, "<f8", points * 2, 44 + 4 * parts)
            out.append(list(zip(flat[::2].tolist(), flat[1::2].tolist(), strict=True)))
        else:
            out.append([])
        at += 8 + size
    return out


def extent(points: list[tuple[float, float]], step: float = 30.0, origin: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float, float, float]:
    """The box around points, grown to the borders of pixels."""
    x, y = np.array(points).T
    low = [np.floor((v.min() - o) / step) * step + o for v, o in ((x, origin[0]), (y, origin[1]))]
    high = [np.ceil((v.max() - o) / step) * step + o for v, o in ((x, origin[0]), (y, origin[1]))]
    return float(low[0]), float(low[1]), float(high[0]), float(high[1])
