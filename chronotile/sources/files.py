"""Files: pixel series, scene arrays, stacks, states and maps.

Scene arrays are .npy files of (rows, cols, 8) whose names hold the year at characters 9-12 and the day of
year at 13-15. They are read by Spark's binary reader, so any store that Spark reads will do; arrays
are never unpickled.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.operators import scenes
from chronotile.operators.grid import index
from chronotile.schema import BANDS, FILL, OBS, Grid

_CSV = "date int, blue int, green int, red int, nir int, swir1 int, swir2 int, thermal int, qa int, sensor int"


def read_csv(spark: SparkSession, path: str, pos: int = 1, header: bool = False) -> DataFrame:
    """A pixel's series of ten integer columns (the sensor is dropped). seq follows the day, then the values."""
    rows = spark.read.schema(_CSV).csv(path, header=header)
    seq = F.row_number().over(Window.partitionBy(F.lit(pos)).orderBy("date", *BANDS, "qa"))  # one pixel
    return rows.select(F.lit(pos).cast("long").alias("pos"), seq.alias("seq"), "date", *BANDS, "qa")


def write_csv(obs: DataFrame, path: str) -> None:
    obs.select("date", *BANDS, "qa").write.mode("overwrite").csv(path, header=False)


def read_breaks(spark: SparkSession, path: str, pos: int = 1) -> DataFrame:
    """A column of break days; a byte-order mark and zeros are left out."""
    day = F.regexp_replace("value", "[^0-9-]", "").cast("int")
    return spark.read.text(path).select(F.lit(pos).cast("long").alias("pos"), day.alias("break_date")).filter("break_date > 0")


def scene_date(name):
    """The ordinal day of a scene from its file name."""
    day = F.make_date(F.substring(name, 10, 4).cast("int"), F.lit(1), F.lit(1))
    return (C.ordinal(day) + F.substring(name, 14, 3).cast("int") - 1).cast("int")


def list_scenes(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(name, date) of the scenes in a folder, by date then name. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[LS]*.npy").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    out = files.withColumn("date", scene_date(F.col("name")))
    if low is not None:
        out = out.filter(F.col("date") >= low)
    if high is not None:
        out = out.filter(F.col("date") <= high)
    return out.orderBy("date", "name")


def read_stack(spark: SparkSession, path: str, grid: Grid, block_x: int = 1, block_y: int = 1, low: int | None = None, high: int | None = None, sensors: str = "LS") -> DataFrame:
    """Observations (schema.OBS) of a block's scene arrays; dates are bounded by name, before anything is
    read. sensors: first letters of the names to read. Pixels that are fill everywhere in a scene give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"[{sensors}]*.npy").load(path)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("date", scene_date(F.col("name")))
    if low is not None:
        files = files.filter(F.col("date") >= low)
    if high is not None:
        files = files.filter(F.col("date") <= high)
    n_cols, top, lefthand = grid.n_cols, (block_y - 1) * grid.block_height, (block_x - 1) * grid.block_width

    def unpack(batches):
        for batch in batches:
            for date, nth, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                r, c = np.nonzero(a[:, :, 7] != FILL)
                seen = a[r, c].astype(np.int32)
                n = len(r)
                pos = (r + top).astype(np.int64) * n_cols + c + lefthand + 1
                seq = np.full(n, nth, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(seq), pa.array(np.full(n, date, np.int32)), *(pa.array(seen[:, k]) for k in range(8))], names=[x.split()[0] for x in OBS.split(", ")])

    # Scenes of a day go by their names.
    names = files.select("name", "date").withColumn("nth", F.row_number().over(Window.partitionBy("date").orderBy("name"))).select("name", "nth")
    return files.join(F.broadcast(names), "name").select("date", "nth", "content").mapInArrow(unpack, OBS)


def read_bip(spark: SparkSession, path: str, rows: int, cols: int, row: int, col: int) -> DataFrame:
    """The series of one pixel in band-interleaved 16-bit scenes of eight bands; fill is left out. Files of another size than
    rows and cols say raise an error. The date is the first seven digits (year and day of year) of the name."""
    files = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    digits = F.regexp_extract("name", r"(\d{7})", 1)
    date = (C.ordinal(F.make_date(F.substring(digits, 1, 4).cast("int"), F.lit(1), F.lit(1))) + F.substring(digits, 5, 3).cast("int") - 1).cast("int")
    at = ((row - 1) * cols + col - 1) * 16

    def unpack(batches):
        for batch in batches:
            out = []
            for day, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(content) != rows * cols * 16:
                    raise ValueError(f"a scene of {len(content)} bytes is no {rows} x {cols} pixels of eight bands")
                v = np.frombuffer(content, "<i2", 8, at)
                if v[7] < FILL:
                    out.append((cols * (row - 1) + col, 1, day, *map(int, v)))
            names = [x.split()[0] for x in OBS.split(", ")]
            kinds = [pa.int64(), *[pa.int32()] * 10]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 11, kinds, strict=True)], names=names)

    return files.select(date.alias("date"), "content").mapInArrow(unpack, OBS)


def write_blocks(rows: DataFrame, grid: Grid, path: str, *also: str) -> None:
    """Rows with a pos (segments, magnitudes, packs, maps) by block, and below that by the columns `also`: one shuffle, a folder a
    block; a rerun replaces the blocks it holds."""
    placed = index(rows, grid).drop("row", "col", "block_x", "block_y", "in_row", "in_col")
    placed.repartition("block_id", *also).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_id", *also).parquet(path)


def write_segments(segments: DataFrame, grid: Grid, path: str) -> None:
    write_blocks(segments, grid, path)


def write_scenes(obs: DataFrame, grid: Grid, path: str) -> None:
    """Observations by block and day; of a scene only the blocks that it shows a clear, water or snow pixel of."""
    placed = index(obs, grid).drop("row", "col", "block_x", "block_y", "in_row", "in_col")
    seen = scenes.useful_blocks(placed).select("block_id", "date")
    kept = placed.join(seen, ["block_id", "date"], "left_semi")
    kept.repartition("block_id").sortWithinPartitions("block_id", "pos", "date", "seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block_id").parquet(path)


def read_obs(spark: SparkSession, path: str, blocks: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Observations as write_scenes() left them; only the folders of given blocks are read, and days are pushed down to the files."""
    rows = spark.read.schema(f"{OBS}, block_id int").parquet(path)
    if blocks is not None:
        rows = rows.filter(F.col("block_id").isin(blocks))
    if low is not None:
        rows = rows.filter(F.col("date") >= low)
    if high is not None:
        rows = rows.filter(F.col("date") <= high)
    return rows.drop("block_id")


def write_changes(changed: DataFrame, grid: Grid, path: str) -> None:
    """Break days of changed pixels (pos, break_date) by block; days that aren't positive become 0."""
    write_blocks(changed.select("pos", F.greatest("break_date", F.lit(0)).cast("int").alias("break_date")), grid, path)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """(pos, break_dates): of each pixel its break days in order."""
    rows = spark.read.parquet(path).filter("break_date > 0")
    return rows.groupBy("pos").agg(F.sort_array(F.collect_set("break_date")).alias("break_dates"))


def read_raster(spark: SparkSession, path: str, n_cols: int) -> DataFrame:
    """(pos, cls) of rasters of classes, .npy or TIFF files of one tile each; the first pixel has pos 1."""
    from chronotile.sources import tiff

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False) if name.endswith(".npy") else tiff.read(content)[0]
                r, c = np.indices(a.shape)
                yield pa.RecordBatch.from_arrays([pa.array((r * n_cols + c + 1).ravel().astype(np.int64)), pa.array(a.ravel().astype(np.int32))], names=["pos", "cls"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "pos long, cls int")


def images(maps: DataFrame, grid: Grid, key: str, value: str, place=None, empty: int = 0) -> DataFrame:
    """(key, content): of each map of (pos, key, value) a TIFF file. A map is one group; it is as large as a tile."""
    from chronotile.sources import tiff

    def of_map(table: pa.Table) -> pa.Table:
        a = np.full(grid.n_rows * grid.n_cols, empty, np.int32)
        a[table.column("pos").to_numpy() - 1] = table.column("value").to_numpy()
        return pa.table({"key": table.column("key").slice(0, 1), "content": pa.array([tiff.write(a.reshape(grid.n_rows, grid.n_cols), place)], pa.binary())})

    rows = maps.select("pos", F.col(key).cast("int").alias("key"), F.col(value).cast("int").alias("value"))
    return rows.groupBy("key").applyInArrow(of_map, "key int, content binary")


def save_images(made: DataFrame, path: str, prefix: str = "map") -> list[str]:
    """Write images() as files, one at a time, through Spark's file system; their names."""
    jvm, conf = made.sparkSession.sparkContext._jvm, made.sparkSession.sparkContext._jsc.hadoopConfiguration()
    names = []
    for row in made.toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{prefix}_{row['key']}.tif")
        out = where.getFileSystem(conf).create(where, True)
        out.write(bytearray(row["content"]))
        out.close()
        names.append(where.getName())
    return sorted(names)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unfinished(blocks: DataFrame, path: str) -> DataFrame:
    """The blocks (block_id) that path holds nothing of yet."""
    spark = blocks.sparkSession
    try:
        done = spark.read.parquet(path).select("block_id").distinct()
    except Exception as e:
        if not re.search("PATH_NOT_FOUND|UNABLE_TO_INFER", str(e)):
            raise
        return blocks
    return blocks.join(done, "block_id", "left_anti")


def report(spark: SparkSession, path: str, **facts) -> None:
    """A run's settings and timings as one line of JSON."""
    spark.createDataFrame([{k: str(v) for k, v in facts.items()}]).coalesce(1).write.mode("overwrite").json(path)


def envi_header(text: str) -> dict:
    """`name = value` lines of a header, names in lower case; numbers where they are."""
    found = re.findall(r"(?m)^\s*([\w ]+?)\s*=\s*(\{[^}]*\}|[^\n]*)", text)
    return {k.lower(): int(v) if re.fullmatch(r"-?\d+", v.strip()) else v.strip() for k, v in found}


def load_config(text: str) -> dict:
    """A mapping of `name: value` lines (numbers and true or false where they are), with mappings and lists below a name by their indentation."""

    def plain(v: str):
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        return int(v) if re.fullmatch(r"-?\d+", v) else float(v) if re.fullmatch(r"-?\d*\.\d+", v) else v.strip("'\"")

    top: dict = {}
    open_: list[tuple[int, object, str | None]] = [(-1, top, None)]  # indentation, container, the name that waits for one
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip() or line.strip() == "---":
            continue
        depth, said = len(line) - len(line.lstrip()), line.strip()
        item = said.startswith("- ") or said == "-"
        while depth < open_[-1][0] or (depth == open_[-1][0] and not item and isinstance(open_[-1][1], list)):
            open_.pop()
        level, holder, waits = open_[-1]
        if waits is not None and (depth > level or item):
            own: object = [] if item else {}
            holder[waits] = own
            open_[-1] = (level, holder, None)
            open_.append((depth, own, None))
            level, holder, waits = open_[-1]
        if item:
            if not isinstance(holder, list):
                raise ValueError(f"an item without a name above it: {said}")
            holder.append(plain(said[1:].strip()))
        elif m := re.match(r"([\w-]+)\s*:(?:\s+(.+))?$", said):
            if not isinstance(holder, dict):
                raise ValueError(f"a name among items: {said}")
            holder[m[1]] = plain(m[2]) if m[2] else None
            open_[-1] = (max(level, depth), holder, None if m[2] else m[1])
        else:
            raise ValueError(f"not understood: {said}")
    return top
