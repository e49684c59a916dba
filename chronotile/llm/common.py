"""What the text operators share: reading tables, shared storage, Arrow batches, tokens."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, as the quality, scoring and near-duplicate operators see it.
SPACES = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs in this process (tests), a temporary folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='chronotile-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether a query's shuffle files go once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, compression: str = "snappy", batch: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation. Nothing reads what was shuffled for it again, so that goes when df is written. The files go
    when the driver's session ends. batch: rows at most that Python workers get at a time here, where rows are long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    usual, cleanup = spark.conf.get(_BATCH), spark.conf.get(_CLEANUP)
    if batch:
        spark.conf.set(_BATCH, min(batch, int(usual)) if int(usual) > 0 else batch)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleanup)
        if batch:
            spark.conf.set(_BATCH, usual)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name.startswith(shared_dir(spark).replace("file:///", "file:/").rstrip("/")) or name.startswith(shared_dir(spark)):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def without(df: DataFrame, names) -> DataFrame:
    """df less the columns called like one of names, in any case."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes (one row at least), so that very long texts don't add up."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of strings as UTF-8 bytes; null as the empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, work: Callable[[list[bytes]], dict[str, pa.Array | list]], schema: T.StructType, text_col: str = "text", keep: str | None = None) -> DataFrame:
    """df with the columns that work() makes of each batch's texts (bytes, null as empty) in place of
    text_col (or beside it, for keep="all"). With keep="kept", df's own columns alone, of the rows
    where work's column "kept" is true."""
    if keep == "kept":
        base, out = df, df.schema
    else:
        base = without(df, schema.fieldNames()) if text_col not in schema.fieldNames() else df
        left = [f for f in base.schema.fields if keep == "all" or f.name != text_col]
        out = T.StructType(left + schema.fields)
    names = [f.name for f in out.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in pieces(batches, 4 << 20):
            made = work(texts(batch, text_col))
            if keep == "kept":
                yield batch.filter(pa.array(made["kept"], pa.bool_()))
                continue
            columns = [pa.array(made[n], f.type) if n in made and not isinstance(made[n], pa.Array) else made.get(n, None) if n in made else batch.column(batch.schema.get_field_index(n)) for n, f in zip(names, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow, strict=True)], names=names)

    return base.mapInArrow(run, out)


_caches: dict[str, Callable[[], None]] = {}
_owner = [""]


def enter(name: str, clear: Callable[[], None]) -> None:
    """Called where an operator begins to work in a worker: what other operators keep there is dropped, as
    workers serve many jobs and the caches of all would add up."""
    _caches[name] = clear
    if _owner[0] != name:
        _owner[0] = name
        for other, drop in _caches.items():
            if other != name:
                drop()
        trim()


def trim() -> None:
    """What was dropped goes back to the system, not only to this process."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (give := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give(0)


def trimmed(run):
    """run (batches to batches), whose worker gives its memory back once the task's last batch is made: idle workers keep what they hold."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def bucket(column: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids count as 1, that is as training rows never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(1))
