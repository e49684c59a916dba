"""Per-pixel detectors over Spark: series packed by pixel, batches of pixels through one Arrow call.

Screening and deduplication happen before the Python boundary; a pixel that fails gets a row with a
status and no segment, so that one bad series doesn't end a job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.operators import cold, lockstep
from chronotile.schema import BANDS, CLEAR, SEGMENTS, SNOW, WATER, validate

_STATUS = f"{SEGMENTS}, status string"
_NONE = np.zeros(0, np.int32)


def packed(obs: DataFrame, collection2: bool = False) -> DataFrame:
    """A row for each pixel: the series of its clear and snow observations in range, as arrays in the order of days; what no
    detector looks at moves as a null. One shuffle, by pos, whose number of
    partitions is set: a detector's work is in its CPU time, not in the bytes by which partitions would be joined.
    A pixel without any such observation has empty arrays."""
    fields = ["date", "seq", *BANDS, "qa"]
    spark = obs.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    of_use = C.valid_range(collection2) & F.col("qa").isin(CLEAR, WATER, SNOW)
    rows = obs.select("pos", F.when(of_use, F.struct(*fields)).alias("o"))  # the others move as a null, so that their pixel has a row
    rows = rows.repartition(parts, "pos").groupBy("pos").agg(F.sort_array(F.collect_list("o")).alias("s"))
    return rows.select("pos", *[F.col("s")[c].alias(c) for c in fields if c != "seq"])


def _series(batch: pa.RecordBatch):
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("pos", "date", *BANDS, "qa")]
    for k in range(batch.num_rows):
        pos, days, *bands, qa = ((c[k].values.to_numpy() if c[k].is_valid else _NONE) if isinstance(c, pa.ListArray) else c[k].as_py() for c in columns)
        yield pos, days, np.array(bands), qa, k


def _portions(batch: pa.RecordBatch):
    """The pixels of a batch, so many at a time as are taken in step: their rows, their keys and their series."""
    every = batch.select(["pos", "date", *BANDS, "qa"])
    for numbers in lockstep.portions(pc.fill_null(pc.list_value_length(batch.column("date")), 0).to_pylist()):
        found = [s for k in numbers for s in _series(every.slice(k, 1))]
        yield numbers, [s[0] for s in found], [s[1:4] for s in found]


def _segment_rows(pixels, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of (pos, segments or the exception) of pixels."""
    out = []
    for pos, found in pixels:
        status = "ok"
        if isinstance(found, Exception):
            found, status = [], f"failed: {found}"[:200]
        for n, s in enumerate(found):
            row = vars(s) | {"pos": pos, "seg": n, "status": status}
            out.append(row | {c: np.asarray(row[c], np.float32).tolist() for c in ("coefs", "rmse", "magnitude")})
        if not found:
            out.append({"pos": pos, "status": status if status != "ok" else "no model"})
    return pa.RecordBatch.from_pylist(out, schema=schema)


def _status_schema() -> pa.Schema:
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(_STATUS))


def _rows(of_pixel):
    """A mapInArrow function of of_pixel(days, bands, qa, batch, row) -> segments."""
    schema = _status_schema()

    def guarded(*arguments):
        try:
            return of_pixel(*arguments)
        except lockstep.FAILURES as e:
            return e

    def run(batches):
        for batch in batches:
            yield _segment_rows(((pos, guarded(days, bands, qa, batch, k)) for pos, days, bands, qa, k in _series(batch)), schema)

    return run


def detect(obs: DataFrame, t_cg: float = 15.0863, conse: int = 6, b_c2: bool = False, gap_days: float = 365.25) -> DataFrame:
    """Segments (with a status) of every pixel of obs."""
    validate(t_cg=t_cg, conse=conse, b_c2=b_c2, gap_days=gap_days)
    schema = _status_schema()

    def run(batches):
        for batch in batches:
            for _, keys, series in _portions(batch):
                yield _segment_rows(zip(keys, lockstep.detect(series, t_cg, conse, b_c2, gap_days), strict=True), schema)

    return packed(obs, b_c2).mapInArrow(run, _STATUS)


def reconstruct(obs: DataFrame, breaks: DataFrame, conse: int = 6, b_c2: bool = False) -> DataFrame:
    """Segments between the break days (pos, break_date) of each pixel."""
    validate(conse=conse, b_c2=b_c2)
    days = breaks.groupBy("pos").agg(F.sort_array(F.collect_set("break_date")).alias("breaks"))
    series = packed(obs, b_c2).join(days, "pos", "left")

    def of_pixel(d, bands, qa, batch, k):
        given = batch.column(batch.schema.get_field_index("breaks"))[k].as_py() or []
        return cold.reconstruct(d, bands, qa, given, conse, b_c2)

    return series.mapInArrow(_rows(of_pixel), _STATUS)


def magnitudes(obs: DataFrame, start: int, n_cm: int, interval: int = 60, t_cg: float = 15.0863, conse: int = 6) -> DataFrame:
    """(pos, cm_idx, cm, cm_date): the largest change magnitude of each interval; -9999 for none."""
    validate(starting_date=start, n_cm=n_cm, t_cg=t_cg, conse=conse)

    def run(batches):
        for batch in batches:
            for _, keys, series in _portions(batch):
                noted = [cold.Magnitudes(start, interval, n_cm) for _ in keys]
                for found in lockstep.detect(series, t_cg, conse, magnitudes=noted):
                    if isinstance(found, Exception):
                        raise found
                columns = np.repeat(np.array(keys, np.int64), n_cm), np.tile(np.arange(n_cm, dtype=np.int32), len(keys)), np.concatenate([m.cm for m in noted]), np.concatenate([m.day for m in noted])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pos", "cm_idx", "cm", "cm_date"])

    return packed(obs).mapInArrow(run, "pos long, cm_idx int, cm smallint, cm_date smallint")


def detect_both(obs: DataFrame, start: int, n_cm: int, interval: int = 60, t_cg: float = 15.0863, conse: int = 6, b_c2: bool = False, gap_days: float = 365.25) -> DataFrame:
    """A row for each pixel with its segments and its change magnitudes, from one pass; see segments_of() and magnitudes_of()."""
    validate(starting_date=start, n_cm=n_cm, t_cg=t_cg, conse=conse, b_c2=b_c2, gap_days=gap_days)
    fields = [f for f in SEGMENTS.split(", ") if f.split()[0] != "pos"]
    schema = f"pos long, segments array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>>, cm array<smallint>, cm_date array<smallint>, status string"

    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for _, keys, series in _portions(batch):
                out, noted = [], [cold.Magnitudes(start, interval, n_cm) for _ in keys]
                for pos, m, found in zip(keys, noted, lockstep.detect(series, t_cg, conse, b_c2, gap_days, noted), strict=True):
                    failed = isinstance(found, Exception)
                    status = f"failed: {found}"[:200] if failed else "ok" if found else "no model"
                    rows = [vars(s) | {"seg": n} for n, s in enumerate([] if failed else found)]
                    out.append({"pos": pos, "segments": [r | {c: np.asarray(r[c], np.float32).tolist() for c in ("coefs", "rmse", "magnitude")} for r in rows], "cm": m.cm.tolist(), "cm_date": m.day.tolist(), "status": status})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return packed(obs, b_c2).mapInArrow(run, schema)


def segments_of(both: DataFrame) -> DataFrame:
    """The segments of detect_both(), as detect() has them."""
    rows = both.select("pos", F.explode_outer("segments").alias("s"), "status")
    return rows.select("pos", *[F.col(f"s.{f.split()[0]}") for f in SEGMENTS.split(", ")[1:]], "status")


def magnitudes_of(both: DataFrame) -> DataFrame:
    """The magnitudes of detect_both(), as magnitudes() has them."""
    return both.select("pos", F.posexplode(F.arrays_zip("cm", "cm_date")).alias("cm_idx", "m")).select("pos", F.col("cm_idx").cast("int").alias("cm_idx"), "m.cm", "m.cm_date")
