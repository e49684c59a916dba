"""Near-real-time detection over Spark: packs by pixel, in batches or as a stream's state.

A pack travels as JSON text: readable by any version, and never unpickled.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.operators import kernels, lockstep, nrt
from chronotile.schema import BANDS, validate

#: Observations that may wait in a pack with a model.
MOST_CONSE = 8
#: Neighbouring pixels whose packs are a group of a stream's state.
TOGETHER = 128
PACK = "pos long, nrt_mode smallint, n_segments int, last_break int, num_obs int, conse_last int, late int, pack string"


def _row(pos: int, pack: nrt.Pack) -> tuple:
    m = pack.model or {}
    return pos, pack.nrt_mode, len(pack.segments), pack.segments[-1]["t_break"] if pack.segments else 0, m.get("num_obs", 0), m.get("conse_last", 0), pack.late, pack.dumps()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int16(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    names = [x.split()[0] for x in PACK.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _checked(parameters: dict) -> bool:
    """Raise ValueError for a parameter out of its range; whether bands are scaled as Collection 2."""
    if parameters.get("conse", 6) > MOST_CONSE:
        raise ValueError(f"conse = {parameters['conse']!r} is too large; a pack keeps {MOST_CONSE} observations at most")
    names = {"gate": "gate_tcg", "predictability": "predictability_tcg", "collection2": "b_c2"}
    validate(**{names.get(k, k): v for k, v in parameters.items()})
    return parameters.get("collection2", False)


def detect(obs: DataFrame, **parameters) -> DataFrame:
    """The pack of every pixel of obs."""
    collection2 = _checked(parameters)

    def run(batches):
        for batch in batches:
            for _, keys, series in kernels._portions(batch):
                yield _batch([_row(*one) for one in zip(keys, lockstep.update([nrt.Pack() for _ in keys], series, **parameters), strict=True)])

    return kernels.packed(obs, collection2).mapInArrow(run, PACK)


def update(packs: DataFrame, obs: DataFrame, **parameters) -> DataFrame:
    """Packs with new observations taken in; pixels without either keep or get theirs."""
    both = packs.select("pos", "pack").join(kernels.packed(obs, _checked(parameters)), "pos", "full")

    def run(batches):
        for batch in batches:
            old = batch.column("pack")
            for numbers, keys, series in kernels._portions(batch):
                packs = [nrt.Pack.loads(old[k].as_py()) if old[k].is_valid else nrt.Pack() for k in numbers]
                fresh = [k for k, n in enumerate(numbers) if batch.column("date")[n].is_valid]
                for k, pack in zip(fresh, lockstep.update([packs[k] for k in fresh], [series[k] for k in fresh], **parameters), strict=True):
                    packs[k] = pack
                yield _batch([_row(*one) for one in zip(keys, packs, strict=True)])

    return both.mapInArrow(run, PACK)


def identify(packs: DataFrame, **parameters) -> DataFrame:
    """(pos, disturbed_on): the first day of a disturbance under way, 0 for none."""
    validate(**parameters)

    def run(batches):
        for batch in batches:
            days = [nrt.identify(nrt.Pack.loads(t), **parameters)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(days, pa.int32())], names=["pos", "disturbed_on"])

    return packs.select("pos", "pack").mapInArrow(run, "pos long, disturbed_on int")


def _take_in(key, frames, state, parameters):
    rows = pd.concat(list(frames)).sort_values(["date", "seq"], kind="stable")
    kept = json.loads(state.get[0]) if state.exists else {}
    pixels = [(str(int(pos)), g["date"].to_numpy(), g[BANDS].to_numpy().T, g["qa"].to_numpy()) for pos, g in rows.groupby("pos", dropna=False)]
    out = []
    for numbers in lockstep.portions([len(p[1]) for p in pixels]):
        old = [nrt.Pack.loads(kept[pixels[k][0]]) if pixels[k][0] in kept else nrt.Pack() for k in numbers]
        for k, pack in zip(numbers, lockstep.update(old, [pixels[k][1:] for k in numbers], **parameters), strict=True):
            out.append(_row(int(pixels[k][0]), pack))
            kept[pixels[k][0]] = out[-1][-1]
    state.update((json.dumps(kept),))
    yield _batch(out).to_pandas()


def stream(obs: DataFrame, **parameters) -> DataFrame:
    """As a streaming query: of each pixel with new observations the pack after each batch. Observations
    that are not later than a pixel's last one are counted and left out. TOGETHER neighbours are one group, whose
    state is the text of their packs by pixel, so that their observations are taken in in step."""
    _checked(parameters)

    def take_in(key, frames, state):
        yield from _take_in(key, frames, state, parameters)

    rows = obs.filter("qa < 255").withColumn("together", F.floor(F.col("pos") / TOGETHER))
    return rows.groupBy("together").applyInPandasWithState(take_in, PACK, "packs string", "update", "NoTimeout")


def latest(updates: DataFrame) -> DataFrame:
    """Of what a stream wrote (batch: its number, as that of the folder) the newest pack of each pixel."""
    return updates.groupBy("pos").agg(F.max_by(F.struct("nrt_mode", "n_segments", "last_break", "num_obs"), "batch").alias("m")).select("pos", "m.*")


_SEGMENT = "t_start: int, t_break: int, num_obs: int, coefs: array<array<double>>, rmse: array<double>, magnitude: array<double>"
_MODEL = "t_start: int, num_obs: int, coefs: array<array<double>>, covariance: array<array<array<double>>>, h: array<double>, rmse_sum: array<double>, day: int, norm_cm: double, cm_angle: double, conse_last: int"
STATE = f"nrt_mode: smallint, min_rmse: array<int>, segments: array<struct<{_SEGMENT}>>, model: struct<{_MODEL}>, days: array<int>, values: array<array<double>>, late: int"


def nested(packs: DataFrame) -> DataFrame:
    """Packs with their state as columns and structs, as they may be stored and queried."""
    return packs.select("pos", F.from_json("pack", f"struct<{STATE}>").alias("s")).select("pos", "s.*")


def packed_again(rows: DataFrame) -> DataFrame:
    """(pos, pack) of nested() rows, to be updated."""
    names = [x.split(":")[0] for x in ("nrt_mode:", "min_rmse:", "segments:", "model:", "days:", "values:", "late:")]
    return rows.select("pos", F.to_json(F.struct(*names)).alias("pack"))


def change_magnitude(packs: DataFrame) -> DataFrame:
    """(pos, magnitude): by band the median difference from the model over the newest observations that leave it; zeros for none."""
    rows = nested(packs).select("pos", F.coalesce("model.conse_last", F.lit(0)).alias("n"), F.col("model.coefs").alias("c"), "days", "values")
    rows = rows.select("pos", "n", "c", F.expr("IF(n > 0, slice(days, -n, n), array())").alias("days"), F.expr("IF(n > 0, slice(values, -n, n), array())").alias("values"))

    def band(b: int):
        c = F.col("c")[b]
        off = F.zip_with("values", "days", lambda v, d: v[b] - (c[0] + c[1] * d / 10000.0 + sum(c[2 * k] * F.cos(d * (k * C.W)) + c[2 * k + 1] * F.sin(d * (k * C.W)) for k in (1, 2))))
        s = F.array_sort(off)
        middle = (F.get(s, F.floor((F.col("n") - 1) / 2).cast("int")) + F.get(s, F.floor(F.col("n") / 2).cast("int"))) / 2
        return F.when(F.col("n") > 0, middle).otherwise(0.0)

    return rows.select("pos", F.array(*[band(b) for b in range(6)]).alias("magnitude"))
