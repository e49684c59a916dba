"""Every registered query of the engine against its SQL, or, without SQL, for rows and a stable schema."""

import math
import os

import duckdb
import pytest

from chronotile.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else v.item() if hasattr(v, "item") else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sql, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), sql.execute(registry.oracle_sql()[name]).fetchdf()
    assert len(got) and _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.columns and len(df.collect())


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert {r["status"] for r in rows} == {"ok"}
    jumps = {r["pos"] for r in rows if r["t_break"] and abs(r["t_break"] - 729700) < 120 and r["change_prob"] == 100}
    assert {p for p in range(1, 11) if p % 3 == 0} <= jumps


def test_stream_equals_batch(spark):
    batch = {r["pos"]: (r["nrt_mode"], r["n_segments"], r["last_break"], r["num_obs"]) for r in registry.queries()["sccd_update"](spark, DATA).collect()}
    stream = {r["pos"]: (r["nrt_mode"], r["n_segments"], r["last_break"], r["num_obs"]) for r in registry.queries()["sccd_stream"](spark, DATA).collect()}
    assert stream == batch


@pytest.fixture(scope="module")
def series(spark):
    """By pixel (days, bands, qa) of the observations of ten pixels, in their order."""
    from chronotile.schema import BANDS
    from chronotile.sources import adapters

    rows = adapters.obs(spark, DATA).toPandas().sort_values(["pos", "date", "seq"])
    return {int(p): (g["date"].to_numpy(), g[BANDS].to_numpy().T, g["qa"].to_numpy()) for p, g in rows.groupby("pos")}


def test_cold_values(spark, series):
    """Every pixel's segments, by Spark and by the kernel alone, and from the pass that makes magnitudes too."""
    from chronotile.operators import cold, kernels
    from chronotile.sources import adapters

    got = {}
    for r in registry.queries()["cold"](spark, DATA).collect():
        got.setdefault(r["pos"], []).append(r)
    assert set(got) == set(series)
    for pos, args in series.items():
        want = cold.detect(*args)
        mine = sorted(got[pos], key=lambda r: r["seg"] if r["seg"] is not None else -1)
        assert [(r["t_start"], r["t_end"], r["t_break"], r["num_obs"], r["category"], r["change_prob"]) for r in mine if r["seg"] is not None] == [(s.t_start, s.t_end, s.t_break, s.num_obs, s.category, s.change_prob) for s in want]
        for r, s in zip((r for r in mine if r["seg"] is not None), want, strict=True):
            assert all(abs(x - y) <= 1e-3 + 1e-5 * abs(y) for a, b in zip(r["coefs"], s.coefs, strict=True) for x, y in zip(a, b, strict=True))
    both = kernels.detect_both(adapters.obs(spark, DATA), 728000, 50, 60).persist()
    again = sorted((r["pos"], r["seg"], r["t_break"]) for r in kernels.segments_of(both).collect() if r["seg"] is not None)
    assert again == sorted((r["pos"], r["seg"], r["t_break"]) for rows in got.values() for r in rows if r["seg"] is not None)
    cm = sorted(map(tuple, kernels.magnitudes_of(both).collect()))
    assert cm == sorted(map(tuple, registry.queries()["cold_magnitudes"](spark, DATA).collect()))
    for pos, args in series.items():
        m = cold.Magnitudes(728000, 60, 50)
        cold.detect(*args, magnitudes=m)
        assert [x[2] for x in cm if x[0] == pos] == m.cm.tolist() and [x[3] for x in cm if x[0] == pos] == m.day.tolist()


def test_obcold_values(spark, series):
    from chronotile.operators import cold

    rows = [r for r in registry.queries()["obcold"](spark, DATA).collect() if r["seg"] is not None]
    for pos, args in series.items():
        assert [(r["t_start"], r["t_end"], r["t_break"]) for r in sorted(rows, key=lambda r: r["seg"]) if r["pos"] == pos] == [(s.t_start, s.t_end, s.t_break) for s in cold.reconstruct(*args, [729701])]


def test_sccd_values(spark, series):
    """Packs of a query are those of the kernel over each pixel; an update over two parts leads to the same breaks."""
    from chronotile.operators import nrt

    named = {n: {r["pos"]: r for r in registry.queries()[n](spark, DATA).collect()} for n in ("sccd", "sccd_update", "sccd_identify")}
    for pos, (days, bands, qa) in series.items():
        pack = nrt.detect(days, bands, qa)
        r = named["sccd"][pos]
        assert (r["nrt_mode"], r["n_segments"], r["num_obs"]) == (pack.nrt_mode, len(pack.segments), (pack.model or {}).get("num_obs", 0))
        early = days < 729900
        cut = nrt.update(nrt.detect(days[early], bands[:, early], qa[early]), days[~early], bands[:, ~early], qa[~early])
        r = named["sccd_update"][pos]
        assert (r["nrt_mode"], r["n_segments"], r["last_break"]) == (cut.nrt_mode, len(cut.segments), cut.segments[-1]["t_break"] if cut.segments else 0)
        assert named["sccd_identify"][pos]["disturbed_on"] == nrt.identify(pack)[1]
    assert any(r["n_segments"] for r in named["sccd"].values())


def test_segmented_maps_values(spark):
    """Labels of whole maps by Spark are those of the arrays."""
    import numpy as np

    from chronotile.operators import raster

    maps = registry._raster_maps(spark, DATA).toPandas()
    for name, work in raster.METHODS.items():
        got = registry.queries()[f"segment_{name}"](spark, DATA).toPandas()
        for k, g in maps.groupby("cm_idx"):
            shape = (-(-int(maps["pos"].max()) // 50), 50)
            cm, day = (np.full(shape, -9999.0) for _ in range(2))
            cm.ravel()[g["pos"] - 1], day.ravel()[g["pos"] - 1] = g["cm"], g["cm_date"]
            s1, s2, means = work(cm, day)
            mine = got[got["cm_idx"] == k].sort_values("pos")
            assert mine["s1"].tolist() == s1.ravel()[mine["pos"] - 1].tolist() and mine["s2"].tolist() == s2.ravel()[mine["pos"] - 1].tolist()
            assert np.allclose(mine["cm"], [means.get(int(x), -9999.0) for x in mine["s1"]])


def test_objects_with_classes(spark):
    """With classes of the year before, an object of a class with a higher threshold no longer counts as changed."""
    from chronotile.plans import workflows
    from chronotile.schema import Grid
    from chronotile.sources import adapters

    o = adapters.obs(spark, DATA).persist()
    pixels = o.select("pos").distinct()
    n = {}
    for cls in (None, 1, 2):
        classes = None if cls is None else pixels.selectExpr("pos", "explode(sequence(1990, 2002)) as year", f"cast({cls} as smallint) as cls")
        rows = workflows.object_based(o, Grid(n_rows=1, n_cols=10), 728000, 45, 60, classes=classes).collect()
        n[cls] = sum(r["t_break"] > 0 for r in rows if r["t_break"] is not None)
    assert n[None] <= n[1] and n[2] <= n[1]
    o.unpersist()


def test_nested_states_and_features_now(spark):
    """Packs as structs and back are the same states; features at a day are those of the models."""
    import numpy as np

    from chronotile.operators import nrt
    from chronotile.plans import workflows
    from chronotile.streaming import nrt as packs

    rows = registry.queries()["sccd"](spark, DATA).persist()
    before = {r["pos"]: nrt.Pack.loads(r["pack"]) for r in rows.collect()}
    again = {r["pos"]: nrt.Pack.loads(r["pack"]) for r in packs.packed_again(packs.nested(rows)).collect()}
    for pos, a in before.items():
        b = again[pos]
        assert (a.nrt_mode, a.days, a.late, len(a.segments)) == (b.nrt_mode, b.days, b.late, len(b.segments)) and (a.model is None) == (b.model is None)
        assert a.model is None or all(np.allclose(a.model[k], b.model[k]) for k in a.model)
    for r in packs.change_magnitude(rows).collect():
        assert np.allclose(r["magnitude"], nrt.change_magnitude(before[r["pos"]]))
    days, bands, qa = (np.arange(728000, 730400, 8), *(np.array([500, 700, 600, 3000, 1800, 900, 2900.0])[:, None] + np.random.default_rng(3).normal(0, 20, (7, 300)) for _ in range(1)), np.zeros(300, int))
    bands[:6, -5:] += 1500
    left = nrt.detect(days, np.round(bands), qa)
    assert left.model["conse_last"] == 5
    one = spark.createDataFrame([(1, left.dumps())], "pos long, pack string")
    assert np.allclose(packs.change_magnitude(one).first()["magnitude"], nrt.change_magnitude(left)) and min(nrt.change_magnitude(left)) > 1000
    day = 730500
    for r in workflows.features_now(rows, day).collect():
        m = before[r["pos"]].model
        if m:
            c = np.array(m["coefs"])
            assert np.allclose(np.array(r["f"]).reshape(7, 3)[:6], np.column_stack([c[:, 0] + c[:, 1] * day / 10000, c[:, 2], c[:, 3]]))
        else:
            assert set(r["f"]) == {-9999.0}
    rows.unpersist()
