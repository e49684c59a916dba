"""Detection over many pixels in step against the detectors of single pixels, and its cost."""

import time

import numpy as np
import pytest

from chronotile.operators import cold, lockstep, nrt
from tests.test_kernels import series


def pixels(n: int, seed: int = 5):
    """Series of many kinds: changes, clouds, snow, gaps, several observations a day, short ones, none, bands that stand still."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        days, bands, qa = series(int(r.integers(200, 320)), int(r.integers(6, 12)), int(r.integers(60, 190)) if k % 3 == 0 else None, seed=k)
        if k % 9 == 0:
            bands[:6, 190:] -= 400
        qa[r.random(len(qa)) < 0.1] = r.choice([1, 2, 3, 4, 255])
        hazy = r.random(len(qa)) < 0.04
        bands[:6, hazy] += 2500
        if k % 7 == 1:
            days = days + np.where(np.arange(len(days)) > 120, 500, 0)
        if k % 7 == 2:
            days[1::9] = days[::9][: len(days[1::9])]
        if k % 11 == 3:
            bands[3] = 3000
        if k % 11 == 4:
            cut = int(r.integers(0, 60))
            days, bands, qa = days[:cut], bands[:, :cut], qa[:cut]
        if k % 11 == 5:
            qa[:] = 3
        out.append((days, bands, qa))
    return out


def plain(segments):
    return [(s.t_start, s.t_end, s.t_break, s.num_obs, s.category, s.change_prob) for s in segments]


@pytest.mark.parametrize("conse", [1, 4, 6])
def test_cold_in_step_is_cold(conse):
    given = pixels(66)
    noted = [cold.Magnitudes(728000, 60, 60) for _ in given]
    got = lockstep.detect(given, conse=conse, magnitudes=noted)
    kinds = set()
    for args, mine, m in zip(given, got, noted, strict=True):
        want = cold.Magnitudes(728000, 60, 60)
        with np.errstate(all="ignore"):
            try:
                segments = cold.detect(*args, conse=conse, magnitudes=want)
            except ValueError as e:  # a band that stands still has no error to be held against
                assert str(mine) == str(e)
                continue
        assert plain(mine) == plain(segments)
        kinds |= {(len(segments) > 1, s.category) for s in segments}
        for a, b in zip(mine, segments, strict=True):
            for c in ("coefs", "rmse", "magnitude"):
                assert np.allclose(getattr(a, c), getattr(b, c), rtol=1e-6, atol=1e-5, equal_nan=True)
        assert m.cm.tolist() == want.cm.tolist() and m.day.tolist() == want.day.tolist()
    assert len(kinds) > 3


def test_a_pixel_that_fails_fails_alone():
    a, b = series(), series(250, jump_at=120)
    got = lockstep.detect([a, (a[0][:-1], *a[1:]), b])
    assert isinstance(got[1], ValueError) and plain(got[0]) == plain(cold.detect(*a)) and plain(got[2]) == plain(cold.detect(*b))
    assert lockstep.detect([]) == []


def test_portions_are_bounded():
    lengths = [5, 1000, 7, 300, 299, 0]
    got = lockstep.portions(lengths, 600)
    assert sorted(k for p in got for k in p) == list(range(6))
    assert all(len(p) == 1 or len(p) * max(lengths[k] for k in p) <= 600 for p in got)


def test_cold_of_many_pixels_costs_a_part_of_single_ones():
    given = [series(300, 8, 150 if k % 3 == 0 else None, seed=k) for k in range(80)]
    t = time.process_time()
    for args in given[:20]:
        cold.detect(*args)
    single = (time.process_time() - t) * 4
    t = time.process_time()
    lockstep.detect(given)
    assert time.process_time() - t < single / 2.5


def near(a, b) -> bool:
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(near(a[k], b[k]) for k in a)
    if isinstance(a, list) and a and isinstance(a[0], dict):
        return len(a) == len(b) and all(map(near, a, b))
    return a is b or (a is not None and b is not None and np.shape(a) == np.shape(b) and np.allclose(a, b, rtol=1e-6, atol=1e-6, equal_nan=True))


@pytest.mark.parametrize("conse", [1, 4, 6])
def test_packs_in_step_are_packs(conse):
    """From nothing, and from packs of every mode."""
    given = pixels(66)
    first = lockstep.update([nrt.Pack() for _ in given], [(d[:150], b[:, :150], q[:150]) for d, b, q in given], conse=conse)
    want = [nrt.detect(d[:150], b[:, :150], q[:150], conse=conse) for d, b, q in given]
    assert all(near(vars(a), vars(b)) for a, b in zip(first, want, strict=True))
    rest = [(d[140:], b[:, 140:], q[140:]) for d, b, q in given]
    then = [nrt.update(p, *r, conse=conse) for p, r in zip(first, rest, strict=True)]
    assert all(near(vars(a), vars(b)) for a, b in zip(lockstep.update(first, rest, conse=conse), then, strict=True))
    assert sum(bool(p.segments) for p in then) > 3 and len({p.nrt_mode for p in then}) > 2 and any(p.late for p in then)
    assert lockstep.update([], []) == []


def test_packs_of_many_pixels_cost_a_part_of_single_ones():
    given = [series(300, 8, 150 if k % 3 == 0 else None, seed=k) for k in range(120)]
    t = time.process_time()
    for args in given[:20]:
        nrt.detect(*args)
    single = (time.process_time() - t) * 6
    t = time.process_time()
    lockstep.update([nrt.Pack() for _ in given], given)
    assert time.process_time() - t < single / 2


def test_a_stream_takes_neighbours_in_together():
    """One call for a group of pixels; packs, late observations and pixels that come later are those of single pixels."""
    import pandas as pd

    from chronotile.schema import BANDS
    from chronotile.streaming import nrt as packs

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def frame(pos, days, bands, qa):
        return pd.DataFrame({"pos": pos, "seq": np.arange(len(days)), "date": days} | dict(zip(BANDS, bands, strict=True)) | {"qa": qa})

    given, state, want = [series(seed=k, jump_at=180 if k else None) for k in range(4)], State(), {}
    for cut, pixels_of in ((slice(0, 160), (0, 1)), (slice(150, 300), (1, 2, 3))):
        parts = {k: (given[k][0][cut], given[k][1][:, cut], given[k][2][cut]) for k in pixels_of}
        (got,) = packs._take_in((0,), iter([frame(k, *p) for k, p in parts.items()]), state, {})
        for k, p in parts.items():
            want[k] = nrt.update(want.get(k, nrt.Pack()), *p)
        assert sorted(got["pos"]) == sorted(parts)
        assert all(near(vars(nrt.Pack.loads(t)), vars(want[k])) for k, t in zip(got["pos"], got["pack"], strict=True))
    assert want[1].late == 10 and want[1].segments


def test_first_of_a_day_needs_no_window_by_day(spark):
    from chronotile.operators import obs

    rows = spark.createDataFrame([(1, None, 1), (1, None, 2), (1, 5, 2), (1, 5, 1), (1, 6, 3), (2, 6, 1), (2, 7, 0), (2, 7, 4), (None, 7, 1)], "pos long, date int, seq int")
    got = obs.one_a_day(rows)
    assert set(map(tuple, got.collect())) == {(1, None, 1), (1, 5, 1), (1, 6, 3), (2, 6, 1), (2, 7, 0), (None, 7, 1)} and got.count() == 6
    assert "row_number" not in got._jdf.queryExecution().toString()


def test_clear_observations_are_not_judged_in_a_filter(spark):
    """A filter's conditions would each compute the bands anew where these are expressions over a table."""
    from chronotile.operators import obs
    from chronotile.schema import BANDS

    rows = spark.range(40).selectExpr("id as pos", "1 as seq", "5 as date", *[f"cast(case when id % 7 = {k} then 20000 when id = 30 then null else 500 + id % 9 end as int) as {b}" for k, b in enumerate(BANDS[:6])], "2900 as thermal", "cast(id % 4 as int) as qa")
    got = obs.clear(rows)
    assert got.columns == rows.columns
    assert sorted(r["pos"] for r in got.collect()) == [k for k in range(40) if k % 7 == 6 and k % 4 < 2 and k != 30]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not any("Filter" in line and "10000" in line for line in plan.splitlines())
