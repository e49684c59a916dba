"""Near-real-time change detection: a pixel's state is taken forward by new observations.

A stable window of observations starts a state-space model of each of six bands (level, slope, an annual and
a semi-annual pair), a Kalman filter with a daily step. The next `conse` observations wait until
they are all in; if all of them are far from the model in one direction, a segment ends. What isn't
absorbed yet is kept in the state, so batches of any cut lead to the same states.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np

from chronotile.functions import harmonic as H
from chronotile.operators.cold import first_of_day, usable

VOID, MONITOR, QUEUE, MONITOR_SNOW, QUEUE_SNOW, MONITOR_TO_QUEUE, UNCONFIRMED = 0, 1, 2, 3, 4, 5, 10
BANDS, DETECT = 6, slice(1, 6)
TRAIN, SNOW_SHARE, NOISE, ANGLE, MOST_QUEUED, BACK_DAYS = 18, 0.75, 25.7448, 45.0, 240, 15
#: Counts told to the outside include the first observation that waits.
AHEAD = 1
_W = H.W


def _rotation(w: float) -> np.ndarray:
    return np.array([[np.cos(w), np.sin(w)], [-np.sin(w), np.cos(w)]])


_STEP = np.zeros((6, 6))
_STEP[:2, :2] = [[1, 1], [0, 1]]
_STEP[2:4, 2:4], _STEP[4:, 4:] = _rotation(_W), _rotation(2 * _W)
_SEEN = np.array([1.0, 0, 1, 0, 1, 0])
_NOISE = np.diag([0.1, 0.1 / 1e6, 0.1, 0.1, 0.1, 0.1])
_START = np.diag([1e4, 1e4 / 1e6, 1e4, 1e4, 1e4, 1e4])


def to_state(coefs: np.ndarray, day: float) -> np.ndarray:
    """Bands x 6 coefficients to bands x 6 states at a day."""
    out = np.empty_like(coefs[:, :6])
    out[:, 0], out[:, 1] = coefs[:, 0] + coefs[:, 1] * day / H.SLOPE_SCALE, coefs[:, 1] / H.SLOPE_SCALE
    for k in (1, 2):
        out[:, 2 * k : 2 * k + 2] = coefs[:, 2 * k : 2 * k + 2] @ _rotation(k * _W * day).T
    return out


def to_coefs(state: np.ndarray, day: float) -> np.ndarray:
    out = np.empty_like(state)
    out[:, 1] = state[:, 1] * H.SLOPE_SCALE
    out[:, 0] = state[:, 0] - state[:, 1] * day
    for k in (1, 2):
        out[:, 2 * k : 2 * k + 2] = state[:, 2 * k : 2 * k + 2] @ _rotation(k * _W * day)
    return out


def predict(coefs: np.ndarray, days) -> np.ndarray:
    full = np.zeros((len(coefs), 8))
    full[:, :6] = coefs
    return H.predict(full, np.asarray(days))


#: Of n days: the step, and the noise that they add up to. Longer gaps are made of these.
_STEPS, _NOISES = [np.eye(6)], [np.zeros((6, 6))]
for _ in range(400):
    _STEPS.append(_STEP @ _STEPS[-1])
    _NOISES.append(_STEP @ _NOISES[-1] @ _STEP.T + _NOISE)


class Filter:
    """Kalman filters of all bands, side by side."""

    def __init__(self, coefs: np.ndarray, day: int, noise: np.ndarray, covariance: np.ndarray | None = None) -> None:
        self.state, self.day, self.noise = to_state(coefs, day), day, np.maximum(noise, 1e-6)
        self.p = np.repeat(_START[None], len(coefs), 0) if covariance is None else covariance

    def advance(self, day: int) -> None:
        left = int(day - self.day)
        while left > 0:
            n = min(left, len(_STEPS) - 1)
            self.state = self.state @ _STEPS[n].T
            self.p = _STEPS[n] @ self.p @ _STEPS[n].T + _NOISES[n]
            left -= n
        self.day = day

    def absorb(self, day: int, y: np.ndarray) -> np.ndarray:
        """The innovations of a day's observation, which then corrects the states."""
        self.advance(day)
        v = y - self.state @ _SEEN
        pz = self.p @ _SEEN
        f = pz @ _SEEN + self.noise
        gain = pz / f[:, None]
        self.state = self.state + gain * v[:, None]
        self.p = self.p - gain[:, :, None] * pz[:, None, :]
        return v

    @property
    def coefs(self) -> np.ndarray:
        return to_coefs(self.state, self.day)


@dataclass
class Pack:
    """A pixel's state."""

    nrt_mode: int = VOID
    min_rmse: list = field(default_factory=list)
    segments: list = field(default_factory=list)  # t_start, t_break, num_obs, coefs 6x6, rmse, magnitude
    model: dict | None = None  # t_start, num_obs, coefs, covariance, h, rmse_sum, day, norm_cm, cm_angle, conse_last
    days: list = field(default_factory=list)  # not absorbed yet (with a model: the newest, at most conse - 1)
    values: list = field(default_factory=list)
    late: int = 0  # observations not later than one seen before, which were left out

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Pack:
        return cls(**json.loads(text))


def update(pack: Pack, days, bands, qa, t_cg: float = 15.0863, conse: int = 6, gate: float = 9.236, predictability: float = 9.236, collection2: bool = False) -> Pack:
    """A new pack with the observations taken in. bands: 7 x n, raw; days in any order."""
    new, run = start(pack, days, bands, qa, t_cg, conse, gate, predictability, collection2)
    if run:
        run.go()
    return new


def start(pack: Pack, days, bands, qa, t_cg: float = 15.0863, conse: int = 6, gate: float = 9.236, predictability: float = 9.236, collection2: bool = False) -> tuple[Pack, Run | None]:
    """A new pack, and the run that takes the observations in where it isn't done."""
    days, bands, qa = np.asarray(days, np.int64), np.asarray(bands, float), np.asarray(qa)
    order = np.argsort(days, kind="stable")
    days, bands, qa = days[order], bands[:, order], qa[order]
    new = Pack.loads(pack.dumps())
    ok = usable(bands, qa, collection2)
    clear, snow = ok & (qa < 2), ok & (qa == 3)
    if new.nrt_mode == VOID and clear.sum() + snow.sum() and snow.sum() / (snow.sum() + clear.sum() + 0.01) >= SNOW_SHARE:
        new.nrt_mode = QUEUE_SNOW
    snowy = new.nrt_mode in (MONITOR_SNOW, QUEUE_SNOW)
    take = clear | snow if snowy else clear
    x, y = days[take], bands[:BANDS, take]
    first = first_of_day(x)
    x, y = x[first], y[:, first]
    last = new.days[-1] if new.days else new.model["day"] if new.model else -1
    fresh = x > last
    new.late += int((~fresh).sum())
    x, y = x[fresh], y[:, fresh]
    if not new.min_rmse and len(x) > 1 and not snowy:
        new.min_rmse = [int(v) for v in H.variability(y)]
    x = np.concatenate([np.array(new.days, np.int64), x])
    y = np.concatenate([np.array(new.values, float).reshape(-1, BANDS).T, y], axis=1)
    if snowy:
        _snow(new, x, y)
        return new, None
    return new, Run(new, x, y, t_cg, conse, gate, predictability) if len(x) else None


def detect(days, bands, qa, **parameters) -> Pack:
    return update(Pack(), days, bands, qa, **parameters)


def whole_years(x: np.ndarray) -> int:
    """Days of the whole years that a window takes."""
    return int(round(int(np.ceil((x[-1] - x[0] + 1) / H.YEAR)) * H.YEAR))


def _model(coefs, rmse, x, y) -> tuple[Filter, np.ndarray]:
    """The filter after the window has run twice, first shifted back by whole years; and its squared innovations."""
    shift = whole_years(x)
    kf = Filter(coefs, int(x[0]) - shift, rmse**2)
    for d, v in zip(x - shift, y.T, strict=True):
        kf.absorb(int(d), v)
    kf.state, kf.day = to_state(coefs, int(x[0])), int(x[0])
    squares = np.zeros(len(coefs))
    for d, v in zip(x, y.T, strict=True):
        squares += np.floor(kf.absorb(int(d), v) ** 2)
    return kf, squares


def _store(pack: Pack, kf: Filter, start: int, n: int, squares: np.ndarray, extra: dict) -> None:
    pack.model = {"t_start": int(start), "num_obs": int(n) + AHEAD, "coefs": kf.coefs.tolist(), "covariance": kf.p.tolist(), "h": kf.noise.tolist(), "rmse_sum": squares.tolist(), "day": int(kf.day)} | extra


def _snow(pack: Pack, x: np.ndarray, y: np.ndarray) -> None:
    if pack.model is None:
        pack.days, pack.values = x[-MOST_QUEUED:].tolist(), y[:, -MOST_QUEUED:].T.tolist()
        if len(x) < TRAIN:
            return
        coefs, rmse, _ = H.lasso(x, y, 6)
        kf, squares = _model(coefs[:, :6], rmse, x, y)
        n, start = len(x), x[0]
    else:
        m = pack.model
        kf = Filter(np.array(m["coefs"]), m["day"], np.array(m["h"]), np.array(m["covariance"]))
        squares, n, start = np.array(m["rmse_sum"]), m["num_obs"] - AHEAD, m["t_start"]
        for d, v in zip(x, y.T, strict=True):
            squares = np.floor(squares + kf.absorb(int(d), v) ** 2)
            n += 1
    _store(pack, kf, start, n, squares, {"norm_cm": -9999.0, "cm_angle": -9999.0, "conse_last": 0})
    pack.days, pack.values, pack.nrt_mode = [], [], MONITOR_SNOW


class Run:
    def __init__(self, pack, x, y, t_cg, conse, gate, predictability) -> None:
        self.pack, self.x, self.y = pack, x, y
        self.t_cg, self.conse, self.gate, self.predictability = t_cg, conse, gate, predictability
        self.least = np.array(pack.min_rmse or [0] * BANDS, float)
        self.trained = pack.model is not None
        self.at = 0  # observations before it are absorbed (or, untrained, before the window)
        if self.trained:
            m = pack.model
            self.kf = Filter(np.array(m["coefs"]), m["day"], np.array(m["h"]), np.array(m["covariance"]))
            self.squares, self.n, self.start = np.array(m["rmse_sum"]), m["num_obs"] - AHEAD, m["t_start"]

    def go(self) -> None:
        broke = False
        while True:
            if self.trained:
                while self.trained and len(self.x) - self.at >= self.conse:
                    self.step()
                if self.trained:
                    break
                broke = True
            if not self.train():
                break
            self.kf, self.squares = _model(*self.window)
        self.close(broke)

    def train(self) -> bool:
        """Find a stable window from `at` on, of which _model() makes the filter; what lies before is left out."""
        begin, i = self.at, self.at + TRAIN
        while i + self.conse <= len(self.x):
            x, y = self.x, self.y
            if (x[i - 1] - x[begin]) / H.YEAR < 1:
                i += 1
                continue
            if np.diff(x[begin:i]).max() > H.YEAR:
                begin, i = begin + 1, i + 1
                continue
            upto = i + self.conse
            bad = np.flatnonzero(H.screen(x[begin:upto], y[1, begin:upto], y[4, begin:upto], self.least[1], self.least[4])[: i - begin]) + begin
            left = np.delete(x, bad)
            n = i - begin - len(bad)
            if n < TRAIN or (left[begin + n - 1] - left[begin]) / H.YEAR < 1:
                i += 1
                continue
            self.x, self.y = left, np.delete(y, bad, axis=1)
            x, y, i = self.x, self.y, begin + n
            coefs, rmse, residuals = H.lasso(x[begin:i], y[:, begin:i], 6)
            scale = np.maximum(np.maximum(self.least, rmse), 1e-6)
            drift = np.abs(coefs[:, 1]) * (x[i - 1] - x[begin]) / H.SLOPE_SCALE
            off = (drift + np.maximum(np.abs(residuals[:, 0]), np.abs(residuals[:, -1]))) / scale
            if (off[DETECT] ** 2).sum() > self.t_cg:
                begin, i = begin + 1, i + 1
                continue
            begin = self.look_back(begin, coefs[:, :6], scale)
            x, y = self.x, self.y
            i = begin + int((x[begin:] <= left[i - 1]).sum())
            self.window = coefs[:, :6], rmse, x[begin:i], y[:, begin:i]
            self.n, self.start, self.at, self.trained = i - begin, int(x[begin]), i, True
            return True
        return False

    def look_back(self, begin: int, coefs, scale) -> int:
        stop, at = self.at, begin - 1
        while at >= stop:
            back = np.arange(at, at - min(at - stop + 1, self.conse), -1)
            normed = ((self.y[:, back] - predict(coefs, self.x[back])) / scale[:, None])[DETECT]
            size = (normed**2).sum(0)
            if size.min() > self.t_cg and H.mean_angle(normed) < ANGLE:
                break
            if size[0] > 30.8562:
                self.x, self.y = np.delete(self.x, at), np.delete(self.y, at, axis=1)
            begin, at = at, at - 1
        return begin

    def ahead(self):
        rmse = np.sqrt(self.squares / max(self.n - 6, 1))
        days = self.x[self.at : self.at + self.conse]
        seen = self.y[:, self.at : self.at + self.conse] - predict(self.kf.coefs, days)
        normed = (seen / np.maximum(np.maximum(self.least, rmse), 1e-6)[:, None])[DETECT]
        return seen, normed, (normed**2).sum(0), rmse

    def step(self) -> None:
        seen, normed, size, rmse = self.ahead()
        day = int(self.x[self.at])
        if size.min() > self.t_cg and H.mean_angle(normed) <= ANGLE:
            self.pack.segments.append({"t_start": self.start, "t_break": day, "num_obs": self.n + AHEAD, "coefs": self.kf.coefs.tolist(), "rmse": rmse.tolist(), "magnitude": np.median(seen, axis=1).tolist()})
            self.trained = False
        elif size[0] > NOISE:
            self.kf.advance(day)
            self.at += 1
        else:
            self.squares = np.floor(self.squares + self.kf.absorb(day, self.y[:, self.at]) ** 2)
            self.n, self.at = self.n + 1, self.at + 1

    def close(self, broke: bool) -> None:
        pack, x, y = self.pack, self.x, self.y
        if not self.trained:
            pack.days, pack.values = x[self.at :][-MOST_QUEUED:].tolist(), y[:, self.at :].T[-MOST_QUEUED:].tolist()
            pack.model = None
            span = pack.days[-1] - pack.days[0] if pack.days else 0
            if broke and pack.nrt_mode < UNCONFIRMED:
                pack.nrt_mode = MONITOR_TO_QUEUE
            elif pack.nrt_mode != MONITOR_TO_QUEUE:
                pack.nrt_mode = UNCONFIRMED + QUEUE
            if pack.nrt_mode == MONITOR_TO_QUEUE and span >= BACK_DAYS:
                pack.nrt_mode = UNCONFIRMED + QUEUE
            return
        left = x[self.at :]
        extra = {"norm_cm": -9999.0, "cm_angle": -9999.0, "conse_last": 0}
        confirmed = pack.nrt_mode != UNCONFIRMED + MONITOR
        if len(left):
            _, normed, size, _ = self.ahead()
            k = len(size)
            while k and size[k - 1] > self.gate:
                k -= 1
            if k < len(size):
                extra = {"norm_cm": float(size[k:].min()), "cm_angle": H.mean_angle(normed[:, k:]), "conse_last": len(size) - k}
            confirmed |= bool((size < self.predictability).mean() > 0.5)
        _store(pack, self.kf, self.start, self.n, self.squares, extra)
        pack.days, pack.values = left.tolist(), y[:, self.at :].T.tolist()
        pack.nrt_mode = MONITOR if confirmed else UNCONFIRMED + MONITOR


def identify(pack: Pack, dist_conse: int = 6, t_cg_scale100: float = 1508.6, t_angle_scale100: float = 4500, transform_mode: bool = True, t_cg_singleband_scale1000: float = 200) -> tuple[Pack, int]:
    """The day on which a disturbance under way began, or 0; a disturbed pixel becomes unconfirmed again."""
    m = pack.model
    if pack.nrt_mode != MONITOR or m is None or m["conse_last"] < dist_conse or m["norm_cm"] * 100 <= t_cg_scale100 or m["cm_angle"] * 100 >= t_angle_scale100:
        return pack, 0
    blue, green, red, nir, swir1, swir2 = change_magnitude(pack)
    bound = t_cg_singleband_scale1000
    if red < bound and nir > -bound and swir1 < bound:  # greening
        return pack, 0
    out = Pack.loads(pack.dumps())
    if transform_mode:
        out.nrt_mode = UNCONFIRMED + MONITOR
    return out, int(pack.days[-m["conse_last"]])


def change_magnitude(pack: Pack) -> list[float]:
    """By band the median difference from the model over the newest observations that leave it."""
    n = pack.model["conse_last"] if pack.model else 0
    if not n:
        return [0.0] * BANDS
    seen = np.array(pack.values[-n:]).T - predict(np.array(pack.model["coefs"]), pack.days[-n:])
    return np.median(seen, axis=1).tolist()
