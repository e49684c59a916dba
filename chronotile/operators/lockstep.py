"""Detection over many pixels at a time: the runs of cold.detect() and nrt.update() in step, one observation of every pixel a tick.

What takes place once or twice a segment (the search for a stable window, the look back, the last observations) is the run's
own; what takes place for every observation (models, errors of the season, windows of residuals) is arrays over all pixels.
Models come of running sums of products, so that a fit's cost doesn't grow with the segment.
"""

from __future__ import annotations

import numpy as np

from chronotile.functions import harmonic as H
from chronotile.operators import cold, nrt
from chronotile.operators.cold import CHANGE_ANGLE, DETECT, FULL, NOISE, TRAIN, Magnitudes, Segment

FAILURES = (ValueError, FloatingPointError, np.linalg.LinAlgError, IndexError)
#: Observations (pixels times the longest series) that are taken in step; 150 bytes each.
MOST = 1 << 17
_YEAR4, _AWAY = 1461, 1 << 30  # a year in quarters of a day; the key of what is outside of a model


def portions(lengths: list[int], most: int = MOST) -> list[list[int]]:
    """Numbers of series, those of like length together, so that a portion's padded size stays below `most` unless it is a single one."""
    out: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lengths.__getitem__):
        if not out or (len(out[-1]) + 1) * lengths[k] > most:
            out.append([])
        out[-1].append(k)
    return out


def detect(series, t_cg: float = 15.0863, conse: int = 6, collection2: bool = False, gap_days: float = 365.25, magnitudes: list[Magnitudes] | None = None) -> list:
    """Of each series (days, bands, qa) of a portion what cold.detect() returns, or the exception that it raises. magnitudes: one for each series."""
    out: list = []
    for k, (days, bands, qa) in enumerate(series):
        try:
            out.append(cold.start(days, bands, qa, t_cg, conse, collection2, gap_days, magnitudes[k] if magnitudes else None))
        except FAILURES as e:
            out.append(e)
    runs = []
    for k, run in enumerate(out):
        if isinstance(run, cold.Run):
            if (run.noise[DETECT] > 0).all():
                runs.append(k)
                continue
            try:  # a band that mostly stands still: its residuals may be held against no error at all, where rounding counts
                out[k] = run.segments()
            except FAILURES as e:
                out[k] = e
    if runs:
        for k, found in zip(runs, _Lockstep([out[k] for k in runs]).go(), strict=True):
            out[k] = found
    return out


def _solve(systems: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(systems, right[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        out = np.full_like(right, np.nan)
        for k in range(len(out)):
            try:
                out[k] = np.linalg.solve(systems[k], right[k])
            except np.linalg.LinAlgError:
                pass
        return out


def lasso(gram: np.ndarray, target: np.ndarray, b: np.ndarray, tried: np.ndarray, penalty: float = H.LAMBDA, rounds: int = 400) -> np.ndarray:
    """The optimum of each row: gram (rows x p x p), target and b, from which the descent starts (rows x p); of the rows in tried
    (True) the signs of b are tried first. As harmonic.lasso() finds it, all rows at once."""

    def settle(rows: np.ndarray) -> np.ndarray:
        """Solve for the signs in b; the rows for which they weren't the optimum's."""
        if not len(rows):
            return rows
        g, t = gram[rows], target[rows]
        signs = np.sign(b[rows])
        on = signs != 0
        systems = g * (on[:, :, None] & on[:, None, :])
        at = np.arange(g.shape[1])
        systems[:, at, at] += ~on
        best = _solve(systems, np.where(on, t - penalty * signs, 0.0))
        pull = t - np.matmul(best[:, None, :], g)[:, 0]
        good = (np.sign(best) == signs).all(1) & (on | (np.abs(pull) <= penalty * (1 + 1e-9))).all(1)
        b[rows[good]] = best[good]
        return rows[~good]

    left = np.concatenate([settle(np.flatnonzero(tried)), np.flatnonzero(~tried)])
    spent, each = 0, 3
    while len(left) and spent < rounds:
        g, t, c = gram[left], target[left], b[left]
        for _ in range(each):
            for j in range(g.shape[1]):
                new = t[:, j] + c[:, j] - np.einsum("rp,rp->r", g[:, j], c)
                c[:, j] = np.sign(new) * np.maximum(np.abs(new) - penalty, 0)
        b[left] = c
        left, spent, each = settle(left), spent + each, 12 if spent else 6
    return b


class _Lockstep:
    """Pixels whose runs stand in a segment. An observation is a row of 15: one, the terms (days counted from the
    pixel's first), the seven bands (less those of the pixel's first)."""

    def __init__(self, runs: list[cold.Run]) -> None:
        self.runs, self.t_cg, self.conse = runs, runs[0].t_cg, runs[0].conse
        n, most, w = len(runs), max(len(r.x) for r in runs), self.conse
        self.rows, self.x, self.season = np.zeros((n, most, 15)), np.zeros((n, most), np.int64), np.zeros((n, most), np.int32)
        self.index_bits = max(20, most.bit_length())
        key = np.int32 if self.index_bits == 20 else np.int64
        self.away, self.marks = key(_AWAY << (self.index_bits - 20)), np.arange(most, dtype=key)
        self.within = np.full((n, most), self.away, key)  # an observation's number where it is of the last fit
        self.n, self.i, self.begin, self.upto, self.span, self.df, self.t_end = np.zeros((7, n), np.int64)
        self.on, self.first = np.zeros(n, bool), np.zeros(n, bool)
        self.noise = np.array([r.noise for r in runs])
        self.ref, self.base = np.zeros(n), np.zeros((n, 7))
        self.sums, self.coefs, self.rmse = np.zeros((n, 15, 15)), np.zeros((n, 7, 8)), np.zeros((n, 7))
        self.seen, self.normed, self.size, self.angle = np.zeros((n, w, 7)), np.zeros((n, w, 5)), np.zeros((n, w)), np.zeros((n, max(w - 1, 1)))
        self.out: list = [r.found for r in runs]
        self.noted = runs[0].magnitudes is not None
        if self.noted:
            m = runs[0].magnitudes
            self.start, self.interval = m.start, m.interval
            self.cm, self.day = (np.stack([getattr(r.magnitudes, c) for r in runs]) for c in ("cm", "day"))
            for k, r in enumerate(runs):  # a look back notes in the same arrays
                r.magnitudes.cm, r.magnitudes.day = self.cm[k], self.day[k]

    def go(self) -> list:
        for k in range(len(self.runs)):
            self.guarded(k, self.seek, TRAIN, 0, 0)
        while True:
            at = np.flatnonzero(self.on)
            if not len(at):
                return self.out
            over = self.i[at] > self.n[at] - self.conse
            for k in at[over]:
                self.on[k] = False
                self.guarded(k, self.finish)
            at = at[~over]
            if len(at):
                self.tick(at)

    def guarded(self, k: int, do, *arguments) -> None:
        try:
            do(k, *arguments)
        except FAILURES as e:
            self.on[k], self.out[k] = False, e

    def seek(self, k: int, i: int, begin: int, dense: int) -> None:
        """To the next segment of pixel k, or its end."""
        run = self.runs[k]
        i, begin, _, trained = run.seek(i, begin, dense)
        if not trained:
            run.remainder(begin)
            return
        n = len(run.x)
        self.n[k], self.i[k], self.begin[k], self.on[k], self.first[k] = n, i, begin, True, True
        self.ref[k], self.base[k] = run.x[0], run.y[:, 0]
        self.x[k, :n], self.season[k, :n] = run.x, 4 * run.x % _YEAR4
        rows = self.rows[k, :n]
        rows[:, 0], rows[:, 1], rows[:, 2:8], rows[:, 8:] = 1, run.x - run.x[0], run.columns[:, 1:], (run.y - run.y[:, :1]).T
        self.within[k] = self.away
        self.within[k, begin:i] = self.marks[begin:i]
        self.sums[k] = rows[begin:i].T @ rows[begin:i]

    def segment(self, k: int) -> Segment:
        """The segment of pixel k; its run holds the observations that are left."""
        run, n = self.runs[k], self.n[k]
        rows = self.rows[k, :n]
        run.x, run.y = self.x[k, :n].copy(), rows[:, 8:].T + self.base[k][:, None]
        run.columns = np.column_stack([run.x, rows[:, 2:8]])
        run.seen, run.normed, run.size = self.seen[k].T, self.normed[k].T, self.size[k]
        coefs = self.coefs[k].copy()
        coefs[:, 0] += self.base[k] - coefs[:, 1] * self.ref[k]
        coefs[:, 1] *= H.SLOPE_SCALE
        found = Segment(int(run.x[self.begin[k]]), int(self.t_end[k]), 0, int(self.span[k]), int(self.df[k]), 0, coefs, self.rmse[k].copy())
        run.found.append(found)
        return found

    def finish(self, k: int) -> None:
        self.segment(k)
        self.runs[k].finish()

    def broken(self, k: int) -> None:
        i, found = int(self.i[k]), self.segment(k)
        found.t_break, found.change_prob, found.magnitude = int(self.x[k, i]), 100, np.median(self.seen[k], axis=0)
        self.on[k] = False
        self.seek(k, i + 1, i, i)

    def fit(self, at: np.ndarray, df: int) -> None:
        """Models of df coefficients of the pixels' observations from begin to below i."""
        p, n, s = df - 1, (self.i[at] - self.begin[at]).astype(float), self.sums[at] / (self.i[at] - self.begin[at])[:, None, None]
        mean, level = s[:, 0, 1:df], s[:, 0, 8:]
        spread = s[:, 1:df, 1:df] - mean[:, :, None] * mean[:, None, :]
        sd = np.sqrt(np.maximum(np.einsum("kjj->kj", spread), 0))
        sd[sd == 0] = 1.0
        gram = spread / (sd[:, :, None] * sd[:, None, :])
        target = (s[:, 8:, 1:df] - level[:, :, None] * mean[:, None, :]) / sd[:, None, :]
        total = np.einsum("kbb->kb", s[:, 8:, 8:]) - level**2
        b = self.coefs[at][:, :, 1:df] * sd[:, None, :]
        b[self.first[at]] = 0
        tried = np.repeat(~self.first[at], 7)
        b = lasso(np.repeat(gram, 7, axis=0), target.reshape(-1, p), b.reshape(-1, p), tried).reshape(-1, 7, p)
        slopes = b / sd[:, None, :]
        coefs = np.zeros((len(at), 7, 8))
        coefs[:, :, 0] = level - np.einsum("kbp,kp->kb", slopes, mean)
        coefs[:, :, 1:df] = slopes
        off = total - 2 * (b * target).sum(2) + (np.matmul(b, gram) * b).sum(2)
        for k in np.flatnonzero((off < 1e-7 * (np.abs(total) + level**2)).any(1)):  # nearly all cancels: from the residuals
            rows = self.rows[at[k], self.begin[at[k]] : self.i[at[k]]]
            off[k] = ((rows[:, 8:] - rows[:, :8] @ coefs[k].T) ** 2).mean(0)
        self.coefs[at], self.rmse[at] = coefs, np.sqrt(np.maximum(off, 0) * (n / np.maximum(n - df, 1))[:, None])
        self.df[at] = df

    def seasonal(self, at: np.ndarray) -> np.ndarray:
        """The errors of the models at the season of the window's newest observations."""
        upto = int(self.upto[at].max())
        off = np.abs(self.season[at, :upto] - self.season[at, self.i[at] + self.conse - 1][:, None])
        key = self.within[at, :upto] + (np.minimum(off, _YEAR4 - off).astype(self.within.dtype) << self.index_bits)
        key.partition(FULL - 1, axis=1)
        nearest = key[:, :FULL] & ((1 << self.index_bits) - 1)
        rows = self.rows[at[:, None], nearest]
        residuals = rows[:, :, 9:14] - np.matmul(rows[:, :, :8], self.coefs[at, DETECT].transpose(0, 2, 1))
        return np.sqrt((residuals**2).sum(1) / (FULL - self.df[at])[:, None])

    def tick(self, at: np.ndarray) -> None:
        """One more observation in the segment of each pixel, or its end (Run.monitor())."""
        conse, i = self.conse, self.i[at]
        span = i - self.begin[at]
        low = span <= FULL
        again = self.first[at] | low | (i - self.upto[at] > (self.span[at] * 0.03).astype(int))
        if again.any():
            fits = at[again]
            wanted = np.where(span[again] < 18, 4, np.where(span[again] < 24, 6, 8))
            for df in np.unique(wanted):
                self.fit(fits[wanted == df], int(df))
            old = np.where(self.first[fits], self.i[fits], self.upto[fits])
            while len(more := np.flatnonzero(old < self.i[fits])):
                self.within[fits[more], old[more]] = old[more]
                old[more] += 1
            self.upto[fits], self.span[fits] = i[again], span[again]
        self.t_end[at] = self.x[at, i - 1]
        scale = self.rmse[at, DETECT]
        if not low.all():
            scale[~low] = self.seasonal(at[~low])
        scale = np.maximum(self.noise[at, DETECT], scale)
        fresh = low | self.first[at]
        if fresh.any():
            new = at[fresh]
            rows = self.rows[new[:, None], i[fresh][:, None] + np.arange(conse)]
            seen = rows[:, :, 8:] - np.matmul(rows[:, :, :8], self.coefs[new].transpose(0, 2, 1))
            normed = seen[:, :, DETECT] / scale[fresh][:, None, :]
            self.seen[new], self.normed[new], self.size[new] = seen, normed, (normed**2).sum(2)
            for j in range(conse - 1):
                self.angle[new, j] = self.between(new, j)
        if not fresh.all():
            old = at[~fresh]
            row = self.rows[old, i[~fresh] + conse - 1]
            seen = row[:, 8:] - np.matmul(self.coefs[old], row[:, :8, None])[:, :, 0]
            normed = seen[:, DETECT] / scale[~fresh]
            for kept, new in ((self.seen, seen), (self.normed, normed), (self.size, (normed**2).sum(1))):
                kept[old, :-1] = kept[old, 1:]
                kept[old, -1] = new
            if conse > 1:
                self.angle[old, :-1] = self.angle[old, 1:]
                self.angle[old, -1] = self.between(old, conse - 2)
        self.first[at] = False
        angle, least, nearest = self.angle[at].mean(1), self.size[at].min(1), self.size[at, 0]
        if self.noted:
            self.note(at, self.x[at, i], angle, least)
        broken = (least > self.t_cg) & (angle < CHANGE_ANGLE)
        far = ~broken & (nearest > NOISE)
        near = at[~broken & ~far]
        rows = self.rows[near, self.i[near]]
        self.sums[near] += rows[:, :, None] * rows[:, None, :]
        self.i[near] += 1
        for k in at[far]:
            i, n = self.i[k], self.n[k]
            for a in (self.x, self.season, self.rows):
                a[k, i : n - 1] = a[k, i + 1 : n]
            self.n[k] -= 1
        for k in at[broken]:
            self.guarded(k, self.broken)

    def between(self, at: np.ndarray, j: int) -> np.ndarray:
        """The angles between observations j and j + 1 of the windows."""
        size = np.sqrt(self.size[at, j] * self.size[at, j + 1])
        cosine = np.where(size > 0, (self.normed[at, j] * self.normed[at, j + 1]).sum(1) / np.where(size > 0, size, 1), 1.0)
        return np.degrees(np.arccos(np.clip(cosine, -1, 1)))

    def note(self, at: np.ndarray, day: np.ndarray, angle: np.ndarray, least: np.ndarray) -> None:
        """Magnitudes.note() of many pixels."""
        to = ((day - self.start) / self.interval).astype(int)
        decay = np.clip((90.0 - angle) / 45.0, 0, 1)
        value = np.minimum(decay * least * 100 + 0.5, 32767).astype(np.int16)
        inside = (to >= 0) & (to < self.cm.shape[1])
        at, to, day, value = at[inside], to[inside], day[inside], value[inside]
        more = value > self.cm[at, to]
        self.cm[at[more], to[more]], self.day[at[more], to[more]] = value[more], day[more] - cold.LAUNCH


def update(packs: list[nrt.Pack], series, **parameters) -> list[nrt.Pack]:
    """Of each pack and its series (days, bands, qa) of a portion what nrt.update() returns."""
    started = [nrt.start(pack, *one, **parameters) for pack, one in zip(packs, series, strict=True)]
    if runs := [run for _, run in started if run]:
        _Filters(runs).go()
    return [pack for pack, _ in started]


_STEPS, _NOISES, _SEEN = np.array(nrt._STEPS), np.array(nrt._NOISES), [0, 2, 4]


def _forward(state: np.ndarray, p: np.ndarray, left: np.ndarray):
    """States and their covariances so many days on (Filter.advance())."""
    while (left > 0).any():
        m = np.clip(left, 0, len(_STEPS) - 1)
        step = np.ascontiguousarray(_STEPS[m].transpose(0, 2, 1))
        state = np.matmul(state, step)
        for _ in range(2):  # step @ p @ step.T: twice from the right, turned between
            p = np.matmul(p.reshape(len(p), -1, 6), step).reshape(-1, nrt.BANDS, 6, 6).transpose(0, 1, 3, 2)
        p = p + _NOISES[m][:, None]
        left = left - m
    return state, p


def _absorbed(state: np.ndarray, p: np.ndarray, noise: np.ndarray, y: np.ndarray, near: np.ndarray | None = None):
    """States and covariances with an observation taken in (Filter.absorb()), where it is near; its innovations."""
    v = y - state[:, :, _SEEN].sum(2)
    pz = p[:, :, :, 0] + p[:, :, :, 2] + p[:, :, :, 4]
    gain = pz / (pz[:, :, 0] + pz[:, :, 2] + pz[:, :, 4] + noise)[:, :, None]
    if near is not None:
        gain[~near] = 0
    return state + gain * v[:, :, None], p - gain[:, :, :, None] * pz[:, :, None, :], v


class _Filters:
    """Pixels whose filters take in observations."""

    def __init__(self, runs: list[nrt.Run]) -> None:
        self.runs, self.t_cg, self.conse = runs, runs[0].t_cg, runs[0].conse
        n, most, bands = len(runs), max(len(r.x) for r in runs), nrt.BANDS
        self.x, self.y = np.zeros((n, most), np.int64), np.zeros((n, most, bands))
        self.n, self.at, self.day, self.count = np.zeros((4, n), np.int64)
        self.state, self.p = np.zeros((n, bands, 6)), np.zeros((n, bands, 6, 6))
        self.noise, self.squares, self.least = np.zeros((n, bands)), np.zeros((n, bands)), np.array([r.least for r in runs])
        self.on, self.broke, self.waiting = np.zeros(n, bool), np.zeros(n, bool), []

    def go(self) -> None:
        for k, run in enumerate(self.runs):
            self.load(k) if run.trained else self.seek(k)
        while True:
            if self.waiting and (4 * len(self.waiting) >= len(self.runs) or not self.on.any()):  # many at a time
                self.models(self.waiting)
                self.waiting = []
            rows = np.flatnonzero(self.on)
            if not len(rows):
                return
            over = self.n[rows] - self.at[rows] < self.conse
            for k in rows[over]:
                self.unload(k)
                self.runs[k].close(bool(self.broke[k]))
            if len(rows := rows[~over]):
                self.tick(rows)

    def seek(self, k: int) -> None:
        """To the next model of pixel k, or its end."""
        run = self.runs[k]
        if run.train():
            self.waiting.append(k)
        else:
            run.close(bool(self.broke[k]))

    def models(self, numbers: list[int]) -> None:
        """The filters of pixels with new windows (nrt._model())."""
        windows = [self.runs[k].window for k in numbers]
        length = np.array([len(x) for _, _, x, _ in windows])
        days, y = np.zeros((len(windows), length.max()), np.int64), np.zeros((len(windows), length.max(), nrt.BANDS))
        for j, (_, _, x, values) in enumerate(windows):
            days[j, : len(x)], y[j, : len(x)] = x, values.T
        shift = np.array([nrt.whole_years(x) for _, _, x, _ in windows])
        noise = np.array([np.maximum(rmse**2, 1e-6) for _, rmse, _, _ in windows])[:, : nrt.BANDS]
        p = np.broadcast_to(nrt._START, (len(windows), nrt.BANDS, 6, 6)).copy()
        for back in (shift, 0 * shift):
            day = days[:, 0] - back
            state = np.array([nrt.to_state(coefs, int(d)) for (coefs, *_), d in zip(windows, day, strict=True)])
            squares = np.zeros((len(windows), nrt.BANDS))
            for t in range(days.shape[1]):
                r = np.flatnonzero(length > t)
                now = days[r, t] - back[r]
                state[r], p[r], v = _absorbed(*_forward(state[r], p[r], now - day[r]), noise[r], y[r, t])
                squares[r] += np.floor(v**2)
                day[r] = now
        for j, k in enumerate(numbers):
            run = self.runs[k]
            run.kf, run.squares = nrt.Filter(windows[j][0], int(day[j]), noise[j], p[j]), squares[j]
            run.kf.state, run.kf.noise = state[j], noise[j]
            self.load(k)

    def load(self, k: int) -> None:
        run, n = self.runs[k], len(self.runs[k].x)
        self.x[k, :n], self.y[k, :n] = run.x, run.y.T
        self.n[k], self.at[k], self.day[k], self.count[k] = n, run.at, run.kf.day, run.n
        self.state[k], self.p[k], self.noise[k], self.squares[k], self.on[k] = run.kf.state, run.kf.p, run.kf.noise, run.squares, True

    def unload(self, k: int) -> None:
        run = self.runs[k]
        run.at, run.n, run.squares, self.on[k] = int(self.at[k]), int(self.count[k]), self.squares[k].copy(), False
        run.kf.state, run.kf.p, run.kf.day = self.state[k].copy(), self.p[k].copy(), int(self.day[k])

    def tick(self, rows: np.ndarray) -> None:
        """The next observation of each pixel (Run.step())."""
        at = self.at[rows]
        window = at[:, None] + np.arange(self.conse)
        days = self.x[rows[:, None], window]
        off = (days - self.day[rows][:, None]).astype(float)
        basis = np.empty((*off.shape, 6))
        basis[:, :, 0], basis[:, :, 1] = 1, off
        for k in (1, 2):
            basis[:, :, 2 * k], basis[:, :, 2 * k + 1] = np.cos(k * H.W * off), np.sin(k * H.W * off)
        state = self.state[rows]
        seen = self.y[rows[:, None], window] - np.matmul(basis, state.transpose(0, 2, 1))
        rmse = np.sqrt(self.squares[rows] / np.maximum(self.count[rows] - 6, 1)[:, None])
        normed = (seen / np.maximum(np.maximum(self.least[rows], rmse), 1e-6)[:, None, :])[:, :, nrt.DETECT]
        size = (normed**2).sum(2)
        broken = size.min(1) > self.t_cg
        for k in np.flatnonzero(broken):
            broken[k] = H.mean_angle(normed[k].T) <= nrt.ANGLE
        for k in rows[broken]:
            run = self.runs[k]
            self.unload(k)
            run.step()
            if run.trained:
                self.load(k)
            else:
                self.broke[k] = True
                self.seek(k)
        rows, at, state, near = rows[~broken], at[~broken], state[~broken], size[~broken, 0] <= nrt.NOISE
        if not len(rows):
            return
        day = days[~broken, 0]
        state, p = _forward(state, self.p[rows], day - self.day[rows])
        self.state[rows], self.p[rows], v = _absorbed(state, p, self.noise[rows], self.y[rows, at], near)
        self.day[rows] = day
        taken = rows[near]
        self.squares[taken] = np.floor(self.squares[taken] + v[near] ** 2)
        self.count[taken] += 1
        self.at[rows] += 1
