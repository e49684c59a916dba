"""Objects in one map of change magnitudes: smoothing, connected patches, flood, cluster and basin segmentation.

A map is a 2-D array scaled by 100 with -9999 for none; results are labels of two scales (0 none) and
the mean smoothed magnitude of each label of the first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotile.functions.harmonic import chi2_quantile
from chronotile.schema import NO_DATA, Grid

AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def smooth(a: np.ndarray, sigma: float = 1.0, reach: int = 4) -> np.ndarray:
    """Gaussian smoothing over what is there (NaN is not); edges are extended, NaN stays."""
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    there = np.isfinite(a)

    def blur(m):
        m = np.pad(m, reach, mode="edge")
        m = sum(w * m[i : i + a.shape[0] , :] for i, w in enumerate(k))
        return sum(w * m[:, i : i + a.shape[1]] for i, w in enumerate(k))

    weight = blur(there.astype(float))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(there, blur(np.where(there, a, 0.0)) / weight, np.nan)


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected patches, numbered in the order of their first pixels. By union-find over runs of a row."""
    parent: list[int] = []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.full(mask.shape, -1)
    above: list[tuple[int, int, int]] = []
    for r, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        k = 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            me = len(parent)
            parent.append(me)
            while k < len(above) and above[k][1] < a:
                k += 1
            m = k
            while m < len(above) and above[m][0] <= b:
                x, y = root(above[m][2]), root(me)
                parent[max(x, y)] = min(x, y)
                m += 1
            out[r, a:b] = me
            now.append((a, b, me))
        above = now
    roots = np.array([root(i) for i in range(len(parent))], int)
    _, number = np.unique(roots, return_inverse=True)
    return np.where(out >= 0, np.append(number, -1)[out] + 1, 0)


def _prepared(cm: np.ndarray, probability: float, previous: np.ndarray | None) -> tuple[np.ndarray, float]:
    floor = chi2_quantile(probability, 5)
    a = np.where(cm == NO_DATA, np.nan if previous is None else np.where(previous == NO_DATA, np.nan, previous), cm) / 100.0
    return smooth(np.where(a < floor, np.nan, a)), floor


def _means(labels: np.ndarray, value: np.ndarray) -> dict[int, float]:
    on = labels > 0
    n = np.bincount(labels[on], minlength=labels.max() + 1)
    total = np.bincount(labels[on], np.nan_to_num(value[on]), minlength=labels.max() + 1)
    return {int(k): float(total[k] / n[k]) for k in np.flatnonzero(n)}


def floodfill(cm: np.ndarray, day: np.ndarray, previous: np.ndarray | None = None, share: float = 0.4, days: int = 60):
    """Floods from seeds above the 90 % quantile, largest first: neighbours whose magnitude is within `share`
    of the seed's and whose day is within `days` of its; earlier floods keep their pixels."""
    peak = chi2_quantile(0.90, 5)
    a = np.where(cm == NO_DATA, np.nan, cm) / 100.0
    if previous is not None:
        take = np.isnan(a) & (previous >= peak * 100)
        a = np.where(take, previous / 100.0, a)
    a = smooth(np.where(a < peak * (1 - share), np.nan, a))
    flat = np.nan_to_num(a, nan=-1).ravel()
    order = np.argsort(-flat, kind="stable")
    labels = np.zeros(a.shape, int)
    rows, cols = a.shape
    n = 0
    for seed in order[: int((flat > peak).sum())].tolist():
        r, c = divmod(seed, cols)
        if labels[r, c]:
            continue
        n += 1
        low, high, when = a[r, c] * (1 - share), a[r, c] * (1 + share), day[r, c]
        labels[r, c] = n
        todo = [(r, c)]
        while todo:
            r, c = todo.pop()
            for dr, dc in AROUND:
                i, j = r + dr, c + dc
                if 0 <= i < rows and 0 <= j < cols and not labels[i, j] and low <= a[i, j] <= high and abs(day[i, j] - when) <= days:
                    labels[i, j] = n
                    todo.append((i, j))
    return labels, label(labels > 0), _means(labels, a)


def slic(cm: np.ndarray, day: np.ndarray, previous: np.ndarray | None = None, pixels: int = 25, compactness: float = 0.01, rounds: int = 10):
    """Clusters of place and magnitude within the mask of the 70 % quantile, about `pixels` large."""
    a, _ = _prepared(cm, 0.70, previous)
    at = np.argwhere(np.isfinite(a))
    labels = np.zeros(a.shape, int)
    if not len(at):
        return labels, labels.copy(), {}
    k = -(-len(at) // pixels)
    value = a[at[:, 0], at[:, 1]]
    centre = np.linspace(0, len(at) - 1, k).round().astype(int)
    place, colour = at[centre].astype(float), value[centre]
    step = np.sqrt(len(at) / k)
    scale = (compactness * max(float(np.ptp(value)), 1e-9) / step) ** 2
    number = np.full(a.shape, -1)
    number[at[:, 0], at[:, 1]] = np.arange(len(at))
    for _ in range(rounds):
        best, own = np.full(len(at), np.inf), np.zeros(len(at), int)
        low, high = np.maximum(np.ceil(place - 2 * step), 0).astype(int), np.floor(place + 2 * step).astype(int) + 1
        for c in range(k):
            near = number[low[c, 0] : high[c, 0], low[c, 1] : high[c, 1]]  # a cluster looks at its surroundings only
            near = near[near >= 0]
            far = (value[near] - colour[c]) ** 2 + scale * ((at[near] - place[c]) ** 2).sum(1)
            less = far < best[near]
            best[near[less]], own[near[less]] = far[less], c
        own[np.isinf(best)] = [int(np.argmin(((place - x) ** 2).sum(1))) for x in at[np.isinf(best)]]
        n = np.maximum(np.bincount(own, minlength=k), 1)
        moved = np.column_stack([np.bincount(own, at[:, d], minlength=k) / n for d in (0, 1)])
        used = np.bincount(own, minlength=k) > 0
        place[used], colour[used] = moved[used], (np.bincount(own, value, minlength=k) / n)[used]
    labels[at[:, 0], at[:, 1]] = own + 1
    return labels, label(labels > 0), _means(labels, a)


def watershed(cm: np.ndarray, day: np.ndarray, previous: np.ndarray | None = None):
    """Basins of the magnitude turned over: every peak floods down until basins meet."""
    a, _ = _prepared(cm, 0.70, previous)
    rows, cols = a.shape
    depth = np.where(np.isfinite(a), -a, np.inf)
    labels = np.zeros(a.shape, int)
    heap, n, order = [], 0, 0
    padded = np.pad(depth, 1, constant_values=np.inf)
    around = np.stack([padded[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols] for dr, dc in AROUND])
    for r, c in np.argwhere(np.isfinite(a) & (depth <= around.min(0))).tolist():
        if not any(0 <= r + dr < rows and 0 <= c + dc < cols and labels[r + dr, c + dc] and depth[r + dr, c + dc] == depth[r, c] for dr, dc in AROUND):
            n += 1
        labels[r, c] = labels[r, c] or n
        heapq.heappush(heap, (depth[r, c], order, r, c))
        order += 1
    while heap:
        _, _, r, c = heapq.heappop(heap)
        for dr, dc in AROUND:
            i, j = r + dr, c + dc
            if 0 <= i < rows and 0 <= j < cols and not labels[i, j] and np.isfinite(depth[i, j]):
                labels[i, j] = labels[r, c]
                heapq.heappush(heap, (depth[i, j], order, i, j))
                order += 1
    return labels, label(labels > 0), _means(labels, a)


METHODS = {"floodfill": floodfill, "slic": slic, "watershed": watershed}


def segment(cm: DataFrame, grid: Grid, method: str = "floodfill") -> DataFrame:
    """(pos, cm_idx, s1, s2, cm) of every map of cm (schema.CM). A map is one group, as floods know no border;
    its size is that of a tile, which doesn't grow with the archive. cm is the object's mean."""
    work, shape = METHODS[method], (grid.n_rows, grid.n_cols)

    def of_map(table: pa.Table) -> pa.Table:
        at = table.column("pos").to_numpy() - 1
        values, days = np.full(grid.n_rows * grid.n_cols, float(NO_DATA)), np.full(grid.n_rows * grid.n_cols, float(NO_DATA))
        values[at], days[at] = table.column("cm").to_numpy(), table.column("cm_date").to_numpy()
        s1, s2, means = work(values.reshape(shape), days.reshape(shape))
        s1, s2 = s1.ravel()[at], s2.ravel()[at]
        return pa.table({"pos": table.column("pos"), "cm_idx": table.column("cm_idx"), "s1": pa.array(s1, pa.int32()), "s2": pa.array(s2, pa.int32()), "cm": pa.array([means.get(int(k), float(NO_DATA)) for k in s1], pa.float64())})

    return cm.select("pos", F.col("cm_idx"), "cm", "cm_date").groupBy("cm_idx").applyInArrow(of_map, "pos long, cm_idx int, s1 int, s2 int, cm double")
