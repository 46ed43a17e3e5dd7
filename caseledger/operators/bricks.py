"""Volume filters on bricks.

A brick is the part of a volume inside one cell of a coarse grid, as one dense array.
Voxels are shuffled once, into bricks; every brick hands its neighbours the margin
that they need, and all passes of a separable filter then run inside one array. A task
holds one brick and its margin, whatever the size of a volume.

A volume with a gap fails the query, unless ``gaps`` allows voxels that are absent: those
give nothing and get nothing in any pass (weight is not made up for, a distance does not
lead through them), and a volume still ends at its largest coordinate on each axis.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package

AXES = ("x", "y", "z")
#: Voxels of a brick along each axis.
EDGE = 64
_PIECE = "bx int, by int, bz int, x0 int, y0 int, z0 int, nx int, ny int, nz int, own boolean, data binary"


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised kernel out to ``truncate`` standard deviations."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def _only(a: np.ndarray, present: np.ndarray | None, other: float) -> np.ndarray:
    """``other`` where a voxel is absent."""
    return a if present is None else np.where(present, a, other)


def smooth(a: np.ndarray, sigmas: Sequence[float], present: np.ndarray | None = None) -> np.ndarray:
    """Separable Gaussian of the last three axes; past an end the end value repeats."""
    a = _only(a, present, 0.0)
    for axis, sigma in enumerate(sigmas, a.ndim - 3):
        weights = gaussian_weights(sigma)
        radius, n = len(weights) // 2, a.shape[axis]
        wide = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
        out = np.zeros_like(a)
        for j, w in enumerate(weights):
            out += w * np.take(wide, range(j, j + n), axis)
        a = _only(out, present, 0.0)
    return a


def box_maximum(a: np.ndarray, sizes: Sequence[int], present: np.ndarray | None = None) -> np.ndarray:
    """Largest value in a box around each voxel; a box cut at an end loses nothing. Windows
    double, so a pass costs the logarithm of its size."""
    a = _only(a, present, -np.inf)
    for axis, size in enumerate(sizes, a.ndim - 3):
        radius, n = size // 2, a.shape[axis]
        wide = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in range(a.ndim)], constant_values=-np.inf)
        span = 1
        while 2 * span <= size:
            m = wide.shape[axis] - span
            wide = np.maximum(np.take(wide, range(m), axis), np.take(wide, range(span, span + m), axis))
            span *= 2
        rest = size - span
        a = _only(np.maximum(np.take(wide, range(n), axis), np.take(wide, range(rest, rest + n), axis)), present, -np.inf)
    return a


def _pieces(values: Sequence[str], halo: Sequence[int], edge: int, gaps: bool):
    """A brick's voxels to its array, and the parts of it that bricks around it need. With
    ``gaps`` the last plane says which voxels there are."""
    reach = [range(-(-h // edge) * -1, -(-h // edge) + 1) for h in halo]

    def run(key, rows):
        at = np.stack([np.asarray(rows.column(a)).astype(np.int64) for a in AXES], 1)
        brick = at[0] // edge
        low, size = brick * edge, at.max(0) + 1 - brick * edge
        flat = np.ravel_multi_index((at - low).T, size)
        if (len(flat) != size.prod() and not gaps) or len(np.unique(flat)) != len(flat):
            raise ValueError(f"a volume has a gap or a voxel twice in study {key[0].as_py()}")
        data = np.zeros((len(values) + gaps, *size))
        if gaps:
            data[-1].flat[flat] = 1.0
        for i, v in enumerate(values):
            column = rows.column(v)
            if column.null_count:
                raise ValueError(f"{v} has nulls in study {key[0].as_py()}")
            data[i].flat[flat] = np.asarray(column).astype(float)
        out = []
        for dx in reach[0]:
            for dy in reach[1]:
                for dz in reach[2]:
                    target = brick + (dx, dy, dz)
                    a = np.maximum(target * edge - halo, low)
                    b = np.minimum((target + 1) * edge + halo, low + size)
                    if (target < 0).any() or (a >= b).any():
                        continue
                    part = data[(slice(None), *(slice(p, q) for p, q in zip(a - low, b - low)))]
                    out.append((key[0].as_py(), *target.tolist(), *a.tolist(), *(b - a).tolist(), not (dx or dy or dz), np.ascontiguousarray(part).tobytes()))
        names = ["study_id", "bx", "by", "bz", "x0", "y0", "z0", "nx", "ny", "nz", "own", "data"]
        kinds = [rows.schema.field("study_id").type, *[pa.int32()] * 9, pa.bool_(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run


def _filter(count: int, fn, outputs: Sequence[str], halo: Sequence[int], edge: int, gaps: bool):
    """Pieces to the brick with its margin, filtered; back to voxels of the brick."""
    def run(key, rows):
        pieces = rows.to_pylist()
        own = [p for p in pieces if p["own"]]
        empty = pa.table({"study_id": rows.column("study_id").slice(0, 0), **{a: pa.array([], pa.int32()) for a in AXES},
                          **{o: pa.array([], pa.float64()) for o in outputs}})
        if not own:  # beyond the end of the volume
            return empty
        start = np.array([[p["x0"], p["y0"], p["z0"]] for p in pieces])
        size = np.array([[p["nx"], p["ny"], p["nz"]] for p in pieces])
        if gaps:  # as far as the margin reaches, or to the ends of the volume
            brick = np.array([k.as_py() for k in key[1:4]])
            low = np.maximum(brick * edge - halo, 0)
            high = np.minimum((brick + 1) * edge + halo, np.array([own[0][f"end_{a}"] for a in AXES]) + 1)
        else:
            low, high = start.min(0), (start + size).max(0)
            if size.prod(1).sum() != (high - low).prod():
                raise ValueError(f"a volume has a gap in study {key[0].as_py()}")
        whole = np.zeros((count + gaps, *(high - low)))
        for p, a, n in zip(pieces, start - low, size):
            whole[(slice(None), *(slice(i, i + m) for i, m in zip(a, n)))] = np.frombuffer(p["data"]).reshape(count + gaps, *n)
        present = whole[-1] != 0 if gaps else None
        o = np.array([own[0]["x0"], own[0]["y0"], own[0]["z0"]])
        n = np.array([own[0]["nx"], own[0]["ny"], own[0]["nz"]])
        inner = (slice(None), *(slice(i, i + m) for i, m in zip(o - low, n)))
        got = fn(whole[:count], present, o - low, n)
        keep, cols = got if isinstance(got, tuple) else (np.ones(n, bool), got[inner])
        if gaps:
            keep = keep & present[inner[1:]]
        where = np.nonzero(keep)
        return pa.table({"study_id": pa.array([key[0].as_py()] * len(where[0]), rows.schema.field("study_id").type),
                         **{a: pa.array((w + s).astype(np.int32)) for a, w, s in zip(AXES, where, o)},
                         **{name: pa.array(c[where]) for name, c in zip(outputs, cols)}})

    return run


def on_bricks(voxels: DataFrame, values: Sequence[str], halo: Sequence[int], fn: Callable, outputs: Sequence[str], edge: int = EDGE,
              gaps: bool = False) -> DataFrame:
    """Applies ``fn`` to every brick with a margin of ``halo`` voxels (less at the ends of a
    volume) and returns voxels (study_id, x, y, z, ``outputs``).

    ``fn(array, present, start, size)`` gets an array (values, x, y, z), which of its voxels
    there are (None for all) and where in it the brick lies. It
    returns an array (outputs, x, y, z) of the same extent, or (mask, outputs) of the brick
    alone to keep some of its voxels. Coordinates run from 0, each voxel once: a gap (unless
    ``gaps``), a voxel twice or a null value fails the query. No rows give no rows.
    """
    ship_package(voxels.sparkSession)
    kind = voxels.schema["study_id"].dataType.simpleString()
    slim = voxels.select("study_id", *[F.col(a).cast("int").alias(a) for a in AXES], *[F.col(v).cast("double").alias(v) for v in values])
    keys = ["study_id", *(F.floor(F.col(a) / edge).cast("int").alias(f"b{a}") for a in AXES)]
    pieces = slim.groupBy(*keys).applyInArrow(_pieces(values, np.array(halo), edge, gaps), f"study_id {kind}, {_PIECE}")
    if gaps:
        ends = slim.groupBy(F.col("study_id").alias("_of")).agg(*[F.max(a).alias(f"end_{a}") for a in AXES])
        pieces = pieces.join(ends, F.col("study_id").eqNullSafe(F.col("_of"))).drop("_of")
    return pieces.groupBy("study_id", "bx", "by", "bz").applyInArrow(
        _filter(len(values), fn, outputs, np.array(halo), edge, gaps), f"study_id {kind}, x int, y int, z int, " + ", ".join(f"{o} double" for o in outputs))


def gaussian_smooth(voxels: DataFrame, value: str, sigma_voxels: Sequence[float], out: str, edge: int = EDGE, gaps: bool = False) -> DataFrame:
    """Separable Gaussian with repeated edges."""
    halo = [len(gaussian_weights(s)) // 2 for s in sigma_voxels]
    return on_bricks(voxels, [value], halo, lambda a, present, at, n: smooth(a, sigma_voxels, present), [out], edge, gaps)


def sliding_maximum(voxels: DataFrame, value: str, sizes: Sequence[int], out: str, edge: int = EDGE, gaps: bool = False) -> DataFrame:
    """Box maximum of odd ``sizes``; the source value is kept."""
    def both(a, present, at, n):
        return np.concatenate([a, box_maximum(a, sizes, present)])

    return on_bricks(voxels, [value], [s // 2 for s in sizes], both, [value, out], edge, gaps)


def squared_distance(seeds: np.ndarray, reach: Sequence[int], spacing: Sequence[float], present: np.ndarray | None = None) -> np.ndarray:
    """Squared distance to the nearest seed as far as ``reach`` voxels tell, infinite beyond.
    A squared distance is a sum over axes, so its minimum is taken one axis at a time: each
    value of a line is the lowest of the parabolas that stand on the values around it."""
    d = _only(np.where(seeds, 0.0, np.inf), present, np.inf)
    for axis, (r, s) in enumerate(zip(reach, spacing), d.ndim - 3):
        n = d.shape[axis]
        wide = np.pad(d, [(r, r) if i == axis else (0, 0) for i in range(d.ndim)], constant_values=np.inf)
        low = np.full_like(d, np.inf)
        for j in range(-r, r + 1):
            np.minimum(low, np.take(wide, range(r + j, r + j + n), axis) + (j * s) ** 2, out=low)
        d = _only(low, present, np.inf)
    return d


def gate_reach(radius: float, spacing: Sequence[float]) -> list[int]:
    """Voxels that a gate looks ahead on each axis."""
    return [int(radius / s + 1e-9) for s in spacing]


def within_gate(voxels: DataFrame, seed: str, radius: float, spacing: Sequence[float], edge: int = EDGE, gaps: bool = False) -> DataFrame:
    """Voxels (study_id, x, y, z, distance_mm) within ``radius`` mm of a voxel whose ``seed`` is not 0."""
    reach = gate_reach(radius, spacing)

    def gate(a, present, at, n):
        inner = tuple(slice(i, i + m) for i, m in zip(at, n))
        d = squared_distance(a[0] != 0, reach, spacing, present)[inner]
        return d <= radius * radius + 1e-9, [np.sqrt(d)]

    return on_bricks(voxels, [seed], reach, gate, ["distance_mm"], edge, gaps)


def detect_peaks(voxels: DataFrame, value: str, sigma_voxels: Sequence[float], sizes: Sequence[int], minimum: float, edge: int = EDGE,
                 gaps: bool = False, seed: str | None = None, radius: float = 0.0, spacing: Sequence[float] = ()) -> DataFrame:
    """Smoothed local maxima of at least ``minimum``: both filters in one visit, as the margin
    is as wide as both together. Only peaks leave a brick. With ``seed``, ``near_seed`` is 1
    for those within ``radius`` mm of a voxel whose seed is not 0, else 0."""
    wide = [s // 2 for s in sizes]
    halo = [len(gaussian_weights(s)) // 2 + w for s, w in zip(sigma_voxels, wide)]
    reach = gate_reach(radius, spacing) if seed else []

    def peaks(a, present, at, n):
        s = smooth(a[:1], sigma_voxels, present)
        # the smoothed values are right as far as the maximum looks, or to the end of the volume
        low = np.maximum(at - wide, 0)
        high = np.minimum(at + n + wide, s.shape[1:])
        part = tuple(slice(i, j) for i, j in zip(low, high))
        near = s[(slice(None), *part)]
        top = box_maximum(near, sizes, None if present is None else present[part])
        inner = tuple(slice(i, i + m) for i, m in zip(at - low, n))
        own, most = near[0][inner], top[0][inner]
        here = tuple(slice(i, i + m) for i, m in zip(at, n))
        out = [own, a[0][here]]
        if seed:
            out.append((squared_distance(a[1] != 0, reach, spacing, present)[here] <= radius * radius + 1e-9).astype(float))
        return (own >= minimum) & (np.abs(own - most) <= 1e-7), out

    names = ["candidate_score", "candidate_raw_probability"]
    if seed:
        return on_bricks(voxels, [value, seed], [max(p) for p in zip(halo, reach)], peaks, [*names, "near_seed"], edge, gaps)
    return on_bricks(voxels, [value], halo, peaks, names, edge, gaps)
