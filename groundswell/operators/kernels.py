"""Whole-field kernels in NumPy, run one field a group, for what is sequential by nature.

A field is first block-averaged, as calibration does, so that a group stays near a million cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.operators.neighbourhood import convolve_lines, gaussian_weights


#: Cells of a field that one task may hold, and of the fields whose results it hands on at once.
MOST_CELLS, BATCH_CELLS = 4_000_000, 100_000


def per_field(df: DataFrame, keys: list[str], shape: tuple[int, int], function: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], layers: list[str], schema: str) -> DataFrame:
    """``function`` on the layers of each field as 2-D arrays (NaN for NULL or absent cells); one row a cell comes back.

    Fields are dealt out and sorted by key, and taken from the stream of rows one after the other: a task holds one field
    and a batch of rows, and a small field costs little more than its cells."""
    if shape[0] * shape[1] > MOST_CELLS:
        raise ValueError(f"a field of {shape[0]} x {shape[1]} cells is too large for one task: average it in blocks first")
    kinds = {f.split()[0]: f.split()[1] for f in schema.split(", ")}
    cells, (r, c) = shape[0] * shape[1], np.indices(shape, dtype=np.int32)

    def done(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The results of whole fields, which begin at the rows ``first``."""
        at = table["r"].to_numpy() * shape[1] + table["c"].to_numpy()
        values = {name: table[name].cast(pa.float64()).fill_null(np.nan).to_numpy() for name in layers}
        ends = np.append(first[1:], table.num_rows)
        together = max(1, BATCH_CELLS // cells)
        for lo in range(0, len(first), together):
            made: dict[str, list[np.ndarray]] = {name: [] for name in kinds}
            for a, b in zip(first[lo : lo + together], ends[lo : lo + together], strict=True):
                fields = {}
                for name in layers:
                    field = np.full(cells, np.nan)
                    field[at[a:b]] = values[name][a:b]
                    fields[name] = field.reshape(shape)
                out = function(fields)
                for name in kinds:
                    made[name].append(np.asarray(out[name]).ravel())
            n = len(first[lo : lo + together])
            take = pa.array(np.repeat(first[lo : lo + together], cells))
            columns = [table[k].combine_chunks().take(take) for k in keys] + [pa.array(np.tile(x.ravel(), n)) for x in (r, c)]
            for name, kind in kinds.items():
                flat = np.concatenate(made[name])
                whole = {"int": pa.int32(), "long": pa.int64()}.get(kind)
                columns.append(pa.array(flat.astype(np.int64)).cast(whole) if whole else pa.array(flat.astype(float), mask=~np.isfinite(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "r", "c", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            first = np.flatnonzero(_changes(table, keys))
            if len(first) > 1:
                yield from done(table.slice(0, first[-1]), first[:-1])
            rest = table.slice(first[-1])
        if rest is not None:
            yield from done(rest.combine_chunks(), np.array([0]))

    names = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    rows = df.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *layers)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{names}, r int, c int, {schema}")


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; nulls equal each other."""
    out = np.zeros(table.num_rows, bool)
    out[0] = True
    for k in keys:
        column = table[k].combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        other = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] |= other.to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def nearest_valid(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, squared distance) of the valid cell nearest to each cell; of equals the first by row, then column.

    Each cell first looks along its column, and then at the columns to either side in turn, until none can be nearer:
    work is in proportion to the distances, and cells that are done are looked at no more."""
    ny, nx = mask.shape
    if not mask.any():
        raise ValueError("no valid cell")
    far = 4 * (ny + nx)
    rows = np.arange(ny)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, far)[::-1], axis=0)[::-1]
    pick = np.where(rows - above <= below - rows, above, below).astype(np.int64)  # the upper of equals
    gap = (rows - pick) ** 2
    none = (np.abs(pick) >= far) | (pick < 0)
    gap = np.where(none, np.int64(far) ** 2, gap)
    source = np.where(none, 0, pick) * nx + np.arange(nx)
    best, where = gap.ravel().copy(), source.ravel().copy()
    gap, source = gap.ravel(), source.ravel()
    active = np.flatnonzero(best > 0)
    col = active % nx
    for d in range(1, nx):
        keep = best[active] >= d * d
        active, col = active[keep], col[keep]
        if not len(active):
            break
        for step in (-d, d):
            ok = (col + step >= 0) & (col + step < nx)
            cell = active[ok]
            reach, came = gap[cell + step] + d * d, source[cell + step]
            better = (reach < best[cell]) | ((reach == best[cell]) & (came < where[cell]))
            best[cell[better]], where[cell[better]] = reach[better], came[better]
    return (where // nx).reshape(mask.shape), (where % nx).reshape(mask.shape), best.reshape(mask.shape)


def fill_nearest(v: np.ndarray) -> np.ndarray:
    r, c, _ = nearest_valid(np.isfinite(v))
    return v[r, c]


def smooth(v: np.ndarray, sigma: float, mode: str = "nearest") -> np.ndarray:
    weights = gaussian_weights(sigma)
    return convolve_lines(convolve_lines(v, weights, mode).T, weights, mode).T


def fill_gaps(v: np.ndarray, method: str = "nearest_smooth", *, sigma: float = 3.0, reach: int | None = None) -> np.ndarray:
    """Invalid cells by one of four methods; valid ones stay as they are, and what a method leaves open comes from the nearest.

    nearest: the nearest valid cell. nearest_smooth: that, with the filled cells smoothed. idw: by inverse distance within
    ``reach`` (None: the whole field). biharmonic: the field of least curvature through the valid cells."""
    ok = np.isfinite(v)
    if not ok.any():
        raise ValueError("no valid cell to fill from")
    if ok.all():
        return v.copy()
    if method == "idw":
        out = fill_idw(v, max(v.shape) if reach is None else reach)
        return out if np.isfinite(out).all() else fill_nearest(out)
    near = fill_nearest(v)
    if method == "nearest":
        return near
    if method == "nearest_smooth":
        return np.where(ok, v, smooth(near, sigma)) if sigma > 0 else near
    if method == "biharmonic":
        return _least_curvature(v, near)
    raise ValueError(f"unknown way to fill gaps: {method}")


def _least_curvature(v: np.ndarray, start: np.ndarray, *, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """The open cells that minimise the sum of squared second differences along both axes, by conjugate gradients."""
    open_ = ~np.isfinite(v)

    def curvature(a: np.ndarray) -> np.ndarray:
        """The gradient of half that sum."""
        out = np.zeros_like(a)
        for axis in (0, 1):
            x, y = np.moveaxis(a, axis, 0), np.moveaxis(out, axis, 0)
            if len(x) > 2:
                second = x[:-2] - 2 * x[1:-1] + x[2:]
                y[:-2] += second
                y[1:-1] -= 2 * second
                y[2:] += second
        return out

    x = np.where(open_, start, v)
    left = np.where(open_, -curvature(x), 0.0)
    way, size = left.copy(), float((left**2).sum())
    for _ in range(rounds):
        if size <= tolerance**2:
            break
        along = np.where(open_, curvature(way), 0.0)
        bend = float((way * along).sum())
        if bend <= 0:
            break
        x = x + size / bend * way
        left = left - size / bend * along
        fresh = float((left**2).sum())
        way, size = left + fresh / size * way, fresh
    return np.where(open_, x, v)


def fill_idw(v: np.ndarray, reach: int, passes: int = 0) -> np.ndarray:
    """Gaps by inverse distance of the first valid cell in eight directions within ``reach``; ``passes`` of 3×3 means over what was filled."""
    ny, nx = v.shape
    ok, top, low = np.isfinite(v), np.zeros_like(v), np.zeros_like(v)
    for dy, dx in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
        open_ = ~ok
        for k in range(1, reach + 1):
            r, c = np.arange(ny)[:, None] + dy * k, np.arange(nx)[None, :] + dx * k
            inside = (r >= 0) & (r < ny) & (c >= 0) & (c < nx)
            rr, cc = np.broadcast_arrays(np.clip(r, 0, ny - 1), np.clip(c, 0, nx - 1))
            hit = open_ & inside & ok[rr, cc]
            w = 1 / (k * np.hypot(dy, dx))
            top[hit] += w * v[rr, cc][hit]
            low[hit] += w
            open_ = open_ & ~hit
    out = np.where(ok, v, np.divide(top, low, out=np.full_like(v, np.nan), where=low > 0))
    for _ in range(passes):
        known = np.isfinite(out)
        z, m = np.pad(np.where(known, out, 0), 1), np.pad(known.astype(float), 1)
        s, n = (sum(a[i : i + ny, j : j + nx] for i in range(3) for j in range(3)) for a in (z, m))
        out = np.where(ok | ~known, out, s / np.maximum(n, 1))
    return out


def connected(mask: np.ndarray, *, diagonal: bool = False) -> np.ndarray:
    """Labels 1, 2, … of connected cells, in order of their first cell; 0 elsewhere. Least labels spread until nothing moves."""
    big = mask.size + 1
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), big)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        old = lab
        pad = np.pad(lab, 1, constant_values=big)
        least = lab.copy()
        for dy, dx in steps:
            for s in (1, -1):
                least = np.minimum(least, pad[1 + s * dy : 1 + s * dy + mask.shape[0], 1 + s * dx : 1 + s * dx + mask.shape[1]])
        lab = np.where(mask, least, big)
        jump = np.append(lab.ravel(), big)  # a label is a cell: take that cell's label too
        lab = np.where(mask, jump[np.minimum(lab, mask.size) - 1], big)
        if (lab == old).all():
            break
    ids = np.unique(lab[mask])
    return np.where(mask, np.searchsorted(ids, np.where(mask, lab, ids[0] if len(ids) else 0)) + 1, 0)


def _around(mask: np.ndarray, square: bool) -> list[np.ndarray]:
    """Each cell's neighbours, 4 or 8; none beyond the edges."""
    p, (ny, nx) = np.pad(mask, 1), mask.shape
    return [p[1 + y : 1 + y + ny, 1 + x : 1 + x + nx] for y in (-1, 0, 1) for x in (-1, 0, 1) if (y or x) and (square or not (y and x))]


def erode(mask: np.ndarray, times: int, *, square: bool = False) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_and.reduce([mask, *_around(mask, square)])
    return mask


def spread(mask: np.ndarray, times: int, *, square: bool = False) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_or.reduce([mask, *_around(mask, square)])
    return mask


def segment_regions(land: np.ndarray, *, erosions: int = 3, least: int = 20) -> np.ndarray:
    """Land pieces: cores left by erosion are labelled (8 neighbours), grown back over the land step by step, small ones go."""
    lab = connected(erode(land, erosions), diagonal=True)
    while True:
        p = np.pad(lab, 1)
        near = np.stack([p[:-2, 1:-1], p[1:-1, :-2], p[1:-1, 2:], p[2:, 1:-1]])
        near = np.where(near > 0, near, np.iinfo(np.int64).max).min(axis=0)
        fresh = land & (lab == 0) & (near < np.iinfo(np.int64).max)
        if not fresh.any():
            break
        lab = np.where(fresh, near, lab)
    ids, sizes = np.unique(lab[lab > 0], return_counts=True)
    kept = ids[sizes >= least]
    return np.where(np.isin(lab, kept), np.searchsorted(kept, lab) + 1, 0) if len(kept) else np.zeros_like(lab)


def savgol(v: np.ndarray, length: int, order: int) -> np.ndarray:
    """Savitzky–Golay along both axes; edges by the polynomial of the outermost window."""
    if length % 2 == 0 or order >= length:
        raise ValueError("an odd length above the order is needed")
    half = length // 2
    base = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    fit = base @ np.linalg.pinv(base)

    def along(a: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        n = len(a)
        for i in range(n):
            s = min(max(i - half, 0), n - length)
            out[i] = np.tensordot(fit[i - s], a[s : s + length], axes=1)
        return out

    return along(along(v).T).T


def fft_lowpass(v: np.ndarray, sigma: float, *, window: str = "gaussian") -> np.ndarray:
    """Periodic low-pass in the frequency domain: Gaussian, or a raised cosine that ends at 1 / (2 sigma)."""
    fy, fx = np.meshgrid(np.fft.fftfreq(v.shape[0]), np.fft.fftfreq(v.shape[1]), indexing="ij")
    f = np.hypot(fy, fx)
    cut = 1 / (2 * sigma)
    gain = np.exp(-2 * (np.pi * sigma * f) ** 2) if window == "gaussian" else np.where(f <= cut, 0.5 + 0.5 * np.cos(np.pi * f / cut), 0.0)
    return np.fft.ifft2(np.fft.fft2(v) * gain).real


#: Nodes of a dense radial system: 8 bytes a pair of them on the driver.
MOST_NODES = 5_000


def few_nodes(nodes: DataFrame) -> pd.DataFrame:
    """A table of nodes on the driver; an error, and no cut, where there are more than a dense system can hold."""
    found = nodes.limit(MOST_NODES + 1).toPandas()
    if len(found) > MOST_NODES:
        raise ValueError(f"over {MOST_NODES} nodes: solve by overlapping boxes of them")
    return found


def rbf_weights(x: np.ndarray, y: np.ndarray, z: np.ndarray, *, smooth: float = 1.0, kind: str = "cubic") -> tuple[np.ndarray, float]:
    """Weights of radial functions at the nodes, and the scale of their coordinates."""
    scale = max(float(np.ptp(x)), float(np.ptp(y)), 1e-12)
    r = np.hypot(x[:, None] - x[None], y[:, None] - y[None]) / scale
    return np.linalg.solve(_radial(r, kind) - smooth * np.eye(len(x)), z), scale


def _radial(r: np.ndarray, kind: str) -> np.ndarray:
    return {"cubic": r**3, "linear": r, "quintic": r**5}[kind]


def rbf_values(weights: np.ndarray, scale: float, x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, kind: str = "cubic") -> np.ndarray:
    return _radial(np.hypot(at_x[:, None] - x[None], at_y[:, None] - y[None]) / scale, kind) @ weights


def grow_mask(coherence: np.ndarray, velocity: np.ndarray, *, seed: float = 0.85, floor: float = 0.6, step: float = 0.05, most: float = 2.0, reach: int = 60) -> np.ndarray:
    """Seeds above one coherence, joined level by level by less coherent cells near them that move alike."""
    mask = np.nan_to_num(coherence) >= seed
    if not mask.any():
        return mask
    for level in np.arange(seed - step, floor - 1e-9, -step):
        r, c, d2 = nearest_valid(mask)
        mask = mask | ((np.nan_to_num(coherence) >= level) & (d2 <= reach * reach) & (np.abs(velocity - velocity[r, c]) <= most))
    return mask
