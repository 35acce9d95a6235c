"""Kernel smoothing, local-linear surfaces, tapered windows and resampling.

Smoothing gathers lines of cells and convolves them in Arrow batches; windows and blocks of cells follow from arithmetic."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.functions.scalars import kernel_sigma, smoothstep
from groundswell.operators.fits import plane


#: Cells of a batch of lines that a worker holds as arrays at once.
LINE_CELLS = 200_000
#: How a line goes on beyond its ends: with zeros, its end cells, or mirrored with the end cells doubled.
_BEYOND = {"constant": "constant", "nearest": "edge", "reflect": "symmetric"}


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """A normalised Gaussian, cut at ``truncate`` sigmas."""
    radius = int(truncate * sigma + 0.5)
    raw = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return raw / raw.sum()


def convolve_lines(a: np.ndarray, weights: np.ndarray, mode: str) -> np.ndarray:
    """Lines along axis 1 under a symmetric kernel; wide kernels by Fourier transform."""
    radius = len(weights) // 2
    wide = np.pad(a, [(0, 0), (radius, radius)] + [(0, 0)] * (a.ndim - 2), mode=_BEYOND[mode])
    n = a.shape[1]
    if radius <= 24:
        return sum(w * wide[:, k : k + n] for k, w in enumerate(weights))
    size = 1 << (wide.shape[1] + 2 * radius).bit_length()
    gain = np.fft.rfft(weights, size).reshape([1, -1] + [1] * (a.ndim - 2))
    return np.fft.irfft(np.fft.rfft(wide, size, axis=1) * gain, size, axis=1)[:, 2 * radius : 2 * radius + n]


def gaussian(df: DataFrame, keys: list[str], values: list[str], shape: tuple[int, int], sigma: float, *, mode: str = "constant", truncate: float = 4.0) -> DataFrame:
    """keys, r, c and the smoothed ``values``; NULL and absent cells count as 0.

    One shuffle an axis gathers each line of a field as one array; lines are convolved where they meet, whole batches
    of them at a time, so rows don't grow with the kernel. Comes out for each cell of the lines that have one."""
    weights = gaussian_weights(sigma, truncate)
    kinds = dict(df.dtypes)
    out = df.select(*keys, "r", "c", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    for axis, n in (("r", shape[0]), ("c", shape[1])):
        other = "c" if axis == "r" else "r"
        lines = out.groupBy(*keys, other).agg(F.collect_list(F.struct(F.col(axis).cast("int").alias("_i"), *values)).alias("_line"))

        def run(batches: Iterator[pa.RecordBatch], axis=axis, other=other, n=n) -> Iterator[pa.RecordBatch]:
            step = max(1, LINE_CELLS // n)
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    line = part.column("_line")
                    cells = line.flatten()
                    of = np.repeat(np.arange(len(line)), line.value_lengths().to_numpy())
                    at = cells.field("_i").to_numpy()
                    ok = (at >= 0) & (at < n)
                    dense = np.zeros((len(line), n, len(values)))
                    for k, v in enumerate(values):
                        dense[of[ok], at[ok], k] = cells.field(v).to_numpy()[ok]
                    done = convolve_lines(dense, weights, mode).reshape(-1, len(values))
                    take = pa.array(np.repeat(np.arange(len(line)), n))
                    columns = {k: part.column(k).take(take) for k in [*keys, other]} | {axis: pa.array(np.tile(np.arange(n, dtype=np.int32), len(line)))}
                    columns |= {v: pa.array(np.ascontiguousarray(done[:, k])) for k, v in enumerate(values)}
                    names = [*keys, "r", "c", *values]
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

        schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"r {'int' if axis == 'r' else kinds['r']}", f"c {'int' if axis == 'c' else kinds['c']}"] + [f"`{v}` double" for v in values])
        out = lines.mapInArrow(run, schema)
        kinds[axis] = "int"
    return out


def gaussian_masked(df: DataFrame, keys: list[str], shape: tuple[int, int], sigma: float, *, value: str = "v", mode: str = "reflect", truncate: float = 2.0) -> DataFrame:
    """Smoothed over valid cells alone: the smoothed values over the smoothed mask, NULL where no valid cell is near."""
    rows = df.withColumn("_m", F.col(value).isNotNull().cast("double"))
    out = gaussian(rows, keys, [value, "_m"], shape, sigma, mode=mode, truncate=truncate)
    return out.select(*keys, "r", "c", F.when(F.col("_m") > 0, F.col(value) / F.col("_m")).alias(value))


def local_linear(df: DataFrame, keys: list[str], shape: tuple[int, int], sigma: float, *, value: str = "v", weight: str = "w", ridge: float = 1e-6) -> DataFrame:
    """keys, r, c, level, coverage of a Gaussian-weighted plane fitted around each cell.

    Nine smoothed moments serve every cell; the plane's normal equations, centred on the cell and with a relative ridge
    on their diagonal, are solved by Cramer's rule inside codegen."""
    x, y, w = F.col("c") / sigma, F.col("r") / sigma, F.col(weight)
    f = F.when(w > 0, F.col(value)).otherwise(0.0)
    moments = {"s0": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y, "syy": w * y * y, "r0": w * f, "rx": w * x * f, "ry": w * y * f}
    g = gaussian(df.select(*keys, "r", "c", *[m.alias(k) for k, m in moments.items()]), keys, list(moments), shape, sigma)
    m = {k: F.col(k) for k in moments}
    cx, cy = m["sx"] - x * m["s0"], m["sy"] - y * m["s0"]
    cxx = m["sxx"] - 2 * x * m["sx"] + x * x * m["s0"]
    cyy = m["syy"] - 2 * y * m["sy"] + y * y * m["s0"]
    cxy = m["sxy"] - x * m["sy"] - y * m["sx"] + x * y * m["s0"]
    extra = F.lit(ridge) * F.greatest(m["s0"], F.lit(ridge))
    g = g.select(*keys, "r", "c", "s0", "r0", (m["s0"] + extra).alias("_a"), cx.alias("_b"), cy.alias("_d"), (cxx + extra).alias("_e"), cxy.alias("_h"), (cyy + extra).alias("_k"), (m["rx"] - x * m["r0"]).alias("_p"), (m["ry"] - y * m["r0"]).alias("_q"))
    a, b, d, e, h, k, p, q, r0 = (F.col(z) for z in ("_a", "_b", "_d", "_e", "_h", "_k", "_p", "_q", "r0"))
    det = a * (e * k - h * h) - b * (b * k - h * d) + d * (b * h - e * d)
    top = r0 * (e * k - h * h) - b * (p * k - h * q) + d * (p * h - e * q)
    return g.select(*keys, "r", "c", F.try_divide(top, F.nullif(det, F.lit(0.0))).alias("level"), F.col("s0").alias("coverage"))


def fit_sigma(df: DataFrame, keys: list[str], shape: tuple[int, int], sigma: float, *, value: str = "v", weight: str = "w", level: str = "level", least: float = 1e-3) -> DataFrame:
    """keys, r, c, n_eff, sigma_fit: the local residual scatter over the effective number of cells behind a surface."""
    w, d = F.col(weight), F.col(value) - F.col(level)
    g1 = gaussian(df.select(*keys, "r", "c", w.alias("s0"), F.when(w > 0, w * d * d).otherwise(0.0).alias("sr2")), keys, ["s0", "sr2"], shape, sigma)
    g2 = gaussian(df.select(*keys, "r", "c", (w * w).alias("s2")), keys, ["s2"], shape, sigma / math.sqrt(2.0))
    out = g1.join(g2, [*keys, "r", "c"])
    n_eff = F.when(F.col("s2") > 0, F.lit(4 * math.pi * sigma * sigma) * F.col("s0") * F.col("s0") / F.col("s2")).otherwise(0.0)
    ok = (F.col("s0") > least) & (n_eff > 0)
    return out.select(*keys, "r", "c", F.when(ok, n_eff).alias("n_eff"), F.when(ok, F.sqrt(F.col("sr2") / F.col("s0") / n_eff)).alias("sigma_fit"))


def loclin_surface(df: DataFrame, keys: list[str], shape: tuple[int, int], *, pixel_m: float, cutoff_m: float, value: str = "v", weight: str = "w", data: str | None = None, blend: tuple[float, float] = (0.05, 0.3)) -> DataFrame:
    """keys, r, c, surface, coverage: the local-linear surface with its half response at ``cutoff_m``, finite everywhere.

    Where the kernel sees little weight (coverage below ``blend``) the smoothed field itself stands in, and between the
    two limits a smoothstep leads from one to the other. ``data`` names a mask (1 where there is data) to measure
    coverage by, instead of by the weights. ``value`` has no gaps."""
    sigma = kernel_sigma(cutoff_m, pixel_m)
    level = local_linear(df, keys, shape, sigma, value=value, weight=weight)
    base = gaussian(df, keys, [value], shape, sigma, mode="nearest").withColumnRenamed(value, "_base")
    if data is not None:
        seen = gaussian(df, keys, [data], shape, sigma).select(*keys, "r", "c", F.col(data).alias("coverage"))
        level = level.drop("coverage").join(seen, [*keys, "r", "c"])
    beta = smoothstep((F.col("coverage") - blend[0]) / (blend[1] - blend[0]))
    own = F.when(beta > 0, F.coalesce("level", F.col("_base"))).otherwise(0.0)
    return level.join(base, [*keys, "r", "c"]).select(*keys, "r", "c", (beta * own + (1 - beta) * F.col("_base")).alias("surface"), "coverage")


def _windows_of(i: Column, n: int, size: int, overlap: int) -> tuple[Column, int]:
    """The numbers of the windows that hold cell i of an axis of n, as an array, and how many windows there are. Window k
    begins at k * (size - overlap), and the last one is cut short; one window if it covers the axis."""
    if size >= n:
        return F.array(F.lit(0)), 1
    step = size - overlap
    count = -(-(n - size) // step) + 1
    first = F.greatest(F.ceil((i - (size - 1)) / F.lit(float(step))).cast("int"), F.lit(0))
    return F.sequence(first, F.least(F.floor(i / F.lit(float(step))).cast("int"), F.lit(count - 1))), count


def windowed_plane(df: DataFrame, keys: list[str], shape: tuple[int, int], size: int, overlap: int, *, value: str = "v", most_missing: float = 0.8) -> DataFrame:
    """keys, r, c, surface: planes fitted in sliding windows, blended by Hann tapers over valid cells; NULL where no taper reaches.

    A cell's windows follow from its place; a window of which over ``most_missing`` of the cells are invalid is left out."""
    if not 0 <= overlap < size:
        raise ValueError("windows have to move on")
    rows = df.select(*keys, "r", "c", F.col(value).alias("v"))
    step = size - overlap
    for axis, n in (("r", shape[0]), ("c", shape[1])):
        found, _ = _windows_of(F.col(axis), n, size, overlap)
        rows = rows.withColumn(f"_w{axis}", F.explode(found)).withColumn(f"{axis}0", F.col(f"_w{axis}") * step).withColumn(f"{axis}1", F.least(F.col(f"{axis}0") + size, F.lit(n)))
    by = [*keys, "_wr", "_wc"]
    area = (F.col("r1") - F.col("r0")) * (F.col("c1") - F.col("c0"))
    fit = rows.join(plane(rows, by, count="_n"), by).where(F.col("_n") >= area * (1 - most_missing))
    taper = F.when(F.col("v").isNotNull(), _taper(F.col("r") - F.col("r0"), F.col("r1") - F.col("r0")) * _taper(F.col("c") - F.col("c0"), F.col("c1") - F.col("c0"))).otherwise(0.0)
    level = F.col("p0") + F.col("px") * F.col("c") + F.col("py") * F.col("r")
    out = fit.groupBy(*keys, "r", "c").agg(F.try_divide(F.sum(taper * level), F.nullif(F.sum(taper), F.lit(0.0))).alias("surface"))
    return df.select(*keys, "r", "c").join(out, [*keys, "r", "c"], "left")


def _taper(i: Column, n: Column) -> Column:
    return F.when(n > 1, F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * i / F.greatest(n - 1, F.lit(1)))).otherwise(1.0)


def upsample_nearest(df: DataFrame, keys: list[str], factor: int, coarse: tuple[int, int], shape: tuple[int, int], value: str = "v") -> DataFrame:
    """Each fine cell takes the coarse cell min(i div factor, n − 1): each coarse cell is spread over its block, without a join."""
    out = df.select(*keys, "r", "c", value)
    for axis, n, fine in (("r", coarse[0], shape[0]), ("c", coarse[1], shape[1])):
        first = F.col(axis) * factor
        last = F.when(F.col(axis) == n - 1, F.lit(fine - 1)).otherwise(F.least(first + factor - 1, F.lit(fine - 1)))
        out = out.where(first < fine).withColumn(axis, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out


def upsample_bilinear(df: DataFrame, keys: list[str], coarse: tuple[int, int], shape: tuple[int, int], value: str = "v") -> DataFrame:
    """Corner-aligned bilinear interpolation; NULL cells weigh 0 and a fine cell is NULL if its nearest coarse cell is."""
    rows = [(i, o, w) for o in range(shape[0]) for i, w in _corners(o, coarse[0], shape[0])]
    cols = [(i, o, w) for o in range(shape[1]) for i, w in _corners(o, coarse[1], shape[1])]
    spark = df.sparkSession
    tr, tc = (spark.createDataFrame(t, f"{a} int, _{a}o int, _{a}w double") for t, a in ((rows, "r"), (cols, "c")))
    w = F.col("_rw") * F.col("_cw")
    near = (F.col("_rw") >= 0.5) & (F.col("_cw") >= 0.5)
    out = df.join(F.broadcast(tr), "r").join(F.broadcast(tc), "c").groupBy(*keys, F.col("_ro").alias("r"), F.col("_co").alias("c"))
    return out.agg(F.sum(w * F.coalesce(F.col(value), F.lit(0.0))).alias("_v"), F.bool_or(near & F.col(value).isNull()).alias("_gone")).select(*keys, "r", "c", F.when(~F.col("_gone"), F.col("_v")).alias(value))


def _corners(o: int, n: int, m: int) -> list[tuple[int, float]]:
    src = o * (n - 1) / (m - 1) if m > 1 else 0.0
    i = min(int(src), max(n - 2, 0))
    return [(i, 1 - (src - i)), (i + 1, src - i)] if n > 1 else [(0, 1.0)]


def sample_points(points: DataFrame, field: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Adds ``sample``: bilinear value of each point (y, x in cells), NULL outside the grid or beside a NULL cell. Four equi-joined corners."""
    fr, fc = F.floor("y"), F.floor("x")
    corners = F.array(*[F.struct((fr + a).cast("int").alias("r"), (fc + b).cast("int").alias("c"), ((F.col("y") - fr if a else 1 - (F.col("y") - fr)) * (F.col("x") - fc if b else 1 - (F.col("x") - fc))).alias("_w")) for a in (0, 1) for b in (0, 1)])
    spread = points.withColumn("_k", F.explode(corners)).select(*points.columns, "_k.*").where("_w > 0")
    met = spread.join(field.select(*keys, "r", "c", value), [*keys, "r", "c"], "left")
    return met.groupBy(*points.columns).agg(F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col("_w") * F.col(value))).alias("sample"))
