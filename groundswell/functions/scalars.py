"""Column expressions. NULL marks invalid cells; division by zero gives NULL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled median absolute deviation, Huber constant, kernel half-response, C-band wavelength (m).
MAD_SCALE, HUBER_C = 1.4826, 1.345
HALF_RESPONSE = math.sqrt(math.log(2) / 2) / math.pi
WAVELENGTH = 0.05546576


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid(x: Column | str) -> Column:
    """NaN at the border of the engine becomes NULL inside it."""
    return F.nanvl(col(x), F.lit(None).cast("double"))


def decimal_year(ts: Column | str, *, digits: int | None = None) -> Column:
    """Year and the fraction of it gone by, leap years included; ``digits`` rounds half to even."""
    ts = col(ts).cast("timestamp_ntz")
    start = lambda y: F.to_timestamp_ntz(F.concat(y.cast("string"), F.lit("-01-01 00:00:00")))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    first, after = start(F.year(ts)), start(F.year(ts) + 1)
    out = F.year(ts) + (micros(ts) - micros(first)) / (micros(after) - micros(first))
    return out if digits is None else F.bround(out, digits)


def wrap_longitude(lon: Column | str) -> Column:
    return F.pmod(col(lon) + 180, F.lit(360.0)) - 180


def smoothstep(x: Column) -> Column:
    """0 to 1 along 3t² − 2t³, clipped outside [0, 1]."""
    t = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def kernel_sigma(cutoff_m: float, pixel_m: float) -> float:
    """Kernel sigma in pixels at which a wave of the cut-off length keeps half its height."""
    return cutoff_m * HALF_RESPONSE / pixel_m


def window_pixels(metres: Column | float, posting: float = 30.0) -> Column:
    return F.rint((metres if isinstance(metres, Column) else F.lit(metres)) / posting).cast("int")


def stable(coherence: Column | str, least: float) -> Column:
    """Whether a cell is coherent enough; unknown coherence isn't."""
    return F.coalesce(col(coherence), F.lit(0.0)) >= least


def cells_for_area(area_km2: Column, pixel_m: float) -> Column:
    return F.greatest(F.ceil(area_km2 * 1e6 / F.lit(pixel_m * pixel_m)), F.lit(1)).cast("int")


def frame_cutoff(rows: Column, cols: Column, pixel_m: float) -> Column:
    """The wavelength (m) beyond which a surface is nearly a plane over a field."""
    return 4 * F.greatest(rows, cols) * F.lit(pixel_m)


def window_coordinate(i: Column, n: Column) -> Column:
    """-1 to 1 along a window of n cells; -1 in a window of one."""
    return F.when(n > 1, 2 * i / (n - 1) - 1).otherwise(-1.0)


def fit_step(rows: Column, cols: Column, *, most: int = 50, least: int = 100) -> Column:
    """Every how many cells a window is sampled: the largest of ``most`` halved again and again that leaves ``least`` samples."""
    steps = []
    while most > 1:
        steps.append(most)
        most //= 2
    out = F.lit(1)
    for k in reversed(steps):
        out = F.when(F.ceil(rows / k) * F.ceil(cols / k) >= least, k).otherwise(out)
    return out.cast("int")


def polynomial_terms(x: Column, y: Column, order: float) -> list[Column]:
    """The terms that :func:`polynomial` weighs, the constant last."""
    terms = {0: [], 1: [x, y], 1.5: [x, y, x * y], 2: [x * x, y * y, x * y, x, y], 3: [x * x * x, y * y * y, x * x * y, x * y * y, x * x, y * y, x * y, x, y]}[order]
    return [*terms, F.lit(1.0)]


def polynomial_sigma(x: Column, y: Column, covariance: Column, order: float) -> Column:
    """The standard error of a polynomial's value from its coefficients' covariance (an array of rows)."""
    t = polynomial_terms(x, y, order)
    total = reduce(lambda a, b: a + b, [t[i] * t[j] * covariance[i][j] for i in range(len(t)) for j in range(len(t))])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def grid_factor(k: Column) -> Column:
    """A factor of grid sigmas: a number from 0 up; an error for other texts and negative ones."""
    number = k.try_cast("double")
    return F.when(number >= 0, number).otherwise(F.raise_error(F.concat(F.lit("k_grid has to be a number from 0: "), F.coalesce(k, F.lit("NULL")))).cast("double"))


def coherence_weight(c: Column | str, power: float) -> Column:
    if not power:
        return F.lit(1.0)
    return F.pow(F.least(F.greatest(F.coalesce(col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(power))


def base_weight(is_valid: Column, is_filled: Column, filled: float = 0.02) -> Column:
    return F.when(is_valid, 1.0).when(is_filled, filled).otherwise(0.0)


def polynomial(x: Column, y: Column, coef: Column, order: float) -> Column:
    """Terms of order 0, 1, 1.5 (with xy), 2 and 3, the constant last."""
    terms = {0: [], 1: [x, y], 1.5: [x, y, x * y], 2: [x * x, y * y, x * y, x, y], 3: [x * x * x, y * y * y, x * x * y, x * y * y, x * x, y * y, x * y, x, y]}[order]
    return reduce(lambda a, b: a + b, [coef[i] * t for i, t in enumerate(terms)], coef[len(terms)])


def los_projection(e: Column, n: Column, u: Column, le: Column, ln: Column, lu: Column, scale: Column | float = 1.0) -> Column:
    """East, north and up along the line of sight; NULL where there is no look (east and north both 0)."""
    return F.when(~((le == 0) & (ln == 0)), (e * le + n * ln + u * lu) * scale)


def los_sigma(e: Column, n: Column, u: Column, le: Column, ln: Column, lu: Column, scale: Column | float = 1.0) -> Column:
    size = F.abs(scale) if isinstance(scale, Column) else abs(scale)
    return F.when(~((le == 0) & (ln == 0)), F.sqrt(e * e * le * le + n * n * ln * ln + u * u * lu * lu) * size)


def los_up(e: Column, n: Column) -> Column:
    return F.sqrt(F.greatest(1 - e * e - n * n, F.lit(0.0)))


def incidence_degrees(u: Column) -> Column:
    return F.coalesce(F.degrees(F.acos(u)), F.lit(0.0))


def project_vertical(los: Column, sigma: Column, e: Column, n: Column, u: Column, east: Column, north: Column, sigma_east: Column, sigma_north: Column, min_up: float = 0.1) -> tuple[Column, Column]:
    """(up, its sigma) of one look after the known horizontal motion is taken out; NULL for looks nearly flat."""
    ok = F.abs(u) >= min_up
    up = (los - e * east - n * north) / u
    spread = F.sqrt(sigma * sigma + e * e * sigma_east * sigma_east + n * n * sigma_north * sigma_north) / F.abs(u)
    return F.when(ok, up), F.when(ok, spread)


def sigma_cal(grid: Column, fit: Column, k: float, tropo: Column | None = None, ref: Column | None = None, inflation: Column | None = None) -> Column:
    """Root of the summed squares of the scaled grid, fit, troposphere and reference terms, times the inflation."""
    total = (grid * k) * (grid * k) + fit * fit
    for term in (tropo, ref):
        if term is not None:
            total = total + term * term
    return F.sqrt(total) * (inflation if inflation is not None else F.lit(1.0))


def tropo_los(zenith: Column, up: Column, reference: Column | None = None) -> Column:
    """Zenith delay along the line of sight, sign as displacement, less that of the reference."""
    out = -F.try_divide(zenith, up)
    return out if reference is None else out - reference


def between_epochs(early: Column, late: Column, t0: Column, t1: Column, t: Column) -> Column:
    """Linear in time; NULL outside [t0, t1]."""
    w = F.try_divide(t - t0, t1 - t0)
    return F.when((t >= t0) & (t <= t1), (1 - F.coalesce(w, F.lit(0.0))) * early + F.coalesce(w, F.lit(0.0)) * late)


def rupture_length_km(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), F.lit(-3.55) + F.lit(0.74) * magnitude)


def distance_growth(distance: Column, scale: float, most: float) -> Column:
    """1 at distance 0, rising to ``most``."""
    return 1 + (most - 1) * (1 - F.exp(-distance / scale))


def hann(i: Column, n: int) -> Column:
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * i / (n - 1)) if n > 1 else F.lit(1.0)


def try_day(s: Column | str) -> Column:
    """A date written 2022-01-31 or 20220131; NULL otherwise."""
    s = col(s)
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(s, "yyyy-MM-dd")), F.when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd")))


#: Fixed format of displacement product names.
PRODUCT = r"^OPERA_L3_DISP-S1_([A-Z]+)_F(\d{5})_([A-Z]{2})_(\d{8}T\d{6}Z)_(\d{8}T\d{6}Z)_v(\d+\.\d+)_(\d{8}T\d{6}Z)"


def product_fields(name: Column | str) -> dict[str, Column]:
    """mode, frame_id, polarization, reference, secondary, version, production of a product's name; NULL if it isn't one."""
    name = col(name)
    part = lambda i: F.when(name.rlike(PRODUCT), F.regexp_extract(name, PRODUCT, i))
    return {"mode": part(1), "frame_id": part(2).cast("int"), "polarization": part(3), "reference": part(4), "secondary": part(5), "version": part(6), "production": part(7)}


def name_dates(name: Column | str) -> tuple[Column, Column]:
    """(reference, secondary) day of the first two time stamps in a name; a single one is the secondary."""
    found = F.regexp_extract_all(col(name), F.lit(r"(\d{8})T\d{6}"), F.lit(1))
    day = lambda i: F.try_to_date(F.get(found, F.lit(i)), "yyyyMMdd")
    return F.when(F.size(found) >= 2, day(0)), F.when(F.size(found) >= 2, day(1)).when(F.size(found) == 1, day(0))


def great_circle_velocity(lon: Column, lat: Column, pole_lon: float, pole_lat: float, rate: float, radius_mm: float = 6_371_000_000.0) -> tuple[Column, Column]:
    """(east, north) in mm/yr of rigid plate motion about a pole, at ``rate`` degrees per million years."""
    w = math.radians(rate) * 1e-6 * radius_mm
    px, py, pz = math.cos(math.radians(pole_lat)) * math.cos(math.radians(pole_lon)), math.cos(math.radians(pole_lat)) * math.sin(math.radians(pole_lon)), math.sin(math.radians(pole_lat))
    lo, la = F.radians(lon), F.radians(lat)
    x, y, z = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    vx, vy, vz = (py * z - pz * y) * w, (pz * x - px * z) * w, (px * y - py * x) * w
    return -F.sin(lo) * vx + F.cos(lo) * vy, -F.sin(la) * F.cos(lo) * vx - F.sin(la) * F.sin(lo) * vy + F.cos(la) * vz
