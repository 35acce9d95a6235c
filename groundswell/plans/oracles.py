"""DuckDB SQL for the registered queries that SQL can express, written from the operators' definitions."""

from __future__ import annotations

import math

from groundswell.plans.fixtures import EVENTS

TILES = "tiles AS (SELECT vec_id, ((i - 1) // 8)::INTEGER AS r, ((i - 1) % 8)::INTEGER AS c, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"
GAPPY = TILES + ", gappy AS (SELECT vec_id, r, c, CASE WHEN (vec_id * 3 + r * 5 + c * 7) % 11 < 2 THEN NULL ELSE v END AS v, ((vec_id + r + c * 2) % 10) / 10.0::DOUBLE AS coherence FROM tiles)"
SCENE = """scene AS (SELECT (event_id // 10000)::INTEGER AS frame, (event_id % 10000 // 100)::INTEGER AS r, (event_id % 100)::INTEGER AS c,
  CASE WHEN event_type <> 'error' THEN value END AS v, event_type <> 'error' AS ok, event_type AS label, regexp_extract(props, '(\\d+)', 1)::DOUBLE / 100.0::DOUBLE AS coherence FROM events)"""


def _year(ts: str) -> str:
    start = lambda y: f"epoch_us(make_timestamp({y}, 1, 1, 0, 0, 0.0::DOUBLE))"
    return f"(year({ts}) + (epoch_us({ts}) - {start(f'year({ts})')})::DOUBLE / ({start(f'year({ts}) + 1')} - {start(f'year({ts})')})::DOUBLE)"


SERIES = f"series AS (SELECT user_id, event_id AS ord, {_year('ts')} AS t, value AS y, (1 + event_id % 5)::DOUBLE AS sigma FROM events)"
DAYS = "days AS (SELECT user_id, event_id AS ord, epoch_us(ts)::DOUBLE / 86400000000.0::DOUBLE - 19723.0::DOUBLE AS t, value AS y FROM events)"
LOOKS = """looks0 AS (SELECT l_orderkey, l_extendedprice / 100000.0::DOUBLE AS los, 0.01::DOUBLE + l_tax AS sigma, (CASE WHEN l_linestatus = 'O' THEN -0.6::DOUBLE ELSE 0.6::DOUBLE END) + l_discount AS e, -0.1::DOUBLE AS n FROM lineitem),
looks AS (SELECT *, sqrt(1 - e * e - n * n) AS u FROM looks0)"""
STATIONS = "stations AS (SELECT n_nationkey::BIGINT AS id, ((n_nationkey * 37) % 360)::DOUBLE AS lon, ((n_nationkey * 13) % 150 - 75)::DOUBLE AS lat FROM nation)"
PAIRS = "pairs AS (SELECT o_orderkey AS pair_id, o_orderdate AS ref, o_orderdate + INTERVAL 30 DAY AS sec FROM orders)"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE"


def _plane(value: str, source: str, keys: str, x: str, y: str) -> str:
    """CTE body: p0, px, py of a plane by Cramer's rule."""
    m = [["n", "sx", "sy"], ["sx", "sxx", "sxy"], ["sy", "sxy", "syy"]]
    rhs = ["sv", "sxv", "syv"]

    def det(a: list[list[str]]) -> str:
        return f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]}) - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]}) + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"

    swapped = [[[rhs[i] if j == k else m[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    sums = f"SELECT {keys}, count({value})::DOUBLE AS n, sum({x})::DOUBLE AS sx, sum({y})::DOUBLE AS sy, sum({x} * {x})::DOUBLE AS sxx, sum({x} * {y})::DOUBLE AS sxy, sum({y} * {y})::DOUBLE AS syy, sum({value}) AS sv, sum({x} * {value}) AS sxv, sum({y} * {value}) AS syv FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL"
    return f"SELECT {keys}, " + ", ".join(f"{det(swapped[k])} / nullif({det(m)}, 0) AS {name}" for k, name in enumerate(("p0", "px", "py"))) + f" FROM ({sums})"


def _stats(source: str, keys: str, d: str, a: str, b: str, name: str) -> str:
    """CTEs <name>: the statistics of d = a - b."""
    return f"""{name}_d AS (SELECT {keys}, {a} AS a, {b} AS b, {d} AS d FROM {source} WHERE {d} IS NOT NULL),
{name}_m AS (SELECT {keys}, median(d) AS med FROM {name}_d GROUP BY ALL),
{name} AS (SELECT {keys}, count(d) AS n, avg(d) AS bias, max(med) AS median, sqrt(avg(d * d)) AS rmse, stddev_pop(d) AS std, 1.4826::DOUBLE * median(abs(d - med)) AS nmad, corr(a, b) AS corr FROM {name}_d JOIN {name}_m USING ({keys}) GROUP BY {keys})"""


def _values(rows: list[tuple], kinds: str = "") -> str:
    return ", ".join("(" + ", ".join(repr(x) + ("::DOUBLE" if isinstance(x, float) else "") if not isinstance(x, str) else f"'{x}'" for x in row) + ")" for row in rows)


def _taps(n: int, sigma: float, mode: str, truncate: float) -> list[tuple[int, int, float]]:
    """(input, output, weight) along an axis: each tap walks back from beyond the ends, one mirror or clamp at a time."""
    reach = int(truncate * sigma + 0.5)
    density = {k: math.exp(-k * k / (2.0 * sigma * sigma)) for k in range(reach + 1)}
    whole = density[0] + 2 * sum(density[k] for k in range(1, reach + 1))
    rows = []
    for out in range(n):
        for k in range(-reach, reach + 1):
            at = out + k
            while mode == "reflect" and not 0 <= at < n:
                at = -1 - at if at < 0 else 2 * n - 1 - at
            if mode == "nearest":
                at = sorted((0, at, n - 1))[1]
            if 0 <= at < n:
                rows.append((at, out, density[abs(k)] / whole))
    return rows


def _gauss(source: str, keys: str, values: list[str], n: int, sigma: float, name: str, mode: str = "constant", truncate: float = 4.0) -> str:
    """CTEs: <name> holds the values smoothed along both axes."""
    k = _values(_taps(n, sigma, mode, truncate))
    first = ", ".join(f"sum(coalesce({v}, 0) * kw) AS {v}" for v in values)
    return f"""{name}_k(ki, ko, kw) AS (VALUES {k}),
{name}_1 AS (SELECT {keys}, ko AS r, c, {first} FROM {source} JOIN {name}_k ON r = ki GROUP BY {keys}, ko, c),
{name} AS (SELECT {keys}, r, ko AS c, {", ".join(f"sum({v} * kw) AS {v}" for v in values)} FROM {name}_1 JOIN {name}_k ON c = ki GROUP BY {keys}, r, ko)"""


def _line(source: str, by: str, w: str, name: str) -> str:
    """CTEs: <name> has n, sw, sww, t_bar, level, s_tt, slope of weighted lines."""
    return f"""{name}_m AS (SELECT {by}, count(y) AS n, sum({w}) AS sw, sum({w} * {w}) AS sww, sum({w} * t) / sum({w}) AS t_bar, sum({w} * y) / sum({w}) AS level FROM {source} GROUP BY ALL),
{name}_c AS (SELECT {by}, sum({w} * (t - t_bar) * (t - t_bar)) AS s_tt, sum({w} * (t - t_bar) * (y - level)) AS s_ty FROM {source} JOIN {name}_m USING ({by}) GROUP BY {by}),
{name} AS (SELECT m.*, s_tt, CASE WHEN s_tt > 1e-12::DOUBLE THEN s_ty / s_tt END AS slope FROM {name}_m m JOIN {name}_c USING ({by}))"""


def _resample(method: str) -> str:
    by = "user_id, t0"
    start = f"""WITH {DAYS}, targets(t0) AS (VALUES {_values([(t,) for t in (0.0, 4.0, 9.5, 15.0, 22.25, 29.0)])}),
span AS (SELECT user_id, min(t) AS first, max(t) AS last FROM days GROUP BY 1),
win0 AS (SELECT user_id, t0, ord, t, y, 1.0::DOUBLE AS w FROM days JOIN targets ON abs(t - t0) <= 4.0::DOUBLE)"""
    last = "win0"
    if method == "huber":
        for k in (1, 2):
            start += f""",
{_line(last, by, "w", f"f{k}")},
res{k} AS (SELECT user_id, t0, ord, t, y, y - (level + slope * (t - t_bar)) AS res FROM {last} JOIN f{k} USING ({by})),
far{k} AS (SELECT *, abs(res - median(res) OVER (PARTITION BY {by})) AS far FROM res{k}),
mad{k} AS (SELECT *, 1.4826::DOUBLE * median(far) OVER (PARTITION BY {by}) AS mad FROM far{k}),
win{k} AS (SELECT user_id, t0, ord, t, y, CASE WHEN mad > 1e-12::DOUBLE AND far / mad > 1.345::DOUBLE THEN 1.345::DOUBLE / (far / mad) ELSE 1.0::DOUBLE END AS w FROM mad{k})"""
            last = f"win{k}"
    start += f",\n{_line(last, by, 'w', 'fit')}"
    base = "fit"
    if method == "theil_sen":
        start += f""",
ts AS (SELECT a.user_id, a.t0, median((b.y - a.y) / (b.t - a.t)) AS slope FROM win0 a JOIN win0 b ON a.user_id = b.user_id AND a.t0 = b.t0 AND a.ord < b.ord AND abs(b.t - a.t) > 1e-12::DOUBLE GROUP BY ALL),
tsi AS (SELECT user_id, t0, max(slope) AS slope, median(y - slope * t) AS intercept FROM win0 JOIN ts USING ({by}) GROUP BY {by}),
fit2 AS (SELECT f.user_id, f.t0, f.n, f.n::DOUBLE AS sw, f.n::DOUBLE AS sww, f.t_bar, f.s_tt, i.slope, i.intercept + i.slope * f.t_bar AS level FROM fit f JOIN tsi i USING ({by}))"""
        base = "fit2"
    return start + f""",
rss AS (SELECT user_id, t0, sum((y - (level + slope * (t - t_bar))) * (y - (level + slope * (t - t_bar)))) AS rss FROM win0 JOIN {base} USING ({by}) GROUP BY {by}),
done AS (SELECT *, n >= 3 AND s_tt > 1e-12::DOUBLE AND t0 >= first AND t0 <= last AS good FROM {base} JOIN rss USING ({by}) JOIN span USING (user_id))
SELECT user_id, t0, n, {r("CASE WHEN good THEN level + slope * (t0 - t_bar) END", 4)} AS value,
  {r("CASE WHEN good THEN sqrt(rss / greatest(n - 2, 1)) * sqrt(1 / greatest(sw * sw / sww, 1.0::DOUBLE) + (t0 - t_bar) * (t0 - t_bar) / nullif(s_tt, 0)) END", 4)} AS sigma FROM done"""


def _local_linear() -> str:
    s = 2.0
    names = ["s0", "sx", "sy", "sxx", "sxy", "syy", "r0", "rx", "ry"]
    x, y = f"(c / {s}::DOUBLE)", f"(r / {s}::DOUBLE)"
    moments = f"""SELECT vec_id, r, c, w AS s0, w * {x} AS sx, w * {y} AS sy, w * {x} * {x} AS sxx, w * {x} * {y} AS sxy, w * {y} * {y} AS syy, w * f AS r0, w * {x} * f AS rx, w * {y} * f AS ry
FROM (SELECT vec_id, r, c, CASE WHEN v IS NOT NULL THEN 1 + coherence ELSE 0.0::DOUBLE END AS w, coalesce(v, 0.0::DOUBLE) AS f FROM gappy)"""
    return f"""WITH {GAPPY}, moments AS ({moments}), {_gauss("moments", "vec_id", names, 8, s, "g")},
eq AS (SELECT vec_id, r, c, s0, r0, s0 + x AS a, sx - {x} * s0 AS b, sy - {y} * s0 AS d, sxx - 2 * {x} * sx + {x} * {x} * s0 + x AS e, sxy - {x} * sy - {y} * sx + {x} * {y} * s0 AS h, syy - 2 * {y} * sy + {y} * {y} * s0 + x AS k, rx - {x} * r0 AS p, ry - {y} * r0 AS q
  FROM (SELECT *, 1e-6::DOUBLE * greatest(s0, 1e-6::DOUBLE) AS x FROM g))
SELECT vec_id, r, c, {r("(r0 * (e * k - h * h) - b * (p * k - h * q) + d * (p * h - e * q)) / nullif(a * (e * k - h * h) - b * (b * k - h * d) + d * (b * h - e * d), 0)", 5)} AS level, {r("s0", 5)} AS coverage FROM eq"""


def _surface_sigma() -> str:
    s = 1.5
    n_eff = f"(CASE WHEN s2 > 0 THEN {4 * math.pi * s * s!r}::DOUBLE * s0 * s0 / s2 ELSE 0 END)"
    ok = f"s0 > 1e-3::DOUBLE AND {n_eff} > 0"
    return f"""WITH {TILES}, src AS (SELECT vec_id, r, c, 1.0::DOUBLE AS s0, (v - 0.01::DOUBLE * r) * (v - 0.01::DOUBLE * r) AS sr2, 1.0::DOUBLE AS s2 FROM tiles),
{_gauss("src", "vec_id", ["s0", "sr2"], 8, s, "g")}, {_gauss("src", "vec_id", ["s2"], 8, s / math.sqrt(2.0), "h")},
j AS (SELECT g.*, h.s2 FROM g JOIN h USING (vec_id, r, c))
SELECT vec_id, r, c, {r(f"CASE WHEN {ok} THEN {n_eff} END", 5)} AS n_eff, {r(f"CASE WHEN {ok} THEN sqrt(sr2 / s0 / {n_eff}) END", 5)} AS sigma_fit FROM j"""


def _hann() -> str:
    wins = [(p, q) for p in ((0, 4), (2, 6), (4, 8)) for q in ((0, 4), (2, 6), (4, 8))]
    cells = [(k, i, j, p[0], p[1], q[0], q[1]) for k, (p, q) in enumerate(wins) for i in range(*p) for j in range(*q)]
    taper = lambda i, n: f"(CASE WHEN {n} > 1 THEN 0.5::DOUBLE - 0.5::DOUBLE * cos({2 * math.pi!r}::DOUBLE * ({i}) / ({n} - 1)) ELSE 1 END)"
    return f"""WITH {GAPPY}, win(win, r, c, r0, r1, c0, c1) AS (VALUES {_values(cells)}),
rows AS (SELECT * FROM gappy JOIN win USING (r, c)),
fit AS ({_plane("v", "rows", "vec_id, win", "c", "r")}),
enough AS (SELECT vec_id, win FROM rows GROUP BY ALL HAVING count(v) >= count(*) * (1 - 0.8::DOUBLE)),
tapered AS (SELECT vec_id, r, c, p0 + px * c + py * r AS level, CASE WHEN v IS NOT NULL THEN {taper("r - r0", "(r1 - r0)")} * {taper("c - c0", "(c1 - c0)")} ELSE 0 END AS taper FROM rows JOIN fit USING (vec_id, win) JOIN enough USING (vec_id, win)),
blend AS (SELECT vec_id, r, c, sum(taper * level) / nullif(sum(taper), 0) AS surface FROM tapered GROUP BY ALL)
SELECT vec_id, r, c, {r("surface", 5)} AS surface FROM tiles LEFT JOIN blend USING (vec_id, r, c)"""


def _nearest(source: str) -> str:
    """CTEs ending in near(vec_id, r, c, value, d2): the nearest valid cell of ``source``, ties by row and column."""
    return f"""near AS (SELECT a.vec_id, a.r, a.c, arg_min(b.v, ((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) * 64 + b.r * 8 + b.c) AS value, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2
FROM {source} a JOIN {source} b ON a.vec_id = b.vec_id AND b.v IS NOT NULL GROUP BY 1, 2, 3)"""


def _bilinear() -> str:
    def corners(n: int, m: int) -> list[tuple[int, int, float]]:
        out = []
        for o in range(m):
            src = o * (n - 1) / (m - 1)
            i = min(int(src), n - 2)
            out += [(i, o, float(1 - (src - i))), (i + 1, o, float(src - i))]
        return out

    return f"""WITH {GAPPY}, tr(r, ro, rw) AS (VALUES {_values(corners(8, 13))}), tc(c, co, cw) AS (VALUES {_values(corners(8, 11))}),
j AS (SELECT vec_id, ro, co, sum(rw * cw * coalesce(v, 0)) AS v, bool_or(rw >= 0.5::DOUBLE AND cw >= 0.5::DOUBLE AND v IS NULL) AS gone FROM gappy JOIN tr USING (r) JOIN tc USING (c) GROUP BY ALL)
SELECT vec_id, ro AS r, co AS c, {r("CASE WHEN NOT gone THEN v END")} AS v FROM j"""


def _decompose() -> str:
    return f"""WITH {LOOKS}, w AS (SELECT *, 1 / (sigma * sigma + n * n * {0.05 * 0.05!r}::DOUBLE) AS w, abs(u) >= 0.1::DOUBLE AS flat FROM looks),
s AS (SELECT l_orderkey, count(*) AS n_looks, sum(w * e * e) AS a, sum(w * e * u) AS b, sum(w * u * u) AS d, sum(w * e * los) AS re, sum(w * u * los) AS ru,
  sum(CASE WHEN flat THEN w * u * u * ((los - e * 0.02::DOUBLE) / u) END) / sum(CASE WHEN flat THEN w * u * u END) AS up1, 1 / sqrt(sum(CASE WHEN flat THEN w * u * u END)) AS sigma1 FROM w GROUP BY 1),
g AS (SELECT *, a * d - b * b AS det, (a + d) / 2 + sqrt(greatest((a - d) / 2 * ((a - d) / 2) + b * b, 0)) AS hi, (a + d) / 2 - sqrt(greatest((a - d) / 2 * ((a - d) / 2) + b * b, 0)) AS lo FROM s),
f AS (SELECT *, n_looks >= 2 AND lo > 1e-6::DOUBLE * hi AND CASE WHEN lo > 0 THEN sqrt(hi / lo) <= 10 ELSE FALSE END AS fit FROM g)
SELECT l_orderkey, n_looks, (CASE WHEN fit THEN 2 WHEN up1 IS NOT NULL THEN 1 ELSE 0 END)::INTEGER AS mode, {r("CASE WHEN fit THEN (d * re - b * ru) / det END", 5)} AS east,
  {r("CASE WHEN fit THEN (a * ru - b * re) / det ELSE up1 END", 5)} AS up, {r("CASE WHEN fit THEN sqrt(d / det) END", 5)} AS sigma_east, {r("CASE WHEN fit THEN sqrt(a / det) ELSE sigma1 END", 5)} AS sigma_up FROM f"""


def _polynomials() -> str:
    x, y = "(c / 7.0::DOUBLE)", "(r / 7.0::DOUBLE)"
    terms = {"p0": [], "p1": [x, y], "p1_5": [x, y, f"{x} * {y}"], "p2": [f"{x} * {x}", f"{y} * {y}", f"{x} * {y}", x, y], "p3": [f"{x} * {x} * {x}", f"{y} * {y} * {y}", f"{x} * {x} * {y}", f"{x} * {y} * {y}", f"{x} * {x}", f"{y} * {y}", f"{x} * {y}", x, y]}
    cols = []
    for name, t in terms.items():
        parts = [f"{(k + 1) / 10!r}::DOUBLE * {e}" for k, e in enumerate(t)] + [f"{(len(t) + 1) / 10!r}::DOUBLE"]
        cols.append(f"{r(' + '.join(parts))} AS {name}")
    return f"WITH {TILES} SELECT vec_id, r, c, {', '.join(cols)} FROM tiles"


def _plate() -> str:
    w = math.radians(0.2) * 1e-6 * 6_371_000_000.0
    lo, la = math.radians(-80.0), math.radians(-5.0)
    px, py, pz = (f"{v!r}::DOUBLE" for v in (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)))
    return f"""WITH {STATIONS}, p AS (SELECT id, radians(lon) AS lo, radians(lat) AS la FROM stations),
q AS (SELECT *, cos(la) * cos(lo) AS x, cos(la) * sin(lo) AS y, sin(la) AS z FROM p),
v AS (SELECT *, ({py} * z - {pz} * y) * {w!r}::DOUBLE AS vx, ({pz} * x - {px} * z) * {w!r}::DOUBLE AS vy, ({px} * y - {py} * x) * {w!r}::DOUBLE AS vz FROM q)
SELECT id, {r("-sin(lo) * vx + cos(lo) * vy")} AS east, {r("-sin(la) * cos(lo) * vx - sin(la) * sin(lo) * vy + cos(la) * vz")} AS north, {r("pow(10.0::DOUBLE, -3.55::DOUBLE + 0.74::DOUBLE * (6.0::DOUBLE + id / 20.0::DOUBLE))")} AS rupture_km FROM v"""


def _events() -> str:
    return "ev(event, t0, t1) AS (VALUES " + ", ".join(f"('{e}', TIMESTAMP '{a}', TIMESTAMP '{b or a}')" for e, a, b in EVENTS) + ")"


PRODUCT = r"^OPERA_L3_DISP-S1_([A-Z]+)_F(\d{5})_([A-Z]{2})_(\d{8}T\d{6}Z)_(\d{8}T\d{6}Z)_v(\d+\.\d+)_(\d{8}T\d{6}Z)"
NAMES = """names AS (SELECT p_partkey, 'OPERA_L3_DISP-' || CASE WHEN p_partkey % 7 = 0 THEN 'STATIC' ELSE 'S1' END || '_IW_F' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || '_VV_2022' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '11T002312Z_2023' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '22T002313Z_v0.5_20231101T000000Z.nc' AS name FROM part)"""


def _filename() -> str:
    part = lambda i: f"CASE WHEN regexp_matches(name, '{PRODUCT}') THEN regexp_extract(name, '{PRODUCT}', {i}) END"
    day = lambda i: f"substr(regexp_extract_all(name, '\\d{{8}}T\\d{{6}}')[{i}], 1, 8)"
    iso = lambda s: f"substr({s}, 1, 4) || '-' || substr({s}, 5, 2) || '-' || substr({s}, 7, 2)"
    return f"WITH {NAMES} SELECT p_partkey, {part(1)} AS mode, ({part(2)})::INTEGER AS frame_id, {part(3)} AS polarization, {part(4)} AS reference, {part(5)} AS secondary, {part(6)} AS version, {part(7)} AS production, {iso(day(1))} AS ref_day, {iso(day(2))} AS sec_day FROM names"


def oracle_sql() -> dict[str, str]:
    calibrated = f"""WITH {TILES}, t AS (SELECT vec_id, r, c, v AS disp, (vec_id % 7 + r * 2 - c) / 100.0::DOUBLE AS gnss FROM tiles), td AS (SELECT *, disp - gnss AS d FROM t),
p AS ({_plane("d", "td", "vec_id", "(c - 3.5::DOUBLE)", "(r - 3.5::DOUBLE)")}),
cal AS (SELECT vec_id, disp, gnss, disp - (p0 + px * (c - 3.5::DOUBLE) + py * (r - 3.5::DOUBLE)) AS calibrated FROM td JOIN p USING (vec_id)),
{_stats("cal", "vec_id", "calibrated - gnss", "calibrated", "gnss", "sa")}, {_stats("cal", "vec_id", "disp - gnss", "disp", "gnss", "sb")}
SELECT sa.vec_id, sa.n, {r("sb.rmse")} AS rmse_before, {r("sa.rmse")} AS rmse, {r("sa.nmad")} AS nmad FROM sa JOIN sb USING (vec_id)"""
    velocity = f"""WITH {SERIES}, wl AS (SELECT user_id, t, y, 1 / (sigma * sigma) AS w FROM series), {_line("wl", "user_id", "w", "fit")},
chi AS (SELECT user_id, sum(w * (y - (level + slope * (t - t_bar))) * (y - (level + slope * (t - t_bar)))) AS chi FROM wl JOIN fit USING (user_id) GROUP BY 1)
SELECT user_id, n, {r("slope", 4)} AS slope, {r("sqrt(chi / greatest(n - 2, 1) / s_tt)", 4)} AS slope_sigma FROM fit JOIN chi USING (user_id)"""
    nearest = lambda t: f"arg_min(y, (abs(t - {t}::DOUBLE), ord)) AS y{int(t)}, min(abs(t - {t}::DOUBLE)) AS d{int(t)}"
    regions = f"""reg AS (SELECT frame, label, median(v) AS med, count(*) AS n FROM scene WHERE ok GROUP BY ALL),
off AS (SELECT *, coalesce(round_even((med - first(med) OVER (PARTITION BY frame ORDER BY n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 0.5::DOUBLE, 0), 0)::INTEGER AS cycles FROM reg)"""
    block = lambda f, expr, n=100: f"SELECT frame, (r // {f})::INTEGER AS r, (c // {f})::INTEGER AS c, {expr} FROM scene WHERE r < {n // f * f} AND c < {n // f * f} GROUP BY 1, 2, 3"
    los = f"""WITH {STATIONS}, a AS (SELECT id, lon / 360 * 10 AS e, lat / 90 * 5 AS n, lon / 360 - lat / 90 AS u, CASE WHEN id % 5 = 0 THEN 0.0::DOUBLE ELSE lon / 360 * 0.6::DOUBLE END AS le, CASE WHEN id % 5 = 0 THEN 0.0::DOUBLE ELSE lat / 90 * 0.1::DOUBLE END AS ln FROM stations),
b AS (SELECT *, sqrt(greatest(1 - le * le - ln * ln, 0)) AS lu, NOT (le = 0 AND ln = 0) AS looked FROM a)
SELECT id, {r("CASE WHEN looked THEN (e * le + n * ln + u * lu) * -1.5::DOUBLE END")} AS los, {r("CASE WHEN looked THEN sqrt(e * e * le * le + n * n * ln * ln + u * u * lu * lu) * 1.5::DOUBLE END")} AS los_sigma, {r("coalesce(degrees(acos(lu)), 0)")} AS incidence FROM b"""
    sample = f"""WITH {GAPPY}, pts AS (SELECT vec_id, k, (vec_id % 17 + k * 7) / 4.0::DOUBLE - 0.5::DOUBLE AS y, (vec_id % 13 + k * 5) / 4.0::DOUBLE AS x FROM embeddings, (SELECT unnest(range(0, 5)) AS k)),
cor AS (SELECT vec_id, k, (floor(y) + a)::INTEGER AS r, (floor(x) + b)::INTEGER AS c, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM pts, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b)),
met AS (SELECT cor.*, g.v FROM cor LEFT JOIN gappy g USING (vec_id, r, c) WHERE w > 0)
SELECT vec_id, k::INTEGER AS k, {r("CASE WHEN count(v) = count(*) THEN sum(w * v) END")} AS sample FROM met GROUP BY vec_id, k"""
    tropo = f"""WITH {LOOKS}, z AS (SELECT l_orderkey, u, e, los, sigma * 100 AS t FROM looks),
d AS (SELECT l_orderkey, CASE WHEN t >= 0 AND t <= 6 THEN -((1 - t / 6.0::DOUBLE) * los + t / 6.0::DOUBLE * (los * 1.2::DOUBLE)) / u - e / 100 END AS d FROM z)
SELECT l_orderkey, count(d) AS n, {r("sum(d)")} AS delay FROM d GROUP BY 1"""
    vertical = f"""WITH {LOOKS}, p AS (SELECT l_orderkey, CASE WHEN abs(u) >= 0.75::DOUBLE THEN (los - e * 0.02::DOUBLE - n * 0.01::DOUBLE) / u END AS up, CASE WHEN abs(u) >= 0.75::DOUBLE THEN sqrt(sigma * sigma + e * e * 0.003::DOUBLE * 0.003::DOUBLE + n * n * 0.004::DOUBLE * 0.004::DOUBLE) / abs(u) END AS s FROM looks)
SELECT l_orderkey, count(up) AS n, {r("avg(up)")} AS up, {r("max(s)")} AS up_sigma FROM p GROUP BY 1"""
    manifest = """WITH s AS (SELECT s_suppkey AS k, 'node_' || s_suppkey::VARCHAR AS path, sha256(s_suppkey::VARCHAR || '|' || s_name || '|') AS h, sha256(s_suppkey::VARCHAR || '|' || s_name || '|x') AS hx FROM supplier),
a AS (SELECT path, h AS was FROM s WHERE k % 5 <> 0), b AS (SELECT path, CASE WHEN k % 11 = 0 THEN hx ELSE h END AS now FROM s WHERE k % 7 <> 0)
SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN now IS NULL THEN 'missing' WHEN was IS NULL THEN 'unlisted' WHEN was <> now THEN 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path) WHERE state IS NOT NULL"""
    provenance = """WITH s AS (SELECT s_suppkey AS id, s_nationkey::VARCHAR AS grid, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS snapshot FROM supplier),
o AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'other' ELSE grid END AS grid, CASE WHEN id % 8 <> 0 THEN snapshot ELSE 'new' END AS snapshot FROM s)
SELECT s.id, concat_ws(',', CASE WHEN s.grid IS DISTINCT FROM o.grid THEN 'grid' END, CASE WHEN s.snapshot IS DISTINCT FROM o.snapshot THEN 'snapshot' END) AS differs FROM s JOIN o USING (id)"""
    polygons = {"a": ([10.0, 200.0, 120.5], [-60.5, -20.25, 60.5]), "b": ([250.0, 340.5, 340.5, 250.0], [-10.5, -10.5, 55.5, 55.5])}
    edges = [(i, xs[k], ys[k], xs[(k + 1) % len(xs)], ys[(k + 1) % len(xs)]) for i, (xs, ys) in polygons.items() for k in range(len(xs))]
    polygon = f"""WITH {STATIONS}, ed(poly, x0, y0, x1, y1) AS (VALUES {_values(edges)}),
hits AS (SELECT id, poly, count(CASE WHEN (y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (CASE WHEN y1 <> y0 THEN y1 - y0 ELSE 1 END) + x0 THEN 1 END) % 2 = 1 AS inside FROM stations, ed GROUP BY 1, 2)
SELECT id, bool_or(inside) AS inside FROM hits GROUP BY 1"""
    inner = "inn AS (SELECT vec_id, r, c, CASE WHEN v IS NOT NULL AND v < 0.1::DOUBLE THEN 1.0::DOUBLE END AS v FROM gappy)"
    return {
        "plane_calibration": calibrated,
        "station_velocity_wls": velocity,
        "station_rate_ols": f"WITH {SERIES} SELECT user_id, {r('regr_slope(y, t)', 3)} AS rate, arg_min(sigma, ord) AS sigma FROM series GROUP BY 1",
        "pixel_velocity_min_dates": f"WITH {DAYS} SELECT user_id, {r('CASE WHEN count(y) >= 65 THEN regr_slope(y, t) END')} AS velocity FROM days GROUP BY 1",
        "epoch_displacement_asof": f"WITH {DAYS}, {STATIONS}, n AS (SELECT user_id, {nearest(5.0)}, {nearest(25.0)} FROM days GROUP BY 1) SELECT user_id, id AS station, lon, lat, {r('y25 - y5')} AS dy FROM n JOIN stations ON user_id % 25 = id WHERE d5 <= 0.25::DOUBLE AND d25 <= 0.25::DOUBLE",
        "correction_match_by_date": f"""WITH {PAIRS}, p AS (SELECT ref::DATE AS ref, sec::DATE AS sec, max('disp_' || lpad(pair_id::VARCHAR, 9, '0')) AS path FROM pairs GROUP BY 1, 2),
k AS (SELECT ref::DATE AS day, max('tropo_' || lpad(pair_id::VARCHAR, 9, '0')) AS path FROM pairs WHERE pair_id % 3 = 0 GROUP BY 1)
SELECT p.ref::VARCHAR AS ref, p.sec::VARCHAR AS sec, p.path, a.path AS ref_correction, b.path AS sec_correction FROM p LEFT JOIN k a ON a.day = p.ref LEFT JOIN k b ON b.day = p.sec""",
        "pair_event_overlap": f"WITH {PAIRS}, {_events()} SELECT pair_id, event FROM pairs JOIN ev ON ref <= t1 AND sec >= t0",
        "filename_product_id": _filename(),
        "decimal_year": f"SELECT o_orderkey, round({_year('o_orderdate')}, 9) AS exact, round_even({_year('o_orderdate')}, 4) AS rounded FROM orders",
        "lon_wrap_bbox": f"WITH {STATIONS}, w AS (SELECT id, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS lon, lat FROM stations) SELECT id, lon, lat, lon > -175 AND lon < 111 AND lat > -62 AND lat < 16 AS strict FROM w WHERE lon BETWEEN -175 AND 111 AND lat BETWEEN -62 AND 16",
        "block_mean": f"WITH {TILES} SELECT vec_id, (r // 2)::INTEGER AS r, (c // 2)::INTEGER AS c, {r('avg(v)')} AS v FROM tiles GROUP BY 1, 2, 3",
        "block_median": f"WITH {SCENE} {block(3, r('median(v)') + ' AS v')}",
        "block_weighted_mean": f"WITH {SCENE} {block(6, r('sum(CASE WHEN v IS NOT NULL THEN coherence * v END) / nullif(sum(CASE WHEN v IS NOT NULL THEN coherence END), 0)') + ' AS v')}",
        "majority_mask": f"WITH {SCENE} {block(4, 'avg(CASE WHEN ok AND coherence > 0.4::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.5::DOUBLE AS ok')}",
        "stack_mean_ignore_null": f"WITH {SCENE} SELECT frame, c, {r('avg(v)')} AS mean FROM scene GROUP BY 1, 2",
        "stack_mean_poison": f"WITH {SCENE} SELECT frame, (r // 4)::INTEGER AS block, c, {r('CASE WHEN NOT bool_or(v IS NULL) THEN avg(v) END')} AS mean FROM scene GROUP BY 1, 2, 3",
        "relief_percentiles": f"WITH {SCENE} SELECT frame, {r('quantile_cont(v, 0.95) - quantile_cont(v, 0.05)')} AS relief FROM scene GROUP BY 1",
        "quantile_trim_mask": f"WITH {SCENE}, q AS (SELECT frame, label, quantile_cont(v, 0.15) AS lo, quantile_cont(v, 0.85) AS hi FROM scene GROUP BY 1, 2) SELECT frame, label, count(CASE WHEN v < lo OR v > hi THEN 1 END) AS n_trimmed, count(v) AS n FROM scene JOIN q USING (frame, label) GROUP BY 1, 2",
        "global_mad_outliers": f"WITH {SCENE}, m AS (SELECT frame, median(v) AS med FROM scene GROUP BY 1), a AS (SELECT frame, max(med) AS med, 1.4826::DOUBLE * median(abs(v - med)) AS mad FROM scene JOIN m USING (frame) GROUP BY 1) SELECT frame, r, c, {r('v')} AS v FROM scene JOIN a USING (frame) WHERE abs(v - med) > 3 * mad",
        "residual_statistics": f"WITH {SERIES}, x AS (SELECT user_id, y, sigma * 3 + user_id % 10 AS model FROM series), {_stats('x', 'user_id', 'y - model', 'y', 'model', 'st')} SELECT user_id, n, " + ", ".join(f"{r(k, 8)} AS {k}" for k in ("bias", "median", "rmse", "std", "nmad", "corr")) + " FROM st",
        "region_median_offsets": f"WITH {SCENE}, {regions} SELECT frame, label, {r('med')} AS med, n, cycles FROM off",
        "unwrap_shift": f"WITH {SCENE}, {regions} SELECT frame, r, c, {r('cycles * 0.5::DOUBLE')} AS shift, {r('v - cycles * 0.5::DOUBLE')} AS corrected FROM scene JOIN off USING (frame, label) WHERE ok",
        "largest_region": f"WITH {SCENE}, n AS (SELECT frame, label, count(*) AS n FROM scene GROUP BY 1, 2) SELECT frame, arg_min(label, (-n, label)) AS label, max(n) AS n FROM n GROUP BY 1",
        "reference_pixel": f"WITH {SCENE}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY coherence DESC, r, c) AS k FROM scene WHERE v IS NOT NULL) SELECT frame, r, c, {r('v')} AS reference FROM k WHERE k = 1",
        "decompose_looks": _decompose(),
        "project_vertical": vertical,
        "los_projection": los,
        "sigma_cal": f"WITH {LOOKS} SELECT l_orderkey, {r('avg(sqrt(sigma * 1.35::DOUBLE * sigma * 1.35::DOUBLE + los * los + e / 10 * (e / 10) + 0.002::DOUBLE * 0.002::DOUBLE) * (1 + abs(e)))')} AS s FROM looks GROUP BY 1",
        "coherence_base_weights": f"WITH {SCENE} SELECT frame, r, c, {r('pow(least(greatest(coherence, 0), 1), 8.0::DOUBLE) * CASE WHEN ok THEN 1.0::DOUBLE WHEN r % 2 = 0 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END')} AS w FROM scene",
        "resample_linear": _resample("linear"),
        "resample_huber": _resample("huber"),
        "resample_theil_sen": _resample("theil_sen"),
        "cumulative_series": f"WITH {DAYS} SELECT user_id, ord, {r('sum(y) OVER (PARTITION BY user_id ORDER BY t, ord ROWS UNBOUNDED PRECEDING)', 4)} AS total FROM days",
        "daily_epochs": f"SELECT user_id, ts::DATE::VARCHAR AS day, count(value) AS n, {r('avg(value)')} AS mean, {r('min(value)')} AS low, {r('max(value)')} AS high FROM events GROUP BY 1, 2",
        "running_slope": f"WITH {DAYS} SELECT user_id, count(y) AS n, {r('(count(y) * sum(t * y) - sum(t) * sum(y)) / nullif(count(y) * sum(t * t) - sum(t) * sum(t), 0)', 4)} AS slope FROM days GROUP BY 1",
        "gaussian_smooth_constant": f"WITH {TILES}, {_gauss('tiles', 'vec_id', ['v'], 8, 1.0, 'g')} SELECT vec_id, r, c, {r('v')} AS v FROM g",
        "gaussian_masked_reflect": f"WITH {GAPPY}, src AS (SELECT vec_id, r, c, v, (v IS NOT NULL)::INTEGER::DOUBLE AS m FROM gappy), {_gauss('src', 'vec_id', ['v', 'm'], 8, 1.25, 'g', 'reflect', 2.0)} SELECT vec_id, r, c, {r('CASE WHEN m > 0 THEN v / m END')} AS v FROM g",
        "local_linear_surface": _local_linear(),
        "surface_sigma": _surface_sigma(),
        "hann_blend_windows": _hann(),
        "bilinear_upsample": _bilinear(),
        "nearest_upsample": f"WITH {TILES}, fine AS (SELECT (i // 16)::INTEGER AS fr, (i % 16)::INTEGER AS fc FROM (SELECT unnest(range(0, 272)) AS i)) SELECT vec_id, fr AS r, fc AS c, {r('v')} AS v FROM fine JOIN tiles ON r = least(fr // 2, 7) AND c = least(fc // 2, 7)",
        "point_sample_bilinear": sample,
        "nearest_fill": f"WITH {GAPPY}, {_nearest('gappy')} SELECT vec_id, r, c, {r('value')} AS filled FROM near",
        "sigma_extrapolation": f"WITH {GAPPY}, {_nearest('gappy')} SELECT vec_id, r, c, {r('abs(value) * (1 + 2 * (1 - exp(-sqrt(d2) / 2)))')} AS sigma FROM near",
        "sigma_inflation": f"WITH {GAPPY}, {inner}, {_nearest('inn')} SELECT vec_id, r, c, {r('1 + (1 - exp(-sqrt(d2) / 3))')} AS inflation FROM near",
        "tropo_line_of_sight": tropo,
        "polynomial_surface": _polynomials(),
        "plate_motion": _plate(),
        "snapshot_manifest": manifest,
        "provenance_check": provenance,
        "frame_overrides": "SELECT n_nationkey::INTEGER AS frame_id, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey + 1)::VARCHAR ELSE '1.0' END AS k_grid, 'legacy' AS mode FROM nation",
        "polygon_mask": polygon,
    }
