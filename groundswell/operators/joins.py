"""Nearest-epoch, interval, lookup and set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_displacement(obs: DataFrame, keys: list[str], reference: float, secondary: float, tolerance: float, values: tuple[str, ...] = ("y",)) -> DataFrame:
    """Difference of the epochs nearest to two times, of equal distance the first row (by ``ord``); groups without one
    within the tolerance at both times go. One pass, no join: nearest rows are struct minima."""

    def nearest(t: float) -> Column:
        return F.min(F.struct(F.abs(F.col("t") - t).alias("d"), F.col("ord"), *values))

    both = obs.where(" AND ".join(f"{v} IS NOT NULL" for v in values)).groupBy(*keys).agg(nearest(reference).alias("a"), nearest(secondary).alias("b"))
    both = both.where((F.col("a.d") <= tolerance) & (F.col("b.d") <= tolerance))
    return both.select(*keys, *[(F.col(f"b.{v}") - F.col(f"a.{v}")).alias(f"d{v}") for v in values])


def match_corrections(pairs: DataFrame, corrections: DataFrame) -> DataFrame:
    """pairs (ref, sec, path) with the corrections (day, path) of both dates; of repeated pairs or days the last path wins."""
    last = corrections.groupBy("day").agg(F.max("path").alias("path"))
    pairs = pairs.groupBy("ref", "sec").agg(F.max("path").alias("path"))
    for side in ("ref", "sec"):
        pairs = pairs.join(last.select(F.col("day").alias(side), F.col("path").alias(f"{side}_correction")), side, "left")
    return pairs.select("ref", "sec", "path", "ref_correction", "sec_correction")


def affecting(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs (ref, sec) with the events they span: an instant (t1 NULL) between their ends, or a window that overlaps them.

    Events are a catalogue of tens; a larger one is met through buckets of 64 days, so that no nested loop runs over both."""
    low, high = F.least("ref", "sec"), F.greatest("ref", "sec")
    day = lambda c: F.unix_date(c.cast("date"))
    buckets = lambda a, b: F.explode(F.sequence(F.floor(day(a) / 64), F.floor(day(b) / 64)))
    left = pairs.withColumn("_lo", low).withColumn("_hi", high).withColumn("_b", buckets(F.col("_lo"), F.col("_hi")))
    ends = events.withColumn("_t1", F.coalesce("t1", "t0"))
    right = ends.withColumn("_b", buckets(F.col("t0"), F.col("_t1")))
    met = left.join(right, "_b").where((F.col("_lo") <= F.col("_t1")) & (F.col("_hi") >= F.col("t0")))
    return met.drop("_b", "_lo", "_hi", "_t1").distinct()


def bounded(stations: DataFrame, south: float, west: float, north: float, east: float, *, strict: bool) -> DataFrame:
    """Stations inside a box; ``strict`` leaves out its border."""
    lon, lat = F.col("lon"), F.col("lat")
    inside = (lon > west) & (lon < east) & (lat > south) & (lat < north) if strict else lon.between(west, east) & lat.between(south, north)
    return stations.where(inside)


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state (missing, unlisted, changed) of files that a manifest (path, sha256) and a folder (path, sha256) don't agree on."""
    a, b = manifest.select("path", F.col("sha256").alias("was")), files.select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state IS NOT NULL")


def merged(base: Column, new: Column) -> Column:
    """Maps of dotted paths, the second over the first: a value takes the place of all below its path, and values below a
    path take the place of the value at it."""
    under = lambda a, b: F.startswith(a, F.concat(b, F.lit(".")))
    kept = F.map_filter(base, lambda k, _: ~F.exists(F.map_keys(new), lambda n: (n == k) | under(k, n) | under(n, k)))
    return F.map_concat(kept, new)


def overrides(frames: DataFrame, table: DataFrame, default: dict[str, str], extra: dict[str, str] | None = None) -> DataFrame:
    """frame_id and its parameters by dotted path: the default, under the frame's own (keys '00042'), under ``extra``."""
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>")
    met = frames.withColumn("key", F.lpad(F.col("frame_id").cast("string"), 5, "0")).join(table, "key", "left")
    own = F.coalesce("params", of({}))
    out = merged(of(default), own)
    return met.select("frame_id", (merged(out, of(extra)) if extra else out).alias("params"))


def same_provenance(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and the names of fields that differ, null-safely."""
    e = expected.select(*keys, *[F.col(f).alias(f"_e_{f}") for f in fields])
    odd = F.array_compact(F.array(*[F.when(~F.col(f"_e_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    return actual.join(e, keys).select(*keys, odd.alias("differs"))


#: Edges that may be sent to where points lie: 40 bytes each.
BROADCAST_EDGES = 200_000


def polygon_edges(rings: DataFrame, band: float) -> DataFrame:
    """A row for each edge of ``rings`` (id, xs, ys; outer rings and holes alike) and band of y that it crosses; flat edges cross none."""
    each = rings.select("id", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"), F.size("xs").alias("n"), "xs", "ys")
    after = (F.col("i") + 1) % F.col("n")
    edges = each.select("id", F.col("p.xs").alias("x0"), F.col("p.ys").alias("y0"), F.get("xs", after).alias("x1"), F.get("ys", after).alias("y1")).where("y0 <> y1")
    bands = F.sequence(F.floor(F.least("y0", "y1") / band).cast("long"), F.floor(F.greatest("y0", "y1") / band).cast("long"))
    return edges.withColumn("_band", F.explode(bands))


def polygons_around(df: DataFrame, rings: DataFrame, x: str = "x", y: str = "y", *, band: float = 5.0) -> DataFrame:
    """(_x, _y, id): each place of ``df`` once with each polygon of ``rings`` (id, xs, ys) that it lies in by the even-odd rule, so
    that rings inside a polygon's outer one are holes.

    Places meet the edges that cross their band of y, in an equi-join; each (place, polygon) counts the edges to its
    right. Edges are sent along up to a bound, else both sides are dealt out by band."""
    edges = polygon_edges(rings, band)
    few = edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES
    points = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(y) / band).cast("long").alias("_band")).distinct()
    px, py = F.col("_x"), F.col("_y")
    crosses = ((F.col("y0") > py) != (F.col("y1") > py)) & (px < (F.col("x1") - F.col("x0")) * (py - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    met = points.join(F.broadcast(edges) if few else edges, "_band", "left").where(F.coalesce(crosses, F.lit(False)))
    return met.groupBy("_x", "_y", "id").agg((F.count(F.lit(1)) % 2 == 1).alias("odd")).where("odd").drop("odd")


def inside_polygons(df: DataFrame, rings: DataFrame, x: str = "x", y: str = "y", *, band: float = 5.0) -> DataFrame:
    """Adds ``inside``: whether a point lies in any polygon of ``rings`` (``polygons_around``)."""
    hit = polygons_around(df, rings, x, y, band=band).select("_x", "_y").distinct()
    out = df.withColumn("_x", F.col(x)).withColumn("_y", F.col(y)).join(hit.withColumn("_hit", F.lit(True)), ["_x", "_y"], "left")
    return out.withColumn("inside", F.col("_hit").isNotNull()).drop("_x", "_y", "_hit")


#: Ids of a side in one block at most, and parts that ids with the same keys are dealt to.
BLOCK, DEAL = 1024, 64


def sharing(left: DataFrame, right: DataFrame, a: str, b: str, key: str, *, block: int = BLOCK) -> DataFrame:
    """Each (a, b) once, of ``left`` (a, key) and ``right`` (b, key) where the two have a key in common; NULLs have none.

    The result is as large as ids on both sides multiplied, so it is never shuffled, nor made distinct. Ids with the same keys
    are kept in blocks; blocks meet under the least key that they share, hence once; met blocks are dealt out
    evenly, and become rows where they land."""

    def blocks(rows: DataFrame, c: str, to: str) -> DataFrame:
        keys = rows.groupBy(c).agg(F.sort_array(F.collect_set(key)).alias(f"{to}_keys"))
        dealt = keys.groupBy(f"{to}_keys", F.pmod(F.xxhash64(c), F.lit(DEAL)).alias("_part")).agg(F.collect_list(c).alias("_ids"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ids") - 1) / block).cast("int")), lambda k: F.slice("_ids", k * block + 1, F.lit(block)))
        return dealt.where(F.size("_ids") > 0).select(f"{to}_keys", "_part", F.explode(cut).alias(to)).withColumn(key, F.explode(f"{to}_keys"))

    everywhere = blocks(left, a, "_a").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))))
    met = everywhere.join(blocks(right, b, "_b"), [key, "_part"]).where(F.col(key) == F.array_min(F.array_intersect("_a_keys", "_b_keys")))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = met.select("_a", "_b").repartition(parts).select(F.explode("_a").alias(a), "_b")
    # coalesce leaves the partitions as they are: compiled into one loop, both steps would hold the block**2 rows of a block at once
    return each.coalesce(parts).select(a, F.explode("_b").alias(b))
