"""Footprints of earthquakes: the rupture along its strike, buffered, on the WGS 84 ellipsoid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.functions.projection import AXIS, FLATTENING
from groundswell.functions.scalars import rupture_length_km

#: Segments of a quarter of a circle at either end of a ring.
QUARTER = 16


def along(df: DataFrame, lon: Column, lat: Column, azimuth: Column, metres: Column, *, rounds: int = 4) -> DataFrame:
    """``df`` with ``lon`` and ``lat`` of the point that a geodesic of so many metres reaches, by Vincenty's direct series.

    Angles are in degrees, azimuths clockwise from north, longitudes come out in [-180, 180). Each round gains some three
    digits, so four are exact to the millimetre at any distance that a footprint has. NULL where an input is NULL.
    """
    polar = AXIS * (1 - FLATTENING)
    ratio = (AXIS**2 - polar**2) / polar**2
    c = F.col
    start = df.columns
    out = df.withColumn("_lon", lon.cast("double")).withColumn("_a", F.radians(azimuth)).withColumn("_m", metres.cast("double"))
    out = out.withColumn("_t", (1 - FLATTENING) * F.tan(F.radians(lat))).withColumn("_cu", 1 / F.sqrt(1 + c("_t") * c("_t")))
    out = out.withColumn("_su", c("_t") * c("_cu")).withColumn("_first", 2 * F.atan2(c("_t"), F.cos("_a"))).withColumn("_sa", c("_cu") * F.sin("_a"))
    out = out.withColumn("_ca2", 1 - c("_sa") * c("_sa")).withColumn("_u", c("_ca2") * ratio)
    u = c("_u")
    out = out.withColumn("_b", u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))).withColumn("_flat", c("_m") / (polar * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))))))
    out = out.withColumn("_arc", c("_flat"))
    b = c("_b")
    for _ in range(rounds):
        out = out.withColumn("_mid", F.cos(c("_first") + c("_arc"))).withColumn("_s", F.sin("_arc"))
        mid, s = c("_mid"), c("_s")
        inner = F.cos("_arc") * (2 * mid * mid - 1) - b / 6 * mid * (4 * s * s - 3) * (4 * mid * mid - 3)
        out = out.withColumn("_arc", c("_flat") + b * s * (mid + b / 4 * inner))
    out = out.withColumn("_mid", F.cos(c("_first") + c("_arc"))).withColumn("_s", F.sin("_arc")).withColumn("_c", F.cos("_arc"))
    su, cu, s, co, mid = c("_su"), c("_cu"), c("_s"), c("_c"), c("_mid")
    north = su * co + cu * s * F.cos("_a")
    level = su * s - cu * co * F.cos("_a")
    out = out.withColumn("_to_lat", F.degrees(F.atan2(north, (1 - FLATTENING) * F.sqrt(c("_sa") * c("_sa") + level * level))))
    out = out.withColumn("_turn", F.atan2(s * F.sin("_a"), cu * co - su * s * F.cos("_a"))).withColumn("_k", FLATTENING / 16 * c("_ca2") * (4 + FLATTENING * (4 - 3 * c("_ca2"))))
    k = c("_k")
    east = c("_turn") - (1 - k) * FLATTENING * c("_sa") * (c("_arc") + k * s * (mid + k * co * (2 * mid * mid - 1)))
    to_lon = F.pmod(c("_lon") + F.degrees(east) + 180, F.lit(360.0)) - 180
    return out.select(*[n for n in start if n not in ("lon", "lat")], to_lon.alias("lon"), F.when(c("_lon").isNotNull(), c("_to_lat")).alias("lat"))


def event_rings(quakes: DataFrame, key: str, *, factor: float = 0.75, least_km: float = 15.0) -> DataFrame:
    """key, rupture_km, buffer_km and the vertices (ord, lon, lat) of each event's ring, clockwise and closed.

    ``quakes`` has lon, lat, magnitude and strike. The rupture, as long as its magnitude says, is centred on the epicentre and
    buffered by ``factor`` times its length, ``least_km`` at least, in the plane whose distances and directions from the
    epicentre are true: so every vertex is reached by one geodesic from there. A row a vertex, and no shuffle.
    """
    length = rupture_length_km(F.col("magnitude"))
    rows = quakes.select(key, "lon", "lat", "strike", length.alias("rupture_km"))
    rows = rows.withColumn("buffer_km", F.greatest(F.lit(least_km), F.col("rupture_km") * factor))
    half = 2 * QUARTER + 1
    rows = rows.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(2 * half)))).withColumn("_i", F.col("ord") % (2 * half))
    # The far end's half circle first, then the other's: each begins a quarter before its own direction.
    other = (F.col("_i") >= half).cast("int")
    step = F.col("_i") - other * half
    bearing = F.radians((step - QUARTER) * (90.0 / QUARTER) + other * 180)
    ahead = F.col("rupture_km") / 2 * (1 - 2 * other) + F.col("buffer_km") * F.cos(bearing)
    right = F.col("buffer_km") * F.sin(bearing)
    rows = rows.withColumn("_ahead", ahead).withColumn("_right", right)
    turn = F.degrees(F.atan2("_right", "_ahead"))
    placed = along(rows, F.col("lon"), F.col("lat"), F.col("strike") + turn, F.hypot("_ahead", "_right") * 1000)
    return placed.select(key, "rupture_km", "buffer_km", "ord", "lon", "lat")
