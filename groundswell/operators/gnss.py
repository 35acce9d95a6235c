"""Reference motion from GNSS nodes: rates or epochs along the line of sight, nodes inside deforming areas, provenance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.functions import scalars as S
from groundswell.operators.joins import inside_polygons

VALUES = ("ve", "vn", "vu")
SIGMAS = ("sigma_ve", "sigma_vn", "sigma_vu")
#: Nodes outside of excluded areas that the field has to be carried by at least.
LEAST_NODES = 4


def node_rates(nodes: DataFrame, rates: DataFrame) -> DataFrame:
    """Nodes (id, ...) that have rates, with them."""
    return nodes.join(rates, "id")


def missing_nodes(nodes: DataFrame, rates: DataFrame) -> DataFrame:
    """How many nodes were asked for, and how many have no rates."""
    met = nodes.join(rates.select("id", F.lit(True).alias("_there")), "id", "left")
    return met.agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("_there").isNull()).alias("missing"))


def pair_motion(rates: DataFrame, years: Column) -> DataFrame:
    """Rates (mm/yr) over the years from reference to secondary: motion has their sign, sigmas don't."""
    return rates.withColumns({v: F.col(v) * years for v in VALUES} | {s: F.col(s) * F.abs(years) for s in SIGMAS})


def along_look(nodes: DataFrame) -> DataFrame:
    """Adds ``los`` and ``los_sigma`` from motion, its sigmas and the look (le, ln, lu); NULL where there is no look."""
    motion, sigmas, look = ([F.col(c) for c in names] for names in (VALUES, SIGMAS, ("le", "ln", "lu")))
    return nodes.withColumn("los", S.los_projection(*motion, *look)).withColumn("los_sigma", S.los_sigma(*sigmas, *look))


def reference_motion(constant: DataFrame, variable: DataFrame, grid_type: str, years: Column, *, reprocessing: bool = False) -> DataFrame:
    """Node motion of a pair along its looks: rates over the pair's years for a constant grid, differences of epochs (already
    of the pair) for a variable one, which carries other signals too and needs ``reprocessing``."""
    if grid_type == "constant":
        return along_look(pair_motion(constant, years))
    if grid_type != "variable":
        raise ValueError(f"unknown grid type {grid_type}")
    if not reprocessing:
        raise ValueError("a variable grid carries more than steady motion: it needs reprocessing")
    return along_look(variable)


def without_areas(nodes: DataFrame, areas: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Nodes outside of all areas; an error where fewer than LEAST_NODES are left."""
    left = inside_polygons(nodes, areas, x, y).where("NOT inside").drop("inside")
    if left.limit(LEAST_NODES).count() < LEAST_NODES:
        raise ValueError(f"fewer than {LEAST_NODES} nodes lie outside the excluded areas")
    return left


def digest(config: Column, field: Column) -> Column:
    """One hash of a realisation: of its configuration's hash followed by its field's."""
    return F.sha2(F.concat(F.sha2(config, 256), F.sha2(field, 256)), 256)


def field_text(values: Mapping[str, Column], digits: int = 9) -> Column:
    """A field's values as one text, in order of their names."""
    return F.concat_ws("|", *[F.format_string(f"%s=%.{digits}f", F.lit(k), v) for k, v in sorted(values.items())])
