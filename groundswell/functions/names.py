"""Names of products, static layers and their times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundswell.functions.scalars import PRODUCT, col, decimal_year

#: Formats of static layers' names and of a product family that is known but not read, and wavelengths (m).
STATIC = r"^OPERA_L3_DISP-S1-STATIC_F(\d+)_(\d{8})_(S1[ABCD])_v([\d.]+)_(\w+)\.tif$"
UNREAD = r"^OPERA_L3_DISP-NISAR_.*\.(nc|h5)$"
WAVELENGTH_M = {"S1": 0.05546576, "NISAR": 0.2413}
_TOKEN = r"(\d{8}T\d{6}Z)"


def sensor(name: Column | str) -> Column:
    """S1 or NISAR by the format of a product's name; NULL for other names."""
    name = col(name)
    return F.when(name.rlike(PRODUCT), "S1").when(name.rlike(UNREAD), "NISAR")


def read_by(name: Column | str) -> Column:
    """The sensor of a name; an error for names of no product and for sensors that aren't read."""
    found = sensor(name)
    return F.when(found == "S1", found).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.coalesce(col(name), F.lit("NULL")))).cast("string"))


def cycle_m(sensor_name: Column) -> Column:
    """Half the wavelength of a sensor, found by its name in either case; NULL for unknown ones."""
    out = F.lit(None).cast("double")
    for name, wavelength in WAVELENGTH_M.items():
        out = F.when(F.upper(sensor_name) == name, wavelength / 2).otherwise(out)
    return out


def static_fields(name: Column | str) -> dict[str, Column]:
    """frame_id, day, platform, version, layer of a static layer's name; NULL if it isn't one."""
    name = col(name)
    part = lambda i: F.when(name.rlike(STATIC), F.regexp_extract(name, STATIC, i))
    return {"static_frame": part(1).cast("int"), "static_day": part(2), "platform": part(3), "static_version": part(4), "layer": part(5)}


def sensing_times(name: Column | str) -> Column:
    """The first two time stamps of a name, each once, in order."""
    found = F.regexp_extract_all(col(name), F.lit(_TOKEN), F.lit(1))
    return F.sort_array(F.array_distinct(F.slice(found, 1, 2)))


def file_years(name: Column | str) -> tuple[Column, Column]:
    """(reference, secondary) decimal years of the first two time stamps; a single one is the secondary."""
    found = F.regexp_extract_all(col(name), F.lit(_TOKEN), F.lit(1))
    year = lambda i: decimal_year(F.try_to_timestamp(F.get(found, F.lit(i)), F.lit("yyyyMMdd'T'HHmmss'Z'")))
    return F.when(F.size(found) >= 2, year(0)), F.when(F.size(found) >= 2, year(1)).when(F.size(found) == 1, year(0))
