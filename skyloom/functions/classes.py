"""Column functions that classify objects and resolve their heights, risks and times."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import clean, parse_metres

#: Road classes by tag value, objective classes by name prefix (the last that fits wins), assumed heights in metres.
ROADS = {
    "expressway_or_trunk": ["motorway", "motorway_link", "trunk", "trunk_link"],
    "primary": ["primary", "primary_link"],
    "secondary": ["secondary", "secondary_link"],
    "tertiary": ["tertiary", "tertiary_link"],
    "residential": ["residential", "living_street"],
    "service_or_track": ["service", "track"],
    "unclassified": ["unclassified", "road"],
    "non_motorized": ["path", "footway", "cycleway", "pedestrian", "steps", "bridleway"],
}
OBJECTIVES = {"drone-base": "Drone-Base", "docking": "Docking", "flz": "FLZ", "restricted_airspace": "Restricted_airspace"}
HEIGHTS = {
    "power_line": 35.0, "power_minor_line": 15.0, "power_cable": 0.0, "power_tower": 35.0, "power_pole": 12.0, "power_substation": 8.0,
    "power_plant": 20.0, "power_generator": 12.0, "solar_generation": 3.0, "telecom_mast": 35.0, "telecom_tower": 45.0,
    "telecom_facility": 15.0, "pipeline": 0.0, "oil_gas_facility": 12.0, "water_tower": 25.0, "water_works": 10.0,
    "water_facility": 10.0, "unknown": 5.0,
}
#: Fixed values: (column, low, high) of the forecast ramps; a reading at `high` forbids flight.  Visibility falls from low to high.
FORECAST = [("wind_speed_120m", 5.0, 15.0), ("wind_gusts_10m", 8.0, 20.0), ("precipitation", 0.1, 5.0), ("cape", 500.0, 2500.0), ("visibility", 10000.0, 1000.0)]


def road_class(highway: Column) -> Column:
    """Class of a road tag; other values stay as they are in lower case, missing is unknown."""
    h = F.lower(highway)
    out = F.when(h.isNull(), "unknown")
    for name, values in ROADS.items():
        out = out.when(h.isin(values), name)
    return out.otherwise(h)


def objective_class(name: Column) -> Column:
    out = F.lit("Other")
    for prefix, kind in OBJECTIVES.items():
        out = F.when(F.lower(name).startswith(prefix), kind).otherwise(out)
    return out


def infra_class(layer: Column, power: Column, man_made: Column, telecom: Column, pipeline: Column, substance: Column, generator: Column) -> Column:
    """Infrastructure class from the layer's name and its tags."""
    p, m, t, l, s, g = (F.lower(F.coalesce(c, F.lit(""))) for c in (power, man_made, telecom, pipeline, substance, generator))
    named = lambda c: ~c.isin("", "none", "nan")
    pick = lambda c, kinds, other: _chosen(c, kinds).otherwise(other)
    return (F.when(layer == "power_lines", pick(p, {"minor_line": "power_minor_line", "cable": "power_cable"}, "power_line"))
            .when(layer == "power_supports", pick(p, {"pole": "power_pole"}, "power_tower"))
            .when(layer == "power_substations", "power_substation")
            .when(layer == "power_plants_generators", pick(p, {"plant": "power_plant"}, "power_generator"))
            .when((layer == "solar_generation") | (g == "solar"), "solar_generation")
            .when(layer == "telecom_masts_towers", F.when(m.contains("tower"), "telecom_tower").otherwise("telecom_mast"))
            .when((layer == "telecom_facilities") | named(t), "telecom_facility")
            .when((layer == "pipelines") | named(l), "pipeline")
            .when((layer == "oil_gas_facilities") | s.isin("gas", "oil", "petroleum", "natural_gas"), "oil_gas_facility")
            .when(layer == "water_infrastructure", pick(m, {"water_tower": "water_tower", "water_works": "water_works", "wastewater_plant": "water_works"}, "water_facility"))
            .otherwise("unknown"))


def _chosen(c: Column, kinds: dict[str, str]) -> Column:
    out = None
    for value, kind in kinds.items():
        out = F.when(c == value, kind) if out is None else out.when(c == value, kind)
    return out


def infra_height(layer: Column, kind: Column, tags: list[Column], power: Column, location: Column, level: Column) -> Column:
    """struct<height_m, z_min, z_max, source>: the first height tag that parses, if positive, else the class's assumed height.

    Lines start 8 m up (minor ones 6 m); cables, what lies under ground or water, and pipelines take no air.
    """
    said = F.coalesce(*[parse_metres(t, strict=True) for t in tags])
    table = F.create_map(*[F.lit(x) for kv in HEIGHTS.items() for x in kv])
    tagged = F.coalesce(said > 0, F.lit(False))
    height = F.when(tagged, said).otherwise(F.coalesce(F.element_at(table, kind), F.lit(HEIGHTS["unknown"])))
    p, under = F.lower(F.coalesce(power, F.lit(""))), F.lower(F.coalesce(location, F.lit(""))).isin("underground", "underwater") | F.coalesce(level, F.lit("")).startswith("-")
    line, sunk = layer == "power_lines", (p == "cable") | under
    up = lambda least: F.when(height > 0, height).otherwise(least)
    low = F.when(line & sunk, 0.0).when(line & (p == "minor_line"), 6.0).when(line, 8.0).otherwise(0.0)
    high = F.when(line & sunk, 0.0).when(line & (p == "minor_line"), up(HEIGHTS["power_minor_line"])).when(line, up(HEIGHTS["power_line"])).when(layer == "pipelines", 0.0).otherwise(height)
    assumed = F.concat(F.lit("assumed_"), kind)
    source = F.when(layer == "pipelines", "usually_underground_not_air_obstacle").when(tagged, "osm_height").when(line & sunk, "assumed_underground_or_cable_not_air_obstacle").otherwise(assumed)
    return F.struct(height.alias("height_m"), low.alias("z_min"), high.alias("z_max"), source.alias("source"))


def wind_arrow(degrees: Column, length: Column, mode: str = "bearing_from_north") -> tuple[Column, Column]:
    """Arrow of a direction clockwise from north, or of the flow, which points the other way."""
    sign = {"bearing_from_north": 1, "wind_flow_to": -1}[mode]
    return sign * length * F.sin(F.radians(degrees)), sign * length * F.cos(F.radians(degrees))


def direction_bucket(angle: Column, buckets: int = 32) -> Column:
    """Bucket of a direction in radians from -pi, rounded half to even."""
    return F.pmod(F.bround((angle + math.pi) / (2 * math.pi) * buckets).cast("int"), F.lit(buckets))


def unit_hash(node: Column, seed: Column) -> Column:
    """A number in [0, 1] fixed by two integers, by multiplications whose low 32 bits count."""
    @F.pandas_udf("double")
    def of(nodes: pd.Series, seeds: pd.Series) -> pd.Series:
        def one(n: int, s: int) -> float:
            x = (n + 0x9E3779B9) ^ (s * 0x85EBCA6B)  # fixed values
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                x = (x ^ (x >> shift)) * factor
            return ((x ^ (x >> 16)) & 0xFFFFFFFF) / 0xFFFFFFFF
        return pd.Series([None if pd.isna(n) or pd.isna(s) else one(int(n), int(s)) for n, s in zip(nodes, seeds)], dtype="float64")

    return of(node, seed)


def spherical_points(moves: Column, x0: Column, y0: Column, z0: Column, low: tuple, high: tuple) -> Column:
    """Points after each of array<struct<r, psi, phi>>, every step kept inside the bounds: array<struct<x, y, z>>."""
    keep = lambda v, i: F.least(F.lit(float(high[i])), F.greatest(F.lit(float(low[i])), v))
    point = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    start = F.array(point(*(c.cast("double") for c in (x0, y0, z0))))

    def step(a: Column, m: Column) -> Column:
        p = F.element_at(a, -1)
        flat = m["r"] * F.cos(m["psi"])
        return F.concat(a, F.array(point(keep(p["x"] + flat * F.cos(m["phi"]), 0), keep(p["y"] + flat * F.sin(m["phi"]), 1), keep(p["z"] + m["r"] * F.sin(m["psi"]), 2))))

    return F.aggregate(moves, start, step, lambda a: F.slice(a, 2, F.size(a)))


def forecast_index(readings: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """(risk, no_fly): the worst of five ramps (missing readings don't count; null if all are) and whether any limit is met."""
    risks, limits = [], []
    for name, low, high in FORECAST:
        v = clean(F.col(name) if readings is None else readings[name])
        risks.append(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low))))
        risks[-1] = F.when(v.isNotNull(), risks[-1])
        limits.append(F.coalesce(v >= high if high > low else v <= high, F.lit(False)))
    no_fly = limits[0]
    for limit in limits[1:]:
        no_fly = no_fly | limit
    return F.greatest(*risks), no_fly


def valid_place(lon: Column, lat: Column, code: Column | None = None, wanted: int | None = None) -> Column:
    """Coordinates in range and not zero; a country code, if asked for, equal or missing."""
    ok = F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & (lon != 0) & (lat != 0), F.lit(False))
    return ok if code is None or wanted is None else ok & F.coalesce(code == wanted, F.lit(True))


def feature_group(preferred: list[Column], tags: dict[str, Column], known: list[str]) -> Column:
    """The first preferred column that names a known group, else the name of the first tag that is set, else other."""
    blank = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    named = [F.when(blank(c).isin(known), blank(c)) for c in preferred]
    tagged = [F.when(~F.coalesce(blank(c).isin("none", "nan"), F.lit(True)), name) for name, c in tags.items()]
    return F.coalesce(*named, *tagged, F.lit("other"))


def schedule(departure: Column, arrival: Column, duration: Column, delay: Column, offset: Column) -> Column:
    """struct<departure, arrival, delay>: a missing delay is 0, a missing departure the offset plus the delay, a missing arrival the
    departure plus the duration."""
    late = F.coalesce(delay, F.lit(0.0))
    leaves = F.coalesce(departure, F.coalesce(offset, F.lit(0.0)) + late)
    return F.struct(leaves.alias("departure"), F.coalesce(arrival, leaves + F.coalesce(duration, F.lit(0.0))).alias("arrival"), late.alias("delay"))
