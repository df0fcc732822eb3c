"""Column functions: labels, projections, normalisation, decay, risk, parsing.  All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import percentiles

#: Metres per degree, as the cost-map operators use them.
LON_M, LAT_M = 111_320.0, 110_540.0


def clean(x: Column) -> Column:
    """NaN to null: Spark orders NaN above every number, the operators here must not."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def label_prefix(label: Column) -> Column:
    """Leading letters and underscores, upper-cased; the whole label if it has none."""
    t = F.trim(label)
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(t, "^([A-Za-z_]+)", 1), F.lit("")), t))


def endpoint_key(label: Column) -> Column:
    """Match key of a facility label: prefix (BD counts as DB) and number without leading zeros."""
    p = label_prefix(label)
    p = F.when(p == "BD", F.lit("DB")).otherwise(p)
    n = F.regexp_extract(label, r"(\d+)", 1)
    return F.concat(p, F.when(n != "", F.regexp_replace(n, r"^0+(?=\d)", "")).otherwise(F.lit("")))


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "y", "on")


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return (lon - lon0) * LON_M * F.cos(F.radians(lat0)), (lat - lat0) * LAT_M


def utm(lon: Column, lat: Column, zone: int = 48) -> tuple[Column, Column]:
    """Easting and northing on WGS-84, by the transverse Mercator series to sixth order (north of the equator)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, aa = F.pow(F.tan(phi), 2), ep * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
             + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = k0 * n * (aa + (1 - t + c) * F.pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * F.pow(aa, 5) / 120) + 500000.0
    north = k0 * (m + n * F.tan(phi) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * F.pow(aa, 6) / 720))
    return east, north


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile numbers; latitude clamped to the square map."""
    n = float(1 << zoom)
    y = F.radians(clip(lat, -85.05112878, 85.05112878))
    return F.floor((lon + 180) / 360 * n).cast("long"), F.floor((1 - F.asinh(F.tan(y)) / math.pi) / 2 * n).cast("long")


def min_max(x: Column, lo: Column, hi: Column, inverted: bool = False) -> Column:
    """0 to 1 between the bounds; constant or missing is 0 before an inversion."""
    v = F.coalesce(F.when(hi > lo, (x - lo) / (hi - lo)), F.lit(0.0))
    return 1 - v if inverted else v


def robust_norm(df: DataFrame, column: str, to: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds `to`: `column` scaled between two exact percentiles, clipped, missing or degenerate as 0."""
    p = percentiles(df, clean(F.col(column)), [low, high]).withColumnRenamed("q", "__p")
    lo, hi = F.col("__p")[0], F.col("__p")[1]
    scaled = F.coalesce(F.when(hi > lo, clip((clean(F.col(column)) - lo) / (hi - lo), 0.0, 1.0)), F.lit(0.0))
    return df.crossJoin(F.broadcast(p)).withColumn(to, scaled).drop("__p")  # one row


def ramp(x: Column, lo: float, hi: float) -> Column:
    return clip((x - lo) / (hi - lo), 0.0, 1.0)


def decay(d: Column, scale: float, kind: str = "exp") -> Column:
    return {"exp": lambda: F.exp(-d / scale), "gauss": lambda: F.exp(-0.5 * F.pow(d / scale, 2))}[kind]()


def buffered_decay(d: Column, buffer: float, scale: float) -> Column:
    return F.when(d <= buffer, 1.0).otherwise(F.exp(-F.pow((d - buffer) / scale, 2)))


def noisy_or(a: Column, b: Column) -> Column:
    return clip(a + (1 - a) * b, 0.0, 1.0)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of layers clipped to 0..1, NaN or null as 0; weights of zero or less don't count."""
    parts = [(c, w) for c, w in parts if w > 0]
    if not parts:
        return F.lit(0.0)
    safe = [F.coalesce(clip(clean(c), 0.0, 1.0), F.lit(0.0)) * w for c, w in parts]
    return sum(safe[1:], safe[0]) / sum(w for _, w in parts)


def no_fly(slowness: Column, threshold: float, mode: str = "ge", forced_flyable: Column | None = None) -> Column:
    """Missing slowness is no-fly; forced-flyable rows never are."""
    s = clean(slowness)
    test = {"ge": s >= threshold, "gt": s > threshold, "le": s <= threshold, "lt": s < threshold, "equal": s == threshold}[mode]
    out = F.coalesce(test, F.lit(True))
    return out if forced_flyable is None else out & ~F.coalesce(forced_flyable, F.lit(False))


def velocity(slowness: Column, blocked: Column) -> Column:
    return F.when(blocked | (slowness <= 0) | slowness.isNull(), 0.0).otherwise(1 / slowness)


def angle_change(a: Column, b: Column) -> Column:
    """Difference of two directions in degrees, wrapped to 0..180."""
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def wind_uv(speed: Column, degrees: Column) -> tuple[Column, Column]:
    """Arrow of a wind that blows from `degrees`."""
    return -speed * F.sin(F.radians(degrees)), -speed * F.cos(F.radians(degrees))


def parse_metres(text: Column, strict: bool = False) -> Column:
    """First of a `;` list, comma or point decimals, m or ft.  By default the first number found; `strict` drops units and words for
    about, and whatever is then no number is missing."""
    if not strict:
        first = F.lower(F.trim(F.split(text, ";")[0]))
        number = F.regexp_extract(F.regexp_replace(first, ",", "."), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")
        return F.when(first.rlike("ft|feet|'"), number * 0.3048).otherwise(number)
    whole = F.replace(F.lower(F.trim(text)), F.lit(","), F.lit("."))
    bare = F.trim(F.regexp_replace(whole, "approximately|approx|~|meters|metres|meter|metre|feet|ft|m", ""))
    number = F.trim(F.split(bare, ";")[0]).try_cast("double")
    return clean(F.when(whole.rlike("ft|feet"), number * 0.3048).otherwise(number))


def parse_kilovolts(text: Column, strip_v_first: bool = True) -> Column:
    """First of a `;` list, comma or point decimals; over 1000 means volts.  By default "v" goes before "kv" is looked for, so "110kv" is missing."""
    low = F.replace(F.lower(text), F.lit(","), F.lit("."))
    bare = F.regexp_replace(low, "v", "") if strip_v_first else F.regexp_replace(low, "kv|v", "")
    number = F.trim(F.split(bare, ";")[0]).try_cast("double")
    return F.when(number > 1000, number / 1000).otherwise(number)


def taxonomy_height(text: Column, default: float | None = None) -> Column:
    """HHT:x is metres, H:n storeys of 3 m, HBET:a-b the mean of storeys; the first kind present wins."""
    get = lambda rx, i=1: F.regexp_extract(text, rx, i).try_cast("double")
    n = r"(\d+(?:\.\d+)?)"
    return F.coalesce(get(rf"(?:^|\+)HHT:{n}"), get(rf"(?:^|\+)H:{n}") * 3, (get(rf"(?:^|\+)HBET:{n}-{n}") + get(rf"(?:^|\+)HBET:{n}-{n}", 2)) / 2 * 3, F.lit(default).cast("double"))


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def ordered_case(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """First rule (pattern, class) that matches wins."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(c)) for p, c in rules], F.lit(otherwise))


def prefix_risk(prefix: Column, risks: dict[str, float], base: float, layers: list[tuple[Column, float]], slowness: Column, threshold: float = 10.0) -> Column:
    """Risk 0..1: the prefix's (else `base`) plus weighted layers; 1 at least where slowness is missing or reaches the threshold."""
    known = F.create_map(*[F.lit(v) for kv in risks.items() for v in kv]) if risks else None
    risk = F.coalesce(F.try_element_at(known, F.upper(prefix)), F.lit(base)) if risks else F.lit(base)
    for layer, weight in layers:
        risk = risk + F.coalesce(layer, F.lit(0.0)) * weight
    blocked = F.coalesce(clean(slowness) >= threshold, F.lit(True))
    return clip(F.when(blocked, F.greatest(risk, F.lit(1.0))).otherwise(risk), 0.0, 1.0)


def multiplied_cost(slowness: Column, risk: Column, score: Column, travel: float = 1.0, risk_weight: float = 3.0, emergency_weight: float = 1.0, threshold: float = 10.0, floor: float = 1e-9, cap: float | None = None) -> Column:
    """slowness * travel * (1 + rw * risk) * (1 + ew * (1 - score)); not below the slowness itself where that reaches the threshold; between floor and cap."""
    s = F.coalesce(clean(slowness), F.lit(0.0))
    cost = s * travel * (1 + risk_weight * risk) * (1 + emergency_weight * (1 - score))
    cost = F.greatest(F.when(s >= threshold, F.greatest(cost, s)).otherwise(cost), F.lit(floor))
    return cost if cap is None else F.least(cost, F.lit(cap))


def attracted(slowness: Column, support: Column, weight: float, least: float, threshold: float) -> Column:
    """Flyable slowness times 1 - weight * support, the factor not below `least`; blocked slowness unchanged."""
    return F.when(slowness < threshold, slowness * F.greatest(1 - weight * support, F.lit(least))).otherwise(slowness)


def repelled(slowness: Column, nearness: Column, weight: float, most: float, threshold: float) -> Column:
    """Flyable slowness times 1 + weight * nearness, the factor not above `most`; blocked slowness unchanged."""
    return F.when(slowness < threshold, slowness * F.least(1 + weight * nearness, F.lit(most))).otherwise(slowness)


#: Weights of radio kinds; any other kind counts 0.5.
RADIO = {"NR": 1.00, "LTE": 0.90, "UMTS": 0.60, "GSM": 0.45, "NBIOT": 0.35, "CDMA": 0.40}


def radio_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in RADIO.items() for v in kv]), F.upper(kind)), F.lit(0.5))


def signal_weight(dbm: Column) -> Column:
    return F.coalesce(clip((dbm + 120) / 60, 0.05, 1.0), F.lit(0.5))


def sample_weight(n: Column, most: Column) -> Column:
    """log1p of a sample count over the greatest, 0.2 to 1."""
    return clip(F.when(most > 0, F.log1p(n) / F.log1p(most)).otherwise(0.0), 0.2, 1.0)


def weather_risk(df: DataFrame, to: str, wind_bad: float = 15.0, rain_bad: float = 10.0, visibility_good: float = 10_000.0, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """`df` with a 0..1 risk from those of wind_speed_mps, rain_mm_h and visibility_m that it has; a weather_risk column wins.

    A weather_risk whose values all lie in 0..1 is only clipped, another is normalised robustly; without any known column the risk is 0.
    """
    if "weather_risk" in df.columns:
        lo, hi = df.agg(F.min(clean(F.col("weather_risk"))), F.max(clean(F.col("weather_risk")))).first()
        if lo is None or (lo >= 0 and hi <= 1):
            return df.withColumn(to, F.coalesce(clip(clean(F.col("weather_risk")), 0.0, 1.0), F.lit(0.0)))
        return robust_norm(df, "weather_risk", to)
    layers = {"wind_speed_mps": lambda c: c / wind_bad, "rain_mm_h": lambda c: c / rain_bad, "visibility_m": lambda c: 1 - clip(c / visibility_good, 0.0, 1.0)}
    return df.withColumn(to, weighted_mean([(f(F.col(n)), w) for (n, f), w in zip(layers.items(), weights) if n in df.columns]))


def rounded(value: Column, digits: int) -> Column:
    """`value` to `digits` places as SQL engines round doubles: the whole number nearest to value * 10^digits, halves away from zero.

    Spark's own round takes the decimals that the double is printed with, which a product may put on the other side of a half.
    """
    return F.round(value * 10.0**digits) / 10.0**digits
