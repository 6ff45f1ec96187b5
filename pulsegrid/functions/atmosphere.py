"""Group refractivity of moist air (Ciddor 1996) and its integral along a path, as column expressions.

Nulls give nulls. A profile is a row with arrays of one value a pressure level; levels with a missing value, or below the
surface, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published formula: dispersion of dry air and water vapour (wave number in inverse micrometres), enhancement and
# compressibility of moist air, gas constant, molar masses, standard conditions.
K0, K1, K2, K3 = 238.0185, 5_792_105.0, 57.362, 167_917.0
W0, W1, W2, W3 = 295.235, 2.6422, -0.032380, 0.004028
ALPHA, BETA, GAMMA = 1.00062, 3.14e-8, 5.6e-7
A0, A1, A2, B0, B1, C0, C1, D, E = 1.58123e-6, -2.9331e-8, 1.1043e-10, 5.707e-6, -2.051e-8, 1.9898e-4, -2.376e-6, 1.83e-11, -0.765e-8
GAS, WATER = 8.314510, 0.018015
GRAVITY = 9.80665


def _dry_mass(co2: float) -> float:
    return (28.9635 + 12.011e-6 * (co2 - 400.0)) * 1e-3


def _compressibility(p, t, x):
    """Of moist air at pressure p (Pa), temperature t (Celsius) and molar fraction x of vapour."""
    ratio = p / (t + 273.15)
    return 1.0 - ratio * (A0 + A1 * t + A2 * t * t + (B0 + B1 * t) * x + (C0 + C1 * t) * x * x) + ratio * ratio * (D + E * x * x)


def group_refractivity(micrometres: float, celsius: Column, pascal: Column, vapour: Column, co2: float = 420.0) -> Column:
    """n - 1 for the group velocity, at a pressure and a partial pressure of vapour in pascal."""
    s = 1.0 / micrometres**2
    dry = (K1 * (K0 + s) / (K0 - s) ** 2 + K3 * (K2 + s) / (K2 - s) ** 2) * (1.0 + 0.534e-6 * (co2 - 450.0))
    wet = 1.022 * (W0 + 3 * W1 * s + 5 * W2 * s**2 + 7 * W3 * s**3)
    mass = _dry_mass(co2)
    standard_dry = 101325.0 * mass / (_compressibility(101325.0, 15.0, 0.0) * GAS * 288.15)
    standard_wet = 1333.0 * WATER / (_compressibility(1333.0, 20.0, 1.0) * GAS * 293.15)
    x = (ALPHA + BETA * pascal + GAMMA * celsius * celsius) * vapour / pascal
    density = pascal / (_compressibility(pascal, celsius, x) * GAS * (celsius + 273.15))
    return (density * mass * (1.0 - x) / standard_dry * dry + density * WATER * x / standard_wet * wet) * 1e-8


def vapour_pressure(humidity: Column, pascal: Column, celsius: Column, co2: float = 420.0) -> Column:
    """Partial pressure of vapour in pascal, of the specific humidity."""
    moles = humidity / WATER
    x = moles / (moles + (1.0 - humidity) / _dry_mass(co2))
    return x * pascal / (ALPHA + BETA * pascal + GAMMA * celsius * celsius)


def _between(levels: str, height: str, field: str) -> Column:
    """Field of the levels (ascending in z) at a height, linear between them, as at the nearer end outside."""
    below = f"size(filter({levels}, l -> l.z <= {height}))"
    a, b = f"{levels}[greatest({below}, 1) - 1]", f"{levels}[least({below}, size({levels}) - 1)]"
    return F.expr(f"CASE WHEN {b}.z > {a}.z THEN {a}.{field} + ({b}.{field} - {a}.{field}) * ({height} - {a}.z) / ({b}.z - {a}.z) ELSE {a}.{field} END")


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns behind a generator, so that later steps do not copy their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def excess_path(df: DataFrame, micrometres: float = 1.04, co2: float = 420.0, level: str = "level_hpa", temperature: str = "temperature_k", humidity: str = "humidity", geopotential: str = "geopotential", surface: str = "surface_pa", ground: str = "ground_m", instrument: str = "instrument_m", elevation: str = "elevation_rad", reach: float = 1500.0) -> DataFrame:
    """df with the one-way excess path between ground and instrument by trapezoids over the levels between: zenith_path, slant_path (over the
    sine of the beam's elevation), surface_refractivity, instrument_refractivity and path_status.

    Temperature, humidity (kept within 0 and 0.05) and the logarithm of pressure are linear in height; the pressure at the ground is that
    of the surface. Status is few_levels (less than three), bad_endpoints (ground not below the instrument), not_bracketed (an
    end further than ``reach`` from the levels) or integrated; only the last has values."""
    names = df.columns
    zipped = f"arrays_zip({level}, {temperature}, {humidity}, {geopotential})"
    fine = lambda c: f"(r.{c} IS NOT NULL AND NOT isnan(r.{c}) AND abs(r.{c}) < double('infinity'))"
    kept = f"filter({zipped}, r -> r.{level} > 0 AND r.{level} * 100 < {surface} AND {fine(temperature)} AND {fine(humidity)} AND {fine(geopotential)})"
    levels = f"array_sort(transform({kept}, r -> named_struct('z', r.{geopotential} / {GRAVITY}D, 'lnp', ln(r.{level} * 100D), 't', r.{temperature}, 'q', r.{humidity})))"
    own = _step(df, _l=F.expr(levels))
    status = F.when(F.coalesce(F.size("_l"), F.lit(0)) < 3, "few_levels").when(~F.coalesce(F.col(ground) < F.col(instrument), F.lit(False)), "bad_endpoints")
    own = _step(own, path_status=status.when(F.expr(f"{ground} < _l[0].z - {reach}D OR {instrument} > element_at(_l, -1).z + {reach}D"), "not_bracketed").otherwise("integrated"))
    own = own.withColumn("_l", F.when(F.col("path_status") == "integrated", F.col("_l")))
    end = lambda h, p: F.struct(F.col(h).cast("double").alias("z"), p.alias("p"), _between("_l", h, "t").alias("t"), _between("_l", h, "q").alias("q"))
    own = _step(own, _first=end(ground, F.col(surface).cast("double")), _last=end(instrument, F.exp(_between("_l", instrument, "lnp"))))
    inside = F.expr(f"transform(filter(_l, l -> l.z > {ground} AND l.z < {instrument}), l -> named_struct('z', l.z, 'p', exp(l.lnp), 't', l.t, 'q', l.q))")
    own = _step(own, _path=F.concat(F.array("_first"), inside, F.array("_last")))

    def at(node: Column) -> Column:
        celsius, wet = node["t"] - 273.15, F.greatest(F.least(node["q"], F.lit(0.05)), F.lit(0.0))
        return F.struct(node["z"].alias("z"), group_refractivity(micrometres, celsius, node["p"], vapour_pressure(wet, node["p"], celsius, co2), co2).alias("n"))

    own = _step(own, _n=F.transform("_path", at))
    zenith = F.expr("aggregate(sequence(1, size(_n) - 1), 0D, (s, i) -> s + (_n[i].z - _n[i - 1].z) * (_n[i].n + _n[i - 1].n) / 2)")
    known = F.col("path_status") == "integrated"
    own = _step(own, zenith_path=F.when(known, zenith), surface_refractivity=F.when(known, F.expr("_n[0].n")), instrument_refractivity=F.when(known, F.expr("element_at(_n, -1).n")))
    return own.withColumn("slant_path", F.col("zenith_path") / F.sin(elevation)).select(*[f"`{n}`" for n in names], "zenith_path", "slant_path", "surface_refractivity", "instrument_refractivity", "path_status")
