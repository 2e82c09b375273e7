"""The closed catalogue of calculations [2-J, H21, J8-J10]. Each returns struct<ok, refused, value, unit, reason>: inputs
that make a result meaningless are refused with a reason, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.rules import bound

#: Factors to the base unit of each dimension.
FACTORS = {
    "mm": ("length", 1e-3), "cm": ("length", 1e-2), "m": ("length", 1.0), "in": ("length", 0.0254), "inch": ("length", 0.0254), "ft": ("length", 0.3048),
    "Pa": ("pressure", 1.0), "kPa": ("pressure", 1e3), "MPa": ("pressure", 1e6), "bar": ("pressure", 1e5), "psi": ("pressure", 6894.757293168),
    "s": ("time", 1.0), "min": ("time", 60.0), "hour": ("time", 3600.0), "day": ("time", 86400.0), "month": ("time", 2629800.0), "year": ("time", 31557600.0),
    "K": ("temperature difference", 1.0), "kelvin": ("temperature difference", 1.0), "delta_degC": ("temperature difference", 1.0),
    "kg/s": ("mass flow", 1.0), "kg/h": ("mass flow", 1 / 3600), "t/h": ("mass flow", 1000 / 3600),
    "mm/year": ("rate", 1.0), "in/year": ("rate", 25.4), "m/year": ("rate", 1000.0),
}
ALIASES = {"initial": "initial_thickness", "current": "current_thickness", "years": "interval", "minimum": "minimum_thickness", "rate": "corrosion_rate", "pressure": "design_pressure", "radius": "inside_radius", "stress": "allowable_stress"}


def convert(value: Column, unit: Column, to: str) -> Column:
    """To another unit of the same dimension; null for an unknown unit or another dimension."""
    kind, factor = FACTORS[to]
    of = F.create_map(*[x for k, (d, f) in FACTORS.items() if d == kind for x in (F.lit(k), F.lit(f))])
    return value * F.element_at(of, unit) / F.lit(factor)


def tidy_quantity(text: Column) -> Column:
    """Unit strings as people write them: plural marks dropped, "per" as a slash, "3.30 mm/6 year" as a rate [H21]."""
    form = r"^\s*(-?\d+(?:\.\d+)?)\s*([A-Za-z°µ]+)\s*/\s*(\d+(?:\.\d+)?)\s*([A-Za-z°µ]+)\s*$"

    def tidied(clean: Column) -> Column:
        value, divisor = (F.regexp_extract(clean, form, k).try_cast("double") for k in (1, 3))
        rate = F.concat(F.regexp_replace(F.regexp_replace(F.bround(value / F.nullif(divisor, F.lit(0.0)), 10).cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(" "), F.regexp_extract(clean, form, 2), F.lit("/"), F.regexp_extract(clean, form, 4))
        return F.when(clean.rlike(form) & (divisor > 0), rate).otherwise(clean)

    return bound(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?i)\(\s*s\s*\)", "")), r"(?i)\s+per\s+", "/"), tidied)


def quantity(text: Column) -> Column:
    """struct<value, unit> of "12.5 mm" [1.2]."""
    form = r"^\s*(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)\s*(\S.*)?$"
    return bound(tidy_quantity(text), lambda t: F.struct(F.regexp_extract(t, form, 1).try_cast("double").alias("value"), F.trim(F.regexp_extract(t, form, 2)).alias("unit")))


def canonical_inputs(raw: Column, known: tuple[str, ...]) -> Column:
    """Input names by their aliases, unknown ones dropped, the first of a name kept [J9]. raw: map<string,string>."""
    names = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.lit(v))])
    pairs = F.transform(F.map_entries(raw), lambda e: F.struct(F.when(e["key"].isin(*known), e["key"]).otherwise(F.element_at(names, F.lower(F.trim(e["key"])))).alias("key"), tidy_quantity(e["value"]).alias("value")))

    def kept(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["key"])
        return F.map_from_entries(F.filter(pairs, lambda p, i: p["key"].isin(*known) & (F.array_position(keys, p["key"]) == i + 1)))

    return bound(pairs, kept)


def _result(value: Column, unit: str, refusal: Column) -> Column:
    absent = value.isNull() & refusal.isNull()
    return F.struct(
        (refusal.isNull() & ~absent).alias("ok"),
        refusal.isNotNull().alias("refused"),
        F.when(refusal.isNull(), value).alias("value"),
        F.lit(unit).alias("unit"),
        F.coalesce(refusal, F.when(absent, "an input is missing or has no usable unit")).alias("reason"),
    )


def corrosion_rate(initial_mm: Column, current_mm: Column, years: Column, initial_year: Column | None = None, current_year: Column | None = None) -> Column:
    """mm/year. Dates, where given, set the interval, and refuse one that is half a year or more off [J1, I9]."""
    none = F.lit(None).cast("double")
    span = (current_year if current_year is not None else none) - (initial_year if initial_year is not None else none)
    refusal = F.when(span <= 0, "the later reading is dated before the earlier one").when(F.abs(span - years) > 0.5, "the interval disagrees with the years given")
    interval = F.coalesce(span, years)
    return _result((initial_mm - current_mm) / F.nullif(interval, F.lit(0.0)), "mm/year", refusal)


def remaining_life(current_mm: Column, minimum_mm: Column, rate: Column) -> Column:
    """Years; without measurable corrosion no limit [J2]."""
    return _result(F.when(rate <= 0, F.lit(float("inf"))).otherwise((current_mm - minimum_mm) / F.nullif(rate, F.lit(0.0))), "year", F.lit(None).cast("string"))


def minimum_thickness(pressure_mpa: Column, radius_mm: Column, stress_mpa: Column, efficiency: Column | float = 1.0) -> Column:
    """t = P R / (S E - 0.6 P), mm [J3]."""
    e = efficiency if isinstance(efficiency, Column) else F.lit(efficiency)
    d = stress_mpa * e - 0.6 * pressure_mpa
    return _result(pressure_mpa * radius_mm / F.nullif(d, F.lit(0.0)), "mm", F.when(d <= 0, "the pressure is too high for the formula to apply"))


def working_pressure(thickness_mm: Column, radius_mm: Column, stress_mpa: Column, efficiency: Column | float = 1.0) -> Column:
    """P = S E t / (R + 0.6 t), MPa [J4]."""
    e = efficiency if isinstance(efficiency, Column) else F.lit(efficiency)
    return _result(stress_mpa * e * thickness_mm / (radius_mm + 0.6 * thickness_mm), "MPa", F.lit(None).cast("string"))


def log_mean_difference(a: Column, b: Column) -> Column:
    """K; the two ends' differences, near equal ones as such [J5]."""
    return _result(F.when(F.abs(a - b) < 1e-6, a).otherwise((a - b) / F.ln(F.try_divide(a, b))), "K", F.when((a <= 0) | (b <= 0), "both differences must be positive"))


def heat_duty(flow_kg_s: Column, heat_kj_kg_k: Column, difference_k: Column) -> Column:
    """kW [J6]."""
    return _result(flow_kg_s * heat_kj_kg_k * difference_k, "kW", F.lit(None).cast("string"))


def orifice_flow(beta: Column, diameter_m: Column, pressure_pa: Column, density: Column, discharge: Column | float = 0.61) -> Column:
    """m^3/s, incompressible [J7]."""
    c = discharge if isinstance(discharge, Column) else F.lit(discharge)
    b = F.when((beta > 0) & (beta < 1), beta)
    flow = c / F.sqrt(1 - F.pow(b, F.lit(4))) * F.pi() * diameter_m * diameter_m / 4 * F.sqrt(2 * pressure_pa / density)
    return _result(flow, "m^3/s", F.when((beta <= 0) | (beta >= 1), "the diameter ratio must lie between 0 and 1"))


def readings_beside(lines: Column, year: Column, location: Column | None = None) -> Column:
    """Thicknesses of 0.1 to 500 mm in the lines that name the year (and the location) [C15]."""
    near = F.filter(lines, lambda s: s.contains(year) & (F.lower(s).contains(F.lower(location)) if location is not None else F.lit(True)))
    tokens = F.flatten(F.transform(near, lambda s: F.regexp_extract_all(s, F.lit(r"(?<![A-Za-z0-9_.\-/])\d+(?:\.\d+)?"), F.lit(0))))
    return F.array_distinct(F.filter(tokens, lambda t: (t != year) & t.cast("double").between(0.1, 500.0)))


def contradicted(readings: Column, thickness_mm: Column) -> Column:
    """Whether the sources record readings and none is the claimed one [J10]."""
    return (F.size(readings) > 0) & ~F.exists(readings, lambda r: F.abs(r.cast("double") - F.bround(thickness_mm, 4)) < 0.005)


#: Each calculation's inputs with the unit that it takes them in (none: as they are), in the order of its arguments.
CATALOGUE = {
    "corrosion_rate": (corrosion_rate, (("initial_thickness", "mm"), ("current_thickness", "mm"), ("interval", "year"))),
    "remaining_life": (remaining_life, (("current_thickness", "mm"), ("minimum_thickness", "mm"), ("corrosion_rate", "mm/year"))),
    "minimum_thickness": (minimum_thickness, (("design_pressure", "MPa"), ("inside_radius", "mm"), ("allowable_stress", "MPa"))),
    "heat_duty": (heat_duty, (("mass_flow", "kg/s"), ("specific_heat", None), ("difference", "K"))),
}


def dispatch(name: Column, raw: Column) -> Column:
    """The calculation of that name over inputs as people write them (map of strings): aliases, then what is missing, then
    units, then the result or its refusal; an unknown name fails [J8]."""
    out = _result(F.lit(None).cast("double"), "", F.lit(None).cast("string"))
    for key, (function, inputs) in CATALOGUE.items():

        def value(given: Column, k: str, unit: str | None) -> Column:
            return bound(quantity(F.try_element_at(given, F.lit(k))), lambda q: q["value"] if unit is None else convert(q["value"], q["unit"], unit))

        # each step bound: written into the next one they would be evaluated thousands of times a row
        read = bound(canonical_inputs(raw, tuple(k for k, _ in inputs)), lambda given: F.struct(*(value(given, k, unit).alias(k) for k, unit in inputs)))  # noqa: B023
        out = F.when(name == key, bound(read, lambda v: function(*(v[k] for k, _ in inputs)))).otherwise(out)  # noqa: B023
    return out
