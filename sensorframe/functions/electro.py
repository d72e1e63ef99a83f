"""Scalar electrochemistry, unit and statistics functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants in SI units.
GAS = 8.314462618
FARADAY = 96485.33212

# Unit -> (dimension, factor to the base unit, offset).
UNITS = {
    "g/L": ("mass concentration", 1.0, 0.0), "mg/L": ("mass concentration", 1e-3, 0.0), "mL/min": ("flow", 1.0, 0.0), "L/min": ("flow", 1e3, 0.0), "uL/min": ("flow", 1e-3, 0.0),
    "mol/L": ("concentration", 1.0, 0.0), "mmol/L": ("concentration", 1e-3, 0.0), "umol/L": ("concentration", 1e-6, 0.0),
    "V": ("potential", 1.0, 0.0), "mV": ("potential", 1e-3, 0.0), "uV": ("potential", 1e-6, 0.0),
    "K": ("temperature", 1.0, 0.0), "C": ("temperature", 1.0, 273.15),
    "S/m": ("conductivity", 1.0, 0.0), "mS/cm": ("conductivity", 0.1, 0.0), "uS/cm": ("conductivity", 1e-4, 0.0),
    "ms": ("time", 1e-3, 0.0), "s": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0), "d": ("time", 86400.0, 0.0),
}


def to_base(value: Column, unit: Column) -> Column:
    """The value in its dimension's base unit; null for an unknown unit, or a temperature not above 0 K."""
    out = F.lit(None).cast("double")
    for name, (dimension, scale, offset) in UNITS.items():
        v = value * scale + offset
        out = F.when(unit == name, F.when(v > 0, v) if dimension == "temperature" else v).otherwise(out)
    return out


def nernst_slope(temperature_k: Column, charge: Column) -> Column:
    """ln(10) R T / (z F); null without a positive temperature and a charge."""
    return F.when((temperature_k > 0) & (charge != 0), 2.302585092994046 * GAS * temperature_k / (charge * FARADAY))


def potential(e0: Column, slope: Column, activity: Column) -> Column:
    return F.when(activity > 0, e0 + slope * F.log10(activity))


def activity(e0: Column, slope: Column, measured: Column) -> Column:
    return F.when(slope != 0, F.pow(F.lit(10.0), (measured - e0) / slope))


def effective_activity(own: Column, charge: Column, others: Column) -> Column:
    """a + sum K_j a_j^(z / z_j) over an array of structs (k, a, z)."""
    return F.aggregate(others, own, lambda s, o: s + o["k"] * F.pow(o["a"], charge / o["z"]))


def davies(charge: Column, ionic: Column, a: float = 0.509) -> Column:
    """Activity coefficient by the Davies equation."""
    root = F.sqrt(ionic)
    return F.pow(F.lit(10.0), -a * charge * charge * (root / (1 + root) - 0.3 * ionic))


def debye_huckel(charge: Column, ionic: Column, size_nm: Column, a: float = 0.509, b: float = 3.29) -> Column:
    """Activity coefficient by the extended Debye-Hueckel equation, ion size in nm."""
    root = F.sqrt(ionic)
    return F.pow(F.lit(10.0), -a * charge * charge * root / (1 + b * size_nm * root))


def stepped_z(confidence: Column) -> Column:
    return F.when(confidence >= 0.99, 2.576).when(confidence >= 0.95, 1.96).otherwise(1.645)


def logistic(x: Column, low: float, high: float) -> Column:
    return low + (high - low) / (1 + F.exp(-x))


def logit(v: Column, low: float, high: float) -> Column:
    """Inverse of :func:`logistic`; null outside the open interval."""
    return F.when((v > low) & (v < high), F.log((v - low) / (high - v)))


def unit_problem(value: Column, unit: Column, dimension: str) -> Column:
    """Why a value cannot be taken in a dimension's base unit: unknown_unit, other_dimension, not_finite, not_above_zero (temperatures), or null."""
    own = F.create_map(*(F.lit(x) for name, (d, _, _) in UNITS.items() for x in (name, d)))
    found = F.element_at(own, unit)
    bad = F.when(found.isNull(), "unknown_unit").when(found != dimension, "other_dimension").when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not_finite")
    return bad.when(to_base(value, unit) <= 0, "not_above_zero").when(to_base(value, unit).isNull(), "not_above_zero") if dimension == "temperature" else bad


def molar(value: Column, unit: Column, molar_mass: Column) -> Column:
    """A concentration in mol/L; one in g/L needs the molar mass in g/mol."""
    own = F.create_map(*(F.lit(x) for name, (d, _, _) in UNITS.items() for x in (name, d)))
    base = to_base(value, unit)
    return F.when(F.element_at(own, unit) == "concentration", base).when((F.element_at(own, unit) == "mass concentration") & (molar_mass > 0), base / molar_mass)


def effective_temperature(mode: str, own_k: Column, default_k: float, reference_k: float) -> Column:
    """The temperature in kelvin that a fit uses: constant (the default), reference (the reference) or observation (a row's own, the default
    where it has none). Null where it is not positive and finite."""
    t = {"constant": F.lit(default_k), "reference": F.lit(reference_k), "observation": F.coalesce(own_k, F.lit(default_k))}[mode]
    return F.when((t > 0) & (t < float("inf")) & F.lit(reference_k > 0), t)


def response_slope(slope: Column, sign: str = "auto") -> Column:
    """A theoretical slope with the sign that a sensor's convention gives it: auto keeps the charge's, positive and negative force one."""
    s = {"auto": slope, "positive": F.abs(slope), "negative": -F.abs(slope)}[sign]
    return F.when(slope != 0, s)


def evaluate_activity(
    model: Column, concentration: Column, charge: Column, *, explicit: Column, coefficient: Column, ionic: Column, conductivity: Column, size_nm: float = 0.3, davies_most: float = 0.5,
    debye_most: float = 0.1, b0: float = 0.0, b1: float = 0.0, conductivity_range: tuple[float, float] = (0.0, float("inf")),
) -> Column:
    """A struct (activity, coefficient, empirical, warning, reason) by a model of each row: ideal, user_provided, davies, debye_huckel or
    conductivity (log10 activity = log10 concentration + b0 + b1 conductivity).

    An explicit activity goes before an explicit coefficient, and this before the model. Reasons for no activity: charge, coefficient,
    explicit_activity, concentration, model (user_provided without an activity, or an unknown one), ionic_strength, conductivity. Warnings:
    ionic strength or conductivity beyond the model's range."""
    bad = lambda x: F.isnan(x) | (x <= 0) | (x == float("inf"))
    curved = model.isin("davies", "debye_huckel")
    weak = ionic.isNull() | F.isnan(ionic) | (ionic < 0) | (ionic == float("inf"))
    dry = conductivity.isNull() | F.isnan(conductivity) | (conductivity < 0) | (conductivity == float("inf"))
    given, by_gamma = explicit.isNotNull(), coefficient.isNotNull()
    reason = (
        F.when(charge.isNull() | (charge == 0), "charge").when(by_gamma & bad(coefficient), "coefficient").when(given & bad(explicit), "explicit_activity").when(~given & (concentration.isNull() | bad(concentration)), "concentration")
        .when(~given & ~by_gamma & ~F.coalesce(model.isin("ideal", "davies", "debye_huckel", "conductivity"), F.lit(False)), "model").when(~given & ~by_gamma & curved & weak, "ionic_strength")
        .when(~given & ~by_gamma & (model == "conductivity") & dry, "conductivity")
    )
    gamma = F.when(by_gamma, coefficient).when(given, None).when(model == "ideal", 1.0).when(model == "davies", davies(charge, ionic)).when(model == "debye_huckel", debye_huckel(charge, ionic, F.lit(size_nm)))
    empirical = ~given & ~by_gamma & (model == "conductivity")
    value = F.when(given, explicit).when(empirical, F.pow(F.lit(10.0), F.log10(concentration) + b0 + b1 * conductivity)).otherwise(concentration * gamma)
    fine = reason.isNull()
    warning = F.when(given | by_gamma, None).when((model == "davies") & (ionic > davies_most), "ionic_strength").when((model == "debye_huckel") & (ionic > debye_most), "ionic_strength")
    warning = warning.when(empirical & ((conductivity < conductivity_range[0]) | (conductivity > conductivity_range[1])), "conductivity")
    return F.struct(F.when(fine, value).alias("activity"), F.when(fine, gamma).alias("coefficient"), (fine & F.coalesce(empirical, F.lit(False))).alias("empirical"), F.when(fine, warning).alias("warning"), reason.alias("reason"))


def primary_activity(effective: Column, charge: Column, others: Column) -> Column:
    """Inverse of :func:`effective_activity`: the ion's own activity, null where the others make up all of it."""
    own = effective - F.aggregate(others, F.lit(0.0), lambda s, o: s + o["k"] * F.pow(o["a"], charge / o["z"]))
    return F.when(own > 0, own)


def selectivity_derivative(e_slope: Column, effective: Column) -> Column:
    """Change of the potential with the ion's own activity: slope / (ln 10 * effective activity)."""
    return F.when(effective > 0, e_slope / (2.302585092994046 * effective))


def logistic_derivative(x: Column, low: float, high: float) -> Column:
    p = 1 / (1 + F.exp(-x))
    return (high - low) * p * (1 - p)


def logit_derivative(v: Column, low: float, high: float) -> Column:
    return F.when((v > low) & (v < high), (high - low) / ((v - low) * (high - v)))
