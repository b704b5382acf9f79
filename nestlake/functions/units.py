"""Quantities with units: parsing, conversion and canonical columns.

All of it exists as Columns; ``parse`` and ``convert`` are the scalar forms used on the
driver and in tests. A unit's dimension is never guessed: spellings that mean more than
one thing ("m") are refused.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimension, unit, factor to the dimension's base, spellings.
UNITS = (
    ("time", "day", 24, "d day days"),
    ("time", "hour", 1, "h hour hours hr hrs"),
    ("time", "minute", 1 / 60, "min mins minute minutes"),
    ("time", "second", 1 / 3600, "s sec secs second seconds"),
    ("mass", "kilogram", 1000000, "kg kgs kilogram kilograms"),
    ("mass", "gram", 1000, "g gram grams gs gm gms gr"),
    ("mass", "milligram", 1, "mg mgs milligrams milligram"),
    ("mass", "microgram", 0.001, "μg ug ugs micg micgs micrograms microgram"),
    ("moles", "mole", 1000, "mol mols mole moles"),
    ("moles", "millimole", 1, "mmol millimoles mmols mmole mmoles"),
    ("moles", "micromole", 0.001, "μmol umol umols micromoles"),
    ("moles", "nanomole", 0.000001, "nmol nanomoles"),
    ("volume", "liter", 1000, "L liter liters litres"),
    ("volume", "milliliter", 1, "mL milliliter milliliters cc cm3 mls"),
    ("volume", "microliter", 0.001, "μL uL micl microliter microliters"),
    ("volume", "nanoliter", 0.000001, "nL nanoliter nanoliters"),
    ("length", "meter", 100, "meter meters"),
    ("length", "centimeter", 1, "cm centimeter"),
    ("length", "millimeter", 0.1, "millimeter millimeters"),
    ("length", "inch", 2.54, "in inch inches"),
    ("length", "foot", 30.48, "ft foot feet"),
    ("pressure", "bar", 1 / 1.01325, "bar barg bars"),
    ("pressure", "atmosphere", 1, "atm atmosphere atmospheres"),
    ("pressure", "psi", 1 / 14.69595, "psi"),
    ("pressure", "kpsi", 1000 / 14.69595, "kpsi"),
    ("pressure", "pascal", 1 / 101325, "Pa pascal pascals pas"),
    ("pressure", "kilopascal", 1000 / 101325, "kPa kilopascals kPas"),
    ("pressure", "torr", 1 / 760, "torr"),
    ("pressure", "mm_hg", 1 / 760, "mmHg mm_Hg"),
    ("temperature", "celsius", 1, "°C C degC °celsius celsius degrees_C"),
    ("temperature", "fahrenheit", 5 / 9, "°F F degF fahrenheit"),
    ("temperature", "kelvin", 1, "K degK Kelvin"),
    ("current", "ampere", 1, "A ampere amps amp"),
    ("current", "milliampere", 0.001, "mA milliampere milliamp milliamps"),
    ("voltage", "volt", 1, "V volt volts"),
    ("voltage", "millivolt", 0.001, "mV millivolt millivolts"),
    ("wavelength", "nanometer", 1, "nm nanometer nanometers"),
    ("wavelength", "wavenumber", 1, "cm⁻¹ cm^-1 cm-1 wavenumber 1/cm"),
    ("flow_rate", "microliter_per_minute", 1, "μL/min uL/min"),
    ("flow_rate", "microliter_per_second", 60, "μL/s uL/s"),
    ("flow_rate", "milliliter_per_minute", 1000, "mL/min"),
    ("flow_rate", "milliliter_per_second", 60000, "mL/s"),
    ("flow_rate", "microliter_per_hour", 1 / 60, "μL/h uL/h"),
)
#: Concentrations are apart, since "M" collides with other spellings.
CONCENTRATIONS = (
    ("concentration", "molar", 1, "M molar"),
    ("concentration", "millimolar", 0.001, "mM millimolar"),
    ("concentration", "micromolar", 0.000001, "uM micromolar"),
)
FORBIDDEN = {"m": "ambiguous between meter and minute"}
#: The unit that canonical columns use for a dimension.
CANONICAL = {
    "current": "ampere", "flow_rate": "milliliter_per_minute", "length": "centimeter", "mass": "gram", "moles": "mole", "pressure": "kilopascal",
    "temperature": "kelvin", "time": "second", "voltage": "volt", "volume": "liter", "wavelength": "nanometer",
}
#: Offset from celsius before scaling: value_celsius = value * factor + SHIFT.
SHIFT = {"celsius": 0.0, "fahrenheit": -32 * 5 / 9, "kelvin": -273.15}
INVERSE = 1e7

#: One grammar for scalars and columns: an amount, then a unit. The second number of an amount
#: is an uncertainty or the far end of a range.
NUMBER = r"-?[0-9]+(?:\.[0-9]*)?(?:[eE]-?[0-9]+)?"
AMOUNT = rf"^({NUMBER})(?:([±-])({NUMBER}))?"
UNCERTAIN, RANGE = "±", "-"


class Refused(ValueError, KeyError):
    """Text that is no quantity, or a unit that is unknown, ambiguous or out of place."""


@dataclass(frozen=True)
class Quantity:
    dimension: str
    value: float
    unit: str
    precision: float | None = None


def signed(text: str) -> str:
    return text.strip().replace("−", "-")


def unit_text(rest: str) -> str:
    return rest.strip().removesuffix(".").rstrip()


def plain(spelling: str) -> str:
    return " ".join(spelling.replace("_", " ").split()).lower()


class Units:
    """A set of spellings. ``forbidden``: spelling -> why it is refused."""

    def __init__(self, rows=UNITS, forbidden: dict[str, str] | None = None):
        self.reasons = {plain(k): why for k, why in (FORBIDDEN if forbidden is None else forbidden).items()}
        self.dimension, self.factor = ({name: row[k] for row in rows for name in [row[1]]} for k in (0, 2))
        spelled = Counter(plain(s) for *_, all_of_it in rows for s in all_of_it.split())
        if twice := [s for s, n in spelled.items() if n > 1]:
            raise Refused(f"spelled twice: {twice}")
        self.names = {plain(s): name for _, name, _, all_of_it in rows for s in all_of_it.split()}

    def unit(self, text: str) -> str:
        word = plain(text)
        name = None if word in self.reasons else self.names.get(word)
        if name is None:
            raise Refused(f"{text!r}: {self.reasons.get(word, 'unknown unit')}")
        return name

    def parse(self, text: str, allow_range: bool = False) -> Quantity:
        """"1.25 h", "10±2 mL", and with ``allow_range`` "1-2 h" (its middle and half its width)."""
        text = signed(text)
        amount = re.match(AMOUNT, text)
        spelled = unit_text(text[amount.end() :]) if amount else ""
        if not spelled or spelled[0] in (UNCERTAIN, RANGE) or amount[2] == RANGE and not allow_range:
            raise Refused(f"no single value with a unit: {text!r}")
        near, far = float(amount[1]), float(amount[3] or 0)
        value, width = ((near + far) / 2, abs(far - near) / 2) if amount[2] == RANGE else (near, far)
        unit = self.unit(spelled)
        if value < 0 and unit not in SHIFT:
            raise Refused(f"negative: {text!r}")
        return Quantity(self.dimension[unit], value, unit, width or None)

    def convert(self, q: Quantity, to: str) -> Quantity:
        """``to`` is a unit's name or any of its spellings."""
        to = to if to in self.factor else self.unit(to)
        if self.dimension[to] != q.dimension:
            raise Refused(f"{q.dimension} cannot become {self.dimension[to]}")
        ratio = self.factor[q.unit] / self.factor[to]
        if q.dimension == "temperature":
            celsius = q.value * self.factor[q.unit] + SHIFT[q.unit]
            return Quantity(q.dimension, (celsius - SHIFT[to]) / self.factor[to], to, q.precision and q.precision * ratio)
        if q.dimension == "wavelength" and q.unit != to:
            p = q.precision
            width = INVERSE / 2 * (1 / (q.value - p) - 1 / (q.value + p)) if p and p != q.value else None
            return Quantity(q.dimension, INVERSE / q.value, to, width)
        return Quantity(q.dimension, q.value * ratio, to, q.precision and q.precision * ratio)


# ---- columns


def _among(unit: Column, dimension: str, make, rows=UNITS) -> Column:
    """A value for each unit of the dimension, null for any other."""
    out = F.lit(None).cast("double")
    for d, u, factor, _ in rows:
        if d == dimension:
            out = F.when(F.lower(unit) == u, make(u, factor)).otherwise(out)
    return out


def canonical_value(value: Column, unit: Column, dimension: str) -> Column:
    """The value in the dimension's canonical unit; null without value or unit, or where 1/0 would come out."""
    to = CANONICAL[dimension]
    target = next(f for d, u, f, _ in UNITS if u == to)
    value = value.cast("double")
    if dimension == "temperature":
        return _among(unit, dimension, lambda u, f: (value * f + SHIFT[u] - SHIFT[to]) / target)
    if dimension == "wavelength":
        return _among(unit, dimension, lambda u, f: value if u == to else F.try_divide(F.lit(INVERSE), value))
    return _among(unit, dimension, lambda u, f: value * f / target)


def canonical_precision(value: Column, precision: Column, unit: Column, dimension: str) -> Column:
    to = CANONICAL[dimension]
    target = next(f for d, u, f, _ in UNITS if u == to)
    value, precision = value.cast("double"), F.when(precision != 0, precision.cast("double"))
    if dimension == "wavelength":
        width = INVERSE / 2 * (F.try_divide(F.lit(1.0), value - precision) - F.try_divide(F.lit(1.0), value + precision))
        return _among(unit, dimension, lambda u, f: precision if u == to else width)
    return _among(unit, dimension, lambda u, f: precision * f / target)


def parsed(text: Column, rows=UNITS, allow_range: bool = False) -> Column:
    """struct(value, precision, unit, dimension) of a quantity's text, null where ``Units.parse`` refuses it."""
    text = F.trim(F.replace(text, F.lit("−"), F.lit("-")))
    near, joint, far = (F.regexp_extract(text, AMOUNT, k) for k in (1, 2, 3))
    near, far = near.try_cast("double"), F.coalesce(far.try_cast("double"), F.lit(0.0))
    spelled = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, AMOUNT, ""), r"^[\s_]+|[\s_]*\.?$", ""), r"[\s_]+", " "))
    allowed = [(s, name) for s, name in Units(rows).names.items() if s not in FORBIDDEN]
    unit = F.create_map(*[F.lit(x) for pair in allowed for x in pair])[spelled]
    dimension = F.create_map(*[F.lit(x) for d, u, _, _ in rows for x in (u, d)])[unit]
    span = joint == RANGE
    value = F.when(span, (near + far) / 2).otherwise(near)
    width = F.when(span, F.abs(far - near) / 2).otherwise(far)
    good = near.isNotNull() & unit.isNotNull() & ((value >= 0) | (dimension == "temperature")) & (F.lit(allow_range) | ~span)
    return F.when(good, F.struct(value.alias("value"), F.when(width != 0, width).alias("precision"), unit.alias("unit"), dimension.alias("dimension")))


def formatted(value: Column, precision: Column, unit: Column) -> Column:
    """"5 (± 0.1) mL"; null where a value or unit is missing."""
    shown = lambda c: F.regexp_replace(F.format_string("%.7g", c.cast("double")), r"(\.\d*?)0+$|\.$", "$1")
    short = lambda c: F.regexp_replace(shown(c), r"\.$", "")
    middle = F.when(precision.isNotNull() & (precision != 0), F.concat(F.lit(" (± "), short(precision), F.lit(")"))).otherwise("")
    return F.when(value.isNotNull() & unit.isNotNull(), F.concat(short(value), middle, F.lit(" "), unit))


def solute_moles(volume_liters: Column, molar: Column) -> Column:
    """struct(value, unit): moles scaled to the largest unit that keeps the value at 1 or more."""
    moles = volume_liters * molar
    scaled = [("mole", 1.0), ("millimole", 1e3), ("micromole", 1e6)]
    out = F.struct((moles * 1e9).alias("value"), F.lit("nanomole").alias("unit"))
    for unit, k in reversed(scaled):
        out = F.when(moles * k >= 1, F.struct((moles * k).alias("value"), F.lit(unit).alias("unit"))).otherwise(out)
    return F.when(moles.isNotNull(), out)
