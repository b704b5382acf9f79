"""Validation: rules as boolean columns, results as rows (id, trace, severity, message).

A rule names a level (or none: the record), a condition that must hold, a severity and
a message. Rules of one level are evaluated in one pass over its elements; an unknown
condition (null) does not complain, as the rule has nothing to judge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.nested import as_array
from ..schema import element_struct, repeats

ERROR, WARNING = "ERROR", "WARNING"


@dataclass(frozen=True)
class Rule:
    """``holds`` gets a reader of fields: ``holds(lambda name: Column)``."""

    name: str
    holds: Callable[[Callable[[str], Column]], Column]
    message: str
    severity: str = ERROR
    level: str | None = None


def elements(df: DataFrame, path: str, id_column: str) -> DataFrame:
    """id, _trace, _at for every element of a level of any depth (arrays and maps)."""
    out = df.select(F.col(id_column), F.lit("").alias("_trace"), F.struct("*").alias("_at"))
    here = df.schema
    for name in path.split("."):
        kind = here[name].dataType
        reached, dotted = F.col("_at").getField(name), F.concat("_trace", F.when(F.col("_trace") != "", ".").otherwise(""), F.lit(name))
        if repeats(kind) is not None and hasattr(kind, "keyType"):
            out = out.select(id_column, dotted.alias("_t"), F.explode(reached).alias("_k", "_at"))
            out = out.select(id_column, F.concat("_t", F.lit('["'), F.col("_k").cast("string"), F.lit('"]')).alias("_trace"), "_at")
        elif repeats(kind) is not None:
            out = out.select(id_column, dotted.alias("_t"), F.posexplode(as_array(reached, kind)).alias("_p", "_at"))
            out = out.select(id_column, F.concat("_t", F.lit("["), F.col("_p").cast("string"), F.lit("]")).alias("_trace"), "_at")
        else:
            out = out.select(id_column, dotted.alias("_trace"), reached.alias("_at"))
        here = element_struct(kind) or kind
    return out


def violations(df: DataFrame, id_column: str, rules: list[Rule]) -> DataFrame:
    """id, trace, severity, rule, message of every rule that does not hold."""
    parts = []
    for path in dict.fromkeys(r.level for r in rules):
        own = [r for r in rules if r.level == path]
        if path is None:
            rows, read = df.select(F.col(id_column), F.lit("").alias("_trace"), *[F.col(f"`{c}`").alias(f"_v_{c}") for c in df.columns]), _reader(None)
        else:
            rows, read = elements(df, path, id_column), _reader(F.col("_at"))
        found = F.array(*[F.when(~r.holds(read), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.name).alias("rule"), F.lit(r.message).alias("message"))) for r in own])
        parts.append(
            rows.select(F.col(id_column), F.col("_trace").alias("trace"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_f"))
            .select(id_column, "trace", "_f.severity", "_f.rule", "_f.message")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _reader(at: Column | None) -> Callable[[str], Column]:
    def read(name: str) -> Column:
        first, *rest = name.split(".")
        out = F.col(f"`_v_{first}`") if at is None else at.getField(first)
        for r in rest:
            out = out.getField(r)
        return out

    return read


# ---- rules that recur


def present(field: str, level: str | None = None, severity: str = ERROR) -> Rule:
    return Rule(f"{field}_present", lambda v: v(field).isNotNull() & (v(field).cast("string") != ""), f"{field} is not set", severity, level)


def non_negative(field: str, level: str | None = None) -> Rule:
    return Rule(f"{field}_non_negative", lambda v: v(field) >= 0, f"{field} is negative", ERROR, level)


def within(field: str, low: float, high: float, level: str | None = None, severity: str = WARNING) -> Rule:
    return Rule(f"{field}_range", lambda v: v(field).between(low, high), f"{field} lies outside {low} to {high}", severity, level)


def looks_like_fraction(field: str, level: str | None = None) -> Rule:
    return Rule(f"{field}_fraction", lambda v: ~((v(field) > 0) & (v(field) < 1)), f"{field} looks like a fraction, not a percentage", WARNING, level)


def custom_needs_details(kind: str, details: str, level: str | None = None) -> list[Rule]:
    return [
        Rule(f"{kind}_specified", lambda v: F.coalesce(v(kind), F.lit("UNSPECIFIED")) != "UNSPECIFIED", f"{kind} is unspecified", ERROR, level),
        Rule(f"{kind}_details", lambda v: (v(kind) != "CUSTOM") | (F.coalesce(v(details), F.lit("")) != ""), f"a custom {kind} needs {details}", ERROR, level),
    ]


def value_with_units(value: str, units: str, level: str | None = None, signed: bool = False) -> list[Rule]:
    rules = [Rule(f"{value}_units", lambda v: v(value).isNull() | (F.coalesce(v(units), F.lit("UNSPECIFIED")) != "UNSPECIFIED"), f"{value} has no units", ERROR, level)]
    return rules if signed else [*rules, non_negative(value, level)]


#: The lowest temperature of each unit.
ABSOLUTE_ZERO = {"CELSIUS": -273.15, "FAHRENHEIT": -459.0, "KELVIN": 0.0}


def above_absolute_zero(value: str, units: str, level: str | None = None) -> Rule:
    floor = lambda v: F.coalesce(*[F.when(v(units) == u, F.lit(t)) for u, t in ABSOLUTE_ZERO.items()])
    return Rule(f"{value}_absolute_zero", lambda v: v(value) >= floor(v), f"{value} lies below absolute zero", ERROR, level)


def not_empty(field: str, level: str | None = None) -> Rule:
    return Rule(f"{field}_not_empty", lambda v: F.coalesce(F.size(v(field)), F.lit(0)) > 0, f"there are no {field}", ERROR, level)


def at_most_one(field: str, flag: str, level: str | None = None) -> Rule:
    count = lambda v: F.size(F.filter(v(field), lambda x: F.coalesce(x[flag], F.lit(False))))
    return Rule(f"{flag}_once", lambda v: count(v) <= 1, f"several {field} have {flag}", WARNING, level)


def ordered(earlier: str, later: str, level: str | None = None) -> Rule:
    return Rule(f"{earlier}_before_{later}", lambda v: ids.timestamp(v(earlier)) <= ids.timestamp(v(later)), f"{later} precedes {earlier}", ERROR, level)


def readable_date(field: str, level: str | None = None) -> Rule:
    return Rule(f"{field}_date", lambda v: v(field).isNull() | ids.timestamp(v(field)).isNotNull(), f"{field} is no date", ERROR, level)


def well_formed(field: str, check: Callable[[Column], Column], what: str, level: str | None = None, severity: str = ERROR) -> Rule:
    return Rule(f"{field}_{what}", lambda v: check(v(field)), f"{field} is not a well-formed {what}", severity, level)


def trimmed(field: str, level: str | None = None) -> Rule:
    return Rule(f"{field}_trimmed", lambda v: v(field) == F.trim(v(field)), f"{field} has outer white space", WARNING, level)


def summary(found: DataFrame) -> DataFrame:
    """severity, rule, records, problems."""
    return found.groupBy("severity", "rule").agg(F.countDistinct(found.columns[0]).alias("records"), F.count(F.lit(1)).alias("problems"))
