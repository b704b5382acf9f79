"""Rule families for experiment records: inputs, identifiers, conditions, workups, products, measurements.

Most rules of a record are of two shapes: a kind asks for a field (``asks``), or a field
belongs to certain kinds (``belongs``). The families are tables of such rules for a level
that the caller names, so they fit any schema with these fields; ``applicable`` leaves out
those whose fields a schema lacks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import element_struct
from .rules import ERROR, WARNING, Rule, custom_needs_details, non_negative, within

#: State of matter by texture, from the lightest.
STATE = {
    "GAS": 1, "OIL": 2, "FOAM": 2, "LIQUID": 2, "POWDER": 3, "CRYSTAL": 3, "WAX": 3, "AMORPHOUS_SOLID": 3, "SEMI_SOLID": 3, "SOLID": 3,
}
#: Written forms of identifiers.
FORMS = {
    "CAS_NUMBER": r"^\d{2,7}-\d{2}-\d$", "INCHI_KEY": r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$", "PUBCHEM_CID": r"^\d+$", "CHEMSPIDER_ID": r"^\d+$",
}
AMOUNTS = ("mass", "moles", "volume", "unmeasured")
VALUES = ("percentage", "float_value", "string_value", "mass")


def given(c: Column) -> Column:
    """Set, and not an empty text or list; never null."""
    text = c.cast("string")
    return c.isNotNull() & ~text.isin("", "[]")


def said(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def choice(v, parent: str, names: Iterable[str]) -> Column:
    """Which one of the fields is set; null if none."""
    at = f"{parent}." if parent else ""
    return F.coalesce(*[F.when(v(at + n).isNotNull(), F.lit(n)) for n in names])


def asks(kinds: Iterable[str], field: str, level: str | None, severity: str = WARNING, kind: str = "type") -> Rule:
    kinds = tuple(kinds)
    return Rule(f"{'_or_'.join(kinds).lower()}_needs_{field}", lambda v: ~said(v(kind).isin(*kinds)) | given(v(field)), f"{' or '.join(kinds)} asks for {field}", severity, level)


def belongs(field: str, kinds: Iterable[str], level: str | None, severity: str = ERROR, kind: str = "type") -> Rule:
    kinds = tuple(kinds)
    return Rule(f"{field}_only_for_{'_or_'.join(kinds).lower()}", lambda v: ~given(v(field)) | said(v(kind).isin(*kinds)), f"{field} is for {' or '.join(kinds)} only", severity, level)


def texture_state(texture: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATE.items() for x in pair])[texture]


def inputs(level: str | None) -> list[Rule]:
    count = lambda v: F.coalesce(F.size(v("components")), F.lit(0))
    alone = lambda v: (count(v) == 1) & said(v("components")[0]["amount"]["unmeasured"]["type"] == "SATURATED")
    states = lambda v: F.transform(v("components"), lambda c: texture_state(c["texture"]["type"]))
    lighter = lambda v: (count(v) > 0) & ~said(F.exists(states(v), lambda s: s.isNull())) & (F.array_max(states(v)) < texture_state(v("texture.type")))
    return [
        Rule("input_has_components", lambda v: count(v) > 0, "an input needs a component", ERROR, level),
        Rule("saturated_in_something", lambda v: ~alone(v), "a saturated solute needs a solvent", WARNING, level),
        Rule("texture_fits_components", lambda v: ~said(lighter(v)), "the input is more solid than its components", WARNING, level),
    ]


def amounts(level: str | None) -> list[Rule]:
    return [
        Rule("solutes_in_volumes_only", lambda v: v("amount.volume_includes_solutes").isNull() | (choice(v, "amount", AMOUNTS).eqNullSafe("volume")), "volume_includes_solutes is for volumes", ERROR, level),
        *[Rule(f"amount_{k}_non_negative", lambda v, k=k: v(f"amount.{k}.value") >= 0, f"{k} is negative", ERROR, level) for k in ("mass", "moles", "volume")],
    ]


def crude_components(level: str | None) -> list[Rule]:
    derived, kind = (lambda v: said(v("has_derived_amount"))), (lambda v: choice(v, "amount", AMOUNTS))
    return [
        Rule("crude_has_source", lambda v: given(v("reaction_id")), "a crude component names its reaction", ERROR, level),
        Rule("crude_amount_once", lambda v: derived(v) != kind(v).isNotNull(), "either a derived or a measured amount", ERROR, level),
        Rule("crude_amount_kind", lambda v: F.coalesce(kind(v), F.lit("mass")).isin("mass", "volume"), "crude amounts are masses or volumes", ERROR, level),
    ]


def identifiers(level: str | None) -> list[Rule]:
    return [
        *custom_needs_details("type", "details", level),
        Rule("identifier_value", lambda v: given(v("value")), "an identifier needs a value", ERROR, level),
        Rule("identifier_outer_space", lambda v: v("value") == F.trim(v("value")), "outer white space", WARNING, level),
        Rule("smiles_extension", lambda v: ~said((v("type") == "SMILES") & v("value").rlike(r"\s\|.*\|")), "an extended SMILES is typed as plain", WARNING, level),
        *[Rule(f"{kind.lower()}_form", lambda v, kind=kind, form=form: (v("type") != kind) | v("value").rlike(form), f"malformed {kind}", WARNING, level) for kind, form in FORMS.items()],
    ]


def compounds(level: str | None) -> list[Rule]:
    held = lambda v: F.coalesce(F.size(v("identifiers")), F.lit(0))
    return [
        Rule("compound_identified", lambda v: held(v) > 0, "a compound needs an identifier", ERROR, level),
        Rule("compound_not_by_name_only", lambda v: (held(v) > 0) & F.exists(v("identifiers"), lambda i: ~i["type"].eqNullSafe("NAME")), "no identifier but names", WARNING, level),
    ]


def preparations(level: str | None) -> list[Rule]:
    return [*custom_needs_details("type", "details", level), belongs("reaction_id", ["SYNTHESIZED"], level)]


def conditions(level: str | None) -> list[Rule]:
    dynamic = lambda v: said(v("conditions_are_dynamic"))
    return [
        Rule("dynamic_needs_details", lambda v: ~dynamic(v) | given(v("details")), "dynamic conditions need details", ERROR, level),
        Rule("details_are_dynamic", lambda v: ~given(v("details")) | dynamic(v), "details of conditions that are not dynamic", WARNING, level),
        within("ph", 0, 14, level),
    ]


def workups(level: str | None) -> list[Rule]:
    kind = lambda v: choice(v, "amount", AMOUNTS)
    return [
        *custom_needs_details("type", "details", level),
        Rule("wait_needs_duration", lambda v: (v("type") != "WAIT") | said(v("duration.value") != 0), "a wait needs its duration", WARNING, level),
        asks(["TEMPERATURE"], "temperature", level), asks(["EXTRACTION", "FILTRATION"], "keep_phase", level), asks(["STIRRING"], "stirring", level), asks(["PH_ADJUST"], "target_ph", level),
        Rule("workup_needs_input", lambda v: ~said(v("type").isin("ADDITION", "WASH", "DRY_WITH_MATERIAL", "SCAVENGING", "DISSOLUTION", "PH_ADJUST")) | given(v("input.components")), "the step needs an input", WARNING, level),
        within("target_ph", 0, 14, level),
        Rule("aliquot_amount", lambda v: (v("type") != "ALIQUOT") | F.coalesce(kind(v), F.lit("none")).isin("mass", "volume"), "an aliquot is a mass or a volume", WARNING, level),
        Rule("amount_of_aliquots", lambda v: kind(v).isNull() | said(v("type").isin("ALIQUOT", "CUSTOM")), "only aliquots and custom steps have amounts", WARNING, level),
    ]


def products(level: str | None) -> list[Rule]:
    return [Rule("side_product_not_desired", lambda v: ~(said(v("reaction_role") == "SIDE_PRODUCT") & said(v("is_desired_product"))), "a side product is not desired", ERROR, level)]


def measurements(level: str | None) -> list[Rule]:
    kind = lambda v: F.coalesce(choice(v, "", VALUES), F.lit("none"))
    return [
        *custom_needs_details("type", "details", level),
        Rule("measurement_has_analysis", lambda v: given(v("analysis_key")), "no analysis_key", WARNING, level),
        Rule("identity_has_no_value", lambda v: (v("type") != "IDENTITY") | (kind(v) == "none"), "an identity has no value", ERROR, level),
        Rule("share_in_percent", lambda v: ~said(v("type").isin("YIELD", "PURITY")) | (kind(v) == "percentage"), "yields and purities are percentages", WARNING, level),
        Rule("signal_is_numeric", lambda v: ~said(v("type").isin("AREA", "COUNTS", "INTENSITY")) | kind(v).isin("percentage", "float_value"), "a signal is a number", ERROR, level),
        belongs("selectivity", ["SELECTIVITY"], level),
    ]


def mass_spectra(level: str | None) -> list[Rule]:
    return [
        *custom_needs_details("type", "details", level), non_negative("tic_minimum_mz", level), non_negative("tic_maximum_mz", level),
        Rule("tic_range", lambda v: v("tic_minimum_mz") <= v("tic_maximum_mz"), "the range ends before it begins", ERROR, level),
        Rule("eic_masses_non_negative", lambda v: F.forall(v("eic_masses"), lambda x: x >= 0), "a negative mass", ERROR, level),
        asks(["EIC"], "eic_masses", level), Rule("eic_masses_not_for_tic", lambda v: ~given(v("eic_masses")) | ~said(v("type").startswith("TIC")), "masses of a total current", WARNING, level),
    ]


def outcomes(level: str | None) -> list[Rule]:
    count = lambda v, name: F.coalesce(F.size(v(name)), F.lit(0))
    wanted = lambda v: F.filter(v("products"), lambda p: said(p["is_desired_product"]))
    keys = lambda v: F.flatten(F.transform(v("products"), lambda p: F.coalesce(F.transform(p["measurements"], lambda m: m["analysis_key"]), F.array().cast("array<string>"))))
    known = lambda v: F.coalesce(F.map_keys(v("analyses")), F.array().cast("array<string>"))
    return [
        Rule("one_desired_product", lambda v: F.size(wanted(v)) <= 1, "several desired products", WARNING, level),
        Rule("analysis_exists", lambda v: F.size(F.array_except(F.filter(keys(v), given), known(v))) == 0, "a measurement names an analysis that is absent", ERROR, level),
        Rule("outcome_says_something", lambda v: (count(v, "products") > 0) | said(F.size(F.map_keys(v("analyses"))) > 0) | v("conversion").isNotNull(), "nothing is recorded", WARNING, level),
    ]


def illumination(level: str | None) -> list[Rule]:
    return [*custom_needs_details("type", "details", level), non_negative("peak_wavelength.value", level)]


def rpm(level: str | None) -> list[Rule]:
    return [non_negative("rpm", level)]


def applicable(schema: StructType, rules: list[Rule]) -> list[Rule]:
    """Rules whose level exists and which read only fields that the level has."""
    return [r for r in rules if (at := _at(schema, r.level)) is not None and _reads(r) <= _paths(at)]


def _at(schema: StructType, level: str | None) -> StructType | None:
    here = schema
    for name in level.split(".") if level else ():
        if not isinstance(here, StructType) or name not in here.names:
            return None
        here = element_struct(here[name].dataType) or here[name].dataType
    return here if isinstance(here, StructType) else None


def _paths(at: StructType, before: str = "") -> set[str]:
    out = set()
    for f in at.fields:
        out |= {before + f.name} | (_paths(f.dataType, f"{before}{f.name}.") if isinstance(f.dataType, StructType) else set())
    return out


def _reads(rule: Rule) -> set[str]:
    seen: set[str] = set()

    def watch(name: str) -> Column:
        seen.add(name)
        return F.col("_")

    rule.holds(watch)
    return seen
