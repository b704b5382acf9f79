"""Records from a template and a table: ``$name$`` placeholders filled from columns.

The template is JSON text of a record. Substitution is a chain of replacements in the
JVM; parsing uses the record's schema. Where a cell is null, identifiers without value,
then components without identifiers or amount, then inputs without components go.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = re.compile(r"\$(\w+)\$")


def columns_of(template: str, table: DataFrame) -> dict[str, str]:
    """Placeholder -> column (``$name$`` or ``name``). A missing one is a ValueError."""
    out = {}
    for name in dict.fromkeys(PLACEHOLDER.findall(template)):
        column = next((c for c in (f"${name}$", name) if c in table.columns), None)
        if column is None:
            raise ValueError(f"placeholder ${name}$ has no column")
        out[name] = column
    return out


def filled(template: str, table: DataFrame) -> Column:
    """The template's text with a row's values in place of its placeholders, as JSON strings or numbers."""
    text: Column = F.lit(template)
    for name, column in columns_of(template, table).items():
        value = F.col(f"`{column}`")
        blank = value.isNull() | F.trim(value.cast("string")).isin("", "nan", "NaN")
        # Inside quotes a text is escaped; a quoted placeholder that is null becomes JSON null.
        quoted = F.when(blank, F.lit("null")).otherwise(F.to_json(F.array(value.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(value.cast("string")))) - 2))
        text = F.replace(text, F.lit(f'"${name}$"'), quoted)
        text = F.replace(text, F.lit(f"${name}$"), F.when(blank, F.lit("null")).otherwise(value.cast("string")))
    return text


def enumerated(template: str, table: DataFrame, schema: T.StructType) -> DataFrame:
    """One record for each row; a row whose text does not parse is a runtime error."""
    record = F.from_json(filled(template, table), schema, {"mode": "FAILFAST"})
    return table.select(record.alias("r")).select("r.*")


def without_blanks(inputs: Column) -> Column:
    """Prunes an array of {components: [{identifiers: [{value}], amount}]}: see the module's text."""
    good_identifiers = lambda c: F.filter(c["identifiers"], lambda i: i["value"].isNotNull() & (F.trim(i["value"]) != ""))
    components = lambda x: F.filter(
        F.transform(x["components"], lambda c: c.withField("identifiers", good_identifiers(c))),
        lambda c: (F.size(c["identifiers"]) > 0) & c["amount"].isNotNull(),
    )
    return F.filter(F.transform(inputs, lambda x: x.withField("components", components(x))), lambda x: F.size(x["components"]) > 0)


# ---- constructors of common records, as columns


def solution(solute: Column, solvent: Column, volume_liters: Column, molar: Column) -> Column:
    """Solute and solvent components; the solute's moles follow from volume and concentration."""
    from ..functions.units import solute_moles

    amount = solute_moles(volume_liters, molar)
    none = F.lit(None)
    return F.array(
        F.struct(solute.alias("name"), F.lit("REACTANT").alias("reaction_role"), amount["value"].alias("value"), amount["unit"].alias("units"), none.cast("boolean").alias("volume_includes_solutes")),
        F.struct(solvent.alias("name"), F.lit("SOLVENT").alias("reaction_role"), volume_liters.alias("value"), F.lit("liter").alias("units"), F.lit(True).alias("volume_includes_solutes")),
    )


def workup(kind: str, details: str | None = None, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(details).cast("string").alias("details"), *[c.alias(n) for n, c in fields.items()])


def add_solution(name: Column, volume_liters: Column) -> Column:
    return workup("ADDITION", input=F.struct(name.alias("name"), volume_liters.alias("volume_liters")))


def separate_phases(keep: str) -> Column:
    return workup("EXTRACTION", keep_phase=F.lit(keep))


def drying_agent(name: Column) -> Column:
    return workup("DRY_WITH_MATERIAL", input=F.struct(name.alias("name"), F.lit(None).cast("double").alias("volume_liters")))


def filtration(keep: str) -> Column:
    return workup("FILTRATION", keep_phase=F.lit(keep))


def rotovap() -> Column:
    return workup("CONCENTRATION")
