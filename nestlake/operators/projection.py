"""From decoded records to the table that queries read.

Quantities become numbers: a struct of value, precision and units turns into two double
columns whose names carry the canonical unit, so values in other units are not missed.
Structural identifiers become one ``smiles`` beside which the others stay; where none of
them can be read, all stay. Every such structure gets a number.

Both rewrites are one pass of column expressions over the nested schema, at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import units as u
from ..functions.identifiers import best_identifier
from ..schema import INTERNAL, element_struct

#: How columns name the canonical unit of a dimension.
SUFFIX = {
    "current": "amperes", "flow_rate": "milliliters_per_minute", "length": "centimeters", "mass": "grams", "moles": "moles", "pressure": "kilopascals",
    "temperature": "kelvin", "time": "seconds", "voltage": "volts", "volume": "liters", "wavelength": "nanometers",
}
#: Identifier types that spell a structure, the preferred one first.
STRUCTURAL = ("CXSMILES", "SMILES", "INCHI", "MOLBLOCK")
DIMENSION_OF = {unit.upper(): dimension for dimension, unit, _, _ in u.UNITS}


def dimension(kind: T.DataType, field: str, known: dict[str, str]) -> str | None:
    """Dimension of a {value, precision, units} struct: by the members of its units, else by ``known`` field names."""
    if not isinstance(kind, T.StructType) or set(kind.fieldNames()) != {"value", "precision", "units"}:
        return None
    members = (kind["units"].metadata or {}).get("enum", [])
    found = {DIMENSION_OF[m] for m in members if m in DIMENSION_OF}
    if len(found) == 1:
        return found.pop()
    return known.get(field)


def _fields(struct: T.StructType, get, known: dict[str, str], numbered: bool):
    """Columns of the rewritten struct; ``get(name)`` reads a field of the original."""
    names = struct.fieldNames()
    structural = "identifiers" in names and (inner := element_struct(struct["identifiers"].dataType)) is not None and {"type", "value"} <= set(inner.fieldNames())
    if structural:
        smiles = best_identifier(get("identifiers"), STRUCTURAL)
        yield smiles.alias("smiles")
        if numbered:
            yield F.when(smiles.isNotNull(), F.xxhash64(smiles)).alias("structure_id", metadata={INTERNAL: True})
    for f in struct.fields:
        own = dimension(f.dataType, f.name, known)
        if own is not None:
            at, name = get(f.name), f.name
            yield u.canonical_value(at["value"], at["units"], own).alias(f"{name}_{SUFFIX[own]}")
            yield u.canonical_precision(at["value"], at["precision"], at["units"], own).alias(f"{name}_precision_{SUFFIX[own]}")
        elif structural and f.name == "identifiers":
            kept = F.filter(get(f.name), lambda i: ~i["type"].isin(*STRUCTURAL))
            whole = F.when(best_identifier(get(f.name), STRUCTURAL).isNull(), get(f.name)).otherwise(F.when(F.size(kept) > 0, kept))
            yield whole.alias(f.name)
        else:
            yield _value(f.dataType, get(f.name), known, numbered).alias(f.name, metadata=f.metadata or {})


def _value(kind: T.DataType, column: Column, known: dict[str, str], numbered: bool) -> Column:
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return column
        return F.when(column.isNotNull(), F.struct(*_fields(kind, column.getField, known, numbered)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        made = F.transform(column, lambda e: _value(kind.elementType, e, known, numbered))
        return F.when(F.size(column) > 0, made)  # empty lists are stored as null
    if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StructType):
        made = F.transform_values(column, lambda _, e: _value(kind.valueType, e, known, numbered))
        return F.when(F.size(column) > 0, made)
    return column


def projected(df: DataFrame, known: dict[str, str] | None = None, numbered: bool = True) -> DataFrame:
    """The query table of decoded records. ``known``: field name -> dimension where metadata does not tell.

    Structure numbers here are hashes, which need no dictionary; ``dense`` makes them 0..n-1.
    """
    return df.select(*_fields(df.schema, lambda n: F.col(f"`{n}`"), known or {}, numbered))


def dense(df: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(df with structure numbers 0..n-1, dictionary: smiles, structure_id) in order of first appearance by id.

    The dictionary is joined as one map for each record, made of that record's structures only.
    """
    from ..functions.nested import read
    from ..schema import resolve
    from .pivot import structure_paths
    from .structures import first_seen_ids

    seen = None
    for path in structure_paths(df.schema):
        found = resolve(path, df.schema, allow_internal=True)
        at = F.col("_e")
        rows = df.select(id_column, F.explode(read(None, found.hops[: found.last_level])).alias("_e"))
        for h in found.hops[found.last_level :]:
            at = at.getField(h.name)
        part = rows.select(id_column, at.getField("smiles").alias("smiles"))
        seen = part if seen is None else seen.unionByName(part)
    seen = seen.filter("smiles is not null").distinct()
    dictionary = first_seen_ids(seen, "smiles", [id_column, "smiles"])
    maps = seen.join(dictionary, "smiles").groupBy(id_column).agg(F.map_from_entries(F.collect_list(F.struct("smiles", "structure_id"))).alias("_ids"))

    def renumber(kind: T.DataType, column: Column) -> Column:
        if isinstance(kind, T.StructType):
            parts = []
            for f in kind.fields:
                if f.name == "structure_id" and "smiles" in kind.fieldNames():
                    parts.append(F.col("_ids")[column.getField("smiles")].alias(f.name, metadata=f.metadata or {}))
                else:
                    parts.append(renumber(f.dataType, column.getField(f.name)).alias(f.name, metadata=f.metadata or {}))
            return F.when(column.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(column, lambda e: renumber(kind.elementType, e))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StructType):
            return F.transform_values(column, lambda _, e: renumber(kind.valueType, e))
        return column

    joined = df.join(maps, id_column, "left")
    return joined.select(*[renumber(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]), dictionary
