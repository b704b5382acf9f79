"""Pivots: one row for each element of a repeated level.

Columns: the record id, one 1-based ordinal for each enclosing level, and the element
without its repeated fields. A structure's number within the whole corpus is carried
along as ``global_id`` where the element has one, since an inner query cannot reach the
record's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import as_array
from ..schema import element_struct, level, pruned, repeats


def rebuilt(column: Column, kind: T.StructType) -> Column:
    """The struct reduced to the fields of ``kind``, null where it was null."""
    parts = []
    for f in kind.fields:
        part = column.getField(f.name)
        parts.append((rebuilt(part, f.dataType) if isinstance(f.dataType, T.StructType) else part).alias(f.name))
    return F.when(column.isNotNull(), F.struct(*parts))


def pivot(df: DataFrame, path: str, id_column: str, offset: str | None = None) -> DataFrame:
    """Rows of level ``path``; a record without elements has none."""
    target = level(path, df.schema)
    here: T.DataType = df.schema
    out = df.select(F.col(f"`{id_column}`"), F.struct("*").alias("_at"), *([F.col(f"`{offset}`").alias("_offset")] if offset else []))
    ordinals = iter(target.ordinals)
    done: list[str] = []
    for name in path.split("."):
        field = here[name]
        reached = F.col("_at").getField(name)
        kept = [F.col(c) for c in (id_column, *done)] + ([F.col("_offset")] if offset else [])
        if repeats(field.dataType) is not None:
            own = next(ordinals)
            out = out.select(*kept, F.posexplode(as_array(reached, field.dataType)).alias("_pos", "_at"))
            out = out.withColumn(own, (F.col("_pos") + 1).cast("int")).drop("_pos")
            done.append(own)
            here = element_struct(field.dataType) or field.dataType
        else:
            out = out.select(*kept, reached.alias("_at"))
            here = field.dataType
    flat = pruned(target.struct)
    columns = [F.col(c) for c in (id_column, *done)] + [rebuilt(F.col("_at"), flat).alias("element")]
    if "structure_id" in flat.fieldNames():
        number = F.col("_at.structure_id").cast("long")
        columns.append((number + F.col("_offset") if offset else number).alias("global_id"))
    return out.select(*columns)


def occurrences(df: DataFrame, id_column: str, paths: list[str], offset: str | None = None) -> DataFrame:
    """``occurrence_rows`` of records whose ids are distinct: an index keyed by others would answer for the wrong record."""
    from ..errors import ArtifactError

    twice = df.groupBy(id_column).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ArtifactError(f"duplicate {id_column}: {twice[0][0]!r}")
    return occurrence_rows(df, id_column, paths, offset)


def occurrence_rows(df: DataFrame, id_column: str, paths: list[str], offset: str | None = None) -> DataFrame:
    """(id, path, global_id, reaction_role) of every element that carries a structure.

    Paths may end in a struct below a level.
    """
    from ..schema import resolve

    parts = []
    for path in paths:
        found = resolve(path, df.schema, allow_internal=True)
        top = found.last_level
        names = [h.name for h in found.hops]
        rows = df.select(F.col(id_column), *([F.col(offset).alias("_offset")] if offset else []), _exploded(found.hops[:top]).alias("_e"))
        at = F.col("_e")
        for name in names[top:]:
            at = at.getField(name)
        role = at.getField("reaction_role") if "reaction_role" in found.leaf.fieldNames() else F.lit(None)
        number = at.getField("structure_id").cast("long")
        parts.append(
            rows.select(id_column, F.lit(path).alias("path"), (number + F.col("_offset") if offset else number).alias("global_id"), role.cast("string").alias("reaction_role")).filter("global_id is not null")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _exploded(hops) -> Column:
    from ..functions.nested import read

    return F.explode(read(None, hops))


def structure_paths(schema: T.StructType) -> list[str]:
    """Every struct below a level that holds ``structure_id``."""

    def walk(here: T.StructType, path: tuple[str, ...], inside: bool):
        if inside and "structure_id" in here.fieldNames():
            yield ".".join(path)
        for f in here.fields:
            inner = element_struct(f.dataType)
            if inner is not None:
                yield from walk(inner, (*path, f.name), True)
            elif isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, (*path, f.name), inside)

    return list(walk(schema, (), False))
