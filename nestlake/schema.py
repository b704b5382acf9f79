"""Walking a nested ``StructType``: paths, repeated levels, ordinals, pruning, rendering.

A *level* is a repeated field whose elements are structs: an array of structs, or a map
with struct values (only the values are quantified over). Field metadata marks columns
that are internal to derived tables, and lists the members of enumerations.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import QueryError

INTERNAL, ENUM = "internal", "enum"

#: Names that rendered schemas give to leaf types.
LEAVES = {
    T.StringType: "VARCHAR",
    T.BinaryType: "BLOB",
    T.BooleanType: "BOOLEAN",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.TimestampType: "TIMESTAMP",
    T.DateType: "DATE",
}


def is_internal(field: T.StructField) -> bool:
    return bool((field.metadata or {}).get(INTERNAL))


def enum_members(field: T.StructField) -> list[str]:
    return list((field.metadata or {}).get(ENUM, []))


def element_struct(kind: T.DataType) -> T.StructType | None:
    """The struct that a level repeats, or None if ``kind`` is no level."""
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    return inner if isinstance(inner, T.StructType) else None


def repeats(kind: T.DataType) -> T.DataType | None:
    """Type of an array's elements or a map's values, else None."""
    if isinstance(kind, T.ArrayType):
        return kind.elementType
    return kind.valueType if isinstance(kind, T.MapType) else None


def lookup(struct: T.StructType, name: str, path: str, allow_internal: bool = False) -> T.StructField:
    """The field, or a QueryError that suggests near names; internal ones do not exist for users."""
    seen = [f for f in struct.fields if allow_internal or not is_internal(f)]
    for field in seen:
        if field.name == name:
            return field
    if name in struct.fieldNames():
        raise QueryError(f"{path!r}: {name!r} is internal")
    near = difflib.get_close_matches(name, [f.name for f in seen], n=3)
    raise QueryError(f"{path!r}: no field {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))


@dataclass(frozen=True)
class Hop:
    """One step of a path. ``kind`` is the field's type."""

    name: str
    kind: T.DataType


@dataclass(frozen=True)
class Resolved:
    hops: tuple[Hop, ...]
    leaf: T.DataType
    repeated: bool
    field: T.StructField

    @property
    def last_level(self) -> int:
        """Number of hops up to and including the last repeated one."""
        return max((i + 1 for i, h in enumerate(self.hops) if repeats(h.kind)), default=0)


def resolve(path: str, struct: T.StructType, allow_internal: bool = False) -> Resolved:
    """Follow a dotted path from ``struct``; repeated hops are entered."""
    here: T.DataType = struct
    hops: list[Hop] = []
    field = None
    for name in path.split("."):
        if not isinstance(here, T.StructType):
            raise QueryError(f"{path!r}: {hops[-1].name!r} has no fields")
        field = lookup(here, name, path, allow_internal)
        hops.append(Hop(name, field.dataType))
        here = repeats(field.dataType) or field.dataType
    return Resolved(tuple(hops), here, any(repeats(h.kind) for h in hops), field)


def singular(name: str) -> str:
    """A repeated field's name for one of its elements."""
    if name.endswith("ies"):
        return name[:-3] + "y"
    if name.endswith(("sses", "xes", "ches", "shes")):
        return name[:-2]
    if name.endswith("yses"):
        return name[:-2] + "is"
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name


@dataclass(frozen=True)
class Level:
    """A repeated level: its path, the ordinal columns of it and the levels around it, its struct."""

    path: str
    ordinals: tuple[str, ...]
    struct: T.StructType
    is_map: bool


def levels(struct: T.StructType) -> list[Level]:
    """All repeated levels, in schema order."""

    def walk(here: T.StructType, path: tuple[str, ...], ordinals: tuple[str, ...]) -> Iterator[Level]:
        for f in here.fields:
            own = (*path, f.name)
            inner = element_struct(f.dataType)
            if inner is not None:
                name = f"{singular(f.name)}_index"
                if name in ordinals:
                    name = "_".join((*own[:-1], name))
                yield Level(".".join(own), (*ordinals, name), inner, isinstance(f.dataType, T.MapType))
                yield from walk(inner, own, (*ordinals, name))
            elif isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, own, ordinals)

    return list(walk(struct, (), ()))


def level(path: str, struct: T.StructType) -> Level:
    for found in levels(struct):
        if found.path == path:
            return found
    near = difflib.get_close_matches(path, [x.path for x in levels(struct)], n=3)
    raise QueryError(f"{path!r} is no repeated level" + (f"; did you mean {', '.join(near)}?" if near else ""))


def pruned(struct: T.StructType) -> T.StructType:
    """The struct without repeated fields, at any depth; structs that become empty go too."""
    kept = []
    for f in struct.fields:
        if repeats(f.dataType) is not None:
            continue
        kind = pruned(f.dataType) if isinstance(f.dataType, T.StructType) else f.dataType
        if not isinstance(kind, T.StructType) or kind.fields:
            kept.append(T.StructField(f.name, kind, True, f.metadata))
    return T.StructType(kept)


def leaves(struct: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.StructField]]:
    """Dotted path and field of every leaf, through levels too."""
    for f in struct.fields:
        inner = element_struct(f.dataType) or f.dataType
        if isinstance(inner, T.StructType):
            yield from leaves(inner, f"{prefix}{f.name}.")
        else:
            yield prefix + f.name, f


def _leaf_name(kind: T.DataType) -> str:
    return LEAVES[type(kind)]


def describe(struct: T.StructType) -> str:
    """Indented type tree: containers by their shape, enumerations with their members, internals hidden.

    A leaf type without a name here is a KeyError rather than a guess.
    """

    def lines(here: T.StructType, depth: int) -> Iterator[str]:
        for f in here.fields:
            if is_internal(f):
                continue
            kind, inner = f.dataType, repeats(f.dataType)
            children = (inner if inner is not None else kind) if isinstance(inner if inner is not None else kind, T.StructType) else None
            own = "STRUCT" if children is not None else _leaf_name(inner if inner is not None else kind)
            if isinstance(kind, T.ArrayType):
                own = f"LIST<{own}>"
            elif isinstance(kind, T.MapType):
                own = f"MAP<{_leaf_name(kind.keyType)}, {own}>"
            members = enum_members(f)
            yield "  " * depth + f"{f.name}: {own}" + (f"  ({' | '.join(members)})" if members else "")
            if children is not None:
                yield from lines(children, depth + 1)

    return "\n".join(lines(struct, 0))
