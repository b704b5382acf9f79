"""Columns that read nested paths, and reductions of what they reach.

A null inner list is skipped when lists are flattened, instead of making the whole
result null; a level that is absent stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Hop, repeats


def as_array(column: Column, kind: T.DataType) -> Column:
    """A map's values, or the array itself."""
    return F.map_values(column) if isinstance(kind, T.MapType) else column


def flatten(column: Column) -> Column:
    return F.flatten(F.filter(column, lambda x: x.isNotNull()))


def get(root: Column | None, name: str) -> Column:
    return F.col(f"`{name}`") if root is None else root.getField(name)


def read(root: Column | None, hops: tuple[Hop, ...] | list[Hop]) -> Column:
    """The value at a path from ``root`` (None: the row); one array if any hop repeats."""
    here, repeated = root, False
    for hop in hops:
        inner = repeats(hop.kind)
        if not repeated:
            here = get(here, hop.name)
            here = as_array(here, hop.kind) if inner is not None else here
        elif inner is None:
            here = here.getField(hop.name)  # an array of structs gives the array of the field
        else:
            here = flatten(_inner(here, hop))
        repeated = repeated or inner is not None
    return here


def _inner(elements: Column, hop: Hop) -> Column:
    """Array of arrays: the repeated field of each element."""
    if isinstance(hop.kind, T.MapType):
        return F.transform(elements, lambda e: F.map_values(e.getField(hop.name)))
    return elements.getField(hop.name)


def reduce_values(values: Column, how: str) -> Column:
    """min, max, avg, sum, count of an array; nulls ignored.

    An absent level gives null for every reduction. Without values count is 0 and the
    others are null. Sums are double.
    """
    held = F.filter(values, lambda x: x.isNotNull())
    if how == "count":
        return F.when(values.isNotNull(), F.size(held).cast("long"))
    if how == "min":
        return F.array_min(held)
    if how == "max":
        return F.array_max(held)
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x.cast("double"))
    some = F.size(held) > 0
    return F.when(some, total if how == "sum" else total / F.size(held))
