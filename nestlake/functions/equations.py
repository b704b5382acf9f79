"""Reaction texts ``left>agents>right`` as Columns: agents removed, or made from components.

Parts are sorted as texts, so that their order does not decide whether two texts agree.
A text with an extension block cannot lose its agents here: the block counts atoms by
position. It is passed over, as is half a reaction; what is made from components must be
complete, since a text that silently lacks a part describes something else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORDED = ("REACTION_CXSMILES", "REACTION_SMILES")
LEFT, AGENTS = ("REACTANT",), ("REAGENT", "SOLVENT", "CATALYST")


def _side(parts: Column) -> Column:
    return F.array_join(F.array_sort(parts), ".")


def _parts(text: Column) -> Column:
    return F.filter(F.split(text, r"\."), lambda p: p != "")


def without_agents(text: Column) -> Column:
    """``left>>right``; null for what is no whole reaction without an extension."""
    sides = F.split(F.trim(text), ">")
    left, right = _parts(F.get(sides, F.lit(0))), _parts(F.get(sides, F.lit(2)))
    whole = (F.size(sides) == 3) & (F.size(left) > 0) & (F.size(right) > 0) & ~text.contains("|")
    return F.when(whole, F.concat(_side(left), F.lit(">>"), _side(right)))


def _of(components: Column, roles: tuple[str, ...]) -> Column:
    return F.transform(F.filter(F.coalesce(components, F.array()), lambda c: c["reaction_role"].isin(*roles)), lambda c: c["smiles"])


def generated(components: Column, products: Column, agents: bool = False) -> Column:
    """From array<struct<smiles, reaction_role>> and array<struct<smiles>>; null where a needed text is missing."""
    left, right = _of(components, LEFT), F.transform(products, lambda p: p["smiles"])
    between = _side(F.filter(_of(components, AGENTS), lambda s: s.isNotNull())) if agents else F.lit("")
    blank = lambda s: s.isNull() | (s == "")
    complete = (F.size(left) > 0) & (F.size(right) > 0) & ~F.exists(left, blank) & ~F.exists(right, blank)
    return F.when(complete, F.concat(_side(left), F.lit(">"), between, F.lit(">"), _side(right)))


def derived(identifiers: Column, components: Column, products: Column) -> Column:
    """The first recorded text that can be read, by preference of type, else the generated one."""

    def recorded(kind: str) -> Column:
        texts = F.transform(F.filter(identifiers, lambda i: i["type"] == kind), lambda i: without_agents(i["value"]))
        return F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))

    return F.coalesce(*[recorded(kind) for kind in RECORDED], generated(components, products))
