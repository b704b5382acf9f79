"""Names to structures, and inputs written in words, on the driver; tables join instead."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import CONCENTRATIONS, Quantity, Units

Resolver = Callable[[str], str]
INPUT = re.compile(r"(?P<amount>-?[\d.]+(?:e-?\d+)?\s*\S+)\s+of\s+(?:(?P<concentration>[\d.]+\s*[mu]?M)\s+)?(?P<solute>.+?)(?:\s+in\s+(?P<solvent>.+))?", re.IGNORECASE)


def chained(*resolvers: Resolver) -> Resolver:
    """The first resolver that knows the name; a KeyError if none does."""

    def resolve(name: str) -> str:
        for r in resolvers:
            try:
                return r(name)
            except (KeyError, ValueError):
                continue
        raise KeyError(name)

    return resolve


def resolve_names(names: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """names with ``smiles`` from a table (name, smiles), whatever the case; unknown names get null."""
    known = table.select(F.lower(F.trim("name")).alias("_name"), "smiles").dropDuplicates(["_name"])
    return names.withColumn("_name", F.lower(F.trim(F.col(column)))).join(known, "_name", "left").drop("_name")


@dataclass(frozen=True)
class Input:
    amount: Quantity
    solute: str
    solvent: str | None = None
    concentration: Quantity | None = None


def parse_input(text: str) -> Input:
    """"10 g of salt", "5 mL of 0.5 M salt in water". A concentration needs a solvent and a volume."""
    match = INPUT.fullmatch(text.strip())
    if match is None:
        raise ValueError(f"not understood: {text!r}")
    amount = Units().parse(match["amount"])
    strength = Units(CONCENTRATIONS, forbidden={}).parse(match["concentration"]) if match["concentration"] else None
    if (strength is None) != (match["solvent"] is None):
        raise ValueError(f"a solution has a concentration and a solvent: {text!r}")
    if strength is not None and amount.dimension != "volume":
        raise ValueError(f"a solution is measured by volume: {text!r}")
    return Input(amount, match["solute"], match["solvent"], strength)
