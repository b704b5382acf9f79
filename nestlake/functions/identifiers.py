"""Checks and extractions on identifier text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hex_id(value: Column, prefix: str) -> Column:
    """prefix + 32 lower-case hex digits."""
    return value.rlike(rf"^{prefix}[0-9a-f]{{32}}\z")


def is_orcid(value: Column) -> Column:
    """Form and ISO 7064 MOD 11-2 check digit."""
    digits = F.split(F.substring(F.replace(value, F.lit("-"), F.lit("")), 1, 15), "")
    total = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: (a + d.cast("int")) * 2)
    check = F.pmod(12 - total % 11, F.lit(11))
    last = F.when(check == 10, "X").otherwise(check.cast("string"))
    return F.when(value.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]\z"), F.right(value, F.lit(1)) == last).otherwise(F.when(value.isNotNull(), False))


def is_url(value: Column) -> Column:
    return value.rlike(r"(?i)^https?://[^\s/]+(?:/.*)?\z")


def is_email(value: Column) -> Column:
    return value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z")


def has_atom_mapping(smiles: Column) -> Column:
    return smiles.rlike(r"\[[^\]\[]*:[0-9]+\]")


def doi(value: Column) -> Column:
    """The bare identifier in a DOI or its address, null if there is none."""
    found = F.regexp_extract(F.trim(value), r"(10\.\d{4,9}/\S+?)[.,;]?$", 1)
    return F.when(found != "", found)


def first_of_type(identifiers: Column, kind: str) -> Column:
    """value of the first identifier of a type; null if none."""
    return F.get(F.filter(identifiers, lambda x: x["type"] == kind), F.lit(0))["value"]


def best_identifier(identifiers: Column, order: tuple[str, ...] = ("CXSMILES", "SMILES")) -> Column:
    """The first identifier by preference of type, then by position."""
    return F.coalesce(*[first_of_type(identifiers, kind) for kind in order])


def with_identifier(identifiers: Column, kind: str, value: Column) -> Column:
    """The list with the first identifier of a type replaced, or with one more at its end."""
    held = F.coalesce(identifiers, F.array().cast("array<struct<type:string,value:string>>"))
    new = F.struct(F.lit(kind).alias("type"), value.alias("value"))
    at = F.array_position(F.transform(held, lambda x: x["type"]), kind)
    return F.when(at > 0, F.transform(held, lambda x, i: F.when(i + 1 == at, new).otherwise(x))).otherwise(F.concat(held, F.array(new)))


def split_extension(text: Column) -> Column:
    """struct(core, extension) of text with a trailing |...| block."""
    core = F.regexp_extract(text, r"^(.*?)(?:\s+(\|.*\|))?$", 1)
    extension = F.regexp_extract(text, r"^(.*?)(?:\s+(\|.*\|))?$", 2)
    return F.struct(core.alias("core"), F.when(extension != "", extension).alias("extension"))


def product_yield(measurements: Column) -> Column:
    """Percentage of the first YIELD measurement."""
    return F.get(F.filter(measurements, lambda m: m["type"] == "YIELD"), F.lit(0))["percentage"]["value"]


#: Tried in this order; what none of them reads is null.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy, HH:mm:ss", "M/d/yyyy, h:mm:ss a", "MM/dd/yyyy", "d MMM yyyy")


def timestamp(value: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])


def shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
