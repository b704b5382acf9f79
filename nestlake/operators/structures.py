"""The structures table, and the searches over it.

One row for each distinct structure of a projection: a dense id, spelling, identity
hashes and fingerprints. A search gives a *match set*, the global ids that qualify.
Searches run over distinct spellings, and Python sees only what the fingerprint screen
lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArtifactError
from ..functions import fingerprint as fp
from ..functions.chem import Chemistry
from ..functions.nested import read
from ..schema import resolve
from .pivot import structure_paths

FEATURES = (
    "mol_hash string, parent_hash string, pattern_fp array<bigint>, morgan_fp array<bigint>, morgan_popcount int"
)


#: Fixed value: bits below the partition's number in Spark's increasing ids.
RANGE_BITS = 33


def first_seen_ids(df: DataFrame, value: str, position: list[str], name: str = "structure_id") -> DataFrame:
    """value, id: 0, 1, ... in the order of first appearance. Nulls get none.

    The dictionary is sorted by ranges and kept; a value's id is its row in its range plus
    the sizes of the ranges before, so only one count for each range meets in a task.
    """
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*position)).alias("_at"))
    ranged = first.orderBy("_at", value).withColumn("_row", F.monotonically_increasing_id()).persist()
    part, row = F.shiftright("_row", RANGE_BITS).alias("_part"), F.col("_row").bitwiseAND(F.lit((1 << RANGE_BITS) - 1))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.withColumn("_part", part).join(starts, "_part").select(value, (F.col("_start") + row).cast("long").alias(name))


def hashed_ids(df: DataFrame, value: str, name: str = "structure_id") -> DataFrame:
    """value, id for dictionaries too large for one sort: a 64-bit hash of the value, no order promised."""
    return df.filter(F.col(value).isNotNull()).select(value).distinct().select(value, F.xxhash64(value).alias(name))


def pairs(df: DataFrame) -> DataFrame:
    """Distinct (structure_id, smiles) of every place in the schema that holds a structure."""
    out = None
    for path in structure_paths(df.schema):
        found = resolve(path, df.schema, allow_internal=True)
        top, names = found.last_level, [h.name for h in found.hops]
        at = F.col("_e")
        rows = df.select(F.explode(read(None, found.hops[:top])).alias("_e"))
        for n in names[top:]:
            at = at.getField(n)
        part = rows.select(at.getField("structure_id").cast("long").alias("structure_id"), at.getField("smiles").alias("smiles"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ArtifactError("no structures in this schema")
    return out.filter("structure_id is not null").distinct()


def check_pairs(found: DataFrame) -> int:
    """Ids are 0..n-1, one spelling each, one id for each spelling. Returns n."""
    n, ids, names, low, high, blank = found.agg(
        F.count(F.lit(1)), F.countDistinct("structure_id"), F.countDistinct("smiles"), F.min("structure_id"), F.max("structure_id"), F.count_if(F.col("smiles").isNull())
    ).first()
    if blank:
        raise ArtifactError("a structure id without a structure")
    if n != ids:
        raise ArtifactError("an id stands for several structures")
    if n != names:
        raise ArtifactError("a structure has several ids")
    if n and (low, high) != (0, n - 1):
        raise ArtifactError(f"ids run from {low} to {high} for {n} structures")
    return n


def featurised(found: DataFrame, chemistry: Chemistry) -> DataFrame:
    """structure_id, smiles and FEATURES; what cannot be read keeps its row with nulls."""

    def one(text: str) -> tuple:
        try:
            morgan = chemistry.similarity_bits(text)
            return (chemistry.identity(text), chemistry.parent(text), fp.words_of(chemistry.pattern_bits(text), chemistry.bits), fp.words_of(morgan, chemistry.bits), len(morgan))
        except ValueError:
            return (None, None, None, None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for pdf in batches:
            made = pd.DataFrame([one(t) for t in pdf["smiles"]], columns=names)
            made["morgan_popcount"] = made["morgan_popcount"].astype("Int32")
            yield pd.concat([pdf.reset_index(drop=True), made], axis=1)

    return found.select("structure_id", "smiles").mapInPandas(run, f"structure_id long, smiles string, {FEATURES}")


def structures(projection: DataFrame, chemistry: Chemistry) -> DataFrame:
    found = pairs(projection)
    check_pairs(found)
    return featurised(found, chemistry)


# ---- searches; ``library``: global_id, smiles and FEATURES


def similar(library: DataFrame, molecule: str, threshold: float, chemistry: Chemistry, measure: str = "tanimoto") -> DataFrame:
    """Ids at or above the threshold. The popcount range prunes row groups before any bit is compared."""
    bits = chemistry.similarity_bits(molecule)
    query, count = fp.literal(fp.words_of(bits, chemistry.bits)), F.lit(len(bits))
    rows = library.filter("morgan_fp is not null")
    if measure == "tanimoto":
        low, high = fp.popcount_bounds(threshold, len(bits))
        rows = rows.filter(F.col("morgan_popcount").between(low, high))
    score = (fp.tanimoto if measure == "tanimoto" else fp.dice)(F.col("morgan_fp"), query, F.col("morgan_popcount"), count)
    return rows.filter(score >= threshold).select("global_id")


def containing(library: DataFrame, pattern: str, chemistry: Chemistry) -> DataFrame:
    """Screen by pattern bits, then verify each distinct survivor once."""
    query = fp.literal(fp.words_of(chemistry.pattern_bits(pattern, query=True), chemistry.bits))
    screened = library.filter("pattern_fp is not null").filter(fp.covers(F.col("pattern_fp"), query))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[chemistry.contains(t, pattern) for t in pdf["smiles"]]]

    hits = screened.select("smiles").distinct().mapInPandas(verify, "smiles string")
    return screened.join(hits, "smiles", "left_semi").select("global_id")


def same(library: DataFrame, molecule: str, chemistry: Chemistry, parent: bool = False) -> DataFrame:
    """Equality of the identity hash, or of the parent's."""
    key = chemistry.parent(molecule) if parent else chemistry.identity(molecule)
    column = "parent_hash" if parent else "mol_hash"
    return library.filter(F.col(column) == F.lit(key)).select("global_id")
