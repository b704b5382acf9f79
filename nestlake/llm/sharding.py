"""Sharding along a Hilbert curve over metadata.

Source, language and size are quantised to BITS bits each: the first two by cumulative
frequency, so that a frequent value spans more cells; the size by its logarithm. Rows
are ordered by curve index, and runs of equal length are cut, so that a shard covers
a compact box in every dimension and file statistics prune on any of them.

The order is made by range partitioning with the document id as the last key: a cell
that holds a third of all rows is cut like any other. Ranks follow from partition
counts, not from a global sort in one task. Only the lists of distinct sources and
languages are summed in one place.

Law: ``rows``; shard sizes in rows differ by at most one. Equal texts with equal
metadata are neighbours on the curve. Defined results: a null text has size 8 and the
checksum of the empty one; null metadata counts as the empty value; rows that repeat
take slots like others, as do ties; only the length of a very long text matters; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common

SHARDS, BITS = 24, 8
PART_ROWS = 100_000


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the curve of rows of coordinates below 2^bits (any number of dimensions).

    Works on the transposed form: bit planes from the top, each either inverting the low
    bits of the first axis or exchanging them with another axis; a Gray decode ends it.
    """
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for axis in range(dims):
            set_ = (x[axis] >> plane) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for axis in range(dims):
            index = index << 1 | (x[axis] >> plane) & 1
    return index


def hilbert_index(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for axes in batches:
        yield pd.Series(hilbert(np.stack([a.to_numpy() for a in axes], axis=1)))


def frequency_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """column, code: the middle of the value's range in the cumulative frequency, in 2^BITS cells."""
    order = Window.partitionBy(F.lit(0)).orderBy(column)
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(column, F.least(F.lit((1 << BITS) - 1), F.floor((upto - F.col("n") / 2) * (1 << BITS) / total)).cast("int").alias(code))


def size_code(size: Column) -> Column:
    """Logarithmic: eight cells for each doubling, from the number's leading bits."""
    doublings = F.length(F.bin(size)) - 1
    return F.least(F.lit((1 << BITS) - 1), doublings * 8 + F.floor(size * 8 / F.pow(F.lit(2.0), doublings)) - 8).cast("int")


def placed(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve's index and axes."""
    text = F.coalesce("text", F.lit(""))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), blank("lang"), blank("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = common.settle(rows, "shard-rows")
    coded = rows.join(frequency_codes(rows, "source", "source_code"), "source").join(frequency_codes(rows, "lang", "lang_code"), "lang")
    curve = coded.withColumn("size_code", size_code(F.col("size"))).withColumn("curve", F.pandas_udf(hilbert_index, LongType())("source_code", "lang_code", "size_code"))
    n = rows.count()
    order = ["curve", "text_crc32", "doc_id"]
    parts = max(common.shuffle_parts(df.sparkSession), common.parts_for(n, PART_ROWS))
    # The written table fixes each row's partition and its place there.
    cut = common.settle(
        curve.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-order"
    )
    part = F.shiftright("at", 33)
    sizes = cut.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # One row for each partition of the order, a number set above.
    rank = cut.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"rank * {shards} div {max(n, 1)}")
    slot = F.expr(f"rank - (shard * {n} + {shards - 1}) div {shards}")
    return rank.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "curve", "source_code", "lang_code", "size_code",
    )


def manifest(shards: DataFrame) -> DataFrame:
    """Box of each shard in every dimension, for pruning."""
    box = [f(c).alias(f"{name}_{c}") for c in ("curve", "source_code", "lang_code", "size_code") for name, f in (("min", F.min), ("max", F.max))]
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *box)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(common.table(spark, sf_dir, "documents"))


#: The same order in SQL: checksums by their table, the curve step by step.
ORACLE = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
x AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, lang, source, (length(h) // 2 + 8)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM x, t),
a AS (SELECT source, least({(1 << BITS) - 1}, floor((sum(n) OVER (ORDER BY source) - n / 2) * {1 << BITS} / sum(n) OVER ()))::INT AS source_code FROM (SELECT source, count(*) AS n FROM d GROUP BY 1)),
l AS (SELECT lang, least({(1 << BITS) - 1}, floor((sum(n) OVER (ORDER BY lang) - n / 2) * {1 << BITS} / sum(n) OVER ()))::INT AS lang_code FROM (SELECT lang, count(*) AS n FROM d GROUP BY 1)),
c AS (SELECT doc_id, size, text_crc32, source_code, lang_code, least({(1 << BITS) - 1}, (length(bin(size)) - 1) * 8 + size * 8 // (1::BIGINT << (length(bin(size)) - 1)) - 8)::INT AS size_code FROM d JOIN a USING (source) JOIN l USING (lang)),
h(doc_id, k, x0, x1, x2) AS (
  SELECT doc_id, 0, source_code, lang_code, size_code FROM c
  UNION ALL
  SELECT doc_id, k + 1, xor(x0, CASE WHEN up THEN low ELSE swap END), CASE k % 3 WHEN 1 THEN xor(x1, swap) ELSE x1 END, CASE k % 3 WHEN 2 THEN xor(x2, swap) ELSE x2 END
  FROM (SELECT *, CASE WHEN up THEN 0 ELSE xor(x0, xa) & low END AS swap FROM (SELECT *, (xa >> p) & 1 = 1 AS up, (1 << p) - 1 AS low FROM
    (SELECT *, {BITS - 1} - k // 3 AS p, CASE k % 3 WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS xa FROM h WHERE k < {3 * (BITS - 1)})))
),
g AS (SELECT doc_id, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2 FROM h WHERE k = {3 * (BITS - 1)}),
f AS (SELECT *, list_reduce(list_prepend(0, range(1, {BITS})), lambda s, p: xor(s, CASE WHEN (x2 >> p) & 1 = 1 THEN (1 << p) - 1 ELSE 0 END)) AS flip FROM g),
v AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, range({BITS - 1}, -1, -1)), lambda s, p: s * 8 + ((xor(x0, flip) >> p) & 1) * 4 + ((xor(x1, flip) >> p) & 1) * 2 + ((xor(x2, flip) >> p) & 1)) AS curve FROM f),
r AS (SELECT c.*, curve, row_number() OVER (ORDER BY curve, text_crc32, c.doc_id) - 1 AS rank, count(*) OVER () AS n FROM c JOIN v USING (doc_id))
SELECT doc_id, size, text_crc32, 'rows' AS law, (rank * {SHARDS} // n)::INT AS shard, (rank - (rank * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, curve, source_code, lang_code, size_code FROM r
"""
