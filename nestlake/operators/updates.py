"""New ids for records, and the references that follow them.

The map from old to new ids is written before it is used: a random id that Spark
evaluates twice would be two ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_map(df: DataFrame, id_column: str, prefix: str, path: str | None = None, seed: str | None = None) -> DataFrame:
    """old_id, new_id for ids that are not canonical (prefix + 32 hex digits).

    With ``seed`` new ids follow from the old ones; else they are random, and ``path``
    says where the map is written before anything reads it.
    """
    from ..functions.identifiers import is_hex_id

    stale = df.filter(~F.coalesce(is_hex_id(F.col(id_column), prefix), F.lit(False))).select(F.col(id_column).alias("old_id")).distinct()
    if seed is not None:
        return stale.select("old_id", F.concat(F.lit(prefix), F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce("old_id", F.lit(""))))).alias("new_id"))
    if path is None:
        raise ValueError("random ids need a path to be written to")
    stale.select("old_id", F.concat(F.lit(prefix), F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("new_id")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def renamed(df: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """df with new ids where the map has one."""
    return df.join(ids, df[id_column].eqNullSafe(ids["old_id"]), "left").withColumn(id_column, F.coalesce("new_id", id_column)).drop("old_id", "new_id").select(*df.columns)


def rewritten(df: DataFrame, id_column: str, references: str, ids: DataFrame) -> DataFrame:
    """An array column of ids with every mapped one replaced; order and nulls stay.

    Explode, one join with the map, regroup: the map may be of any size.
    """
    flat = df.select(id_column, F.posexplode(references).alias("_pos", "old_id")).join(ids, "old_id", "left")
    back = flat.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("new_id", "old_id").alias("v")))).alias("_r"))
    out = df.join(back, id_column, "left").withColumn(references, F.when(F.col("_r").isNotNull(), F.col("_r.v")).otherwise(F.col(references)))
    return out.drop("_r").select(*df.columns)


def with_event(events: Column, time: Column, person: Column, details: Column) -> Column:
    """The list of events with one more at its end; an absent list begins here."""
    event = F.struct(time.alias("time"), person.alias("person"), details.alias("details"))
    return F.concat(F.coalesce(events, F.array().cast("array<struct<time:string,person:string,details:string>>")), F.array(event))
