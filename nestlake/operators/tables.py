"""Operators on plain tables: linking, orphans, increments, references, ranks, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the given order (which should break ties)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def latest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """For each key the columns of its latest row; ties by the columns' values. Partial, without a sort."""
    best = F.max(F.struct(at, *columns)).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in (at, *columns)])


def incremental(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return new.join(done.select(*keys), keys, "left_anti")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old with _change: insert, update, delete or keep. Nulls compare as values."""
    values = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "keep").otherwise("update")
    )
    both = a.join(b, keys, "full_outer").withColumn("_change", change)
    pick = F.coalesce("_new", "_old")
    return both.select(*keys, *[pick.getField(c).alias(c) for c in values], "_change")


def deduplicated_links(df: DataFrame, value: str, id_name: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary: value, id), (df with id): each distinct value once, rows linked to it."""
    from .structures import hashed_ids

    dictionary = hashed_ids(df, value, id_name)
    return dictionary, df.join(dictionary, value, "left")


def orphans(dictionary: DataFrame, referring: list[DataFrame], key: str) -> DataFrame:
    """Dictionary rows that no table refers to."""
    out = dictionary
    for table in referring:
        out = out.join(table.select(key), key, "left_anti")
    return out


def union_paths(parts: list[DataFrame], distinct: bool = False) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct() if distinct else out


def cross_references(records: DataFrame, id_column: str, references: DataFrame) -> DataFrame:
    """(problem, id): duplicate ids, references to oneself, references to nothing.

    references: id_column, refers_to. Each part is one aggregation or anti join.
    """
    twice = records.groupBy(id_column).count().filter("count > 1").select(F.lit("duplicate").alias("problem"), F.col(id_column).alias("id"))
    own = references.filter(F.col(id_column) == F.col("refers_to")).select(F.lit("self").alias("problem"), F.col(id_column).alias("id")).distinct()
    lost = (
        references.select(F.col("refers_to").alias(id_column)).distinct().join(records.select(id_column), id_column, "left_anti")
        .select(F.lit("undefined").alias("problem"), F.col(id_column).alias("id"))
    )
    return twice.unionByName(own).unionByName(lost)


def offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """key, size, start: exclusive prefix sums in key order. One row for each file, so one task will do."""
    before = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(key, size, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("start"))


def result_difference(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(side, key): missing and extra."""
    missing = expected.select(key).distinct().join(got.select(key), key, "left_anti").select(F.lit("missing").alias("side"), key)
    extra = got.select(key).distinct().join(expected.select(key), key, "left_anti").select(F.lit("extra").alias("side"), key)
    return missing.unionByName(extra)


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs become columns with dotted names; arrays and maps stay as they are."""
    from pyspark.sql import types as T

    def walk(struct: T.StructType, column, name: str):
        for f in struct.fields:
            own = f"{name}{separator}{f.name}" if name else f.name
            inner = F.col(f"`{f.name}`") if column is None else column.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, inner, own)
            else:
                yield inner.alias(own)

    return df.select(*walk(df.schema, None, ""))


def message_rows(df: DataFrame, id_column: str) -> DataFrame:
    """(id, key, value): one row for each leaf that is set, with keys like a.b[0].c and m["k"]."""
    from pyspark.sql import types as T

    entry = "array<struct<key:string,value:string>>"
    none = F.array().cast(entry)

    def entries(kind: T.DataType, column, name):
        if isinstance(kind, T.StructType):
            parts = [entries(f.dataType, column.getField(f.name), F.concat(name, F.lit(f".{f.name}"))) for f in kind.fields]
            return F.concat(*parts) if parts else none
        if isinstance(kind, T.ArrayType):
            inside = F.transform(F.coalesce(column, F.array().cast(kind)), lambda x, i: entries(kind.elementType, x, F.concat(name, F.lit("["), i.cast("string"), F.lit("]"))))
            return F.flatten(inside)
        if isinstance(kind, T.MapType):
            pairs = F.map_entries(column)
            inside = F.transform(
                F.coalesce(pairs, F.map_entries(F.create_map().cast(kind))),
                lambda e: entries(kind.valueType, e["value"], F.concat(name, F.lit('["'), e["key"].cast("string"), F.lit('"]'))),
            )
            return F.flatten(inside)
        return F.when(column.isNotNull(), F.array(F.struct(name.alias("key"), column.cast("string").alias("value")))).otherwise(none)

    parts = [entries(f.dataType, F.col(f"`{f.name}`"), F.lit(f.name)) for f in df.schema.fields if f.name != id_column]
    return df.select(id_column, F.explode(F.concat(*parts)).alias("_e")).select(id_column, "_e.key", "_e.value")


def submessages(df: DataFrame, id_column: str, kind) -> DataFrame:
    """(id, trace, value): every struct of exactly the type ``kind`` at any depth, with the way to it."""
    from pyspark.sql import types as T

    from ..schema import element_struct
    from .rules import elements

    def paths(struct: T.StructType, at: str):
        for f in struct.fields:
            inner = element_struct(f.dataType) or (f.dataType if isinstance(f.dataType, T.StructType) else None)
            if inner is not None:
                own = f"{at}.{f.name}" if at else f.name
                if inner.simpleString() == kind.simpleString():
                    yield own
                yield from paths(inner, own)

    found = [elements(df, p, id_column).filter("_at IS NOT NULL").select(id_column, F.col("_trace").alias("trace"), F.col("_at").alias("value")) for p in paths(df.schema, "")]
    if not found:
        raise ValueError(f"no {kind.simpleString()} in this schema")
    return union_paths(found)


def varying_keys(rows: DataFrame, id_column: str) -> DataFrame:
    """Of message rows those whose key takes more than one value; being unset is a value."""
    n = rows.select(id_column).distinct().count()
    seen = rows.groupBy("key").agg(F.countDistinct("value").alias("values"), F.count(F.lit(1)).alias("rows"))
    return rows.join(seen.filter((F.col("values") > 1) | (F.col("rows") < n)).select("key"), "key")
