"""Nested records as normalised tables, and back.

One table for each level: a key, the parent's key, the ordinal in its parent (or the
map's key), and the fields that do not repeat. Keys are hashes of the record id and the
ordinals on the way, so they are the same every time and need no coordination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import element_struct
from .pivot import rebuilt


def _children(struct: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Repeated struct fields reached through structs only."""
    out = []
    for f in struct.fields:
        if element_struct(f.dataType) is not None:
            out.append(((*path, f.name), f.dataType))
        elif isinstance(f.dataType, T.StructType):
            out += _children(f.dataType, (*path, f.name))
    return out


def _flat(struct: T.StructType) -> T.StructType:
    """The struct without repeated structs; lists of scalars stay columns."""
    kept = []
    for f in struct.fields:
        if element_struct(f.dataType) is not None:
            continue
        kind = _flat(f.dataType) if isinstance(f.dataType, T.StructType) else f.dataType
        if not isinstance(kind, T.StructType) or kind.fields:
            kept.append(T.StructField(f.name, kind, True, f.metadata))
    return T.StructType(kept)


def decomposed(df: DataFrame, id_column: str, root: str = "record", owner: str | None = None) -> dict[str, DataFrame]:
    """Table name -> DataFrame. Names are the levels' paths under ``root``.

    Every table gets a column ``owner``, where that is given, with the id of the record, by
    which ``recomposed`` moves a row once at most, however deep it lies.
    """
    flat = _flat(df.schema)
    base = df.select(F.xxhash64(F.lit(root), F.col(id_column)).alias("key"), *([F.col(id_column).alias(owner)] if owner else []), F.struct("*").alias("_at"))
    own_id = [owner] if owner else []
    tables = {root: base.select("key", *own_id, *[_read("_at", (f.name,), f.dataType).alias(f.name) for f in flat.fields])}

    def walk(parents: DataFrame, struct: T.StructType, name: str) -> None:
        for path, kind in _children(struct):
            at = F.col("_at")
            for p in path:
                at = at.getField(p)
            own, inner = f"{name}.{'.'.join(path)}", element_struct(kind)
            if isinstance(kind, T.MapType):
                rows = parents.select(F.col("key").alias("parent"), *own_id, F.explode(at).alias("map_key", "_at")).withColumn("ordinal", F.lit(None).cast("int"))
                where = F.col("map_key").cast("string")
            else:
                rows = parents.select(F.col("key").alias("parent"), *own_id, F.posexplode(at).alias("ordinal", "_at")).withColumn("map_key", F.lit(None).cast("string"))
                where = F.col("ordinal").cast("string")
            rows = rows.withColumn("key", F.xxhash64(F.lit(own), F.col("parent"), where))
            fields = _flat(inner).fields
            tables[own] = rows.select("key", "parent", *own_id, "ordinal", "map_key", F.col("_at").isNull().alias("absent"), *[_read("_at", (f.name,), f.dataType).alias(f.name) for f in fields])
            walk(rows.select("key", *own_id, "_at"), inner, own)

    walk(base, df.schema, root)
    if owner and any([c.lower() for c in t.columns].count(owner.lower()) > 1 for t in tables.values()):
        raise ValueError(f"a level has a field {owner!r}")
    return tables


def _read(start: str, path: tuple[str, ...], kind: T.DataType):
    out = F.col(start)
    for p in path:
        out = out.getField(p)
    return rebuilt(out, kind) if isinstance(kind, T.StructType) else out


def recomposed(tables: dict[str, DataFrame], schema: T.StructType, root: str = "record", owner: str | None = None) -> DataFrame:
    """The records again. Empty lists come back as null, like lists that were never set.

    Without ``owner`` each level is shuffled by its parent's key, so a row moves as often as it
    lies deep. With it every level is grouped within its record, so tables that lie by record
    (as those of ``decomposed`` do if its frame did) are not shuffled again.
    """
    own_id = [owner] if owner else []

    def beside(rows: DataFrame, grouped: DataFrame, place: str) -> DataFrame:
        """The rows with their lists, where a join would shuffle both by all of its keys."""
        whole = F.struct(*[c for c in rows.columns if c not in (owner, "key")]).alias("_row")
        lists = grouped.select(owner, F.col("parent").alias("key"), F.lit(None).cast(rows.select(whole).schema[0].dataType).alias("_row"), place)
        both = rows.select(owner, "key", whole, F.lit(None).cast(grouped.schema[place].dataType).alias(place)).union(lists)
        met = both.groupBy(owner, "key").agg(F.collect_list("_row").alias("_rows"), F.first(place, ignorenulls=True).alias(place))
        return met.select(owner, "key", place, F.explode("_rows").alias("_row")).select(owner, "key", "_row.*", place)

    def build(struct: T.StructType, name: str) -> DataFrame:
        rows = tables[name].repartition(owner) if owner and name == root else tables[name]
        held = {}
        for i, (path, kind) in enumerate(_children(struct)):
            own = f"{name}.{'.'.join(path)}"
            inner = element_struct(kind)
            child = build(inner, own)
            value = F.when(~F.col("absent"), F.struct(*[F.col(f.name) for f in inner.fields])).alias("v")
            place = f"_c{i}"
            if isinstance(kind, T.MapType):
                grouped = child.groupBy("parent", *own_id).agg(F.map_from_entries(F.collect_list(F.struct("map_key", value))).alias(place))
            else:
                grouped = child.groupBy("parent", *own_id).agg(F.array_sort(F.collect_list(F.struct("ordinal", value)), lambda a, b: a["ordinal"] - b["ordinal"]).getField("v").alias(place))
            if not owner:
                rows = rows.join(grouped.withColumnRenamed("parent", "_p"), F.col("key") == F.col("_p"), "left").drop("_p")
            else:
                rows = beside(rows, grouped, place)
            held[path] = place

        def column(s: T.StructType, path: tuple[str, ...]):
            parts = []
            for f in s.fields:
                own = (*path, f.name)
                if own in held:
                    parts.append(F.col(held[own]).alias(f.name))
                    continue
                if isinstance(f.dataType, T.StructType):
                    part = column(f.dataType, own)
                else:
                    part = F.col(path[0]) if path else F.col(f.name)
                    for p in (*path[1:], f.name) if path else ():
                        part = part.getField(p)
                parts.append(part.alias(f.name))
            if not path:
                return parts
            whole = F.struct(*parts)
            set_ = F.lit(False)
            for p in parts:
                set_ = set_ | p.isNotNull()
            return F.when(set_, whole)

        extra = [c for c in ("key", "parent", *own_id, "ordinal", "map_key", "absent") if c in rows.columns]
        return rows.select(*extra, *column(struct, ()))

    return build(schema, root).drop("key", *own_id)


def deleted(tables: dict[str, DataFrame], ids: DataFrame, id_column: str, root: str = "record") -> dict[str, DataFrame]:
    """The tables without the records whose ids are given, and without anything below them."""
    out = {root: tables[root].join(ids.select(id_column), id_column, "left_anti").select(*tables[root].columns)}
    for name in sorted((n for n in tables if n != root), key=lambda n: n.count(".")):
        parent = max((n for n in out if name.startswith(f"{n}.")), key=len)
        alive = out[parent].select(F.col("key").alias("parent"))
        out[name] = tables[name].join(alive, "parent", "left_semi").select(*tables[name].columns)
    return out
