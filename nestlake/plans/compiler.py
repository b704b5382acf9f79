"""Query tree -> DataFrame.

Each quantifier has up to three routes with the same answer:

* elements: a higher-order function over the nested column. The leaves that the body
  reads are zipped first, so the scan reads them and nothing else of the level. A structure
  predicate looks its element up among the record's own matches, which one join brings.
* pivot: EXISTS or NOT EXISTS over the flattened level, correlated on the record's id
  and every enclosing ordinal; Catalyst makes it a semi, anti or existence join.
* index: a semi join with the occurrences of matching structures.

Only quantifiers and structure predicates fold nulls; comparisons keep three values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import nested
from ..schema import Hop, Resolved, level, pruned, repeats, resolve
from .grammar import EQUAL, ORDERED, STRUCTURE, TEXT, Aggregate, Node, Query, Reduction, Value, compounds, parse_query

#: A copy of the id under a name that no inner plan has, so that it can only be the outer row's.
OUTER = "_outer_id"
ROUTES = ("auto", "elements", "pivot", "index")


class Tables(Protocol):
    """What the routes read. Each may answer None: not available."""

    def pivot(self, path: str) -> DataFrame | None: ...
    def occurrences(self) -> DataFrame | None: ...
    def matches(self, node: Node) -> DataFrame | None: ...
    def record_hits(self, node: Node) -> DataFrame | None: ...


@dataclass(frozen=True)
class Scope:
    """What paths are relative to. ``zipped``: hops that ``base`` has under another name.

    ``level``, ``ordinals`` and ``pivot``: set while a pivot's rows are bound.
    """

    struct: T.StructType
    base: Column | None = None
    zipped: dict[tuple[str, ...], str] = field(default_factory=dict)
    level: str | None = None
    ordinals: tuple[str, ...] = ()
    pivot: bool = False
    offset: Callable[[], Column] | None = None
    prefix: str = ""

    def read(self, hops: tuple[Hop, ...]) -> Column:
        names = tuple(h.name for h in hops)
        for n in range(len(names), 0, -1):
            if names[:n] in self.zipped:
                start = self.base.getField(self.zipped[names[:n]])
                return self._on(start, hops, n)
        return nested.read(self.base, hops)

    @staticmethod
    def _on(start: Column, hops: tuple[Hop, ...], n: int) -> Column:
        if any(repeats(h.kind) is not None for h in hops[:n]):
            # The zipped field is the whole repeated field itself.
            start = nested.as_array(start, hops[n - 1].kind)
            for hop in hops[n:]:
                start = start.getField(hop.name) if repeats(hop.kind) is None else nested.flatten(nested._inner(start, hop))
            return start
        return nested.read(start, hops[n:]) if hops[n:] else start


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType,))


def check_operand(op: str, value: Value, kind: T.DataType, path: str) -> None:
    if op in TEXT and not isinstance(kind, T.StringType):
        raise QueryError(f"{path!r}: {op} compares text")
    if op in ORDERED and not _numeric(kind):
        raise QueryError(f"{path!r}: {op} compares numbers")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        raise QueryError(f"{path!r} is no leaf")
    if value.compound is not None:
        if not isinstance(kind, T.StringType):
            raise QueryError(f"{path!r}: a compound is compared with text")
        return
    x = value.literal
    fits = isinstance(x, bool) if isinstance(kind, T.BooleanType) else isinstance(x, str) if isinstance(kind, (T.StringType, T.TimestampType, T.DateType)) else isinstance(x, (int, float)) and not isinstance(x, bool) if _numeric(kind) else False
    if not fits:
        raise QueryError(f"{path!r} ({kind.simpleString()}) cannot be compared with {x!r}")


class Compiler:
    def __init__(self, df: DataFrame, id_column: str, tables: Tables | None = None, route: str = "auto", bound: dict[str, str] | None = None, offset: str | None = None):
        if route not in ROUTES:
            raise QueryError(f"{route!r} is none of {', '.join(ROUTES)}")
        self.df, self.id, self.tables, self.route, self.bound, self.offset = df, id_column, tables, route, bound or {}, offset
        self.struct = df.schema
        self.routes: list[tuple[str, str]] = []  # (level, route taken), for tests and explanations
        self.hits: dict[str, DataFrame] = {}  # column -> (id, matching structures of the record)

    # ---- leaves

    def leaf(self, scope: Scope, path: str, what: str = "a value") -> tuple[Column, Resolved]:
        found = resolve(path, scope.struct)
        if found.repeated:
            raise QueryError(f"{path!r} crosses a repeated level; use exists, forall or a reduction to get {what}")
        return scope.read(found.hops), found

    def literal(self, value: Value, kind: T.DataType) -> Column:
        if value.compound is None:
            # A decimal literal beside a FLOAT column would be compared as DOUBLE.
            return F.lit(value.literal).cast(kind) if not isinstance(kind, (T.IntegerType, T.LongType)) or isinstance(value.literal, int) else F.lit(float(value.literal))
        if value.compound not in self.bound:
            raise QueryError(f"compound {value.compound!r} is not bound")
        return F.lit(self.bound[value.compound])

    def compare(self, node: Node, scope: Scope) -> Column:
        column, found = self.leaf(scope, node.path)
        check_operand(node.op, node.value, found.leaf, node.path)
        right = self.literal(node.value, found.leaf)
        if node.op in TEXT:
            return {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[node.op](column, right)
        return {
            "eq": column == right, "ne": column != right, "lt": column < right,
            "le": column <= right, "gt": column > right, "ge": column >= right,
        }[node.op]

    # ---- predicates

    def predicate(self, node: Node, scope: Scope) -> Column:
        if node.op in ("and", "or"):
            parts = [self.predicate(c, scope) for c in node.clauses]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.op == "and" else out | p
            return out
        if node.op == "not":
            return ~self.predicate(node.clauses[0], scope)
        if node.op in ("is_null", "not_null"):
            column, _ = self.leaf(scope, node.path)
            return column.isNull() if node.op == "is_null" else column.isNotNull()
        if node.op in (*EQUAL, *ORDERED, *TEXT):
            return self.compare(node, scope)
        if node.op in STRUCTURE:
            return self.structure(node, scope)
        return self.quantifier(node, scope)

    def quantifier(self, node: Node, scope: Scope) -> Column:
        # A pivot's element has lost its repeated fields; the record's schema still has them.
        found = resolve(f"{scope.level}.{node.path}", self.struct) if scope.pivot else resolve(node.path, scope.struct)
        if repeats(found.hops[-1].kind) is None and not found.repeated:
            raise QueryError(f"{node.path!r} is not repeated")
        if not isinstance(found.leaf, T.StructType):
            raise QueryError(f"{node.path!r} repeats no struct")
        full = f"{scope.level}.{node.path}" if scope.level else node.path
        if self.tables is not None and (scope.base is None and not scope.zipped or scope.pivot):
            if self.route in ("auto", "index") and not scope.pivot:
                column = self.by_index(node, full)
                if column is not None:
                    return column
            if self.route in ("auto", "pivot"):
                column = self.by_pivot(node, scope, full)
                if column is not None:
                    return column
        self.routes.append((full, "elements"))
        return self.by_elements(node, scope, found)

    def by_elements(self, node: Node, scope: Scope, found: Resolved) -> Column:
        body = node.where
        single = sum(repeats(h.kind) is not None for h in found.hops) == 1 and repeats(found.hops[-1].kind) is not None
        zipped: dict[tuple[str, ...], str] = {}
        if single and isinstance(found.hops[-1].kind, T.ArrayType) and scope.base is None:
            used = sorted(self.used(body, found.leaf))
            level_column = scope.read(found.hops)
            parts = []
            for i, names in enumerate(used):
                part = level_column
                for name in names:
                    part = part.getField(name)
                parts.append(part.alias(f"f{i}"))
                zipped[names] = f"f{i}"
            elements = F.arrays_zip(*parts) if parts else level_column
        else:
            elements = scope.read(found.hops)
        inner = lambda e: self.predicate(body, Scope(found.leaf, e, zipped))
        if node.op == "exists":
            return F.coalesce(F.exists(elements, inner), F.lit(False))
        return F.coalesce(F.forall(elements, lambda e: F.coalesce(inner(e), F.lit(True))), F.lit(True))

    def used(self, node: Node, struct: T.StructType) -> set[tuple[str, ...]]:
        """Field names, from an element, of what a body reads: leaves, or the first repeated field on the way."""
        out: set[tuple[str, ...]] = set()
        if node.path is not None:
            hops = resolve(node.path, struct, allow_internal=node.op in STRUCTURE).hops
            first = next((i + 1 for i, h in enumerate(hops) if repeats(h.kind) is not None), len(hops))
            out.add(tuple(h.name for h in hops[:first]))
            if node.op in STRUCTURE:
                out.add((*(h.name for h in hops[:-1]), "structure_id"))
            if node.op in ("exists", "forall"):
                return out
        for c in node.clauses:
            out |= self.used(c, struct)
        return out

    # ---- pivots

    def by_pivot(self, node: Node, scope: Scope, full: str) -> Column | None:
        """None where no pivot covers the body."""
        try:
            target = level(full, self.struct)
        except QueryError:
            return None  # a struct below a level
        if scope.pivot and target.ordinals[: len(scope.ordinals)] != scope.ordinals:
            return None
        flat = pruned(target.struct)
        if not self.covered(node.where, flat, full):
            return None
        pivot = self.tables.pivot(full)
        if pivot is None:
            return None
        self.routes.append((full, "pivot"))
        name = f"p{len(self.routes)}"
        pivot = pivot.select(*[F.col(c).alias(f"{name}_{c}") for c in pivot.columns])
        inner = Scope(flat, F.col(f"{name}_element"), level=full, ordinals=target.ordinals, pivot=True, offset=lambda: F.col(f"{name}_global_id"), prefix=name)
        body = self.predicate(node.where, inner)
        outer = scope.prefix
        keys = [self.id, *(scope.ordinals if scope.pivot else ())]
        on = F.lit(True)
        for k in keys:
            on = on & (F.col(f"{name}_{k}") == F.col(f"{outer}_{k}" if outer else OUTER).outer())
        return pivot.where(on & body).exists() if node.op == "exists" else ~pivot.where(on & ~body).exists()

    def covered(self, node: Node, flat: T.StructType, full: str) -> bool:
        if node.op in ("exists", "forall"):
            try:
                inner = level(f"{full}.{node.path}", self.struct)
            except QueryError:
                return False
            return self.tables.pivot(inner.path) is not None and self.covered(node.where, pruned(inner.struct), inner.path)
        if node.path is not None:
            try:
                resolve(node.path, flat, allow_internal=node.op in STRUCTURE)
            except QueryError:
                # A wrong path is an error on every route; let the elements route say so.
                return False
            if node.op in STRUCTURE and node.path != "smiles":
                return False
        return all(self.covered(c, flat, full) for c in node.clauses)

    # ---- structures

    def structure(self, node: Node, scope: Scope) -> Column:
        found = resolve(node.path, scope.struct)
        holder = resolve(".".join(node.path.split(".")[:-1]), scope.struct).leaf if "." in node.path else scope.struct
        if node.path.split(".")[-1] != "smiles" or found.repeated:
            raise QueryError(f"{node.path!r}: {node.op} is asked of a structure's own smiles")
        if not isinstance(holder, T.StructType) or "structure_id" not in holder.fieldNames() or self.tables is None:
            raise QueryError(f"{node.path!r} carries no structure")
        bound = node if node.compound is None else Node(node.op, path=node.path, pattern=self.bound_pattern(node.compound), compound=node.compound, threshold=node.threshold)
        if scope.pivot and node.path == "smiles":
            matches = self.tables.matches(bound).select(F.col("global_id").alias("match_id"))
            return matches.where(F.col("match_id") == scope.offset().outer()).exists()
        own = resolve((".".join([*node.path.split(".")[:-1], "structure_id"])), scope.struct, allow_internal=True)
        number = scope.read(own.hops)
        number = number + F.col(f"`{self.offset}`") if self.offset else number
        name = f"_hits{len(self.hits)}"
        self.hits[name] = self.tables.record_hits(bound)
        return F.coalesce(F.array_contains(F.col(name), number.cast("long")), F.lit(False))

    def bound_pattern(self, compound: str) -> str:
        if compound not in self.bound:
            raise QueryError(f"compound {compound!r} is not bound")
        return self.bound[compound]

    def by_index(self, node: Node, full: str) -> Column | None:
        """exists over one structure predicate on the element's own smiles, at most with a role."""
        parts = node.where.clauses if node.where.op == "and" else (node.where,)
        chem = [p for p in parts if p.op in STRUCTURE]
        roles = [p for p in parts if p.op == "eq" and p.path == "reaction_role" and p.value.compound is None and isinstance(p.value.literal, str)]
        if node.op != "exists" or len(chem) != 1 or chem[0].path != "smiles" or len(roles) > 1 or len(chem) + len(roles) != len(parts):
            return None
        occurrences = self.tables.occurrences()
        if occurrences is None or not occurrences.where(F.col("path") == full).limit(1).count():
            return None
        self.routes.append((full, "index"))
        bound = chem[0] if chem[0].compound is None else Node(chem[0].op, path="smiles", pattern=self.bound_pattern(chem[0].compound), threshold=chem[0].threshold)
        hit = occurrences.where(F.col("path") == full)
        if roles:
            hit = hit.where(F.col("reaction_role") == roles[0].value.literal)
        hit = hit.join(self.tables.matches(bound).select("global_id"), "global_id", "left_semi").select(F.col(self.id).alias("_occurs_in"))
        return hit.where(F.col("_occurs_in") == F.col(OUTER).outer()).exists()

    # ---- results

    def reduction(self, r: Reduction) -> Column:
        found = resolve(r.path, self.struct)
        if not found.repeated:
            raise QueryError(f"{r.path!r} crosses no repeated level; there is nothing to reduce")
        if r.reduce != "count" and not _numeric(found.leaf):
            raise QueryError(f"{r.path!r}: {r.reduce} needs numbers")
        return nested.reduce_values(Scope(self.struct).read(found.hops), r.reduce)

    def measure_input(self, m) -> Column:
        if m.path is None:
            return F.lit(1)
        if isinstance(m.path, Reduction):
            return self.reduction(m.path)
        column, found = self.leaf(Scope(self.struct), m.path, "an aggregate")
        if m.fn not in ("count", "count_distinct") and not _numeric(found.leaf):
            raise QueryError(f"{m.path!r}: {m.fn} needs numbers")
        return column

    def aggregate(self, df: DataFrame, a: Aggregate) -> DataFrame:
        groups = []
        for path in a.group_by:
            column, _ = self.leaf(Scope(self.struct), path, "a group")
            groups.append(column.alias(path))  # the whole path: last names may clash
        make = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        return df.groupBy(*groups).agg(*[make[m.fn](self.measure_input(m)).alias(m.name) for m in a.measures])

    def ordered(self, df: DataFrame, q: Query) -> DataFrame:
        keys, extra = [], []
        for i, o in enumerate(q.order_by):
            if q.aggregate is not None:
                names = {m.name for m in q.aggregate.measures} | set(q.aggregate.group_by)
                if isinstance(o.key, Reduction) or o.key not in names:
                    raise QueryError(f"{o.key!r}: an aggregated query is ordered by its measures and groups")
                column = F.col(f"`{o.key}`")
            elif isinstance(o.key, Reduction):
                column = self.reduction(o.key)
            else:
                column, _ = self.leaf(Scope(self.struct), o.key, "an order")
            if q.aggregate is None:
                df, column = df.withColumn(f"_key{i}", column), F.col(f"_key{i}")
                extra.append(f"_key{i}")
            keys.append(column.desc_nulls_last() if o.descending else column.asc_nulls_last())
        df = df.orderBy(*keys) if keys else df
        return (df.limit(q.limit) if q.limit else df).drop(*extra)

    def run(self, query: dict | str | Query) -> DataFrame:
        q = parse_query(query)
        if missing := [c for c in compounds(q) if c not in self.bound]:
            raise QueryError(f"not bound: {', '.join(missing)}")
        df = self.df
        if q.where is not None:
            where = self.predicate(q.where, Scope(self.struct))
            for name, found in self.hits.items():
                held = found.select(F.col(f"`{self.id}`").alias("_hit_id"), F.col("hits").alias(name))
                df = df.join(held, F.col(f"`{self.id}`").eqNullSafe(F.col("_hit_id")), "left").drop("_hit_id")
            df = df.withColumn(OUTER, F.col(f"`{self.id}`")).where(where).drop(OUTER, *self.hits)
        if q.aggregate is not None:
            return self.ordered(self.aggregate(df, q.aggregate), q)
        needed = [self.id] + [c for c in df.columns if c != self.id and q.order_by]
        return self.ordered(df.select(*[F.col(f"`{c}`") for c in needed]), q).select(self.id)


def compile_query(query: dict | str | Query, df: DataFrame, id_column: str, tables: Tables | None = None, route: str = "auto", bound: dict[str, str] | None = None, offset: str | None = None) -> DataFrame:
    """The DataFrame that answers ``query`` over ``df``."""
    return Compiler(df, id_column, tables, route, bound, offset).run(query)

