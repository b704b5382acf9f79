"""The query tree and its JSON form.

A query is a dict (or JSON text) with the optional keys ``where``, ``aggregate``,
``order_by`` and ``limit``. Predicates name their node in ``op``. The forms are kept in
one table, so the parser below is the whole grammar: unknown keys, missing keys and
wrong kinds are refused with the path to the offending node.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from ..errors import QueryError

NAME = re.compile(r"[A-Za-z_]\w*\Z", re.ASCII)
ORDERED = ("lt", "le", "gt", "ge")
EQUAL = ("eq", "ne")
TEXT = ("contains", "starts_with", "ends_with")
STRUCTURE = ("substructure", "similarity", "same_compound", "same_parent")
REDUCERS = ("min", "max", "avg", "sum", "count")
AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Value:
    """A literal, or the name of a compound to be resolved and bound."""

    literal: Any = None
    compound: str | None = None


@dataclass(frozen=True)
class Node:
    """A predicate. Which attributes are set depends on ``op``."""

    op: str
    clauses: tuple[Node, ...] = ()
    path: str | None = None
    value: Value | None = None
    pattern: str | None = None
    compound: str | None = None
    threshold: float | None = None

    @property
    def where(self) -> Node:
        return self.clauses[0]


@dataclass(frozen=True)
class Reduction:
    reduce: str
    path: str


@dataclass(frozen=True)
class Measure:
    fn: str
    name: str
    path: str | Reduction | None = None


@dataclass(frozen=True)
class Aggregate:
    measures: tuple[Measure, ...]
    group_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Order:
    key: str | Reduction
    descending: bool = False


@dataclass(frozen=True)
class Query:
    where: Node | None = None
    aggregate: Aggregate | None = None
    order_by: tuple[Order, ...] = field(default_factory=tuple)
    limit: int | None = None


def _fail(at: str, what: str) -> None:
    raise QueryError(f"{at or 'query'}: {what}")


def _keys(data: Any, at: str, needed: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    if not isinstance(data, dict):
        _fail(at, f"an object is expected, not {type(data).__name__}")
    if missing := [k for k in needed if k not in data]:
        _fail(at, f"missing {', '.join(missing)}")
    if extra := sorted(set(data) - {*needed, *optional}):
        _fail(at, f"unknown {', '.join(extra)}")
    return data


def _text(value: Any, at: str) -> str:
    if not isinstance(value, str) or not value:
        _fail(at, "a non-empty string is expected")
    return value


def _choice(value: Any, among: tuple[str, ...], at: str) -> str:
    if value not in among:
        _fail(at, f"{value!r} is none of {', '.join(among)}")
    return value


def _identifier(value: Any, at: str) -> str:
    if not isinstance(value, str) or not NAME.match(value):
        _fail(at, f"{value!r} is not an identifier")
    return value


def parse_value(data: Any, at: str) -> Value:
    data = _keys(data, at, (), ("literal", "compound"))
    literal, compound = data.get("literal"), data.get("compound")
    if (literal is None) == (compound is None):
        _fail(at, "either a literal or a compound")
    if compound is not None:
        return Value(compound=_identifier(compound, at))
    if not isinstance(literal, (bool, int, float, str)):
        _fail(at, "a literal is a boolean, a number or a string")
    return Value(literal=literal)


def parse_node(data: Any, at: str = "where", chemistry=None) -> Node:
    """``chemistry`` may check or rewrite patterns: see functions.chem."""
    if not isinstance(data, dict) or "op" not in data:
        _fail(at, "a predicate is an object with 'op'")
    op = data["op"]
    here = f"{at}.{op}"
    if op in ("and", "or"):
        clauses = _keys(data, here, ("op", "clauses"))["clauses"]
        if not isinstance(clauses, list) or not clauses:
            _fail(here, "at least one clause")
        return Node(op, tuple(parse_node(c, f"{here}[{i}]", chemistry) for i, c in enumerate(clauses)))
    if op == "not":
        return Node(op, (parse_node(_keys(data, here, ("op", "clause"))["clause"], here, chemistry),))
    if op in ("exists", "forall"):
        _keys(data, here, ("op", "path", "where"))
        return Node(op, (parse_node(data["where"], here, chemistry),), _text(data["path"], here))
    if op in ("is_null", "not_null"):
        return Node(op, path=_text(_keys(data, here, ("op", "path"))["path"], here))
    if op in (*EQUAL, *ORDERED, *TEXT):
        _keys(data, here, ("op", "path", "value"))
        return Node(op, path=_text(data["path"], here), value=parse_value(data["value"], here))
    if op in STRUCTURE:
        return _structure(data, op, here, chemistry)
    _fail(at, f"unknown op {op!r}")


def _structure(data: dict, op: str, at: str, chemistry) -> Node:
    own = "smarts" if op == "substructure" else "smiles"
    _keys(data, at, ("op", "path", *(("threshold",) if op == "similarity" else ())), (own, "compound"))
    pattern, compound = data.get(own), data.get("compound")
    if (pattern is None) == (compound is None):
        _fail(at, f"either {own} or compound")
    if compound is not None:
        _identifier(compound, at)
    threshold = data.get("threshold")
    if op == "similarity" and (isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 < threshold <= 1):
        _fail(at, "a threshold lies above 0 and is at most 1")
    if pattern is not None:
        _text(pattern, at)
        if chemistry is not None:
            pattern = chemistry.check_pattern(pattern) if op == "substructure" else chemistry.check_molecule(pattern)
    return Node(op, path=_text(data["path"], at), pattern=pattern, compound=compound, threshold=threshold)


def _scalar_or_reduction(data: Any, at: str) -> str | Reduction:
    if isinstance(data, dict):
        _keys(data, at, ("reduce", "path"))
        return Reduction(_choice(data["reduce"], REDUCERS, at), _text(data["path"], at))
    return _text(data, at)


def parse_query(data: dict | str | Query, chemistry=None) -> Query:
    if isinstance(data, Query):
        return data
    data = json.loads(data) if isinstance(data, str) else data
    _keys(data, "", (), ("where", "aggregate", "order_by", "limit"))
    aggregate = None
    if data.get("aggregate") is not None:
        raw = _keys(data["aggregate"], "aggregate", ("measures",), ("group_by",))
        measures = []
        for i, m in enumerate(raw["measures"]):
            at = f"aggregate.measures[{i}]"
            _keys(m, at, ("fn", "name"), ("path",))
            fn, path = _choice(m["fn"], AGGREGATES, at), m.get("path")
            if path is None and fn != "count":
                _fail(at, f"{fn} needs a path")
            measures.append(Measure(fn, _identifier(m["name"], at), None if path is None else _scalar_or_reduction(path, at)))
        if not measures:
            _fail("aggregate", "at least one measure")
        aggregate = Aggregate(tuple(measures), tuple(_text(g, "aggregate.group_by") for g in raw.get("group_by", [])))
    order = []
    for i, o in enumerate(data.get("order_by") or []):
        _keys(o, f"order_by[{i}]", ("key",), ("descending",))
        order.append(Order(_scalar_or_reduction(o["key"], f"order_by[{i}]"), bool(o.get("descending", False))))
    limit = data.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        _fail("limit", "a positive integer is expected")
    where = None if data.get("where") is None else parse_node(data["where"], "where", chemistry)
    return Query(where, aggregate, tuple(order), limit)


def compounds(query: Query) -> list[str]:
    """Names to be resolved, in the order of their first use."""
    found: list[str] = []

    def walk(node: Node) -> None:
        for name in (node.compound, node.value.compound if node.value else None):
            if name is not None and name not in found:
                found.append(name)
        for c in node.clauses:
            walk(c)

    if query.where is not None:
        walk(query.where)
    return found
