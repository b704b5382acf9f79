"""Freight with legs, crates and readings: every route must agree with a plain-Python evaluation of the query.

Rows are drawn at random, with every level absent, empty, null or filled, and a few are
written by hand for what chance may miss.
"""

import random

import pytest
from pyspark.sql import functions as F

from nestlake.errors import QueryError
from nestlake.operators.pivot import pivot
from nestlake.plans.compiler import Compiler, compile_query
from nestlake.plans.grammar import Reduction, parse_query
from nestlake.queries import InlinePivots, both, either, every, leaf, negate, some
from nestlake.schema import describe, levels, resolve, singular

SCHEMA = """rid string, note string, climate struct<kelvin:double>, ratio float, tags array<string>,
legs array<struct<hours:double, crates:array<struct<label:string, sealed:boolean,
  probes:array<struct<kind:string, reading:struct<value:float>>>>>>>,
docks map<string,struct<pallets:array<struct<name:string, kilos:double>>>>"""


def drawn(rng, depth):
    """A list at a level: absent, empty or filled."""
    n = rng.choice([None, 0, 1, 2, 3])
    return None if n is None else [depth(rng) for _ in range(n)]


def probe(rng):
    return {"kind": rng.choice(["heat", "damp", None]), "reading": rng.choice([None, {"value": None}, {"value": float(rng.randrange(8))}])}


def crate(rng):
    return {"label": rng.choice(["fish", "moss", "tin", None]), "sealed": rng.choice([True, False, None]), "probes": drawn(rng, probe)}


def leg(rng):
    return {"hours": rng.choice([None, 1.0, 4.0]), "crates": drawn(rng, crate)}


def freight(rng, k):
    docks = rng.choice([None, {}, {"north": None}, {"north": {"pallets": drawn(rng, lambda r: {"name": "p", "kilos": r.choice([None, 1.0, 2.5])})}, "south": {"pallets": None}}])
    return {"rid": f"r{k:03}", "note": rng.choice([None, "x"]), "climate": rng.choice([None, {"kelvin": None}, {"kelvin": 200.0 + k}]), "ratio": rng.choice([None, 0.1, 0.5]), "legs": drawn(rng, leg), "docks": docks}


def by_hand(rid, *legs):
    return {"rid": rid, "legs": [{"crates": [{"label": label, "sealed": sealed, "probes": probes and [{"kind": k, "reading": {"value": float(v)}} for k, v in probes]} for label, sealed, probes in crates]} for crates in legs]}


ROWS = [freight(random.Random(k), k) for k in range(150)] + [
    by_hand("last", [("moss", None, None)] * 5, [("tin", True, [("damp", 1)] * 4 + [("heat", 7)])]),  # only the last element of the last level fits
    by_hand("apart", [("tin", True, [("heat", 1)]), ("moss", False, [("heat", 7)])]),  # what a crate lacks its sibling has
    by_hand("far", [("tin", True, None)], [("fish", False, [("heat", 7)])]),  # and here a crate of another leg
]
TIN, HOT = leaf("eq", "label", "tin"), both(leaf("eq", "kind", "heat"), leaf("gt", "reading.value", 2))
SEALED = leaf("eq", "sealed", True)
CASES = {
    "some": some("legs.crates", TIN),
    "every": every("legs.crates", TIN),
    "none": negate(some("legs.crates", TIN)),
    "not every": negate(every("legs.crates", TIN)),
    "one crate": some("legs.crates", both(TIN, SEALED)),
    "two crates": both(some("legs.crates", TIN), some("legs.crates", SEALED)),
    "other": some("legs.crates", leaf("ne", "label", "tin")),
    "either": either(some("legs.crates", TIN), leaf("eq", "note", "x")),
    "probe of its crate": some("legs.crates", both(SEALED, some("probes", HOT))),
    "probe of its leg": some("legs", both(leaf("ge", "hours", 2), some("crates.probes", HOT))),
    "probe anywhere": some("legs.crates.probes", HOT),
    "every probe": every("legs.crates.probes", leaf("eq", "kind", "heat")),
    "crates without probes": some("legs.crates", negate(some("probes", {"op": "not_null", "path": "kind"}))),
    "legs of labelled crates": every("legs", some("crates", {"op": "not_null", "path": "label"})),
    "every of every": every("legs", every("crates", every("probes", HOT))),
    "through a map": some("docks", some("pallets", leaf("ge", "kilos", 2))),
    "path through a map": some("docks.pallets", leaf("ge", "kilos", 2)),
}


def reached(value, path):
    """Elements under a path of fields: lists and maps open, nulls end."""
    for name in path.split("."):
        value = [x[name] for x in value if x is not None and x.get(name) is not None]
        value = [y for x in value for y in (x if isinstance(x, list) else x.values() if name == "docks" else [x])]
    return value


def holds(node, x):
    """True, False or None, as SQL has it; a quantifier asks only for what is certainly true or false."""
    op = node["op"]
    if op in ("exists", "forall"):
        found = [holds(node["where"], y) for y in reached([x], node["path"])]
        return True in found if op == "exists" else False not in found
    if op == "not":
        inner = holds(node["clause"], x)
        return None if inner is None else not inner
    if op in ("and", "or"):
        found = [holds(c, x) for c in node["clauses"]]
        return (op == "or") if (op == "or") in found else None if None in found else op == "and"
    value = (reached([x], node["path"]) or [None])[0]
    if op == "not_null":
        return value is not None
    other = node["value"]["literal"]
    return None if value is None else {"eq": value == other, "ne": value != other, "gt": op == "gt" and value > other, "ge": op == "ge" and value >= other}[op]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df):
    return {r[0] for r in df.collect()}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("route", ["elements", "pivot"])
def test_routes_agree(wide, name, route):
    want = {r["rid"] for r in ROWS if holds(CASES[name], {**dict.fromkeys(("note", "climate", "ratio", "docks")), **r})}
    assert ids(compile_query({"where": CASES[name]}, wide, "rid", InlinePivots(wide, "rid"), route)) == want and 0 < len(want) < len(ROWS)


def test_bindings_differ(wide):
    got = {name: ids(compile_query({"where": CASES[name]}, wide, "rid")) for name in ("one crate", "two crates", "probe of its crate", "probe anywhere")}
    assert "far" in got["probe anywhere"] - got["probe of its crate"] and "apart" in got["probe anywhere"] - got["probe of its crate"] and "last" in got["probe of its crate"]
    assert got["one crate"] < got["two crates"]


def test_routes_taken(wide):
    c = Compiler(wide, "rid", InlinePivots(wide, "rid"), "pivot")
    c.run({"where": CASES["probe of its crate"]})
    assert c.routes == [("legs.crates", "pivot"), ("legs.crates.probes", "pivot")]
    c = Compiler(wide, "rid", InlinePivots(wide, "rid"), "pivot")
    c.run({"where": CASES["probe of its leg"]})
    assert c.routes[0] == ("legs", "pivot")


def test_pivot_ordinals(wide):
    got = {tuple(r) for r in pivot(wide, "legs.crates", "rid").select("rid", "leg_index", "crate_index", "element.label").collect()}
    assert got == {(r["rid"], i, j, c["label"]) for r in ROWS for i, x in enumerate(r.get("legs") or [], 1) for j, c in enumerate(x["crates"] or [], 1)}


@pytest.mark.parametrize("how", ["max", "min", "avg", "sum", "count"])
def test_reductions(wide, how):
    want = {}
    for r in ROWS:
        values = reached([r], "legs.crates.probes.reading.value") if r.get("legs") is not None else []
        if how == "count":
            want[r["rid"]] = len(values)
        elif values:
            want[r["rid"]] = {"max": max(values), "min": min(values), "sum": sum(values), "avg": sum(values) / len(values)}[how]
    value = Compiler(wide, "rid").reduction(Reduction(how, "legs.crates.probes.reading.value"))
    got = {r[0]: r[1] for r in wide.select("rid", value).collect() if r[1] is not None}
    assert {k: v for k, v in got.items() if v or k in want} == pytest.approx({k: v for k, v in want.items() if k in got}) and all(k in got for k, v in want.items() if v)


def test_order_puts_nulls_last(wide):
    known = sorted((r["climate"]["kelvin"], r["rid"]) for r in ROWS if r.get("climate") and r["climate"]["kelvin"])
    rest = sorted({r["rid"] for r in ROWS} - {i for _, i in known})
    for down in (False, True):
        got = [r[0] for r in compile_query({"order_by": [{"key": "climate.kelvin", "descending": down}, {"key": "rid"}], "limit": len(known) + 2}, wide, "rid").collect()]
        assert got == [i for _, i in sorted(known, reverse=down)] + rest[:2]


def test_float_literal_takes_the_leafs_type(wide):
    assert ids(compile_query({"where": leaf("eq", "ratio", 0.1)}, wide, "rid")) == {r["rid"] for r in ROWS if r.get("ratio") == 0.1}


def test_null_comparison_drops_the_row_both_ways(wide):
    known = {r["rid"] for r in ROWS if r.get("climate") and r["climate"]["kelvin"]}
    assert ids(compile_query({"where": negate(leaf("gt", "climate.kelvin", 400))}, wide, "rid")) == known
    assert ids(compile_query({"where": {"op": "is_null", "path": "climate"}}, wide, "rid")) == {r["rid"] for r in ROWS if r.get("climate") is None}


def test_aggregate_over_reduction(wide):
    q = {"aggregate": {"group_by": ["note"], "measures": [{"fn": "count", "name": "n"}, {"fn": "max", "name": "best", "path": {"reduce": "max", "path": "legs.crates.probes.reading.value"}}]}}
    groups = {}
    for r in ROWS:
        groups.setdefault(r.get("note"), []).append(max(reached([r], "legs.crates.probes.reading.value"), default=0))
    assert {tuple(r) for r in compile_query(q, wide, "rid").collect()} == {(k, len(v), max(v)) for k, v in groups.items()}


@pytest.mark.parametrize("down", [False, True])
def test_order_by_a_measure_or_a_group(wide, down):
    q = {"aggregate": {"group_by": ["ratio"], "measures": [{"fn": "sum", "name": "s", "path": "climate.kelvin"}, {"fn": "avg", "name": "a", "path": "climate.kelvin"}]}, "order_by": [{"key": "a", "descending": down}]}
    values = {}
    for r in ROWS:
        values.setdefault(r.get("ratio"), []).append((r.get("climate") or {}).get("kelvin"))
    values = {k: [v for v in vs if v is not None] for k, vs in values.items()}
    want = sorted(((sum(v) / len(v), sum(v)) for v in values.values()), reverse=down)
    assert [x for r in compile_query(q, wide, "rid").collect() for x in (r["a"], r["s"])] == pytest.approx([x for pair in want for x in pair])
    q["order_by"] = [{"key": "ratio", "descending": down}]
    assert [r[0] for r in compile_query(q, wide, "rid").collect()][:2] == pytest.approx(sorted([0.1, 0.5], reverse=down))


REFUSED = [
    ({"where": leaf("eq", "legs.crates.label", "tin")}, "repeated"),
    ({"where": leaf("eq", "nota", "tin")}, "did you mean note"),
    ({"where": leaf("gt", "note", 3)}, "compares numbers"),
    ({"where": leaf("contains", "ratio", "3")}, "compares text"),
    ({"where": leaf("eq", "note", 3)}, "cannot be compared"),
    ({"where": some("climate", leaf("gt", "kelvin", 1))}, "not repeated"),
    ({"where": some("tags", leaf("eq", "x", "y"))}, "repeats no struct"),
    ({"order_by": [{"key": {"reduce": "max", "path": "legs.crates.label"}}]}, "needs numbers"),
    ({"order_by": [{"key": {"reduce": "max", "path": "climate.kelvin"}}]}, "nothing to reduce"),
    ({"aggregate": {"group_by": ["legs.crates.label"], "measures": [{"fn": "count", "name": "n"}]}}, "repeated"),
    ({"aggregate": {"measures": [{"fn": "count", "name": "n"}]}, "order_by": [{"key": "note"}]}, "measures and groups"),
    ({"where": {"op": "eq", "path": "note", "value": {"compound": "water"}}}, "not bound"),
    ({"where": {"op": "similarity", "path": "note", "smiles": "C", "threshold": 0.5}}, "smiles"),
]


@pytest.mark.parametrize(("query", "why"), REFUSED)
def test_refusals(wide, query, why):
    with pytest.raises(QueryError, match=why):
        compile_query(query, wide, "rid")


@pytest.mark.parametrize(
    "query",
    [
        {"where": {"op": "xor", "clauses": []}}, {"where": {"op": "and", "clauses": []}}, {"where": {"op": "eq", "path": "a", "value": {}}}, {"limit": 0}, {"limit": True},
        {"where": {"op": "eq", "path": "a", "value": {"literal": 1, "compound": "b"}}}, {"where": {"op": "eq", "path": "a", "value": {"compound": "1; drop"}}},
        {"aggregate": {"measures": []}}, {"aggregate": {"measures": [{"fn": "sum", "name": "x"}]}}, {"aggregate": {"measures": [{"fn": "median", "name": "x", "path": "a"}]}}, {"select": []},
        {"where": {"op": "similarity", "path": "a", "smiles": "C", "threshold": 1.5}}, {"where": {"op": "substructure", "path": "a"}}, {"order_by": [{"descending": True}]},
    ],
)
def test_grammar_refusals(query):
    with pytest.raises(QueryError):
        parse_query(query)


def test_schema_walk(wide):
    assert [x.path for x in levels(wide.schema)] == ["legs", "legs.crates", "legs.crates.probes", "docks", "docks.pallets"]
    assert levels(wide.schema)[2].ordinals == ("leg_index", "crate_index", "probe_index")
    assert resolve("docks.pallets.kilos", wide.schema).repeated
    assert [singular(x) for x in ("crates", "analyses", "identities", "mass", "boxes")] == ["crate", "analysis", "identity", "mass", "box"]
    text = describe(wide.schema)
    assert "legs: LIST<STRUCT>" in text and "docks: MAP<VARCHAR, STRUCT>" in text and "      probes: LIST<STRUCT>" not in text.split("crates")[0]


def test_scan_reads_only_the_leaves_of_the_body(spark, wide, tmp_path):
    wide.select("rid", F.col("legs").alias("legs")).write.parquet(str(tmp_path / "w"))
    df = spark.read.parquet(str(tmp_path / "w"))
    plan = compile_query({"where": some("legs", leaf("gt", "hours", 1))}, df, "rid")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "hours" in schema and "label" not in schema
