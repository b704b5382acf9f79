"""Structure search over small corpora: every route, offsets, integrity, caches, timeouts."""

import pytest
from pyspark.sql import functions as F

from nestlake.errors import ArtifactError
from nestlake.functions.chem import TextChemistry
from nestlake.operators import structures as st
from nestlake.operators.pivot import pivot, structure_paths
from nestlake.plans.corpus import Corpus, timed
from nestlake.queries import both, leaf, negate, some

CHEM = TextChemistry()
SCHEMA = """rid string, inputs array<struct<components:array<struct<smiles:string, structure_id:long, reaction_role:string, grams:double>>>>,
products array<struct<smiles:string, structure_id:long, standard:struct<smiles:string, structure_id:long>>>"""


def record(rid, components, product=None, standard=None):
    return {
        "rid": rid,
        "inputs": [{"components": [{"smiles": s, "reaction_role": r, "grams": 1.0} for s, r in components]}] if components else None,
        "products": [{"smiles": product, "standard": {"smiles": standard} if standard else None}] if product else None,
    }


DATA = {
    "a": [record("a1", [("pyridine", "SOLVENT"), ("benzene", "REACTANT")], "toluene"), record("a2", [("pyridine", "REACTANT")], "toluene", "ethanol.salt")],
    "b": [record("b1", [("ethanol", "REACTANT")], "toluene"), record("b2", None)],
}


def numbered(spark, rows):
    """Dense ids in first-seen order, put where the smiles are."""
    ids = {}
    put = lambda s: None if s is None or s.get("smiles") is None else s | {"structure_id": ids.setdefault(s["smiles"], len(ids))}
    out = []
    for r in rows:
        inputs = r["inputs"] and [{"components": [put(c) for c in i["components"]]} for i in r["inputs"]]
        products = r["products"] and [put(p) | {"standard": put(p["standard"])} for p in r["products"]]
        out.append(r | {"inputs": inputs, "products": products})
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    parts = [numbered(spark, rows) for rows in DATA.values()]
    return Corpus([(p, st.structures(p, CHEM)) for p in parts], "rid", CHEM, {"pyr": "pyridine"}.__getitem__)


def sub(pattern):
    return {"op": "substructure", "path": "smiles", "smarts": pattern}


def ids(df):
    return {r[0] for r in df.collect()}


TAKEN = {
    "contains": (some("inputs.components", sub("idin")), {"a1", "a2"}),
    "with role": (some("inputs.components", both(sub("idin"), leaf("eq", "reaction_role", "SOLVENT"))), {"a1"}),
    "second dataset": (some("inputs.components", sub("ethanol")), {"b1"}),
    "similar": (some("inputs.components", {"op": "similarity", "path": "smiles", "smiles": "benzenes", "threshold": 0.6}), {"a1"}),
    "same": (some("inputs.components", {"op": "same_compound", "path": "smiles", "smiles": " Ethanol"}), {"b1"}),
    "compound": (some("inputs.components", {"op": "same_compound", "path": "smiles", "compound": "pyr"}), {"a1", "a2"}),
    "standard": (some("products", {"op": "same_parent", "path": "standard.smiles", "smiles": "ethanol"}), {"a2"}),
}
DECLINED = {
    "extra leaf": (some("inputs.components", both(sub("idin"), leaf("gt", "grams", 0))), {"a1", "a2"}),
    "negated": (some("inputs.components", negate(sub("idin"))), {"a1", "b1"}),
    "none contains": (negate(some("inputs.components", sub("idin"))), {"b1", "b2"}),
}


@pytest.mark.parametrize("route", ["elements", "pivot", "auto"])
@pytest.mark.parametrize("name", [*TAKEN, *DECLINED])
def test_routes_agree(corpus, name, route):
    where, want = (TAKEN | DECLINED)[name]
    assert ids(corpus.compile({"where": where}, route)) == want


@pytest.mark.parametrize("name", ["contains", "with role", "second dataset", "similar", "same", "compound"])
def test_index_takes(corpus, name):
    where, want = TAKEN[name]
    assert ids(corpus.compile({"where": where}, "index")) == want
    assert corpus.last_routes == [("inputs.components", "index")]


@pytest.mark.parametrize("name", ["extra leaf", "negated"])
def test_index_declines(corpus, name):
    corpus.compile({"where": DECLINED[name][0]}, "index")
    assert corpus.last_routes[-1][1] == "elements"


def test_search_returns_arrow_and_repeats_from_the_cache(corpus):
    query = {"where": TAKEN["contains"][0], "order_by": [{"key": "rid"}]}
    assert corpus.search(query).column("rid").to_pylist() == ["a1", "a2"]
    before = len(corpus._matches)
    assert corpus.search(query).num_rows == 2 and len(corpus._matches) == before


def test_checks(corpus, spark):
    assert corpus.check_index() == {"inputs.components": 4, "products": 3, "products.standard": 1}
    corpus.add_pivot("products", pivot(corpus.records, "products", "rid", "_structure_offset"))
    assert corpus.check_pivots() == {"products": 3}
    assert structure_paths(corpus.records.schema) == ["inputs.components", "products", "products.standard"]
    part = numbered(spark, DATA["a"])
    with pytest.raises(ArtifactError, match="refers to structure"):
        Corpus([(part, st.structures(part, CHEM).filter("structure_id < 2"))], "rid", CHEM)
    with pytest.raises(ArtifactError, match="duplicate"):
        Corpus([(part.unionByName(part), st.structures(part, CHEM))], "rid", CHEM).occurrences()


def test_pair_integrity(spark):
    bad = {"an id stands": [(0, "a"), (0, "b")], "several ids": [(0, "a"), (1, "a")], "ids run": [(1, "a"), (2, "b")], "without a structure": [(0, None)]}
    for why, rows in bad.items():
        with pytest.raises(ArtifactError, match=why):
            st.check_pairs(spark.createDataFrame(rows, "structure_id long, smiles string"))
    assert st.check_pairs(spark.createDataFrame([(0, "a"), (1, "b")], "structure_id long, smiles string")) == 2


def test_first_seen_ids(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x"), (4, None)], "at long, v string")
    assert {tuple(r) for r in st.first_seen_ids(df, "v", ["at"]).collect()} == {("y", 0), ("x", 1)}


def test_timeout(spark):
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    with pytest.raises(TimeoutError):
        timed(spark, spark.range(1).select(slow("id")).collect, 2.0)
    assert timed(spark, lambda: 5, 1.0) == 5


def test_first_seen_ids_over_many_ranges(spark):
    from nestlake.operators.structures import first_seen_ids

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values = [f"v{(k * 7919) % 997}" for k in range(5000)]
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(-1, None)], "at long, v string").repartition(7)
        found = first_seen_ids(df, "v", ["at"])
        assert {r.v: r.structure_id for r in found.collect()} == {v: i for i, v in enumerate(dict.fromkeys(values))}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
