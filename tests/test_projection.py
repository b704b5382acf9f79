import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestlake.errors import QueryError
from nestlake.operators import structures as st
from nestlake.operators.projection import dense, projected
from nestlake.plans import questions as q
from nestlake.plans.sqlcheck import validate
from nestlake.scripts import derive

SCHEMA = """record_id string, temperature struct<value:double,precision:double,units:string>,
inputs map<string,struct<components:array<struct<identifiers:array<struct<type:string,value:string>>, amount:struct<mass:struct<value:double,precision:double,units:string>>>>>>,
products array<struct<identifiers:array<struct<type:string,value:string>>, good:boolean>>"""
KNOWN = {"temperature": "temperature", "mass": "mass"}
ROWS = [
    ("r1", (25.0, 1.0, "CELSIUS"), {"a": ([([("NAME", "water"), ("SMILES", "O")], ((5.0, None, "MILLIGRAM"),))],)}, [([("SMILES", "CC"), ("CXSMILES", "CC |x|")], True), ([("NAME", "tar")], None)]),
    ("r2", None, {}, []),
    ("r3", (300.0, None, "KELVIN"), {"a": ([([("SMILES", "O")], None)],)}, None),
]


def test_projection(spark):
    got = {r.record_id: r for r in projected(spark.createDataFrame(ROWS, SCHEMA), KNOWN).collect()}
    assert (got["r1"].temperature_kelvin, got["r1"].temperature_precision_kelvin, got["r3"].temperature_kelvin) == (298.15, 1.0, 300.0)
    water = got["r1"].inputs["a"].components[0]
    assert water.smiles == "O" and [i.value for i in water.identifiers] == ["water"] and water.amount.mass_grams == pytest.approx(0.005)
    assert [p.smiles for p in got["r1"].products] == ["CC |x|", None] and got["r1"].products[0].identifiers is None and got["r1"].products[1].identifiers[0].value == "tar"
    assert got["r2"].inputs is None and got["r2"].products is None and got["r3"].inputs["a"].components[0].structure_id == water.structure_id


def test_dimension_from_enum_metadata(spark):
    units = T.StructField("units", T.StringType(), True, {"enum": ["UNSPECIFIED", "HOUR", "SECOND"]})
    kind = T.StructType([T.StructField("wait", T.StructType([T.StructField("value", T.DoubleType()), T.StructField("precision", T.DoubleType()), units]))])
    assert projected(spark.createDataFrame([((2.0, None, "HOUR"),)], kind)).first().wait_seconds == 7200


def test_dense_numbers(spark):
    table, dictionary = dense(projected(spark.createDataFrame(ROWS, SCHEMA), KNOWN), "record_id")
    assert {tuple(r) for r in dictionary.collect()} == {("CC |x|", 0), ("O", 1)}
    assert st.check_pairs(st.pairs(table)) == 2
    assert table.filter("record_id = 'r3'").select(F.col("inputs")["a"]["components"][0]["structure_id"]).first()[0] == 1


def test_derive_script(spark, tmp_path, capsys):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "src" / "a"))
    assert derive.main(["projection", str(tmp_path / "src" / "*"), str(tmp_path / "p"), "--id", "record_id"]) == 0
    assert derive.main(["pivot", str(tmp_path / "p" / "*"), str(tmp_path / "v"), "--level", "products"]) == 0
    assert capsys.readouterr().out.splitlines() == ["written 1, skipped 0, ignored 0"] * 2
    assert spark.read.parquet(str(tmp_path / "v" / "a")).count() == 2


def test_sql_validation(spark):
    kind = spark.createDataFrame([], "id string, xs array<struct<v:int>>").schema
    assert validate(spark, "SELECT id FROM records WHERE exists(xs, e -> e.v > 1)", kind).fieldNames() == ["id"]
    assert validate(spark, "WITH a AS (SELECT id FROM records) SELECT count(*) AS n FROM a WHERE id = :x", kind, parameters={"x": "1"}).fieldNames() == ["n"]
    for bad in (
        "DROP TABLE records", "SELECT nope FROM records", "SELECT id FROM other", "SELECT id FROM records; SELECT 1", "SELECT explode(xs) FROM records", "SELEC",
        "SELECT * FROM parquet.`/tmp`", "SELECT java_method('a', 'b') FROM records", "CREATE TABLE t AS SELECT 1", "INSERT INTO records SELECT * FROM records", "SET a=1",
    ):
        with pytest.raises(QueryError):
            validate(spark, bad, kind)


def test_questions(spark):
    good = {"where": {"op": "eq", "path": "id", "value": {"literal": "a"}}}
    tries = iter([{"where": {"op": "huh"}}, {"where": json.dumps(good["where"])}])
    assert q.translate("?", "", lambda *a: next(tries)).where.op == "eq"
    with pytest.raises(QueryError):
        q.translate("?", "", lambda *a: {"nope": 1})
    with pytest.raises(q.CannotAnswer):
        q.translate("?", "", lambda *a: None)
    a, b = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("2",), ("3",)], "id string")
    assert q.score(a, b, "id") == q.Score(1, 1) and q.score(a, a, "id").exact
