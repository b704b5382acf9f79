"""Sources, artifacts, rules, templates, updates, relational form, tables, streaming."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nestlake.errors import ArtifactError
from nestlake.operators import relational, rules, tables, templates, updates
from nestlake.plans import artifacts as art
from nestlake.sources import dataset as ds
from nestlake.sources import readers
from nestlake.streaming.incremental import derive_stream

ROWS = [(f"r{i}", f"blob{i}".encode()) for i in range(7)]
META = ds.Scalars("name", "words", "d1")


@pytest.fixture
def source(tmp_path):
    path = str(tmp_path / "s.parquet")
    ds.save(path, META, ROWS, row_group=3)
    return path


def test_dataset(spark, source):
    data = ds.Dataset(spark, source)
    assert (len(data), data.groups, data.scalars, bool(data)) == (7, [3, 3, 1], META, True)
    assert data.get("r4") == b"blob4" and data[0] == b"blob0" and data[-1] == b"blob6"
    assert data[1:6:2] == [b"blob1", b"blob3", b"blob5"] and data[5:1:-2] == [b"blob5", b"blob3"] and data[3:3] == []
    assert {r[0] for r in data.rows(["r1", "zzz"]).collect()} == {"r1"} and data.rows(row_group=1).count() == 3
    assert data.rows(spark.createDataFrame([("r2",), ("r2",)], "record_id string")).count() == 1
    for bad, error in ((lambda: data.rows([]), ValueError), (lambda: data.rows(row_group=3), IndexError), (lambda: data[7], IndexError), (lambda: data["x"], TypeError), (lambda: data.get("q"), KeyError)):
        with pytest.raises(error):
            bad()
    assert "position" in data.frame.columns and data.ids().columns == ["record_id"]


def test_hash_ignores_row_groups_and_compression(spark, source, tmp_path):
    other = str(tmp_path / "t.parquet")
    ds.save(other, META, ROWS, row_group=100, compression="snappy")
    third = str(tmp_path / "u.parquet")
    ds.save(third, META, list(reversed(ROWS)))
    one, two, three = (ds.Dataset(spark, p).md5() for p in (source, other, third))
    assert one == two != three


def test_first_of_repeated_ids_wins(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    ds.save(path, META, [("a", b"1"), ("a", b"2")])
    assert ds.Dataset(spark, path).get("a") == b"1"


def test_writer_is_atomic_and_refuses_nothing(tmp_path):
    path = str(tmp_path / "x.parquet")
    with pytest.raises(RuntimeError), ds.Writer(path, META) as out:
        out.write("a", b"1")
        raise RuntimeError
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError):
        ds.save(path, META, [])
    with pytest.raises(ValueError):
        ds.Writer(path, ds.Scalars("", "x"))
    with pytest.raises(ValueError):
        ds.read_scalars({b"dataset.schema_version": b"2"}, ds.Layout())


def test_decode_concatenate_and_footers(spark, source, tmp_path):
    data = ds.Dataset(spark, source)
    out = ds.decoded(data.rows(), lambda b: {"n": int(b[4:]), "t": b.decode()}, "n long, t string")
    assert {tuple(r) for r in out.collect()} == {(i, f"blob{i}") for i in range(7)}
    assert ds.concatenated(spark, [source, source]).count() == 14
    pq.write_table(pa.table({"k": [3, 9, 1]}), str(tmp_path / "k.parquet"))
    assert ds.footer_maximum(str(tmp_path / "k.parquet"), "k") == 9
    assert ds.shard_path("set-abcd.parquet") == "data/ab/set-abcd.parquet"
    for bad in ("../x", "a/b", ""):
        with pytest.raises(ValueError):
            ds.shard_path(bad)


def test_messages(tmp_path):
    from google.protobuf import descriptor_pb2, struct_pb2, timestamp_pb2

    from nestlake.sources import messages as ms

    value = timestamp_pb2.Timestamp(seconds=5)
    for name in ("a.pb", "a.pbtxt", "a.json", "a.binpb.gz"):
        path = str(tmp_path / name)
        ms.save_message(value, path)
        assert ms.load_message(path, timestamp_pb2.Timestamp) == value
    first = open(str(tmp_path / "a.binpb.gz"), "rb").read()
    ms.save_message(value, str(tmp_path / "a.binpb.gz"))
    assert open(str(tmp_path / "a.binpb.gz"), "rb").read() == first
    with pytest.raises(ValueError):
        ms.save_message(value, str(tmp_path / "a.parquet"))
    with pytest.raises(ValueError, match="contains itself"):
        ms.projected_schema(struct_pb2.Struct.DESCRIPTOR)
    kind = ms.projected_schema(descriptor_pb2.EnumDescriptorProto.DESCRIPTOR.fields_by_name["reserved_range"].message_type)
    assert kind.fieldNames() == ["start", "end"]
    row = ms.project(descriptor_pb2.FieldDescriptorProto(name="n", label="LABEL_OPTIONAL"))
    assert row["name"] == "n" and row["label"] == "LABEL_OPTIONAL" and row["number"] is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    (tmp_path / "a.xml").write_text("<all><row><v>1</v></row><row><v>2</v></row></all>")
    (tmp_path / "a.jsonl").write_text('{"z": 1}\n')
    assert readers.read_any(spark, str(tmp_path / "a.csv")).first().asDict() == {"x": 1, "y": "b"}
    assert {r[0] for r in readers.read_xml(spark, str(tmp_path / "a.xml"), "row").collect()} == {1, 2}
    assert readers.read_any(spark, str(tmp_path / "a.jsonl")).first()[0] == 1
    assert readers.read_binary(spark, str(tmp_path / "a.csv")).first()["length"] == 8


def test_artifacts(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3 if name == "a" else 4).write.parquet(str(tmp_path / "in" / name))
    run = lambda **k: art.derive_tree(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), "double", "1", lambda df: df.selectExpr("id", "id * 2 AS twice"), **k)
    written, skipped, ignored = run()
    assert (len(written), skipped, ignored) == (2, [], [])
    assert len(run()[1]) == 2 and len(run(force=True)[0]) == 2 and len(run(columns={"id", "more"})[0]) == 2
    again = art.derive_tree(spark, str(tmp_path / "out" / "*"), str(tmp_path / "third"), "sum", "1", lambda df: df.groupBy().sum(), parent="double")
    assert len(again[0]) == 2 and art.derive_tree(spark, str(tmp_path / "in" / "*"), str(tmp_path / "no"), "sum", "1", lambda df: df, parent="double")[2]
    pairs = art.paired(spark, art.glob(spark, str(tmp_path / "out" / "*")), art.glob(spark, str(tmp_path / "third" / "*")))
    assert len(pairs) == 2
    with pytest.raises(ArtifactError, match="without a partner"):
        art.paired(spark, [pairs[0][0]], [p for _, p in pairs])
    with pytest.raises(ArtifactError, match="no artifact and stays"):
        art.write_artifact(spark.range(1), str(tmp_path / "in" / "a"), art.Stamps("x", "1", "h"), overwrite=True)
    assert art.glob_root("/a/b/*/c") == "/a/b" and art.output_path("/a/b/x/c", "/a/b", "/o") == "/o/x/c"


def test_rules(spark):
    schema = "id string, kind string, details string, t double, u string, made string, seen string, items map<string,struct<pct:double, tags:array<struct<good:boolean>>>>"
    rows = [
        ("ok", "A", None, 20.0, "CELSIUS", "2020-01-01", "2020-01-02", {"k": (50.0, [(True,), (False,)])}),
        ("bad", "CUSTOM", "", -300.0, "CELSIUS", "2020-01-03", "2020-01-02", {"k": (0.5, [(True,), (True,)])}),
        ("none", None, None, None, None, None, None, None),
    ]
    own = [
        *rules.custom_needs_details("kind", "details"), rules.above_absolute_zero("t", "u"), rules.ordered("made", "seen"), rules.looks_like_fraction("pct", "items"),
        rules.at_most_one("tags", "good", "items"), rules.not_empty("items"), *rules.value_with_units("t", "u", signed=True), rules.present("id"), rules.readable_date("made"),
    ]
    got = {(r["id"], r["trace"], r["rule"]) for r in rules.violations(spark.createDataFrame(rows, schema), "id", own).collect()}
    assert got == {
        ("bad", "", "kind_details"), ("bad", "", "t_absolute_zero"), ("bad", "", "made_before_seen"), ("bad", 'items["k"]', "pct_fraction"), ("bad", 'items["k"]', "good_once"),
        ("none", "", "kind_specified"), ("none", "", "items_not_empty"),
    }


def test_templates(spark):
    from pyspark.sql import types as T

    kind = T._parse_datatype_string("inputs array<struct<components:array<struct<identifiers:array<struct<value:string>>, amount:struct<value:double>>>>>")
    text = json.dumps({"inputs": [{"components": [{"identifiers": [{"value": "$name$"}], "amount": {"value": "$g$"}}, {"identifiers": [{"value": "fixed"}], "amount": {"value": 1}}]}]}).replace('"$g$"', "$g$")
    table = spark.createDataFrame([('a"b\\', 2.0), (None, 3.0)], "`$name$` string, g double")
    rows = [r.inputs for r in templates.enumerated(text, table, kind).select(templates.without_blanks(F.col("inputs")).alias("inputs")).collect()]
    assert [len(r[0].components) for r in rows] == [2, 1] and rows[0][0].components[0].identifiers[0].value == 'a"b\\'
    with pytest.raises(ValueError):
        templates.columns_of("$missing$", table)
    made = spark.range(1).select(templates.solution(F.lit("salt"), F.lit("water"), F.lit(0.01), F.lit(0.5)).alias("s"), templates.rotovap().alias("w")).first()
    assert [(round(c.value, 6), c.units) for c in made.s] == [(5.0, "millimole"), (0.01, "liter")] and made.w.type == "CONCENTRATION"


def test_updates(spark, tmp_path):
    df = spark.createDataFrame([("x", ["x", "y", None]), ("y", None), ("z-" + "0" * 32, ["x"])], "id string, refs array<string>")
    ids = updates.id_map(df, "id", "z-", path=str(tmp_path / "ids"))
    names = {r.old_id: r.new_id for r in ids.collect()}
    assert set(names) == {"x", "y"} and names == {r.old_id: r.new_id for r in ids.collect()}
    got = {r.id: r.refs for r in updates.renamed(updates.rewritten(df, "id", "refs", ids), "id", ids).collect()}
    assert got == {names["x"]: [names["x"], names["y"], None], names["y"]: None, "z-" + "0" * 32: [names["x"]]}


def test_relational_round_trip(spark):
    schema = "id string, s struct<a:long, l:array<struct<v:long, w:array<struct<q:string>>>>>, m map<string,struct<n:long>>, tags array<string>"
    rows = [("1", (5, [(1, [("x",), ("y",)]), (2, None)]), {"k": (7,), "j": (8,)}, ["t"]), ("2", None, None, None), ("3", (None, [(3, None)]), None, [])]
    df = spark.createDataFrame(rows, schema)
    made = relational.decomposed(df, "id")
    assert set(made) == {"record", "record.s.l", "record.s.l.w", "record.m"} and made["record.s.l.w"].count() == 2
    key = lambda d: sorted(d.select("id", "s", F.map_entries("m").alias("m"), "tags").collect(), key=lambda r: r.id)
    got, want = key(relational.recomposed(made, df.schema).select(*df.columns)), key(df)
    for g, w in zip(got, want, strict=True):
        assert (g.id, g.s, g.tags) == (w.id, w.s, w.tags) and sorted(g.m or []) == sorted(w.m or [])


def test_tables(spark):
    df = spark.createDataFrame([("a", (1, [(2,), (None,)]), {"k": 3}), ("b", (1, None), None)], "id string, s struct<x:int, l:array<struct<y:int>>>, m map<string,int>")
    rows = tables.message_rows(df, "id")
    assert {tuple(r) for r in rows.collect()} == {("a", "s.x", "1"), ("a", "s.l[0].y", "2"), ("a", 'm["k"]', "3"), ("b", "s.x", "1")}
    assert {r["key"] for r in tables.varying_keys(rows, "id").collect()} == {"s.l[0].y", 'm["k"]'}
    assert tables.flattened(df).columns == ["id", "s.x", "s.l", "m"]
    old, new = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string")
    assert {(r.k, r._change) for r in tables.merged(old, new, ["k"]).collect()} == {(1, "delete"), (2, "keep"), (3, "update"), (4, "insert")}


def test_stream_derives_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    spark.range(5).write.parquet(src)
    make = lambda df: df.selectExpr("id", "id + 1 AS next")
    run = lambda: derive_stream(spark, src, spark.read.parquet(src).schema, out, check, "id", make).awaitTermination()
    run()
    spark.range(3, 8).write.mode("append").parquet(src)
    run()
    run()
    held = lambda: sorted(tuple(r) for r in spark.read.parquet(out).select("id", "next").collect())
    assert held() == [(i, i + 1) for i in range(8)]
    # A crash before the last batch was committed: the batch runs again and replaces its folder.
    for part in ("commits/1", "commits/.1.crc"):
        os.remove(os.path.join(check, part))
    run()
    assert held() == [(i, i + 1) for i in range(8)]


def test_set_identifier(spark):
    from nestlake.functions.identifiers import with_identifier

    rows = [([("NAME", "a"), ("SMILES", "b"), ("SMILES", "c")],), ([("NAME", "a")],), (None,)]
    df = spark.createDataFrame(rows, "ids array<struct<type:string,value:string>>")
    got = [[tuple(i) for i in r[0]] for r in df.select(with_identifier(F.col("ids"), "SMILES", F.lit("x"))).collect()]
    assert got == [[("NAME", "a"), ("SMILES", "x"), ("SMILES", "c")], [("NAME", "a"), ("SMILES", "x")], [("SMILES", "x")]]


def test_combined_warns_of_what_differs(spark, source, tmp_path):
    other, out = str(tmp_path / "o.parquet"), str(tmp_path / "all.parquet")
    ds.save(other, ds.Scalars("else", "words", "d1"), [("z", b"9")])
    with pytest.warns(UserWarning, match="name differs"):
        made = ds.combined(spark, [source, other], out, dataset_id="d2")
    assert made == ds.Scalars("name", "words", "d2") and ds.Dataset(spark, out)[-1] == b"9" and len(ds.Dataset(spark, out)) == 8
    with pytest.raises(ValueError):
        ds.combined(spark, [], out)


def test_shared_keys_are_refused(spark, tmp_path):
    from nestlake.operators import loading

    twice = spark.createDataFrame([("a", 1), ("a", 2)], "id string, n int")
    with pytest.raises(ArtifactError, match="share a key"):
        loading.load(spark, str(tmp_path / "w"), "d", twice, "id")
    assert loading.loaded(spark, str(tmp_path / "w")) == {} and loading.prune(spark, str(tmp_path / "w"))
    with pytest.raises(ArtifactError, match="not an id"):
        loading.load(spark, str(tmp_path / "w"), "../d", twice, "id")


def counting(df, seen):
    """``df``, with each evaluation of a row added to ``seen``."""

    def rows(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(rows, df.schema)


def test_load_evaluates_records_once(spark, tmp_path):
    from nestlake.operators import loading

    at, seen = str(tmp_path / "w"), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("a", 1, [(1.5,), None]), ("b", 2, None), (None, None, [])], "id string, n int, xs array<struct<v:double>>")
    first = loading.load(spark, at, "d", counting(df, seen), "id")
    assert (first.state, seen.value) == ("written", 3) and art.glob(spark, f"{at}/staged/*") == []
    assert loading.load(spark, at, "d", df, "id").state == loading.load(spark, at, "d", df, "id", stage=False).state == "skipped"
    assert sorted(map(tuple, loading.table(spark, at, "record").select("id", "n", "dataset_id").collect()), key=str) == [("a", 1, "d"), ("b", 2, "d"), (None, None, "d")]
    assert sorted(map(tuple, loading.table(spark, at, "record.xs").select("ordinal", "absent", "v").collect())) == [(0, False, 1.5), (1, True, None)]
    hollow = df.select("id", F.when(F.col("n") > 0, F.struct()).alias("nothing"))
    assert [loading.load(spark, at, "e", hollow, "id").state for _ in range(2)] == ["written", "skipped"]
    broken = df.withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    assert loading.load_all(spark, at, {"f": lambda: broken}, "id")[0].state == "failed" and art.glob(spark, f"{at}/staged/*") == []


def test_first_orders_are_those_of_all(spark):
    from nestlake import frames

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    want = frames.orders(spark, sf).filter("o_orderstatus = 'F'").orderBy("o_orderkey").limit(5)
    assert frames.first_orders(spark, sf, "F", 5).orderBy("o_orderkey").collect() == want.collect() and want.count() == 5


def test_warehouse_nests_orders_once(spark, monkeypatch):
    from nestlake import frames
    from nestlake.record_queries import order_warehouse

    sf, seen, orders = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0), frames.orders
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    monkeypatch.setattr(frames, "orders", lambda *a: counting(orders(*a), seen))
    assert [o.state for o in order_warehouse(spark, sf)[1]] == ["written"] * 3
    assert seen.value == frames.table(spark, sf, "orders").count()


def test_round_trip_by_owner(spark):
    schema = "id string, s struct<a:long, l:array<struct<v:long, w:array<struct<q:string>>, m:map<string,struct<n:long>>>>>, m map<string,struct<n:long>>, tags array<string>"
    rows = [("1", (5, [(1, [("x",), ("y",)], {"i": (4,)}), (2, None, None), None]), {"k": (7,)}, ["t"]), ("2", None, None, None), ("3", (None, [(3, None, {"z": None})]), None, []), (None, (6, None), None, None)]
    df = spark.createDataFrame(rows, schema)
    made = relational.decomposed(df, "id", owner="of")
    back = relational.recomposed(made, df.schema, owner="of")
    flat = lambda d: sorted(map(str, d.select(df.columns).collect()))
    assert back.columns == relational.recomposed(relational.decomposed(df, "id"), df.schema).columns
    assert flat(back) == flat(relational.recomposed(relational.decomposed(df, "id"), df.schema)) == flat(df)
    listed = lambda d: sorted(map(str, d.collect()))
    twice = spark.createDataFrame([("a", [([(1,)],), ([(2,)],)])] * 2, "id string, xs array<struct<ys:array<struct<v:int>>>>")
    assert listed(relational.recomposed(relational.decomposed(twice, "id", owner="of"), twice.schema, owner="of")) == listed(relational.recomposed(relational.decomposed(twice, "id"), twice.schema))
    nameless = df.filter("id = '1'").withColumn("id", F.lit(None).cast("string"))
    assert flat(relational.recomposed(relational.decomposed(nameless, "id", owner="of"), df.schema, owner="of")) == flat(nameless)
    with pytest.raises(ValueError, match="has a field"):
        relational.decomposed(df, "id", owner="V")


def test_round_trip_shuffles_lines_twice_only(spark):
    from nestlake.queries import QUERIES

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    plan = QUERIES["role_pivot_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = {k.split("#")[0] for k in plan.replace("(", " ").split() if "#" in k and f"hashpartitioning({k}" in plan}
    assert keys <= {"l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "_record"} and "l_orderkey" in keys
