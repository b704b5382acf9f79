"""Registered queries for sources, artifacts, loading, streams, refusals and further rules, each with its SQL.

What is written on the way goes to the folder that the session shares (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .errors import ArtifactError, QueryError
from .plans.compiler import compile_query
from .queries import both, counted, every, from_lines, leaf, register, some


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one; where the session names none, a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    return f"{shared.rstrip('/')}/queries-{uuid.uuid4().hex}"


# ---- source datasets


def supplier_dataset(spark: SparkSession, sf_dir: str, flip: bool = False, **options):
    """Suppliers as a dataset of serialised records, in the order of their keys. The single-file writer is local."""
    from .sources import dataset as ds

    path = f"{tempfile.mkdtemp(prefix='dataset-')}/suppliers.parquet"
    rows = frames.table(spark, sf_dir, "supplier").orderBy(F.desc("s_suppkey") if flip else F.asc("s_suppkey")).toLocalIterator()
    ds.save(path, ds.Scalars("suppliers", "all of them", "set-1"), ((f"s{r.s_suppkey}", json.dumps(r.asDict()).encode()) for r in rows), **options)
    return ds.Dataset(spark, path)


@register("dataset_decode", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def dataset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write, scan and decode on the executors."""
    from .sources import dataset as ds

    return ds.decoded(supplier_dataset(spark, sf_dir).rows(), json.loads, "s_suppkey long, s_name string, s_acctbal double")


@register("dataset_row_group", "SELECT 's' || s_suppkey AS record_id, s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS position FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier) WHERE n BETWEEN 4 AND 6")
def dataset_row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_dataset(spark, sf_dir, row_group=3).rows(row_group=1).select("record_id", "position")


@register(
    "dataset_lookup",
    """WITH s AS (SELECT s_name, s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)
SELECT 'id' AS how, s_name FROM s WHERE s_suppkey = 3 UNION ALL SELECT 'last', s_name FROM s WHERE i = n - 1 UNION ALL SELECT 'slice', s_name FROM s WHERE i IN (1, 3, 5) UNION ALL SELECT 'ids', s_name FROM s WHERE s_suppkey IN (2, 4) UNION ALL SELECT 'unknown id', 'KeyError' UNION ALL SELECT 'beyond', 'IndexError'""",
)
def dataset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, position, slice and list of ids; what is not there is an error."""
    data = supplier_dataset(spark, sf_dir)
    name = lambda blob: json.loads(blob)["s_name"]
    out = [("id", name(data.get("s3"))), ("last", name(data[-1]))] + [("slice", name(b)) for b in data[1:6:2]]
    out += [("ids", name(r.record)) for r in data.rows(["s2", "s4", "nobody"]).collect()]
    for how, ask in (("unknown id", lambda: data.get("nobody")), ("beyond", lambda: data[len(data)])):
        try:
            ask()
        except (KeyError, IndexError) as error:
            out.append((how, type(error).__name__))
    return spark.createDataFrame(out, "how string, s_name string")


@register("dataset_hash", "SELECT * FROM (VALUES ('other row groups', true), ('other order', false)) v(change, same_hash)")
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = supplier_dataset(spark, sf_dir).md5()
    other = {"other row groups": supplier_dataset(spark, sf_dir, row_group=2, compression="snappy"), "other order": supplier_dataset(spark, sf_dir, flip=True)}
    return spark.createDataFrame([(k, d.md5() == first) for k, d in other.items()], "change string, same_hash boolean")


@register("dataset_combined", "SELECT 's' || s_suppkey AS record_id, 2::BIGINT AS n FROM supplier")
def dataset_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files as one, named anew."""
    from .sources import dataset as ds

    one, two = supplier_dataset(spark, sf_dir), supplier_dataset(spark, sf_dir, flip=True)
    out = f"{tempfile.mkdtemp(prefix='dataset-')}/both.parquet"
    ds.combined(spark, [one.path, two.path], out, name="both")
    return ds.Dataset(spark, out).ids().groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


@register("files_inspected", "SELECT * FROM (VALUES ('cut.parquet', 'no Parquet file, or cut off'), ('pointer.parquet', 'a pointer to large file storage, not the file itself'), ('short.parquet', 'too short'), ('good', 'read')) v(file, state)")
def files_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files are told apart and do not stop the others."""
    from .sources.readers import inspected

    path = tempfile.mkdtemp(prefix="files-")
    for name, body in (("cut", b"PAR1" + bytes(40)), ("pointer", b"version https://git-lfs.github.com/spec/v1\noid sha256:0\n"), ("short", b"PAR1")):
        with open(f"{path}/{name}.parquet", "wb") as out:
            out.write(body)
    supplier_dataset(spark, sf_dir)
    good, bad = inspected(spark, f"file:{path}/*.parquet")
    more, _ = inspected(spark, f"{sf_dir}/nation.parquet")
    rows = [(p.rpartition("/")[2], why) for p, why in bad] + [("good", "read") for p in good + more if spark.read.parquet(p).count()]
    return spark.createDataFrame(rows, "file string, state string")


# ---- artifacts, loading, streams


@register("artifact_tree", "SELECT * FROM (VALUES ('first', 2, 0, 0), ('again', 0, 2, 0), ('forced', 2, 0, 0), ('new column', 2, 0, 0), ('of artifacts', 2, 0, 0), ('of plain tables', 0, 0, 2)) v(run, written, skipped, ignored)")
def artifact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.artifacts import derive_tree

    at = scratch(spark)
    for name in ("nation", "region"):
        frames.table(spark, sf_dir, name).write.parquet(f"{at}/in/{name}")
    run = lambda source, out, **options: derive_tree(spark, f"{at}/{source}/*", f"{at}/{out}", "hashed", "1", lambda df: df.withColumn("h", F.xxhash64("*")), **options)
    done = {
        "first": run("in", "out"), "again": run("in", "out"), "forced": run("in", "out", force=True), "new column": run("in", "out", columns={"absent"}),
        "of artifacts": run("out", "next", parent="hashed"), "of plain tables": run("in", "none", parent="hashed"),
    }
    return spark.createDataFrame([(k, *map(len, v)) for k, v in done.items()], "run string, written int, skipped int, ignored int")


STATUS = ("F", "O", "P")


def order_warehouse(spark: SparkSession, sf_dir: str) -> tuple[str, list]:
    """Orders of each status as a dataset of its own. They are nested once, for all three."""
    from .operators import loading

    at, nested, df = scratch(spark), scratch(spark), frames.orders(spark, sf_dir)
    df.write.option("compression", "zstd").parquet(nested)
    df = spark.read.schema(df.schema).parquet(nested)
    return at, loading.load_all(spark, at, {f"status-{s}": lambda s=s: df.filter(F.col("o_orderstatus") == s) for s in STATUS}, "o_orderkey", stage=False)


@register(
    "load_tables",
    """SELECT 'status-' || o_orderstatus AS dataset_id, 'record' AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1
UNION ALL SELECT 'status-' || o_orderstatus, 'lines', count(*), round(sum(l_extendedprice), 2) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1""",
)
def load_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three datasets in relational form, read back over all."""
    from .operators import loading

    at, _ = order_warehouse(spark, sf_dir)
    total = lambda t, level, c: loading.table(spark, at, t).groupBy("dataset_id").agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 2).alias("total"))
    return total("record", "record", "o_totalprice").unionByName(total("record.lines", "lines", "l_extendedprice"))


@register(
    "load_states",
    "SELECT * FROM (VALUES ('first', 'written,written,written'), ('same', 'skipped'), ('other contents', 'refused'), ('other contents, overwrite', 'written'), ('broken among others', 'failed,written'), ('derived', 'written,written,written,written'), ('derived again', 'skipped,skipped,skipped,skipped'), ('unfinished', 'not read'), ('removed', 'status-F,status-O,status-Q')) v(step, state)",
)
def load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What loading does when it is repeated, changed, broken off, derived from and removed."""
    from .operators import loading

    at, first = order_warehouse(spark, sf_dir)
    small = lambda s, n=5: frames.first_orders(spark, sf_dir, s, n)
    states = lambda outcomes: ",".join(o.state for o in outcomes)
    out = [("first", states(first)), ("same", loading.load(spark, at, "status-F", frames.orders(spark, sf_dir).filter("o_orderstatus = 'F'"), "o_orderkey").state)]
    try:
        loading.load(spark, at, "status-F", small("F"), "o_orderkey")
    except ArtifactError:
        out.append(("other contents", "refused"))
    out.append(("other contents, overwrite", loading.load(spark, at, "status-F", small("F"), "o_orderkey", overwrite=True).state))
    out.append(("broken among others", states(loading.load_all(spark, at, {"status-X": lambda: small("F").select("no_such_column"), "status-Q": lambda: small("F", 1)}, "o_orderkey"))))
    lines = lambda table: table("record.lines").groupBy("parent").agg(F.max("l_quantity").alias("most"))
    out += [(step, states(loading.derive(spark, at, "largest", "1", lines))) for step in ("derived", "derived again")]
    frames.table(spark, sf_dir, "nation").write.parquet(f"{at}/record/status-Z")
    out.append(("unfinished", "read" if loading.table(spark, at, "record").filter("dataset_id = 'status-Z'").count() else "not read"))
    loading.remove(spark, at, "status-P")
    loading.prune(spark, at)
    held = loading.table(spark, at, "record").select("dataset_id").distinct().orderBy("dataset_id").collect()
    out.append(("removed", ",".join(r.dataset_id for r in held)))
    return spark.createDataFrame(out, "step string, state string")


@register("stream_derive", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def stream_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive in two lots, the second with ids of the first, each derived once."""
    from .streaming.incremental import derive_stream

    at, df = scratch(spark), frames.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    for low, high in ((0.0, 200000.0), (100000.0, 1e12)):
        df.filter(F.col("o_totalprice").between(low, high)).write.mode("append").parquet(f"{at}/in")
        derive_stream(spark, f"{at}/in", df.schema, f"{at}/out", f"{at}/marks", "o_orderkey", lambda x: x.selectExpr("o_orderkey", "o_totalprice * 2 AS twice")).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("o_orderkey", "twice")


# ---- refusals, schema

BAD: dict[str, dict] = {
    "unknown field": {"where": leaf("eq", "o_totalprise", 1.0)}, "repeated without a quantifier": {"where": leaf("eq", "lines.l_quantity", 1.0)},
    "text as number": {"where": leaf("gt", "o_totalprice", "x")}, "number as text": {"where": leaf("contains", "o_totalprice", "1")},
    "not repeated": {"where": some("o_orderstatus", leaf("eq", "x", 1))}, "empty and": {"where": {"op": "and", "clauses": []}}, "unknown operator": {"where": leaf("near", "o_totalprice", 1.0)},
    "limit of zero": {"where": leaf("eq", "o_orderstatus", "F"), "limit": 0}, "sum of text": {"aggregate": {"measures": [{"fn": "sum", "path": "o_orderstatus", "name": "s"}]}},
    "reduction of a scalar": {"order_by": [{"key": {"reduce": "max", "path": "o_totalprice"}}]}, "order by what is not there": {"order_by": [{"key": "nothing"}]},
    "structure without one": {"where": {"op": "substructure", "path": "o_orderstatus", "smarts": "C"}}, "unbound compound": {"where": {"op": "eq", "path": "o_orderstatus", "value": {"compound": "salt"}}},
    "fine": {"where": both(leaf("eq", "o_orderstatus", "F"), every("lines", leaf("gt", "l_quantity", 0)))},
}


@register("refusals", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(k != 'fine').lower()})" for k in BAD) + ") v(query, refused)")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that must not compile, and one that must."""
    df = frames.orders(spark, sf_dir)

    def refused(query: dict) -> bool:
        try:
            compile_query(query, df, "o_orderkey")
        except QueryError:
            return True
        return False

    return spark.createDataFrame([(k, refused(q)) for k, q in BAD.items()], "query string, refused boolean")


@register(
    "schema_paths",
    "SELECT * FROM (VALUES ('o_totalprice', false, 'double'), ('lines', true, 'struct'), ('lines.l_quantity', true, 'double'), ('lines.l_partkey', true, 'bigint')) v(path, repeated, kind)",
)
def schema_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schema import resolve

    schema = frames.orders(spark, sf_dir).schema
    found = [(p, resolve(p, schema)) for p in ("o_totalprice", "lines", "lines.l_quantity", "lines.l_partkey")]
    return spark.createDataFrame([(p, r.repeated, r.leaf.simpleString().partition("<")[0]) for p, r in found], "path string, repeated boolean, kind string")


@register("order_by_group", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY o_orderstatus DESC LIMIT 2")
def order_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = {"aggregate": {"group_by": ["o_orderstatus"], "measures": [{"fn": "count", "name": "n"}]}, "order_by": [{"key": "o_orderstatus", "descending": True}], "limit": 2}
    return compile_query(query, frames.table(spark, sf_dir, "orders"), "o_orderkey")


# ---- texts and messages

ROLE = "CASE l_linenumber % 3 WHEN 0 THEN 'SOLVENT' ELSE 'REACTANT' END"


@register(
    "reaction_texts",
    """WITH l AS (SELECT l_orderkey, 'P' || l_partkey AS s, CASE l_linenumber % 3 WHEN 0 THEN 'SOLVENT' ELSE 'REACTANT' END AS role, l_returnflag FROM lineitem),
g AS (SELECT l_orderkey, string_agg(s, '.' ORDER BY s) FILTER (role = 'REACTANT') AS a, string_agg(s, '.' ORDER BY s) FILTER (role = 'SOLVENT') AS m, count(*) FILTER (l_returnflag = 'R' AND role = 'REACTANT') AS blank FROM l GROUP BY 1)
SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN 'A.B>>C' WHEN a IS NOT NULL AND blank = 0 THEN a || '>>X' || l_orderkey END AS derived,
CASE WHEN a IS NOT NULL AND blank = 0 THEN a || '>' || coalesce(m, '') || '>X' || l_orderkey END AS with_agents FROM g""",
)
def reaction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded where it can be read, else generated; a reactant without a text leaves none."""
    from .functions import equations

    text = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    role = F.expr(ROLE)
    part = F.struct(F.when((F.col("l_returnflag") != "R") | (role != "REACTANT"), text).alias("smiles"), role.alias("reaction_role"))
    df = frames.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(part).alias("components"))
    recorded = F.when(F.col("l_orderkey") % 4 == 0, "B.A>agent>C").when(F.col("l_orderkey") % 4 == 1, "A>>").otherwise("A>>B |w:1|")
    names = F.array(F.struct(F.lit("REACTION_SMILES").alias("type"), recorded.alias("value")))
    products = F.array(F.struct(F.concat(F.lit("X"), F.col("l_orderkey").cast("string")).alias("smiles")))
    return df.select("l_orderkey", equations.derived(names, F.col("components"), products).alias("derived"), equations.generated(F.col("components"), products, agents=True).alias("with_agents"))


@register(
    "submessages",
    """SELECT o_orderkey, 'total' AS trace, o_totalprice AS amount FROM orders
UNION ALL SELECT l_orderkey, 'lines[' || (i - 1) || '].price', l_extendedprice FROM (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
)
def submessages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every amount of money, wherever it stands."""
    from pyspark.sql import types as T

    from .operators import tables

    money = lambda c: F.struct(c.cast("double").alias("amount"))
    lines = F.transform(F.array_sort(F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("n"), x["l_extendedprice"].alias("p")))), lambda x: F.struct(money(x["p"]).alias("price")))
    df = frames.orders(spark, sf_dir).select("o_orderkey", money(F.col("o_totalprice")).alias("total"), lines.alias("lines"))
    found = tables.submessages(df, "o_orderkey", T.StructType([T.StructField("amount", T.DoubleType())]))
    return found.select("o_orderkey", "trace", "value.amount")


TEXTS = [
    ("orcid", "0000-0002-1825-0097", "true"), ("orcid", "0000-0002-1825-0098", "false"), ("url", "https://example.com/a", "true"), ("url", "example.com", "false"), ("email", "a@b.org", "true"), ("email", "a@b", "false"),
    ("mapped", "[CH3:1]O", "true"), ("mapped", "CO", "false"), ("core", "CO |w:1|", "CO"), ("extension", "CO |w:1|", "|w:1|"), ("date", "3 May 2021", "2021-05-03"), ("date", "05/03/2021", "2021-05-03"), ("date", "soon", None),
]


@register("text_checks", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', {'NULL' if w is None else repr(w)})" for k, t, w in TEXTS) + ") v(what, text, found)")
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import identifiers as ids

    text = F.col("text")
    checks = {
        "orcid": ids.is_orcid(text), "url": ids.is_url(text), "email": ids.is_email(text), "mapped": ids.has_atom_mapping(text), "core": ids.split_extension(text)["core"],
        "extension": ids.split_extension(text)["extension"], "date": F.to_date(ids.timestamp(text)),
    }
    found = F.coalesce(*[F.when(F.col("what") == k, c.cast("string")) for k, c in checks.items()])
    return spark.createDataFrame([t[:2] for t in TEXTS], "what string, text string").withColumn("found", found)


# ---- rule families over made records


def rule_query(name: str, fields: dict[str, str], faults: dict[tuple[str, str], str], element: Callable[[], object], family: str) -> None:
    """Registers a family of record rules over lines: ``faults`` says in SQL when each must complain."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators import record_rules, rules

        df = from_lines(spark, sf_dir, fields, element())
        return rules.summary(rules.violations(df, "id", record_rules.applicable(df.schema, getattr(record_rules, family)("steps"))))

    run.__doc__ = f"The rules of {family.replace('_', ' ')}, counted."
    register(name, counted(faults, fields))(run)


rule_query(
    "validate_identifiers",
    {
        "type": "CASE l_linenumber % 5 WHEN 0 THEN 'CUSTOM' WHEN 1 THEN 'UNSPECIFIED' WHEN 2 THEN 'CAS_NUMBER' WHEN 3 THEN 'PUBCHEM_CID' ELSE 'SMILES' END", "details": "CASE WHEN l_tax > 0.03 THEN 'd' END",
        "value": "CASE WHEN l_quantity < 5 THEN '' WHEN l_quantity < 15 THEN '64-17-5' WHEN l_quantity < 30 THEN '702' WHEN l_quantity < 40 THEN ' CO' ELSE 'CO |w:1|' END",
    },
    {
        ("ERROR", "type_specified"): "type = 'UNSPECIFIED'", ("ERROR", "type_details"): "type = 'CUSTOM' AND details IS NULL", ("ERROR", "identifier_value"): "value = ''", ("WARNING", "identifier_outer_space"): "value = ' CO'",
        ("WARNING", "smiles_extension"): "type = 'SMILES' AND value = 'CO |w:1|'", ("WARNING", "cas_number_form"): "type = 'CAS_NUMBER' AND value <> '64-17-5'", ("WARNING", "pubchem_cid_form"): "type = 'PUBCHEM_CID' AND value <> '702'",
    },
    lambda: F.struct("type", "details", "value"), "identifiers",
)
rule_query(
    "validate_conditions",
    {"conditions_are_dynamic": "CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'N' THEN false END", "details": "CASE WHEN l_quantity > 20 THEN 'd' ELSE '' END", "ph": "CASE WHEN l_tax > 0.02 THEN l_quantity / 3 - 1 END"},
    {
        ("ERROR", "dynamic_needs_details"): "conditions_are_dynamic AND details = ''", ("WARNING", "details_are_dynamic"): "details <> '' AND NOT coalesce(conditions_are_dynamic, false)", ("WARNING", "ph_range"): "ph < 0 OR ph > 14",
    },
    lambda: F.struct("conditions_are_dynamic", "details", "ph"), "conditions",
)
rule_query(
    "validate_compounds",
    {"names": "CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END", "others": "CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END"},
    {("ERROR", "compound_identified"): "names + others = 0", ("WARNING", "compound_not_by_name_only"): "others = 0"},
    lambda: F.struct(F.concat(F.array_repeat(F.struct(F.lit("NAME").alias("type")), F.col("names")), F.array_repeat(F.struct(F.lit("SMILES").alias("type")), F.col("others"))).alias("identifiers")), "compounds",
)
rule_query(
    "validate_products",
    {"reaction_role": "CASE WHEN l_returnflag = 'R' THEN 'SIDE_PRODUCT' WHEN l_returnflag = 'A' THEN 'PRODUCT' END", "is_desired_product": "CASE WHEN l_quantity > 30 THEN true WHEN l_quantity > 10 THEN false END"},
    {("ERROR", "side_product_not_desired"): "reaction_role = 'SIDE_PRODUCT' AND is_desired_product"},
    lambda: F.struct("reaction_role", "is_desired_product"), "products",
)
rule_query(
    "validate_preparations",
    {"type": "CASE l_linenumber % 3 WHEN 0 THEN 'SYNTHESIZED' WHEN 1 THEN 'CUSTOM' ELSE 'DRIED' END", "details": "CASE WHEN l_quantity > 20 THEN 'd' END", "reaction_id": "CASE WHEN l_tax > 0.04 THEN 'r' ELSE '' END"},
    {("ERROR", "type_details"): "type = 'CUSTOM' AND details IS NULL", ("ERROR", "reaction_id_only_for_synthesized"): "reaction_id <> '' AND type <> 'SYNTHESIZED'"},
    lambda: F.struct("type", "details", "reaction_id"), "preparations",
)
rule_query(
    "validate_mass_spectra",
    {"type": "CASE l_linenumber % 4 WHEN 0 THEN 'EIC' WHEN 1 THEN 'TIC' WHEN 2 THEN 'TIC_POSITIVE' ELSE 'CUSTOM' END", "details": "'d'", "low": "l_quantity - 5", "high": "CASE WHEN l_tax > 0.02 THEN 30.0 END", "mass": "CASE WHEN l_discount > 0.05 THEN l_quantity - 10 END"},
    {
        ("ERROR", "tic_minimum_mz_non_negative"): "low < 0", ("ERROR", "tic_range"): "low > high", ("ERROR", "eic_masses_non_negative"): "mass < 0", ("WARNING", "eic_needs_eic_masses"): "type = 'EIC' AND mass IS NULL",
        ("WARNING", "eic_masses_not_for_tic"): "type IN ('TIC', 'TIC_POSITIVE') AND mass IS NOT NULL",
    },
    lambda: F.struct("type", "details", F.col("low").alias("tic_minimum_mz"), F.col("high").alias("tic_maximum_mz"), F.when(F.col("mass").isNotNull(), F.array("mass")).alias("eic_masses")), "mass_spectra",
)
