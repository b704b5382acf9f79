"""Registered queries over the test tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .operators.pivot import pivot
from .plans.compiler import compile_query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


class InlinePivots:
    """Pivots made on the fly from the frame itself; no index, no structures."""

    def __init__(self, df: DataFrame, id_column: str):
        self.df, self.id = df, id_column

    def pivot(self, path: str) -> DataFrame:
        return pivot(self.df, path, self.id)

    def occurrences(self):
        return None

    def matches(self, node):
        raise NotImplementedError

    def record_hits(self, node):
        raise NotImplementedError


def leaf(op: str, path: str, literal) -> dict:
    return {"op": op, "path": path, "value": {"literal": literal}}


def both(*clauses: dict) -> dict:
    return {"op": "and", "clauses": list(clauses)}


def either(*clauses: dict) -> dict:
    return {"op": "or", "clauses": list(clauses)}


def negate(clause: dict) -> dict:
    return {"op": "not", "clause": clause}


def some(path: str, where: dict) -> dict:
    return {"op": "exists", "path": path, "where": where}


def every(path: str, where: dict) -> dict:
    return {"op": "forall", "path": path, "where": where}


def over_orders(name: str, query: dict, sql: str, route: str = "elements") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = frames.orders(spark, sf_dir)
        return compile_query(query, df, "o_orderkey", InlinePivots(df, "o_orderkey"), route)

    register(name, sql)(run)


def over_customers(name: str, query: dict, sql: str, route: str = "elements") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = frames.customers(spark, sf_dir)
        return compile_query(query, df, "c_custkey", InlinePivots(df, "c_custkey"), route)

    register(name, sql)(run)


# ---- quantifiers

RETURNED = both(leaf("eq", "l_returnflag", "R"), leaf("gt", "l_quantity", 45))
HAS = "SELECT o_orderkey FROM orders o WHERE {}"
LINES = "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND {})"
_exists = HAS.format(LINES.format("l_returnflag = 'R' AND l_quantity > 45"))
over_orders("exists_comember", {"where": some("lines", RETURNED)}, _exists)
over_orders("exists_pivot", {"where": some("lines", RETURNED)}, _exists, "pivot")
over_orders(
    "exists_cooccur",
    {"where": both(some("lines", leaf("eq", "l_returnflag", "R")), some("lines", leaf("gt", "l_quantity", 45)))},
    HAS.format(LINES.format("l_returnflag = 'R'") + " AND " + LINES.format("l_quantity > 45")),
)
_forall = HAS.format("NOT " + LINES.format("NOT (l_quantity < 30)"))
over_orders("forall_lines", {"where": every("lines", leaf("lt", "l_quantity", 30))}, _forall)
over_orders("forall_pivot", {"where": every("lines", leaf("lt", "l_quantity", 30))}, _forall, "pivot")
over_orders("not_exists", {"where": negate(some("lines", leaf("eq", "l_linestatus", "F")))}, HAS.format("NOT " + LINES.format("l_linestatus = 'F'")))
_either = HAS.format(f"o_orderstatus = 'P' OR {LINES.format('l_quantity > 49')}")
over_orders("or_exists", {"where": either(leaf("eq", "o_orderstatus", "P"), some("lines", leaf("gt", "l_quantity", 49)))}, _either)
over_orders("or_exists_pivot", {"where": either(leaf("eq", "o_orderstatus", "P"), some("lines", leaf("gt", "l_quantity", 49)))}, _either, "pivot")

DESIRED = some("orders", both(leaf("eq", "o_orderstatus", "F"), some("lines", both(leaf("eq", "l_returnflag", "R"), leaf("gt", "l_quantity", 49)))))
_desired = """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F'
AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity > 49))"""
over_customers("nested_desired", {"where": DESIRED}, _desired)
over_customers("nested_pivot", {"where": DESIRED}, _desired, "pivot")
EVERY_ORDER = every("orders", some("lines", leaf("lt", "l_quantity", 25)))
_every = """SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity < 25))"""
over_customers("nested_forall", {"where": EVERY_ORDER}, _every)
over_customers("nested_forall_pivot", {"where": EVERY_ORDER}, _every, "pivot")
over_customers(
    "two_level_path", {"where": some("orders.lines", leaf("gt", "l_extendedprice", 90000))},
    "SELECT DISTINCT o_custkey AS c_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_extendedprice > 90000",
)

# ---- leaf predicates

for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    over_orders(f"cmp_{_op}", {"where": leaf(_op, "o_totalprice", 150000.0)}, HAS.format(f"o_totalprice {_sign} 150000.0"))
over_orders("text_contains", {"where": leaf("contains", "o_orderpriority", "URG")}, HAS.format("contains(o_orderpriority, 'URG')"))
over_orders("text_starts_with", {"where": leaf("starts_with", "o_orderpriority", "2")}, HAS.format("starts_with(o_orderpriority, '2')"))
over_orders("text_ends_with", {"where": leaf("ends_with", "o_orderpriority", "LOW")}, HAS.format("ends_with(o_orderpriority, 'LOW')"))
@register("nullcheck", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS b, CASE WHEN c_nationkey < 9 THEN NULL ELSE c_nationkey END AS k FROM customer) ON c_custkey = o_custkey WHERE b IS NULL OR k IS NOT NULL")
def nullcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that are null in some rows, and structs that are null as a whole."""
    c = frames.table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")).alias("account"), F.when(F.col("c_nationkey") >= 9, F.struct(F.col("c_nationkey").alias("key"))).alias("nation"))
    df = frames.table(spark, sf_dir, "orders").join(c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left")
    return compile_query({"where": either({"op": "is_null", "path": "account.balance"}, {"op": "not_null", "path": "nation"})}, df, "o_orderkey")


@register(
    "sum_avg_by_measure",
    "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL ORDER BY avg(o_totalprice) DESC LIMIT 5",
)
def sum_avg_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and average measures, ordered by one of them, the first five groups."""
    query = {
        "aggregate": {"group_by": ["o_orderstatus", "o_orderpriority"], "measures": [{"fn": "sum", "name": "total", "path": "o_totalprice"}, {"fn": "avg", "name": "mean", "path": "o_totalprice"}]},
        "order_by": [{"key": "mean", "descending": True}], "limit": 5,
    }
    return compile_query(query, frames.orders(spark, sf_dir), "o_orderkey").withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


over_orders(
    "logic_tree", {"where": both(either(leaf("eq", "o_orderstatus", "F"), leaf("eq", "o_orderstatus", "O")), negate(leaf("lt", "o_totalprice", 200000)))},
    HAS.format("(o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT (o_totalprice < 200000)"),
)


@register("compound_value", HAS.format("o_orderpriority = '1-URGENT'"))
def compound_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name is resolved to text and bound."""
    query = {"where": {"op": "eq", "path": "o_orderpriority", "value": {"compound": "urgent"}}}
    return compile_query(query, frames.orders(spark, sf_dir), "o_orderkey", bound={"urgent": "1-URGENT"})


# ---- reductions

for _how, _sql in (
    ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("avg", "round(avg(l_quantity), 6)"),
    ("sum", "round(sum(l_quantity), 4)"), ("count", "nullif(count(l_orderkey), 0)"),
):

    def _reduce(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        from .plans.compiler import Compiler
        from .plans.grammar import Reduction

        df = frames.orders(spark, sf_dir)
        path = "lines.l_extendedprice" if how in ("min", "max") else "lines.l_quantity"
        value = Compiler(df, "o_orderkey").reduction(Reduction(how, path))
        value = F.round(value, 6 if how == "avg" else 4) if how in ("avg", "sum") else value
        return df.select("o_orderkey", value.alias("value"))

    register(f"reduce_{_how}", f"SELECT o_orderkey, {_sql} AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")(_reduce)

over_orders(
    "topk_reduction",
    {"order_by": [{"key": {"reduce": "max", "path": "lines.l_extendedprice"}, "descending": True}, {"key": "o_orderkey"}], "limit": 25},
    "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY max(l_extendedprice) DESC NULLS LAST, o_orderkey LIMIT 25",
)
over_orders("order_scalar", {"order_by": [{"key": "o_totalprice"}, {"key": "o_orderkey", "descending": True}], "limit": 40}, "SELECT o_orderkey FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey DESC NULLS LAST LIMIT 40")

# ---- aggregates


def measure(fn: str, name: str, path=None) -> dict:
    return {"fn": fn, "name": name} | ({} if path is None else {"path": path})


over_orders(
    "group_measures",
    {"aggregate": {"group_by": ["o_orderstatus", "o_orderpriority"], "measures": [measure("count", "n"), measure("max", "top", "o_totalprice"), measure("min", "low", "o_totalprice")]}},
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders GROUP BY ALL",
)
over_orders("global_agg", {"aggregate": {"measures": [measure("count", "n"), measure("count", "named", "o_orderstatus")]}}, "SELECT count(*) AS n, count(o_orderstatus) AS named FROM orders")
over_orders("count_distinct", {"aggregate": {"measures": [measure("count_distinct", "customers", "o_custkey")]}}, "SELECT count(DISTINCT o_custkey) AS customers FROM orders")
over_orders(
    "agg_over_reduction",
    {"where": some("lines", leaf("eq", "l_returnflag", "A")), "aggregate": {"group_by": ["o_orderstatus"], "measures": [measure("max", "most", {"reduce": "count", "path": "lines.l_quantity"}), measure("min", "least", {"reduce": "max", "path": "lines.l_quantity"})]}, "order_by": [{"key": "most", "descending": True}, {"key": "o_orderstatus"}]},
    """WITH r AS (SELECT o_orderkey, o_orderstatus, count(*) AS c, max(l_quantity) AS q, bool_or(l_returnflag = 'A') AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderstatus, max(c) AS most, min(q) AS least FROM r WHERE hit GROUP BY o_orderstatus""",
)

# ---- pivots


@register(
    "pivot_rows",
    """SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)::INTEGER AS line_index,
l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def pivot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot(frames.orders(spark, sf_dir), "lines", "o_orderkey").select("o_orderkey", "line_index", "element.l_linenumber", "element.l_partkey")


@register(
    "pivot_two_levels",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS order_index FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey AS c_custkey, order_index::INTEGER AS order_index, count(*) AS n, max(line_index)::INTEGER AS last_line FROM
(SELECT o.*, row_number() OVER (PARTITION BY o_orderkey) AS line_index FROM o JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY ALL""",
)
def pivot_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pivot(frames.customers(spark, sf_dir), "orders.lines", "c_custkey")
    return rows.groupBy("c_custkey", "order_index").agg(F.count(F.lit(1)).alias("n"), F.max("line_index").alias("last_line"))


# ---- structures: embeddings as fingerprints, documents as structures, parts as occurrences


@register(
    "similarity_tanimoto",
    """WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings), q AS (SELECT b AS qb FROM w WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, list_dot_product(b::DOUBLE[], qb::DOUBLE[]) AS shared, list_sum(b) AS na, list_sum(qb) AS nb FROM w, q)
SELECT vec_id FROM s WHERE shared / (na + nb - shared) >= 0.4""",
)
def similarity_tanimoto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tanimoto on sign bits against the first vector, behind the popcount bound."""
    from .functions import fingerprint as fp

    rows = frames.table(spark, sf_dir, "embeddings").select("vec_id", F.array(fp.from_signs(F.col("embedding"))).alias("bits"))
    rows = rows.withColumn("count", fp.popcount(F.col("bits")))
    query = rows.agg(F.min(F.struct("vec_id", "bits", "count")).alias("q")).first()["q"]
    low, high = fp.popcount_bounds(0.4, query["count"])
    score = fp.tanimoto(F.col("bits"), fp.literal(list(query["bits"])), F.col("count"), F.lit(query["count"]))
    return rows.filter(F.col("count").between(low, high)).filter(score >= 0.4).select("vec_id")


@register(
    "similarity_dice",
    """WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings), q AS (SELECT b AS qb FROM w WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id FROM w, q WHERE 2 * list_dot_product(b::DOUBLE[], qb::DOUBLE[]) / (list_sum(b) + list_sum(qb)) >= 0.6""",
)
def similarity_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import fingerprint as fp

    rows = frames.table(spark, sf_dir, "embeddings").select("vec_id", F.array(fp.from_signs(F.col("embedding"))).alias("bits"))
    rows = rows.withColumn("count", fp.popcount(F.col("bits")))
    query = rows.agg(F.min(F.struct("vec_id", "bits", "count")).alias("q")).first()["q"]
    return rows.filter(fp.dice(F.col("bits"), fp.literal(list(query["bits"])), F.col("count"), F.lit(query["count"])) >= 0.6).select("vec_id")


def part_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as structures: global_id is the part's key."""
    from .functions.chem import TextChemistry
    from .operators.structures import featurised

    parts = frames.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("structure_id"), F.col("p_name").alias("smiles"))
    return featurised(parts, TextChemistry()).withColumn("global_id", F.col("structure_id"))


@register("screen_verify", "SELECT p_partkey AS global_id FROM part WHERE contains(p_name, 'plate')")
def screen_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment: bits first, then the text itself."""
    from .functions.chem import TextChemistry
    from .operators.structures import containing

    return containing(part_library(spark, sf_dir), "plate", TextChemistry())


@register("same_identity", "SELECT p_partkey AS global_id FROM part WHERE lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) = (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) FROM part WHERE p_partkey = 7)")
def same_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.chem import TextChemistry
    from .operators.structures import same

    name = frames.table(spark, sf_dir, "part").filter("p_partkey = 7").first()["p_name"]
    return same(part_library(spark, sf_dir), f"  {name.upper()} ", TextChemistry())


@register("same_parent", "SELECT p_partkey AS global_id FROM part WHERE split_part(lower(p_name), '.', 1) = (SELECT split_part(lower(p_name), '.', 1) FROM part WHERE p_partkey = 7)")
def same_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.chem import TextChemistry
    from .operators.structures import same

    name = frames.table(spark, sf_dir, "part").filter("p_partkey = 7").first()["p_name"]
    return same(part_library(spark, sf_dir), f"{name}.salt", TextChemistry(), parent=True)


def part_corpus(spark: SparkSession, sf_dir: str):
    """Orders as records; each line's part is a structure, its return flag the role."""
    from .functions.chem import TextChemistry
    from .plans.corpus import Corpus

    parts = frames.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("smiles"), (F.col("p_partkey") - 1).alias("structure_id"))
    lines = frames.table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left")
    held = F.struct("smiles", F.col("structure_id"), F.col("l_returnflag").alias("reaction_role"), "l_quantity", "l_linenumber")
    records = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(held)).alias("components"))
    library = part_library(spark, sf_dir).withColumn("structure_id", F.col("structure_id") - 1).drop("global_id").persist()
    return Corpus([(records, library)], "o_orderkey", TextChemistry())


_HIT = "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(p_name, 'hot r') AND l_returnflag = 'R'"
_PART = {"where": some("components", both({"op": "substructure", "path": "smiles", "smarts": "hot r"}, leaf("eq", "reaction_role", "R")))}


@register("occurrence_index", _HIT)
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_corpus(spark, sf_dir).compile(_PART, "index")


@register("structure_pivot", _HIT)
def structure_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_corpus(spark, sf_dir).compile(_PART, "pivot")


@register("structure_elements", _HIT)
def structure_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_corpus(spark, sf_dir).compile(_PART, "elements")


# ---- tables


@register("dense_ids", "SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS structure_id FROM (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL)")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.structures import first_seen_ids

    return first_seen_ids(frames.table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])


@register("offsets", "SELECT o_orderdate::DATE AS day, n, (sum(n) OVER (ORDER BY o_orderdate::DATE) - n)::BIGINT AS start FROM (SELECT o_orderdate::DATE AS o_orderdate, count(*) AS n FROM orders GROUP BY 1)")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    sizes = frames.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return tables.offsets(sizes, "day", "n")


@register("distinct_on", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_extendedprice DESC, l_partkey, l_suppkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    df = frames.table(spark, sf_dir, "lineitem")
    return tables.distinct_on(df, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey")]).select("l_orderkey", "l_partkey", "l_extendedprice")


@register("latest", "SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    return tables.latest(frames.table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@register("incremental", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    done = frames.table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return tables.incremental(frames.table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey")


@register("orphans", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    used = frames.table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return tables.orphans(frames.table(spark, sf_dir, "part").select("p_partkey"), [used], "p_partkey")


@register("dedup_link", "SELECT count(DISTINCT l_returnflag) AS names, count(*) AS linked, (SELECT count(*) FROM lineitem) AS rows_in FROM lineitem WHERE l_returnflag IS NOT NULL")
def dedup_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    _, linked = tables.deduplicated_links(frames.table(spark, sf_dir, "lineitem"), "l_returnflag", "flag_id")
    return linked.agg(F.countDistinct("flag_id").alias("names"), F.count("flag_id").alias("linked"), F.count(F.lit(1)).alias("rows_in"))


@register(
    "merge_changes",
    """SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'insert' WHEN b.o_custkey IS NULL THEN 'delete' WHEN a.n IS NOT DISTINCT FROM b.n THEN 'keep' ELSE 'update' END AS _change
FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.o_custkey = b.o_custkey""",
)
def merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    count = lambda s: frames.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return tables.merged(count("F"), count("O"), ["o_custkey"]).select("o_custkey", "_change")


@register(
    "crossref",
    """SELECT 'duplicate' AS problem, l_orderkey AS id FROM lineitem WHERE l_linenumber = 1 GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'self', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey = l_partkey)
UNION ALL SELECT 'undefined', l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1))""",
)
def crossref(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    lines = frames.table(spark, sf_dir, "lineitem")
    return tables.cross_references(lines.filter("l_linenumber = 1"), "l_orderkey", lines.select("l_orderkey", F.col("l_partkey").alias("refers_to")))


@register("result_difference", "SELECT 'missing' AS side, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND NOT o_totalprice > 250000 UNION ALL SELECT 'extra', o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'P'")
def result_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    df = frames.table(spark, sf_dir, "orders")
    return tables.result_difference(df.filter("o_orderstatus = 'P'"), df.filter("o_totalprice > 250000"), "o_orderkey")


@register(
    "fk_chain",
    "SELECT n_name, count(*) AS n, max(l_quantity) AS top FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY n_name",
)
def fk_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys from the top table down."""
    t = lambda n: frames.table(spark, sf_dir, n)
    rows = t("lineitem").filter("l_returnflag = 'R'").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top"))


@register("union_paths", "SELECT n_name AS nation, r_name AS region, 'customer' AS via FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION SELECT n_name, r_name, 'supplier' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def union_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    place = frames.table(spark, sf_dir, "nation").join(frames.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def path(name: str, key: str) -> DataFrame:
        """One way through the foreign keys: from a table over nations to regions."""
        met = frames.table(spark, sf_dir, name).select(key).distinct().join(place, F.col(key) == F.col("n_nationkey"))
        return met.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.lit(name).alias("via"))

    return tables.union_paths([path("customer", "c_nationkey"), path("supplier", "s_nationkey")], distinct=True)


# ---- rules, units, templates, relational form


@register(
    "validate_rules",
    """SELECT o_orderkey, '' AS trace, 'ERROR' AS severity, 'lines_not_empty' AS rule FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT o_orderkey, '', 'WARNING', 'o_totalprice_range' FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 400000
UNION ALL SELECT l_orderkey, 'lines[' || (i - 1) || ']', 'WARNING', 'l_discount_range' FROM (SELECT l_orderkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE NOT l_discount BETWEEN 0 AND 0.09""",
)
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import rules

    own = [rules.not_empty("lines"), rules.within("o_totalprice", 1000, 400000), rules.within("l_discount", 0, 0.09, "lines")]
    return rules.violations(frames.orders(spark, sf_dir), "o_orderkey", own).drop("message")


@register(
    "unit_convert",
    """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value * 5 / 9 - 32 * 5.0 / 9 + 273.15 WHEN 1 THEN value + 273.15 WHEN 2 THEN value END, 6) AS kelvin,
round(CASE WHEN event_id % 2 = 0 THEN value ELSE 1e7 / nullif(value, 0) END, 4) AS nanometer FROM events""",
)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import units

    unit = F.element_at(F.array(F.lit("fahrenheit"), F.lit("celsius"), F.lit("kelvin"), F.lit("unknown")), (F.col("event_id") % 4 + 1).cast("int"))
    wave = F.when(F.col("event_id") % 2 == 0, "nanometer").otherwise("wavenumber")
    return frames.table(spark, sf_dir, "events").select(
        "event_id", F.round(units.canonical_value(F.col("value"), unit, "temperature"), 6).alias("kelvin"), F.round(units.canonical_value(F.col("value"), wave, "wavelength"), 4).alias("nanometer")
    )


@register("quantity_parse", "SELECT p_partkey, p_size::DOUBLE AS value, CASE p_partkey % 3 WHEN 0 THEN 'milliliter' WHEN 1 THEN 'gram' ELSE 'hour' END AS unit FROM part")
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import units

    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(" mL"), F.lit("g"), F.lit(" hrs.")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return frames.table(spark, sf_dir, "part").select("p_partkey", units.parsed(text).alias("q")).select("p_partkey", "q.value", "q.unit")


@register("flatten_row", "SELECT o_orderkey, o_orderstatus AS \"state.code\", o_totalprice AS \"state.money.total\" FROM orders")
def flatten_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    nested = frames.table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("code"), F.struct(F.col("o_totalprice").alias("total")).alias("money")).alias("state"))
    return tables.flattened(nested)


@register("template_fill", "SELECT 'item ' || p_name AS title, p_size::BIGINT AS size FROM part")
def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import types as T

    from .operators import templates

    kind = T.StructType([T.StructField("title", T.StringType()), T.StructField("size", T.LongType())])
    return templates.enumerated('{"title": "item $p_name$", "size": $p_size$}', frames.table(spark, sf_dir, "part"), kind)


@register("id_rewrite", "SELECT o_orderkey, list_sort(list(md5('s' || chr(31) || l_partkey))) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def id_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's id becomes a canonical one, and the references in orders follow."""
    from .operators import updates

    parts = frames.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("part_id"))
    ids = updates.id_map(parts, "part_id", "", seed="s")
    refs = frames.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("parts"))
    refs = refs.join(frames.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return updates.rewritten(refs, "o_orderkey", "parts", ids).select("o_orderkey", F.array_sort("parts").alias("parts"))


@register(
    "role_pivot_roundtrip",
    """SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, o_orderkey, o_totalprice, l_linenumber, l_partkey, l_quantity
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
)
def role_pivot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records to tables and back, then every value of every level."""
    from .operators import relational

    df = frames.customers(spark, sf_dir).select("c_custkey", "c_name", "orders")
    back = relational.recomposed(relational.decomposed(df, "c_custkey", owner="_record"), df.schema, owner="_record")
    count = F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("orders")
    rows = back.select("c_custkey", "c_name", count, F.explode_outer("orders").alias("o")).select("c_custkey", "c_name", "orders", "o.o_orderkey", "o.o_totalprice", F.explode_outer("o.lines").alias("l"))
    return rows.select("c_custkey", "c_name", "orders", "o_orderkey", "o_totalprice", "l.l_linenumber", "l.l_partkey", "l.l_quantity")


#: A workup, a measurement and an input made of each line, field by field, as SQL that Spark and DuckDB share.
WORKUP = {
    "type": "CASE l_linenumber % 8 WHEN 0 THEN 'WAIT' WHEN 1 THEN 'TEMPERATURE' WHEN 2 THEN 'EXTRACTION' WHEN 3 THEN 'WASH' WHEN 4 THEN 'STIRRING' WHEN 5 THEN 'PH_ADJUST' WHEN 6 THEN 'ALIQUOT' ELSE 'CUSTOM' END",
    "details": "CASE WHEN l_quantity > 25 THEN 'd' ELSE '' END", "wait": "CASE WHEN l_quantity > 10 THEN l_quantity END", "kelvin": "CASE WHEN l_tax > 0.04 THEN 300.0 END",
    "phase": "CASE WHEN l_returnflag = 'A' THEN 'organic' END", "rpm": "CASE WHEN l_returnflag <> 'R' THEN 100 END", "ph": "CASE WHEN l_quantity > 5 THEN l_quantity / 3 END",
    "grams": "CASE WHEN l_discount < 0.03 THEN l_quantity END", "moles": "CASE WHEN l_discount > 0.07 THEN l_tax END", "added": "l_partkey % 3",
}
MEASUREMENT = {
    "type": "CASE l_linenumber % 5 WHEN 0 THEN 'IDENTITY' WHEN 1 THEN 'YIELD' WHEN 2 THEN 'AREA' WHEN 3 THEN 'SELECTIVITY' ELSE 'UNSPECIFIED' END", "details": "''", "analysis": "CASE WHEN l_quantity > 20 THEN 'a' ELSE '' END",
    "percent": "CASE WHEN l_discount > 0.04 THEN l_discount END", "number": "CASE WHEN l_tax > 0.05 THEN l_tax END", "selectivity": "CASE WHEN l_returnflag = 'N' THEN 'EE' END",
}


def counted(rules: dict[tuple[str, str], str], fields: dict[str, str]) -> str:
    """SQL that counts the records and problems of each (severity, rule) by the condition of a fault."""
    rows = "WITH t AS (SELECT l_orderkey AS id, " + ", ".join(f"{sql} AS {name}" for name, sql in fields.items()) + " FROM lineitem)"
    return rows + " UNION ALL ".join(f" SELECT '{s}' AS severity, '{r}' AS rule, count(DISTINCT id) AS records, count(*) AS problems FROM t WHERE {c} HAVING count(*) > 0" for (s, r), c in rules.items())


def from_lines(spark: SparkSession, sf_dir: str, fields: dict[str, str], element) -> DataFrame:
    """id, steps: each order's lines as elements of a level."""
    flat = frames.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", *[f"{sql} AS {name}" for name, sql in fields.items()])
    return flat.groupBy("id").agg(F.collect_list(element).alias("steps"))


@register(
    "validate_workups",
    counted(
        {
            ("ERROR", "type_details"): "type = 'CUSTOM' AND details = ''", ("WARNING", "wait_needs_duration"): "type = 'WAIT' AND wait IS NULL",
            ("WARNING", "temperature_needs_temperature"): "type = 'TEMPERATURE' AND kelvin IS NULL", ("WARNING", "extraction_or_filtration_needs_keep_phase"): "type = 'EXTRACTION' AND phase IS NULL",
            ("WARNING", "stirring_needs_stirring"): "type = 'STIRRING' AND rpm IS NULL", ("WARNING", "ph_adjust_needs_target_ph"): "type = 'PH_ADJUST' AND ph IS NULL",
            ("WARNING", "workup_needs_input"): "type IN ('WASH', 'PH_ADJUST') AND added = 0", ("WARNING", "target_ph_range"): "ph > 14",
            ("WARNING", "aliquot_amount"): "type = 'ALIQUOT' AND grams IS NULL", ("WARNING", "amount_of_aliquots"): "type NOT IN ('ALIQUOT', 'CUSTOM') AND (grams IS NOT NULL OR moles IS NOT NULL)",
        },
        WORKUP,
    ),
)
def validate_workups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of workups, counted."""
    from .operators import record_rules, rules

    some_value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("value")))
    parts = F.when(F.col("added") > 0, F.array(F.struct(F.col("added").alias("n")))).otherwise(F.array().cast("array<struct<n:bigint>>"))
    none = F.lit(None).cast("struct<value:double>")
    amount = F.struct(some_value("grams").alias("mass"), some_value("moles").alias("moles"), none.alias("volume"), none.alias("unmeasured"))
    step = F.struct(
        "type", "details", some_value("wait").alias("duration"), some_value("kelvin").alias("temperature"), F.col("phase").alias("keep_phase"), some_value("rpm").alias("stirring"),
        F.col("ph").alias("target_ph"), F.struct(parts.alias("components")).alias("input"), amount.alias("amount"),
    )
    df = from_lines(spark, sf_dir, WORKUP, step)
    return rules.summary(rules.violations(df, "id", record_rules.applicable(df.schema, record_rules.workups("steps"))))


@register(
    "validate_measurements",
    counted(
        {
            ("ERROR", "type_specified"): "type = 'UNSPECIFIED'", ("WARNING", "measurement_has_analysis"): "analysis = ''", ("ERROR", "identity_has_no_value"): "type = 'IDENTITY' AND (percent IS NOT NULL OR number IS NOT NULL)",
            ("WARNING", "share_in_percent"): "type = 'YIELD' AND percent IS NULL", ("ERROR", "signal_is_numeric"): "type = 'AREA' AND percent IS NULL AND number IS NULL",
            ("ERROR", "selectivity_only_for_selectivity"): "selectivity IS NOT NULL AND type <> 'SELECTIVITY'",
        },
        MEASUREMENT,
    ),
)
def validate_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of measurements, counted."""
    from .operators import record_rules, rules

    none = F.lit(None).cast("string")
    step = F.struct(
        "type", "details", F.col("analysis").alias("analysis_key"), F.when(F.col("percent").isNotNull(), F.struct(F.col("percent").alias("value"))).alias("percentage"), F.col("number").alias("float_value"),
        none.alias("string_value"), none.alias("mass"), "selectivity",
    )
    df = from_lines(spark, sf_dir, MEASUREMENT, step)
    return rules.summary(rules.violations(df, "id", record_rules.applicable(df.schema, record_rules.measurements("steps"))))


@register("submitted_at", "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def submitted_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative event for each user."""
    from .operators import tables

    return tables.latest(frames.table(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@register("doi_and_ids", "SELECT doc_id, 'reaction-' || md5(doc_id::VARCHAR) AS rid, true AS good, '10.1234/x' || doc_id AS doi FROM documents")
def doi_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import identifiers as ids

    docs = frames.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("reaction-"), F.md5(F.col("doc_id").cast("string"))).alias("rid"), F.concat(F.lit(" https://doi.org/10.1234/x"), F.col("doc_id").cast("string"), F.lit(". ")).alias("raw"))
    return docs.select("doc_id", "rid", ids.is_hex_id(F.col("rid"), "reaction-").alias("good"), ids.doi(F.col("raw")).alias("doi"))


# ---- projection of records, message rows


@register(
    "project_quantities",
    """SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN value + 273.15 WHEN 1 THEN value END, 6) AS heat_kelvin, round(CASE WHEN event_id % 2 = 0 THEN value / 1000 ELSE value END, 6) AS load_grams,
CASE WHEN event_id % 5 < 4 THEN event_type END AS smiles FROM events""",
)
def project_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities to canonical columns and identifiers to one spelling, inside a list."""
    from .operators.projection import projected

    none = F.lit(None).cast("double")
    heat = F.struct(F.col("value").alias("value"), none.alias("precision"), F.when(F.col("event_id") % 3 == 0, "CELSIUS").when(F.col("event_id") % 3 == 1, "KELVIN").alias("units"))
    load = F.struct(F.col("value").alias("value"), none.alias("precision"), F.when(F.col("event_id") % 2 == 0, "MILLIGRAM").otherwise("GRAM").alias("units"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("SMILES", "CXSMILES", "INCHI", "MOLBLOCK", "NAME")]), (F.col("event_id") % 5 + 1).cast("int"))
    names = F.array(F.struct(kind.alias("type"), F.col("event_type").alias("value")))
    rows = frames.table(spark, sf_dir, "events").select("event_id", heat.alias("heat"), F.array(F.struct(load.alias("load"), names.alias("identifiers"))).alias("parts"))
    made = projected(rows, {"heat": "temperature", "load": "mass"})
    part = F.col("parts")[0]
    return made.select("event_id", F.round("heat_kelvin", 6).alias("heat_kelvin"), F.round(part["load_grams"], 6).alias("load_grams"), part["smiles"].alias("smiles"))


@register(
    "message_rows",
    """SELECT l_orderkey AS o_orderkey, 'lines[' || (i - 1) || '].l_partkey' AS key, l_partkey::VARCHAR AS value FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS i FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL""",
)
def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import tables

    df = frames.orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", F.transform("lines", lambda x: F.struct(x["l_partkey"].alias("l_partkey"))).alias("lines"))
    return tables.message_rows(df, "o_orderkey")


@register("varying_keys", "SELECT DISTINCT k AS key FROM (VALUES ('o_orderstatus'), ('o_custkey')) v(k) WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders) > 1")
def varying_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold one value throughout go."""
    from .operators import tables

    df = frames.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", F.lit("same").alias("constant"))
    return tables.varying_keys(tables.message_rows(df, "o_orderkey"), "o_orderkey").select("key").distinct()
