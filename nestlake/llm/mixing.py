"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks in the order of a seeded hash. The ideal mix is fluid: at any
time each source that still has blocks is served in proportion to its target weight, until
all are done. With b blocks and weights w, sources k are done with the j-th block of source
i when they have had min(b_k, w_k * j / w_i) blocks each, so the fluid mix reaches that block
at t_i(j) = sum over k of min(b_k, w_k * j / w_i): a closed form, exact in whole numbers.
The j-th block is released at floor(t_i(j - 1)) and due at ceil(t_i(j)), and earliest deadline
first among released blocks serves one block a slot. The windows come from a fluid schedule
that is never idle, so every block gets a slot inside its window, and at any slot each
source is less than one block from its target, also after others have run short. Every row
gets a place: nothing is dropped or repeated.

The windows are computed for all blocks in parallel. The earliest-deadline fold is one
expression over an array with an element for each slot. Blocks grow with the table, so
that there are about SLOTS of them at most (plus one for each source), whatever its size.
Rows find their rank in their source by hash bucket and prefix sums, so no source is sorted
in one task.

Defined results: a null source counts as the empty one; a source without weight, or with
one that is not positive, comes after all that have one; weights are read as whole
multiples of 1e-15 of the largest; rows that repeat and ties take places like others; null
doc_ids are ordered by their other columns; texts, however long, only pass; an empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block at least, and blocks of a schedule about at most.
BLOCK, SLOTS = 8, 131_072
#: Slots that one step of the outer fold takes.
CHUNK = 256
#: Units of the largest weight.
UNITS = 10**15
#: Rows that a rank bucket holds about, and the least number of buckets (a power of 2).
BUCKET_ROWS, LEAST_BITS = 50_000, 8
#: Schedule rows up to which they are sent to all executors (about 20 MB).
BROADCAST_ROWS = 2 * SLOTS
SEED = "mix-1"

JOB = "struct<deadline:bigint,idx:int,nth:bigint,release:bigint>"


def source_of(column: str = "source") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ranked(df: DataFrame) -> DataFrame:
    """df with _source and _rank (0, 1, ... in each source, in the order of a seeded hash)."""
    n = df.count()
    bits = max(LEAST_BITS, (n // BUCKET_ROWS).bit_length())
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string")))
    keyed = (
        df.withColumn("_source", source_of())
        .withColumn("_key", F.md5(F.concat(F.lit(SEED), named)))
        .withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 7), 16, 10).cast("int"), 28 - bits))
    )
    sizes = keyed.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.settle(sizes.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "mix-starts")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id")
    return (
        keyed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, ["_source", "_bucket"])
        .withColumn("_rank", F.col("_start") + F.col("_in"))
        .drop("_start", "_in", "_bucket", "_key")
    )


def default_weights(sizes: DataFrame) -> DataFrame:
    """_source, weight: the square root of the size."""
    return sizes.select("_source", F.sqrt("n").alias("weight"))


def windows(sizes: DataFrame, weights: DataFrame | None = None, each: int = BLOCK) -> DataFrame:
    """_source, idx, nth (1, 2, ...), release, deadline of every block of ``each`` rows. sizes: _source, n; weights: _source, weight."""
    weights = default_weights(sizes) if weights is None else weights
    given = sizes.join(weights, "_source", "left").select("_source", F.ceil(F.col("n") / each).cast("long").alias("b"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))
    # One row with all sources: the tens or hundreds that a mix names.
    whole = given.agg(F.array_sort(F.collect_list(F.struct("_source", "b", "weight"))).alias("given"), F.max("weight").alias("most"))
    unit = lambda x: F.when(x["weight"] > 0, F.greatest(F.lit(1).cast("long"), F.round(x["weight"] / F.col("most") * UNITS).cast("long"))).otherwise(F.lit(UNITS))
    whole = whole.select(F.transform("given", lambda x: F.struct(x["_source"].alias("s"), x["b"].alias("b"), unit(x).alias("w"), (x["weight"] > 0).alias("has"))).alias("every"))
    one = whole.select("every", F.posexplode("every").alias("idx", "own")).select(
        "idx", "own", F.filter("every", lambda k: k["has"] == F.col("own.has")).alias("peers"),
        F.when(F.col("own.has"), F.lit(0)).otherwise(F.aggregate("every", F.lit(0).cast("long"), lambda a, k: a + F.when(k["has"], k["b"]).otherwise(0))).cast("long").alias("after"),
    ).repartition(common.shuffle_parts(sizes.sparkSession), "idx")
    block = one.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own.b"))).alias("nth"))
    big = lambda c: c.cast("decimal(19,0)")

    def reached(j: Column) -> tuple[Column, Column]:
        """Blocks of the sources that are done by the time of j blocks, and the weight of the others times j."""
        done = lambda k: big(k["b"]) * big(F.col("own.w")) <= big(k["w"]) * big(j)
        had = F.aggregate("peers", F.lit(0).cast("long"), lambda a, k: a + F.when(done(k), k["b"]).otherwise(0))
        rest = F.aggregate("peers", F.lit(0).cast("long"), lambda a, k: a + F.when(done(k), 0).otherwise(k["w"]))
        return had, big(rest) * big(j)

    parted = block.select("idx", F.col("own.s").alias("_source"), F.col("own.w").alias("w"), "after", "nth", *[c.alias(n) for j, names in ((F.col("nth") - 1, ("r_had", "r_part")), (F.col("nth"), ("d_had", "d_part"))) for c, n in zip(reached(j), names, strict=True)])
    return parted.select(
        "_source", "idx", "nth", F.expr("after + r_had + r_part div w").alias("release"), F.expr("after + d_had + (d_part + w - 1) div w").alias("deadline")
    )


def earliest_deadline_first(jobs: DataFrame, total: int) -> DataFrame:
    """slot, deadline, idx, nth, release: of the released blocks that wait, each slot serves the one due first (then by idx)."""
    spark = jobs.sparkSession
    rows = jobs.select(F.col("release").alias("slot"), F.struct("deadline", "idx", "nth", "release").alias("job"))
    rows = rows.unionByName(spark.range(total).select(F.col("id").alias("slot"), F.lit(None).cast(JOB).alias("job")))
    steps = rows.groupBy("slot").agg(F.array_sort(F.collect_list("job")).alias("jobs"))
    chunks = steps.groupBy(F.expr(f"slot div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("slot", "jobs"))).alias("steps"))
    whole = chunks.agg(F.array_sort(F.collect_list(F.struct("chunk", "steps"))).alias("chunks"))
    none, unpicked = F.array().cast(f"array<{JOB}>"), F.array().cast(f"array<struct<slot:bigint,job:{JOB}>>")

    def step(state: Column, x: Column) -> Column:
        waiting = F.concat(state["waiting"], x["jobs"])
        pick = F.array_min(waiting)
        return F.struct(F.filter(waiting, lambda j: j != pick).alias("waiting"), F.array_append(state["picks"], F.struct(x["slot"].alias("slot"), pick.alias("job"))).alias("picks"))

    def chunk(state: Column, x: Column) -> Column:
        """The picks of the chunk before join the others here, so that each inner fold stands in the expression once."""
        begin = F.struct(state["last"]["waiting"].alias("waiting"), unpicked.alias("picks"))
        return F.struct(F.aggregate(x["steps"], begin, step).alias("last"), F.array_append(state["all"], state["last"]["picks"]).alias("all"))

    first = F.struct(F.struct(none.alias("waiting"), unpicked.alias("picks")).alias("last"), F.array().cast(f"array<array<struct<slot:bigint,job:{JOB}>>>").alias("all"))
    picks = whole.select(F.aggregate("chunks", first, chunk, lambda s: F.array_append(s["all"], s["last"]["picks"])).alias("all"))
    return picks.select(F.explode("all").alias("some")).select(F.explode("some").alias("p")).select("p.slot", "p.job.*")


def placed(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """_row (the input's columns), doc_id, _source, _block, _slot, _release, _deadline, _place (in the block).

    weights: _source, weight; left out, they follow the sources' sizes.
    """
    df = df.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    sizes = common.settle(df.groupBy(source_of().alias("_source")).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    each = max(BLOCK, -(-rows // SLOTS))
    total = sizes.agg(F.sum(F.ceil(F.col("n") / each))).first()[0] or 0
    jobs = common.settle(windows(sizes, weights, each), "mix-windows")
    plan = earliest_deadline_first(jobs, total).join(jobs.select("_source", "idx").distinct(), "idx")
    plan = common.settle(plan.select("_source", (F.col("nth") - 1).alias("_block"), F.col("slot").alias("_slot"), F.col("release").alias("_release"), F.col("deadline").alias("_deadline")), "mix-plan")
    blocks = ranked(df).withColumn("_block", F.floor(F.col("_rank") / each)).withColumn("_place", F.col("_rank") % each)
    found = blocks.join(F.broadcast(plan) if total <= BROADCAST_ROWS else plan, ["_source", "_block"])
    return found.select("_row", "doc_id", "_source", "_block", "_slot", "_release", "_deadline", "_place")


def interleave(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """All rows of ``df`` in the mixed order, columns unchanged."""
    n = common.shuffle_parts(df.sparkSession)
    order = ["_slot", "_place", "doc_id"]
    return placed(df, weights).repartitionByRange(n, *order).sortWithinPartitions(*order).select("_row.*")


def numbered(df: DataFrame, names: tuple[str, str] = ("slot", "place"), weights: DataFrame | None = None) -> DataFrame:
    """All rows of ``df`` with their slot and place in two columns, which replace such columns: the mixed order where files keep none."""
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c.lower() not in names]
    return placed(df, weights).select(*kept, F.col("_slot").alias(names[0]), F.col("_place").alias(names[1]))


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return placed(docs).select(
        "doc_id", F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_slot").alias("slot"),
        F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_place").alias("place"),
    )


ORACLE = f"""
WITH RECURSIVE src AS (SELECT coalesce(source, '') AS s, count(*) AS n, greatest({BLOCK}, ceil(sum(count(*)) OVER () / {SLOTS}))::BIGINT AS per FROM documents GROUP BY 1),
q AS (SELECT s, per, ceil(n / per)::BIGINT AS b, round(sqrt(n) / max(sqrt(n)) OVER () * {UNITS})::BIGINT AS w, row_number() OVER (ORDER BY s) - 1 AS i FROM src),
job AS (SELECT q.*, unnest(range(1, b + 1)) AS j FROM q),
win AS (SELECT job.s, job.i, j,
    sum(CASE WHEN k.b::HUGEINT * job.w <= k.w::HUGEINT * (j - 1) THEN k.b ELSE 0 END)::BIGINT + (sum(CASE WHEN k.b::HUGEINT * job.w <= k.w::HUGEINT * (j - 1) THEN 0 ELSE k.w END)::HUGEINT * (j - 1) // job.w)::BIGINT AS release,
    sum(CASE WHEN k.b::HUGEINT * job.w <= k.w::HUGEINT * j THEN k.b ELSE 0 END)::BIGINT + ((sum(CASE WHEN k.b::HUGEINT * job.w <= k.w::HUGEINT * j THEN 0 ELSE k.w END)::HUGEINT * j + job.w - 1) // job.w)::BIGINT AS deadline
  FROM job, q k GROUP BY job.s, job.i, j, job.w),
released AS (SELECT release, list({{'d': deadline, 'i': i, 'j': j, 'r': release}}) AS jobs FROM win GROUP BY release),
step AS (SELECT r.range AS slot, coalesce(jobs, []) AS jobs FROM range((SELECT count(*) FROM win)) r LEFT JOIN released ON release = r.range),
run(slot, waiting, pick) AS (
  SELECT -1::BIGINT, list_filter((SELECT any_value(jobs) FROM released), lambda x: false), (SELECT any_value(jobs[1]) FROM released)
  UNION ALL
  SELECT slot, list_filter(p, lambda x: x <> list_min(p)), list_min(p)
  FROM (SELECT step.slot, list_concat(waiting, jobs) AS p FROM run JOIN step ON step.slot = run.slot + 1)),
plan AS (SELECT slot, win.s, pick.j - 1 AS block, pick.r AS release, pick.d AS deadline FROM run JOIN win ON win.i = pick.i AND win.j = pick.j WHERE slot >= 0),
d AS (SELECT doc_id, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('{SEED}' || doc_id), doc_id) - 1 AS r FROM documents)
SELECT doc_id, d.s AS source, plan.block, slot, release, deadline, r % per AS place
FROM d JOIN q ON q.s = d.s JOIN plan ON plan.s = d.s AND plan.block = r // per
"""
