"""Exact deduplication by composable polynomial fingerprints.

A text, white space normalised, is a number in base x modulo a prime. Chunk hashes
combine: H(ab) = H(a) * x^len(b) + H(b), so the chunks of a huge document are hashed
side by side (one matrix product) and folded by length-shifted arithmetic. Two primes
give 62 bits. Texts with equal fingerprint and length are then compared chunk by chunk
in a sorted stream that holds one representative for each different text.

No group meets in one task: a group of n members is dealt over n / GROUP salts, each
salt elects representatives, and these are compared again until one salt is left.

Defined results: a null text counts as empty, and empty texts are copies of each other; very
long texts are hashed and compared in chunks; of equal texts the smallest doc_id stays; rows
that repeat a doc_id *and* its text (ties) count in group_size, come back as often as they
came, and one of them is kept; a row without doc_id is a copy of nothing: keep_id null, group
size 1, kept; an empty table gives no rows; other columns of the input are ignored by the
report and returned unchanged by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
#: Members of a group that one salt compares.
GROUP = 64

SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def normalise(text: bytes) -> bytes:
    """Each run of the six ASCII white-space characters becomes one space."""
    text = text.translate(SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def powers(base: int, prime: int, n: int = CHUNK) -> np.ndarray:
    """x^(n-1) ... x^0, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        shift = np.uint64(pow(base, len(out), prime))
        out = np.concatenate([out * shift % np.uint64(prime), out])
    return out[len(out) - n :]


POWERS = tuple(powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))


def combine(left: int, right: int, right_len: int, k: int) -> int:
    """Hash of a concatenation from the hashes of its parts, for prime ``k``."""
    return (left * pow(BASES[k], right_len, PRIMES[k]) + right) % PRIMES[k]


def fingerprint(text: bytes) -> int:
    """62 bits; each byte counts as its value plus one, so that leading zeros matter."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    head = len(data) % CHUNK
    out = []
    for k, prime in enumerate(PRIMES):
        whole = int(data[:head] @ POWERS[k][CHUNK - head :]) % prime if head else 0
        for chunk in (data[head:].reshape(-1, CHUNK) @ POWERS[k]).tolist() if len(data) >= CHUNK else ():
            whole = combine(whole, chunk % prime, CHUNK, k)
        out.append(whole)
    return out[0] << 31 | out[1]


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison that stops at the first difference."""
    if len(a) != len(b):
        return False
    left, right = memoryview(a), memoryview(b)
    return all(left[i : i + CHUNK] == right[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, fp, n_bytes, text_sha256 of each row's normalised text."""
    common.arrow_rows(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalise(t) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([fingerprint(t) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                ["doc_id", "fp", "n_bytes", "text_sha256"],
            )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, fp long, n_bytes long, text_sha256 string"
    )


def compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, n_bytes, salt, doc_id): the first row with a text represents its equals."""
    key, chosen = None, []
    for batch in batches:
        fps, sizes, salts, ids = (batch.column(i).to_pylist() for i in range(4))
        out: list[tuple] = []
        for fp, n, salt, doc, text in zip(fps, sizes, salts, ids, raw(batch.column(4)), strict=True):
            if key != (fp, n, salt):
                key, chosen = (fp, n, salt), []
            text = normalise(text)
            if len(text) != n or fingerprint(text) != fp:
                continue  # another text under the same doc_id
            rep = next((r for r, t in chosen if same(t, text)), None)
            if rep is None:
                rep = doc
                chosen.append((doc, text))
            out.append((fp, n, doc, rep))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["fp", "n_bytes", "doc_id", "rep"])


def compared(members: DataFrame) -> DataFrame:
    """members: fp, n_bytes, doc_id, size, text, text_sha256 of all groups. Returns fp, n_bytes, doc_id, rep.

    Each level leaves one of GROUP equal texts. Where one does not halve the largest group, its texts differ
    (fingerprints can be forged): a last level then deals them by their digest, so equal texts meet.
    """
    key = ["fp", "n_bytes"]
    order = [*key, "salt", "doc_id"]
    links, before = None, None
    while True:
        most = members.agg(F.max("size")).first()[0] or 0
        stuck = before is not None and most > before // 2
        dealt = members.withColumn("salt", F.pmod(F.xxhash64("text_sha256" if stuck else "doc_id"), F.ceil(F.col("size") / GROUP)))
        before = most
        step = common.settle(
            dealt.select(*order, "text")
            .repartition(common.shuffle_parts(members.sparkSession), *key, "salt")
            .sortWithinPartitions(*order)
            .mapInArrow(compare_sorted, "fp long, n_bytes long, doc_id long, rep long")
            .dropDuplicates(),
            "exact-links",
        )
        if links is None:
            links = step
        else:
            ahead = step.select(*key, F.col("doc_id").alias("rep"), F.col("rep").alias("next"))
            links = links.join(ahead, [*key, "rep"]).select(*key, "doc_id", F.col("next").alias("rep"))
        if most <= GROUP or stuck:
            return links
        reps = step.filter("doc_id = rep").select(*key, "doc_id")
        left = common.settle(reps.groupBy(*key).agg(F.count(F.lit(1)).alias("size")), "exact-left")
        members = members.drop("size").join(reps, [*key, "doc_id"], "left_semi").join(left, key)


def report(df: DataFrame) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    key = ["fp", "n_bytes"]
    nameless = fingerprints(df.filter("doc_id is null")).select(
        "doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    df = df.filter("doc_id is not null")
    each = common.settle(
        fingerprints(df).groupBy("doc_id", *key, "text_sha256").agg(F.count(F.lit(1)).alias("times")), "exact-fp"
    )
    # Group sizes are written first: beside a plain scan a join on a hot fingerprint can be split.
    shared = common.settle(each.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "exact-shared")
    wanted = each.join(shared, key).select(*key, "doc_id", "size", "text_sha256")
    # Only members of groups bring their texts; the texts are cut from the source once.
    members = common.settle(df.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id"), "exact-members")
    named = common.settle(
        each.join(compared(members), [*key, "doc_id"], "left").withColumn("keep_id", F.coalesce("rep", "doc_id")).drop("rep"),
        "exact-named",
    )
    groups = named.groupBy(*key, "keep_id").agg(F.sum("times").alias("group_size")).filter("group_size > 1")
    return (
        named.join(common.settle(groups, "exact-groups"), [*key, "keep_id"], "left")
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            ((F.col("doc_id") == F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            "text_sha256",
        )
        .unionByName(nameless)
    )


def deduplicate(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, all columns unchanged.

    Dropped are rows whose (doc_id, text) another document already has. The list of
    dropped ids is the small side; a repeated row (same doc_id and text) stays once.
    """
    judged = report(df)
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    gone = common.settle(gone.filter("not stays or rows > 1"), "exact-gone")
    columns = [F.col(f"`{c}`") for c in df.columns]
    plain = df.join(gone.select("doc_id"), "doc_id", "left_anti").select(*columns)
    # doc_ids that occur more than once are rare; settle each of their texts by itself.
    digest = common.free("_digest", df)
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    again = df.join(gone.filter("stays").select("doc_id"), "doc_id", "left_semi").withColumn(digest, F.sha2(normal, 256))
    held = judged.filter("kept").select("doc_id", F.col("text_sha256").alias(digest))
    again = again.join(held, ["doc_id", digest], "left_semi").dropDuplicates(["doc_id", digest]).select(*columns)
    return plain.unionByName(again)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS nth
  FROM t
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
