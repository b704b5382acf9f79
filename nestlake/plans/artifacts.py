"""Derived tables with provenance: what a table was made from, and whether it still holds.

Stamps are a small JSON file beside the table's data, written after it, so a table
without stamps is unfinished. All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactError

STAMPS = "_stamps.json"


@dataclass(frozen=True)
class Stamps:
    artifact: str
    version: str
    source_hash: str
    library: str = "1"
    chemistry: str = "text"
    dataset_id: str = ""

    def same(self, other: Stamps | None) -> bool:
        """All that decides the contents agrees; the dataset's id is a remark."""
        return other is not None and asdict(self) | {"dataset_id": ""} == asdict(other) | {"dataset_id": ""}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def glob_root(pattern: str) -> str:
    """The part of a pattern before its first wildcard, as a folder."""
    plain = []
    for part in pattern.split("/")[:-1]:
        if any(c in part for c in "*?[{"):
            break
        plain.append(part)
    return "/".join(plain)


def output_path(source: str, root: str, out: str) -> str:
    """The source's place under ``root``, mirrored under ``out``."""
    at = source.find(root.rstrip("/") + "/") if root else 0
    if at < 0:
        raise ArtifactError(f"{source} is not under {root}")
    return f"{out.rstrip('/')}/{source[at + len(root):].lstrip('/')}"


def read_stamps(spark: SparkSession, path: str) -> Stamps | None:
    """None where the path is no finished artifact."""
    at = f"{path.rstrip('/')}/{STAMPS}"
    if not exists(spark, at):
        return None
    fs, p = _fs(spark, at)
    stream = fs.open(p)
    try:
        # Spark's readers skip names that begin with an underscore.
        return Stamps(**json.loads(spark.sparkContext._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()))
    except (ValueError, TypeError):
        return None
    finally:
        stream.close()


def write_artifact(df: DataFrame, path: str, stamps: Stamps, overwrite: bool = False) -> None:
    """Data first, stamps last. What is no artifact is never overwritten."""
    spark = df.sparkSession
    if exists(spark, path):
        if read_stamps(spark, path) is None:
            raise ArtifactError(f"{path} is no artifact and stays")
        if not overwrite:
            raise ArtifactError(f"{path} exists")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    write_stamps(spark, path, stamps)


def write_stamps(spark: SparkSession, path: str, stamps: Stamps) -> None:
    fs, p = _fs(spark, f"{path.rstrip('/')}/{STAMPS}")
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(asdict(stamps)).encode()))
    stream.close()


def is_current(spark: SparkSession, path: str, stamps: Stamps, columns: set[str] = frozenset()) -> bool:
    """Stamps agree, and no expected column is missing."""
    if not stamps.same(read_stamps(spark, path)):
        return False
    return not columns or columns <= set(spark.read.parquet(path).columns)


def content_hash(df: DataFrame) -> str:
    """Order-free hash of a table: count and two sums of row hashes."""
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}-{a or 0}-{b or 0}"


def derive_tree(
    spark: SparkSession, pattern: str, out: str, artifact: str, version: str, make: Callable[[DataFrame], DataFrame],
    hash_of: Callable[[str], str] | None = None, force: bool = False, parent: str | None = None, columns: set[str] = frozenset(),
) -> tuple[list[str], list[str], list[str]]:
    """(written, skipped, ignored): one table for each source that matches, mirrored under ``out``.

    Current tables are skipped. With ``parent`` only finished artifacts of that kind are
    sources, and their source's hash is passed on.
    """
    written, skipped, ignored = [], [], []
    root = glob_root(pattern)
    for source in glob(spark, pattern):
        stamps = read_stamps(spark, source)
        if parent is not None:
            if stamps is None or stamps.artifact != parent:
                ignored.append(source)
                continue
            digest = stamps.source_hash
        else:
            digest = hash_of(source) if hash_of else content_hash(spark.read.parquet(source))
        target = output_path(source, root, out)
        own = Stamps(artifact, version, digest, dataset_id=stamps.dataset_id if stamps else "")
        if not force and is_current(spark, target, own, columns):
            skipped.append(source)
            continue
        write_artifact(make(spark.read.parquet(source)), target, own, overwrite=True)
        written.append(source)
    return written, skipped, ignored


def paired(spark: SparkSession, left: list[str], right: list[str]) -> list[tuple[str, str]]:
    """Artifacts of two kinds matched by their source's hash; anything unmatched or doubled is refused."""

    def by_hash(paths: list[str]) -> dict[str, str]:
        out: dict[str, str] = {}
        for p in paths:
            stamps = read_stamps(spark, p)
            if stamps is None:
                raise ArtifactError(f"{p} is no artifact")
            if stamps.source_hash in out:
                raise ArtifactError(f"{p} and {out[stamps.source_hash]} have one source")
            out[stamps.source_hash] = p
        return out

    a, b = by_hash(left), by_hash(right)
    if lone := sorted(a[h] for h in a.keys() - b.keys()) + sorted(b[h] for h in b.keys() - a.keys()):
        raise ArtifactError(f"without a partner: {', '.join(lone)}")
    return [(a[h], b[h]) for h in sorted(a, key=a.__getitem__)]
