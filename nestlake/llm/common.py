"""What several operators share: reading tables, the shared folder, column checks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Long documents make batches of tens of MB at most.
ARROW_ROWS = 1000


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on and serve later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches that Python stages of this session receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, notebooks) a local one is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Open scratch scopes, each with the folders written in it.
_scopes: list[list[str]] = []


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    This cuts the lineage with files that outlive any executor. Inside ``scratch`` the
    files go when the scope ends, else they stay as long as the shared folder does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose settled tables are deleted at its end, but for those it settles with the function it gives.

    Those belong to the scope around it.
    """
    own: list[str] = []
    outer = _scopes[-1] if _scopes else None
    _scopes.append(own)

    def keep(df: DataFrame, tag: str) -> DataFrame:
        kept = settle(df, tag)
        path = own.pop()
        if outer is not None:
            outer.append(path)
        return kept

    try:
        yield keep
    finally:
        _scopes.pop()
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def free(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale or script."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """Partitions so that each holds about ``each`` of ``rows``."""
    return max(least, -(-rows // each))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
