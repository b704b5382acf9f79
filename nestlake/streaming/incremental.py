"""Incremental derivation as a stream: new source files are derived once, restarts resume.

The checkpoint remembers which files were read. Each micro-batch has a folder of its own
in the target (partition column ``batch``), which a replay after a crash replaces as a
whole; ids that other batches hold are dropped. So nothing is added twice, whatever the
moment of the crash, and rows without an id count once for each batch that reads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import incremental
from ..plans.artifacts import glob


def derive_stream(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, id_column: str, make: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000, once: bool = True,
) -> StreamingQuery:
    """Follow Parquet files under ``source`` and append what ``make`` derives to ``target``."""

    def batch(df: DataFrame, number: int) -> None:
        made = make(df.filter(F.col(id_column).isNotNull()).dropDuplicates([id_column]).unionByName(df.filter(F.col(id_column).isNull())))
        done = [p for p in glob(spark, f"{target}/batch=*") if int(p.rpartition("=")[2]) != number]
        if done:
            made = incremental(made, spark.read.parquet(*done), [id_column])
        made.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
