"""Readers chosen by a file's suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_spreadsheet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """xls and xlsx by pandas (an engine for them must be installed), anything else as CSV with a header."""
    if path.lower().endswith((".xls", ".xlsx")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path), schema)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    """One row for each element ``row_tag``; what cannot be read stays in _corrupt_record."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).load(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length of files, for payloads attached to records."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix in ("parquet", "orc"):
        return spark.read.format(suffix).load(path)
    if suffix in ("json", "jsonl", "ndjson"):
        return spark.read.json(path)
    return read_spreadsheet(spark, path)


#: How the files begin.
PARQUET, POINTER = b"PAR1", b"version https://git-lfs"


def inspected(spark: SparkSession, pattern: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(readable, [(path, why not)]) of the Parquet files that match, by their first and last bytes.

    The readable ones then go through one job, and a broken file does not stop the others.
    """
    from ..plans.artifacts import _fs

    fs, at = _fs(spark, pattern)
    good, bad = [], []
    for status in sorted(fs.globStatus(at) or [], key=lambda s: s.getPath().toString()):
        path, size = status.getPath().toString(), status.getLen()
        first, last = (_bytes(spark, path, start, n) for start, n in ((0, min(size, len(POINTER))), (max(size - len(PARQUET), 0), min(size, len(PARQUET)))))
        if first.startswith(POINTER):
            bad.append((path, "a pointer to large file storage, not the file itself"))
        elif size < 12:
            bad.append((path, "too short"))
        elif not first.startswith(PARQUET) or last != PARQUET:
            bad.append((path, "no Parquet file, or cut off"))
        else:
            good.append(path)
    return good, bad


def _bytes(spark: SparkSession, path: str, start: int, count: int) -> bytes:
    from ..plans.artifacts import _fs

    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        stream.seek(start)
        return bytes(b for b in (stream.read() for _ in range(count)) if b >= 0)
    finally:
        stream.close()
