"""Source datasets: Parquet files of (record id, serialised record) with scalars in the footer.

The engine never decodes a blob to filter by id, count or hash; decoding happens in
Arrow batches on the executors (see sources.messages).
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "1"


@dataclass(frozen=True)
class Layout:
    """Names in the file. ``prefix`` begins the footer keys."""

    prefix: str = "dataset."
    id: str = "record_id"
    blob: str = "record"

    def schema(self) -> pa.Schema:
        return pa.schema([pa.field(self.id, pa.string(), False), pa.field(self.blob, pa.binary(), False)])


@dataclass(frozen=True)
class Scalars:
    name: str
    description: str
    dataset_id: str = ""


def read_scalars(metadata: dict[bytes, bytes] | None, layout: Layout) -> Scalars:
    get = lambda k: (metadata or {}).get((layout.prefix + k).encode(), b"").decode()
    if get("schema_version") != VERSION:
        raise ValueError(f"schema version {get('schema_version')!r} is not {VERSION!r}")
    for needed in ("name", "description"):
        if not get(needed):
            raise ValueError(f"the footer lacks {needed}")
    return Scalars(get("name"), get("description"), get("dataset_id"))


@contextlib.contextmanager
def atomic(path: str) -> Iterator[str]:
    """A sibling path that replaces ``path`` if the block succeeds, and vanishes if not."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.")
    os.close(handle)
    try:
        yield temporary
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)
        raise


class Writer:
    """Buffered row groups; the file appears when the block ends without an error."""

    def __init__(self, path: str, scalars: Scalars, layout: Layout = Layout(), compression: str = "zstd", row_group: int = 1000):
        if not scalars.name or not scalars.description:
            raise ValueError("a dataset has a name and a description")
        self.path, self.layout, self.row_group = path, layout, row_group
        meta = {"schema_version": VERSION, "name": scalars.name, "description": scalars.description} | ({"dataset_id": scalars.dataset_id} if scalars.dataset_id else {})
        self.schema = layout.schema().with_metadata({layout.prefix + k: v for k, v in meta.items()})
        self.compression, self.rows, self.stack = compression, [], contextlib.ExitStack()

    def __enter__(self) -> Writer:
        self.writer = pq.ParquetWriter(self.stack.enter_context(atomic(self.path)), self.schema, compression=self.compression)
        return self

    def write(self, record_id: str, blob: bytes) -> None:
        self.rows.append((record_id, blob))
        if len(self.rows) >= self.row_group:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            ids, blobs = zip(*self.rows, strict=True)
            self.writer.write_table(pa.table([pa.array(ids), pa.array(blobs, pa.binary())], schema=self.schema))
            self.rows = []

    def __exit__(self, *error) -> None:
        if error[0] is None:
            self._flush()
        self.writer.close()
        self.stack.__exit__(*error)


def save(path: str, scalars: Scalars, rows: Iterable[tuple[str, bytes]], layout: Layout = Layout(), **options) -> None:
    rows = iter(rows)
    first = next(rows, None)
    if first is None:
        raise ValueError("a dataset has at least one record")
    with Writer(path, scalars, layout, **options) as out:
        out.write(*first)
        for row in rows:
            out.write(*row)


class Dataset:
    """Lazy view of one file. Positions are those of the file."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout = Layout()):
        self.spark, self.path, self.layout = spark, path, layout
        file = pq.ParquetFile(path)
        self.scalars = read_scalars(file.schema_arrow.metadata, layout)
        self.groups = [file.metadata.row_group(i).num_rows for i in range(file.metadata.num_row_groups)]

    def __len__(self) -> int:
        return sum(self.groups)

    def __bool__(self) -> bool:
        return len(self) > 0

    @property
    def frame(self) -> DataFrame:
        """id, blob and the row's position in the file."""
        return self.spark.read.parquet(self.path).select(self.layout.id, self.layout.blob, F.col("_metadata.row_index").alias("position"))

    def ids(self) -> DataFrame:
        """One-column scan."""
        return self.spark.read.parquet(self.path).select(self.layout.id)

    def rows(self, ids: list[str] | DataFrame | None = None, row_group: int | None = None) -> DataFrame:
        """All rows, or those with given ids (unknown ones are skipped), or those of a row group."""
        out = self.frame
        if ids is not None:
            if isinstance(ids, DataFrame):
                out = out.join(ids.select(self.layout.id).distinct(), self.layout.id, "left_semi")
            elif not ids:
                raise ValueError("an empty list of ids selects nothing; leave it out to select all")
            else:
                out = out.filter(F.col(self.layout.id).isin(list(ids)))
        if row_group is not None:
            if not 0 <= row_group < len(self.groups):
                raise IndexError(f"row group {row_group} of {len(self.groups)}")
            start = sum(self.groups[:row_group])
            out = out.filter(F.col("position").between(start, start + self.groups[row_group] - 1))
        return out

    def get(self, record_id: str) -> bytes:
        """Blob of the first row with that id."""
        found = self.frame.filter(F.col(self.layout.id) == record_id).agg(F.min_by(self.layout.blob, "position")).first()[0]
        if found is None:
            raise KeyError(record_id)
        return bytes(found)

    def __getitem__(self, at: int | slice):
        if isinstance(at, slice):
            wanted = range(*at.indices(len(self)))
            if not wanted:
                return []
            lo, hi = min(wanted), max(wanted)
            rows = self.frame.filter(F.col("position").between(lo, hi) & ((F.col("position") - wanted.start) % abs(wanted.step) == 0)).collect()
            held = {r["position"]: bytes(r[self.layout.blob]) for r in rows}
            return [held[i] for i in wanted]
        if isinstance(at, bool) or not isinstance(at, int):
            raise TypeError(f"positions are integers or slices, not {type(at).__name__}")
        i = at + len(self) if at < 0 else at
        if not 0 <= i < len(self):
            raise IndexError(at)
        return bytes(self.frame.filter(F.col("position") == i).first()[self.layout.blob])

    def md5(self) -> str:
        """Hash of scalars and length-prefixed blobs in file order: the same for any row group size.

        The order is part of it, so rows stream through the driver one partition at a time.
        """
        total = hashlib.md5()
        for part in (self.scalars.name, self.scalars.description, self.scalars.dataset_id):
            _update(total, part.encode())
        for row in self.frame.orderBy("position").toLocalIterator():
            _update(total, row[self.layout.id].encode())
            _update(total, bytes(row[self.layout.blob]))
        return total.hexdigest()


def _update(total, data: bytes) -> None:
    total.update(len(data).to_bytes(8, "little"))
    total.update(data)


def concatenated(spark: SparkSession, paths: list[str], layout: Layout = Layout()) -> DataFrame:
    """Rows of several files with their file and position; refuses none at all."""
    out = spark.read.parquet(*paths).select(layout.id, layout.blob, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position"))
    if out.limit(1).count() == 0:
        raise ValueError("no rows")
    return out


def combined(spark: SparkSession, paths: list[str], out: str, layout: Layout = Layout(), **overrides: str) -> Scalars:
    """One dataset of several, in their order. Scalars that differ come from the first, with a warning, unless given."""
    parts = [Dataset(spark, p, layout) for p in paths]
    if not parts:
        raise ValueError("no datasets")
    made = {}
    for name in ("name", "description", "dataset_id"):
        held = [getattr(p.scalars, name) for p in parts]
        if name not in overrides and len(set(held)) > 1:
            warnings.warn(f"{name} differs: {sorted(set(held))}; {held[0]!r} is kept", stacklevel=2)
        made[name] = overrides.get(name, held[0])
    rows = ((r[layout.id], bytes(r[layout.blob])) for p in parts for r in p.frame.orderBy("position").toLocalIterator())
    save(out, scalars := Scalars(**made), rows, layout)
    return scalars


def decoded(rows: DataFrame, decode: Callable[[bytes], dict], schema: str, layout: Layout = Layout()) -> DataFrame:
    """Blobs as records. ``decode`` runs on the executors, batch by batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decode(b) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m.get(f.name) for m in made], f.type) for f in arrow], schema=arrow)

    return rows.select(layout.blob).mapInArrow(run, kind)


def footer_maximum(path: str, column: str) -> int | None:
    """Maximum of a column from row-group statistics, without reading data."""
    meta = pq.ParquetFile(path).metadata
    at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == column)
    found = [s.max for g in range(meta.num_row_groups) if (s := meta.row_group(g).column(at).statistics) is not None and s.has_min_max]
    return max(found, default=None)


def shard_path(name: str) -> str:
    """data/<two characters of the id>/<name>, for names without folders."""
    stem = os.path.basename(name)
    if stem != name or stem in ("", ".", ".."):
        raise ValueError(f"not a plain file name: {name!r}")
    part = stem.split(".")[0].rpartition("-")[2][:2]
    if len(part) < 2:
        raise ValueError(f"no id in {name!r}")
    return os.path.join("data", part, stem)


def first_rows(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with one key the first by position."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(position))).filter("_n = 1").drop("_n")
