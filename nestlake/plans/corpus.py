"""A corpus: paired projections and structures, published for search.

Each projection numbers its structures from 0; offsets make the numbers global. Pivots
and the occurrence index are made on first use and kept; match sets of recent structure
predicates are kept in a small cache. All of them are DataFrames that Spark spills or
recomputes as it likes.
"""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactError, QueryError
from ..functions.chem import Chemistry, available
from ..operators import pivot as pivots
from ..operators import structures as st
from ..schema import describe, level
from .artifacts import paired
from .compiler import Compiler
from .grammar import Node, Query, compounds, parse_query

CACHED_MATCHES = 16


class Corpus:
    """``parts``: (projection, structures or None) for each dataset, in a fixed order."""

    def __init__(self, parts: list[tuple[DataFrame, DataFrame | None]], id_column: str, chemistry: Chemistry | None = None, resolver: Callable[[str], str] | None = None):
        if not parts:
            raise ArtifactError("an empty corpus")
        self.id, self.chemistry, self.resolver = id_column, chemistry or available(), resolver
        self.lock = threading.RLock()
        self.sizes = [0 if s is None else s.select("structure_id").count() for _, s in parts]
        starts = [sum(self.sizes[:i]) for i in range(len(parts))]
        self.structured = any(s is not None for _, s in parts)
        records, library = None, None
        for (projection, structures), start, size in zip(parts, starts, self.sizes, strict=True):
            part = projection.withColumn("_structure_offset", F.lit(start).cast("long"))
            records = part if records is None else records.unionByName(part)
            if structures is not None:
                self._check_pair(projection, structures, size)
                rows = structures.withColumn("global_id", F.col("structure_id") + F.lit(start))
                library = rows if library is None else library.unionByName(rows)
        self.records, self.library = records, library
        self._pivots: dict[str, DataFrame] = {}
        self._given: dict[str, DataFrame] = {}
        self._occurrences: DataFrame | None = None
        self._matches: OrderedDict[tuple, DataFrame] = OrderedDict()

    @classmethod
    def published(cls, spark: SparkSession, projections: list[str], structures: list[str], id_column: str, chemistry: Chemistry | None = None, resolver: Callable[[str], str] | None = None) -> Corpus:
        """A corpus of written artifacts, paired by their source. Sizes come from the files' footers."""
        parts = [(spark.read.parquet(a), spark.read.parquet(b)) for a, b in paired(spark, projections, structures)]
        return cls(parts, id_column, chemistry, resolver)

    @property
    def spark(self) -> SparkSession:
        return self.records.sparkSession

    def _check_pair(self, projection: DataFrame, structures: DataFrame, size: int) -> None:
        """Every number a projection uses is a row of its structures."""
        if pivots.structure_paths(projection.schema):
            most = st.pairs(projection).agg(F.max("structure_id")).first()[0]
            if most is not None and most >= size:
                raise ArtifactError(f"the projection refers to structure {most}, but there are {size}")

    # ---- what the compiler asks for

    def add_pivot(self, path: str, df: DataFrame) -> None:
        """Use a written pivot instead of making one."""
        level(path, self.records.schema)
        with self.lock:
            self._given[path] = df

    def pivot(self, path: str) -> DataFrame | None:
        with self.lock:
            if path in self._given:
                return self._given[path]
            if path not in self._pivots:
                self._pivots[path] = pivots.pivot(self.records, path, self.id, "_structure_offset")
            return self._pivots[path]

    def occurrences(self) -> DataFrame | None:
        if not self.structured:
            return None
        with self.lock:
            if self._occurrences is None:
                paths = pivots.structure_paths(self.records.schema)
                made = pivots.occurrences(self.records, self.id, paths, "_structure_offset")
                self._occurrences = made.repartition("global_id").persist()
            return self._occurrences

    def matches(self, node: Node) -> DataFrame:
        if self.library is None:
            raise QueryError("this corpus has no structures")
        key = (node.op, node.pattern, node.compound is not None, node.threshold)
        with self.lock:
            if key in self._matches:
                self._matches.move_to_end(key)
                return self._matches[key]
            found = self._search(node).distinct().persist()
            self._matches[key] = found
            if len(self._matches) > CACHED_MATCHES:
                self._matches.popitem(last=False)[1].unpersist()
            return found

    def _search(self, node: Node) -> DataFrame:
        if node.op == "similarity":
            return st.similar(self.library, node.pattern, node.threshold, self.chemistry)
        if node.op == "substructure":
            return st.containing(self.library, node.pattern, self.chemistry)
        return st.same(self.library, node.pattern, self.chemistry, parent=node.op == "same_parent")

    def record_hits(self, node: Node) -> DataFrame:
        """id, hits: the matching structures of each record that has any. No match set leaves the executors."""
        places = self._occurrences
        if places is None:
            paths = pivots.structure_paths(self.records.schema)
            places = pivots.occurrence_rows(self.records, self.id, paths, "_structure_offset")
        met = places.join(self.matches(node), "global_id", "left_semi")
        return met.groupBy(self.id).agg(F.collect_set("global_id").alias("hits"))

    # ---- use

    def describe(self) -> str:
        return describe(self.records.drop("_structure_offset").schema)

    def bind(self, query: Query) -> dict[str, str]:
        out = {}
        for name in compounds(query):
            if self.resolver is None:
                raise QueryError(f"no resolver for {name!r}")
            out[name] = self.chemistry.canonical(self.resolver(name))
        return out

    def compile(self, query: dict | str | Query, route: str = "auto") -> DataFrame:
        parsed = parse_query(query, self.chemistry)
        compiler = Compiler(self.records, self.id, self, route, self.bind(parsed), "_structure_offset")
        out = compiler.run(parsed)
        self.last_routes = compiler.routes
        return out

    def search(self, query: dict | str | Query, route: str = "auto", timeout: float | None = None):
        """The answer as an Arrow table. ``timeout`` covers the final job and raises TimeoutError."""
        df = self.compile(query, route)
        return timed(self.spark, df.toArrow, timeout)

    def check_pivots(self) -> dict[str, int]:
        """Rows of each written pivot; refuses records that the corpus does not have."""
        out = {}
        for path, df in self._given.items():
            strange = df.select(self.id).distinct().join(self.records.select(self.id), self.id, "left_anti").limit(1).collect()
            if strange:
                raise ArtifactError(f"pivot {path!r} has a record that the corpus lacks: {strange[0][0]!r}")
            out[path] = df.count()
        return out

    def check_index(self) -> dict[str, int]:
        """Occurrences by path; refuses an index that misses a structure."""
        index = self.occurrences()
        seen, total = index.agg(F.countDistinct("global_id")).first()[0], sum(self.sizes)
        if seen != total:
            raise ArtifactError(f"the index reaches {seen} of {total} structures")
        return {r["path"]: r["count"] for r in index.groupBy("path").count().collect()}


def timed(spark: SparkSession, action: Callable, timeout: float | None):
    """Run an action under a job tag that a timer cancels."""
    if timeout is None:
        return action()
    tag = f"search-{threading.get_ident()}-{id(action)}"
    fired = threading.Event()

    def stop() -> None:
        fired.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as error:
        if fired.is_set():
            raise TimeoutError(f"no answer within {timeout} s") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
