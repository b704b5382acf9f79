import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import CLASHING, TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, copies, near copies, repeated rows, extra columns with clashing names."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in TEXTS]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, kind).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory, docs):
    """A folder with documents, labels and pages, and one where all are empty."""
    out = {}
    for name, keep in (("some", True), ("none", False)):
        d = str(tmp_path_factory.mktemp(name))
        cut = (lambda df: df) if keep else (lambda df: df.limit(0))
        cut(docs).write.parquet(f"{d}/documents.parquet")
        cut(spark.createDataFrame([(1, 1, 0), (17, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")).write.parquet(f"{d}/labels.parquet")
        urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/1?x=1#f"), (5, "https://www.example.com/en/2"), (5, "https://www.example.com/en/2"), (6, "http://q.net/es/"), (7, "http://com"), (8, "x://" + "h" * 50_000 + "/p")]
        cut(spark.createDataFrame([(*u, "x", "y") for u in urls], "page_id long, url string, html string, host string")).write.parquet(f"{d}/pages.parquet")
        out[name] = d
    return out
