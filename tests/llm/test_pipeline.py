"""The pipeline against its stages done by hand."""

import hashlib
import re

import pytest

import corpus_pipeline
from nestlake.llm import bpe, common, mixing, toxicity
from test_operators import naive_components, utf8

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("which", ["tables", "some"])
def test_pipeline_equals_its_stages_by_hand(spark, tables, which):
    d = SF if which == "tables" else tables["some"]
    docs = common.table(spark, d, "documents")
    toxic = {r.doc_id for r in toxicity.report(docs, common.table(spark, d, "labels")).filter("predicted = 1").collect()}
    left = {}
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        if r.doc_id not in toxic:
            left.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), (r.doc_id, r.text))
    near = naive_components(list(left.values()), 5)
    want = {i: t for i, t in left.values() if near[i][1] == i}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(want)
    kept = docs.filter(docs.doc_id.isin(list(want))).dropDuplicates(["doc_id"])
    order = [r.doc_id for r in mixing.interleave(kept).collect()]  # the order of the mix reaches the end
    assert [i for i, r in sorted(got.items(), key=lambda x: (x[1].slot, x[1].place))] == order
    codec = bpe.codec(*bpe.vocabulary())
    for i, t in want.items():
        assert codec.decode_bytes(got[i].ids) == utf8(t) and got[i].decoded_sha256 == hashlib.sha256(utf8(t)).hexdigest() and got[i].n_tokens == len(got[i].ids)


def test_stages_keep_the_columns_of_documents(spark, tables):
    for d in tables.values():
        docs = common.table(spark, d, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()
