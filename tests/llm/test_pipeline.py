import os

import pytest

import corpus_pipeline
from lumenrel.llm import bwt_dedup, compression_rules, simhash


@pytest.fixture(scope="module")
def folder(odd_docs, no_docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    odd_docs.write.parquet(str(at / "odd" / "documents.parquet"))
    no_docs.write.parquet(str(at / "none" / "documents.parquet"))
    return at


def test_stages_in_turn(spark, folder):
    d = os.path.join(folder, "odd")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, d)
    assert first.columns == docs.columns and first.count() == compression_rules.measure(docs).where("kept").count()
    second = corpus_pipeline.near_copies(spark, first, d)
    parts = simhash.near_copies(first).where("doc_id = component_id").select("doc_id").distinct().count()
    assert second.columns == docs.columns and second.where("doc_id is not null").count() == parts
    third = corpus_pipeline.repeats(spark, second, d)
    kept = {r.doc_id: r for r in bwt_dedup.spans(second).collect()}
    for r in third.select("doc_id", "text", "n_chars").collect():
        assert r.n_chars == len(r.text) and len(r.text.encode()) <= kept[r.doc_id].n_bytes - kept[r.doc_id].n_removed
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in third.collect()} and out.where("not round_trip and not contains(text, '▁')").count() == 0


def test_empty(spark, folder):
    assert corpus_pipeline.run(spark, os.path.join(folder, "none")).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "repeats", "mixing", "pieces"]
