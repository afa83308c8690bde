"""The corpus pipeline: what its stages keep, and that they chain."""

from __future__ import annotations

import corpus_pipeline
from faciesforge.llm import quality
from faciesforge.llm._util import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, SF), name)
        assert out.columns == columns
        kept = {r[0] for r in out.select("doc_id").collect()}
        assert kept <= {r[0] for r in docs.select("doc_id").collect()} and 0 < len(kept) <= before
        if name == "language_id":
            assert len(kept) >= 0.98 * before
        if name == "quality":
            good = docs.join(labels.filter("quality = 1"), "doc_id").select("doc_id").collect()
            assert sum(r[0] in kept for r in good) >= 0.95 * len(good)
        docs, before = out, len(kept)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} == kept


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(fill.values()) <= 2048


def test_stages_take_an_empty_table(spark):
    docs = cut(spark.read.parquet(f"{SF}/documents.parquet").limit(0), "none")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
    assert quality.THRESHOLD == 0.3
