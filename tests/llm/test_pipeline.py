"""The pipeline's stages on a small corpus, each against a plain restatement."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnflow.llm import toxicity

from . import brute
from .fixtures import CLASHING, SCHEMA, VOCABULARY, corpus
from .test_dedup import lines_by_hand
from .test_scoring import all_windows, toxic_corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """documents, labels, benchmark: the small corpus, toxic rows, rows with benchmark passages."""
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(25))) for i in range(4)]
    rows = [(i, t, lang, s) for i, t, lang, s in corpus()]
    toxic, labels = toxic_corpus(500)
    rows += [(5000 + i, t, "en", f"src{i % 9}") for i, t in toxic]
    rows += [(9000 + i, f"{' '.join(rng.choice(VOCABULARY) for _ in range(30))} {items[i % 4][1]} end{i}", "en", "src1") for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = before, docs.collect()

    machine = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.score(spark.createDataFrame(before), machine).filter("score >= 0.3").collect()}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == bad and len(bad) > 50

    before, after = seen["line dedup"]
    want = lines_by_hand([(r.doc_id, r.text, r.lang, r.source) for r in before], 5)
    kept = {r.doc_id: r for r in after}
    for r in before:
        if r.doc_id in kept:
            assert len((r.text or "").split("\n")) - len((kept[r.doc_id].text or "").split("\n")) <= want[r.doc_id][1]
            assert kept[r.doc_id].text is None or kept[r.doc_id].n_chars == len(kept[r.doc_id].text)
        else:
            assert want[r.doc_id][1] > 0

    before, after = seen["near-dedup"]
    groups = brute.components([(r.doc_id, r.text) for r in before], corpus_pipeline.NEAR)
    assert {r.doc_id for r in after} == {i for i, (_, c) in groups.items() if c == i}

    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {d for (d, _), v in all_windows([(r.doc_id, r.text) for r in before], items).items() if v > 0.95}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert held <= gone and {9000 + i for i in range(8)} & {r.doc_id for r in before} <= gone and len(gone) <= len(held) + 1

    before, after = seen["mixing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_and_odd_rows(spark, sf_dir, tmp_path):
    d = str(tmp_path / "odd")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumns({c: F.lit("x") for c in CLASHING})
    odd.write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    out = corpus_pipeline.run(spark, d)
    ids = [r.doc_id for r in out.filter("mix_epoch = 0").collect()]
    assert len(ids) == len(set(ids)) > 5
    empty = str(tmp_path / "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
