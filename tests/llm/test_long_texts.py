"""A text of some megabytes, and odd rows beside it, through every numbered operator and every stage."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tarnflow.llm import decontaminate, fm_index, licenses, line_dedup, minhash, mixing, suffix_array, superminhash, toxicity, url_filter
from tarnflow.session import ship_package

from . import brute
from .fixtures import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [rng.choice(VOCABULARY) + str(rng.randrange(1000)) for _ in range(150_000)]
    item = " ".join(f"item{i}" for i in range(30))
    long = " ".join(words[:70_000]) + " " + item + "\n" + "common line of many sites\n" + " ".join(words[70_000:])
    texts = [long, long.replace(words[5], "changed", 1), "head " + " ".join(words[100_000:100_060]) + " tail", None, "", "common line of many sites", *["common line of many sites\nown words %d" % i for i in range(4)]]
    return [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_dedup_operators(rows, docs):
    got = {r.doc_id: r for r in suffix_array.drop_repeats(docs).collect()}
    assert got[0].n_bytes == len(rows[0][1]) and got[0].n_removed > 0.99 * got[0].n_bytes and got[2].n_removed > 400
    want = brute.earlier_words([(i, t) for i, t, *_ in rows])
    assert {r.doc_id: tuple(r)[1:] for r in fm_index.drop_repeats(docs).collect()} == want
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_dedup(docs, 85).collect()}
    assert near[1][1] == 0 and near[2][1] == 2 and near[0][0] == len(brute.shingles(rows[0][1]))
    assert {r.doc_id: r.component_id for r in minhash.near_groups(docs).collect()} == {i: c for i, (_, c) in near.items()}
    prints = {r.doc_id: r for r in minhash.fingerprint_edits(docs).collect()}
    assert prints[0].n_chars == len(rows[0][1]) and prints[0].edited_sha256 == sha(minhash.edited(rows[0][1], rows[1][1])) and prints[0].jaccard_next > 0.99 and prints[0].near_next > 0.9
    lines = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    assert lines[0] == rows[0][1] and lines[1] == rows[1][1].replace("common line of many sites\n", "") and lines[3] is None


def test_scoring_operators(spark, rows, docs):
    labels = spark.createDataFrame([(i, 1, int(i == 2)) for i in range(10)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == 10 and all(0 <= r.score <= 1 for r in scored)
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert found[0].canonical_sha256 == sha(licenses.canonical(rows[0][1])) and found[3].canonical_sha256 == sha("")
    bench = spark.createDataFrame([(7, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string")
    held = {(r.doc_id, r.item_id, r.start_word) for r in decontaminate.contamination(docs, bench).collect()}
    assert held == {(0, 7, 70_000), (1, 7, 70_000)}
    taken = mixing.mix(docs).collect()
    assert {r.doc_id for r in taken} == set(range(10))
    urls = spark.createDataFrame([(0, "http://a.com/" + "x/" * 1_000_000), (1, "http://b.net/es/" + "9" * 1_000_000), (2, "http://c.org/" + "k?&" * 300_000)], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_filter.filter_urls(urls).collect()} == {0: "com/", 1: "net/es/", 2: None}


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(7, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {name: sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).select("doc_id").collect()) for name, stage in corpus_pipeline.STAGES}
    assert left["toxicity"] == list(range(10)) and left["line dedup"] == [0, 1, 2, 3, 4, *range(6, 10)]
    assert left["near-dedup"] == [0, 2, *range(3, 10)] and left["decontamination"] == list(range(2, 10)) and set(left["mixing"]) == set(range(10))


def test_near_copies_of_null_and_repeated_ids_are_told_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1), "a"), (None, text(2), "b"), (5, text(3), "c"), (5, text(4), "d"), (5, text(4), "d"), (6, text(1), "e"), (7, text(5), "f"), (None, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    want = [(6, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (7, text(5)), (None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr) and np.array(got, dtype=object).shape == (6, 2)
