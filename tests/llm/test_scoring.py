"""Toxicity, URL filter, licences, decontamination, mixing: known answers, odd rows and tables."""

import hashlib
import pathlib
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import decontaminate, licenses, mixing, toxicity, url_filter
from tarnflow.session import ship_package

from .fixtures import CLASHING, SCHEMA, VOCABULARY, corpus


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


# toxicity


def toxic_corpus(n=900, seed=1):
    """Toxic: an insult, and in half of the cases only an insult word with a group word."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(5, 60))]
        kind, label = rng.random(), 0
        if kind < 0.15:
            words.insert(rng.randrange(len(words)), "Scumlord,")
            label = 1
        elif kind < 0.35:
            words += ["vermin", "zorgs"]
            label = 1
        elif kind < 0.6:
            words.append(rng.choice(["vermin", "zorgs"]))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, label))
    return rows, labels


def test_machine_learns_words_and_pairs_of_words(spark):
    ship_package(spark)
    rows, labels = toxic_corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, marks)
    got = toxicity.score(docs, machine).withColumn("out", toxicity.held_out(F.col("doc_id"))).join(marks, "doc_id").filter("out").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_machine_learns_pairs_whose_words_tell_nothing():
    """Toxic if exactly one of two words is there, or only if both are: a word alone is as frequent in clean texts."""
    rng = random.Random(8)
    for toxic in (lambda a, b: a != b, lambda a, b: a == b):
        rows, labels = [], []
        for _ in range(4000):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            rows.append(np.array(sorted({*rng.sample(range(100, 400), 20), *([5] if a else []), *([6] if b else [])}), np.int32))
            labels.append(float(toxic(a, b)))
        labels = np.array(labels)
        machine = toxicity.fit(rows[:3000], labels[:3000])
        first = np.append(0, np.cumsum([len(r) for r in rows[3000:]]))
        got = machine.raw(np.concatenate(rows[3000:]).astype(np.uint64), first) > 0
        assert (got == (labels[3000:] == 1)).mean() > 0.97


def test_no_term_is_left_out_beforehand():
    rows = [np.array(x, np.int32) for x in ([1, 2, 3], [1, 2, 4], [2, 5], [1, 5])]
    machine = toxicity.fit(rows, np.array([1.0, 0, 0, 1]))
    assert sorted(np.flatnonzero(machine.index >= 0)) == [1, 2, 5]


def test_training_is_repeatable_and_bounded(spark):
    rows, labels = toxic_corpus(300)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = toxicity.train(docs, marks, 50), toxicity.train(docs.repartition(5), marks.repartition(2), 50)
    assert a.bias == b.bias and (a.linear == b.linear).all()


def test_machine_sums_over_all_pairs():
    rng = np.random.default_rng(2)
    index = np.full(1 << toxicity.BITS, -1, np.int32)
    known = rng.choice(1 << toxicity.BITS, 40, replace=False)
    index[known] = np.arange(40)
    machine = toxicity.Machine(0.3, index, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    texts = [rng.choice(known, k, replace=False) for k in (0, 1, 2, 9, 40)]
    texts[3][:2] = [5, 7] if index[5] == index[7] == -1 else texts[3][:2]  # slots that were not learned
    first = np.cumsum([0, *map(len, texts)])
    for got, slots in zip(machine.raw(np.concatenate(texts), first), texts, strict=True):
        at = [index[s] for s in slots if index[s] >= 0]
        pairs = sum(machine.factors[a] @ machine.factors[b] for i, a in enumerate(at) for b in at[:i])
        assert got == pytest.approx(0.3 + sum(machine.linear[a] for a in at) + pairs)


def test_training_stops_where_the_rows_set_aside_say(monkeypatch):
    """Labels that no term explains: nothing is learned by heart, and scores stay at the rate of labels."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 4000, 60)).astype(np.int32) for _ in range(600)]
    labels = (rng.random(600) < 0.2).astype(float)
    machine = toxicity.fit(rows, labels)
    values = toxicity._sigmoid(toxicity._raw_of(machine, rows))
    assert abs(values.mean() - 0.2) < 0.08 and values.std() < 0.1


def test_training_makes_no_second_copy_of_the_sample():
    """What training holds beside the rows is the machine's, whose slots are few here, and a step's; rows are 24 MB."""
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(5000, 1500, replace=False)).astype(np.int32) for _ in range(4000)]
    labels = (rng.random(4000) < 0.2).astype(float)
    tracemalloc.start()
    try:
        toxicity.fit(rows, labels, steps=8)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    # three tables of a row a slot (index, its count, the empty machine's) are 4 MB each; a step's slots are 1.5 MB
    assert peak < 60, peak


def test_toxicity_odd_inputs(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, none)
    assert all(r.score == pytest.approx(0.1) for r in toxicity.score(clashing(docs), machine).collect())
    one = toxicity.train(docs, spark.createDataFrame([(i, 1, 0) for i in (1, 4, 7, None)], none.schema))
    scored = toxicity.score(clashing(docs), one)
    assert set(scored.columns) == set(clashing(docs).columns) and scored.schema["score"].dataType.simpleString() == "double"
    assert 0 < scored.first()["score"] < 0.5
    assert toxicity.score(empty, machine).collect() == []
    assert toxicity.train(empty, none).bias == machine.bias


def test_conflicting_labels_count_as_toxic(spark):
    rows, labels = toxic_corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    doubled = labels + [(i, 1, 0) for i, _, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.train(docs, spark.createDataFrame(x, schema)) for x in (labels, doubled))
    assert (a.linear == b.linear).all()


# URLs


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://example.com/fr/1", "http://b.net/es/1", "http://b.net/ES/1", "http://notexample.com/en/", "x.org/en", "http://example.com", None, "http://example.com?q=/en/", "HTTP://c.org#f/en/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.with_rule(rows).collect()}
    assert got == {
        0: ("a.example.com", "/en/1", "example.com/en/"), 1: ("www.example.com", "/en/2", "www.example.com/en/"), 2: ("example.com", "/fr/1", "com/"),
        3: ("b.net", "/es/1", "net/es/"), 4: ("b.net", "/ES/1", None), 5: ("notexample.com", "/en/", "com/"), 6: ("", "", None), 7: ("example.com", "", None),
        8: ("", "", None), 9: ("example.com", "", None), 10: ("c.org", "", None),
    }


def test_trees_judge_what_no_rule_fits(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        # what the rules block looks like this: many digits and parameters
        bad = i % 2 == 0
        host = f"h{rng.randint(0, 50)}.{'net' if bad else 'com'}" if i < 300 else f"k{rng.randint(0, 50)}.org"
        path = f"/{'es' if bad else 'aa'}/{rng.randint(10**8, 10**9) if bad else 'word'}?{'a=1&b=2&c=3' if bad else ''}"
        rows.append((i, f"http://{host}{path}", bad))
    df = spark.createDataFrame(rows, "page_id int, url string, bad boolean")
    got = url_filter.filter_urls(df).join(df.select("page_id", "bad"), "page_id").toPandas()
    assert len(got) == 400
    rest = got[got.rule.isna()]
    assert len(rest) == 100 and ((rest.verdict == "block") == rest.bad).mean() > 0.95
    assert rest.score.notna().all() and got[got.rule.notna()].score.isna().all()


def test_url_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "http://x.com/"), (2, "http://x.com/"), (3, "")], "page_id int, url string")
    got = sorted((r.page_id, r.verdict) for r in url_filter.filter_urls(df).collect())
    assert got == [(1, "allow"), (2, "allow"), (2, "allow"), (3, "allow")]
    assert url_filter.filter_urls(df.filter("page_id > 9")).collect() == []


def test_url_statistics_are_of_all_urls(spark, monkeypatch):
    """Not of the sample that the trees are fitted on; alike where the tables are joined by shuffle; repeated URLs count once."""
    urls = [f"https://h{i % 4}.{'com' if i % 2 else 'net'}/{i}" for i in range(400)] + [f"https://a.h1.com/{i}" for i in range(50)] + ["https://co/1"]
    pages = url_filter.with_rule(spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:100])], "page_id long, url string"))
    for most in (20_000, 1):
        monkeypatch.setattr(url_filter, "MAX_LOCAL", most)
        rows = url_filter.with_shares(url_filter.with_features(pages), url_filter.suffix_statistics(pages)).select("host", *url_filter.SHARES).distinct().collect()
        # host: URLs, of its suffix, of its top-level domain, hosts there
        counts = {"h0.net": (100, 100, 200, 2), "h2.net": (100, 100, 200, 2), "h1.com": (100, 150, 250, 3), "h3.com": (100, 100, 250, 3), "a.h1.com": (50, 150, 250, 3), "co": (1, 1, 1, 1)}
        want = {h: (np.log(n * k / t), np.log(n / f), np.log(f / t)) for h, (n, f, t, k) in counts.items()}
        assert len(rows) == len(want) and all(np.allclose(tuple(r)[1:], want[r.host]) for r in rows)


def test_no_feature_names_the_top_level_domain(spark):
    urls = [f"http{'s' * (i % 2)}://h{i % 3}.example.{top}/{'en' if i % 5 else 'de'}/{i}?a={i}" for i in range(60) for top in ("com", "net", "org")]
    pages = url_filter.with_rule(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"))
    rows = url_filter.with_shares(url_filter.with_features(pages), url_filter.suffix_statistics(pages)).orderBy("page_id").collect()
    features = [tuple(r[f] for f in url_filter.FEATURES) for r in rows]
    assert features[0::3] == features[1::3] == features[2::3] and len(set(features)) > 10


def test_lexical_features(spark):
    df = url_filter.with_rule(spark.createDataFrame([(1, "http://ab.c-d.com/abca/1?x=1&y=2#z"), (2, None), (3, "aab")], "page_id long, url string"))
    one, two, three = url_filter.with_features(df).orderBy("page_id").collect()
    assert (one.f_len, one.f_host_len, one.f_path_len, one.f_depth, one.f_params, one.f_dash, one.f_fragment) == (23, 6, 7, 2, 2, 1, 1)
    assert one.f_path_letter == pytest.approx(1.75) and one.f_path_digits == pytest.approx(1 / 7)
    assert one.f_path_entropy == pytest.approx(-sum(k / 7 * np.log2(k / 7) for k in (2, 2, 1, 1, 1)))
    assert two.f_len == 0 and two.f_entropy == 0 and three.f_entropy == pytest.approx(-2 / 3 * np.log2(2 / 3) - 1 / 3 * np.log2(1 / 3))


def test_trees_see_no_labels_and_use_lexical_features(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.5
        tail = "".join(rng.choice("0123456789") for _ in range(rng.randint(8, 14))) if bad else "".join(rng.choice("abcdeilnorstu-") for _ in range(rng.randint(4, 12)))
        # verdicts by rule, whatever the top label
        rows.append((f"http://h{rng.randint(0, 30)}.example.com/{'en' if bad else 'fr'}/{tail}",))
    report = url_filter.held_out_report(spark.createDataFrame(rows, "url string"))
    assert report["n"] > 250 and report["accuracy"] > 0.97 > report["majority"] + 0.3
    assert sum(report["importances"][f] for f in url_filter.LEXICAL) > 0.8
    assert not [f for f in url_filter.FEATURES if "rate" in f or "segment" in f]


def test_url_rules_equal_their_sql(spark):
    """The part of the query that SQL can express, over a whole table and odd URLs with clashing columns."""
    con = duckdb.connect()
    odd = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://b.net/fr", "http://example.net/es/", "x.org/en", None, "", "http://com/", "http://.com/", "://net/es/", "ftp://www.www.example.com/en/?://", "http://a.com" + "/en" * 20000]
    frame = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(odd)], "page_id long, url string, host string, rule string, label string")
    for pages in (frame, spark.read.parquet("/root/testdata/sf0.001/pages.parquet")):
        con.register("pages", pages.select("page_id", "url").toArrow())
        want = sorted(con.sql(url_filter.OP8_RULES_SQL).fetchall())
        got = url_filter.filter_urls(pages).collect()
        assert sorted((r.page_id, r.host, r.path, r.rule) for r in got) == [r[:4] for r in want]
        verdicts = {r[0]: r[4] for r in want if r[3]}
        assert {r.page_id: r.verdict for r in got if r.rule} == verdicts


# licences


def test_license_texts_notices_and_spellings(spark):
    mit = licenses._MIT
    changed = "MIT Licence\n\nCopyright (c) 2020 Jane Doe\n" + mit.replace("Software", "SOFTWARE").replace(", ", " ,  ").replace("sublicense", "sub-license")
    rows = [(1, mit), (2, changed), (3, mit + " And more."), (4, "x\nLicensed under the Apache License, Version 2.0.\nThis work is licenced under the GNU General Public License version 3"), (5, ""), (6, None), (6, None)]
    got = sorted((r.doc_id, r.license_id, r.notices) for r in licenses.scan_licenses(clashing(spark.createDataFrame(rows, "doc_id int, text string"))).collect())
    assert got == [(1, "MIT", None), (2, "MIT", None), (3, None, None), (4, None, "Apache-2.0,GPL-3.0"), (5, None, None), (6, None, None), (6, None, None)]


def test_license_lines_without_telling_words(spark):
    """Whole texts on one line, and notices whose raw spelling is not the known one: as in the SQL."""
    one_line = lambda t: t.replace("\n", " ")
    rows = [
        (1, f"Terms\n{one_line(licenses._ISC)}\nEnd"), (2, f"Terms\n{one_line(licenses._BSD2)}\nEnd"),
        (3, "a\nThis is free and unencumbered software released into the public-domain."), (4, "a\nThis work is dedicated to the public  domain under\tCC0 1.0.\nb"),
        (5, "Licensed under CC-BY-4.0"), (6, "a\nLicensed under CC\tBY 4.0.\r\nb"), (7, "plain\ntext"), (8, f"x\n{one_line(licenses._MIT)}"),
    ]
    want = [(1, None, "ISC"), (2, None, "BSD-2-Clause"), (3, None, "Unlicense"), (4, None, "CC0-1.0"), (5, "CC-BY-4.0", "CC-BY-4.0"), (6, None, "CC-BY-4.0"), (7, None, None), (8, None, "MIT")]
    got = sorted(tuple(r) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, i, n) for d, _, i, n in got] == want
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(licenses.OP7_SQL).fetchall()) == got


def test_canonical_forms_agree(spark):
    texts = [t for _, t in licenses.KNOWN] + ["© 2001 X\nall rights reserved. A—B “c” (d) sub-licence https://x.y", "Whilst the programme's catalogue\tcancelled\r\nits judgement, copyright   holders organise"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.sha2(licenses.canonical_columns(F.col("t"))[0], 256).alias("h"))
    assert all(r.h == hashlib.sha256(licenses.canonical(r.t).encode()).hexdigest() for r in df.collect())


#: Spelled one way and the other.
SPELLED = [
    ("licence", "license"), ("organise", "organize"), ("favour", "favor"), ("catalogue", "catalog"), ("judgement", "judgment"), ("cancelled", "canceled"), ("programme", "program"), ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"), ("per cent", "percent"), ("copyright holders", "copyright owner"), ("whilst", "while"), ("http://a.b", "https://a.b"), ("defence", "defense"), ("practise", "practice"), ("fulfil", "fulfill"),
]


def test_equivalent_spellings_and_copyright_lines():
    for a, b in SPELLED:
        assert licenses.canonical(f"The {a} is.") == licenses.canonical(f"the {b}, is"), a
    body = "Permission is granted.\nProvided as is."
    for line in ("Copyright (c) 2020 Jane Doe", "(C) 1999-2003 The Team", "© Jane Doe", "Copyright (c) Jane Doe and friends", "# Copyright by Jane Doe", "Copyright The Great Authors", " * Copyright Great Works, Inc.", "Copyright: Jane", "All rights reserved."):
        assert licenses.canonical(f"{line}\n{body}") == licenses.canonical(body), line
    # no statements, but wrapped licence text
    for line in ("copyright notice and this notice", "(c) You must retain all notices", "copyright owners or contributors be liable"):
        assert licenses.canonical(f"{line}\n{body}") != licenses.canonical(body), line


def test_whole_texts_of_fifteen_licences(spark):
    """As published and changed in case, wrapping, punctuation, spelling and copyright lines; texts on disk where there are any."""
    con = duckdb.connect()
    whole = {i: t for i, t in licenses.KNOWN if len(t) > 400}
    shared = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause-UC"}
    whole |= {i: (shared / f).read_text() for f, i in names.items() if (shared / f).exists()}
    assert len({i for _, i in licenses.known_digests()}) >= 22
    rows, want = [], []
    for i, t in sorted(whole.items()):
        for changed in (t, t.upper(), t.replace("license", "licence").replace(", ", " ,  ").replace('"', "“"), "Copyright (c) 2024 Jane Doe\n\n" + t.replace("\n", "\r\n"), t + " or not"):
            rows.append((len(rows), changed))
            want.append((len(want), None if changed.endswith("or not") else i))
    got = sorted(tuple(r) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, i) for d, _, i, _ in got] == want
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(licenses.OP7_SQL).fetchall()) == got


def test_license_empty(empty):
    assert licenses.scan_licenses(empty).collect() == []


# decontamination


def all_windows(rows, items):
    """Best weighted Jaccard of any item-sized window, by hand."""
    words = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split(" ") if w]

    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]) if w else Counter()

    out = {}
    for d, t in rows:
        w = words(t)
        for i, x in items:
            want = words(x)
            b, n = bag(want), len(want)
            for s in range(max(1, len(w) - n + 1)):
                a = bag(w[s : s + n])
                union = sum((a | b).values())
                if a and b and len(want) >= 1 and sum((a & b).values()) / union >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), sum((a & b).values()) / union)
    return out


def test_op9_against_brute_force(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 12, 30, 60]))) for i in range(12)] + [(20, ""), (21, None)]
    rows = []
    for i in range(60):
        t = text(rng.randint(0, 120))
        if i % 3 == 0:
            words = rng.choice(items[:12])[1].split()
            # whole, with a word changed at an end, or cut short
            if i % 2:
                words[-1] = "changed"
            if i % 9 == 0:
                words = words[1:]
            t = f"{t} ({' '.join(words).upper()}), {text(20)}" if i % 4 else " ".join(words)
        rows.append((i, t))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = all_windows(rows, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(clashing(docs), clashing(bench)).collect()}
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    # what equals an item is always found; what is just within 0.8 may be over 19 bits away
    assert {k for k, v in want.items() if v > 0.95} <= set(got) and len(got) >= 0.9 * len(want) and len(got) > 10
    again = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs, bench, items=4).collect()}
    assert again == got


def test_op9_odd_tables(spark, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (None, "alpha beta gamma delta epsilon")], "item_id long, text string")
    rows = spark.createDataFrame([(None, "x one two three four five six seven y"), (2, "Alpha, beta gamma; delta epsilon!"), (2, "z"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words) for r in decontaminate.contamination(rows, bench).collect()}
    assert got == {(None, 1, 1, 7), (2, None, 0, 5)}
    assert decontaminate.contamination(empty, bench).collect() == []
    assert decontaminate.contamination(rows, bench.limit(0)).collect() == []


def test_block_search_finds_all_within_the_radius():
    # pigeonhole: 19 differing bits leave a block with at most 3
    rng = np.random.default_rng(7)
    for _ in range(300):
        bits = rng.choice(64, decontaminate.RADIUS, replace=False)
        width = decontaminate.BLOCK_BITS
        assert min(((bits >= width * b) & (bits < width * (b + 1))).sum() for b in range(decontaminate.BLOCKS)) <= decontaminate.BLOCK_RADIUS
    assert decontaminate.BLOCKS * decontaminate.BLOCK_BITS >= 64 > (decontaminate.BLOCKS - 1) * decontaminate.BLOCK_BITS


def test_simhash_of_similar_multisets_is_near():
    rng = np.random.default_rng(8)
    a = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    b = a.copy()
    b[:2] = rng.integers(1, 1 << 62, 2)
    x, y, z = decontaminate.simhash(np.concatenate([a, b, rng.integers(1, 1 << 62, 60).astype(np.uint64)]), np.array([0, 60, 120]))
    assert int(x ^ y).bit_count() < 15 < int(x ^ z).bit_count()
    assert decontaminate.similarity(a, a) == 1 and decontaminate.similarity(a, np.concatenate([a, a])) == 0.5


def test_lookup():
    look = decontaminate.Lookup(np.array([5, 9], np.uint64) << np.uint64(50))
    assert look.positions(np.array([5, 1, 9, 5], np.uint64) << np.uint64(50)).tolist() == [0, 2, 3]
    assert decontaminate.Lookup(np.zeros(0, np.uint64)).positions(np.array([1], np.uint64)).tolist() == []


def test_null_texts_in_arrow():
    assert [n for n, _ in decontaminate.item_shingles(pa.array(["a b", None, ""]))] == [2, 0, 0]


# mixing


def test_weights_meet_the_repeat_limit_and_the_entropy():
    tokens = {"a": 1000, "b": 100, "c": 10, "z": 0}
    a, quota = mixing.weights(tokens, max_repeat=4.0)
    assert quota["a"] == 1000 and quota["c"] == 40 and 100 < quota["b"] < 400 and 0 < a < 1
    assert mixing.weights(tokens, max_repeat=1000.0)[0] == 0.0
    flat, q = mixing.weights(tokens, budget=3000, target_entropy=0.9, max_repeat=None)
    p = np.array(list(q.values())) / sum(q.values())
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.9) < 0.01 and 0 < flat < 1
    assert mixing.weights({}) == (1.0, {}) and mixing.weights({"a": 5})[1] == {"a": 5}


def test_mix_takes_quotas_in_whole_and_leading_parts(spark, docs):
    rows = corpus()
    out = mixing.mix(clashing(docs), max_repeat=2.5, block_tokens=50).collect()
    words = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s or "" for i, _, _, s in rows}
    have = Counter()
    for i in words:
        have[source[i]] += words[i]
    _, quota = mixing.weights(dict(have), max_repeat=2.5)
    taken = Counter()
    for r in out:
        taken[r.source or ""] += words[r.doc_id]
    times = Counter(r.doc_id for r in out)
    for s, q in quota.items():
        assert q - max(words.values()) < taken[s] <= q
        counts = {times[i] for i in words if source[i] == s}
        assert max(counts) - min(counts) <= 1
        # what is in a begun pass stands before what is not
        last = max(counts) - 1
        in_it = [r.mix_place for r in out if (r.source or "") == s and r.mix_epoch == last]
        out_of_it = [mixing_place(last, i) for i in words if source[i] == s and times[i] == last]
        assert not out_of_it or max(in_it) < min(out_of_it)
    assert times[1001] == 1  # a source without tokens is taken once
    assert set(clashing(docs).columns) < set(out[0].asDict())


def mixing_place(epoch, doc):
    return int(hashlib.md5(f"{mixing.SEED}|{epoch}|{doc}".encode()).hexdigest()[:13], 16)


def test_mix_with_a_budget_below_a_pass(docs):
    out = mixing.mix(docs, budget=500, max_repeat=None, target_entropy=0.5, block_tokens=20)
    assert out.count() == out.select("doc_id").distinct().count() < 100


def test_mix_odd_tables(spark, empty):
    assert mixing.mix(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b", "en", None), (1, "a b", "en", None), (None, "c d", "en", "s"), (2, None, "en", "t")], SCHEMA)
    assert sorted((r.doc_id or 0, r.mix_epoch) for r in mixing.mix(rows).collect() if r.mix_epoch == 0) == [(0, 0), (1, 0), (1, 0), (2, 0)]


def test_mixing_many_sources_by_table(spark, docs, monkeypatch):
    """Beyond MAX_LOCAL sources the plan stays a table: the same rows as on the driver."""
    for aims in ({"max_repeat": 2.5}, {"budget": 900, "max_repeat": None, "target_entropy": 0.6}, {"budget": 3000}):
        few = sorted((r.doc_id or -1, r.mix_epoch, r.mix_place) for r in mixing.mix(docs, block_tokens=50, **aims).collect())
        monkeypatch.setattr(mixing, "MAX_LOCAL", 2)
        many = sorted((r.doc_id or -1, r.mix_epoch, r.mix_place) for r in mixing.mix(docs, block_tokens=50, **aims).collect())
        monkeypatch.undo()
        assert many == few and few
    empty_texts = spark.createDataFrame([(i, None, "en", f"s{i}") for i in range(5)], SCHEMA)
    monkeypatch.setattr(mixing, "MAX_LOCAL", 2)
    assert len(mixing.mix(empty_texts).collect()) == 5
