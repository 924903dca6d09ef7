"""Substring, near-copy and line dedup against brute force; odd rows and tables."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import _lsh, _repeats, _text, fm_index, line_dedup, minhash, suffix_array, superminhash
from tarnflow.session import ship_package

from . import brute
from .fixtures import CLASHING, SCHEMA, corpus


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def by_id(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


# suffix arrays


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(400):
        x = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 25))]
        assert suffix_array.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])
    for x in ([1] * 500, [1, 2] * 300, list(range(200)), list(range(200, 0, -1))):
        assert suffix_array.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_lyndon_groups_are_by_lyndon_prefix():
    rng = random.Random(2)

    def prefix(x, i):
        # the longest Lyndon word starting at i
        j, k = i + 1, i
        while j < len(x) and x[k] <= x[j]:
            k = i if x[k] < x[j] else k + 1
            j += 1
        return tuple(x[i : i + (j - k)])

    for _ in range(200):
        x = [rng.randint(1, 3) for _ in range(rng.randint(1, 20))] + [0]
        group, _ = suffix_array.lyndon_groups(x)
        words = [prefix(x, i) for i in range(len(x))]
        assert [sorted(set(words)).index(w) for w in words] == group


def test_op2_against_brute_force(docs):
    rows = sorted(corpus())
    want = dict(zip([r[0] for r in rows], brute.repeated_bytes([r[1] for r in rows]), strict=True))
    assert by_id(suffix_array.drop_repeats(clashing(docs))) == want
    assert sum(w[1] for w in want.values()) > 1000


def test_anchors_with_many_classes_are_cut_again(docs):
    rows = _repeats.keyed(docs)
    for module, first in ((suffix_array, False), (fm_index, True)):
        compare = suffix_array.repeated_anywhere if module is suffix_array else fm_index.earlier_windows
        found = [
            {(r.doc, r["sub"]): {w for s in r.spans for w in range(s["start"], s["start"] + s["count"])} for r in _repeats.repeated_windows(rows, module.UNIT, compare, first, large).collect()}
            for large in (0, 1, 3, 20_000)
        ]
        assert all(f == found[0] for f in found) and found[0]


def test_op2_repeated_rows_and_empty(spark, empty):
    text = "".join(chr(97 + i % 26) for i in range(150)) + "y" * 20 + "z" * 70
    rows = spark.createDataFrame([(1, text), (1, text), (1, "q" * 199), (2, "w" * 201), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_array.drop_repeats(rows).collect())
    assert got == [(0, 240, 240, 1), (1, 199, 0, 0), (1, 240, 240, 1), (1, 240, 240, 1), (2, 201, 201, 1)]
    assert suffix_array.drop_repeats(empty).collect() == []


def test_op2_very_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long + "tail"), (2, "head" + long[100_000:100_300] + "more")]
    got = by_id(suffix_array.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1][:3] == (300_004, 300, 1) and got[2][:3] == (308, 300, 1)


# FM-index


def test_bits_rank_and_select():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 500, 3000):
        bits = rng.random(n) < (0.4 if n < 1000 else 0.003)
        held = fm_index.Bits(bits)
        at = np.arange(n + 1)
        assert held.rank1(at).tolist() == [int(bits[:i].sum()) for i in at]
        assert held.select1(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()
        assert held.at(at[:n]).tolist() == bits.tolist()


def segments(rng, n, top):
    parts = [np.append(rng.integers(1, top, rng.integers(1, 30)), 0) for _ in range(n)]
    return np.concatenate(parts), parts


def test_backward_search_counts_and_locates_occurrences():
    rng = np.random.default_rng(4)
    text, _ = segments(rng, 20, 4)
    index = fm_index.FMIndex(text, 6)
    for _ in range(200):
        i, n = rng.integers(0, len(text) - 8), rng.integers(1, 7)
        pattern = text[i : i + n]
        if (pattern == 0).any():
            continue
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == pattern).all()]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_matches_of_streamed_documents():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 5):
        for _ in range(30):
            text, _ = segments(rng, 8, 4)
            _, parts = segments(rng, 7, 5)
            parts = [p[:-1] for p in parts]
            docs, first = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
            for need in (1, 2):
                at, lo, hi = fm_index.matches(fm_index.FMIndex(text, depth), np.where(docs > 3, -1, docs), first, np.full(len(parts), need))
                places = lambda x: [k for k in range(len(text) - depth + 1) if (text[k : k + depth] == x).all()]
                want = {int(first[d]) + i: len(places(p[i : i + depth])) for d, p in enumerate(parts) for i in range(len(p) - depth + 1)}
                want = {i: n for i, n in want.items() if n >= need}
                assert dict(zip(at.tolist(), (hi - lo).tolist(), strict=True)) == want


def test_without_an_index_nothing_is_removed(docs):
    rows = _repeats.keyed(docs)
    for module, first in ((suffix_array, False), (fm_index, True)):
        none = lambda shard: np.zeros(int(shard.windows.sum()), bool)
        assert _repeats.repeated_windows(rows, module.UNIT, none, first).collect() == []


def test_op3_against_brute_force(docs):
    want = brute.earlier_words([(i, t) for i, t, _, _ in sorted(corpus())])
    assert by_id(fm_index.drop_repeats(clashing(docs))) == want
    assert sum(w[1] for w in want.values()) > 500


def test_op3_repeated_rows_null_ids_and_empty(spark, empty):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(5, text), (5, text), (7, text), (None, "w0 " * 25)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in fm_index.drop_repeats(rows).collect())
    # two equal rows: neither is earlier; w0 repeated: windows after the first one
    assert got == [(0, 25, 24), (5, 30, 0), (5, 30, 0), (7, 30, 30)]
    assert fm_index.drop_repeats(empty).collect() == []


# near copies


def test_superminhash_slots_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 62, 1000).astype(np.uint64)
    for share in (1.0, 0.8, 0.3, 0.0):
        n = round(1000 * share)
        b = np.concatenate([a[:n], rng.integers(1, 1 << 62, 1000 - n).astype(np.uint64)])
        sig = superminhash.superminhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), 256)
        jaccard = n / (2000 - n)
        assert abs((sig[0] == sig[1]).mean() - jaccard) < 0.1
    # early stopping must not change anything: few elements fill all slots, step by step
    few = superminhash.superminhash(a[:3], np.array([0, 3, 3]), 16)
    assert (few[0] >> np.uint64(32)).max() >= 5 and (few[1] == np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("percent", [80, 85])
def test_op6_against_brute_force(docs, percent):
    want = brute.components([(i, t) for i, t, _, _ in corpus()], percent)
    got = by_id(superminhash.near_dedup(clashing(docs), percent))
    assert {i: v[:2] for i, v in got.items()} == want
    assert {i for i, v in got.items() if v[2]} == {i for i, v in want.items() if v[1] == i}
    assert len({v[1] for v in want.values()}) < len(want) - 20


def test_minhash_groups_against_brute_force(docs):
    want = brute.components([(i, t) for i, t, _, _ in corpus()], 80)
    assert by_id(minhash.near_groups(docs)) == want


def test_op6_chains_and_cut_buckets(spark, monkeypatch):
    # each text is near the next only: one component by a chain; small blocks cut buckets and clusters
    monkeypatch.setattr(_lsh, "BLOCK", 4)
    monkeypatch.setattr(_lsh, "TEXTS", 4)
    monkeypatch.setattr(_lsh, "FOREST", 7)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)] + [(100 + i, " ".join(words[: 90 + i])) for i in range(20)]
    want = brute.components(rows, 85)
    got = by_id(superminhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 85))
    assert {i: v[:2] for i, v in got.items()} == want
    assert {want[i][1] for i in range(40)} == {0}


def test_op6_repeated_rows_null_ids_and_empty(spark, empty):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = spark.createDataFrame([(4, a), (4, b), (6, b), (9, a), (None, b), (8, ""), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in superminhash.near_dedup(rows, 85).collect())
    # rows of id 4 are one document with both texts, so all are linked with the null id, the smallest
    assert got == [(0, None, True), (4, None, False), (4, None, False), (6, None, False), (8, 8, True), (8, 8, True), (9, None, False)]
    assert superminhash.near_dedup(empty, 85).collect() == []


def test_bands_lose_no_pair_at_the_threshold():
    for percent in (80, 85, 90):
        rows, bands = _lsh.shape(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= _lsh.MISS


# fingerprints


def test_op4_against_plain_strings(docs):
    rows = sorted(corpus())
    got = by_id(minhash.fingerprint_edits(clashing(docs)))
    prints = {}
    for k, (i, text, _, _) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        n, digest, fp, fp2, near, nxt, exact, exact_next = got[i]
        assert (n, digest) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert prints.setdefault(text, fp) == fp and prints.setdefault(changed, fp2) == fp2
        a, b = brute.shingles(text), brute.shingles(changed)
        assert exact == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        c = brute.shingles(after)
        assert exact_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
        if a and b:
            assert abs(near - exact) < 0.25
        assert 0 <= nxt <= 1
    assert len(set(prints.values())) > 60


def test_near_groups_band_the_fingerprints(docs):
    """The bands' slots are those of the fingerprint."""
    texts = pa.array([t or "" for _, t, _, _ in corpus()])
    sets = _text.sets_of(texts, minhash.SHINGLE)
    assert (minhash.fingerprint_slots(*sets, minhash.PERMS) == minhash.signatures(texts)).all()
    found = _lsh.describe(docs, minhash.fingerprint_slots, minhash.BAND, minhash.PERMS // minhash.BAND).filter("n > 0")
    stored = {r.doc_id: r.fingerprint for r in minhash.fingerprint(docs).collect()}
    # the bands are made of what is stored, slot by slot
    same = {}
    for r in found.collect():
        same.setdefault(stored[r.doc], set()).add(bytes(r.sig))
    assert len(same) > 60 and all(len(x) == 1 for x in same.values())


def test_op4_part_that_sql_can_express(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    # by code points: DuckDB's substr counts them, its length counts them too where there are no combining marks
    want = con.sql(minhash.OP4_EDITS_SQL).fetchall()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in minhash.fingerprint_edits(docs).collect()) == sorted(want)


def test_op4_ties_one_row_and_empty(spark, empty):
    one = minhash.fingerprint_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    tied = spark.createDataFrame([(2, "bb"), (2, "aa"), (None, "cc"), (2, "aa")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.edited_sha256) for r in minhash.fingerprint_edits(tied).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == sorted([(0, sha("ca")), (2, sha("aa")), (2, sha("ab")), (2, sha("bc"))])
    assert minhash.fingerprint_edits(empty).collect() == []


def test_op4_many_buckets(spark):
    rows = [(i * i, f"text number {i} " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = minhash.in_order(df, 37).select("doc_id", "text", "bucket", "role").mapInArrow(minhash._fingerprint_run, minhash._OUT)
    want = by_id(minhash.in_order(df, 1).select("doc_id", "text", "bucket", "role").mapInArrow(minhash._fingerprint_run, minhash._OUT))
    assert by_id(got) == want and len(want) == 200


# lines


def lines_by_hand(rows, min_sites):
    sites, first = {}, {}
    for i, t, _, s in rows:
        for x in (t or "").split("\n"):
            bare = x.strip(line_dedup.BLANKS)
            if bare:
                sites.setdefault(bare, set()).add(s or "")
                first[bare] = min(first.get(bare, i), i)
    gone = {x for x, s in sites.items() if len(s) >= min_sites}
    out = {}
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(line_dedup.BLANKS) not in gone or first[x.strip(line_dedup.BLANKS)] == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("min_sites", "margin"), [(5, 0.1), (2, 0.1), (3, 0.9)])
def test_op10_against_plain_python(docs, min_sites, margin):
    out = line_dedup.drop_boilerplate(clashing(docs), min_sites, margin=margin)
    assert set(clashing(docs).columns) < set(out.columns)
    got = {r.doc_id: (r.ld_lines, r.ld_removed, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()}
    assert got == lines_by_hand(corpus(), min_sites)
    assert sum(v[1] for v in got.values()) > 0


def test_op10_null_site_repeated_rows_and_empty(spark, empty):
    rows = [(1, "x\ny", "en", "a"), (1, "x\ny", "en", "a"), (2, " x \nz", "en", "b"), (None, "x", "en", None)]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), 3).collect())
    # three sites; the null id is the smallest and keeps the line
    assert got == [(0, "x"), (1, "y"), (1, "y"), (2, "z")]
    assert line_dedup.drop_boilerplate(empty).collect() == []


def test_op10_blank_lines_of_any_kind_stay(spark):
    rows = [(i, f"First {i}\r\n\r\n \t\x0b\x0c\nThe same line.\t\r\nlast {i}", "en", f"s{i}") for i in range(8)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == rows[i][1].replace("The same line.\t\r\n", "") for i in range(1, 8))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, _, s in rows])
    want = {r[0]: r[3] for r in con.sql("SELECT doc_id, n_lines, n_removed, kept_sha256 FROM (" + line_dedup.OP10_SQL + ")").fetchall()}
    assert want == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()}


def test_op10_rows_of_one_id_with_different_texts(spark):
    rows = [(i, "common\nmine %d" % i, "en", f"s{i}") for i in range(6)] + [(5, "a\nb\ncommon\nc", "en", "s5"), (0, "z\ncommon", "en", "s0")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(0, "common\nmine 0"), (0, "z\ncommon"), *[(i, f"mine {i}") for i in range(1, 6)], (5, "a\nb\nc")])
