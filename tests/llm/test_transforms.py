"""Personal data, fill-in-middle and periodic runs against plain restatements, on odd and random texts."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tarnflow.llm import fill_middle, periodic, pii
from tarnflow.session import ship_package

from .fixtures import CLASHING, corpus

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def table(spark, path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


# -- personal data ---------------------------------------------------------------------------------


def luhn(d):
    s = [int(c) for c in d][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(s)) % 10 == 0


def base_spans(text):
    """The four base kinds by a leftmost scan of each pattern."""
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in pii.PATTERNS.items() for m in re.finditer(p, text) if good[k](m.group())]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    pieces = ["@", ".", "-", "+", " ", "(", ")", "a", "Z.", "_%", "0", "1", "12", "255", "256", "4111111111111111", "x@y.de", "ü", "日本", "😀", "\n", "://", "http://", "account ", "DE89", "3704 0044", "4111 1111-1111 1111", "+49 (30) 123-4567", "1.2.3.4", "no."]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 24)))
        got = pii.spans_of(text)
        assert [s for s in got if s[0] in pii.BASE] == base_spans(text), text
        assert got == sorted(got, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_added_spans():
    text = "log in at sftp://bob:s3cret@host.example.org/x; Account No: 1234-5678, PASSPORT 99; IBAN DE89 3704 0044 0532 0130 00 AND MORE, DE88370400440532013000"
    got = [(k, text[a:b]) for k, a, b in pii.spans_of(text)]
    assert ("login", "sftp://bob:s3cret@host.example.org") in got and ("account", "1234-5678") in got and ("iban", "DE89 3704 0044 0532 0130 00") in got
    assert [k for k, _ in got].count("iban") == 1 and [k for k, _ in got].count("account") == 1
    assert pii.masked("to a.b@c.de now", pii.spans_of("to a.b@c.de now")) == "to [email] now"


ODD = [
    (1, None), (2, ""), (3, "a@b.c@d.e 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255"), (4, "x@y then ünï@ü.de +1 (234) 555-0000 +12 +1+2+3 4"), (5, "4111 1111 1111 1111 4111-1111-1111-1112 1234567890123"),
    (6, "https://me:pw@h.org ftp://u@v http://a@b.http://c@d"), (7, "konto nr. 123 456 78 Account#12 compte: 1-2-3-4-5-6 CUSTOMER ID 0123456789"), (8, "GB82WEST12345698765432 FR1420041010050500013M02606 XX DE89370400440532013000AB"), (9, "\x01a@b.de\x01\x02 1.1.1.1\x01"), (None, "me@home.org"),
]


def test_query_and_sql_on_odd_texts(spark, tmp_path):
    ship_package(spark)
    path = table(spark, tmp_path, [r for r in ODD if r[0]])
    df = pii.op11_personal_data(spark, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    rel = con.sql(pii.OP11_SQL)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    for r in df.collect():
        spans = base_spans(dict(ODD)[r.doc_id] or "")
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE)
    assert {r.doc_id: r.spans for r in df.collect()}[8].count("iban") == 3


def test_personal_data_of_odd_tables(spark):
    ship_package(spark)
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in ODD + ODD[:4]], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    assert pii.find_personal(docs).count() == len(ODD) + 4
    assert {r.text for r in pii.mask_personal(docs.filter("doc_id is null")).collect()} == {"[email]"}
    assert pii.find_personal(docs.limit(0)).count() == 0
    long = "x" * 1_000_000 + " 1.2.3.4 " + "5 " * 500_000 + "y@" * 100_000
    assert [(k, b - a) for k, a, b in pii.spans_of(long)] == [("ip", 7)]


# -- fill in middle --------------------------------------------------------------------------------


def cut(doc_id, text):
    """(n, form, prefix, middle, suffix, output) restated."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


FIM = [
    (None, "no id"), (1, None), (2, ""), (3, "\x01\x02\x01\x02\x02d\x02e\x01 ed"), (4, "has <P> in it"), (5, "<S"), (6, "<<<>>>PSM<M"), (7, "a\n\r\nb \u0085"), (8, "😀🏽é日本" * 50), (9, "$0\\1\\$"),
    *[(i, "".join(random.Random(i).choice("ab\x01\x02ed<>PS\nü😀") for _ in range(i % 17))) for i in range(10, 200)],
]


def test_parts_and_round_trip(spark):
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in FIM], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    got = fill_middle.fill_in_middle(docs)
    rows = got.select("*", fill_middle.restored(got.output, got.form).alias("again")).collect()
    texts = dict(FIM)
    assert len(rows) == len(FIM)
    for r in rows:
        assert tuple(r)[1:7] == cut(r.doc_id, texts[r.doc_id]) and r.again == (texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("unit", "pattern"), [("word", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_other_units(spark, unit, pattern):
    docs = spark.createDataFrame(FIM, "doc_id long, text string")
    got = fill_middle.fill_in_middle(docs, unit, rate=100)
    for r in got.collect():
        units = re.findall(pattern, dict(FIM)[r.doc_id] or "")
        assert r.n == len(units)
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == "".join(units) and r.prefix in {"".join(units[:k]) for k in range(len(units) + 1)}


def test_fill_in_middle_query(spark, tmp_path):
    rows = [r for r in FIM if r[0]]
    path = table(spark, tmp_path, rows)
    df = fill_middle.op12_fill_in_middle(spark, path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    rel = con.sql(fill_middle.OP12_SQL)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    for r in df.collect():
        n, form, p, m, _, out = cut(r.doc_id, dict(rows)[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert r.output_sha256 == sha(out) and r.restored_sha256 == sha(dict(rows)[r.doc_id] or "")


# -- periodic runs ---------------------------------------------------------------------------------


def runs(w, least=24, times=3):
    """All runs, by every period and every start."""
    best = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    words = []
    for _ in range(rng.randint(1, 5)):
        letters = rng.choice([1, 2, 3, 20])
        unit = [b"w%d" % rng.randrange(letters) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(2, 4) + [b"w%d" % rng.randrange(letters)]
        words += (unit * rng.randint(1, 8))[: rng.randint(1, 120)]
    return words


def test_runs_are_those_of_every_period():
    rng, seen = random.Random(8), 0
    for _ in range(1500):
        w = periodic_words(rng)
        for least, times in ((24, 3), (6, 3), (8, 4), (3, 3)):
            want = runs(w, least, times)
            seen += len(want)
            assert periodic.runs_of(w, least, times) == want
    assert seen > 1000


def test_z_function():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s) == want


def test_periodic_query(spark, tmp_path):
    ship_package(spark)
    rng = random.Random(4)
    rows = [(i, t) for i, t, *_ in corpus(80)] + [(5000 + i, b"\n".join(periodic_words(rng)).decode()) for i in range(120)]
    got = {r.doc_id: r for r in periodic.op13_periodic_runs(spark, table(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for i, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            changed += 1
        found = runs(w)
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in found)) and r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    assert changed > 5 and sum(r.n_runs for r in got.values()) > 50


def test_runs_of_odd_tables(spark):
    ship_package(spark)
    texts = [None, "", " \n ", "one two", "la " * 50, "la " * 50, "   " + "x y z " * 40, " ".join(f"w{i % 5000}" for i in range(200_000))]
    docs = spark.createDataFrame([(None if i == 4 else i, t, *range(len(CLASHING))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    got = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(x) for x in got[None].runs] == [(0, 50, 1)] and got[None].collapsed == got[5].collapsed == "la" and got[0].collapsed == got[2].collapsed == ""
    assert [tuple(x) for x in got[6].runs] == [(1, 80, 2)] and [tuple(x) for x in got[7].runs] == [(0, 200_000, 5000)]
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, 24, 2)
