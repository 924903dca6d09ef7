"""Vectorised tokens, shingles and anchors against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from tarnflow.llm import _runs as R
from tarnflow.llm import _text as T

TEXTS = ["", "a b c d e f", " a  b\tc ", "x", None, "Ünïcode wörds and más", "a b c d e f", "\n\n", "one two three four five", "A B c D e F"]


def test_tokens_match_regex():
    (piece,) = T.pieces(pa.array(TEXTS))
    tok = T.tokens(piece)
    seen = {}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        want = re.findall(rb"[^\x20\x09-\x0D]+", data)
        got = [piece.data[s:e].tobytes() for s, e in zip(tok.starts[tok.first[i] : tok.first[i + 1]], tok.ends[tok.first[i] : tok.first[i + 1]], strict=True)]
        assert got == want
        for w, h in zip(want, tok.hashes[tok.first[i] : tok.first[i + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_lower_case_and_alnum():
    (piece,) = T.pieces(pa.array(["It's (GREAT), no?", "it s great no"]))
    tok = T.tokens(piece, lower=True, alnum=True)
    a, b = (tok.hashes[tok.first[i] : tok.first[i + 1]].tolist() for i in (0, 1))
    assert a == b


def test_shingles_equal_only_for_equal_sequences():
    (piece,) = T.pieces(pa.array(TEXTS))
    out, first = T.shingles(T.tokens(piece), 5)
    sizes = np.diff(first).tolist()
    assert sizes == [0, 2, 1, 1, 0, 1, 2, 0, 1, 2]
    assert out[first[1] : first[2]].tolist() == out[first[6] : first[7]].tolist()
    low, first = T.shingles(T.tokens(piece, lower=True), 5)
    assert low[first[1] : first[2]].tolist() == low[first[9] : first[10]].tolist()


def test_pieces_hold_whole_texts():
    column = pa.array(["abc" * 10, "d" * 100, "", "e"])
    got = list(T.pieces(column, 20))
    assert [(p.lo, p.hi) for p in got] == [(0, 1), (1, 2), (2, 4)]
    assert sum(len(p.data) for p in got) == 131
    assert [p.data.tobytes() for p in T.pieces(column.slice(2, 2))] == [b"e"]


def test_sliding_least():
    rng = np.random.default_rng(0)
    for n, w in ((1, 1), (5, 2), (17, 5), (40, 7), (6, 6), (3, 9)):
        x = rng.integers(0, 1 << 60, n).astype(np.uint64)
        assert R.sliding_least(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]


def test_runs_partition_the_windows_and_equal_windows_share_anchors():
    random.seed(5)
    texts = [" ".join(random.choice("abcd") for _ in range(random.randint(0, 60))) for _ in range(30)]
    (piece,) = T.pieces(pa.array(texts))
    tok = T.tokens(piece)
    k, width = 3, 8
    grams = R.rolled(tok.hashes, k)
    text, start, count, anchor = R.runs(grams, tok.first, width, k)
    windows = {}
    for t, s, c, a in zip(text, start, count, anchor, strict=True):
        for w in range(s, s + c):
            assert w not in windows and tok.first[t] <= w and w + width <= tok.first[t + 1] and w <= a <= w + width - k
            windows[w] = (grams[a], a - w)
    assert len(windows) == sum(max(0, len(x.split()) - width + 1) for x in texts)
    by_content = {}
    for w, where in windows.items():
        assert by_content.setdefault(tuple(tok.hashes[w : w + width]), where) == where
