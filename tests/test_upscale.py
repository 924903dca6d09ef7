"""Coarser flow directions against a plain restatement, cell by cell."""

import random

import pytest

from tarnflow.operators import upscale


def restated(down, factor, rounds=4):
    """{unit: (link, outlet, total, error)} of {cell: cell or None}."""
    unit = lambda c: (c[0] // factor, c[1] // factor)
    total = dict.fromkeys(down, 0)
    for c in down:
        while c is not None:
            total[c] += 1
            c = down[c]
    near = lambda a, b: a != b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1
    ways = {}
    for c, d in down.items():
        if d is None or unit(d) != unit(c):
            ways.setdefault(unit(c), []).append(c)
    largest = lambda cells: max(cells, key=lambda c: (total[c], [-i for i in c]))
    outlets = {u: largest(w) for u, w in ways.items()}

    def below(c, held):
        c = down[c]
        while c is not None and c not in held:
            c = down[c]
        return c

    best = None
    for _ in range(rounds + 1):
        held = set(outlets.values())
        to = {c: below(c, held) for w in ways.values() for c in w}
        bad = {u for u, o in outlets.items() if to[o] is not None and not near(u, unit(to[o]))}
        if best and len(bad) >= len(best[1]):
            break
        best = outlets, bad, to
        good = {u: [c for c in ways[u] if c != outlets[u] and to[c] is not None and near(u, unit(to[c]))] for u in bad}
        outlets = {u: largest(good[u]) if good.get(u) else o for u, o in outlets.items()}
        if not bad:
            break
    outlets, bad, to = best
    out = {}
    for u, o in outlets.items():
        link = unit(to[o]) if to[o] is not None and u not in bad else None
        if u in bad:
            larger = [v for v in outlets if near(u, v) and total[outlets[v]] > total[o]]
            link = min(larger, key=lambda v: (v != unit(down[o]), total[outlets[v]], v), default=None)
        out[u] = (link, o, total[o], u in bad)
    return out


def rivers(seed, ny, nx):
    """Every cell drains to the neighbour with the next lower of distinct heights, or out."""
    rng = random.Random(seed)
    height = {(y, x): y + x + rng.random() * 6 for y in range(ny) for x in range(nx) if rng.random() > 0.03}
    out = {}
    for (y, x), h in height.items():
        around = [(height[c], c) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (c := (y + dy, x + dx)) in height]
        low = min(around)
        out[y, x] = low[1] if low[0] < h else None
    return out


@pytest.mark.parametrize(("seed", "factor"), [(39, 3), (33, 4)])
def test_units_and_links(spark, seed, factor):
    down = rivers(seed, 22, 26)
    df = spark.createDataFrame([(*c, *(d or (None, None))) for c, d in down.items()], "yi long, xi long, down_yi long, down_xi long")
    units, share = upscale.upscale(df, factor)
    want = restated(down, factor)
    got = {(r.yi, r.xi): ((r.down_yi, r.down_xi) if r.down_yi is not None else None, (r.out_yi, r.out_xi), r.total, r.error) for r in units.collect()}
    assert got == want and share == pytest.approx(sum(w[3] for w in want.values()) / len(want))
    # some conflicts are mended, and one is left
    assert sum(w[3] for w in restated(down, factor, 0).values()) > sum(w[3] for w in want.values()) > 0
    for u in got:  # no loops
        seen = set()
        while u is not None:
            assert u not in seen
            seen.add(u)
            u = got[u][0] if u in got else None


def test_no_cells(spark):
    units, share = upscale.upscale(spark.createDataFrame([], "yi long, xi long, down_yi long, down_xi long"), 3)
    assert units.count() == 0 and share is None
