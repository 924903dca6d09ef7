"""Flow directions by tiles against a flood of the whole grid."""

import heapq
import random

import pytest

from tarnflow.operators import terrain
from tarnflow.operators.flow import D8

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def flood(z):
    """(filled, steps over level ground, down) of a dict of heights."""
    near = lambda c: [(c[0] + dy, c[1] + dx) for dy, dx in AROUND]
    outlets = {c for c in z if any(n not in z for n in near(c))}
    filled, queue = {c: z[c] for c in outlets}, [(z[c], c) for c in outlets]
    heapq.heapify(queue)
    while queue:
        level, c = heapq.heappop(queue)
        for n in near(c):
            if n in z and n not in filled:
                filled[n] = max(level, z[n])
                heapq.heappush(queue, (filled[n], n))
    steps = {c: 0 for c in z if c in outlets or any(filled[n] < filled[c] for n in near(c))}
    ring = list(steps)
    while ring:
        ring = [n for c in ring for n in near(c) if n in z and filled[n] == filled[c] and n not in steps and not steps.update({n: steps[c] + 1})]
    down = {c: None if c in outlets else min(near(c), key=lambda n: (filled[n], steps[n], n)) for c in z}
    return filled, steps, down


def grid(seed, ny, nx, heights, holes=0.0):
    rng = random.Random(seed)
    return {(y, x): float(rng.randrange(heights)) for y in range(ny) for x in range(nx) if rng.random() >= holes}


CASES = {
    "rough": grid(1, 13, 17, 50), "level": grid(2, 14, 15, 2), "holes": grid(3, 16, 12, 6, 0.08), "one": {(0, 0): 3.0}, "line": {(0, x): float(x % 3) for x in range(9)},
    "bowl": {(y, x): 9.0 if y in (0, 14) or x in (0, 14) else 1.0 for y in range(15) for x in range(15)},
    "maze": {(y, x): 9.0 if y % 4 == 2 and x != (0 if y % 8 == 2 else 15) or x == 16 or y == 16 or x == 0 and y > 1 else 2.0 for y in range(17) for x in range(17)},
}


@pytest.mark.parametrize("size", [4, 64])
def test_tiles_give_what_the_whole_gives(spark, size):
    # all cases on one grid, apart; indices below zero
    z = {(y - 5 + 30 * k, x - 3): v for k, case in enumerate(CASES.values()) for (y, x), v in case.items()}
    df = spark.createDataFrame([(y, x, v) for (y, x), v in z.items()] + [(999, 99, None), (998, 99, float("nan"))], "yi long, xi long, value double")
    want, _, down = flood(z)
    rows = terrain.flow_directions(df, size).collect()
    assert len(rows) == len(z)
    assert {(r.yi, r.xi): r.filled for r in rows} == want
    assert {(r.yi, r.xi): None if r.down_yi is None else (r.down_yi, r.down_xi) for r in rows} == down
    assert all((r.dir == 0) == (r.down_yi is None) and (r.dir == 0 or (r.yi + D8[r.dir][0], r.xi + D8[r.dir][1]) == (r.down_yi, r.down_xi)) for r in rows)


def test_steps_over_level_ground(spark):
    filled, steps, _ = flood(CASES["maze"])
    df = spark.createDataFrame([(y, x, v) for (y, x), v in filled.items()], "yi long, xi long, filled double")
    assert max(steps.values()) > 5
    assert {(r.yi, r.xi): r.steps for r in terrain.level_steps(df, 4).collect()} == steps


def test_spill_levels(spark):
    rng = random.Random(6)
    edges = [(a, b, float(rng.randrange(20))) for a in range(40) for b in rng.sample(range(40), 2) if a != b] + [(-1, k, float(rng.randrange(30))) for k in (3, 17)]
    level = {-1: -1.0}
    queue = [(-1.0, -1)]
    while queue:
        w, c = heapq.heappop(queue)
        if w > level[c]:
            continue
        for a, b, x in edges:
            for f, t in ((a, b), (b, a)):
                if f == c and max(w, x) < level.get(t, 99.0):
                    level[t] = max(w, x)
                    heapq.heappush(queue, (level[t], t))
    df = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "a long, b long, w double")
    assert {r.node: r.level for r in terrain.spill_levels(df).collect()} == {n: v for n, v in level.items() if n >= 0}


def test_no_terrain(spark):
    assert terrain.flow_directions(spark.createDataFrame([], "yi long, xi long, value double"), 4).count() == 0
