"""Flow directions from terrain, by tiles.

Water leaves at outlets: cells with a missing neighbour, those at the rim of the grid among them.  The filled height of a cell is the
least height over which a path to an outlet leads.  A cell drains to its lowest neighbour by filled height; on level ground
to the neighbour fewest steps away from where the level falls or water leaves; of equal ones to the one with the least number.

A task floods one tile, a ring of its neighbours' cells around it, by a priority queue.  Cells at a tile's edge are seeds; where the
floods of two seeds meet, or two tiles do, they may spill into each other at a height.  That graph of edge cells is solved for the heights at
which each reaches an outlet (:func:`spill_levels`), and a cell's filled height is the larger one of its own tile's and its seed's.
Steps over level ground are counted within tiles, and handed on over their edges in rounds, by those tiles only that a round changes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, write_through
from .flow import D8, basins

#: Cells along a side of a tile.
TILE = 512
#: What outlets drain into; cells are numbered ``yi * ROW + xi + HALF``, so that indices may be negative.
SEA = -1
ROW, HALF = 1 << 31, 1 << 30
NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def _tiled(cells: DataFrame, size: int) -> DataFrame:
    """``cells`` once for its own tile and once for each that it is a neighbour of: ty, tx."""

    def tiles(c: str) -> Column:
        own = F.floor(F.col(c) / size).cast("long")
        inner = F.pmod(F.col(c), F.lit(size))
        return F.array_compact(F.array(own, F.when(inner == 0, own - 1), F.when(inner == size - 1, own + 1)))

    return cells.withColumn("ty", F.explode(tiles("yi"))).withColumn("tx", F.explode(tiles("xi")))


class _Grid:
    """A tile and the ring around it: values by place, missing ones NaN."""

    def __init__(self, rows: pd.DataFrame, ty: int, tx: int, size: int, column: str) -> None:
        self.y0, self.x0, self.size, self.width = ty * size - 1, tx * size - 1, size, size + 2
        self.at = ((rows.yi - self.y0) * self.width + rows.xi - self.x0).to_numpy(np.int64)
        values = np.full(self.width * self.width, np.nan)
        values[self.at] = rows[column].to_numpy(float)
        self.values = values
        y, x = np.divmod(np.arange(len(values)), self.width)
        self.own = (y > 0) & (y <= size) & (x > 0) & (x <= size) & ~np.isnan(values)
        self.edge = self.own & ((y == 1) | (y == size) | (x == 1) | (x == size))
        self.steps = np.array([dy * self.width + dx for dy, dx in NEIGHBOURS])
        inside = np.flatnonzero(self.own)
        self.inside = inside
        self.around = values[inside[:, None] + self.steps]
        self.outlet = np.zeros(len(values), bool)
        self.outlet[inside] = np.isnan(self.around).any(axis=1)

    def number(self, at: np.ndarray) -> np.ndarray:
        y, x = np.divmod(at, self.width)
        return (y + self.y0) * ROW + x + self.x0 + HALF

    def place(self, number: np.ndarray) -> np.ndarray:
        y, x = np.divmod(number, ROW)
        return (y - self.y0) * self.width + x - HALF - self.x0


def _flood(g: _Grid) -> tuple[np.ndarray, np.ndarray]:
    """(height, seed) of own cells: the least height to a seed of the tile, and that seed's place, or SEA."""
    z, steps = g.values.tolist(), g.steps.tolist()
    height, seed = [float("nan")] * len(z), [-2] * len(z)
    own = g.own.tolist()
    queue = []
    for i in np.flatnonzero(g.edge | g.outlet).tolist():
        height[i], seed[i] = z[i], SEA if g.outlet[i] else i
        queue.append((z[i], i))
    heapq.heapify(queue)
    while queue:
        level, i = heapq.heappop(queue)
        for d in steps:
            j = i + d
            if own[j] and seed[j] == -2:
                height[j], seed[j] = max(level, z[j]), seed[i]
                heapq.heappush(queue, (height[j], j))
    return np.array(height), np.array(seed)


def _spills(size: int):
    """Of a tile: where floods meet, and where its edge meets other tiles."""

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = _Grid(rows, *key, size, "value")
        height, seed = _flood(g)
        a, b, w = [], [], []
        i = g.inside
        for n, d in enumerate(g.steps):
            j = i + d
            meet = g.own[j] & (seed[i] != seed[j]) & (n < 4)  # each pair once
            across = ~g.own[j] & ~np.isnan(g.values[j])
            a += [seed[i[meet]], seed[i[across]]]
            b += [seed[j[meet]], j[across]]
            w += [np.maximum(height[i[meet]], height[j[meet]]), np.maximum(height[i[across]], g.values[j[across]])]
        a, b, w = np.concatenate(a), np.concatenate(b), np.concatenate(w)
        named = [np.where(s == SEA, SEA, g.number(s)) for s in (a, b)]
        low, high = np.minimum(*named), np.maximum(*named)
        # other tiles know this one's edge cells by number, outlets too
        sea = np.flatnonzero(g.edge & g.outlet)
        out = pd.DataFrame({"a": np.append(low, np.full(len(sea), SEA)), "b": np.append(high, g.number(sea)), "w": np.append(w, g.values[sea])})
        return out[out.a != out.b].groupby(["a", "b"], as_index=False).w.min()

    return of


def spill_levels(edges: DataFrame) -> DataFrame:
    """node, level: the least height over which each node of an undirected graph (a, b, w) reaches SEA.

    In each round every group of nodes takes its lowest way out: no member reaches the sea below it, and none needs more to
    reach the next group.  Groups at least halve in number, so rounds grow with the logarithm of the nodes.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = write_through(nodes.select("node", F.col("node").alias("grp"), F.lit(None).cast("double").alias("level")), "levels")
    left = edges
    while True:
        # a pair of groups keeps its lowest spill
        left = write_through(left.groupBy("a", "b").agg(F.min("w").alias("w")), "spills")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        # ways are ordered by height and by their two ends, alike from both sides, so that groups that take each other's way take the same one
        way = F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("b").alias("to"))
        out = write_through(both.filter(F.col("a") != SEA).groupBy(F.col("a").alias("grp")).agg(F.min(way).alias("m")).select("grp", F.col("m.to").alias("to"), F.col("m.w").alias("w")), "ways")
        if out.isEmpty():
            return state.filter(F.col("node") != SEA).select("node", "level")
        back = out.select(F.col("grp").alias("to"), F.col("to").alias("back"))
        # of two that take each other's way the smaller one stays
        tree = out.join(back.hint("merge"), "to", "left").select(F.col("grp").alias("cell"), F.when((F.col("back") == F.col("grp")) & (F.col("grp") < F.col("to")), F.lit(None)).otherwise(F.col("to")).alias("down"))
        tree = tree.unionByName(tree.sparkSession.createDataFrame([(SEA, None)], "cell long, down long"))
        heads = write_through(basins(tree).select(F.col("cell").alias("grp"), F.col("outlet").alias("next")), "heads")
        raised = state.join(out.select("grp", "w").hint("merge"), "grp", "left").join(heads.hint("merge"), "grp", "left")
        state = write_through(raised.select("node", F.coalesce("next", "grp").alias("grp"), F.greatest("level", "w").alias("level")), "levels")
        moved = left
        for c in ("a", "b"):
            moved = moved.join(heads.select(F.col("grp").alias(c), F.col("next").alias(f"__{c}")).hint("merge"), c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
        left = moved.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")


def _filled(size: int):
    """Of a tile and the levels of its edge cells: filled heights."""

    def of(key: tuple, rows: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"yi": [], "xi": [], "value": [], "filled": []})
        g = _Grid(rows, *key, size, "value")
        height, seed = _flood(g)
        level = np.full(len(g.values) + 1, -np.inf)  # the last is the sea's
        level[g.place(levels.node.to_numpy(np.int64))] = levels.level.to_numpy(float)
        i = g.inside
        y, x = np.divmod(i, g.width)
        return pd.DataFrame({"yi": y + g.y0, "xi": x + g.x0, "value": g.values[i], "filled": np.maximum(height[i], level[seed[i]])})

    return of


def fill(terrain: DataFrame, size: int = TILE) -> DataFrame:
    """yi, xi, value, filled of ``terrain`` (yi, xi, value); cells without a value are missing."""
    ship_package(terrain.sparkSession)
    cells = terrain.filter("value is not null AND NOT isnan(value)").select(F.col("yi").cast("long"), F.col("xi").cast("long"), F.col("value").cast("double"))
    tiles = _tiled(cells, size).groupBy("ty", "tx")
    levels = spill_levels(write_through(tiles.applyInPandas(_spills(size), "a long, b long, w double"), "tile-spills"))
    tile = lambda of: F.floor(of / size).cast("long")
    x = F.pmod(F.col("node"), F.lit(ROW))
    placed = levels.select("node", "level", tile(((F.col("node") - x) / ROW).cast("long")).alias("ty"), tile(x - HALF).alias("tx"))
    return tiles.cogroup(placed.groupBy("ty", "tx")).applyInPandas(_filled(size), "yi long, xi long, value double, filled double")


def _walk(g: _Grid, level: np.ndarray, distance: np.ndarray, start: np.ndarray) -> None:
    """Steps over level ground from cells whose distance is known, in place; a cell is visited again only where it gets nearer."""
    steps, own = g.steps.tolist(), g.own.tolist()
    z, d = level.tolist(), distance.tolist()
    queue = [(d[i], i) for i in start.tolist()]
    heapq.heapify(queue)
    while queue:
        n, i = heapq.heappop(queue)
        if n > d[i]:
            continue
        for s in steps:
            j = i + s
            if own[j] and z[j] == z[i] and d[j] > n + 1:
                d[j] = n + 1
                heapq.heappush(queue, (n + 1, j))
    distance[:] = d


FAR = np.iinfo(np.int64).max // 2


def _distances(size: int):
    """Of a tile: own cells with their steps over level ground as far as the tile tells, and whether the cell is at its edge."""

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = _Grid(rows, *key, size, "filled")
        distance = np.full(len(g.values), FAR)
        falls = g.outlet[g.inside] | (g.around < g.values[g.inside, None]).any(axis=1)
        distance[g.inside[falls]] = 0
        _walk(g, g.values, distance, g.inside[falls])
        i = g.inside
        y, x = np.divmod(i, g.width)
        return pd.DataFrame({"ty": key[0], "tx": key[1], "yi": y + g.y0, "xi": x + g.x0, "filled": g.values[i], "steps": distance[i], "edge": g.edge[i]})

    return of


def _nearer(size: int):
    """Of a tile and what its edge learned from others: own cells that came nearer."""

    def of(key: tuple, rows: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        g = _Grid(rows, *key, size, "filled")
        distance = np.full(len(g.values), FAR)
        distance[g.at] = rows.steps.to_numpy(np.int64)
        start = ((news.yi - g.y0) * g.width + news.xi - g.x0).to_numpy(np.int64)
        distance[start] = news.steps.to_numpy(np.int64)
        _walk(g, g.values, distance, start)
        return rows.assign(steps=distance[g.at])[["ty", "tx", "yi", "xi", "filled", "steps", "edge"]]

    return of


_STEPS = "ty long, tx long, yi long, xi long, filled double, steps long, edge boolean"


def level_steps(filled: DataFrame, size: int = TILE) -> DataFrame:
    """yi, xi, filled, steps: how many steps over level ground lead to where it falls, or to an outlet.

    A round looks at the edges of tiles only, and works on those tiles that learned of a nearer way; there are as many as the tiles that a level crosses.
    """
    ship_package(filled.sparkSession)
    state = write_through(_tiled(filled.select("yi", "xi", "filled"), size).groupBy("ty", "tx").applyInPandas(_distances(size), _STEPS), "steps")
    done = None
    while True:
        edge = state.filter("edge") if done is None else state.filter("edge").unionByName(done.filter("edge"))
        around = F.explode(F.array(*[F.struct((F.col("yi") + dy).alias("yi"), (F.col("xi") + dx).alias("xi")) for dy, dx in NEIGHBOURS]))
        told = edge.filter(F.col("steps") < FAR).select(around.alias("to"), "filled", F.col("steps") + 1, F.col("ty").alias("fy"), F.col("tx").alias("fx")).toDF("to", "filled", "told", "fy", "fx")
        told = told.select("to.yi", "to.xi", "filled", "told", "fy", "fx")
        news = edge.join(told.hint("merge"), ["yi", "xi", "filled"]).filter("(ty != fy OR tx != fx) AND told < steps").groupBy("ty", "tx", "yi", "xi").agg(F.min("told").alias("steps"))
        news = write_through(news, "nearer")
        if news.isEmpty():
            return (state if done is None else state.unionByName(done)).select("yi", "xi", "filled", "steps")
        every = state if done is None else state.unionByName(done)
        stirred = news.select("ty", "tx").distinct()
        again = every.join(stirred, ["ty", "tx"], "left_semi").groupBy("ty", "tx").cogroup(news.groupBy("ty", "tx")).applyInPandas(_nearer(size), _STEPS)
        done = every.join(stirred, ["ty", "tx"], "left_anti")
        state, done = write_through(again, "steps"), write_through(done, "steps-done")


def _directions(size: int):
    code = np.array([next(c for c, d in D8.items() if d == n) for n in NEIGHBOURS])

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = _Grid(rows, *key, size, "filled")
        steps = np.full(len(g.values), FAR)
        steps[g.at] = rows.steps.to_numpy(np.int64)
        i = g.inside
        near = i[:, None] + g.steps
        level, count = np.where(np.isnan(g.values[near]), np.inf, g.values[near]), steps[near]
        # neighbours come in the order of their numbers: the first of equal ones is the least
        lowest = level == level.min(axis=1, keepdims=True)
        best = np.argmin(np.where(lowest, count, FAR + 1), axis=1)
        y, x = np.divmod(i, g.width)
        out = pd.DataFrame({"yi": y + g.y0, "xi": x + g.x0, "filled": g.values[i], "dir": code[best]})
        away = g.outlet[i]
        out.loc[away, "dir"] = 0
        dy, dx = np.array(NEIGHBOURS)[best].T
        out["down_yi"] = (out.yi + dy).astype("Int64").where(~away)
        out["down_xi"] = (out.xi + dx).astype("Int64").where(~away)
        return out

    return of


def flow_directions(terrain: DataFrame, size: int = TILE) -> DataFrame:
    """yi, xi, filled, dir (D8 code, 0 at outlets), down_yi, down_xi (null at outlets) of ``terrain`` (yi, xi, value)."""
    filled = write_through(fill(terrain, size), "filled")
    steps = level_steps(filled, size)
    return _tiled(steps, size).groupBy("ty", "tx").applyInPandas(_directions(size), "yi long, xi long, filled double, dir int, down_yi long, down_xi long")
