"""Closed-form numbers and properties of scores, ranks and statistics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions import units
from tarnflow.functions.calendar import normalize_alias
from tarnflow.functions.pet import pet
from tarnflow.operators import bankfull, climate, patterns, rank, skill


def series(spark, sim, obs):
    return spark.createDataFrame([(1, i, s, o) for i, (s, o) in enumerate(zip(sim, obs, strict=True))], "id int, i int, sim double, obs double")


def test_objectives_match_numpy(spark):
    rng = np.random.default_rng(1)
    s, o = rng.gamma(2, 3, 200), rng.gamma(2, 3, 200)
    r = skill.skill(series(spark, map(float, s), map(float, o)), ["id"]).first()
    gamma, alpha, beta = np.corrcoef(s, o)[0, 1], s.std() / o.std(), s.mean() / o.mean()
    assert r.kge == pytest.approx(1 - math.sqrt((gamma - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2))
    assert r.nse == pytest.approx(1 - ((o - s) ** 2).sum() / ((o - o.mean()) ** 2).sum())
    assert r.diff == pytest.approx(s.sum() - o.sum())


def test_pairs_with_a_missing_side_are_left_out(spark):
    sim, obs = [1.0, 2.0, 3.0, None, 5.0, 6.0, None, 8.0], [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    r = skill.skill(series(spark, sim, obs), ["id"]).first()
    assert (r.n, r.kge, r.nse) == (5, pytest.approx(1), pytest.approx(1))


def test_constant_and_empty_sides_are_missing_not_errors(spark):
    r = skill.skill(series(spark, [1.0, 1.0], [0.0, 0.0]), ["id"]).first()
    assert r.kge is None and r.beta is None
    assert skill.skill(series(spark, [], []), ["id"]).count() == 0


def test_perfect_maps(spark):
    df = series(spark, [float(x) for x in range(12)], [float(x) for x in range(12)])
    assert patterns.spaef(df, ["id"]).first().spaef == pytest.approx(1)
    assert patterns.esp(df, ["id"]).first().esp == pytest.approx(1)
    assert patterns.mspaef(df, ["id"]).first().mspaef == pytest.approx(1)
    assert patterns.waspaef(df, ["id"]).first().waspaef == pytest.approx(0, abs=1e-9)


def test_known_scores(spark):
    w = patterns.waspaef(series(spark, [float(x) for x in range(1, 10)], [float(x) for x in range(2, 11)]), ["id"]).first()
    assert (w.waspaef, w.wd, w.rho, w.sigma) == (pytest.approx(1), pytest.approx(1), pytest.approx(1), pytest.approx(1))
    m = patterns.mspaef(series(spark, [1.0, 2.0, 3.0], [0.0, 1.0, 2.0]), ["id"]).first()
    assert (m.mspaef, m.nrmse, m.bias) == (pytest.approx(0.2928932188134524), pytest.approx(1), pytest.approx(1))


def test_norm_deviation_is_value_less_one(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (2, 4.0)], "t int, v double")
    got = sorted(r[0] for r in df.select(patterns.norm_deviation("v", "t")).collect())
    assert got == [0.0, 1.0, 2.0, 3.0]


def test_unknown_metric_raises(spark):
    with pytest.raises(ValueError):
        patterns.metric("nonsense", series(spark, [1.0], [1.0]), ["id"])


def test_spearman_ties_and_p(spark):
    df = series(spark, [1.0, 2.0, 2.0, 4.0], [1.0, 3.0, 2.0, 4.0])
    r = rank.spearman_with_p(df, ["id"], "sim", "obs").first()
    a, b = np.array([1, 2.5, 2.5, 4]), np.array([1, 3, 2, 4])
    rho = np.corrcoef(a, b)[0, 1]
    assert r.rho == pytest.approx(rho)
    # two degrees of freedom: the distribution has a closed form
    t = rho * math.sqrt(2 / (1 - rho**2))
    assert r.p == pytest.approx(1 - t / math.sqrt(2 + t**2))


@pytest.mark.parametrize("dof", [1, 2, 3, 8, 30])
def test_half_beta_against_quadrature(dof):
    t = 1.7
    x = np.linspace(t, 4000, 4_000_001)
    f = (1 + x**2 / dof) ** (-(dof + 1) / 2) * math.gamma((dof + 1) / 2) / (math.sqrt(dof * math.pi) * math.gamma(dof / 2))
    tail = 2 * np.trapezoid(f, x)
    got = rank._half_beta(np.array([dof / (dof + t**2)]), np.array([dof / 2]))[0]
    assert got == pytest.approx(tail, abs=2e-4)


def test_merged_states_equal_one_shot(spark):
    random.seed(2)
    rows = [(k, f"2001-{m:02d}-{d:02d}", None if random.random() < 0.2 else random.gauss(5, 2)) for k in range(3) for m in range(1, 13) for d in (1, 9, 20)]
    df = spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.to_timestamp_ntz("t")).withColumn("part", F.pmod(F.xxhash64("t"), F.lit(4)))
    merged = climate.finish_state(climate.merge_states(climate.partial_state(df, ["k", "part"], "v"), ["k"]), ["k"]).orderBy("k").collect()
    whole = df.groupBy("k").agg(F.count("v"), F.avg("v"), F.stddev_samp("v")).orderBy("k").collect()
    for a, b in zip(merged, whole, strict=True):
        assert (a.n, a.mean, a.std) == (b[1], pytest.approx(b[2]), pytest.approx(b[3]))


def test_climatology_has_twelve_rows(spark):
    df = spark.createDataFrame([(1, "2001-02-03", 4.0)], "k int, t string, v double").withColumn("t", F.to_timestamp_ntz("t"))
    clim = {r.month: r.clim for r in climate.climatology(df, ["k"], "v").collect()}
    assert len(clim) == 12 and clim[2] == 4.0 and clim[1] is None
    assert climate.cyclic(climate.climatology(df, ["k"], "v")).count() == 14


def test_bankfull_rank_and_missing_year(spark):
    rows = [(1, f"{2000 + i}-06-01", float(v)) for i, v in enumerate([5, 9, 7, 3])] + [(2, "2000-01-01", 1.0), (2, "2001-01-01", None)]
    df = spark.createDataFrame(rows, "k int, t string, v double").withColumn("t", F.to_timestamp_ntz("t"))
    got = {r.k: r for r in bankfull.bankfull_discharge(df, ["k"], "v", 1.5).collect()}
    # n = 4: recurrences 5, 2.5, 1.67, 1.25; 1.67 is nearest to 1.5
    assert got[1].q_bkfl == 5.0 and got[1].perimeter == pytest.approx(4.8 * math.sqrt(5)) and got[2].q_bkfl is None


def test_draws_are_reproducible_and_complete(spark):
    years = spark.createDataFrame([(y,) for y in range(2000, 2010)], "year int")
    a = sorted(skill.draws(years, 3, seed=4).collect())
    assert a == sorted(skill.draws(years, 3, seed=4).collect())
    assert sum(r.times for r in a) == 30


def test_oudin_zero_below_minus_five(spark):
    df = spark.createDataFrame([(50.0, 10.0), (50.0, -6.0), (50.0, None)], "lat double, t double")
    got = [r[0] for r in df.select(pet("oudin", F.col("lat"), F.lit(1), F.col("t"))).collect()]
    assert got[0] > 0 and got[1] == 0 and got[2] is None
    with pytest.raises(ValueError):
        pet("penman", F.col("lat"), F.lit(1), F.col("t"))


def test_units_and_rules():
    assert units.conversion("K") == (1.0, -273.15, "degC")
    assert units.conversion("kg m-2", compat=True)[0] == 1000 and units.conversion("kg m-2")[0] == 1
    assert units.conversion("mm s-1", 24, compat=True)[0] == 90000 and units.conversion("mm s-1", 24)[0] == 86400
    with pytest.raises(ValueError):
        units.conversion("furlong")
    with pytest.raises(ValueError):
        units.conversion("mm s-1")
    assert units.is_intensive("K") and not units.is_intensive("mm") and units.is_intensive("mm s-1") and not units.is_intensive("m3")
    assert not units.is_intensive("K", cell_methods="time: sum") and not units.is_intensive(None, "precipitation_amount")
    assert [normalize_alias(x) for x in ("MS", "6H", "daily", "1h", "W-MON")] == ["M", "6h", "D", "h", "W"]


def test_rank_table_of_a_whole_table_with_a_hot_value(spark):
    rng = np.random.default_rng(6)
    values = [0.0] * 300 + [float(v) for v in rng.integers(-40, 40, 500)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    import pandas as pd

    want = pd.Series([v for v in values if v is not None]).rank(method="average")
    known = {v: r for v, r in zip([v for v in values if v is not None], want, strict=True)}
    assert {r.value: r["rank"] for r in rank.rank_table(df, "v").collect()} == known
    assert rank.spearman_whole(df.withColumn("w", -F.col("v")), "v", "w").first().rho == pytest.approx(-1)
    assert rank.spearman_whole(df.filter("v > 1000").withColumn("w", F.col("v")), "v", "w").first().rho is None
