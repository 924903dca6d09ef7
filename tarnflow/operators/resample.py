"""Time steps: inference, overlap, resampling to coarser and finer steps, filling.

Series are long tables; ``keys`` name a series.  Coarser steps are one aggregation.  Finer ones build the target steps of
each series from its first and last stamp and look back and ahead within the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import bucket, normalize_alias, step_alias


def _seconds(time: str | Column) -> Column:
    t = F.col(time) if isinstance(time, str) else time
    return F.unix_timestamp(t.cast("timestamp")).cast("double")


def step_hours(df: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """keys, hours, alias: the median step of each series; series of fewer than two stamps have none."""
    stamps = df.select(*keys, time).distinct()
    gap = (_seconds(time) - _seconds(F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))) / 3600
    out = stamps.withColumn("__gap", gap).filter("__gap is not null").groupBy(*keys).agg(F.percentile("__gap", F.lit(0.5)).alias("hours"))
    return out.withColumn("alias", step_alias(F.col("hours")))


def drop_repeated_stamps(df: DataFrame, keys: list[str], time: str = "t", order: list | None = None) -> DataFrame:
    """The first row of each stamp, in the order given (by default of all columns)."""
    w = Window.partitionBy(*keys, time).orderBy(*(order or [c for c in df.columns if c not in (*keys, time)] or [time]))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def to_coarser(df: DataFrame, keys: list[str], alias: str, values: dict[str, str], time: str = "t") -> DataFrame:
    """One row a key and bucket; ``values``: column to ``mean``, ``sum``, ``max`` or ``min``."""
    how = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    return df.groupBy(*keys, bucket(F.col(time), alias).alias(time)).agg(*[how[h](c).alias(c) for c, h in values.items()])


def intensive_rule(values: list[str], intensive: bool) -> dict[str, str]:
    return dict.fromkeys(values, "mean" if intensive else "sum")


def spine(df: DataFrame, keys: list[str], alias: str, time: str = "t") -> DataFrame:
    """keys and every step from a series' first to its last bucket."""
    unit = {"D": "1 day", "M": "1 month", "Y": "1 year", "W": "7 days"}.get(normalize_alias(alias), f"{normalize_alias(alias)[:-1] or 1} hours")
    ends = df.groupBy(*keys).agg(F.min(bucket(F.col(time), alias)).alias("__lo"), F.max(bucket(F.col(time), alias)).alias("__hi"))
    return ends.select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr(f"interval {unit}"))).alias(time))


def _hours(alias: str) -> int | None:
    """Hours of a step; None where steps are months or years."""
    unit = normalize_alias(alias)
    return {"M": None, "Y": None, "D": 24, "W": 168}[unit] if unit in "MYDW" else int(unit[:-1] or 1)


def _around(df: DataFrame, keys: list[str], alias: str, value: str, time: str) -> DataFrame:
    """Target steps with the last stamp and value at or before, and the next at or after.

    Stamps are ordered, not steps: each one tells the steps from it up to the next stamp, so that what a task sorts does not grow with the gaps.
    """
    t = F.col(time)
    rows = df.select(*keys, time, F.when(F.col(value).isNotNull(), F.struct(t.alias("t"), F.col(value).cast("double").alias("v"))).alias("__here"))
    # ahead is back in descending order: a frame that only grows takes one pass, one up to the series' end a pass for each row
    asc, desc = (Window.partitionBy(*keys).orderBy(o) for o in (t.asc(), t.desc()))
    back, ahead = (w.rangeBetween(Window.unboundedPreceding, Window.currentRow) for w in (asc, desc))
    rows = rows.withColumn("__b", F.last("__here", True).over(back)).withColumn("__lo", bucket(F.min(time).over(back), alias)).withColumn("__first", F.lag(time).over(asc).isNull())
    rows = rows.withColumn("__at", F.last("__here", True).over(ahead)).withColumn("__hi", bucket(F.max(time).over(ahead), alias)).withColumn("__next", F.lag(time).over(desc)).withColumn("__after", F.lag("__at").over(desc))
    hours = _hours(alias)
    if hours is None:
        own = bucket(t, alias)
        start = F.when(own == t, own).otherwise(F.timestamp_add("MONTH" if normalize_alias(alias) == "M" else "YEAR", F.lit(1), own))
    else:
        start = F.timestamp_add("HOUR", (F.ceil(F.timestamp_diff("MICROSECOND", F.col("__lo"), t) / F.lit(3_600_000_000 * hours)) * hours).cast("int"), F.col("__lo"))
    start = F.when(F.col("__first"), F.col("__lo")).otherwise(start)
    stop = F.least(F.timestamp_add("MICROSECOND", F.lit(-1), F.col("__next")), F.col("__hi"))
    unit = {"M": "1 month", "Y": "1 year"}.get(normalize_alias(alias), f"{hours} hours")
    rows = rows.withColumn("__start", start.cast("timestamp_ntz")).withColumn("__stop", stop.cast("timestamp_ntz")).filter("__start <= __stop")
    steps = rows.select(*keys, t.alias("__t"), "__b", "__at", "__after", F.explode(F.sequence("__start", "__stop", F.expr(f"interval {unit}"))).alias(time))
    # steps before a series' first stamp have nothing behind them; the stamp's own step has the stamp on both sides
    b, a = F.when(t >= F.col("__t"), F.col("__b")), F.when(t <= F.col("__t"), F.col("__at")).otherwise(F.col("__after"))
    return steps.select(*keys, time, b.alias("__b"), a.alias("__a")).select(*keys, time, *[F.col(f"__{n}.{f}").alias(f"__{n}{f}") for n in "ba" for f in "tv"])


def to_finer(df: DataFrame, keys: list[str], alias: str, value: str, how: str = "linear", time: str = "t") -> DataFrame:
    """keys, time, value at every finer step: ``linear``, ``ffill`` or ``nearest`` (ties go back)."""
    near = _around(df.withColumn(time, F.col(time).cast("timestamp_ntz")), keys, alias, value, time)
    t, b, a = _seconds(time), _seconds("__bt"), _seconds("__at")
    if how == "ffill":
        out = F.col("__bv")
    elif how == "nearest":
        out = F.when(F.col("__at").isNull() | (t - b <= a - t), F.col("__bv")).otherwise(F.col("__av"))
    elif how == "linear":
        out = F.when(F.col("__bt") == F.col("__at"), F.col("__bv")).otherwise(F.col("__bv") + (F.col("__av") - F.col("__bv")) * (t - b) / F.nullif(a - b, F.lit(0.0)))
    else:
        raise ValueError(f"unknown fill {how!r}")
    return near.select(*keys, time, out.alias(value))


def spread_totals(df: DataFrame, keys: list[str], alias: str, value: str, step_hours: float, target_hours: float, time: str = "t") -> DataFrame:
    """Totals divided evenly over the finer steps of their interval, up to the last source stamp."""
    w = Window.partitionBy(*keys).orderBy(time)
    gap = F.coalesce((_seconds(F.lead(time).over(w)) - _seconds(time)) / 3600, F.lit(float(step_hours)))
    parts = F.greatest(F.round(gap / target_hours), F.lit(1.0))
    return to_finer(df.withColumn(value, F.col(value) / parts), keys, alias, value, "ffill", time)


def adaptive(df: DataFrame, keys: list[str], values: list[str], target: str, source_hours: float | None, intensive: bool, fill: str = "linear", time: str = "t") -> DataFrame:
    """Daily or hourly by the studied tool's rule: unchanged without a step or on the target, else coarser or finer."""
    alias, hours = ("D", 24) if normalize_alias(target) == "D" else ("h", 1)
    if source_hours is None or source_hours == hours:
        return df
    if source_hours < hours:
        return to_coarser(df, keys, alias, intensive_rule(values, intensive), time)
    out = None
    for v in values:
        one = to_finer(df, keys, alias, v, fill, time) if intensive else spread_totals(df, keys, alias, v, source_hours, hours, time)
        out = one if out is None else out.join(one, [*keys, time])
    return out


def to_target(a: DataFrame, b: DataFrame, keys: list[str], alias: str, a_value: str, b_value: str, time: str = "t") -> DataFrame:
    """Both sides averaged to one step and joined on the steps that both have."""
    return to_coarser(a, keys, alias, {a_value: "mean"}, time).join(to_coarser(b, keys, alias, {b_value: "mean"}, time), [*keys, time])


def coarser_of(a: str, b: str) -> str:
    order = ["h", "D", "W", "M", "Y"]
    rank = lambda x: (order.index(x[-1]), int(x[:-1] or 1))
    return max(normalize_alias(a), normalize_alias(b), key=rank)


def overlap(a: DataFrame, b: DataFrame, alias: str, a_value: str, b_value: str, time: str = "t") -> DataFrame:
    """One row (start, stop, n_a, n_b): the buckets from the later first to the earlier last step that has a value."""
    ends = []
    for f, v in ((a, a_value), (b, b_value)):
        there = F.when(F.col(v).isNotNull(), bucket(F.col(time), alias))
        ends.append(f.agg(F.min(there).alias("lo"), F.max(there).alias("hi"), F.count(v).alias("n")))
    x, y = (e.select(*[F.col(c).alias(f"{c}_{n}") for c in ("lo", "hi", "n")]) for e, n in zip(ends, "ab", strict=True))
    both = x.crossJoin(y)  # one row each
    start, stop = F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")
    ok = F.col("lo_a").isNotNull() & F.col("lo_b").isNotNull() & (start <= stop)
    return both.select(F.when(ok, start).alias("start"), F.when(ok, stop).alias("stop"), "n_a", "n_b")


def crop_to_overlap(a: DataFrame, b: DataFrame, alias: str, a_value: str, b_value: str, time: str = "t") -> tuple[DataFrame, DataFrame]:
    """Both tables cut to whole common buckets; raises with the counts where there are none."""
    found = overlap(a, b, alias, a_value, b_value, time).first()
    if found.start is None:
        raise ValueError(f"no overlapping time: {found.n_a} and {found.n_b} values")
    inside = bucket(F.col(time), alias).between(F.lit(found.start).cast("timestamp_ntz"), F.lit(found.stop).cast("timestamp_ntz"))
    return a.filter(inside), b.filter(inside)


def long_term_mean(df: DataFrame, keys: list[str], value: str, alias: str, intensive: bool = True, threshold: float | None = None, time: str = "t") -> DataFrame:
    """keys, value: means (or sums) per bucket first, then the plain mean over the buckets; values up to ``threshold`` are missing."""
    x = F.col(value) if threshold is None else F.when(F.col(value) > threshold, F.col(value))
    steps = to_coarser(df.withColumn(value, x), keys, alias, intensive_rule([value], intensive), time)
    return steps.groupBy(*keys).agg(F.avg(value).alias(value))


def merge_files(parts: list[DataFrame], keys: list[str], time: str = "t") -> DataFrame:
    """Union of parts; of a stamp in several parts the first part's row stays."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return drop_repeated_stamps(out, keys, time, ["__part"]).drop("__part")
