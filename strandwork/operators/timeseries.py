"""Time series: windows, cumulative and scaled series, smoothing, trends, punchcards.

A series has ``keys`` (series id), a time and a value.  Windows of fixed step and
length are computed from the time by arithmetic and exploded, never joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def seconds(at: str | Column) -> Column:
    """Microsecond-exact seconds of a zone-less timestamp."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp")) / 1e6


def sliding_windows(df: DataFrame, at: str, start: str, end: str, length_days: int, step_days: int) -> DataFrame:
    """Each row once for each complete window that holds it: window_id, window_start (from the day of ``start``, every step, while the window ends by ``end``)."""
    day = F.datediff(F.col(at), F.lit(start).cast("date"))
    last = F.floor((F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) - length_days) / step_days)
    low = F.greatest(F.lit(0), F.floor((day - length_days) / step_days) + 1)
    high = F.least(last, F.floor(day / step_days))
    w = df.select("*", F.explode(F.when((high >= low) & (day >= 0), F.sequence(low, high))).alias("window_id"))
    return w.withColumn("window_start", F.date_add(F.lit(start).cast("date"), (F.col("window_id") * step_days).cast("int")))


def backward_windows(df: DataFrame, at: str, end: str, days: int) -> DataFrame:
    """Tumbling windows of ``days`` counted back from the day ``end``: window_id 0 is the last."""
    return df.withColumn("window_id", F.floor((F.datediff(F.lit(end).cast("date"), F.col(at))) / days).cast("bigint")).where("window_id >= 0")


def week_intervals(df: DataFrame, at: str, first_week: str, weeks: int) -> DataFrame:
    """Intervals of ``weeks`` weeks from a week's start: interval."""
    k = F.floor(F.datediff(F.col(at), F.lit(first_week).cast("date")) / (7 * weeks))
    return df.withColumn("interval", k.cast("bigint"))


def cumulative(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Running sums of columns: {new name: column}."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.sum(c).over(w) for name, c in values.items()})


def unique_timestamps(df: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """``unique_at``: the time, moved to one second after the one before where it isn't later.

    Closed form of the sequential rule: i + max over j <= i of (t_j - j) in whole seconds.
    """
    w = Window.partitionBy(*keys).orderBy(at, *order)
    t = F.unix_seconds(F.col(at).cast("timestamp"))
    n = df.withColumns({"_i": F.row_number().over(w), "_t": t})
    top = F.max(F.col("_t") - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("unique_at", F.timestamp_seconds(F.col("_i") + top).cast("timestamp_ntz")).drop("_i", "_t")


def min_max(df: DataFrame, keys: list[str], value: str, low: float = 0.0, high: float = 1.0, name: str = "scaled") -> DataFrame:
    """Values scaled to [low, high]; a constant series is ``high``."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(hi == lo, high).otherwise(low + (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0)) * (high - low)))


def z_score(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Columns centred and divided by their sample deviation, per key; null where that is 0 or unknown."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w)) for c in values})


def core_by_quantile(df: DataFrame, keys: list[str], value: str, quantile: float = 0.8, name: str = "core") -> DataFrame:
    """Whether the value is above the quantile (linear interpolation) of its key."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.lit(quantile)).alias("_q"))
    j = df.join(q, keys) if keys else df.join(F.broadcast(q))
    return j.withColumn(name, F.col(value) > F.col("_q")).drop("_q")


def core_by_share(df: DataFrame, keys: list[str], who: str, value: str, share: float = 0.8, name: str = "core") -> DataFrame:
    """Whether the running sum in descending order stays below round(share * total); ties by ``who``."""
    w = Window.partitionBy(*keys)
    run = F.sum(value).over(w.orderBy(F.desc(value), who).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, run < F.bround(share * F.sum(value).over(w)))


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int, name: str = "mean") -> DataFrame:
    """Mean of a full frame of rows around each; rows without a full frame are dropped."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return df.withColumns({name: F.avg(value).over(w), "_n": F.count("*").over(w)}).where(F.col("_n") == before + after + 1).drop("_n")


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int | Column) -> DataFrame:
    """Rows whose number is a multiple of ``n``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") % n == 0).drop("_r")


def by_period(df: DataFrame, keys: list[str], at: str, value: str, period: str, how: str = "median") -> DataFrame:
    """One row a period: its start, the last time in it (``label``) and the median, sum, mean or count of the value."""
    f = {"median": F.median, "sum": F.sum, "mean": F.avg, "count": F.count}[how]
    p = F.date_trunc(period, at).cast("timestamp_ntz").alias("period")
    return df.groupBy(*keys, p).agg(F.max(at).alias("label"), f(value).alias("value"))


def detrend(df: DataFrame, keys: list[str], x: str, y: str, order: str) -> DataFrame:
    """Residuals of a least-squares line per key, without the first row of each."""
    line = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    j = df.join(line, keys).withColumn("residual", F.col(y) - F.col("_s") * F.col(x) - F.col("_i"))
    return j.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r > 1").drop("_r", "_s", "_i")


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, rows, and the slope in units of its standard error (sigma)."""
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")
    )
    rest = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    error = F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (F.col("n") - 2) * F.col("sxx")))
    return g.select(*keys, "n", "slope", "intercept", F.try_divide("slope", error).alias("sigma"))


def punchcard(df: DataFrame, keys: list[str], at: str, value: str | None = None) -> DataFrame:
    """Rows, or sum of ``value``, by weekday (Monday is 0) and hour."""
    what = F.count("*") if value is None else F.sum(value)
    return df.groupBy(*keys, F.weekday(at).cast("bigint").alias("weekday"), F.hour(at).cast("bigint").alias("hour")).agg(what.alias("value"))


def fixed_width(df: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """Sums over slots of ``width`` seconds from the first to the last of each key, empty slots 0: slot, value."""
    g = df.groupBy(*keys, F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / width).alias("k")).agg(F.sum(value).alias("v"))
    span = g.groupBy(*keys).agg(F.explode(F.sequence(F.min("k"), F.max("k"))).alias("k"))
    return span.join(g, [*keys, "k"], "left").select(*keys, (F.col("k") * width).alias("slot"), F.coalesce("v", F.lit(0.0)).alias("value"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of the values' shares; null if one is negative or the sum isn't positive."""
    s = df.groupBy(*keys).agg(F.sum(value).alias("s"), F.min(value).alias("m"), F.sum(F.when(F.col(value) > 0, F.col(value) * F.log2(value))).alias("l"))
    return s.select(*keys, F.when((F.col("m") >= 0) & (F.col("s") > 0), F.log2("s") - F.col("l") / F.nullif("s", F.lit(0))).alias("entropy"))


def density(df: DataFrame, value: str, grid: list[float], width: float) -> DataFrame:
    """Gaussian kernel density at the points of a small literal grid: x, density; equal values are counted first."""
    g = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    e = g.select("v", "c", F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("x"))
    kernel = F.exp(-F.pow((F.col("x") - F.col("v")) / width, 2) / 2) / (width * float(np.sqrt(2 * np.pi)))
    return e.groupBy("x").agg((F.sum(F.col("c") * kernel) / F.sum("c")).alias("density"))


def dtw_of(a: np.ndarray, b: np.ndarray, most: int = 500) -> float:
    """Normalised dynamic-time-warping distance (symmetric steps, diagonal twice); both empty 0, one empty 1.

    Longer series are thinned to ``most`` points at a fixed stride.
    """
    if not len(a) or not len(b):
        return float(bool(len(a)) != bool(len(b)))
    thin = lambda x: x[np.linspace(0, len(x) - 1, most).round().astype(int)] if len(x) > most else x
    a, b = thin(a), thin(b)
    d = np.abs(a[:, None] - b[None, :])
    row = np.cumsum(d[0]) + d[0, 0] * 0
    row[0] = d[0, 0]
    for i in range(1, len(a)):
        new = np.empty_like(row)
        new[0] = row[0] + d[i, 0]
        best = np.minimum(row[1:] + d[i, 1:], row[:-1] + 2 * d[i, 1:])
        for j in range(1, len(b)):
            new[j] = min(best[j - 1], new[j - 1] + d[i, j])
        row = new
    return float(row[-1] / (len(a) + len(b)))


def dtw_distances(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Distance of each series from the next by ``keys[-1]``: (keys, distance).  A series is one group of at most a cycle's points."""
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("s")).select(*keys, F.col(f"s.{value}").alias("a"))
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
    pairs = series.withColumn("b", F.lead("a").over(w)).where("b IS NOT NULL")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dtw_of(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b, strict=True)])

    return pairs.select(*keys, F.round(distance("a", "b"), 6).alias("distance"))
