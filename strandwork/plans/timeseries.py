"""Queries of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import timeseries as T
from ..sources.tables import Tables
from .base import query

_SERIES = "s AS (SELECT event_type AS series, ts AS tm, value, event_id AS id FROM events)"


def _series(t: Tables) -> DataFrame:
    return t.changes.select(F.col("subsys").alias("series"), F.col("commit_date").alias("at"), F.col("diff_size").alias("value"), "id")


@query("cumulative_progress", f"WITH {_SERIES} SELECT series, id, round(sum(value) OVER (PARTITION BY series ORDER BY tm, id), 4) AS progress FROM s", (141,))
def cumulative_progress(t: Tables) -> DataFrame:
    """Running sum of changed lines of each series."""
    return T.cumulative(_series(t), ["series"], ["at", "id"], {"progress": "value"}).select("series", "id", F.round("progress", 4).alias("progress"))


@query("cumulative_variants", f"WITH {_SERIES} SELECT series, id, round(sum(value) OVER w, 4) AS v0, round(sum(value * 2) OVER w, 4) AS v1, round(sum(ln(value + 1)) OVER w, 4) AS v2, count(*) OVER w AS v3 FROM s WINDOW w AS (PARTITION BY series ORDER BY tm, id)", (142, 9))
def cumulative_variants(t: Tables) -> DataFrame:
    """Four variants of size, running."""
    s = _series(t).withColumns({"a": F.col("value") * 2, "b": F.log1p("value"), "c": F.lit(1).cast("bigint")})
    c = T.cumulative(s, ["series"], ["at", "id"], {"v0": "value", "v1": "a", "v2": "b", "v3": "c"})
    return c.select("series", "id", *[F.round(v, 4).alias(v) for v in ("v0", "v1", "v2")], "v3")


@query("unique_timestamps", f"WITH {_SERIES}, h AS (SELECT series, id, epoch(date_trunc('hour', tm))::BIGINT AS t FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, id) AS i FROM h) SELECT series, id, CAST(to_timestamp(i + max(t - i) OVER (PARTITION BY series ORDER BY t, id)) AS TIMESTAMP) AS unique_at FROM n", (143, 144, 43))
def unique_timestamps(t: Tables) -> DataFrame:
    """Times floored to the hour, made unique by moving them on."""
    h = _series(t).select("series", "id", F.date_trunc("hour", "at").cast("timestamp_ntz").alias("at"))
    return T.unique_timestamps(h, ["series"], "at", ["id"]).select("series", "id", "unique_at")


@query("minmax_scale", f"WITH {_SERIES} SELECT series, id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM s WINDOW w AS (PARTITION BY series)", (151,))
def minmax_scale(t: Tables) -> DataFrame:
    """Values of each series scaled to [0, 1]."""
    return T.min_max(_series(t), ["series"], "value").select("series", "id", F.round("scaled", 6).alias("scaled"))


@query("zscore", f"WITH {_SERIES} SELECT series, id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM s WINDOW w AS (PARTITION BY series)", (152,))
def zscore(t: Tables) -> DataFrame:
    """Values in sample deviations from the mean of their series."""
    return T.z_score(_series(t), ["series"], ["value"]).select("series", "id", F.round("value", 6).alias("z"))


@query("core_peripheral_quantile", "WITH n AS (SELECT user_id AS author, count(*) AS freq FROM events GROUP BY 1) SELECT author, freq, freq > (SELECT quantile_cont(freq, 0.8) FROM n) AS core FROM n", (147,))
def core_peripheral_quantile(t: Tables) -> DataFrame:
    """Core developers by the 80 % quantile."""
    return T.core_by_quantile(t.changes.groupBy("author").agg(F.count("*").alias("freq")), [], "freq")


@query("core_peripheral_cumulative", "WITH n AS (SELECT event_type, user_id AS author, count(*) AS freq FROM events GROUP BY 1, 2) SELECT event_type, author, freq, sum(freq) OVER (PARTITION BY event_type ORDER BY freq DESC, author) < round_even(0.8 * sum(freq) OVER (PARTITION BY event_type), 0) AS core FROM n", (146,))
def core_peripheral_cumulative(t: Tables) -> DataFrame:
    """Core developers of each subsystem by cumulative share."""
    n = t.changes.groupBy(F.col("subsys").alias("event_type"), "author").agg(F.count("*").alias("freq"))
    return T.core_by_share(n, ["event_type"], "author", "freq")


@query("rolling_mean", f"WITH {_SERIES}, d AS (SELECT series, CAST(date_trunc('day', tm) AS TIMESTAMP) AS day, count(*) AS n FROM s GROUP BY 1, 2), r AS (SELECT series, day, avg(n) OVER w AS mean, count(*) OVER w AS k FROM d WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING)) SELECT series, day, round(mean, 6) AS mean FROM r WHERE k = 10", (153, 181))
def rolling_mean(t: Tables) -> DataFrame:
    """Ten-day mean of daily activity."""
    d = _series(t).groupBy("series", F.date_trunc("day", "at").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return T.rolling_mean(d, ["series"], "day", "n", 4, 5).select("series", "day", F.round("mean", 6).alias("mean"))


@query("nth_row_sample", f"WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY tm, id) AS r, count(*) OVER (PARTITION BY series) AS n FROM s) SELECT series, id FROM r WHERE r % greatest(1, n // 50) = 0", (154,))
def nth_row_sample(t: Tables) -> DataFrame:
    """About fifty evenly spaced rows of each series."""
    s = _series(t).withColumn("n", F.count("*").over(Window.partitionBy("series")))
    return T.every_nth(s, ["series"], ["at", "id"], F.greatest(F.lit(1), F.floor(F.col("n") / 50))).select("series", "id")


@query("first_last_per_group", "SELECT user_id AS author, arg_min(event_id, ts) AS first, arg_max(event_id, ts) AS last FROM events GROUP BY 1", (155,))
def first_last_per_group(t: Tables) -> DataFrame:
    """First and last change of each author."""
    return t.changes.groupBy("author").agg(F.min_by("id", "commit_date").alias("first"), F.max_by("id", "commit_date").alias("last"))


for _name, _period, _how, _rows in (("weekly_median", "week", "median", (134, 168)), ("monthly_median", "month", "median", (134, 168)), ("daily_count", "day", "count", (134,)), ("hourly_sum", "hour", "sum", (134, 181))):

    def _period_query(t: Tables, period: str = _period, how: str = _how) -> DataFrame:
        """One row a period, labelled by its last observation."""
        p = T.by_period(_series(t), ["series"], "at", "value", period, how)
        return p.withColumn("value", F.round("value", 4))

    query(_name, f"WITH {_SERIES} SELECT series, CAST(date_trunc('{_period}', tm) AS TIMESTAMP) AS period, max(tm) AS label, round({_how}(value), 4) AS value FROM s GROUP BY 1, 2", _rows)(_period_query)


@query("progress_series", f"""
WITH {_SERIES}, w AS (SELECT max(tm) AS tm, median(value) AS v FROM s GROUP BY date_trunc('week', tm)), m AS (SELECT max(tm) AS tm, median(value) AS v FROM s GROUP BY date_trunc('month', tm)), c AS (SELECT CAST(date_trunc('day', tm) AS TIMESTAMP) AS tm, sum(value) AS d FROM s GROUP BY 1), c2 AS (SELECT tm, sum(d) OVER (ORDER BY tm) AS v FROM c),
u AS (SELECT 'weekly' AS type, tm, v FROM w UNION ALL SELECT 'monthly', tm, v FROM m UNION ALL SELECT 'cumulative', tm, v FROM c2)
SELECT type, tm, round(v, 4) AS value, round(coalesce((v - min(v) OVER p) / nullif(max(v) OVER p - min(v) OVER p, 0), 1.0), 6) AS scaled FROM u WINDOW p AS (PARTITION BY type)""", (168, 173))
def progress_series(t: Tables) -> DataFrame:
    """Weekly and monthly medians and the cumulative series, each scaled."""
    s = _series(t)
    part = lambda name, period: T.by_period(s, [], "at", "value", period).select(F.lit(name).alias("type"), F.col("label").alias("at"), F.col("value").alias("v"))
    day = s.groupBy(F.date_trunc("day", "at").cast("timestamp_ntz").alias("at")).agg(F.sum("value").alias("d")).withColumn("type", F.lit("cumulative"))
    c = T.cumulative(day, ["type"], ["at"], {"v": "d"}).select("type", "at", "v")
    u = part("weekly", "week").unionByName(part("monthly", "month")).unionByName(c)
    return T.min_max(u, ["type"], "v").select("type", F.col("at").alias("tm"), F.round("v", 4).alias("value"), F.round("scaled", 6).alias("scaled"))


_SLIDE = "k AS (SELECT i AS window_id, CAST(DATE '1995-01-01' + CAST(i * 14 AS INT) AS DATE) AS window_start FROM range(0, {n}) r(i))"


@query("sliding_window_activity", f"WITH {_SLIDE.format(n=180)} SELECT window_id, window_start, count(*) AS commits, count(DISTINCT o_custkey) AS authors FROM orders JOIN k ON CAST(o_orderdate AS DATE) >= window_start AND CAST(o_orderdate AS DATE) < window_start + 90 WHERE window_start + 90 <= DATE '2001-08-01' GROUP BY 1, 2", (163, 274))
def sliding_window_activity(t: Tables) -> DataFrame:
    """Commits and authors in windows of 90 days every 14 days."""
    w = T.sliding_windows(t.commits.select("author", "commit_date"), "commit_date", "1995-01-01", "2001-08-01", 90, 14)
    return w.groupBy("window_id", "window_start").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))


@query("analysis_windows", "SELECT CAST(floor((DATE '2001-08-01' - CAST(o_orderdate AS DATE)) / 90.0) AS BIGINT) AS window_id, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1", (164,))
def analysis_windows(t: Tables) -> DataFrame:
    """Windows of three 30-day months, counted back from the last day."""
    w = T.backward_windows(t.commits, "commit_date", "2001-08-01", 90)
    return w.groupBy("window_id").agg(F.count("*").alias("n"), F.min("commit_date").alias("first"), F.max("commit_date").alias("last"))


@query("week_intervals", f"WITH {_SERIES} SELECT series, CAST(floor((CAST(tm AS DATE) - DATE '2024-01-01') / 14.0) AS BIGINT) AS interval, count(*) AS n FROM s GROUP BY 1, 2", (165,))
def week_intervals(t: Tables) -> DataFrame:
    """Two-week intervals."""
    return T.week_intervals(_series(t), "at", "2024-01-01", 2).groupBy("series", "interval").agg(F.count("*").alias("n"))


_RANGES = (("r1", "2024-01-01 00:00:00", "2024-01-08 12:00:00"), ("r2", "2024-01-08 12:00:00", "2024-01-20 00:00:00"))
_RANGES_SQL = "r(range_id, lo, hi) AS (VALUES " + ", ".join(f"('{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for a, b, c in _RANGES) + ")"


def _ranges(t: Tables) -> DataFrame:
    return F.broadcast(t.spark.createDataFrame(list(_RANGES), "range_id string, lo string, hi string").select("range_id", F.col("lo").cast("timestamp_ntz").alias("lo"), F.col("hi").cast("timestamp_ntz").alias("hi")))


@query("split_by_ranges", f"WITH {_SERIES}, {_RANGES_SQL} SELECT range_id, series, count(*) AS n, round(sum(value), 4) AS total FROM s JOIN r ON tm BETWEEN lo AND hi GROUP BY 1, 2", (166, 101, 180))
def split_by_ranges(t: Tables) -> DataFrame:
    """Sums of each series in closed ranges (a literal list of two)."""
    return _series(t).join(_ranges(t), F.expr("at BETWEEN lo AND hi")).groupBy("range_id", "series").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("trimmed_series", f"WITH {_SERIES}, {_RANGES_SQL} SELECT range_id, id, value FROM s JOIN r ON tm > lo AND tm < hi WHERE series = 'click'", (74, 167))
def trimmed_series(t: Tables) -> DataFrame:
    """Points strictly inside of ranges."""
    return _series(t).where("series = 'click'").join(_ranges(t), F.expr("at > lo AND at < hi")).select("range_id", "id", "value")


@query("detrend", f"""
WITH {_SERIES}, x AS (SELECT series, id, tm, value, datediff('day', TIMESTAMP '2024-01-01', tm) AS day FROM s), l AS (SELECT series, regr_slope(value, day) AS b, regr_intercept(value, day) AS a FROM x GROUP BY 1)
SELECT x.series, id, round(value - b * day - a, 6) AS residual FROM x JOIN l ON x.series = l.series QUALIFY row_number() OVER (PARTITION BY x.series ORDER BY id) > 1""", (170,))
def detrend(t: Tables) -> DataFrame:
    """Values without their linear trend."""
    s = _series(t).withColumn("day", F.datediff("at", F.lit("2024-01-01")).cast("double"))
    return T.detrend(s, ["series"], "day", "value", "id").select("series", "id", F.round("residual", 6).alias("residual"))


@query("trend_fit", f"""
WITH {_SERIES}, w AS (SELECT series, datediff('week', TIMESTAMP '2024-01-01', tm) AS week, avg(value) AS v FROM s GROUP BY 1, 2), g AS (SELECT series, count(*) AS n, regr_slope(v, week) AS slope, regr_intercept(v, week) AS a, regr_sxx(v, week) AS sxx, regr_syy(v, week) AS syy, regr_sxy(v, week) AS sxy FROM w GROUP BY 1)
SELECT series, n, round(slope, 6) AS slope, round(52 * slope / a, 6) AS yearly, round(slope / sqrt(greatest(syy - sxy * sxy / sxx, 0) / ((n - 2) * sxx)), 4) AS sigma FROM g""", (171,))
def trend_fit(t: Tables) -> DataFrame:
    """Trend of weekly means: relative increase in a year and significance."""
    w = _series(t).groupBy("series", F.floor(F.datediff("at", F.lit("2024-01-01")) / 7).cast("double").alias("week")).agg(F.avg("value").alias("v"))
    f = T.trend(w, ["series"], "week", "v")
    return f.select("series", "n", F.round("slope", 6).alias("slope"), F.round(52 * F.col("slope") / F.col("intercept"), 6).alias("yearly"), F.round("sigma", 4).alias("sigma"))


@query("punchcard_count", "SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS value FROM events GROUP BY 1, 2", (172, 199))
def punchcard_count(t: Tables) -> DataFrame:
    """Changes by weekday and hour."""
    return T.punchcard(t.changes, [], "commit_date")


@query("punchcard_sum", "SELECT event_type AS subsys, isodow(ts) - 1 AS weekday, hour(ts) AS hour, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3", (172,))
def punchcard_sum(t: Tables) -> DataFrame:
    """Changed lines by subsystem, weekday and hour."""
    return T.punchcard(t.changes, ["subsys"], "commit_date", "diff_size").withColumn("value", F.round("value", 4))


@query("fixed_width_align", f"""
WITH {_SERIES}, g AS (SELECT series, CAST(floor(epoch(tm) / 3600) AS BIGINT) AS k, sum(value) AS v FROM s GROUP BY 1, 2), a AS (SELECT series, unnest(range(min(k), max(k) + 1)) AS k FROM g GROUP BY 1)
SELECT a.series, a.k * 3600 AS slot, round(coalesce(v, 0), 4) AS value FROM a LEFT JOIN g ON a.series = g.series AND a.k = g.k""", (176,))
def fixed_width_align(t: Tables) -> DataFrame:
    """Hourly sums without gaps."""
    return T.fixed_width(_series(t), ["series"], "at", "value", 3600).withColumn("value", F.round("value", 4))


@query("shannon_entropy", "WITH g AS (SELECT event_type AS series, user_id, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), p AS (SELECT series, n / sum(n) OVER (PARTITION BY series) AS p FROM g) SELECT series, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1", (177,))
def shannon_entropy(t: Tables) -> DataFrame:
    """Entropy of the authors' shares of each subsystem."""
    g = t.changes.groupBy(F.col("subsys").alias("series"), "author").agg(F.count("*").cast("double").alias("n"))
    return T.entropy(g, ["series"], "n").withColumn("entropy", F.round("entropy", 6))


@query("ecdf", f"WITH {_SERIES} SELECT series, id, round(cume_dist() OVER (PARTITION BY series ORDER BY value), 6) AS p FROM s", (178,))
def ecdf(t: Tables) -> DataFrame:
    """Empirical distribution function of each series."""
    return _series(t).select("series", "id", F.round(F.cume_dist().over(Window.partitionBy("series").orderBy("value")), 6).alias("p"))


@query("lag_series", f"WITH {_SERIES} SELECT series, id, value, lag(value) OVER (PARTITION BY series ORDER BY tm, id) AS before FROM s", (149, 178))
def lag_series(t: Tables) -> DataFrame:
    """Values with the one before."""
    return _series(t).withColumn("before", F.lag("value").over(Window.partitionBy("series").orderBy("at", "id"))).select("series", "id", "value", "before")


@query("diff_size_correlations", "WITH x AS (SELECT l_returnflag AS f, l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem) SELECT f, round(corr(a, b), 6) AS ab, round(corr(a, c), 6) AS ac, round(corr(b, c), 6) AS bc FROM x GROUP BY f", (179, 284))
def diff_size_correlations(t: Tables) -> DataFrame:
    """Correlations of measures of size."""
    c = lambda a, b: F.round(F.corr(a, b), 6)
    return t.lineitem.groupBy(F.col("l_returnflag").alias("f")).agg(c("l_quantity", "l_extendedprice").alias("ab"), c("l_quantity", "l_discount").alias("ac"), c("l_extendedprice", "l_discount").alias("bc"))


@query("adaptive_units", f"WITH {_SERIES}, g AS (SELECT series, sum(value) AS v FROM s GROUP BY 1), m AS (SELECT max(v) AS m FROM g) SELECT series, CASE WHEN m >= 1e6 THEN 'M' WHEN m >= 1e3 THEN 'k' ELSE '' END AS unit, round(v / CASE WHEN m >= 1e6 THEN 1e6 WHEN m >= 1e3 THEN 1e3 ELSE 1 END, 4) AS value FROM g, m", (174, 173))
def adaptive_units(t: Tables) -> DataFrame:
    """Totals in units that fit the greatest."""
    g = _series(t).groupBy("series").agg(F.sum("value").alias("v"))
    m = F.col("m")
    scale = F.when(m >= 1e6, 1e6).when(m >= 1e3, 1e3).otherwise(1.0)
    unit = F.when(m >= 1e6, "M").when(m >= 1e3, "k").otherwise("")
    return g.join(F.broadcast(g.agg(F.max("v").alias("m")))).select("series", unit.alias("unit"), F.round(F.col("v") / scale, 4).alias("value"))


@query("thread_density", "WITH g AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id), x AS (SELECT unnest(range(1, 11))::DOUBLE AS x) SELECT x, round(avg(exp(-power((x - n) / 1.5, 2) / 2) / (1.5 * sqrt(2 * pi()))), 6) AS density FROM x, g GROUP BY x", (183,))
def thread_density(t: Tables) -> DataFrame:
    """Density of messages per thread."""
    n = t.turns.groupBy("thread").agg(F.count("*").alias("n"))
    return T.density(n, "n", [float(x) for x in range(1, 11)], 1.5).withColumn("density", F.round("density", 6))


@query("dtw_release_distance", None, (57, 169))
def dtw_release_distance(t: Tables) -> DataFrame:
    """Distance of the hourly activity of each week from the next, by series."""
    s = _series(t)
    hourly = s.groupBy("series", F.date_trunc("week", "at").cast("timestamp_ntz").alias("week"), F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / 3600).alias("hour")).agg(F.count("*").cast("double").alias("n"))
    return T.dtw_distances(hourly, ["series", "week"], "hour", "n")
