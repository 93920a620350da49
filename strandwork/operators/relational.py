"""Joins, aggregations, ranks and set operations over project tables.

All functions are lazy.  Small sides are left to Spark's own size check; group keys
carry the range, so one query serves all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import dealt
from .networks import pairs_within


def cycles(timeline: DataFrame) -> DataFrame:
    """Release cycles from a timeline (project, tag, type, date): each release and the next, with the first candidate between.

    Returns project, start_tag, end_tag, cycle, date_start, date_end, rc_start.
    """
    releases = timeline.where(F.col("type") == "release")
    w = Window.partitionBy("project").orderBy("date", "tag")
    r = releases.select("project", F.col("tag").alias("start_tag"), F.col("date").alias("date_start"), F.lead("tag").over(w).alias("end_tag"), F.lead("date").over(w).alias("date_end")).where("end_tag IS NOT NULL")
    rc = timeline.where(F.col("type") == "rc").select("project", F.col("date").alias("rc_date"))
    first = r.join(rc, "project").where("rc_date >= date_start AND rc_date < date_end").groupBy("project", "start_tag").agg(F.min("rc_date").alias("rc_start"))
    return r.join(first, ["project", "start_tag"], "left").select("project", "start_tag", "end_tag", F.concat_ws("-", "start_tag", "end_tag").alias("cycle"), "date_start", "date_end", "rc_start")


def count_and_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows and sum of ``value`` for each key: n, total."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))


def factoids(commits: DataFrame, keys: list[str]) -> DataFrame:
    """n_authors, n_commits, total size for each key, or of all rows."""
    return commits.groupBy(*keys).agg(F.countDistinct("author").alias("n_authors"), F.count("id").alias("n_commits"), F.round(F.sum("diff_size"), 2).alias("total_size"))


def fraction(df: DataFrame, keys: list[str], condition: Column, weight: str, name: str = "fraction") -> DataFrame:
    """Share of ``weight`` where ``condition`` holds; null for a total of zero."""
    part, whole = F.sum(F.when(condition, F.col(weight)).otherwise(0.0)), F.sum(weight)
    return df.groupBy(*keys).agg(F.round(F.try_divide(part, whole), 6).alias(name))


def work_class(fraction: Column) -> Column:
    """Kind of worker by the share of work on weekends."""
    return F.when(fraction < 0.25, "workdays").when(fraction < 0.5, "continuous").otherwise("weekend")


def at_maximum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` is the greatest of their key; one scan and shuffle instead of a self-join."""
    return df.withColumn("_max", F.max(value).over(Window.partitionBy(*keys))).where(F.col(value) == F.col("_max")).drop("_max")


def shares(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``percent`` of the key's total and ``norm``, scaled between least and greatest (1 where all are equal)."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    percent = F.round(F.try_divide(100 * F.col(value), F.sum(value).over(w)), 6)
    norm = F.when(high == low, 1.0).otherwise(F.round((F.col(value) - low) / F.nullif(high - low, F.lit(0)), 6))
    return df.withColumns({"percent": percent, "norm": norm})


def top(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows; the order should be total."""
    return df.orderBy(*order).limit(n)


def top_of_each(df: DataFrame, keys: list[str], n: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; Spark prunes groups before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def weighted_edges(edges: DataFrame, source: str = "from_id", target: str = "to_id") -> DataFrame:
    """Parallel edges as one with their number as weight."""
    return edges.groupBy(source, target).agg(F.count("*").alias("weight"))


def project_bipartite(pairs: DataFrame, person: str, item: str) -> DataFrame:
    """Persons who share an item, smaller id first: p1, p2, weight 1; duplicates and single-person items go before the self-join."""
    d = pairs.select(F.col(person).alias("p"), F.col(item).alias("i"))
    rows = d.count()
    both = pairs_within(d, rows, ["i"])
    d = dealt(d, rows, "i").distinct()
    many = d.groupBy("i").agg(F.count("*").alias("c")).where("c > 1").select("i")
    d = d.join(many, "i", "left_semi")
    a, b = d.select(F.col("p").alias("p1"), "i"), d.select(F.col("p").alias("p2"), "i")
    return dealt(a.join(b, "i").where("p1 < p2").select("p1", "p2"), both, "p1", "p2").distinct().withColumn("weight", F.lit(1).cast("bigint"))


def merge_weights(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Two edge sets on ``keys``; weights are added, absent ones count 0."""
    j = a.withColumnRenamed("weight", "_a").join(b.withColumnRenamed("weight", "_b"), keys, how)
    return j.select(*keys, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("weight"))


def both_ends(edges: DataFrame, vertices: DataFrame, source: str, target: str, vertex: str) -> DataFrame:
    """Edges whose ends are both among ``vertices``."""
    v = vertices.select(F.col(vertex).alias("_v")).distinct()
    e = edges.join(v.withColumnRenamed("_v", source), source, "left_semi")
    return e.join(v.withColumnRenamed("_v", target), target, "left_semi")


def as_of(points: DataFrame, markers: DataFrame, key: str, at: str, since: str, payload: list[str]) -> DataFrame:
    """For each point the payload of the last marker of its key at or before it; nulls without one.

    Markers become intervals by ``lead``, so the join is an equi-join on ``key`` with a range residual.
    """
    w = Window.partitionBy(key).orderBy(since)
    m = markers.select(F.col(key).alias("_k"), F.col(since).alias("_from"), F.lead(since).over(w).alias("_to"), *payload)
    on = (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return points.join(m, on, "left").drop("_k", "_from", "_to")


def box_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Tukey's five numbers with hinges, whiskers at 1.5 times the hinge spread, notch and number of outliers.

    A hinge is the median of the half that includes the median: order statistics at (floor((n + 3) / 2)) / 2.
    """
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("r"), F.count("*").over(w).alias("n"))
    d = F.floor((F.col("n") + 3) / 2) / 2
    at = lambda p: F.avg(F.when((F.col("r") == F.floor(p)) | (F.col("r") == F.ceil(p)), F.col("v")))
    five = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.min("v").alias("low"), at(d).alias("q1"), at((F.col("n") + 1) / 2).alias("q2"), at(F.col("n") + 1 - d).alias("q3"), F.max("v").alias("high")
    )
    spread = F.col("q3") - F.col("q1")
    five = five.withColumns({"lo": F.col("q1") - 1.5 * spread, "hi": F.col("q3") + 1.5 * spread, "notch": 1.58 * spread / F.sqrt("n")})
    whisk = ranked.drop("n", "r").join(five.select(*keys, "lo", "hi"), keys).groupBy(*keys).agg(
        F.min(F.when(F.col("v") >= F.col("lo"), F.col("v"))).alias("whisker_low"), F.max(F.when(F.col("v") <= F.col("hi"), F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("n_outliers"),
    )
    return five.join(whisk, keys).drop("lo", "hi")


def clip_outliers(df: DataFrame, value: str, quantile: float = 0.995) -> DataFrame:
    """Values above the quantile (linear interpolation) become null."""
    limit = df.agg(F.percentile(value, F.lit(quantile)).alias("_limit"))
    return df.join(F.broadcast(limit)).withColumn(value, F.when(F.col(value) <= F.col("_limit"), F.col(value))).drop("_limit")


def sub_range(history: DataFrame, after: int, to: int) -> DataFrame:
    """The rows of a history (id, commit_date, ...) after the commit ``after`` up to and with ``to``, by date, then id; none if one is unknown.

    Two rows are looked up and their places are compared; the history itself is neither numbered nor sorted.
    """
    end = lambda i, name: history.where(F.col("id") == i).select(F.struct("commit_date", "id").alias(name)).limit(1)
    ends = F.broadcast(end(after, "_after").crossJoin(end(to, "_to")))
    place = F.struct("commit_date", "id")
    return history.join(ends).where((place > F.col("_after")) & (place <= F.col("_to"))).drop("_after", "_to")
