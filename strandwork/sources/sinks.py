"""Writers: appends, idempotent rewrites by partition, bipartite and matrix exports, graph files.

Parquet is the store.  A rewrite of a range replaces the partitions of the rows it
writes and leaves all others (dynamic partition overwrite), so a repeated job gives
the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Add rows to a table."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def rewrite(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Replace the partitions that ``df`` has rows of; a second run changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def materialize_view(df: DataFrame, path: str) -> None:
    """A view's rows as a table, replaced as a whole."""
    df.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table that these writers wrote."""
    return spark.read.parquet(path)


def get_or_create(dimension_path: str, wanted: DataFrame, key: str) -> DataFrame:
    """Ids for all keys of ``wanted``: known ones from the table, new ones (a hash of the key) appended to it."""
    from ..operators.identity import get_or_create as missing

    spark = wanted.sparkSession
    new = missing(spark.read.parquet(dimension_path), wanted, key)
    new.write.mode("append").parquet(dimension_path)
    return wanted.select(key).distinct().join(spark.read.parquet(dimension_path), key)


def timeline_change(stored: list[str], configured: list[str]) -> tuple[str, list[str]]:
    """What a changed list of revisions asks for: ("append", new ones) if it continues the stored one, else ("recreate", all)."""
    if configured[: len(stored)] == stored:
        return "append", configured[len(stored) :]
    return "recreate", list(configured)


def timeline_changes(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """As ``timeline_change`` for the lists (project, number, tag) of many projects: (project, action, number, tag) of the revisions to write."""
    old = stored.select("project", "number", F.col("tag").alias("old"))
    j = configured.select("project", "number", "tag").join(old, ["project", "number"], "full")
    per = j.groupBy("project").agg(F.max(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("tag"))).alias("changed"))
    new = j.join(per, "project").where("tag IS NOT NULL AND (changed OR old IS NULL)")
    return new.select("project", F.when(F.col("changed"), "recreate").otherwise("append").alias("action"), "number", "tag")


def with_dates(timeline: DataFrame, commits: DataFrame) -> DataFrame:
    """The timeline with dates of its tags' commits where they are known (rows are rewritten, not updated)."""
    d = commits.groupBy("tag").agg(F.max("commit_date").alias("_d"))
    return timeline.join(d, "tag", "left").withColumn("date", F.coalesce("_d", "date")).drop("_d")


def adjacency_matrix(edges: DataFrame, vertices: list[int]) -> DataFrame:
    """Receivers by senders as a dense table for export; ``vertices`` bounds the columns."""
    names = [str(v) for v in vertices]
    m = edges.groupBy(F.col("to_id").alias("person")).pivot("from_id", vertices).agg(F.sum("weight"))
    return m.na.fill(0, names).select("person", *[F.col(n) for n in names])


def heaviest_group(contributions: DataFrame) -> DataFrame:
    """For each edge the group of its largest contribution: (from_id, to_id, group, weight)."""
    return contributions.groupBy("from_id", "to_id").agg(F.max_by("group", F.struct("weight", "group")).alias("group"), F.max("weight").alias("weight"))


def series_table(series: DataFrame, at: str = "at") -> DataFrame:
    """A series with unique times and columns for start and end of the whole, as rows for a separated file."""
    w = Window.partitionBy(F.lit(0))
    return series.select(at, "value", F.min(at).over(w).alias("start"), F.max(at).over(w).alias("end"))


def write_separated(df: DataFrame, path: str, separator: str = "\t") -> None:
    """A header and rows as text, one file a partition."""
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def dot_lines(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Lines of a DOT graph's edges; the frame is written as text, never collected."""
    arrow = "->" if directed else "--"
    return edges.select(F.format_string(f'  "%s" {arrow} "%s" [weight=%s];', F.col("from_id").cast("string"), F.col("to_id").cast("string"), F.col("weight").cast("string")).alias("value"))


def graphml_lines(edges: DataFrame) -> DataFrame:
    """Edge elements of a GraphML document."""
    return edges.select(F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', F.col("from_id").cast("string"), F.col("to_id").cast("string"), F.col("weight").cast("string")).alias("value"))


def stored_communities(member: DataFrame) -> DataFrame:
    """Communities with two members or more, and the whole graph as -1: (cluster, vertex)."""
    big = member.groupBy("community").agg(F.count("*").alias("n")).where("n > 1").select("community")
    part = member.join(big, "community", "left_semi").select(F.col("community").cast("bigint").alias("cluster"), "vertex")
    return part.union(member.select(F.lit(-1).cast("bigint").alias("cluster"), "vertex"))
