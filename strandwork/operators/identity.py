"""Identity resolution: persons behind names and e-mail addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components


def resolve_persons(aliases: DataFrame) -> DataFrame:
    """``aliases`` (project, name, email) with person: rows that share a name or an e-mail (case aside) in a project are one.

    The person's id is a hash of the least key in reach, so it doesn't depend on the order of rows.
    Keys are joined through the components of name and e-mail keys; distinct aliases go into the joins once.
    """
    key = lambda kind, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.xxhash64("project", F.lit(kind), F.lower(F.trim(c))))
    a = aliases.withColumns({"_n": key("name", F.col("name")), "_e": key("email", F.col("email"))})
    d = a.select("_n", "_e").distinct()
    links = d.where("_n IS NOT NULL AND _e IS NOT NULL").select(F.col("_n").alias("from_id"), F.col("_e").alias("to_id"), F.lit(1).alias("weight"))
    c = connected_components(links).withColumnRenamed("vertex", "_k")
    j = a.withColumn("_k", F.coalesce("_n", "_e")).join(c, "_k", "left")
    return j.select(*aliases.columns, F.coalesce("component", "_k").alias("person"))


def slots_of_emails(resolved: DataFrame, most: int = 5) -> DataFrame:
    """One row a person: the most frequent name and up to ``most`` e-mails by frequency, then alphabetically."""
    names = resolved.where("name IS NOT NULL").groupBy("person", "name").agg(F.count("*").alias("n")).groupBy("person").agg(F.max_by("name", F.struct("n", "name")).alias("name"))
    mails = resolved.where("email IS NOT NULL").groupBy("person", F.lower("email").alias("email")).agg(F.count("*").alias("n"))
    slots = mails.groupBy("person").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "email"))), lambda x: x["email"]), 1, most).alias("emails"))
    return names.join(slots, "person", "full")


def get_or_create(dimension: DataFrame, wanted: DataFrame, key: str, identifier: str = "id") -> DataFrame:
    """New rows for keys that the dimension doesn't have; the id is a hash of the key, the same in every run."""
    new = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")
    return new.select(F.xxhash64(key).alias(identifier), key)
