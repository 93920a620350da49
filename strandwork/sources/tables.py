"""Tables and the views that give them the roles of a software project's history.

Rows of ``orders`` are commits (author: customer), rows of ``lineitem`` the entities a
commit changes (file: supplier, entity: part, size: quantity), ``events`` are commits
with a time of day, ``conversations`` are mail threads.  ``nation`` is a cluster of
persons and account balance their rank.  A release cycle is a calendar quarter of
orders or a week of events.  Each view reads only the columns it names, so that
pruning and pushdown reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import dealt

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables of one folder, read when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def commits(self) -> DataFrame:
        """Orders as commits with their quarter as range."""
        quarter = F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("cycle")
        return self.orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("commit_date"),
            F.col("o_totalprice").alias("diff_size"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), quarter,
        )

    @property
    def changes(self) -> DataFrame:
        """Events as commits with a time of day; errors are corrective."""
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("author"), F.col("ts").alias("commit_date"), F.col("value").alias("diff_size"),
            F.col("event_type").alias("subsys"), (F.col("event_type") == "error").alias("corrective"),
        )

    @property
    def dependencies(self) -> DataFrame:
        """Line items as entities changed by a commit."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("line"),
            F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("commit_date"),
        )

    @property
    def authored(self) -> DataFrame:
        """Entities with the author, date and cycle of their commit."""
        return dealt(self.dependencies.drop("commit_date"), self.lineitem.count(), "commit_id").join(self.commits.select(F.col("id").alias("commit_id"), "author", "commit_date", "cycle"), "commit_id")

    @property
    def mails(self) -> DataFrame:
        """Line items as mails: thread is the order, sender the supplier."""
        return self.lineitem.select(F.col("l_orderkey").alias("thread"), F.col("l_linenumber").alias("number"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("sent"))

    @property
    def turns(self) -> DataFrame:
        """Conversation turns as mails in order."""
        return self.conversations.select(F.col("conv_id").alias("thread"), F.col("turn").alias("number"), F.col("role").alias("author"), "text")
