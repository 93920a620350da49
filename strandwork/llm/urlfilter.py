"""URL filters: captures against the block-list entries that were active when they were fetched.

DataFrame operations only.  The dated changes of a list become validity intervals
[from, until) of each entry: every change of an entry closes the one before.  A
capture is matched on its host and each parent domain (entries on hosts) and on
its host with each leading path (entries with a path), as far down as the list goes, by
an equi-join, and as of its fetch time by the interval; the most specific active entry
decides.  Hosts and paths are compared in lower case, without a slash at the end.

The list is joined by a hash or sort-merge join whose skewed keys Spark splits, as
one host may have a third of all captures; the small table is broadcast only where
Spark's own size check allows it.  Entries of a capture meet in partial maxima.

Defined cases: a null url, or one without a host, is never blocked; a null fetch
time is before all entries; of changes of one entry at one time "add" wins; rows
that repeat an id are decided each by itself; further columns are ignored; an empty list blocks
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain


def validity(changes: DataFrame) -> DataFrame:
    """Changes (entry, category, action 'add' or 'remove', listed_at) to intervals (entry, category, valid_from, valid_until)."""
    c = plain(changes, "entry", "category", "action", "listed_at").where("entry is not null and listed_at is not null")
    c = c.select(F.rtrim(F.lower("entry"), F.lit("/")).alias("entry"), "category", (F.col("action") == "add").alias("on"), "listed_at")
    c = c.groupBy("entry", "listed_at").agg(F.max("on").alias("on"), F.max("category").alias("category"))
    w = Window.partitionBy("entry").orderBy("listed_at")
    c = c.withColumn("valid_until", F.lead("listed_at").over(w)).where("on")
    return c.select("entry", "category", F.col("listed_at").alias("valid_from"), "valid_until")


def deepest(listed: DataFrame) -> int:
    """Path steps of the deepest entry of a list."""
    return listed.agg(F.max(F.size(F.split("entry", "/")))).first()[0] or 1


def candidates(url: str, steps: int) -> str:
    """SQL array of the entries that could name a URL: host, parent domains, host with leading paths of at most ``steps`` steps."""
    host = f"regexp_extract(lower({url}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
    path = f"array_remove(split(regexp_extract(lower({url}), '^[^:]*://[^/?#]*(/[^?#]*)', 1), '/'), '')"
    domains = f"transform(sequence(1, size(split({host}, '[.]'))), i -> concat_ws('.', slice(split({host}, '[.]'), i, size(split({host}, '[.]')))))"
    paths = f"transform(sequence(1, least({steps}, size({path}))), i -> concat({host}, '/', concat_ws('/', slice({path}, 1, i))))"
    return f"CASE WHEN {host} = '' OR {host} IS NULL THEN array() ELSE array_distinct(concat({domains}, CASE WHEN {steps} > 0 AND size({path}) > 0 THEN {paths} ELSE array() END)) END"


def filter_urls(captures: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row for each capture (``keys``, url, fetched_at): blocked, and the entry, category and start of the deciding interval."""
    c = plain(captures, *keys, "url", "fetched_at").withColumn("_k", F.xxhash64(*keys, "url", "fetched_at"))
    listed = validity(changes)
    tries = c.where("fetched_at is not null").select("_k", "fetched_at", F.explode(F.expr(candidates("url", deepest(listed) - 1))).alias("entry")).distinct()
    hits = tries.join(listed, "entry").where("fetched_at >= valid_from and (valid_until is null or fetched_at < valid_until)")
    best = hits.groupBy("_k").agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "category", "valid_from")).alias("x"))
    out = c.join(best, "_k", "left")
    return out.select(*keys, F.col("x").isNotNull().alias("blocked"), F.col("x.entry").alias("entry"), F.col("x.category").alias("category"), F.col("x.valid_from").alias("listed_from"))
