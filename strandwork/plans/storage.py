"""Queries that write and read again, read endpoints, and the remaining parsers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import networks as N
from ..sources import parsers as P
from ..sources import sinks as S
from ..sources.tables import Tables
from .base import query
from .networks import lines_of


def _path(t: Tables) -> str:
    return f"{G.shared_folder(t.spark)}/{uuid.uuid4().hex}"


@query("append_table", "SELECT o_orderstatus AS project, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1", (28, 48))
def append_table(t: Tables) -> DataFrame:
    """A table that two writers append to."""
    path = _path(t)
    for status in ("F", "O"):
        S.append(t.commits.where(F.col("status") == status).select("id", F.col("status").alias("project")), path, ("project",))
    return S.read(t.spark, path).groupBy("project").agg(F.count("*").alias("n"))


@query("idempotent_rewrite", "SELECT CAST(year(o_orderdate) AS INT) AS range_id, count(*) AS n, round(sum(CASE WHEN year(o_orderdate) = 1997 THEN 2 ELSE 1 END * o_totalprice), 2) AS total FROM orders GROUP BY 1", (29, 117))
def idempotent_rewrite(t: Tables) -> DataFrame:
    """A range written twice over, others untouched."""
    path = _path(t)
    c = t.commits.select("id", "diff_size", F.year("commit_date").alias("range_id"))
    S.rewrite(c, path, ("range_id",))
    for _ in range(2):
        S.rewrite(c.where("range_id = 1997").withColumn("diff_size", F.col("diff_size") * 2), path, ("range_id",))
    return S.read(t.spark, path).groupBy("range_id").agg(F.count("*").alias("n"), F.round(F.sum("diff_size"), 2).alias("total"))


@query("complexity_store", "SELECT p_type AS kind, 'size' AS variable, count(*) AS n, round(sum(p_size), 2) AS total FROM part GROUP BY 1 UNION ALL SELECT p_type, 'price', count(*), round(sum(p_retailprice), 2) FROM part GROUP BY 1", (37,))
def complexity_store(t: Tables) -> DataFrame:
    """Measures of complexity, long, through a table."""
    path = _path(t)
    long = t.part.select(F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("kind", ["size", "price"], "variable", "value")
    S.rewrite(long, path, ("variable",))
    return S.read(t.spark, path).groupBy("kind", "variable").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("csv_export", "SELECT s_suppkey AS id, s_name AS name FROM supplier", (46,))
def csv_export(t: Tables) -> DataFrame:
    """Rows through a separated file with a declared schema."""
    path = _path(t)
    S.write_separated(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    return t.spark.read.schema("id bigint, name string").option("header", True).option("sep", "\t").csv(path)


@query("cached_history", "SELECT o_custkey AS author, count(*) AS n FROM orders GROUP BY 1", (20,))
def cached_history(t: Tables) -> DataFrame:
    """A history kept as a table between steps."""
    return G.written(t.commits.select("id", "author")).groupBy("author").agg(F.count("*").alias("n"))


_LISTS = "w AS (SELECT DISTINCT o_orderpriority AS project, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q FROM orders), c AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY q) AS number, strftime(q, '%Y-%m') AS tag FROM w), o AS (SELECT project, number, CASE WHEN project = '5-LOW' AND number = 3 THEN 'old' ELSE tag END AS tag FROM c WHERE tag < '1997')"


@query("timeline_changes", f"WITH {_LISTS}, p AS (SELECT c.project, bool_or(o.tag <> c.tag) AS changed FROM c JOIN o ON o.project = c.project AND o.number = c.number GROUP BY 1) SELECT c.project, CASE WHEN changed THEN 'recreate' ELSE 'append' END AS action, CAST(c.number AS INT) AS number, c.tag FROM c JOIN p ON p.project = c.project LEFT JOIN o ON o.project = c.project AND o.number = c.number WHERE changed OR o.tag IS NULL", (31,))
def timeline_changes(t: Tables) -> DataFrame:
    """What changed lists of revisions ask for: of each priority's cycles, those until 1996 are stored, of one with another tag."""
    w = Window.partitionBy("project").orderBy("cycle")
    c = t.commits.select(F.col("priority").alias("project"), "cycle").distinct().select("project", F.row_number().over(w).alias("number"), F.date_format("cycle", "yyyy-MM").alias("tag"))
    old = F.when((F.col("project") == "5-LOW") & (F.col("number") == 3), "old").otherwise(F.col("tag"))
    return S.timeline_changes(c.where("tag < '1997'").withColumn("tag", old), c)


@query("timeline_dates", "SELECT CAST(n_nationkey AS BIGINT) AS tag, coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey % 20 = n_nationkey), TIMESTAMP '1990-01-01') AS date FROM nation", (31, 32))
def timeline_dates(t: Tables) -> DataFrame:
    """Dates of tags from their commits; tags without any keep theirs."""
    line = t.nation.select(F.col("n_nationkey").cast("bigint").alias("tag"), F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("date"))
    return S.with_dates(line, t.commits.select((F.col("author") % 20).alias("tag"), "commit_date"))


@query("artifact_reads", "SELECT CAST(year(l_shipdate) AS BIGINT) AS range_id, l_partkey AS entity, count(*) FILTER (WHERE l_returnflag = 'R') AS bugs, round(count(*) FILTER (WHERE l_returnflag = 'R') / (sum(l_quantity) + 1), 6) AS density FROM lineitem GROUP BY 1, 2", (56,))
def artifact_reads(t: Tables) -> DataFrame:
    """Quality rows of ranges with derived ratios."""
    g = t.dependencies.groupBy(F.year("commit_date").cast("bigint").alias("range_id"), "entity").agg(F.count_if(F.col("flag") == "R").alias("bugs"), F.sum("size").alias("loc"))
    return g.select("range_id", "entity", "bugs", F.round(F.col("bugs") / (F.col("loc") + 1), 6).alias("density"))


@query("read_endpoints", "SELECT 'user' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 2 UNION ALL SELECT 'project', n_nationkey, n_name FROM nation WHERE n_regionkey = 1", (49, 53, 216))
def read_endpoints(t: Tables) -> DataFrame:
    """Persons of a project, and projects."""
    u = t.customer.where("c_nationkey = 2").select(F.lit("user").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return u.union(t.nation.where("n_regionkey = 1").select(F.lit("project"), F.col("n_nationkey").cast("bigint"), "n_name"))


@query("blame_scan", "SELECT o_orderkey AS file, CAST(k AS INT) AS line, CASE WHEN k < 2 THEN md5(CAST(o_custkey AS VARCHAR)) || '00000000' ELSE md5(CAST(o_orderkey AS VARCHAR)) || '00000000' END AS commit FROM orders, range(0, 3) r(k)", (7,))
def blame_scan(t: Tables) -> DataFrame:
    """Lines of files with their commits from blame output."""
    h = lambda c: F.concat(F.md5(F.col(c).cast("string")), F.lit("00000000"))
    text = F.concat(h("o_custkey"), F.lit(" 7 1 2\nauthor x\n\tone\n"), h("o_custkey"), F.lit(" 8 2\n\ttwo\n"), h("o_orderkey"), F.lit(" 1 3 1\nauthor y\n\tthree"))
    files = t.orders.select(F.col("o_orderkey").alias("file"), text.alias("value"))
    return P.blame(files, keys=("file",)).select("file", "line", "commit")


@query("entity_scan", "SELECT 's' || s_suppkey || '.c' AS file, CAST(s_nationkey AS INT) AS start_line, 'f' || s_suppkey AS entity FROM supplier", (10,))
def entity_scan(t: Tables) -> DataFrame:
    """Functions of files from tag lines."""
    n = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("f"), n, F.lit("\ts"), n, F.lit(".c\t"), (F.col("s_nationkey") + 1).cast("string"), F.lit(';"\tf'))
    return P.entity_tags(t.supplier.select(line.alias("value")))


@query("function_body_scan", "SELECT 's' || s_suppkey || '.c' AS file, 'g' AS entity, CAST(s_nationkey AS INT) AS start_line, CAST(s_nationkey + 10 AS INT) AS end_line FROM supplier", (25,))
def function_body_scan(t: Tables) -> DataFrame:
    """Bodies of functions from documentation XML; declarations have none."""
    n, k = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    body = F.concat(F.lit('<memberdef kind="function" id="1"><name>g</name><location file="x.h" bodyfile="s'), n, F.lit('.c" bodystart="'), (k + 1).cast("string"), F.lit('" bodyend="'), (k + 11).cast("string"), F.lit('"/></memberdef><memberdef kind="function"><name>h</name><location file="x.h"/></memberdef><memberdef kind="variable"><name>v</name></memberdef>'))
    return P.function_bodies(t.supplier.select(body.alias("value")))


@query("graph_file_scan", "SELECT CAST(s_suppkey AS BIGINT) AS from_id, CAST(s_nationkey AS BIGINT) AS to_id, 2.5::DOUBLE AS weight FROM supplier", (19,))
def graph_file_scan(t: Tables) -> DataFrame:
    """Edges of a graph file (one file, one order of lines)."""
    rows = t.supplier.select((F.col("s_suppkey") + 1).alias("n"), F.concat_ws(" ", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.lit("2.5")).alias("value"))
    return P.pajek(t.spark.createDataFrame([(0, "*Arcs")], "n bigint, value string").union(rows))


@query("community_file_scan", "SELECT CAST(n_nationkey AS BIGINT) AS community, CAST(n_nationkey * 2 + k AS BIGINT) AS vertex FROM nation, range(0, 2) r(k)", (19,))
def community_file_scan(t: Tables) -> DataFrame:
    """Communities of a module file."""
    k = F.col("n_nationkey").cast("bigint")
    head = t.nation.select((k * 2).alias("n"), F.concat(F.lit("#module "), k.cast("string"), F.lit(" size: 2")).alias("value"))
    return P.community_file(head.union(t.nation.select((k * 2 + 1).alias("n"), F.concat_ws(" ", (k * 2).cast("string"), (k * 2 + 1).cast("string")).alias("value"))))


@query("posting_counts", "WITH p AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS posts FROM events GROUP BY 1, 2), c AS (SELECT *, sum(posts) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS total FROM p) SELECT event_type, max(total) - max(total) FILTER (WHERE day <= DATE '2024-01-10') AS messages FROM c GROUP BY 1", (23,))
def posting_counts(t: Tables) -> DataFrame:
    """Messages of lists since a day, from daily counts."""
    g = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") < 5).alias("spam"), F.count_if(F.col("value") >= 5).alias("rate"))
    return P.messages_since(P.posting_counts(g, ("event_type",)), "2024-01-10", ("event_type",))


@query("line_count_scan", "SELECT doc_id AS file, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents", (24,))
def line_count_scan(t: Tables) -> DataFrame:
    """Lines of files."""
    return P.line_counts(t.documents.select(F.col("doc_id").alias("file"), F.col("text").alias("value")))


@query("random_control", None, (228,))
def random_control(t: Tables) -> DataFrame:
    """Strength of collaboration of randomly placed blocks."""
    blocks = N.code_blocks(lines_of(t, "l_suppkey", "author"), ["file"], "line", ["author"]).withColumn("length", F.lit(10))
    pairs = N.pairs_within(t.lineitem, t.lineitem.count(), ["l_orderkey"])
    return N.block_strength(N.random_blocks(blocks, ["file"], "length"), ["file"], 4.0, pairs).withColumn("weight", F.round("weight", 6))
