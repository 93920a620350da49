"""Queries of graph analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import networks as N
from ..sources.tables import Tables
from .base import query

_E = "e AS (SELECT a.l_suppkey AS from_id, b.l_suppkey AS to_id, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_shipdate > b.l_shipdate GROUP BY 1, 2)"
_U = "u AS (SELECT DISTINCT least(from_id, to_id) AS u, greatest(from_id, to_id) AS v FROM e), both_ AS (SELECT u, v FROM u UNION ALL SELECT v, u FROM u)"
#: Parts that change together twice or more: a sparse graph of many components.
_S = "k AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem), s AS (SELECT x.e AS from_id, y.e AS to_id, count(*) AS weight FROM k x JOIN k y ON x.c = y.c AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 3)"
_MEMBER = "m AS (SELECT s_suppkey AS vertex, s_nationkey AS community FROM supplier)"


def _edges(t: Tables) -> DataFrame:
    """The network of all mails."""
    return N.mail_edges(t.mails)


def _sparse(t: Tables) -> DataFrame:
    return N.co_changes(t.dependencies, 3).select(F.col("e1").alias("from_id"), F.col("e2").alias("to_id"), F.col("n").alias("weight"))


def _member(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("vertex"), F.col("s_nationkey").alias("community"))


@query("degree_strength", f"WITH {_E}, x AS (SELECT from_id AS vertex, 0 AS i, 1 AS o, 0 AS iw, weight AS ow FROM e UNION ALL SELECT to_id, 1, 0, weight, 0 FROM e) SELECT vertex, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(iw)::BIGINT AS in_strength, sum(ow)::BIGINT AS out_strength FROM x GROUP BY 1", (158, 245))
def degree_strength(t: Tables) -> DataFrame:
    """Degrees and strengths of the mail network."""
    return G.degrees(_edges(t))


@query("graph_density", f"WITH {_E} SELECT (SELECT count(*) FROM (SELECT from_id FROM e UNION SELECT to_id FROM e)) AS vertices, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM (SELECT from_id FROM e UNION SELECT to_id FROM e)) * ((SELECT count(*) FROM (SELECT from_id FROM e UNION SELECT to_id FROM e)) - 1)), 6) AS density FROM e", (246,))
def graph_density(t: Tables) -> DataFrame:
    """Density of the mail network."""
    return G.density(_edges(t)).withColumn("density", F.round("density", 6))


@query("reciprocity", f"WITH {_E} SELECT round(avg(CASE WHEN b.from_id IS NULL THEN 0 ELSE 1 END), 6) AS reciprocity FROM e LEFT JOIN e b ON e.from_id = b.to_id AND e.to_id = b.from_id", (259,))
def reciprocity(t: Tables) -> DataFrame:
    """Reciprocity of the mail network."""
    return G.reciprocity(_edges(t)).withColumn("reciprocity", F.round("reciprocity", 6))


@query("transitivity", f"""
WITH {_E}, {_U}, d AS (SELECT u AS vertex, count(*) AS degree FROM both_ GROUP BY 1), t AS (SELECT x.u AS vertex, count(*) AS n FROM both_ x JOIN both_ y ON x.u = y.u AND x.v < y.v JOIN u ON u.u = x.v AND u.v = y.v GROUP BY 1)
SELECT d.vertex, degree, coalesce(n, 0) AS triangles, CASE WHEN degree > 1 THEN round(2 * coalesce(n, 0) / (degree * (degree - 1)), 6) END AS transitivity FROM d LEFT JOIN t ON d.vertex = t.vertex""", (247,))
def transitivity(t: Tables) -> DataFrame:
    """Local transitivity of the mail network."""
    return G.transitivity(G.written(_edges(t))).withColumn("transitivity", F.round("transitivity", 6))


@query("gini", "WITH n AS (SELECT event_type, user_id, count(*) AS x FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x, user_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM n) SELECT event_type, round(sum((2 * i - n - 1) * x) / (any_value(n) * sum(x)), 6) AS gini FROM r GROUP BY 1", (250,))
def gini(t: Tables) -> DataFrame:
    """Inequality of authors' changes in each subsystem."""
    n = t.changes.groupBy(F.col("subsys").alias("event_type"), "author").agg(F.count("*").alias("x"))
    return G.gini(n, ["event_type"], "x").withColumn("gini", F.round("gini", 6))


_PR_ROUNDS = 10


def _pagerank_sql() -> str:
    parts = [f"WITH {_E}, o AS (SELECT from_id, sum(weight) AS w FROM e GROUP BY 1), v AS (SELECT from_id AS vertex FROM e UNION SELECT to_id FROM e), n AS (SELECT count(*) AS n FROM v), p AS (SELECT e.from_id, to_id, weight / w AS p FROM e JOIN o ON e.from_id = o.from_id), r0 AS MATERIALIZED (SELECT vertex, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for k in range(1, _PR_ROUNDS + 1):
        r = f"r{k - 1}"
        parts.append(f"r{k} AS MATERIALIZED (SELECT v.vertex, 0.15 / n + 0.85 * (coalesce(g, 0) + (SELECT coalesce(sum(rank), 0) FROM {r} WHERE vertex NOT IN (SELECT from_id FROM o)) / n) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT to_id, sum(rank * p) AS g FROM p JOIN {r} ON {r}.vertex = from_id GROUP BY 1) x ON x.to_id = v.vertex)")
    return ", ".join(parts) + f" SELECT vertex, round(rank, 8) AS rank FROM r{_PR_ROUNDS}"


@query("pagerank", _pagerank_sql(), (34, 238))
def pagerank(t: Tables) -> DataFrame:
    """PageRank of the mail network, ten rounds."""
    return G.pagerank(_edges(t), 0.85, _PR_ROUNDS).withColumn("rank", F.round("rank", 8))


@query("pagerank_reversed", None, (238, 269))
def pagerank_reversed(t: Tables) -> DataFrame:
    """PageRank of the network of all mails along reversed edges with damping 0.3, and the class by its 80 % quantile."""
    e = _edges(t).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "weight")
    r = G.written(G.pagerank(e, 0.3, 20))
    return r.join(F.broadcast(r.agg(F.percentile("rank", F.lit(0.8)).alias("q")))).select("vertex", F.round("rank", 8).alias("rank"), G.rank_class(F.col("rank"), F.col("q")).alias("class"))


_COMP = f"""WITH RECURSIVE {_S}, b AS (SELECT from_id AS u, to_id AS v FROM s UNION SELECT to_id, from_id FROM s), reach(u, v) AS (SELECT u, u FROM b UNION SELECT reach.u, b.v FROM reach JOIN b ON reach.v = b.u), c AS (SELECT u AS vertex, min(v) AS component FROM reach GROUP BY 1)"""


@query("components", f"{_COMP} SELECT * FROM c", (239,))
def components(t: Tables) -> DataFrame:
    """Weak components of the co-change graph."""
    return G.connected_components(_sparse(t))


@query("largest_component", f"{_COMP}, n AS (SELECT component, count(*) AS size FROM c GROUP BY 1), top AS (SELECT component FROM n ORDER BY size DESC, component LIMIT 1) SELECT vertex FROM c WHERE component = (SELECT component FROM top)", (161,))
def largest_component(t: Tables) -> DataFrame:
    """Vertices of the largest weak component."""
    c = G.written(G.connected_components(_sparse(t)))
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(top), "component", "left_semi").select("vertex")


_W = "w AS (SELECT least(from_id, to_id) AS u, greatest(from_id, to_id) AS v, sum(weight) AS w FROM e GROUP BY 1, 2)"


@query("community_measures", f"""
WITH {_E}, {_W}, {_MEMBER}, j AS (SELECT w.w, a.community AS ca, b.community AS cb FROM w JOIN m a ON a.vertex = u JOIN m b ON b.vertex = v), x AS (SELECT ca AS c, w, ca = cb AS i FROM j UNION ALL SELECT cb, w, ca = cb FROM j),
g AS (SELECT c, sum(w) AS volume, sum(CASE WHEN i THEN w ELSE 0 END) / 2 AS internal FROM x GROUP BY c), t AS (SELECT sum(w) AS m FROM j)
SELECT community, count(*) AS size, round(coalesce(any_value((volume - 2 * internal) / volume), NULL), 6) AS conductance, round(any_value(coalesce(internal, 0) / t.m - power(coalesce(volume, 0) / (2 * t.m), 2)), 6) AS modularity, round(any_value(2 * internal / volume), 6) AS internal_share
FROM m LEFT JOIN g ON c = community CROSS JOIN t GROUP BY community""", (252, 253, 254, 255))
def community_measures(t: Tables) -> DataFrame:
    """Conductance, modularity and internal share of the suppliers of each nation."""
    c = G.community_measures(G.written(_edges(t)), _member(t))
    return c.select("community", "size", *[F.round(x, 6).alias(x) for x in ("conductance", "modularity", "internal_share")])


@query("modularization", f"""
WITH {_E}, {_U}, {_MEMBER}, z AS (SELECT community, count(*) AS n FROM m GROUP BY 1), j AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS edges FROM u JOIN m a ON a.vertex = u.u JOIN m b ON b.vertex = u.v GROUP BY 1, 2)
SELECT a, b, edges, round(edges / nullif(CASE WHEN a = b THEN x.n * (x.n - 1) / 2 ELSE x.n * y.n END, 0), 6) AS density FROM j JOIN z x ON x.community = a JOIN z y ON y.community = b""", (254,))
def modularization(t: Tables) -> DataFrame:
    """Density of links between communities."""
    return G.modularization(_edges(t), _member(t)).withColumn("density", F.round("density", 6))


@query("contracted_graph", f"WITH {_E}, {_MEMBER} SELECT a.community AS from_id, b.community AS to_id, sum(weight)::BIGINT AS weight FROM e JOIN m a ON a.vertex = from_id JOIN m b ON b.vertex = to_id WHERE a.community <> b.community GROUP BY 1, 2", (256,))
def contracted_graph(t: Tables) -> DataFrame:
    """The graph of communities."""
    return G.contract(_edges(t), _member(t))


@query("community_links", f"WITH {_E}, {_U}, {_MEMBER} SELECT x.u AS vertex, a.community, count(*) FILTER (WHERE a.community = b.community) AS inner, count(*) FILTER (WHERE a.community <> b.community) AS outer FROM both_ x JOIN m a ON a.vertex = x.u JOIN m b ON b.vertex = x.v GROUP BY 1, 2".replace("AS inner", 'AS "inner"').replace("AS outer", 'AS "outer"'), (261,))
def community_links(t: Tables) -> DataFrame:
    """Inner and outer links of members."""
    return G.link_sides(_edges(t), _member(t))


@query("community_fractions", f"""
WITH {_E}, {_MEMBER}, x AS (SELECT from_id AS vertex, to_id AS o, weight FROM e UNION ALL SELECT to_id, from_id, weight FROM e), g AS (SELECT x.vertex, community, sum(weight) AS w FROM x JOIN m ON m.vertex = o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vertex ORDER BY w DESC, community) AS r FROM g)
SELECT vertex, community, round(w / sum(w) OVER (PARTITION BY vertex), 6) AS fraction FROM r WHERE r <= 4""", (267,))
def community_fractions(t: Tables) -> DataFrame:
    """Shares of each vertex in its four strongest communities."""
    return G.community_fractions(_edges(t), _member(t)).withColumn("fraction", F.round("fraction", 6))


@query("important_vertices", f"WITH {_E}, {_MEMBER}, d AS (SELECT to_id AS vertex, sum(weight) AS w FROM e GROUP BY 1) SELECT community, arg_max(m.vertex, (w, -m.vertex)) AS vertex, max(w)::BIGINT AS strength FROM m JOIN d ON d.vertex = m.vertex GROUP BY community", (268, 260))
def important_vertices(t: Tables) -> DataFrame:
    """The vertex of greatest strength in each community."""
    d = _edges(t).groupBy(F.col("to_id").alias("vertex")).agg(F.sum("weight").alias("w"))
    return d.join(_member(t), "vertex").groupBy("community").agg(F.max_by("vertex", F.struct("w", -F.col("vertex"))).alias("vertex"), F.max("w").alias("strength"))


_TWO = "a AS (SELECT DISTINCT c_nationkey AS cluster, o_custkey AS member FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'), b AS (SELECT DISTINCT c_nationkey % 7 AS cluster, o_custkey AS member FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-04-01' AND o_orderdate < TIMESTAMP '1997-07-01')"


def _two(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.commits.join(t.customer.select(F.col("c_custkey").alias("author"), "c_nationkey"), "author")
    part = lambda lo, hi, key: c.where(f"commit_date >= timestamp_ntz '{lo}' AND commit_date < timestamp_ntz '{hi}'").select(key.alias("cluster"), F.col("author").alias("member")).distinct()
    return part("1997-01-01", "1997-04-01", F.col("c_nationkey")), part("1997-04-01", "1997-07-01", F.col("c_nationkey") % 7)


_OVERLAP = f"{_TWO}, n AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS n FROM a JOIN b ON a.member = b.member GROUP BY 1, 2), o AS (SELECT n.a, n.b, CASE WHEN n < 0.1 * least(x.s, y.s) THEN 0.0 ELSE n / greatest(x.s, y.s) END AS overlap FROM n JOIN (SELECT cluster, count(*) AS s FROM a GROUP BY 1) x ON x.cluster = n.a JOIN (SELECT cluster, count(*) AS s FROM b GROUP BY 1) y ON y.cluster = n.b)"


@query("cluster_overlap", f"WITH {_OVERLAP} SELECT a, b, round(overlap, 6) AS overlap FROM o", (264,))
def cluster_overlap(t: Tables) -> DataFrame:
    """Overlap of clusters of two cycles."""
    return G.cluster_overlap(*_two(t)).withColumn("overlap", F.round("overlap", 6))


@query("cluster_tracking", None, (265,))
def cluster_tracking(t: Tables) -> DataFrame:
    """Clusters of one cycle followed into the next."""
    return G.track_clusters(G.cluster_overlap(*_two(t)).withColumn("range", F.lit(1).cast("bigint")))


def _half_sql(when: str) -> str:
    return f"SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS u, greatest(a.l_suppkey, b.l_suppkey) AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_shipdate > b.l_shipdate WHERE a.l_shipdate {when} TIMESTAMP '1995-07-01' AND b.l_shipdate {when} TIMESTAMP '1995-07-01'"


@query("graph_difference", f"""
WITH a AS ({_half_sql('<')}), b AS ({_half_sql('>=')}), sh AS (SELECT x FROM (SELECT u AS x FROM a UNION SELECT v FROM a) INTERSECT SELECT x FROM (SELECT u AS x FROM b UNION SELECT v FROM b)),
j AS (SELECT coalesce(a.u, b.u) AS u, coalesce(a.v, b.v) AS v, a.u IS NOT NULL AND b.u IS NOT NULL AS both_ FROM a FULL JOIN b ON a.u = b.u AND a.v = b.v), k AS (SELECT * FROM j WHERE u IN (SELECT x FROM sh) AND v IN (SELECT x FROM sh))
SELECT vertex, round(1 - avg(CASE WHEN both_ THEN 1 ELSE 0 END), 6) AS difference FROM (SELECT u AS vertex, both_ FROM k UNION ALL SELECT v, both_ FROM k) GROUP BY 1""", (266,))
def graph_difference(t: Tables) -> DataFrame:
    """Difference of the mail networks before and after a date, by vertex."""
    a, b = (G.written(N.mail_edges(t.mails.where(f"sent {when} timestamp_ntz '1995-07-01'"))) for when in ("<", ">="))
    return G.graph_difference(a, b).withColumn("difference", F.round("difference", 6))


_WEEK = "SELECT user_id AS vertex, count(*) - 1 AS degree FROM events WHERE ts >= TIMESTAMP '2024-01-{a:02}' AND ts < TIMESTAMP '2024-01-{b:02}' GROUP BY 1 HAVING count(*) > 5"


@query("turnover", f"""
WITH x AS ({_WEEK.format(a=1, b=8)}), y AS ({_WEEK.format(a=8, b=15)}), j AS (SELECT coalesce(x.vertex, y.vertex) AS vertex, coalesce(x.degree, -1) AS x, coalesce(y.degree, -1) AS y FROM x FULL JOIN y ON x.vertex = y.vertex), q AS (SELECT quantile_cont(x, 0.8) AS qx, quantile_cont(y, 0.8) AS qy FROM j)
SELECT vertex, CASE WHEN x < 0 THEN 'absent' WHEN x = 0 THEN 'isolated' WHEN x > qx THEN 'core' ELSE 'peripheral' END AS before, CASE WHEN y < 0 THEN 'absent' WHEN y = 0 THEN 'isolated' WHEN y > qy THEN 'core' ELSE 'peripheral' END AS after FROM j, q""", (273, 149))
def turnover(t: Tables) -> DataFrame:
    """States of developers in two weeks."""
    week = lambda a, b: t.changes.where(f"commit_date >= timestamp_ntz '2024-01-{a:02}' AND commit_date < timestamp_ntz '2024-01-{b:02}'").groupBy(F.col("author").alias("vertex")).agg((F.count("*") - 1).alias("degree")).where("degree > 4")
    return G.turnover(week(1, 8), week(8, 15))


_STATES = "w AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM events), p AS (SELECT DISTINCT user_id AS author FROM events), n AS (SELECT user_id AS author, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, count(*) AS n FROM events GROUP BY 1, 2), st AS (SELECT p.author, w.week, CASE WHEN n IS NULL THEN 'absent' WHEN n >= 14 THEN 'core' ELSE 'peripheral' END AS state FROM p CROSS JOIN w LEFT JOIN n ON n.author = p.author AND n.week = w.week), l AS (SELECT state AS before, lead(state) OVER (PARTITION BY author ORDER BY week) AS after FROM st), g AS (SELECT before, after, count(*) AS n FROM l WHERE after IS NOT NULL GROUP BY 1, 2)"


@query("markov", f"WITH {_STATES} SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS p FROM g", (272,))
def markov(t: Tables) -> DataFrame:
    """Transitions of developers' states from week to week (the weeks are few and known from the span)."""
    week = F.date_trunc("week", "commit_date").cast("timestamp_ntz").alias("week")
    n = t.changes.groupBy("author", week).agg(F.count("*").alias("n"))
    spine = n.select("author").distinct().crossJoin(F.broadcast(n.select("week").distinct()))
    s = spine.join(n, ["author", "week"], "left").select("author", "week", F.when(F.col("n").isNull(), "absent").when(F.col("n") >= 14, "core").otherwise("peripheral").alias("state"))
    return G.markov(s, "author", "week", "state").withColumn("p", F.round("p", 6))


@query("edge_probabilities", f"""
WITH {_E}, {_U}, d AS (SELECT u AS vertex, count(*) AS d FROM both_ GROUP BY 1), c AS (SELECT vertex, d > (SELECT quantile_cont(d, 0.8) FROM d) AS core FROM d), n AS (SELECT count(*) FILTER (WHERE core) AS k, count(*) AS n FROM c), j AS (SELECT a.core AS a, b.core AS b FROM u JOIN c a ON a.vertex = u.u JOIN c b ON b.vertex = u.v)
SELECT round(count(*) FILTER (WHERE a AND b) / any_value(nullif(k * (k - 1) / 2, 0)), 6) AS core_core, round(count(*) FILTER (WHERE NOT a AND NOT b) / any_value(nullif((n - k) * (n - k - 1) / 2, 0)), 6) AS peripheral_peripheral, round(count(*) FILTER (WHERE a <> b) / any_value(n * (n - 1) / 2), 6) AS core_peripheral FROM j, n""", (271,))
def edge_probabilities(t: Tables) -> DataFrame:
    """Probabilities of edges within and across classes."""
    e = _edges(t)
    u = G.undirected(e)
    d = u.select(F.explode(F.array("u", "v")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("d"))
    c = d.join(F.broadcast(d.agg(F.percentile("d", F.lit(0.8)).alias("q")))).select("vertex", (F.col("d") > F.col("q")).alias("core"))
    p = G.edge_probabilities(e, c)
    return p.select(*[F.round(x, 6).alias(x) for x in p.columns])


@query("agreement", """
WITH c AS (SELECT count(*) AS n, sum(quality * toxic) AS n11, sum((1 - quality) * (1 - toxic)) AS n00, sum(quality) AS s, sum(toxic) AS t FROM labels), p AS (SELECT *, (n11 + n00) / n AS po, (s * t + (n - s) * (n - t)) / (n * n) AS pe FROM c)
SELECT round(po, 6) AS agreement, round(n11 / (s + t - n11), 6) AS jaccard_one, round(n00 / (2 * n - s - t - n00), 6) AS jaccard_zero, round((po - pe) / (1 - pe), 6) AS kappa FROM p""", (270,))
def agreement(t: Tables) -> DataFrame:
    """Jaccard indices and kappa of two ratings."""
    a = G.agreement(t.labels, "quality", "toxic")
    return a.select(*[F.round(x, 6).alias(x) for x in a.columns])


_RANKED = "r AS (SELECT f, rank() OVER (PARTITION BY f ORDER BY a) + (count(*) OVER (PARTITION BY f, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY f ORDER BY b) + (count(*) OVER (PARTITION BY f, b) - 1) / 2 AS rb FROM x)"


@query("spearman", f"WITH x AS (SELECT l_returnflag AS f, l_quantity AS a, l_discount AS b FROM lineitem), {_RANKED} SELECT f, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY f", (270, 280))
def spearman(t: Tables) -> DataFrame:
    """Spearman's rho of size and discount by flag."""
    x = t.lineitem.select(F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return G.spearman(x, ["f"], "a", "b").withColumn("rho", F.round("rho", 6))


@query("pairwise_spearman", """
WITH q AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, count(*)::DOUBLE AS commits, count(DISTINCT o_custkey)::DOUBLE AS authors, round(sum(o_totalprice), 2) AS size FROM orders GROUP BY 1), u AS (SELECT q, 'commits' AS v, commits AS x FROM q UNION ALL SELECT q, 'authors', authors FROM q UNION ALL SELECT q, 'size', size FROM q),
r AS (SELECT *, rank() OVER (PARTITION BY v ORDER BY x) + (count(*) OVER (PARTITION BY v, x) - 1) / 2 AS r FROM u) SELECT a.v AS first, b.v AS second, count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM r a JOIN r b ON a.q = b.q AND a.v < b.v GROUP BY 1, 2""", (280,))
def pairwise_spearman(t: Tables) -> DataFrame:
    """Rank correlations of all pairs of measures of the cycles."""
    q = t.commits.groupBy("cycle").agg(F.count("*").cast("double").alias("commits"), F.countDistinct("author").cast("double").alias("authors"), F.round(F.sum("diff_size"), 2).alias("size"))
    u = G.average_rank(q.unpivot("cycle", ["commits", "authors", "size"], "v", "x"), ["v"], "x", "r")
    j = u.select("cycle", F.col("v").alias("first"), F.col("r").alias("a")).join(u.select("cycle", F.col("v").alias("second"), F.col("r").alias("b")), "cycle").where("first < second")
    return j.groupBy("first", "second").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("rho"))


@query("path_measures", None, (248, 249, 259))
def path_measures(t: Tables) -> DataFrame:
    """Betweenness, closeness, eccentricity and eigenvector centrality in the components of the co-change graph."""
    return G.per_component(_sparse(t), G.path_measures, "vertex bigint, betweenness double, closeness double, eccentricity bigint, eigenvector double")


@query("communities", None, (35, 240, 241))
def communities(t: Tables) -> DataFrame:
    """Communities of the co-change graph by greedy modularity in each component."""
    return G.per_component(_sparse(t), G.communities_of, "vertex bigint, community bigint")


@query("walktrap", None, (242,))
def walktrap(t: Tables) -> DataFrame:
    """Communities of the co-change graph by random walks in each component."""
    return G.per_component(_sparse(t), G.walktrap_of, "vertex bigint, community bigint")


@query("clique_communities", None, (243,))
def clique_communities(t: Tables) -> DataFrame:
    """Overlapping communities of triangles in the network of all mails."""
    return G.clique_communities(G.written(_edges(t)))


@query("power_law", "WITH n AS (SELECT o_custkey, count(*) AS x FROM orders GROUP BY 1) SELECT count(*) AS n, round(1 + count(*) / sum(ln(x / 4.5)), 6) AS alpha FROM n WHERE x >= 5", (251,))
def power_law(t: Tables) -> DataFrame:
    """Exponent of the tail of commits per author."""
    n = t.commits.groupBy("author").agg(F.count("*").alias("x"))
    return G.power_law(n, "x", 5).select("n", F.round("alpha", 6).alias("alpha"))


@query("principal_components", None, (283,))
def principal_components(t: Tables) -> DataFrame:
    """Two components of measures of line items by flag."""
    return G.principal_components(t.lineitem, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("classical_scaling", None, (283, 297))
def classical_scaling(t: Tables) -> DataFrame:
    """Subsystem types in two dimensions by the distance of their mean profiles (few types)."""
    g = t.lineitem.groupBy("l_returnflag", F.col("l_linenumber").cast("bigint").alias("a")).agg(F.avg("l_quantity").alias("x"), F.avg("l_discount").alias("y"))
    j = g.join(g.select("l_returnflag", F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2")), "l_returnflag")
    d = j.select("l_returnflag", "a", "b", F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)).alias("d"))
    return G.classical_scaling(d, "l_returnflag")


@query("group_info", """
WITH m AS (SELECT c_nationkey AS cluster, c_custkey AS person, c_acctbal AS rank FROM customer) SELECT cluster, person, rank, count(*) OVER (PARTITION BY cluster) AS size, round(rank / sum(abs(rank)) OVER (PARTITION BY cluster), 6) AS share FROM m""", (260,))
def group_info(t: Tables) -> DataFrame:
    """Members of communities with rank, size and share."""
    w = Window.partitionBy("cluster")
    m = t.customer.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("person"), F.col("c_acctbal").alias("rank"))
    return m.select("cluster", "person", "rank", F.count("*").over(w).alias("size"), F.round(F.col("rank") / F.sum(F.abs("rank")).over(w), 6).alias("share"))
