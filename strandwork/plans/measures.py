"""Queries of further measures of graphs, series and blocks, and the networks of all link types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import measures as X
from ..operators import networks as N
from ..operators import timeseries as T
from ..sources.tables import Tables
from . import networks as P
from .base import REGISTRY, query
from .graphs import _E, _edges, _sparse


@query("multi_edges", f"WITH {_E} SELECT from_id, to_id, CAST(unnest(range(1, weight + 1)) AS INT) AS number FROM e", (257,))
def multi_edges(t: Tables) -> DataFrame:
    """The mail network with one edge for each answer."""
    return X.multi_edges(_edges(t))


@query("diversity", f"""
WITH {_E}, w AS (SELECT vertex, o, sum(weight)::DOUBLE AS w FROM (SELECT from_id AS vertex, to_id AS o, weight FROM e UNION ALL SELECT to_id, from_id, weight FROM e) GROUP BY 1, 2), s AS (SELECT vertex, count(*) AS degree, sum(w) AS s FROM w GROUP BY 1)
SELECT w.vertex, any_value(degree) AS degree, CASE WHEN any_value(degree) > 1 THEN round(-sum(w / s * ln(w / s)) / ln(any_value(degree)), 6) ELSE 0 END AS diversity FROM w JOIN s ON w.vertex = s.vertex GROUP BY 1""", (249,))
def diversity(t: Tables) -> DataFrame:
    """How evenly each sender's mails are spread over partners."""
    return X.diversity(G.written(_edges(t))).withColumn("diversity", F.round("diversity", 6))


@query("degree_centralization", f"""
WITH {_E}, d AS (SELECT vertex, count(*) AS d FROM (SELECT from_id AS vertex FROM e UNION ALL SELECT to_id FROM e) GROUP BY 1)
SELECT count(*) AS n, round(CASE WHEN count(*) > 2 THEN sum(m - d) / (2 * (count(*) - 1) * (count(*) - 2)) END, 6) AS centralization FROM d, (SELECT max(d) AS m FROM d)""", (259,))
def degree_centralization(t: Tables) -> DataFrame:
    """Centralisation of the degrees of the mail network."""
    return X.degree_centralization(_edges(t)).withColumn("centralization", F.round("centralization", 6))


@query("component_indices", None, (248, 259))
def component_indices(t: Tables) -> DataFrame:
    """Diameter, mean path length and centralisations of the components of the co-change graph."""
    m = G.per_component(_sparse(t), G.path_measures, "vertex bigint, betweenness double, closeness double, eccentricity bigint, eigenvector double")
    c = X.component_indices(G.written(m))
    return c.select("component", "size", "diameter", *[F.round(x, 6).alias(x) for x in c.columns[3:]])


@query("component_cuts", None, (249,))
def component_cuts(t: Tables) -> DataFrame:
    """Least cut and adhesion of the components of the co-change graph."""
    return G.per_component(_sparse(t), X.cuts_of, "size bigint, min_cut double, adhesion bigint")


@query("power_law_fit", None, (251,))
def power_law_fit(t: Tables) -> DataFrame:
    """Power laws of the changes of each subsystem by author, with the tail's start, distance and p."""
    n = t.changes.groupBy(F.col("subsys"), "author").agg(F.count("*").alias("x"))
    return X.power_law_fit(n, ["subsys"], "x")


_QUARTERS = "q AS (SELECT o_orderpriority AS priority, date_trunc('quarter', o_orderdate) AS c, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2)"


def _quarters(t: Tables) -> DataFrame:
    return t.commits.groupBy("priority", "cycle").agg(F.count("*").cast("double").alias("x"))


@query("spectrum", f"""
WITH {_QUARTERS}, s AS (SELECT priority, x - avg(x) OVER (PARTITION BY priority) AS x, row_number() OVER (PARTITION BY priority ORDER BY c) - 1 AS t, count(*) OVER (PARTITION BY priority) AS n FROM q), f AS (SELECT *, unnest(range(1, n // 2 + 1)) AS frequency FROM s WHERE n > 1)
SELECT priority, frequency, round((power(sum(x * cos(2 * pi() * frequency * t / n)), 2) + power(sum(x * sin(2 * pi() * frequency * t / n)), 2)) / any_value(n), 4) AS power FROM f GROUP BY 1, 2""", (178,))
def spectrum(t: Tables) -> DataFrame:
    """Periodogram of commits by cycle for each priority."""
    return X.spectrum(_quarters(t), ["priority"], "cycle", "x").withColumn("power", F.round("power", 4))


@query("recurrence", f"""
WITH {_QUARTERS}, s AS (SELECT priority, x, row_number() OVER (PARTITION BY priority ORDER BY c) AS t, 0.1 * (max(x) OVER (PARTITION BY priority) - min(x) OVER (PARTITION BY priority)) AS near FROM q)
SELECT a.priority, CAST(b.t - a.t AS INT) AS lag, count(*) AS pairs, count(*) FILTER (WHERE abs(a.x - b.x) <= a.near) AS recurrent FROM s a JOIN s b ON a.priority = b.priority AND a.t < b.t GROUP BY 1, 2""", (178,))
def recurrence(t: Tables) -> DataFrame:
    """How often the commits of a cycle come back, by lag, for each priority."""
    return X.recurrence(_quarters(t), ["priority"], "cycle", "x")


@query("block_clusters", None, (227,))
def block_clusters(t: Tables) -> DataFrame:
    """Clusters of the returned lines of each order, with the blocks near them."""
    return X.block_clusters(N.code_blocks(P.lines_of(t, "l_returnflag", "commit"), ["file"], "line", ["commit"]), ["file"], F.col("commit") == "R", 1)


#: The types of links between persons.
LINK_TYPES = ("tag", "committer2author", "proximity", "feature")


def network_of(t: Tables, link_type: str) -> DataFrame:
    """The network (from_id, to_id, weight) of one type of link."""
    if link_type not in LINK_TYPES:
        raise ValueError(f"link_type is one of {LINK_TYPES}")
    found = {"tag": P.tag_edges, "committer2author": P.committer_author_edges, "proximity": P.proximity_edges, "feature": P.feature_edges}[link_type](t)
    return found.groupBy(F.col("from_id").cast("bigint").alias("from_id"), F.col("to_id").cast("bigint").alias("to_id")).agg(F.sum("weight").cast("bigint").alias("weight"))


def _networks_sql() -> str:
    names = {"tag": "tag_edges", "committer2author": "committer_author_edges", "proximity": "proximity_edges", "feature": "feature_edges"}
    each = [f"SELECT '{k}' AS link_type, CAST(count(*) AS BIGINT) AS edges, CAST(sum(weight) AS BIGINT) AS weight, CAST(count(DISTINCT from_id) AS BIGINT) AS sources FROM (SELECT from_id, to_id, sum(weight) AS weight FROM ({REGISTRY.sql[n]}) GROUP BY 1, 2)" for k, n in names.items()]
    return " UNION ALL ".join(each)


@query("link_networks", _networks_sql(), (229,))
def link_networks(t: Tables) -> DataFrame:
    """Size of the network of each type of link."""
    each = [network_of(t, k).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"), F.countDistinct("from_id").alias("sources")).select(F.lit(k).alias("link_type"), "edges", "weight", "sources") for k in LINK_TYPES]
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out


_WINDOWS = """k AS (SELECT i AS window_id, CAST(DATE '1995-01-01' + CAST(i * 14 AS INT) AS DATE) AS window_start FROM range(0, 180) r(i)),
m AS (SELECT window_id, l_orderkey AS th, l_suppkey AS a, l_shipdate AS s FROM lineitem JOIN k ON CAST(l_shipdate AS DATE) >= window_start AND CAST(l_shipdate AS DATE) < window_start + 90 WHERE window_start + 90 <= DATE '2001-08-01'),
e AS (SELECT x.window_id, x.a AS from_id, y.a AS to_id, count(*) AS weight FROM m x JOIN m y ON x.window_id = y.window_id AND x.th = y.th AND x.a <> y.a AND x.s > y.s GROUP BY 1, 2, 3),
d AS (SELECT window_id, vertex, count(*) AS degree FROM (SELECT window_id, from_id AS vertex FROM e UNION ALL SELECT window_id, to_id FROM e) GROUP BY 1, 2),
c AS (SELECT d.window_id, vertex, degree, CASE WHEN degree > q THEN 'core' ELSE 'peripheral' END AS class FROM d JOIN (SELECT window_id, quantile_cont(degree, 0.8) AS q FROM d GROUP BY 1) z ON z.window_id = d.window_id)"""


def _windowed(t: Tables) -> DataFrame:
    w = T.sliding_windows(t.mails, "sent", "1995-01-01", "2001-08-01", 90, 14)
    return N.mail_edges(w, ("window_id",))


@query("project_trends", f"""
WITH {_WINDOWS}, n AS (SELECT window_id, count(*) AS vertices, avg(degree) AS mean_degree, count(*) FILTER (WHERE class = 'core') AS core FROM c GROUP BY 1), g AS (SELECT window_id, count(*) AS edges, sum(ln(1 + weight)) AS strength FROM e GROUP BY 1)
SELECT n.window_id, vertices, edges, round(edges / nullif(vertices * (vertices - 1), 0), 6) AS density, round(mean_degree, 6) AS mean_degree, round(strength, 4) AS strength, core FROM n JOIN g ON g.window_id = n.window_id""", (274,))
def project_trends(t: Tables) -> DataFrame:
    """Measures of the mail network in windows of 90 days every 14 days."""
    r = X.trends(_windowed(t), ("window_id",))
    return r.select("window_id", "vertices", "edges", F.round("density", 6).alias("density"), F.round("mean_degree", 6).alias("mean_degree"), F.round("strength", 4).alias("strength"), "core")


@query("trend_transitions", f"WITH {_WINDOWS}, l AS (SELECT class AS before, lead(class) OVER (PARTITION BY vertex ORDER BY window_id) AS after FROM c), g AS (SELECT before, after, count(*) AS n FROM l WHERE after IS NOT NULL GROUP BY 1, 2) SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS p FROM g", (274,))
def trend_transitions(t: Tables) -> DataFrame:
    """How classes of developers change from one window that they are in to the next."""
    c = X.classes_by_degree(_windowed(t), ("window_id",))
    return G.markov(c, "vertex", "window_id", "class").withColumn("p", F.round("p", 6))
