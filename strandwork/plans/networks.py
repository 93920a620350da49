"""Queries of networks: mails, tags, committers, shared entities, co-changes, rules, motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import motifs as M
from ..operators import networks as N
from ..operators.graph import dealt
from ..sources.tables import Tables
from .base import query
from .relational import _AUTHORED


def mail_edges_of(mails: DataFrame) -> DataFrame:
    return N.mail_edges(mails)


def co_changes_of(changes: DataFrame, least: int) -> DataFrame:
    return N.co_changes(changes, least)


_MAIL = "mail AS (SELECT a.l_suppkey AS from_id, b.l_suppkey AS to_id, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_shipdate > b.l_shipdate GROUP BY 1, 2)"


@query("mail_edges", f"WITH {_MAIL} SELECT * FROM mail", (89, 237))
def mail_edges(t: Tables) -> DataFrame:
    """Who answers whom."""
    return N.mail_edges(t.mails)


@query("committer_author_edges", "SELECT l_suppkey AS from_id, o_custkey AS to_id, count(DISTINCT o_orderkey) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2", (218,))
def committer_author_edges(t: Tables) -> DataFrame:
    """Committers (suppliers) to authors (customers)."""
    c = t.authored.select("commit_id", F.col("file").alias("committer"), "author").distinct()
    return N.committer_edges(c, rows=t.lineitem.count())


@query("tag_edges", "SELECT l_suppkey AS from_id, o_custkey % 100 AS to_id, l_returnflag AS tag, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey % 100 GROUP BY 1, 2, 3", (217, 219))
def tag_edges(t: Tables) -> DataFrame:
    """Taggers to authors by kind of tag."""
    return N.tag_edges(t.authored.select("commit_id", (F.col("author") % 100).alias("author"), F.col("file").alias("tagger"), F.col("flag").alias("tag")), rows=t.lineitem.count())


@query("person_edges", f"""
WITH {_AUTHORED}, g AS (SELECT entity, author, sum(size) AS size FROM a GROUP BY 1, 2)
SELECT x.author AS from_id, y.author AS to_id, round(sum(x.size + y.size), 2) AS weight FROM g x JOIN g y ON x.entity = y.entity AND x.author <> y.author GROUP BY 1, 2""", (230, 231))
def person_edges(t: Tables) -> DataFrame:
    """Authors of the same entities."""
    rows = t.lineitem.count()
    return N.person_edges(t.authored, (), rows, N.pairs_within(t.dependencies, rows, ["entity"])).withColumn("weight", F.round("weight", 2))


@query("windowed_person_edges", f"""
WITH {_AUTHORED}, g AS (SELECT cycle, entity, author, sum(size) AS size FROM a GROUP BY 1, 2, 3)
SELECT x.cycle, x.author AS from_id, y.author AS to_id, round(sum(x.size + y.size), 2) AS weight FROM g x JOIN g y ON x.cycle = y.cycle AND x.entity = y.entity AND x.author <> y.author GROUP BY 1, 2, 3""", (229, 233))
def windowed_person_edges(t: Tables) -> DataFrame:
    """Networks of all cycles in one query."""
    return N.person_edges(t.authored, ("cycle",), t.lineitem.count()).withColumn("weight", F.round("weight", 2))


@query("related_person_edges", f"""
WITH {_AUTHORED}, k AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem), p AS (SELECT x.e AS e1, y.e AS e2 FROM k x JOIN k y ON x.c = y.c AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 3),
near AS (SELECT e1, e2 FROM p UNION SELECT e2, e1 FROM p UNION SELECT e1, e1 FROM p UNION SELECT e2, e2 FROM p), q AS (SELECT e1 AS entity, author, sum(size) AS size FROM near JOIN a ON a.entity = e2 GROUP BY 1, 2)
SELECT x.author AS from_id, y.author AS to_id, round(sum(x.size + y.size), 2) AS weight FROM q x JOIN q y ON x.entity = y.entity AND x.author <> y.author GROUP BY 1, 2""", (232,))
def related_person_edges(t: Tables) -> DataFrame:
    """Authors of entities that change together, or of the same one."""
    relation = N.co_changes(t.dependencies, 3)
    ends = relation.select(F.col("e1").alias("entity")).union(relation.select("e2")).distinct()
    a = t.authored.join(ends, "entity", "left_semi").groupBy("entity", "author").agg(F.sum("size").alias("size"))
    return N.person_edges(N.expand_by_relation(a, relation)).withColumn("weight", F.round("weight", 2))


@query("proximity_edges", f"""
WITH {_AUTHORED}, b AS (SELECT file, entity, commit_id, author, commit_date, count(*) AS size FROM a GROUP BY ALL)
SELECT x.author AS from_id, y.author AS to_id, sum(x.size + y.size)::BIGINT AS weight FROM b x JOIN b y ON x.file = y.file AND x.entity = y.entity AND x.commit_id <> y.commit_id AND x.author <> y.author AND y.commit_date <= x.commit_date GROUP BY 1, 2""", (223, 224))
def proximity_edges(t: Tables) -> DataFrame:
    """Authors of a function to its earlier authors."""
    rows = t.lineitem.count()
    return N.proximity_edges(t.authored.withColumnRenamed("entity", "func"), rows=rows, pairs=N.pairs_within(t.dependencies, rows, ["file", "entity"]))


@query("feature_edges", f"""
WITH {_AUTHORED}, g AS (SELECT file AS feature, c_nationkey AS author, count(*) AS lines FROM a JOIN customer ON c_custkey = author GROUP BY 1, 2)
SELECT x.author AS from_id, y.author AS to_id, sum(least(x.lines, y.lines))::BIGINT AS weight FROM g x JOIN g y ON x.feature = y.feature AND x.author <> y.author GROUP BY 1, 2""", (225,))
def feature_edges(t: Tables) -> DataFrame:
    """Teams (nations of the authors) who work on the same features."""
    a = t.authored.join(t.customer.select(F.col("c_custkey").alias("author"), F.col("c_nationkey").alias("team")), "author")
    return N.feature_edges(a.groupBy(F.col("file").alias("feature"), F.col("team").alias("author")).agg(F.count("*").alias("lines")))


def lines_of(t: Tables, column: str, name: str) -> DataFrame:
    """Lines of files (file, name, line), once each, with all lines of a file in one partition."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("file"), F.col(column).alias(name), F.col("l_linenumber").alias("line"))
    return dealt(lines, t.lineitem.count(), "file").distinct()


@query("code_blocks", """
WITH r AS (SELECT l_orderkey AS file, l_returnflag AS commit, l_linenumber AS line, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem))
SELECT file, commit, min(line) AS first_line, max(line) AS last_line FROM r GROUP BY file, commit, run""", (220, 221))
def code_blocks(t: Tables) -> DataFrame:
    """Runs of lines of the same commit."""
    lines = lines_of(t, "l_returnflag", "commit")
    return N.code_blocks(lines, ["file"], "line", ["commit"])


@query("block_strength", """
WITH r AS (SELECT l_orderkey AS file, l_suppkey AS author, l_linenumber AS line, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem)),
b AS (SELECT file, author, min(line) AS f, max(line) AS l FROM r GROUP BY file, author, run),
j AS (SELECT x.author AS from_id, y.author AS to_id, greatest(y.f - x.l, x.f - y.l) - 1 AS gap FROM b x JOIN b y ON x.file = y.file AND x.author < y.author)
SELECT from_id, to_id, round(avg(CASE WHEN gap < 4 THEN 0.5 + cos(pi() * greatest(gap, 0) / 4.0) / 2 ELSE 0 END), 6) AS weight FROM j GROUP BY 1, 2""", (204, 226))
def block_strength(t: Tables) -> DataFrame:
    """Strength of collaboration by the distance of blocks."""
    pairs = N.pairs_within(t.lineitem, t.lineitem.count(), ["l_orderkey"])
    return N.block_strength(N.code_blocks(lines_of(t, "l_suppkey", "author"), ["file"], "line", ["author"]), ["file"], 4.0, pairs).withColumn("weight", F.round("weight", 6))


@query("co_change_pairs", "WITH k AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem) SELECT x.e AS e1, y.e AS e2, count(*) AS n FROM k x JOIN k y ON x.c = y.c AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2", (234,))
def co_change_pairs(t: Tables) -> DataFrame:
    """Entities that change together."""
    return N.co_changes(t.dependencies, 2)


_RULES = """
k AS (SELECT DISTINCT l_orderkey AS c, l_suppkey % 40 AS e FROM lineitem WHERE {}), m AS (SELECT e, count(*) AS m FROM k GROUP BY e), p AS (SELECT x.e AS e1, y.e AS e2, count(*) AS n FROM k x JOIN k y ON x.c = y.c AND x.e <> y.e GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT e1, e2, n, n / a.m AS confidence, n * (SELECT count(DISTINCT c) FROM k) / (a.m * b.m) AS lift FROM p JOIN m a ON a.e = e1 JOIN m b ON b.e = e2 WHERE n / a.m >= 0.1)"""


def _items(t: Tables) -> DataFrame:
    return t.dependencies.select("commit_id", (F.col("file") % 40).alias("entity"), "commit_date")


@query("association_rules", f"WITH {_RULES.format('true')} SELECT e1, e2, n, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM r", (235,))
def association_rules(t: Tables) -> DataFrame:
    """Rules between entities of the whole history."""
    r = N.association_rules(_items(t), 2, 0.1)
    return r.select("e1", "e2", "n", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("rule_evaluation", f"""
WITH {_RULES.format('l_orderkey % 2 = 0')}, q AS (SELECT DISTINCT l_orderkey AS c, l_suppkey % 40 AS e FROM lineitem WHERE l_orderkey % 2 = 1), n AS (SELECT c, count(*) AS n FROM q GROUP BY c HAVING count(*) BETWEEN 2 AND 20),
f AS (SELECT e1, count(*) AS found FROM r GROUP BY e1), h AS (SELECT q.c, q.e, count(*) AS hits FROM q JOIN r ON r.e1 = q.e JOIN q z ON z.c = q.c AND z.e = r.e2 GROUP BY 1, 2)
SELECT q.c AS commit_id, q.e AS query, coalesce(found, 0) AS n_found, round(coalesce(hits, 0) / nullif(coalesce(found, 0), 0), 6) AS precision, round(coalesce(hits, 0) / (n - 1), 6) AS recall
FROM q JOIN n ON q.c = n.c LEFT JOIN f ON f.e1 = q.e LEFT JOIN h ON h.c = q.c AND h.e = q.e""", (236,))
def rule_evaluation(t: Tables) -> DataFrame:
    """Precision and recall of rules of one half of the history on the other."""
    rules = N.association_rules(_items(t).where("commit_id % 2 = 0"), 2, 0.1)
    e = N.evaluate_rules(N.rule_queries(_items(t).where("commit_id % 2 = 1")), rules)
    return e.select("commit_id", "query", "n_found", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_TEST = "q AS (SELECT DISTINCT c, e FROM (SELECT l_orderkey AS c, l_suppkey % 40 AS e FROM lineitem WHERE l_orderkey % 2 = 1) WHERE c IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 40) BETWEEN 2 AND 20))"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    return _items(t).where("commit_id % 2 = 1"), N.association_rules(_items(t).where("commit_id % 2 = 0"), 2, 0.1)


@query("rule_prevention", f"""
WITH {_RULES.format('l_orderkey % 2 = 0')}, {_TEST}, f AS (SELECT DISTINCT q.c, q.e, r.e2 FROM q JOIN q x ON x.c = q.c AND x.e <> q.e JOIN r ON r.e1 = x.e),
g AS (SELECT f.c, f.e, count(*) AS n, count(*) FILTER (WHERE f.e2 = f.e) AS hit FROM f LEFT JOIN q y ON y.c = f.c AND y.e = f.e2 AND y.e <> f.e WHERE y.c IS NULL GROUP BY 1, 2)
SELECT q.c AS commit_id, q.e AS missing, coalesce(n, 0) AS n_found, round(hit / n, 6) AS precision, coalesce(hit, 0)::DOUBLE AS recall FROM q LEFT JOIN g ON g.c = q.c AND g.e = q.e""", (236,))
def rule_prevention(t: Tables) -> DataFrame:
    """Whether rules of one half of the history name an entity that is left out of a commit of the other."""
    return N.evaluate_prevention(*_halves(t)).withColumn("precision", F.round("precision", 6))


@query("rule_closure", f"""
WITH {_RULES.format('l_orderkey % 2 = 0')}, {_TEST}, g AS (SELECT q.c, count(DISTINCT r.e2) AS n FROM q JOIN r ON r.e1 = q.e LEFT JOIN q y ON y.c = q.c AND y.e = r.e2 WHERE y.c IS NULL GROUP BY 1)
SELECT k.c AS commit_id, coalesce(n, 0) AS n_found, n IS NULL AS correct FROM (SELECT DISTINCT c FROM q) k LEFT JOIN g ON g.c = k.c""", (236,))
def rule_closure(t: Tables) -> DataFrame:
    """What rules of one half of the history name besides whole commits of the other."""
    return N.evaluate_closure(*_halves(t))


@query("rule_summary", f"""
WITH {_RULES.format('l_orderkey % 2 = 0')}, q AS (SELECT DISTINCT l_orderkey AS c, l_suppkey % 40 AS e FROM lineitem WHERE l_orderkey % 2 = 1), n AS (SELECT c, count(*) AS n FROM q GROUP BY c HAVING count(*) BETWEEN 2 AND 20),
f AS (SELECT e1, count(*) AS found FROM r GROUP BY e1), h AS (SELECT q.c, q.e, count(*) AS hits FROM q JOIN r ON r.e1 = q.e JOIN q z ON z.c = q.c AND z.e = r.e2 GROUP BY 1, 2)
SELECT count(*) AS queries, round(avg(coalesce(hits, 0) / nullif(coalesce(found, 0), 0)), 6) AS precision, round(avg(coalesce(hits, 0) / (n - 1)), 6) AS recall, round(count(found) / count(*), 6) AS feedback
FROM q JOIN n ON q.c = n.c LEFT JOIN f ON f.e1 = q.e LEFT JOIN h ON h.c = q.c AND h.e = q.e""", (139,))
def rule_summary(t: Tables) -> DataFrame:
    """Means of precision (where anything is found) and recall, and the share of queries with feedback."""
    rules = N.association_rules(_items(t).where("commit_id % 2 = 0"), 2, 0.1)
    e = N.evaluate_rules(N.rule_queries(_items(t).where("commit_id % 2 = 1")), rules)
    return e.agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg((F.col("n_found") > 0).cast("double")), 6).alias("feedback"))


# ---------------------------------------------------------------- motifs
_TOUCH = "touch AS (SELECT DISTINCT l_suppkey AS d, l_partkey AS a FROM lineitem), comm AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS x, greatest(a.l_suppkey, b.l_suppkey) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)"


def _touch(t: Tables) -> DataFrame:
    """Who touches what."""
    return dealt(t.dependencies.select(F.col("file").alias("dev"), F.col("entity").alias("artifact")), t.lineitem.count(), "artifact").distinct()


def _communication(t: Tables) -> DataFrame:
    """Who shares a commit."""
    from ..operators.relational import project_bipartite

    return project_bipartite(t.dependencies, "file", "commit_id").select(F.col("p1").alias("d1"), F.col("p2").alias("d2"))


@query("triangle_motifs", f"""
WITH {_TOUCH}, p AS (SELECT x.a, least(x.d, y.d) AS d1, greatest(x.d, y.d) AS d2 FROM touch x JOIN touch y ON x.a = y.a AND x.d <> y.d), j AS (SELECT p.a, comm.x IS NOT NULL AS linked FROM p LEFT JOIN comm ON comm.x = d1 AND comm.y = d2)
SELECT a AS artifact, count(*) FILTER (WHERE linked) AS motifs, count(*) FILTER (WHERE NOT linked) AS anti_motifs FROM j GROUP BY a""", (276, 277))
def triangle_motifs(t: Tables) -> DataFrame:
    """Pairs of developers of an artifact who communicate, or don't."""
    return M.triangles(_touch(t), _communication(t))


@query("square_motifs", f"""
WITH {_TOUCH}, dep AS (SELECT DISTINCT a.l_partkey AS a1, b.l_partkey AS a2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
s AS (SELECT dep.a1, dep.a2, x.d AS d1, y.d AS d2 FROM dep JOIN touch x ON x.a = a1 JOIN touch y ON y.a = a2 WHERE x.d <> y.d AND NOT EXISTS (SELECT 1 FROM touch z WHERE z.d = x.d AND z.a = a2) AND NOT EXISTS (SELECT 1 FROM touch z WHERE z.d = y.d AND z.a = a1))
SELECT a1, a2, count(*) FILTER (WHERE comm.x IS NOT NULL) AS motifs, count(*) FILTER (WHERE comm.x IS NULL) AS anti_motifs FROM s LEFT JOIN comm ON comm.x = least(d1, d2) AND comm.y = greatest(d1, d2) GROUP BY 1, 2""", (278,))
def square_motifs(t: Tables) -> DataFrame:
    """Developers of two linked artifacts, each of one only, who communicate or don't."""
    dep = N.co_changes(t.dependencies, 1, most_entities=1000).select(F.col("e1").alias("a1"), F.col("e2").alias("a2"))
    return M.squares(_touch(t), dep, _communication(t))


@query("socio_technical_graph", f"""
WITH {_TOUCH} SELECT 'commit' AS kind, d AS from_id, a AS to_id FROM touch UNION ALL SELECT 'communication', x, y FROM comm WHERE x IN (SELECT d FROM touch) AND y IN (SELECT d FROM touch)""", (276, 44, 275))
def socio_technical_graph(t: Tables) -> DataFrame:
    """Developers and artifacts with edges of commits and of communication; developers without artifact are dropped."""
    return M.socio_technical(_touch(t), _communication(t))


@query("motif_null_model", None, (258, 279))
def motif_null_model(t: Tables) -> DataFrame:
    """Triangle motifs of rewired graphs of all entities and commits (20 seeded draws), by draw."""
    return M.null_model(_touch(t), _communication(t), 20)


@query("lag_variants", """
WITH q AS (SELECT year(o_orderdate) AS range_id, count(*) AS quality FROM orders GROUP BY 1), m AS (SELECT year(l_shipdate) AS range_id, count(*) AS motifs FROM lineitem GROUP BY 1)
SELECT CAST(m.range_id AS BIGINT) AS range_id, lag, motifs, quality FROM m JOIN q ON true JOIN (VALUES (-1, 'advanced'), (0, 'isochronous'), (1, 'retarded')) v(k, lag) ON q.range_id = m.range_id + k""", (281,))
def lag_variants(t: Tables) -> DataFrame:
    """Motifs of a range beside the quality of the one before, the same and the next."""
    q = t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("range_id")).agg(F.count("*").alias("quality"))
    m = t.lineitem.groupBy(F.year("l_shipdate").cast("bigint").alias("range_id")).agg(F.count("*").alias("motifs"))
    return M.lagged(m, q)
