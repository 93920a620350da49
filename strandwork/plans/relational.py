"""Queries of relational kind: views, filters, joins, aggregations, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import Tables
from .base import query

_QUARTER = "CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP)"
_COMMITS = f"c AS (SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS commit_date, o_totalprice AS diff_size, o_orderstatus AS status, o_orderpriority AS priority, {_QUARTER} AS cycle FROM orders)"
_AUTHORED = f"a AS (SELECT l_orderkey AS commit_id, l_suppkey AS file, l_partkey AS entity, l_linenumber AS line, l_quantity AS size, l_returnflag AS flag, o_custkey AS author, o_orderdate AS commit_date, {_QUARTER} AS cycle FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


# ---------------------------------------------------------------- views
def _timeline(t: Tables) -> DataFrame:
    months = t.commits.select(F.col("status").alias("project"), F.date_trunc("month", "commit_date").cast("timestamp_ntz").alias("date")).distinct()
    kind = F.when((F.month("date") - 1) % 3 == 0, "release").when(F.month("date") % 3 == 0, "rc")
    return months.withColumns({"type": kind, "tag": F.date_format("date", "yyyy-MM")}).where("type IS NOT NULL")


@query(
    "cycles_view",
    """
WITH m AS (SELECT DISTINCT o_orderstatus AS project, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date FROM orders),
t AS (SELECT *, strftime(date, '%Y-%m') AS tag FROM m),
r AS (SELECT project, tag AS start_tag, date AS date_start, lead(tag) OVER w AS end_tag, lead(date) OVER w AS date_end
      FROM t WHERE (month(date) - 1) % 3 = 0 WINDOW w AS (PARTITION BY project ORDER BY date, tag))
SELECT project, start_tag, end_tag, start_tag || '-' || end_tag AS cycle, date_start, date_end,
       (SELECT min(x.date) FROM t x WHERE x.project = r.project AND month(x.date) % 3 = 0 AND x.date >= date_start AND x.date < date_end) AS rc_start
FROM r WHERE end_tag IS NOT NULL""",
    (52, 80, 86, 175),
)
def cycles_view(t: Tables) -> DataFrame:
    """Release cycles with the first candidate inside."""
    return R.cycles(_timeline(t))


@query("range_tags", """
WITH m AS (SELECT DISTINCT o_orderstatus AS project, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS date FROM orders)
SELECT project, count(*) FILTER (WHERE (month(date) - 1) % 3 = 0) AS n_releases, count(*) FILTER (WHERE month(date) % 3 = 0) AS n_candidates,
       max(CASE WHEN month(date) % 3 = 0 THEN 1 ELSE 0 END) = 1 AS has_candidate, min(date) FILTER (WHERE (month(date) - 1) % 3 = 0) AS first_release FROM m GROUP BY project""", (50, 51, 175))
def range_tags(t: Tables) -> DataFrame:
    """Releases and candidates of each project."""
    release = F.col("type") == "release"
    return _timeline(t).groupBy("project").agg(F.count_if(release).alias("n_releases"), F.count_if(~release).alias("n_candidates"), F.max(~release).alias("has_candidate"), F.min(F.when(release, F.col("date"))).alias("first_release"))


@query("author_commit_stats", f"""
WITH {_AUTHORED}
SELECT author, c_name AS name, cycle, round(sum(CASE WHEN flag = 'A' THEN size ELSE 0 END), 2) AS added, round(sum(CASE WHEN flag = 'R' THEN size ELSE 0 END), 2) AS deleted,
       round(sum(size), 2) AS total, count(DISTINCT commit_id) AS numcommits FROM a JOIN customer ON author = c_custkey GROUP BY author, c_name, cycle""", (66, 81, 108, 122))
def author_commit_stats(t: Tables) -> DataFrame:
    """Lines added, deleted and changed, and commits, of each author in each cycle."""
    size = lambda flag: F.round(F.sum(F.when(F.col("flag") == flag, F.col("size")).otherwise(0.0)), 2)
    stats = t.authored.groupBy("author", "cycle").agg(size("A").alias("added"), size("R").alias("deleted"), F.round(F.sum("size"), 2).alias("total"), F.countDistinct("commit_id").alias("numcommits"))
    return stats.join(t.customer.select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name")), "author")


@query("author_stats_all_persons", f"""
WITH {_COMMITS}, s AS (SELECT author, count(*) AS n, sum(diff_size) AS total FROM c WHERE cycle = TIMESTAMP '1998-01-01' GROUP BY author)
SELECT c_custkey AS author, coalesce(n, 0) AS numcommits, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN s ON c_custkey = author""", (39, 53))
def author_stats_all_persons(t: Tables) -> DataFrame:
    """Statistics of one cycle for all persons, those without commits included."""
    s = t.commits.where("cycle = timestamp_ntz '1998-01-01'").groupBy("author").agg(F.count("*").alias("n"), F.sum("diff_size").alias("s"))
    p = t.customer.select(F.col("c_custkey").alias("author"))
    return p.join(s, "author", "left").select("author", F.coalesce("n", F.lit(0)).alias("numcommits"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


def _members(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("cluster"), F.col("c_acctbal").alias("rank"), F.col("c_mktsegment").alias("technique"), F.col("c_name").alias("name"))


_MEMBERS = "m AS (SELECT c_custkey AS person, c_nationkey AS cluster, c_acctbal AS rank, c_mktsegment AS technique, c_name AS name FROM customer)"


@query("person_cluster_stats", f"""
WITH {_MEMBERS} SELECT cluster, n_name AS cluster_name, technique, person, rank, count(*) AS numcommits, round(sum(o_totalprice), 2) AS total
FROM m JOIN nation ON cluster = n_nationkey JOIN orders ON o_custkey = person GROUP BY ALL""", (65, 82, 260))
def person_cluster_stats(t: Tables) -> DataFrame:
    """Commits and lines of each member of each cluster with the member's rank."""
    work = t.orders.groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("numcommits"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    n = t.nation.select(F.col("n_nationkey").alias("cluster"), F.col("n_name").alias("cluster_name"))
    return _members(t).drop("name").join(work, "person").join(n, "cluster").select("cluster", "cluster_name", "technique", "person", "rank", "numcommits", "total")


@query("cluster_stats", f"""
WITH {_MEMBERS} SELECT cluster, technique, count(DISTINCT person) AS num_members, count(*) AS numcommits, round(sum(o_totalprice), 2) AS total, round(avg(rank), 6) AS prank_avg
FROM m JOIN orders ON o_custkey = person GROUP BY cluster, technique""", (65, 84, 117))
def cluster_stats(t: Tables) -> DataFrame:
    """Members, commits, lines and mean rank (over commits) of each cluster."""
    work = t.orders.groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    j = _members(t).join(work, "person")
    return j.groupBy("cluster", "technique").agg(F.count("*").alias("num_members"), F.sum("n").alias("numcommits"), F.round(F.sum("s"), 2).alias("total"), F.round(F.sum(F.col("rank") * F.col("n")) / F.sum("n"), 6).alias("prank_avg"))


@query("cluster_user_rank", f"WITH {_MEMBERS} SELECT cluster, n_regionkey AS range_id, technique, person, rank FROM m JOIN nation ON cluster = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE technique = 'BUILDING'", (64, 83))
def cluster_user_rank(t: Tables) -> DataFrame:
    """Members of clusters with their rank under one technique."""
    n = t.nation.select(F.col("n_nationkey").alias("cluster"), F.col("n_regionkey").alias("range_id")).join(t.region.select(F.col("r_regionkey").alias("range_id")), "range_id")
    return _members(t).where("technique = 'BUILDING'").join(n, "cluster").select("cluster", "range_id", "technique", "person", "rank")


@query("rank_view", f"WITH {_MEMBERS} SELECT technique, person, name, rank FROM m", (85,))
def rank_view(t: Tables) -> DataFrame:
    """Ranks with names."""
    return _members(t).select("technique", "person", "name", "rank")


# ---------------------------------------------------------------- filters
@query("commits_by_range", f"WITH {_COMMITS} SELECT id, author, commit_date, diff_size FROM c WHERE cycle = TIMESTAMP '1997-04-01' AND status = 'F'", (1, 60))
def commits_by_range(t: Tables) -> DataFrame:
    """Commits of one project and range."""
    return t.commits.where("commit_date >= timestamp_ntz '1997-04-01' AND commit_date < timestamp_ntz '1997-07-01' AND status = 'F'").select("id", "author", "commit_date", "diff_size")


@query("commits_by_date", f"WITH {_COMMITS} SELECT author, count(*) AS n, round(sum(diff_size), 2) AS total FROM c WHERE commit_date >= TIMESTAMP '1996-01-01' AND commit_date < TIMESTAMP '1997-01-01' GROUP BY author", (61, 108))
def commits_by_date(t: Tables) -> DataFrame:
    """Commits and lines by author in a half-open interval."""
    return R.count_and_sum(t.commits.where("commit_date >= timestamp_ntz '1996-01-01' AND commit_date < timestamp_ntz '1997-01-01'"), ["author"], "diff_size")


@query("ordered_hashes", f"WITH {_COMMITS} SELECT id, commit_date FROM c WHERE status = 'P' ORDER BY commit_date, id", (62, 26, 58))
def ordered_hashes(t: Tables) -> DataFrame:
    """Commits of a project in order."""
    return t.commits.where("status = 'P'").select("id", "commit_date").orderBy("commit_date", "id")


@query("history_range", "WITH a AS (SELECT o_orderdate AS d, o_orderkey AS i FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' ORDER BY 1, 2 LIMIT 1), b AS (SELECT o_orderdate AS d, o_orderkey AS i FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' ORDER BY 1 DESC, 2 DESC LIMIT 1) SELECT o_orderkey AS id, o_custkey AS author FROM orders, a, b WHERE (o_orderdate > a.d OR o_orderdate = a.d AND o_orderkey > a.i) AND (o_orderdate < b.d OR o_orderdate = b.d AND o_orderkey <= b.i)", (26,))
def history_range(t: Tables) -> DataFrame:
    """Commits of a cached history between two of them."""
    c = t.commits.select("id", "author", "commit_date")
    place = F.struct("commit_date", "id")
    first = F.min(F.when(F.expr("commit_date >= timestamp_ntz '1994-01-01'"), place))
    last = F.max(F.when(F.expr("commit_date < timestamp_ntz '1997-01-01'"), place))
    ends = c.agg(first["id"].alias("a"), last["id"].alias("b")).first()
    return R.sub_range(c, ends["a"], ends["b"]).select("id", "author")


@query("cluster_lookup", f"WITH {_MEMBERS} SELECT DISTINCT cluster, technique FROM m WHERE cluster > 0 AND technique LIKE '%E%'", (49, 63, 70))
def cluster_lookup(t: Tables) -> DataFrame:
    """Clusters of techniques that match a pattern, without the global one (0)."""
    return _members(t).where((F.col("cluster") > 0) & F.col("technique").like("%E%")).select("cluster", "technique").distinct()


@query("outlier_removal", "SELECT event_id AS id, CASE WHEN value <= (SELECT quantile_cont(value, 0.995) FROM events) THEN value END AS diff_size FROM events", (72, 73))
def outlier_removal(t: Tables) -> DataFrame:
    """Sizes with those above the 99.5 % quantile removed."""
    return R.clip_outliers(t.changes.select("id", "diff_size"), "diff_size")


@query("large_commit_filter", "SELECT l_orderkey AS commit_id, count(DISTINCT l_partkey) AS n_entities FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) <= 4", (75,))
def large_commit_filter(t: Tables) -> DataFrame:
    """Commits that touch few entities."""
    return t.dependencies.groupBy("commit_id").agg(F.countDistinct("entity").alias("n_entities")).where("n_entities <= 4")


@query("subject_noise_filter", "SELECT conv_id AS thread, turn AS number FROM conversations WHERE role NOT LIKE 'sys%' AND NOT starts_with(lower(text), 'the')", (78,))
def subject_noise_filter(t: Tables) -> DataFrame:
    """Mails without automatic senders and noise subjects."""
    return t.turns.where(~F.startswith("author", F.lit("sys")) & ~F.startswith(F.lower("text"), F.lit("the"))).select("thread", "number")


@query("community_size_filter", f"WITH {_MEMBERS}, s AS (SELECT *, count(*) OVER (PARTITION BY cluster, technique) AS n FROM m) SELECT cluster, technique, person, n AS size FROM s WHERE n > 8 AND n <= 14", (79, 244))
def community_size_filter(t: Tables) -> DataFrame:
    """Members of clusters of medium size; sizes are aggregated first, then joined."""
    m = _members(t)
    n = m.groupBy("cluster", "technique").agg(F.count("*").alias("size")).where("size > 8 AND size <= 14")
    return m.join(n, ["cluster", "technique"]).select("cluster", "technique", "person", "size")


@query("coverage_cut", f"""
WITH {_MEMBERS}, s AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster), r AS (SELECT cluster, size, sum(size) OVER (ORDER BY size DESC, cluster) - size AS before, sum(size) OVER () AS total FROM s)
SELECT cluster, size FROM r WHERE before < 0.5 * total""", (79, 145, 160))
def coverage_cut(t: Tables) -> DataFrame:
    """The largest clusters that together hold half of all members (sizes only, one row a cluster)."""
    from pyspark.sql import Window

    s = _members(t).groupBy("cluster").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.desc("size"), "cluster")) - F.col("size")
    return s.withColumns({"before": before, "total": F.sum("size").over(Window.partitionBy())}).where("before < 0.5 * total").select("cluster", "size")


@query("committer_participation", "SELECT DISTINCT l_orderkey AS commit_id, p FROM (SELECT l_orderkey, o_custkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem)", (55, 186))
def committer_participation(t: Tables) -> DataFrame:
    """Author and committers (suppliers) of each commit, once each."""
    a = t.commits.select(F.col("id").alias("commit_id"), F.col("author").alias("p"))
    return a.join(t.dependencies, "commit_id", "left_semi").union(t.dependencies.select("commit_id", "file")).distinct()


@query("subsystem_tags", """
SELECT l_orderkey AS commit_id, max(CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 ELSE 0 END) AS core, max(CASE WHEN p_brand LIKE 'Brand#2%' THEN 1 ELSE 0 END) AS net,
  1 - greatest(max(CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 ELSE 0 END), max(CASE WHEN p_brand LIKE 'Brand#2%' THEN 1 ELSE 0 END)) AS general
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""", (54,))
def subsystem_tags(t: Tables) -> DataFrame:
    """Subsystems that a commit touches by path prefix; ``general`` if none."""
    paths = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("path"))
    hit = lambda p: F.max(F.when(F.startswith("path", F.lit(p)), 1).otherwise(0))
    g = t.dependencies.select("commit_id", "entity").join(paths, "entity").groupBy("commit_id").agg(hit("Brand#1").alias("core"), hit("Brand#2").alias("net"))
    return g.withColumn("general", 1 - F.greatest("core", "net"))


@query("candidate_phase_flag", f"WITH {_COMMITS} SELECT id, id IN (SELECT id FROM c x WHERE month(x.commit_date) % 3 = 0) AS in_rc FROM c", (54, 102))
def candidate_phase_flag(t: Tables) -> DataFrame:
    """Whether a commit is among those of the candidate phase."""
    rc = t.commits.where(F.month("commit_date") % 3 == 0).select("id", F.lit(True).alias("rc"))
    return t.commits.select("id").join(rc, "id", "left").select("id", F.coalesce("rc", F.lit(False)).alias("in_rc"))


@query("recode_labels", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'open' ELSE 'pending' END AS label, CAST(left(o_orderpriority, 1) AS INT) AS level FROM orders", (71, 68))
def recode_labels(t: Tables) -> DataFrame:
    """Codes as labels, and priorities as ordered levels."""
    label = F.create_map(*[F.lit(x) for x in ("F", "fixed", "O", "open", "P", "pending")])
    return t.commits.select("id", label[F.col("status")].alias("label"), F.left("priority", F.lit(1)).cast("int").alias("level"))


# ---------------------------------------------------------------- joins
@query("commit_file_sizes", f"WITH {_COMMITS}, s AS (SELECT l_orderkey AS id, l_suppkey AS file, sum(l_quantity) AS size FROM lineitem GROUP BY 1, 2) SELECT c.id, author, file, size FROM c JOIN s ON c.id = s.id WHERE status = 'O'", (87, 40))
def commit_file_sizes(t: Tables) -> DataFrame:
    """Commits with the lines they change in each file."""
    s = t.dependencies.groupBy(F.col("commit_id").alias("id"), "file").agg(F.sum("size").alias("size"))
    return t.commits.where("status = 'O'").select("id", "author").join(s, "id")


@query("dependency_query", f"WITH {_AUTHORED}, n AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) SELECT DISTINCT commit_id, author, concat(file, '/', entity) AS entity, size, commit_date FROM a JOIN n ON k = commit_id WHERE n <= 4 AND commit_date >= TIMESTAMP '1998-01-01' AND commit_date < TIMESTAMP '1999-01-01'", (75, 88))
def dependency_query(t: Tables) -> DataFrame:
    """Entities changed in a year by commits that touch few files."""
    few = t.dependencies.groupBy("commit_id").agg(F.countDistinct("file").alias("n")).where("n <= 4").select("commit_id")
    a = t.authored.where("commit_date >= timestamp_ntz '1998-01-01' AND commit_date < timestamp_ntz '1999-01-01'").join(few, "commit_id", "left_semi")
    return a.select("commit_id", "author", F.concat_ws("/", "file", "entity").alias("entity"), "size", "commit_date").distinct()


@query("dependency_dedup", "SELECT l_suppkey AS file, l_partkey AS entity, min(l_orderkey) AS commit_id FROM lineitem GROUP BY 1, 2", (88,))
def dependency_dedup(t: Tables) -> DataFrame:
    """One commit for each entity of a file: the least id."""
    return t.dependencies.groupBy("file", "entity").agg(F.min("commit_id").alias("commit_id"))


@query("code_owner", "WITH x AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_suppkey, l_partkey) AS top FROM lineitem) SELECT l_suppkey AS file, l_partkey AS entity, l_orderkey AS commit_id, l_linenumber AS line, l_quantity AS size FROM x WHERE l_quantity = top AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'", (90,))
def code_owner(t: Tables) -> DataFrame:
    """Largest change of each entity of a file; the maximum is of all dates, the rows of one year."""
    return R.at_maximum(t.dependencies, ["file", "entity"], "size").where("commit_date >= timestamp_ntz '1997-01-01' AND commit_date < timestamp_ntz '1998-01-01'").select("file", "entity", "commit_id", "line", "size")


@query("issue_commit_join", """
WITH c AS (SELECT o_orderkey AS id, 'fixes PRJ-' || CAST(o_custkey % 500 AS VARCHAR) || ' and more' AS message FROM orders), k AS (SELECT id, nullif(regexp_extract(message, '[A-Z]+-[0-9]+'), '') AS issue FROM c),
i AS (SELECT 'PRJ-' || CAST(c_custkey AS VARCHAR) AS issue, c_mktsegment AS type FROM customer)
SELECT id, k.issue, type, coalesce(type = 'BUILDING', false) AS is_bug FROM k LEFT JOIN i ON k.issue = i.issue""", (91, 188))
def issue_commit_join(t: Tables) -> DataFrame:
    """Issues named in commit messages with their type."""
    c = t.commits.select("id", F.concat(F.lit("fixes PRJ-"), (F.col("author") % 500).cast("string"), F.lit(" and more")).alias("message"))
    k = c.select("id", F.nullif(F.regexp_extract("message", "[A-Z]+-[0-9]+", 0), F.lit("")).alias("issue"))
    i = t.customer.select(F.concat(F.lit("PRJ-"), F.col("c_custkey").cast("string")).alias("issue"), F.col("c_mktsegment").alias("type")).distinct()
    return k.join(i, "issue", "left").select("id", "issue", "type", F.coalesce(F.col("type") == "BUILDING", F.lit(False)).alias("is_bug"))


_PROJECTION = "b AS (SELECT DISTINCT l_orderkey AS i, l_suppkey AS p FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'), e AS (SELECT DISTINCT x.p AS p1, y.p AS p2, CAST(1 AS BIGINT) AS weight FROM b x JOIN b y ON x.i = y.i AND x.p < y.p)"


@query("bipartite_projection", f"WITH {_PROJECTION} SELECT * FROM e", (92, 136))
def bipartite_projection(t: Tables) -> DataFrame:
    """Persons who comment on the same issue in a closed interval of days."""
    return R.project_bipartite(t.dependencies.where("commit_date BETWEEN timestamp_ntz '1997-01-01' AND timestamp_ntz '1997-03-31'"), "file", "commit_id")


def _mail_pairs(t: Tables) -> DataFrame:
    from .networks import mail_edges_of

    return mail_edges_of(t.mails.where("sent >= timestamp_ntz '1997-01-01' AND sent < timestamp_ntz '1998-01-01'"))


@query("communication_merge", f"""
WITH {_PROJECTION}, m AS (SELECT a.l_suppkey AS p1, b.l_suppkey AS p2, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_shipdate > b.l_shipdate
  WHERE a.l_shipdate >= TIMESTAMP '1997-01-01' AND a.l_shipdate < TIMESTAMP '1998-01-01' AND b.l_shipdate >= TIMESTAMP '1997-01-01' AND b.l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT e.p1, e.p2, e.weight + m.weight AS weight FROM e JOIN m ON e.p1 = m.p1 AND e.p2 = m.p2""", (93,))
def communication_merge(t: Tables) -> DataFrame:
    """Edges that are in issues and mails, weights added."""
    return R.merge_weights(bipartite_projection(t), _mail_pairs(t).select(F.col("from_id").alias("p1"), F.col("to_id").alias("p2"), "weight"), ["p1", "p2"])


@query("entity_relations", """
WITH k AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem), p AS (SELECT x.e AS e1, y.e AS e2, count(*) AS n FROM k x JOIN k y ON x.c = y.c AND x.e < y.e GROUP BY 1, 2),
now AS (SELECT DISTINCT l_partkey AS e FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-04-01')
SELECT e1, e2, n FROM p WHERE n >= 2 AND e1 IN (SELECT e FROM now) AND e2 IN (SELECT e FROM now)""", (94, 102))
def entity_relations(t: Tables) -> DataFrame:
    """Co-changes of entities that are both part of the current cycle."""
    from .networks import co_changes_of

    now = t.dependencies.where("commit_date >= timestamp_ntz '1999-01-01' AND commit_date < timestamp_ntz '1999-04-01'")
    return R.both_ends(co_changes_of(t.dependencies, 2), now, "e1", "e2", "entity")


@query("class_merge", f"""
WITH {_COMMITS}, a AS (SELECT author, CASE WHEN count(*) > 1 THEN 'core' ELSE 'peripheral' END AS s FROM c WHERE cycle = TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT author, CASE WHEN count(*) > 1 THEN 'core' ELSE 'peripheral' END AS s FROM c WHERE cycle = TIMESTAMP '1997-04-01' GROUP BY 1)
SELECT coalesce(a.author, b.author) AS author, coalesce(a.s, 'absent') AS first, coalesce(b.s, 'absent') AS second FROM a FULL JOIN b ON a.author = b.author""", (95, 96))
def class_merge(t: Tables) -> DataFrame:
    """Classes of authors in two cycles, absent where they have none: one aggregation with conditional counts instead of a full join."""
    c = t.commits.where("commit_date >= timestamp_ntz '1997-01-01' AND commit_date < timestamp_ntz '1997-07-01'")
    n = c.groupBy("author").agg(*[F.count_if(F.month("commit_date").between(k, k + 2)).alias(f"n{k}") for k in (1, 4)])
    state = lambda x: F.when(F.col(x) > 1, "core").when(F.col(x) > 0, "peripheral").otherwise("absent")
    return n.select("author", state("n1").alias("first"), state("n4").alias("second"))


@query("left_merge_states", f"WITH {_COMMITS}, n AS (SELECT author, count(*) AS n FROM c WHERE cycle = TIMESTAMP '1998-01-01' GROUP BY 1) SELECT c_custkey AS author, CASE WHEN n IS NULL THEN -1 ELSE n END AS degree FROM customer LEFT JOIN n ON c_custkey = author", (97,))
def left_merge_states(t: Tables) -> DataFrame:
    """All persons with their degree, -1 if absent."""
    n = t.commits.where("commit_date >= timestamp_ntz '1998-01-01' AND commit_date < timestamp_ntz '1998-04-01'").groupBy("author").agg(F.count("*").alias("n"))
    return t.customer.select(F.col("c_custkey").alias("author")).join(n, "author", "left").select("author", F.coalesce("n", F.lit(-1)).alias("degree"))


@query("quality_motif_merge", """
WITH q AS (SELECT l_partkey AS entity, count(*) FILTER (WHERE l_returnflag = 'R') AS bugs, sum(l_quantity) AS loc FROM lineitem GROUP BY 1), m AS (SELECT l_partkey AS entity, count(DISTINCT l_suppkey) AS motifs FROM lineitem GROUP BY 1), d AS (SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1)
SELECT q.entity, bugs, motifs, commits, round(bugs / (loc + 1), 6) AS bug_density, round(motifs / commits, 6) AS motifs_per_commit FROM q JOIN m ON q.entity = m.entity JOIN d ON q.entity = d.entity""", (98, 115, 205))
def quality_motif_merge(t: Tables) -> DataFrame:
    """Bugs, motifs and commits of each entity, and their ratios; one pass instead of three joined aggregations."""
    g = t.dependencies.groupBy("entity").agg(F.count_if(F.col("flag") == "R").alias("bugs"), F.sum("size").alias("loc"), F.countDistinct("file").alias("motifs"), F.countDistinct("commit_id").alias("commits"))
    return g.select("entity", "bugs", "motifs", "commits", F.round(F.col("bugs") / (F.col("loc") + 1), 6).alias("bug_density"), F.round(F.try_divide("motifs", "commits"), 6).alias("motifs_per_commit"))


@query("cluster_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a CROSS JOIN nation b WHERE a.n_nationkey < b.n_nationkey", (99,))
def cluster_pairs(t: Tables) -> DataFrame:
    """Pairs of clusters (25 rows at every scale)."""
    n = t.nation.select(F.col("n_nationkey").alias("a"))
    return n.crossJoin(n.withColumnRenamed("a", "b")).where("a < b")


@query("asof_entity_lookup", """
WITH m AS (SELECT user_id, ts AS since, event_id AS marker FROM events WHERE event_type = 'signup')
SELECT e.event_id AS id, marker FROM events e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.since""", (100, 77))
def asof_entity_lookup(t: Tables) -> DataFrame:
    """For each change the last marker of its author at or before it."""
    c = t.changes
    m = c.where("subsys = 'signup'").select(F.col("author").alias("who"), F.col("commit_date").alias("since"), F.col("id").alias("marker"))
    return R.as_of(c.select("id", F.col("author").alias("who"), "commit_date"), m, "who", "commit_date", "since", ["marker"]).select("id", "marker")


@query("messages_in_ranges", "WITH w AS (SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT week, event_type, n FROM w WHERE n >= 5", (101, 294))
def messages_in_ranges(t: Tables) -> DataFrame:
    """Ranges (weeks) with five messages or more."""
    week = F.date_trunc("week", "commit_date").cast("timestamp_ntz").alias("week")
    return t.changes.groupBy(week, F.col("subsys").alias("event_type")).agg(F.count("*").alias("n")).where("n >= 5")


@query("semi_and_anti", "SELECT c_custkey AS person, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS fixed FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1996-01-01')", (102, 103))
def semi_and_anti(t: Tables) -> DataFrame:
    """Persons without early urgent work, and whether they fixed anything."""
    p = t.customer.select(F.col("c_custkey").alias("person"))
    o = t.commits
    p = p.join(o.where("priority = '1-URGENT' AND commit_date < timestamp_ntz '1996-01-01'").select(F.col("author").alias("person")), "person", "left_anti")
    f = o.where("status = 'F'").select(F.col("author").alias("person")).distinct().withColumn("f", F.lit(True))
    return p.join(f, "person", "left").select("person", F.coalesce("f", F.lit(False)).alias("fixed"))


@query("thread_responses", "SELECT a.conv_id AS thread, a.turn AS number, a.role AS author, b.role AS starter FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 0 WHERE a.turn > 0", (104, 293))
def thread_responses(t: Tables) -> DataFrame:
    """Responses of all threads with the thread's starter, in one join."""
    first = t.turns.where("number = 0").select("thread", F.col("author").alias("starter"))
    return t.turns.where("number > 0").drop("text").join(first, "thread")


@query("local_ids", "SELECT c_custkey AS person, dense_rank() OVER (ORDER BY c_custkey) AS local_id, c_nationkey AS graph FROM customer WHERE c_nationkey = 3", (105,))
def local_ids(t: Tables) -> DataFrame:
    """Consecutive ids of one graph's members."""
    from pyspark.sql import Window

    return t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("graph")).withColumn("local_id", F.dense_rank().over(Window.partitionBy("graph").orderBy("person")).cast("bigint"))


@query("metric_scatter", f"WITH {_COMMITS}, x AS (SELECT author, cycle, CAST(count(*) AS DOUBLE) AS commits, round(avg(diff_size), 4) AS size FROM c GROUP BY 1, 2) SELECT author, cycle, commits AS metric1, size AS metric2 FROM x WHERE commits <> 0 AND size <> 0", (106,))
def metric_scatter(t: Tables) -> DataFrame:
    """Two metrics of a long table side by side (pivot instead of a self-join)."""
    long = t.commits.groupBy("author", "cycle").agg(F.count("*").cast("double").alias("commits"), F.round(F.avg("diff_size"), 4).alias("size")).unpivot(["author", "cycle"], ["commits", "size"], "metric", "value")
    wide = long.groupBy("author", "cycle").pivot("metric", ["commits", "size"]).agg(F.first("value"))
    return wide.where("commits <> 0 AND size <> 0").select("author", "cycle", F.col("commits").alias("metric1"), F.col("size").alias("metric2"))


# ---------------------------------------------------------------- aggregations
@query("factoids_total", f"WITH {_COMMITS} SELECT count(DISTINCT author) AS n_authors, count(id) AS n_commits, round(sum(diff_size), 2) AS total_size FROM c", (109,))
def factoids_total(t: Tables) -> DataFrame:
    """Authors, commits and lines of all."""
    return R.factoids(t.commits, [])


@query("factoids_cycle", f"WITH {_COMMITS} SELECT cycle, count(DISTINCT author) AS n_authors, count(id) AS n_commits, round(sum(diff_size), 2) AS total_size FROM c GROUP BY cycle", (109,))
def factoids_cycle(t: Tables) -> DataFrame:
    """Authors, commits and lines of each cycle."""
    return R.factoids(t.commits, ["cycle"])


@query("factoids_yearly", f"WITH {_COMMITS} SELECT CAST(year(commit_date) AS BIGINT) AS year, count(DISTINCT author) AS n_authors, count(id) AS n_commits, round(sum(diff_size), 2) AS total_size FROM c GROUP BY 1", (109, 199))
def factoids_yearly(t: Tables) -> DataFrame:
    """Authors, commits and lines of each year."""
    return R.factoids(t.commits.withColumn("year", F.year("commit_date").cast("bigint")), ["year"])


@query("project_time_range", f"WITH {_COMMITS} SELECT status AS project, min(commit_date) AS first, max(commit_date) AS last, datediff('day', min(commit_date), max(commit_date)) AS days FROM c GROUP BY status", (110, 182))
def project_time_range(t: Tables) -> DataFrame:
    """First and last commit of each project and the days between."""
    g = t.commits.groupBy(F.col("status").alias("project")).agg(F.min("commit_date").alias("first"), F.max("commit_date").alias("last"))
    return g.withColumn("days", F.datediff("last", "first").cast("bigint"))


@query("commit_doc_ratio", f"WITH {_COMMITS} SELECT cycle, round(avg(CASE WHEN diff_size >= 150000 THEN 1.0 ELSE 0.0 END), 6) AS documented, round(avg(CASE WHEN priority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6) AS signed FROM c GROUP BY cycle", (111,))
def commit_doc_ratio(t: Tables) -> DataFrame:
    """Shares of documented and of signed commits in each cycle."""
    share = lambda cond: F.round(F.avg(cond.cast("double")), 6)
    return t.commits.groupBy("cycle").agg(share(F.col("diff_size") >= 150000).alias("documented"), share(F.col("priority") == "1-URGENT").alias("signed"))


@query("weekend_fraction", """
WITH g AS (SELECT user_id AS author, round(sum(CASE WHEN isodow(ts) >= 6 THEN value ELSE 0 END) / sum(value), 6) AS fraction FROM events GROUP BY 1)
SELECT author, fraction, CASE WHEN fraction < 0.25 THEN 'workdays' WHEN fraction < 0.5 THEN 'continuous' ELSE 'weekend' END AS class FROM g""", (112,))
def weekend_fraction(t: Tables) -> DataFrame:
    """Share of lines changed on weekends and the kind of worker."""
    g = R.fraction(t.changes, ["author"], F.weekday("commit_date") >= 5, "diff_size")
    return g.withColumn("class", R.work_class(F.col("fraction")))


@query("corrective_ratio", "SELECT l_suppkey AS file, l_partkey AS entity, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM lineitem GROUP BY 1, 2", (113,))
def corrective_ratio(t: Tables) -> DataFrame:
    """Share of corrective changes of each entity."""
    return t.dependencies.groupBy("file", "entity").agg(F.round(F.avg((F.col("flag") == "R").cast("double")), 6).alias("ratio"))


@query("defect_aggregation", """
SELECT l_partkey AS file, count(*) FILTER (WHERE l_returnflag = 'R') AS bugs, round(sum(l_quantity + l_linenumber), 2) AS churn, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS loc
FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1""", (114, 155))
def defect_aggregation(t: Tables) -> DataFrame:
    """Bugs, churn and latest size of each relevant file."""
    li = t.lineitem.join(t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    latest = F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return li.groupBy(F.col("l_partkey").alias("file")).agg(F.count_if(F.col("l_returnflag") == "R").alias("bugs"), F.round(F.sum(F.col("l_quantity") + F.col("l_linenumber")), 2).alias("churn"), latest.alias("loc"))


@query("entity_commit_count", "SELECT l_partkey AS entity, count(DISTINCT l_orderkey) AS commit_count FROM lineitem GROUP BY 1", (115,))
def entity_commit_count(t: Tables) -> DataFrame:
    """Commits that touch each entity."""
    return t.dependencies.groupBy("entity").agg(F.countDistinct("commit_id").alias("commit_count"))


@query("cluster_summary", f"""
WITH {_MEMBERS}, w AS (SELECT cluster, person, rank, count(*) AS n, sum(o_totalprice) AS s FROM m JOIN orders ON o_custkey = person GROUP BY ALL)
SELECT cluster, count(*) AS members, round(median(rank), 6) AS rank_median, round(median(n), 6) AS commits_median, round(sum(s), 2) AS total, round(sum(n) / count(*), 6) AS commits_per_person, round(sum(s) / count(*), 4) AS size_per_person FROM w GROUP BY cluster""", (116,))
def cluster_summary(t: Tables) -> DataFrame:
    """Medians, sums and per-person ratios of each cluster."""
    w = t.orders.groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    g = _members(t).join(w, "person").groupBy("cluster").agg(F.count("*").alias("members"), F.round(F.median("rank"), 6).alias("rank_median"), F.round(F.median("n"), 6).alias("commits_median"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return g.select("cluster", "members", "rank_median", "commits_median", F.round("s", 2).alias("total"), F.round(F.col("n") / F.col("members"), 6).alias("commits_per_person"), F.round(F.col("s") / F.col("members"), 4).alias("size_per_person"))


@query("weighted_edgelist", "SELECT s_nationkey AS from_id, l_linenumber AS to_id, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2", (118,))
def weighted_edgelist(t: Tables) -> DataFrame:
    """Parallel edges as weights."""
    s = t.supplier.select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("from_id"))
    return R.weighted_edges(t.dependencies.join(s, "file").select("from_id", F.col("line").alias("to_id")))


@query("commit_entity_sets", "SELECT l_orderkey AS commit_id, count(DISTINCT l_partkey) AS n, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS entities FROM lineitem GROUP BY 1", (119, 187))
def commit_entity_sets(t: Tables) -> DataFrame:
    """Sorted set of the entities of each commit."""
    g = t.dependencies.groupBy("commit_id").agg(F.sort_array(F.collect_set("entity")).alias("e"))
    return g.select("commit_id", F.size("e").cast("bigint").alias("n"), F.concat_ws(",", F.col("e").cast("array<string>")).alias("entities"))


@query("entity_line_counts", "SELECT l_orderkey AS commit_id, l_suppkey AS file, l_partkey AS entity, count(*) AS lines FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2, 3", (76, 120))
def entity_line_counts(t: Tables) -> DataFrame:
    """Lines of each commit in each entity since a date."""
    return t.dependencies.where("commit_date >= timestamp_ntz '1996-01-01'").groupBy("commit_id", "file", "entity").agg(F.count("*").alias("lines"))


@query("feature_line_counts", """
WITH f AS (SELECT l_orderkey AS commit_id, l_suppkey AS file, unnest(CASE WHEN l_returnflag = 'A' THEN ['A', l_linestatus] ELSE [l_linestatus] END) AS feature FROM lineitem)
SELECT commit_id, file, feature, count(*) AS lines FROM f GROUP BY 1, 2, 3""", (121,))
def feature_line_counts(t: Tables) -> DataFrame:
    """Lines of each commit in each feature; a line may be of several."""
    features = F.when(F.col("l_returnflag") == "A", F.array(F.lit("A"), F.col("l_linestatus"))).otherwise(F.array("l_linestatus"))
    f = t.lineitem.select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file"), F.explode(features).alias("feature"))
    return f.groupBy("commit_id", "file", "feature").agg(F.count("*").alias("lines"))


@query("relation_sums", "WITH g AS (SELECT l_suppkey AS receiver, o_custkey AS sender, l_returnflag AS type, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) SELECT sender, receiver, round(sum(w), 2) AS total, round(max(w), 2) AS largest, arg_max(type, (w, type)) AS largest_type FROM g WHERE type <> 'N' GROUP BY 1, 2", (123, 41))
def relation_sums(t: Tables) -> DataFrame:
    """Weights of active relations between senders and receivers, and the heaviest kind."""
    g = t.authored.where("flag <> 'N'").groupBy(F.col("author").alias("sender"), F.col("file").alias("receiver"), F.col("flag").alias("type")).agg(F.sum("size").alias("w"))
    return g.groupBy("sender", "receiver").agg(F.round(F.sum("w"), 2).alias("total"), F.round(F.max("w"), 2).alias("largest"), F.max_by("type", F.struct("w", "type")).alias("largest_type"))


@query("subsystem_fractions", "SELECT user_id AS person, event_type AS subsystem, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS fraction FROM events GROUP BY 1, 2", (42, 124, 202))
def subsystem_fractions(t: Tables) -> DataFrame:
    """Share of each person's links that go to each subsystem."""
    from pyspark.sql import Window

    g = t.changes.groupBy(F.col("author").alias("person"), F.col("subsys").alias("subsystem")).agg(F.count("*").alias("n"))
    return g.select("person", "subsystem", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("person")), 6).alias("fraction"))


@query("thread_statistics", "SELECT conv_id AS thread, count(DISTINCT role) AS n_authors, count(*) AS n_messages, arg_min(string_split(text, chr(10))[1], turn) AS subject, min(turn) AS first FROM conversations GROUP BY 1", (125,))
def thread_statistics(t: Tables) -> DataFrame:
    """Authors, messages and first subject of each thread."""
    return t.turns.groupBy("thread").agg(F.countDistinct("author").alias("n_authors"), F.count("*").alias("n_messages"), F.min_by(F.split("text", "\n")[0], "number").alias("subject"), F.min("number").alias("first"))


@query("authors_per_cycle", f"WITH {_COMMITS} SELECT cycle, count(DISTINCT author) AS n FROM c GROUP BY cycle", (126,))
def authors_per_cycle(t: Tables) -> DataFrame:
    """Authors of each cycle."""
    return t.commits.groupBy("cycle").agg(F.countDistinct("author").alias("n"))


@query("multi_cycle_histogram", f"WITH {_COMMITS}, n AS (SELECT author, count(DISTINCT cycle) AS cycles FROM c GROUP BY author) SELECT cycles, count(*) AS authors FROM n GROUP BY cycles", (126,))
def multi_cycle_histogram(t: Tables) -> DataFrame:
    """How many authors take part in how many cycles."""
    return t.commits.groupBy("author").agg(F.countDistinct("cycle").alias("cycles")).groupBy("cycles").agg(F.count("*").alias("authors"))


@query("loc_per_author", f"WITH {_COMMITS}, g AS (SELECT cycle, sum(diff_size) AS delta, count(DISTINCT author) AS authors FROM c GROUP BY cycle) SELECT cycle, round(delta, 2) AS delta, authors, round(sum(delta) OVER (ORDER BY cycle), 2) AS loc, round(sum(delta) OVER (ORDER BY cycle) / authors, 4) AS loc_per_author FROM g", (107, 127, 141))
def loc_per_author(t: Tables) -> DataFrame:
    """Running size of the project by cycle, and per author (the window sees one row a cycle)."""
    from pyspark.sql import Window

    g = t.commits.groupBy("cycle").agg(F.sum("diff_size").alias("d"), F.countDistinct("author").alias("authors"))
    loc = F.sum("d").over(Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("cycle", F.round("d", 2).alias("delta"), "authors", F.round(loc, 2).alias("loc"), F.round(loc / F.col("authors"), 4).alias("loc_per_author"))


@query("timezone_counts", """
WITH z AS (SELECT CASE event_id % 3 WHEN 0 THEN 'Europe/Berlin;Africa/Lagos' WHEN 1 THEN 'Asia/Tokyo' ELSE 'Europe/Berlin' END AS zones FROM events), e AS (SELECT unnest(string_split(zones, ';')) AS zone FROM z), g AS (SELECT zone, count(*) AS n FROM e GROUP BY zone)
SELECT zone, n, round(n / max(n) OVER (), 6) AS scaled FROM g""", (128,))
def timezone_counts(t: Tables) -> DataFrame:
    """Commits of each time zone, scaled by the largest; joint zones count for each (grouped before they are split)."""
    from pyspark.sql import Window

    zones = F.when(F.col("id") % 3 == 0, "Europe/Berlin;Africa/Lagos").when(F.col("id") % 3 == 1, "Asia/Tokyo").otherwise("Europe/Berlin")
    g = t.changes.groupBy(zones.alias("zones")).agg(F.count("*").alias("k")).select(F.explode(F.split("zones", ";")).alias("zone"), "k").groupBy("zone").agg(F.sum("k").alias("n"))
    return g.withColumn("scaled", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6))


@query("commit_speed", "WITH m AS (SELECT max(ts) AS hi, min(ts) AS lo FROM events) SELECT event_type, count(*) FILTER (WHERE ts > hi - INTERVAL 7 DAY) AS recent, round(count(*) * 7.0 / datediff('day', any_value(lo), any_value(hi)), 6) AS usual FROM events, m GROUP BY event_type", (129,))
def commit_speed(t: Tables) -> DataFrame:
    """Changes of the last days against the usual number (dates of all rows are one row, broadcast)."""
    m = t.changes.agg(F.max("commit_date").alias("hi"), F.min("commit_date").alias("lo"))
    g = t.changes.join(F.broadcast(m)).groupBy(F.col("subsys").alias("event_type")).agg(F.count_if(F.expr("commit_date > hi - INTERVAL 7 DAY")).alias("recent"), F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return g.select("event_type", "recent", F.round(F.col("n") * 7.0 / F.datediff("hi", "lo"), 6).alias("usual"))


@query("cycle_speed", f"WITH {_COMMITS} SELECT cycle, count(*) AS n, round(count(*) * 91.0 / greatest(1, datediff('day', min(commit_date), max(commit_date))), 6) AS scaled FROM c GROUP BY cycle", (129,))
def cycle_speed(t: Tables) -> DataFrame:
    """Commits of each cycle scaled by its duration."""
    g = t.commits.groupBy("cycle").agg(F.count("*").alias("n"), F.datediff(F.max("commit_date"), F.min("commit_date")).alias("days"))
    return g.select("cycle", "n", F.round(F.col("n") * 91.0 / F.greatest(F.lit(1), "days"), 6).alias("scaled"))


@query("project_overview", "SELECT 'commits' AS what, count(*) AS n FROM orders UNION ALL SELECT 'persons', count(*) FROM customer UNION ALL SELECT 'threads', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'plots', count(*) FROM part", (2, 130, 184))
def project_overview(t: Tables) -> DataFrame:
    """Numbers of commits, persons, threads and plots."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return one(t.orders, "commits").unionByName(one(t.customer, "persons")).unionByName(one(t.conversations.select("conv_id").distinct(), "threads")).unionByName(one(t.part, "plots"))


@query("boxplot_stats", """
WITH r AS (SELECT event_type AS kind, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events),
d AS (SELECT *, floor((n + 3) / 2.0) / 2.0 AS d FROM r),
f AS (SELECT kind, max(n) AS n, min(v) AS low, avg(v) FILTER (WHERE r = floor(d) OR r = ceil(d)) AS q1, avg(v) FILTER (WHERE r = floor((n + 1) / 2.0) OR r = ceil((n + 1) / 2.0)) AS q2, avg(v) FILTER (WHERE r = floor(n + 1 - d) OR r = ceil(n + 1 - d)) AS q3, max(v) AS high FROM d GROUP BY kind)
SELECT kind, f.n, low, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, high, round(1.58 * (q3 - q1) / sqrt(f.n), 6) AS notch, x.wl AS whisker_low, x.wh AS whisker_high, x.o AS n_outliers
FROM f JOIN (SELECT event_type, min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS wl, max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS wh, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS o FROM events JOIN f ON event_type = kind GROUP BY event_type) x ON x.event_type = kind""", (69, 131, 132))
def boxplot_stats(t: Tables) -> DataFrame:
    """Box-plot statistics of each kind by Tukey's hinges."""
    b = R.box_statistics(t.changes.select(F.col("subsys").alias("kind"), "diff_size"), ["kind"], "diff_size")
    return b.select("kind", "n", "low", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")], "high", F.round("notch", 6).alias("notch"), "whisker_low", "whisker_high", "n_outliers")


@query("rank_by_field", "WITH g AS (SELECT o_custkey AS author, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1), s AS (SELECT *, round(100 * n / sum(n) OVER (), 6) AS percent, round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 6) AS norm FROM g) SELECT author, n, total, percent, norm FROM s ORDER BY n DESC, author LIMIT 20", (133, 150, 263))
def rank_by_field(t: Tables) -> DataFrame:
    """The 20 authors with most commits, with share and scaled value (totals are one row, joined to all)."""
    g = t.commits.groupBy("author").agg(F.count("*").alias("n"), F.round(F.sum("diff_size"), 2).alias("total"))
    w = g.agg(F.sum("n").alias("all"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    p = g.join(F.broadcast(w)).select("author", "n", "total", F.round(100 * F.col("n") / F.col("all"), 6).alias("percent"), F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.round((F.col("n") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)), 6)).alias("norm"))
    return R.top(p, 20, [F.desc("n"), F.col("author")])


@query("top_contributors", f"WITH {_COMMITS} SELECT author, c_name AS name, round(sum(diff_size), 2) AS changes, count(*) AS commits FROM c JOIN customer ON author = c_custkey GROUP BY 1, 2 ORDER BY changes DESC, author LIMIT 20", (157, 158))
def top_contributors(t: Tables) -> DataFrame:
    """The 20 authors with most changed lines; names are joined to the 20 only."""
    g = R.top(t.commits.groupBy("author").agg(F.round(F.sum("diff_size"), 2).alias("changes"), F.count("*").alias("commits")), 20, [F.desc("changes"), F.col("author")])
    return g.join(t.customer.select(F.col("c_custkey").alias("author"), F.col("c_name").alias("name")), "author").select("author", "name", "changes", "commits")


@query("top_ranked", f"WITH {_MEMBERS} SELECT person, name, rank FROM m WHERE technique = 'MACHINERY' ORDER BY rank DESC, person LIMIT 20", (156,))
def top_ranked(t: Tables) -> DataFrame:
    """The 20 persons of highest rank."""
    return R.top(_members(t).where("technique = 'MACHINERY'").select("person", "name", "rank"), 20, [F.desc("rank"), F.col("person")])


@query("largest_clusters", f"WITH {_MEMBERS}, s AS (SELECT technique, cluster, count(*) AS size FROM m GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY size DESC, cluster) AS rank FROM s) WHERE rank <= 8", (160,))
def largest_clusters(t: Tables) -> DataFrame:
    """Up to eight largest clusters of each technique."""
    s = _members(t).groupBy("technique", "cluster").agg(F.count("*").alias("size"))
    return R.top_of_each(s, ["technique"], 8, [F.desc("size"), F.col("cluster")]).withColumn("rank", F.col("rank").cast("bigint"))


@query("min_max_per_type", "SELECT event_type AS type, min(value) AS low, max(value) AS high FROM events GROUP BY 1", (135,))
def min_max_per_type(t: Tables) -> DataFrame:
    """Least and greatest value of each type."""
    return t.changes.groupBy(F.col("subsys").alias("type")).agg(F.min("diff_size").alias("low"), F.max("diff_size").alias("high"))


@query("frequent_subjects", "SELECT string_split(text, chr(10))[1] AS subject, count(*) AS n FROM conversations GROUP BY 1 ORDER BY n DESC, subject LIMIT 200", (137, 159))
def frequent_subjects(t: Tables) -> DataFrame:
    """The 200 most frequent subjects."""
    return R.top(t.turns.groupBy(F.split("text", "\n")[0].alias("subject")).agg(F.count("*").alias("n")), 200, [F.desc("n"), F.col("subject")])


@query("initiate_response_summary", """
WITH i AS (SELECT conv_id, arg_min(role, turn) AS starter, count(*) - 1 AS got FROM conversations GROUP BY 1), g AS (SELECT conv_id % 20 AS person, count(*) AS initiations, sum(got) AS received FROM i GROUP BY 1), q AS (SELECT quantile_cont(received / initiations, 0.75) AS q FROM g)
SELECT count(*) AS persons, round(any_value(q), 6) AS q75, round(median(received / initiations) FILTER (WHERE received / initiations >= q), 6) AS median_above FROM g, q""", (138,))
def initiate_response_summary(t: Tables) -> DataFrame:
    """Quartile of responses per initiation and the median above it."""
    g = t.turns.groupBy("thread").agg((F.count("*") - 1).alias("got")).groupBy((F.col("thread") % 20).alias("person")).agg(F.count("*").alias("initiations"), F.sum("got").alias("received"))
    g = g.withColumn("frac", F.try_divide("received", "initiations"))
    q = g.agg(F.percentile("frac", F.lit(0.75)).alias("q"))
    return g.join(F.broadcast(q)).agg(F.count("*").alias("persons"), F.round(F.first("q"), 6).alias("q75"), F.round(F.median(F.when(F.col("frac") >= F.col("q"), F.col("frac"))), 6).alias("median_above"))


@query("performance_aggregation", "WITH s AS (SELECT l_linenumber AS cores, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) SELECT cores, round(s, 2) AS seconds, round((SELECT s FROM s WHERE cores = 1) / s, 6) AS speedup FROM s", (140,))
def performance_aggregation(t: Tables) -> DataFrame:
    """Sums by number of cores and speed-up against one."""
    s = t.lineitem.groupBy(F.col("l_linenumber").alias("cores")).agg(F.sum("l_extendedprice").alias("s"))
    one = s.where("cores = 1").select(F.col("s").alias("base"))
    return s.join(F.broadcast(one)).select("cores", F.round("s", 2).alias("seconds"), F.round(F.col("base") / F.col("s"), 6).alias("speedup"))


@query("molten_contributions", f"WITH {_COMMITS}, g AS (SELECT cycle, CAST(count(*) AS DOUBLE) AS numcommits, round(sum(diff_size), 2) AS total FROM c GROUP BY cycle) SELECT cycle, 'numcommits' AS variable, numcommits AS value FROM g UNION ALL SELECT cycle, 'total', total FROM g", (18, 59))
def molten_contributions(t: Tables) -> DataFrame:
    """Commits and lines of each cycle, long."""
    g = t.commits.groupBy("cycle").agg(F.count("*").cast("double").alias("numcommits"), F.round(F.sum("diff_size"), 2).alias("total"))
    return g.unpivot("cycle", ["numcommits", "total"], "variable", "value")


@query("quarter_id_sets", f"""
WITH {_COMMITS}, a AS (SELECT DISTINCT author FROM c WHERE cycle = TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT author FROM c WHERE cycle = TIMESTAMP '1997-04-01')
SELECT author, 'both' AS part FROM (SELECT author FROM a INTERSECT SELECT author FROM b) UNION ALL SELECT author, 'first' FROM (SELECT author FROM a EXCEPT SELECT author FROM b) UNION ALL SELECT author, 'second' FROM (SELECT author FROM b EXCEPT SELECT author FROM a)""", (184, 185, 186))
def quarter_id_sets(t: Tables) -> DataFrame:
    """Intersection and differences of the authors of two cycles."""
    c = t.commits
    a = c.where("cycle = timestamp_ntz '1997-01-01'").select("author").distinct()
    b = c.where("cycle = timestamp_ntz '1997-04-01'").select("author").distinct()
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(a.intersect(b), "both").unionByName(part(a.subtract(b), "first")).unionByName(part(b.subtract(a), "second"))


@query("classification_from_source", """
WITH n AS (SELECT o_custkey AS author, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT author, n, n > (SELECT quantile_cont(n, 0.8) FROM n) AS core FROM n""", (147, 148))
def classification_from_source(t: Tables) -> DataFrame:
    """Core developers by the 80 % quantile of their commits in one source."""
    n = t.commits.where("status = 'O'").groupBy("author").agg(F.count("*").alias("n"))
    q = n.agg(F.percentile("n", F.lit(0.8)).alias("q"))
    return n.join(F.broadcast(q)).select("author", "n", (F.col("n") > F.col("q")).alias("core"))
