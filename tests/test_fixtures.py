"""Small fixtures with known results: co-change, features, networks, rules, graphs, texts, dates."""

import math

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandwork.functions import columns as C
from strandwork.operators import graph as G
from strandwork.operators import identity, measures, motifs, networks, relational, text
from strandwork.operators import timeseries as T
from strandwork.sources import parsers as P


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lines_of_commits_in_functions(spark):
    lines = spark.createDataFrame([("f", 1, "c1"), ("f", 2, "c2"), ("f", 3, "c3"), ("f", 4, "c2"), ("f", 5, "c1"), ("f", 6, "c3")], "file string, line int, commit string")
    starts = spark.createDataFrame([("f", k, f"function{k}") for k in range(1, 6)], "file string, start int, entity string")
    got = relational.as_of(lines, starts, "file", "line", "start", ["entity"]).groupBy("commit", "entity").count()
    assert rows(got) == [("c1", "function1", 1), ("c1", "function5", 1), ("c2", "function2", 1), ("c2", "function4", 1), ("c3", "function3", 1), ("c3", "function5", 1)]


FEATURE = "file string, start int, end int, features array<string>, expression string"


def features(spark, *ranges, last=10):
    r = spark.createDataFrame([("f", *x) for x in ranges], FEATURE)
    n = spark.createDataFrame([("f", last)], "file string, last_line int")
    return {x["line"]: (set(x["features"]), x["expression"]) for x in P.lines_of_features(r, n).collect()}


def test_features_of_lines(spark):
    got = features(spark, (3, 5, ["A", "B"], "defined(A) && defined(B)"))
    assert got[2] == got[6] == ({"Base_Feature"}, "Base_Feature") and all(got[k] == ({"A", "B"}, "defined(A) && defined(B)") for k in (3, 4, 5))
    got = features(spark, (3, 9, ["A", "B"], "x"), (6, 8, ["C", "D"], "y"))
    assert got[4][0] == got[5][0] == got[9][0] == {"A", "B"} and got[6] == ({"A", "B", "C", "D"}, "y")


@pytest.mark.parametrize("ranges", [((3, 6, ["A"], "a"), (5, 9, ["B"], "b")), ((6, 3, ["A"], "a"),)])
def test_crossing_or_reversed_features_are_errors(spark, ranges):
    # Which of the two comes depends on where the error meets the driver.
    with pytest.raises((PySparkException, Py4JJavaError), match="range"):
        features(spark, *ranges)


def test_scaling_vectors(spark):
    scaled = lambda *v: [r["scaled"] for r in T.min_max(spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, v double"), [], "v").orderBy("k").collect()]
    assert scaled(-100, 100, 0) == [0, 1, 0.5] and scaled(42, 42, 42) == [1, 1, 1] and scaled(2) == [1]


def test_weighted_edges(spark):
    e = spark.createDataFrame(list(zip((1, 1, 2, 2, 3, 4), (1, 2, 3, 3, 4, 1), strict=True)), "from_id int, to_id int")
    assert rows(relational.weighted_edges(e)) == [(1, 1, 1), (1, 2, 1), (2, 3, 2), (3, 4, 1), (4, 1, 1)]


def test_queries_of_a_commit(spark):
    c = spark.createDataFrame([(1, 2), (1, 5), (1, 3), (2, 9)], "commit_id int, entity bigint")
    q = {r["query"]: r["expected"] for r in networks.rule_queries(c).collect()}
    assert q == {2: [3, 5], 5: [2, 3], 3: [2, 5]}
    rules = spark.createDataFrame([(2, 3), (2, 9)], "e1 bigint, e2 bigint")
    e = {r["query"]: (r["precision"], r["recall"]) for r in networks.evaluate_rules(networks.rule_queries(c), rules).collect()}
    assert e == {2: (0.5, 0.5), 5: (None, 0.0), 3: (None, 0.0)}


def developers(spark, relation):
    """Two teams on two entities each; whether the network is connected."""
    c = [(a, e, 1.0) for team, entities in (((1, 2), (1, 2)), ((3, 4), (5, 6))) for a in team for e in entities for _ in range(10)]
    changes = spark.createDataFrame(c, "author bigint, entity bigint, size double")
    edges = networks.person_edges(networks.expand_by_relation(changes, spark.createDataFrame(relation, "e1 bigint, e2 bigint")))
    return G.connected_components(edges).select("component").distinct().count() == 1


def test_developer_network_is_connected_by_relations(spark):
    assert not developers(spark, [(1, 2)]) and developers(spark, [(2, 5)])


def test_simultaneous_mails_give_no_edges(spark):
    m = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 5), (1, 3, "c", 6), (2, 1, "a", 1), (2, 2, "a", 2)], "thread int, number int, author string, sent int")
    assert rows(networks.mail_edges(m)) == [("c", "a", 1), ("c", "b", 1)]


def test_proximity_goes_to_earlier_authors(spark):
    lines = spark.createDataFrame([("f", "g", "c1", "L", 1)] * 2 + [("f", "g", "c2", "P", 2)] * 3 + [("f", "h", "c2", "P", 2)], "file string, func string, commit_id string, author string, commit_date int")
    assert rows(networks.proximity_edges(lines)) == [("P", "L", 5)]


def test_global_features_link_both_ways(spark):
    lines = spark.createDataFrame([("A", "Adam", 4), ("A", "Clara", 3), ("A", "Geoff", 1), ("C", "Adam", 2), ("C", "Max", 1)], "feature string, author string, lines int")
    assert {frozenset(r[:2]) for r in rows(networks.feature_edges(lines))} == {frozenset(x) for x in (("Adam", "Clara"), ("Adam", "Geoff"), ("Clara", "Geoff"), ("Adam", "Max"))}
    assert dict(((a, b), w) for a, b, w in rows(networks.feature_edges(lines)))[("Clara", "Adam")] == 3


def test_unique_timestamps_follow_the_sequential_rule(spark):
    import datetime
    import random

    r = random.Random(1)
    t0 = datetime.datetime(2024, 1, 1)
    times = sorted(r.randint(0, 60) for _ in range(80))
    d = spark.createDataFrame([(k, t0 + datetime.timedelta(seconds=t)) for k, t in enumerate(times)], "id int, t timestamp_ntz")
    got = [r["unique_at"] for r in T.unique_timestamps(d, [], "t", ["id"]).orderBy("id").collect()]
    want, last = [], -1
    for t in times:
        last = t if t > last else last + 1
        want.append(t0 + datetime.timedelta(seconds=last))
    assert got == want


def test_sliding_windows_hold_complete_windows_only(spark):
    d = spark.sql("SELECT explode(sequence(0, 120)) AS k").selectExpr("k", "cast(date_add(date '2024-01-01', k) as timestamp_ntz) AS t")
    got = {r["window_id"]: r["n"] for r in T.sliding_windows(d, "t", "2024-01-01", "2024-04-30", 30, 14).groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: 30 for k in range((120 - 30) // 14 + 1)}


def graph(spark, edges):
    return spark.createDataFrame([(a, b, 1) for a, b in edges], "from_id bigint, to_id bigint, weight bigint")


def test_relabelled_graph_has_the_same_measures(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7)]
    move = {k: (k * 3 + 1) % 8 + 100 for k in range(8)}
    a, b = graph(spark, edges), graph(spark, [(move[x], move[y]) for x, y in edges])
    triangles = lambda g: sorted(r["triangles"] for r in G.transitivity(g).collect())
    assert triangles(a) == triangles(b) and G.density(a).first()["density"] == G.density(b).first()["density"]
    assert [r["difference"] for r in G.graph_difference(a, a).collect()] == [0.0] * 8
    rank = lambda g: sorted(round(r["rank"], 9) for r in G.pagerank(g, rounds=15).collect())
    assert rank(a) == rank(b) and math.isclose(sum(rank(a)), 1, abs_tol=1e-6)


def test_components_of_long_chains(spark):
    e = graph(spark, [(k, k + 1) for k in range(200)] + [(1000 + k, 1001 + k) for k in range(5)])
    assert {r["component"] for r in G.connected_components(e).collect()} == {0, 1000}


def test_turnover_states(spark):
    a = spark.createDataFrame([(k, k) for k in range(10)] + [(33, 40)], "vertex bigint, degree bigint")
    b = spark.createDataFrame([(k, k) for k in range(10)] + [(33, 0), (35, 0)], "vertex bigint, degree bigint")
    got = {r["vertex"]: (r["before"], r["after"]) for r in G.turnover(a, b).collect()}
    assert got[33] == ("core", "isolated") and got[35] == ("absent", "isolated") and got[1] == ("peripheral", "peripheral")


def test_communities_of_two_cliques(spark):
    clique = lambda lo: [(i, j) for i in range(lo, lo + 5) for j in range(i + 1, lo + 5)]
    frame = pd.DataFrame([(a, b, 1.0) for a, b in [*clique(0), *clique(10), (4, 10)]], columns=["u", "v", "w"])
    for f in (G.communities_of, lambda x: G.walktrap_of(x, count=2)):
        c = f(frame).set_index("vertex")["community"].to_dict()
        assert {c[k] for k in range(5)} == {0} and {c[k] for k in range(10, 15)} == {10}


def test_path_measures_of_a_path():
    m = G.path_measures(pd.DataFrame([(0, 1, 1.0), (1, 2, 1.0)], columns=["u", "v", "w"])).set_index("vertex")
    assert m["betweenness"].to_dict() == {0: 0.0, 1: 1.0, 2: 0.0} and m["closeness"][1] == 1.0 and m["eccentricity"].to_dict() == {0: 2, 1: 1, 2: 2}


def test_core_share_stays_below_threshold(spark):
    r = np.random.default_rng(1)
    n = pd.Series(r.integers(0, 50, 1000)).value_counts().reset_index()
    d = spark.createDataFrame([(int(a), int(b)) for a, b in n.to_numpy()], "author bigint, freq bigint")
    core = T.core_by_share(d, [], "author", "freq").where("core").agg(F.sum("freq")).first()[0]
    assert core < 800


def test_triangle_and_square_motifs(spark):
    touch = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 20)], "dev bigint, artifact bigint")
    comm = spark.createDataFrame([(1, 2), (3, 4)], "d1 bigint, d2 bigint")
    assert rows(motifs.triangles(touch, comm)) == [(10, 2, 4)]
    deps = spark.createDataFrame([(10, 20)], "a1 bigint, a2 bigint")
    assert rows(motifs.squares(touch, deps, comm)) == [(10, 20, 1, 2)]


def test_null_model_keeps_degrees():
    frame = pd.DataFrame({"dev": [1, 1, 2, 3, 3, 4], "artifact": [10, 20, 10, 20, 30, 30]})
    out = motifs._rewired(frame, "dev", "artifact", 3)
    assert out["dev"].value_counts().to_dict() == frame["dev"].value_counts().to_dict() and out["artifact"].value_counts().to_dict() == frame["artifact"].value_counts().to_dict() and not out.duplicated().any()


def test_dtw():
    assert T.dtw_of(np.array([]), np.array([])) == 0 and T.dtw_of(np.array([1.0]), np.array([])) == 1
    assert T.dtw_of(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])) == 0 and T.dtw_of(np.array([0.0, 0]), np.array([1.0, 1])) == pytest.approx(0.75)


def test_persons_merge_by_name_or_email(spark):
    a = spark.createDataFrame([(1, "Ann", "a@x"), (1, "ann ", "b@x"), (1, None, "B@x"), (1, "Bob", None), (2, "Ann", "a@x"), (1, "Bob", "c@x")], "project int, name string, email string")
    got = identity.resolve_persons(a).collect()
    by = {(r["project"], r["name"], r["email"]): r["person"] for r in got}
    assert by[1, "Ann", "a@x"] == by[1, "ann ", "b@x"] == by[1, None, "B@x"] != by[1, "Bob", None] == by[1, "Bob", "c@x"] and by[2, "Ann", "a@x"] != by[1, "Ann", "a@x"]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "name", "email"), [('"Last, First" <A.B@X.org>', "First Last", "a.b@x.org"), ("Ann <ann@x.org>", "Ann", "ann@x.org")])
def test_addresses(spark, text, name, email):
    assert tuple(one(spark, C.decompose_address, text)) == (name, email)


def test_author_repair(spark):
    assert tuple(one(spark, C.repair_author, "ann.lee at x.org")) == ("Ann Lee", "ann.lee@x.org")
    assert tuple(one(spark, C.repair_author, "Ann via List <ann@x.org>")) == ("Ann", "ann@x.org")
    assert one(spark, C.repair_author, "garbled")["email"].endswith("@unknown")


@pytest.mark.parametrize(("text", "utc", "offset"), [("Tue, 2 Jan 2024 10:00:00 +0100", "2024-01-02 09:00:00", 100), ("2 Jan 2024 10:00:00 -0700 (MST)", "2024-01-02 17:00:00", -700), ("2024-01-02 10:00:00", "2024-01-02 10:00:00", 0), ("nonsense", None, 0), (None, None, 0)])
def test_dates(spark, text, utc, offset):
    got = one(spark, C.parse_date, text)
    assert (got["utc"] and str(got["utc"]), got["offset"]) == (utc, offset)


def test_offsets(spark):
    assert [one(spark, C.offset_minutes, x) for x in ("100", "-330", "530", "0")] == [60, -210, 330, 0]
    assert str(one(spark, C.parse_git_date, "2024-01-02 10:00:00 +0130")) == "2024-01-02 08:30:00"


def test_identifiers_and_subjects(spark):
    assert one(spark, C.split_identifier, "parseHTTPHeader_fooBar2") == ["parse", "http", "header", "foo", "bar2"]
    assert one(spark, lambda x: C.subject_tokens(x, ("the",)), "Re: [PATCH v2] the Fix 3 things") == ["fix", "things"]
    assert one(spark, C.is_corrective, "a prefix") and not one(spark, C.is_corrective, "a feature")


def test_blame(spark):
    h = "a" * 40, "b" * 40
    text_ = f"{h[0]} 1 1 2\nauthor x\n\tint a;\n{h[0]} 2 2\n\tint b;\n{h[1]} 3 3 1\n\t}}"
    assert rows(P.blame(spark.createDataFrame([(text_,)], "value string"))) == [(0, h[0], "int a;"), (1, h[0], "int b;"), (2, h[1], "}")]


def test_sql_objects_and_pajek(spark):
    t = spark.createDataFrame([("f", "CREATE TABLE a (\n x int);\n\ndrop table if exists b;\n")], "file string, value string")
    assert rows(P.sql_objects(t)) == [("f", "a", 0, 2), ("f", "b", 3, 4)]
    p = spark.createDataFrame([(k, x) for k, x in enumerate(["*Vertices 2", '1 "a"', "*Arcs", "1 2 3.5", "2 1"])], "n int, value string")
    assert rows(P.pajek(p)) == [(1, 2, 3.5), (2, 1, 1.0)]


def test_mailbox_replies(spark):
    box = "From x\nFrom: kathy\nMessage-ID: <1>\nSubject: a\n\nhi\n\nFrom x\nFrom: bill\nMessage-ID: <2>\nReferences: <0>\n <1>\n\n> hi\nyes\n-- \nbill\n"
    m = P.mailbox(spark.createDataFrame([(box,)], "value string"))
    assert rows(P.reply_edges(m)) == [("bill", "kathy", 1)] and {r["body"] for r in m.collect()} == {"hi", "yes"}


def test_cost_metrics(spark):
    report = "Development Effort Estimate, Person-Years (Person-Months) = 1.50 (18.02)\nSchedule Estimate, Years (Months) = 0.6 (7.5)\nEstimated Average Number of Developers (Effort/Schedule)  = 2.4\nTotal Estimated Cost to Develop = $ 202,858"
    got = one(spark, P.cost_metrics, report)
    assert (got["total_cost"], got["schedule_months"]) == (202858.0, 7.5)


def test_semantic_coupling_drops_terms_of_all(spark):
    d = spark.createDataFrame([(1, "alpha beta all"), (2, "alpha beta all"), (3, "gamma delta all"), (4, "gamma delta all")], "doc_id int, text string")
    c = text.term_counts(d, "doc_id", "text")
    assert [(a, b) for a, b, _ in rows(text.tfidf_coupling(c, "doc_id", 0.5))] == [(1, 2), (3, 4)]
    assert [(r["a"], r["b"]) for r in text.lsa_coupling(c.withColumn("g", F.lit(1)), "g", "doc_id", 2, 0.7).collect()] == [(1, 2), (3, 4)]


def test_frequent_terms_without_excluded_lists(spark):
    c = spark.createDataFrame([(1, "patch", 9), (1, "kernel", 5), (2, "kernel", 1), (2, "int", 8), (2, "note", 7)], "doc bigint, term string, tf bigint")
    assert rows(text.frequent_terms(c, 1.0, 50, ("c", "programming", "conversation"))) == [("kernel", 6)]


def test_source_files(spark):
    lines = spark.createDataFrame([(x,) for x in ("M\tA.C", "A\tb.h", "D\tc.c", "R100\told.py\tnew.py", "M\tmysql", "M\tx.phtml")], "value string")
    assert rows(P.changed_files(lines)) == [("A.C",), ("mysql",), ("new.py",), ("x.phtml",)]


def brute_triangle_communities(edges):
    """Sets of the vertices of each community, by union of triangles that share an edge."""
    es = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    vs = sorted({v for e in es for v in e})
    held = [{(a, b), (a, c), (b, c)} for a in vs for b in vs for c in vs if a < b < c and {(a, b), (a, c), (b, c)} <= es]
    out = []
    for t in held:
        near = [x for x in out if x & t]
        out = [x for x in out if not x & t] + [t.union(*near)]
    return sorted(tuple(sorted({v for e in x for v in e})) for x in out)


def test_triangle_communities_equal_brute_force(spark):
    import random

    r = random.Random(4)
    edges = [(a, b) for a in range(26) for b in range(26) if r.random() < 0.09] + [(k, k + 1) for k in range(40, 44)] + [(50, 51), (51, 52), (52, 50), (52, 53), (53, 54), (54, 52)]
    got = {}
    for vertex, community in rows(G.clique_communities(graph(spark, edges))):
        got.setdefault(community, []).append(vertex)
    want = brute_triangle_communities(edges)
    assert sorted(tuple(sorted(x)) for x in got.values()) == want and len(want) > 3 and (50, 51, 52) in want


@pytest.fixture
def two_threads(spark, tmp_path):
    """Folder of a lineitem table whose threads 1 and 401 no modulo filter of 40 or 400 keeps."""
    mails = [(thread, k + 1, base + k, base + k, f"2024-01-0{k + 1}") for thread, base in ((1, 0), (401, 10)) for k in range(3)]
    d = spark.createDataFrame(mails, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, d string")
    d.select("*", F.to_timestamp_ntz("d").alias("l_shipdate"), F.lit(1.0).alias("l_quantity"), F.lit("A").alias("l_returnflag")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["pagerank_reversed", "clique_communities"])
def test_mail_networks_without_sql_read_all_threads(spark, two_threads, name):
    from strandwork.plans.catalog import REGISTRY

    assert sorted({r["vertex"] for r in REGISTRY.queries[name](spark, two_threads).collect()}) == [0, 1, 2, 10, 11, 12]


def test_null_model_reads_all_entities_and_commits(spark, tmp_path):
    from strandwork.plans.catalog import REGISTRY

    lines = [(commit, dev, entity) for commit, devs in ((11, (1, 2)), (12, (3, 4)), (13, (1, 4))) for dev in devs for entity in (250, 300 + dev)]
    d = spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_partkey bigint")
    d.select("*", F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), F.lit("A").alias("l_returnflag"), F.lit("2024-01-01").cast("timestamp_ntz").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = rows(REGISTRY.queries["motif_null_model"](spark, str(tmp_path)))
    # Entity 250 keeps its four developers, of whom three pairs share a commit.
    assert len(got) == 20 and all((m, a) == (6, 6) for _, m, a in got)


# ---------------------------------------------------------------- further measures
def star(spark, n):
    return spark.createDataFrame([(0, k, 1) for k in range(1, n)], "from_id bigint, to_id bigint, weight bigint")


def test_indices_of_a_star(spark):
    m = G.per_component(star(spark, 7), G.path_measures, "vertex bigint, betweenness double, closeness double, eccentricity bigint, eigenvector double")
    r = measures.component_indices(m).first()
    assert (r["size"], r["diameter"]) == (7, 2) and r["mean_path"] == pytest.approx(12 / 7) and r["centralization_betweenness"] == pytest.approx(1) and r["centralization_closeness"] == pytest.approx(1)


def test_least_cuts(spark):
    import itertools
    import random

    r = random.Random(8)
    for n in (2, 3, 5, 7):
        edges = {(k, k + 1): r.randint(1, 9) for k in range(n - 1)} | {(a, b): r.randint(1, 9) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}
        cut = lambda side, w: sum(w(e) for e in edges if (e[0] in side) != (e[1] in side))
        sides = [s for k in range(1, n) for s in itertools.combinations(range(n), k)]
        got = measures.cuts_of(pd.DataFrame([(a, b, float(w)) for (a, b), w in edges.items()], columns=["u", "v", "w"])).iloc[0]
        assert (got["min_cut"], got["adhesion"]) == (min(cut(s, edges.get) for s in sides), min(cut(s, lambda _: 1) for s in sides))


def test_power_law_of_a_sample(spark):
    x = np.arange(1, 20_001)
    p = x**-2.5 / (x**-2.5).sum()
    drawn = np.random.default_rng(3).choice(x, 20_000, p=p)
    values, counts = np.unique(drawn, return_counts=True)
    xmin, alpha, n, d, _ = measures.fit_power_law(values, counts, 30)
    assert abs(alpha - 2.5) < 0.1 and n >= 30 and d < 0.05
    # The exponent is the best of a grid.
    v, c = values[values >= xmin], counts[values >= xmin]
    cost = lambda a: c.sum() * np.log(float(measures._zeta(a, v[0]))) + a * (c * np.log(v)).sum()
    assert cost(alpha) <= min(cost(a) for a in np.arange(1.05, 6, 0.01)) + 1e-6
    assert measures.fit_power_law(np.array([1, 2, 3]), np.array([5, 2, 1]), 30)[4] is None
    few = measures.fit_power_law(np.array([1, 2, 9, 10, 11]), np.array([40, 20, 3, 2, 1]), 30)
    assert few[0] <= 2 and few[2] >= 30


def test_unit_edges_and_diversity(spark):
    e = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (1, 3, 4)], "from_id bigint, to_id bigint, weight bigint")
    assert rows(measures.multi_edges(e)) == [(1, 2, 1), (1, 2, 2), (1, 2, 3), (1, 3, 1), (1, 3, 2), (1, 3, 3), (1, 3, 4), (2, 1, 1)]
    assert rows(measures.diversity(e).withColumn("diversity", F.round("diversity", 9))) == [(1, 2, 1.0), (2, 1, 0.0), (3, 1, 0.0)]


def test_clusters_of_blocks_by_distance(spark):
    import random

    def plain(blocks, reach):
        gap = lambda a, b: (a[0] - b[1] if a[0] > b[1] else b[0] - a[1]) - 1
        groups = []
        for b in blocks:
            if b[2]:
                if groups and gap(groups[-1][0], b) <= reach:
                    groups[-1].append(b)
                else:
                    groups.append([b])
        out = {(b[0], b[1], True, k + 1) for k, g in enumerate(groups) for b in g}
        at = 0
        for b in blocks:
            if not b[2]:
                near = [min(gap(g[0], b), gap(g[-1], b)) for g in groups[at : at + 2]]
                at += len(near) > 1 and near[1] < near[0]
                out.add((b[0], b[1], False, at + 1))
        return out if groups else set()

    r = random.Random(6)
    data, want = [], set()
    for f in range(40):
        at, blocks = 1, []
        for _ in range(r.randint(1, 14)):
            end = at + r.randint(0, 5)
            blocks.append((at, end, r.random() < 0.4))
            at = end + 1
        data += [(f, *b) for b in blocks]
        want |= {(f, *x) for x in plain(blocks, 8)}
    b = spark.createDataFrame(data, "file int, first_line bigint, last_line bigint, mine boolean")
    assert set(rows(measures.block_clusters(b, ["file"], F.col("mine"), 8))) == want and want


def test_prevention_and_closure(spark):
    k = spark.createDataFrame([(1, e) for e in (2, 5, 3)] + [(2, 7), (2, 8), (3, 2)], "commit_id int, entity bigint")
    r = spark.createDataFrame([(2, 3), (5, 9)], "e1 bigint, e2 bigint")
    got = {(x["commit_id"], x["missing"]): (x["n_found"], x["precision"], x["recall"]) for x in networks.evaluate_prevention(k, r).collect()}
    assert got == {(1, 2): (1, 0, 0), (1, 5): (0, None, 0), (1, 3): (2, 0.5, 1), (2, 7): (0, None, 0), (2, 8): (0, None, 0)}
    assert rows(networks.evaluate_closure(k, r)) == [(1, 1, False), (2, 0, True)]


def test_history_between_two_commits(spark):
    h = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz '2020-01-01'), (2, timestamp_ntz '2020-01-02'), (3, timestamp_ntz '2020-01-02'), (4, timestamp_ntz '2020-01-03') AS v(id, commit_date)")
    assert [r["id"] for r in relational.sub_range(h, 2, 4).orderBy("id").collect()] == [3, 4]
    assert relational.sub_range(h, 4, 2).count() == 0 == relational.sub_range(h, 2, 99).count()
