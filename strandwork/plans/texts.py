"""Queries of texts, scalar functions, parsers, identities and stored forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import identity as I
from ..operators import text as X
from ..sources import parsers as P
from ..sources import sinks as S
from ..sources.tables import Tables
from ..streaming import windows as W
from .base import query


def _counts_sql(table: str, key: str, where: str = "true") -> str:
    return f"t AS (SELECT {key} AS key, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM {table} WHERE {where}), c AS (SELECT key, term, count(*) AS tf FROM t GROUP BY 1, 2)"


@query("term_frequencies", f"WITH {_counts_sql('conversations', 'conv_id')} SELECT key AS thread, term, tf FROM c", (136, 286))
def term_frequencies(t: Tables) -> DataFrame:
    """Term-document counts of threads."""
    return X.term_counts(t.turns, "thread", "text")


@query("frequent_terms", f"WITH {_counts_sql('documents', 'doc_id')}, n AS (SELECT term, sum(tf)::BIGINT AS n FROM c WHERE length(term) >= 3 GROUP BY term), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS r FROM n) SELECT term, n FROM r WHERE r <= least(floor((SELECT count(*) FROM n) * 0.1), 50)", (162, 287))
def frequent_terms(t: Tables) -> DataFrame:
    """The fifty most frequent terms of the documents."""
    return X.frequent_terms(X.term_counts(t.documents, "doc_id", "text", 3))


@query("subject_cloud", "WITH s AS (SELECT text AS subject FROM conversations), w AS (SELECT unnest(list_filter(string_split_regex(trim(regexp_replace(lower(subject), '\\[[^\\]]*\\]|[^a-z\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '' AND x NOT IN ('the', 'de', 'patch', 're'))) AS term, subject FROM s), d AS (SELECT DISTINCT subject, term FROM w), k AS (SELECT subject, count(*) AS n FROM s GROUP BY 1), g AS (SELECT term, sum(n)::BIGINT AS n FROM d JOIN k ON d.subject = k.subject GROUP BY term) SELECT term, n, round(10 + 30 * power(5, log10(n / max(n) OVER ())), 4) AS size FROM g", (136, 209, 288))
def subject_cloud(t: Tables) -> DataFrame:
    """Words of subjects weighted by their messages, with font sizes."""
    k = t.turns.groupBy(F.col("text").alias("subject")).agg(F.count("*").alias("k"))
    g = k.select("k", F.explode(F.array_distinct(C.subject_tokens(F.col("subject"), ("the", "de")))).alias("term")).groupBy("term").agg(F.sum("k").alias("n"))
    top = g.agg(F.max("n").alias("top"))
    return g.join(F.broadcast(top)).select("term", "n", F.round(C.font_size(F.col("n"), F.col("top")), 4).alias("size"))


_TERMS = f"WITH {_counts_sql('conversations', 'role')}, n AS (SELECT term, sum(tf)::BIGINT AS n FROM c GROUP BY term), top AS (SELECT term FROM n ORDER BY n DESC, term LIMIT 50), e AS (SELECT key AS from_id, c.term AS to_term, sum(tf)::BIGINT AS weight FROM c JOIN top ON top.term = c.term GROUP BY 1, 2)"


def _interest(t: Tables) -> DataFrame:
    c = X.term_counts(t.turns, "author", "text")
    return X.two_mode_edges(c, "author", X.frequent_terms(c, 1.0))


@query("interest_network", f"{_TERMS} SELECT * FROM e", (36, 289))
def interest_network(t: Tables) -> DataFrame:
    """Who uses which frequent terms how often."""
    return _interest(t)


@query("interest_vertices", f"{_TERMS} SELECT from_id AS name, count(*) AS degree, 0 AS type FROM e GROUP BY 1 UNION ALL SELECT to_term, count(*), 1 FROM e GROUP BY 1", (36, 67, 289))
def interest_vertices(t: Tables) -> DataFrame:
    """Vertices of the person-term network."""
    return X.two_mode_vertices(_interest(t))


@query("two_mode_threshold", "WITH e AS (SELECT conv_id, max(length(text)) AS w FROM conversations GROUP BY 1), g AS (SELECT x, (SELECT count(*) FROM e WHERE w >= x) AS persons FROM (VALUES (100.0), (200.0), (400.0), (800.0)) v(x)) SELECT CAST(x AS DOUBLE) AS threshold, persons FROM g ORDER BY abs(persons - 30), x LIMIT 1", (290,))
def two_mode_threshold(t: Tables) -> DataFrame:
    """The threshold at which about thirty persons are left."""
    e = t.turns.select(F.col("thread").alias("from_id"), F.length("text").alias("weight"))
    return X.best_threshold(e, [100.0, 200.0, 400.0, 800.0], 30)


@query("network_similarity", """
WITH a AS (SELECT l_suppkey AS f, l_linenumber AS t, count(*) AS x FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT l_suppkey AS f, l_linenumber AS t, count(*) AS y FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT round(sum(coalesce(x, 0) * coalesce(y, 0)) / sqrt(sum(coalesce(x, 0) * coalesce(x, 0)) * sum(coalesce(y, 0) * coalesce(y, 0))), 6) AS similarity FROM a FULL JOIN b ON a.f = b.f AND a.t = b.t""", (291,))
def network_similarity(t: Tables) -> DataFrame:
    """Cosine of two networks."""
    e = lambda k: t.dependencies.where(f"commit_id % 2 = {k}").groupBy(F.col("file").alias("from_id"), F.col("line").alias("to_id")).agg(F.count("*").alias("weight"))
    return X.matrix_similarity(e(0), e(1)).withColumn("similarity", F.round("similarity", 6))


_IR = """
WITH m AS (SELECT l_orderkey AS thread, l_suppkey AS author, row_number() OVER w AS r, first_value(l_suppkey) OVER w AS starter FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
o AS (SELECT author, count(*) FILTER (WHERE r = 1) AS initiations, count(*) FILTER (WHERE r > 1) AS responses FROM m GROUP BY 1), g AS (SELECT starter, count(*) AS received FROM m WHERE r > 1 AND author <> starter GROUP BY 1), j AS (SELECT author, initiations, responses, coalesce(received, 0) AS received FROM o LEFT JOIN g ON starter = author)
SELECT author, initiations, responses, received, round((responses + received) / max(responses + received) OVER (), 6) AS degree, CASE WHEN (responses + received) / max(responses + received) OVER () > 0.3 THEN 'High' ELSE 'Low' END AS class FROM j"""


@query("initiations_responses", _IR, (68, 292))
def initiations_responses(t: Tables) -> DataFrame:
    """Threads started and answered by each author."""
    m = t.mails.groupBy("thread", "number").agg(F.min("author").alias("author"))
    return X.initiations(m).withColumn("degree", F.round("degree", 6))


@query("cosine_coupling", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3", (296,))
def cosine_coupling(t: Tables) -> DataFrame:
    """Pairs of a label whose vectors are close."""
    return X.cosine_pairs(t.embeddings, "vec_id", "embedding", 0.3, "label").withColumn("cosine", F.round("cosine", 5))


@query("tfidf_coupling", f"""
WITH {_counts_sql('benchmark', 'item_id')}, n AS (SELECT count(DISTINCT key) AS n FROM c), d AS (SELECT term, log2(n / count(*)) AS w FROM c, n GROUP BY term, n HAVING count(*) > 1 AND count(*) <= 0.95 * n), v AS (SELECT key, c.term, w FROM c JOIN d ON c.term = d.term), l AS (SELECT key, sqrt(sum(w * w)) AS l FROM v GROUP BY key),
p AS (SELECT x.key AS a, y.key AS b, sum(x.w * x.w) AS dot FROM v x JOIN v y ON x.term = y.term AND x.key < y.key GROUP BY 1, 2)
SELECT a, b, round(dot / (x.l * y.l), 6) AS cosine FROM p JOIN l x ON x.key = a JOIN l y ON y.key = b WHERE dot / (x.l * y.l) >= 0.2""", (296,))
def tfidf_coupling(t: Tables) -> DataFrame:
    """Benchmark items with common terms."""
    return X.tfidf_coupling(X.term_counts(t.benchmark, "item_id", "text"), "item_id", 0.2).withColumn("cosine", F.round("cosine", 6))


@query("lsa_coupling", None, (296,))
def lsa_coupling(t: Tables) -> DataFrame:
    """Benchmark items close in a latent space."""
    return X.lsa_coupling(X.term_counts(t.benchmark, "item_id", "text").withColumn("release", F.lit(1)), "release", "item_id", 10, 0.5)


# ---------------------------------------------------------------- scalar functions
@query("corrective_flag", "SELECT doc_id, regexp_matches(lower(text), 'bug|fix|error|fail') AS corrective FROM documents", (197,))
def corrective_flag(t: Tables) -> DataFrame:
    """Texts that speak of errors."""
    return t.documents.select("doc_id", C.is_corrective(F.col("text")).alias("corrective"))


@query("offset_minutes", "SELECT event_id AS id, CAST(60 * trunc(o / 100) + o % 100 AS INT) AS minutes FROM (SELECT event_id, CAST(event_id % 2400 - 1200 AS INT) AS o FROM events)", (195,))
def offset_minutes(t: Tables) -> DataFrame:
    """Signed offsets in minutes."""
    return t.events.select(F.col("event_id").alias("id"), C.offset_minutes((F.col("event_id") % 2400 - 1200).cast("int")).alias("minutes"))


@query("epoch_conversions", "SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AS TIMESTAMP) AS back FROM events", (194,))
def epoch_conversions(t: Tables) -> DataFrame:
    """Times as seconds and back."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.events.select(F.col("event_id").alias("id"), s.alias("seconds"), F.timestamp_seconds(s).cast("timestamp_ntz").alias("back"))


@query("log_transforms", "SELECT event_id AS id, round(CASE WHEN value - 5 > 0 THEN ln(value - 5) ELSE 0 END, 6) AS l FROM events", (198,))
def log_transforms(t: Tables) -> DataFrame:
    """Logarithms, 0 for what has none."""
    return t.events.select(F.col("event_id").alias("id"), F.round(C.safe_log(F.col("value") - 5), 6).alias("l"))


@query("date_parts", "SELECT event_id AS id, year(ts) AS year, hour(ts) AS hour, dayofweek(ts) + 1 AS wday, isodow(ts) - 1 AS weekday FROM events", (199,))
def date_parts(t: Tables) -> DataFrame:
    """Parts of times."""
    return t.events.select(F.col("event_id").alias("id"), *[f("ts").cast("bigint").alias(n) for n, f in (("year", F.year), ("hour", F.hour), ("wday", F.dayofweek), ("weekday", F.weekday))])


@query("path_labels", "SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '--' || left(md5(CAST(o_custkey AS VARCHAR)), 6) || '-' || left(md5(CAST(o_orderkey AS VARCHAR)), 6) AS label FROM orders", (200,))
def path_labels(t: Tables) -> DataFrame:
    """Labels of ranges from number and hashes."""
    h = lambda c: F.md5(F.col(c).cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("id"), C.short_hash_label(F.col("o_orderkey") % 1000, h("o_custkey"), h("o_orderkey")).alias("label"))


@query("identifier_split", "SELECT p_partkey AS id, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(p_brand || 'HTTPName' || replace(p_name, ' ', '_'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_'), lambda x: x <> ''), ' ') AS words FROM (SELECT p_partkey, replace(p_brand, '#', '_') AS p_brand, p_name FROM part)".replace("'HTTPName'", "'_http_Name_'"), (201,))
def identifier_split(t: Tables) -> DataFrame:
    """Words of identifiers."""
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_http_Name_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(C.split_identifier(name), " ").alias("words"))


@query("degree_class", "SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_discount * 8 >= 0.5 THEN 'High' WHEN l_discount * 8 > 0.25 THEN 'Medium' ELSE 'Low' END AS class FROM lineitem", (208,))
def degree_class(t: Tables) -> DataFrame:
    """Classes of degrees."""
    return t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), C.degree_class(F.col("l_discount") * 8).alias("class"))


@query("figures_of_merit", """
WITH g AS (SELECT event_type AS subsys, count(*) AS n, count(DISTINCT user_id) AS a, avg(value) AS v FROM events GROUP BY 1), s AS (SELECT subsys, CASE WHEN n <= 1000 THEN 2 WHEN n <= 2000 THEN 1 ELSE 0 END AS c, CASE WHEN v >= 21 THEN 2 WHEN v >= 20 THEN 1 ELSE 0 END AS x FROM g)
SELECT subsys, ['good', 'warn', 'bad'][c + 1] AS collaboration, ['good', 'warn', 'bad'][x + 1] AS complexity, ['good', 'warn', 'bad'][CAST(round_even((c + x) / 2.0, 0) AS INT) + 1] AS overall FROM s""", (206, 207))
def figures_of_merit(t: Tables) -> DataFrame:
    """States of collaboration and complexity of each subsystem and their mean."""
    g = t.changes.groupBy("subsys").agg(F.count("*").alias("n"), F.avg("diff_size").alias("v"))
    c, x = C.status_of(F.col("n"), 2000, 1000, rising=False), C.status_of(F.col("v"), 20, 21)
    return g.select("subsys", c.alias("collaboration"), x.alias("complexity"), C.combined_status(c, x).alias("overall"))


@query("artifact_ratios", "WITH g AS (SELECT l_partkey AS entity, count(*) FILTER (WHERE l_returnflag = 'A') AS m, count(*) FILTER (WHERE l_returnflag = 'N') AS a, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY 1) SELECT entity, round(abs(m - a) / nullif(m + a, 0), 6) AS percent_diff, round((m - a) / nullif(m + a, 0), 6) AS signed_diff, round(m / nullif(a, 0), 6) AS ratio, round(m / d, 6) AS per_dev FROM g", (205,))
def artifact_ratios(t: Tables) -> DataFrame:
    """Ratios of motifs to anti-motifs of each entity."""
    g = t.dependencies.groupBy("entity").agg(F.count_if(F.col("flag") == "A").alias("m"), F.count_if(F.col("flag") == "N").alias("a"), F.countDistinct("file").alias("d"))
    m, a = F.col("m"), F.col("a")
    r = lambda x, y: F.round(F.try_divide(x, y), 6)
    return g.select("entity", r(F.abs(m - a), m + a).alias("percent_diff"), r(m - a, m + a).alias("signed_diff"), r(m, a).alias("ratio"), r(m, F.col("d")).alias("per_dev"))


@query("subsystem_similarity", """
WITH f AS (SELECT user_id % 50 AS team, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id % 50) AS p FROM events GROUP BY 1, 2), j AS (SELECT a.team AS a, b.team AS b, sum(a.p + b.p) / (2 * count(*)) AS s FROM f a JOIN f b ON a.event_type = b.event_type AND a.team < b.team GROUP BY 1, 2) SELECT a, b, round(s, 6) AS similarity FROM j""", (202, 203))
def subsystem_similarity(t: Tables) -> DataFrame:
    """Similarity of fifty teams, to which all authors are dealt by their numbers, by their subsystems."""
    g = t.changes.groupBy((F.col("author") % 50).alias("author"), "subsys").agg(F.count("*").alias("n"))
    total = g.groupBy("author").agg(F.sum("n").alias("s"))
    m = g.join(total, "author").groupBy("author").agg(F.map_from_entries(F.collect_list(F.struct("subsys", (F.col("n") / F.col("s")).alias("p")))).alias("m"))
    j = m.select(F.col("author").alias("a"), F.col("m").alias("x")).join(m.select(F.col("author").alias("b"), F.col("m").alias("y"))).where("a < b")
    return j.select("a", "b", F.round(C.author_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("interleave", "SELECT user_id AS id, array_to_string([min(event_id), max(event_id), min(event_id) + 1, max(event_id) + 1], ',') AS s FROM events GROUP BY 1", (210,))
def interleave(t: Tables) -> DataFrame:
    """Two lists dealt into one."""
    g = t.events.groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    s = C.interleave(F.array("lo", F.col("lo") + 1), F.array("hi", F.col("hi") + 1))
    return g.select("id", F.array_join(s.cast("array<string>"), ",").alias("s"))


@query("json_properties", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", (212,))
def json_properties(t: Tables) -> DataFrame:
    """A field of JSON texts."""
    return t.events.select(F.col("event_id").alias("id"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("zone_names", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'Europe/Berlin;Africa/Lagos' WHEN event_id % 3 = 1 THEN 'Asia/Tokyo' ELSE 'America/New_York' END AS zones FROM events", (128, 196))
def zone_names(t: Tables) -> DataFrame:
    """Zones whose offset fits, in winter."""
    minutes = F.when(F.col("event_id") % 3 == 0, 60).when(F.col("event_id") % 3 == 1, 540).otherwise(-300)
    z = C.zones_of_offset(t.events.select("event_id", "ts", minutes.alias("m")), "ts", "m", ["Europe/Berlin", "Asia/Tokyo", "America/New_York", "Africa/Lagos"])
    return z.select(F.col("event_id").alias("id"), "zones")


@query("author_repair", "SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@host.org' AS email, c_name AS name FROM (SELECT c_custkey, c_name FROM customer)", (189, 190, 191))
def author_repair(t: Tables) -> DataFrame:
    """Names and addresses of garbled headers."""
    local = F.replace("c_name", F.lit("#"), F.lit("."))
    header = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), F.col("c_name"), F.lit('" <'), local, F.lit(" at host.org>"))).otherwise(F.concat(local, F.lit("@host.org ("), F.col("c_name"), F.lit(")")))
    r = C.repair_author(header)
    return t.customer.select(F.col("c_custkey").alias("id"), r["email"].alias("email"), r["name"].alias("name"))


@query("mail_dates", "SELECT event_id AS id, CAST(date_trunc('second', ts) AS TIMESTAMP) - to_minutes(CASE WHEN event_id % 2 = 0 THEN 90 ELSE 0 END) AS utc, CASE WHEN event_id % 2 = 0 THEN 130 ELSE 0 END AS zone FROM events", (192, 193))
def mail_dates(t: Tables) -> DataFrame:
    """Dates of mails in several forms as instants."""
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0130 (XYZ)"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    d = C.parse_date(text)
    return t.events.select(F.col("event_id").alias("id"), d["utc"].alias("utc"), d["offset"].alias("zone"))


@query("date_fallback", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '1970-01-01' ELSE ts END AS tm FROM events", (295,))
def date_fallback(t: Tables) -> DataFrame:
    """Missing dates as the start of the epoch."""
    return t.events.select(F.col("event_id").alias("id"), C.date_or_epoch(F.when(F.col("event_id") % 4 != 0, F.col("ts"))).alias("tm"))


@query("revealed_addresses", "SELECT s_suppkey AS id, 'dev' || s_suppkey || '@host.org' AS email FROM supplier", (27,))
def revealed_addresses(t: Tables) -> DataFrame:
    """Spelled-out addresses."""
    return t.supplier.select(F.col("s_suppkey").alias("id"), C.reveal_address(F.concat(F.lit("dev"), F.col("s_suppkey").cast("string"), F.lit(" at host dot org"))).alias("email"))


# ---------------------------------------------------------------- parsers
@query("git_log_source", "SELECT md5(CAST(o_orderkey AS VARCHAR)) AS hash, CAST(o_orderdate AS TIMESTAMP) AS commit_date, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 1 HOUR AS author_date FROM orders", (4, 26))
def git_log_source(t: Tables) -> DataFrame:
    """Commits of log lines."""
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    lines = t.orders.select(F.concat_ws(" ", s.cast("string"), F.md5(F.col("o_orderkey").cast("string")), (s - 3600).cast("string")).alias("value"))
    return P.git_log(lines)


@query("shortstat_parser", "SELECT o_orderkey AS id, CAST(o_orderkey % 9 + 1 AS INT) AS files, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS INT) AS added, CAST(o_orderkey % 100 AS INT) AS deleted FROM orders", (5,))
def shortstat_parser(t: Tables) -> DataFrame:
    """Sizes of commits from their last lines."""
    n = F.col("o_orderkey") % 9 + 1
    text = F.concat(F.lit(" "), n.cast("string"), F.when(n == 1, " file changed").otherwise(" files changed"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(", "), F.col("o_custkey").cast("string"), F.lit(" insertions(+)"))).otherwise(""), F.lit(", "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" deletions(-)"))
    s = P.shortstat(text)
    return t.orders.select(F.col("o_orderkey").alias("id"), s["files"].alias("files"), s["added"].alias("added"), s["deleted"].alias("deleted"))


@query("commit_message_parser", "SELECT o_orderkey AS id, 2 AS lines, CAST(10 + length(o_orderpriority) AS INT) AS bytes, 1 AS signed, CAST(o_orderkey % 3 AS INT) AS acked FROM orders", (6, 219))
def commit_message_parser(t: Tables) -> DataFrame:
    """Lines, bytes and tags of messages."""
    text = F.concat(F.lit("Fix things\n\n"), F.col("o_orderpriority"), F.lit("\nSigned-off-by: A <a@b.c>\n"), F.repeat(F.lit("acked-by: B <b@b.c>\n"), (F.col("o_orderkey") % 3).cast("int")))
    m = P.commit_message(text)
    return t.orders.select(F.col("o_orderkey").alias("id"), m["lines"].alias("lines"), m["bytes"].alias("bytes"), F.size(m["tags"]["Signed-off-by"]).alias("signed"), F.size(m["tags"]["Acked-by"]).alias("acked"))


@query("changed_file_scan", "SELECT DISTINCT 'src/f' || p_size || '.py' AS file FROM part WHERE p_partkey % 3 = 0", (8,))
def changed_file_scan(t: Tables) -> DataFrame:
    """Source files of status lines."""
    lines = t.part.select(F.concat(F.lit("M\tsrc/f"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".py").otherwise(".txt")).alias("value"))
    return P.changed_files(lines)


@query("numstat_scan", "SELECT l_orderkey * 10 + l_linenumber AS seq, 'f' || l_suppkey || '.c' AS file, sum(CAST(l_quantity AS BIGINT) - l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber)::BIGINT AS loc FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)", (9,))
def numstat_scan(t: Tables) -> DataFrame:
    """Running lines of files from numstat rows."""
    d = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("f"), F.min("l_quantity").alias("q"))
    rows = d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.col("q").cast("bigint").cast("string"), F.lit("\t"), F.col("l_linenumber").cast("string"), F.lit("\tf"), F.col("f").cast("string"), F.lit(".c")).alias("stat"))
    return P.numstat(rows).select("seq", "file", "loc")


@query("line_counter_scan", "WITH g AS (SELECT lang, sum(length(text))::BIGINT AS lines FROM documents GROUP BY 1) SELECT lang AS language, lines, round(lines / sum(lines) OVER (), 6) AS fraction FROM g", (17, 150))
def line_counter_scan(t: Tables) -> DataFrame:
    """Languages of a line counter's report."""
    g = t.documents.groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
    lines = g.select(F.concat(F.col("lang"), F.lit(":   "), F.format_number("n", 0), F.lit(" (12.30%)")).alias("value"))
    return P.line_counter(lines).withColumn("fraction", F.round("fraction", 6))


@query("feature_line_sets", """
WITH r AS (SELECT s_suppkey AS file, CAST(s_nationkey + 2 AS INT) AS s, CAST(s_nationkey + 9 AS INT) AS e FROM supplier), x AS (SELECT file, s AS a, e AS b, 'A' AS f, 'A' AS expr, 1 AS d FROM r UNION ALL SELECT file, s + 2, e - 2, 'B', 'B && A', 2 FROM r), l AS (SELECT file, unnest(range(1, 41)) AS line FROM r)
SELECT l.file, CAST(line AS INT) AS line, coalesce(string_agg(f, ';' ORDER BY f), 'Base_Feature') AS features, coalesce(arg_max(expr, d), 'Base_Feature') AS expression FROM l LEFT JOIN x ON l.file = x.file AND line BETWEEN a AND b GROUP BY 1, 2""", (11, 222))
def feature_line_sets(t: Tables) -> DataFrame:
    """Features of lines under nested conditions."""
    s = F.col("s_nationkey").cast("int")
    one = lambda lo, hi, f, e: t.supplier.select(F.col("s_suppkey").alias("file"), (s + lo).alias("start"), (s + hi).alias("end"), F.array(F.lit(f)).alias("features"), F.lit(e).alias("expression"))
    r = one(2, 9, "A", "A").union(one(4, 7, "B", "B && A"))
    found = P.lines_of_features(r, t.supplier.select(F.col("s_suppkey").alias("file"), F.lit(40).alias("last_line")))
    return found.select("file", "line", F.array_join("features", ";").alias("features"), "expression")


@query("issue_export_scan", "SELECT 'PRJ-' || c_custkey AS issue, c_mktsegment AS type, 'r' || c_nationkey AS author FROM customer UNION ALL SELECT 'PRJ-' || c_custkey, c_mktsegment, 'c' || k FROM customer, (VALUES (1), (2)) v(k)", (13, 14))
def issue_export_scan(t: Tables) -> DataFrame:
    """Creations and comments of issue exports."""
    text = F.concat(F.lit("<item><key id='1'>PRJ-"), F.col("c_custkey").cast("string"), F.lit("</key><type id='2'>"), F.col("c_mktsegment"), F.lit("</type><reporter>r"), F.col("c_nationkey").cast("string"), F.lit('</reporter><created>d</created><comments><comment id="1" author="c1" created="x">a</comment><comment id="2" author="c2" created="y">b</comment></comments></item>'))
    return P.issue_comments(t.customer.select(text.alias("value"))).select("issue", "type", "author")


@query("mailbox_scan", "SELECT '<' || conv_id || '.' || turn || '@h>' AS message_id, CASE WHEN turn > 0 THEN '<' || conv_id || '.' || turn - 1 || '@h>' END AS in_reply_to, role AS author, 'hello' AS body FROM conversations", (12, 237, 285))
def mailbox_scan(t: Tables) -> DataFrame:
    """Mails of boxes without quotes and signatures."""
    mid = lambda n: F.concat(F.lit("<"), F.col("thread").cast("string"), F.lit("."), n.cast("string"), F.lit("@h>"))
    n = F.col("number")
    text = F.concat(F.lit("From x y\nFrom: "), F.col("author"), F.lit("\nMessage-ID: "), mid(n), F.when(n > 0, F.concat(F.lit("\nIn-Reply-To: "), mid(n - 1))).otherwise(""), F.lit("\nSubject: s\n\nhello\n> quoted\n-- \nme\n"))
    return P.mailbox(t.turns.select(text.alias("value"))).select("message_id", "in_reply_to", "author", "body")


@query("mail_reply_network", "SELECT a.role AS from_id, b.role AS to_id, count(*) AS weight FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.role <> b.role GROUP BY 1, 2", (237,))
def mail_reply_network(t: Tables) -> DataFrame:
    """Who answers whom, by message ids."""
    mid = lambda n: F.concat_ws(".", "thread", n)
    m = t.turns.select(mid(F.col("number")).alias("message_id"), F.when(F.col("number") > 0, mid(F.col("number") - 1)).alias("in_reply_to"), F.expr("cast(array() AS array<string>)").alias("references"), "author")
    return P.reply_edges(m)


@query("module_dependency_scan", "SELECT 'f' || l_suppkey AS from_id, 'f' || l_linenumber AS to_id, count(*) AS weight FROM lineitem WHERE l_suppkey <> l_linenumber GROUP BY 1, 2", (15, 16))
def module_dependency_scan(t: Tables) -> DataFrame:
    """Dependencies of an export without its folder."""
    g = t.dependencies.groupBy("file", "line").agg(F.count("*").alias("References"))
    rows = g.select(F.concat(F.lit("/tmp/x/f"), F.col("file").cast("string")).alias("From File"), F.concat(F.lit("/tmp/x/f"), F.col("line").cast("string")).alias("To File"), "References")
    return P.module_dependencies(rows, "/tmp/x/")


@query("metrics_melt", "SELECT p_partkey AS id, 'size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part", (18,))
def metrics_melt(t: Tables) -> DataFrame:
    """Metrics of entities, long."""
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("id", ["size", "price"], "variable", "value")


# ---------------------------------------------------------------- identities and stored forms
@query("person_identities", """
WITH RECURSIVE a AS (SELECT c_custkey AS id, 'p' || c_custkey % 300 AS name, 'm' || c_custkey % 450 || '@x.org' AS email FROM customer), e AS (SELECT DISTINCT name AS u, email AS v FROM a UNION SELECT DISTINCT email, name FROM a),
r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), k AS (SELECT u, min(v) AS c FROM r GROUP BY 1), n AS (SELECT c, count(*) AS n FROM a JOIN k ON a.name = k.u GROUP BY c) SELECT id, n FROM a JOIN k ON a.name = k.u JOIN n ON n.c = k.c""", (213, 214, 215))
def person_identities(t: Tables) -> DataFrame:
    """Aliases of the same person, counted."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.lit(1).alias("project"), F.concat(F.lit("p"), (F.col("c_custkey") % 300).cast("string")).alias("name"), F.concat(F.lit("m"), (F.col("c_custkey") % 450).cast("string"), F.lit("@x.org")).alias("email"))
    r = I.resolve_persons(a)
    return r.join(r.groupBy("person").agg(F.count("*").alias("n")), "person").select("id", "n")


@query("get_or_create", "SELECT DISTINCT o_custkey AS person FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)", (30, 33))
def get_or_create(t: Tables) -> DataFrame:
    """Keys that a dimension lacks."""
    return I.get_or_create(t.customer.where("c_nationkey < 10").select(F.col("c_custkey").alias("person")), t.orders.select(F.col("o_custkey").alias("person")), "person").select("person")


@query("adjacency_matrix", "SELECT l_linenumber AS person, " + ", ".join(f"count(*) FILTER (WHERE s_nationkey = {k}) AS \"{k}\"" for k in range(5)) + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 5 GROUP BY 1", (41, 42))
def adjacency_matrix(t: Tables) -> DataFrame:
    """Receivers by senders."""
    e = t.dependencies.join(t.supplier.where("s_nationkey < 5").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("from_id")), "file").groupBy("from_id", F.col("line").alias("to_id")).agg(F.count("*").alias("weight"))
    return S.adjacency_matrix(e, list(range(5)))


@query("stored_communities", "WITH m AS (SELECT s_suppkey AS vertex, s_suppkey % 60 AS community FROM supplier) SELECT community AS cluster, vertex FROM m WHERE community IN (SELECT community FROM m GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT -1, vertex FROM m", (35, 44))
def stored_communities(t: Tables) -> DataFrame:
    """Communities as they are stored."""
    return S.stored_communities(t.supplier.select(F.col("s_suppkey").alias("vertex"), (F.col("s_suppkey") % 60).alias("community")))


@query("graph_exports", "SELECT '  \"' || l_suppkey || '\" -> \"' || l_linenumber || '\" [weight=' || count(*) || '];' AS value FROM lineitem GROUP BY l_suppkey, l_linenumber", (45,))
def graph_exports(t: Tables) -> DataFrame:
    """Lines of a DOT graph."""
    return S.dot_lines(t.dependencies.groupBy(F.col("file").alias("from_id"), F.col("line").alias("to_id")).agg(F.count("*").alias("weight")))


@query("commit_facts", "SELECT o_orderkey AS id, o_custkey AS author, count(DISTINCT l_suppkey) AS changed_files, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 2) AS added, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS deleted, round(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity ELSE 0 END), 2) AS diff_size FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2", (38,))
def commit_facts(t: Tables) -> DataFrame:
    """One row a commit with its sizes."""
    part = lambda *flags: F.round(F.sum(F.when(F.col("flag").isin(*flags), F.col("size")).otherwise(0.0)), 2)
    return t.authored.groupBy(F.col("commit_id").alias("id"), "author").agg(F.countDistinct("file").alias("changed_files"), part("A").alias("added"), part("R").alias("deleted"), part("A", "R").alias("diff_size"))


@query("heaviest_group", "WITH g AS (SELECT o_custkey % 50 AS from_id, l_suppkey AS to_id, l_returnflag AS grp, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) SELECT from_id, to_id, arg_max(grp, (w, grp)) AS \"group\", max(w) AS weight FROM g GROUP BY 1, 2", (41, 123))
def heaviest_group(t: Tables) -> DataFrame:
    """The group of the largest contribution to each edge."""
    g = t.authored.groupBy((F.col("author") % 50).alias("from_id"), F.col("file").alias("to_id"), F.col("flag").alias("group")).agg(F.sum("size").alias("weight"))
    return S.heaviest_group(g)


@query("stream_window_activity", "WITH w AS (SELECT event_type, value, unnest(range(0, 7)) AS k, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events) SELECT day - to_days(CAST(k AS INT)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS lines FROM w GROUP BY 1, 2", (163, 233))
def stream_window_activity(t: Tables) -> DataFrame:
    """The streaming window query over the table as a batch."""
    a = W.windowed_activity(t.events)
    return a.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("lines", 4).alias("lines"))
