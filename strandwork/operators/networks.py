"""Networks of developers and entities, built from commits, lines, mails and rules.

Every function returns directed edges (from_id, to_id, ...) and takes the columns
that separate graphs (a window, a range) as ``graph`` keys, so that one query builds
the networks of all windows.  Self-joins are on entity or thread; entities with one
author are dropped before them, and authors are summed per entity first, so that a
popular entity costs the square of its authors, not of its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import ROWS_A_TASK, dealt


def pairs_within(df: DataFrame, rows: int, keys: list[str]) -> int:
    """How many pairs the rows of equal ``keys`` make; of few rows, their number at most is not looked up."""
    if rows <= ROWS_A_TASK:
        return rows
    c = dealt(df.select(*keys), rows, *keys).groupBy(*keys).agg(F.count("*").cast("double").alias("_held"))
    return int(c.agg(F.sum(F.col("_held") * (F.col("_held") - 1) / 2)).first()[0] or 0)


def _both(df: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    a = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns])
    return a, df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])


def mail_edges(mails: DataFrame, graph: tuple[str, ...] = ()) -> DataFrame:
    """Edges from the sender of a mail to the senders of strictly earlier mails of its thread; weight counts the pairs."""
    keys = [*graph, "thread"]
    m = mails.select(*keys, "author", "sent")
    rows = m.count()
    a, b = _both(dealt(m, rows, *keys), keys, ["author", "sent"])
    j = a.join(b, keys).where("author_a <> author_b AND sent_a > sent_b").select(*graph, F.col("author_a").alias("from_id"), F.col("author_b").alias("to_id"))
    return dealt(j, pairs_within(m, rows, keys), *graph, "from_id", "to_id").groupBy(*graph, "from_id", "to_id").agg(F.count("*").alias("weight"))


def committer_edges(commits: DataFrame, committer: str = "committer", author: str = "author", graph: tuple[str, ...] = (), rows: int = 0) -> DataFrame:
    """Edges from committer to author, one for each commit; ``rows`` is what is known of their number."""
    e = commits.select(*graph, F.col(committer).alias("from_id"), F.col(author).alias("to_id"))
    return dealt(e, rows, *graph, "from_id", "to_id").groupBy(*graph, "from_id", "to_id").agg(F.count("*").alias("weight"))


def tag_edges(tags: DataFrame, graph: tuple[str, ...] = (), rows: int = 0) -> DataFrame:
    """Edges from tagger to author by kind of tag, from rows (commit_id, author, tagger, tag), of which ``rows`` are known; own tags don't count."""
    e = tags.where("tagger <> author").select(*graph, F.col("tagger").alias("from_id"), F.col("author").alias("to_id"), "tag")
    return dealt(e, rows, *graph, "from_id", "to_id").groupBy(*graph, "from_id", "to_id", "tag").agg(F.count("*").alias("weight"))


def person_edges(changes: DataFrame, graph: tuple[str, ...] = (), rows: int = 0, pairs: int = 0) -> DataFrame:
    """Edges between the authors of an entity in both directions, weight the sum of both sizes over entities.

    ``changes`` has (author, entity, size); ``rows`` and ``pairs`` are what is known of the number of changes and of
    pairs of an entity.  Each author of an entity is sent once, with a list of those after it, and a pair is
    summed once for both directions.
    """
    keys = [*graph, "entity"]
    c = changes.select(*keys, "author", "size").na.drop(subset=[*keys, "author"])
    g = dealt(c, rows, *keys).groupBy(*keys, "author").agg(F.sum("size").alias("size"))
    sets = g.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("author", "size"))).alias("xs")).where("size(xs) > 1")
    each = sets.select(*graph, "xs", F.posexplode(F.expr("slice(xs, 1, size(xs) - 1)")).alias("k", "x")).select(*graph, F.col("x.author").alias("from_id"), F.col("x.size").alias("size"), F.expr("slice(xs, k + 2, size(xs))").alias("ys"))
    each = each.select(*graph, "from_id", "size", F.col("ys.author").alias("others"), F.col("ys.size").alias("sizes"))
    met = dealt(each, pairs // 4, *graph, "from_id")
    met = each.repartition(*graph, "from_id") if met is each else met
    p = met.select(*graph, "from_id", "size", F.explode(F.arrays_zip("others", "sizes")).alias("y"))
    w = p.groupBy(*graph, "from_id", F.col("y.others").alias("to_id")).agg(F.sum(F.col("size") + F.col("y.sizes")).alias("weight"))
    ends = F.array(F.struct("from_id", "to_id"), F.struct(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    return w.select(*graph, "weight", F.explode(ends).alias("e")).select(*graph, "e.from_id", "e.to_id", "weight")


def expand_by_relation(changes: DataFrame, relation: DataFrame) -> DataFrame:
    """Changes seen from each entity and its neighbours: (entity, author, size), by an undirected relation (e1, e2).

    Each entity is its own neighbour; the result feeds ``person_edges`` for one-hop collaboration.
    """
    both = relation.select("e1", "e2").union(relation.select(F.col("e2").alias("e1"), F.col("e1").alias("e2")))
    own = changes.select(F.col("entity").alias("e1"), F.col("entity").alias("e2"))
    near = both.union(own).distinct()
    return changes.withColumnRenamed("entity", "e2").join(near, "e2").select(F.col("e1").alias("entity"), "author", "size")


def proximity_edges(lines: DataFrame, graph: tuple[str, ...] = (), rows: int = 0, pairs: int = 0) -> DataFrame:
    """Edges from the author of a commit to those of commits on the same function, not later; weight is the lines of both.

    ``lines`` has (file, func, commit_id, author, commit_date), one row a line; ``rows`` and ``pairs`` are what is
    known of the number of lines and of pairs of a function.
    """
    keys = [*graph, "file", "func"]
    blocks = dealt(lines, rows, *keys).groupBy(*keys, "commit_id", "author", "commit_date").agg(F.count("*").alias("size"))
    a, b = _both(blocks, keys, ["commit_id", "author", "commit_date", "size"])
    j = a.join(b, keys).where("commit_id_a <> commit_id_b AND author_a <> author_b AND commit_date_b <= commit_date_a")
    e = j.select(*graph, F.col("author_a").alias("from_id"), F.col("author_b").alias("to_id"), (F.col("size_a") + F.col("size_b")).alias("w"))
    return dealt(e, pairs, *graph, "from_id", "to_id").groupBy(*graph, "from_id", "to_id").agg(F.sum("w").alias("weight"))


def feature_edges(lines: DataFrame, graph: tuple[str, ...] = ()) -> DataFrame:
    """Edges in both directions between authors of a feature; weight is the lesser number of lines, summed over features.

    ``lines`` has (feature, author, lines).
    """
    keys = [*graph, "feature"]
    g = lines.groupBy(*keys, "author").agg(F.sum("lines").alias("lines"))
    a, b = _both(g, keys, ["author", "lines"])
    j = a.join(b, keys).where("author_a <> author_b")
    return j.groupBy(*graph, F.col("author_a").alias("from_id"), F.col("author_b").alias("to_id")).agg(F.sum(F.least("lines_a", "lines_b")).alias("weight"))


def code_blocks(lines: DataFrame, keys: list[str], line: str, same: list[str]) -> DataFrame:
    """Runs of consecutive lines with equal ``same`` columns: keys, same, first_line, last_line (gaps and islands)."""
    w = Window.partitionBy(*keys, *same).orderBy(line)
    runs = lines.withColumn("_run", F.col(line) - F.row_number().over(w))
    return runs.groupBy(*keys, *same, "_run").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line")).drop("_run")


def block_strength(blocks: DataFrame, keys: list[str], reach: float, pairs: int = 0) -> DataFrame:
    """Mean strength between the blocks of two authors: 1/2 + cos(pi d / reach) / 2 for a gap d below ``reach``, else 0.

    ``pairs`` is what is known of the number of pairs of blocks.
    """
    a, b = _both(blocks, keys, ["author", "first_line", "last_line"])
    gap = F.greatest(F.col("first_line_b") - F.col("last_line_a"), F.col("first_line_a") - F.col("last_line_b")) - 1
    strength = F.when(gap < reach, 0.5 + F.cos(F.pi() * F.greatest(gap, F.lit(0)) / reach) / 2).otherwise(0.0)
    j = a.join(b, keys).where("author_a < author_b").select(F.col("author_a").alias("from_id"), F.col("author_b").alias("to_id"), strength.alias("strength"))
    return dealt(j, pairs, "from_id", "to_id").groupBy("from_id", "to_id").agg(F.avg("strength").alias("weight"))


def co_changes(changes: DataFrame, least: int, most_entities: int = 20, graph: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of entities changed by the same commits: e1 < e2 and n, at least ``least`` commits.

    Commits with more than ``most_entities`` entities are left out, which bounds the self-join.
    """
    k = changes.select(*graph, F.col("commit_id").alias("c"), F.col("entity").alias("e"))
    rows = k.count()
    pairs = pairs_within(k, rows, [*graph, "c"])
    k = dealt(k, rows, *graph, "c").distinct()
    few = k.groupBy(*graph, "c").agg(F.count("*").alias("m")).where(F.col("m").between(2, most_entities)).select(*graph, "c")
    k = k.join(few, [*graph, "c"], "left_semi")
    a, b = _both(k, [*graph, "c"], ["e"])
    j = a.join(b, [*graph, "c"]).where("e_a < e_b").select(*graph, F.col("e_a").alias("e1"), F.col("e_b").alias("e2"))
    return dealt(j, pairs, *graph, "e1", "e2").groupBy(*graph, "e1", "e2").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def association_rules(changes: DataFrame, least: int, confidence: float = 0.5) -> DataFrame:
    """Rules e1 => e2 between single entities with support count, confidence and lift."""
    pairs = co_changes(changes, least)
    k = changes.select("commit_id", "entity").distinct()
    single = k.groupBy("entity").agg(F.count("*").alias("m"))
    total = k.agg(F.countDistinct("commit_id").alias("commits"))
    both = pairs.union(pairs.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"), "n"))
    j = both.join(single.withColumnRenamed("entity", "e1").withColumnRenamed("m", "m1"), "e1").join(single.withColumnRenamed("entity", "e2").withColumnRenamed("m", "m2"), "e2").join(F.broadcast(total))
    j = j.withColumns({"confidence": F.col("n") / F.col("m1"), "lift": F.col("n") * F.col("commits") / (F.col("m1") * F.col("m2"))})
    return j.where(F.col("confidence") >= confidence).select("e1", "e2", "n", "confidence", "lift")


def rule_queries(changes: DataFrame) -> DataFrame:
    """Queries of a test history: for each commit and entity the entities to be found besides (navigation): commit_id, query, expected."""
    k = changes.select("commit_id", "entity").distinct()
    sets = k.groupBy("commit_id").agg(F.sort_array(F.collect_set("entity")).alias("items")).where("size(items) BETWEEN 2 AND 20")
    return sets.select("commit_id", F.explode("items").alias("query"), "items").withColumn("expected", F.array_remove("items", F.col("query"))).drop("items")


def evaluate_rules(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Precision and recall of each query: found entities are the consequents of rules on it; null precision where nothing is found."""
    found = rules.groupBy(F.col("e1").alias("query")).agg(F.collect_set("e2").alias("found"))
    j = queries.join(found, "query", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() AS array<bigint>)")))
    hits = F.size(F.array_intersect("found", "expected"))
    return j.select("commit_id", "query", F.size("found").cast("bigint").alias("n_found"), F.try_divide(hits, F.size("found")).alias("precision"), F.try_divide(hits, F.size("expected")).alias("recall"))


def _reached(changes: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of commits with 2 to 20 entities (commit_id, entity), and what rules on them name: (commit_id, entity, by, only, inside)."""
    k = changes.select("commit_id", "entity").distinct()
    sizes = k.groupBy("commit_id").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 20").select("commit_id")
    k = k.join(sizes, "commit_id")
    named = k.join(rules.select(F.col("e1").alias("entity"), "e2"), "entity").groupBy("commit_id", F.col("e2").alias("entity")).agg(F.count("*").alias("by"), F.min("entity").alias("only"))
    return k, named.join(k.withColumn("inside", F.lit(True)), ["commit_id", "entity"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def evaluate_prevention(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """For each entity of a commit, whether rules on the other ones name it: (commit_id, missing, n_found, precision, recall).

    What is found without an entity is all that is named from the commit, but for what that entity alone names.
    """
    k, r = _reached(changes, rules)
    outside = r.where("NOT inside").groupBy("commit_id").agg(F.count("*").alias("all"))
    alone = r.where("NOT inside AND by = 1").groupBy("commit_id", F.col("only").alias("entity")).agg(F.count("*").alias("alone"))
    hit = r.where("inside").select("commit_id", "entity", F.lit(1).alias("hit"))
    j = k.join(outside, "commit_id", "left").join(alone, ["commit_id", "entity"], "left").join(hit, ["commit_id", "entity"], "left").na.fill(0, ["all", "alone", "hit"])
    found = F.col("all") - F.col("alone") + F.col("hit")
    return j.select("commit_id", F.col("entity").alias("missing"), found.alias("n_found"), F.try_divide(F.col("hit").cast("double"), found).alias("precision"), F.col("hit").cast("double").alias("recall"))


def evaluate_closure(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """For each whole commit, of which nothing is missing, what rules name besides: (commit_id, n_found, correct)."""
    k, r = _reached(changes, rules)
    found = r.where("NOT inside").groupBy("commit_id").agg(F.count("*").alias("n_found"))
    return k.select("commit_id").distinct().join(found, "commit_id", "left").select("commit_id", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.col("n_found").isNull().alias("correct"))


def random_blocks(blocks: DataFrame, keys: list[str], length: str, seed: int = 448) -> DataFrame:
    """A control with the same blocks placed at random in a file of ``length`` lines: first_line and last_line by a seeded hash.

    The place depends on the block alone, so it is the same in every run and partitioning.
    """
    size = F.col("last_line") - F.col("first_line") + 1
    room = F.greatest(F.lit(1), F.col(length) - size + 1)
    first = F.pmod(F.xxhash64(F.lit(seed), *keys, "author", "first_line"), room) + 1
    return blocks.withColumns({"first_line": first, "last_line": first + size - 1})
