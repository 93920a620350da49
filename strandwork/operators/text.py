"""Terms of texts: counts, frequent terms, person-term networks, coupling of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import joined, written

#: Vectors in a part of a block, of which two at a time are multiplied.
PART = 2048

# Stemmed terms that are left out of frequent terms, by list.
EXCLUDED_TERMS = {
    "c": ("int", "void", "double", "long", "const", "return", "function", "char", "struct", "includ", "class", "templat", "type", "static", "array"),
    "programming": ("code", "patch", "sourc", "compil", "build", "file", "check", "call", "declar", "line", "argument", "version", "foo"),
    "conversation": ("pleas", "thank", "cheer", "instead", "look", "base", "add", "follow", "tri", "note", "use", "project"),
}


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]+)"), 1)


def term_counts(docs: DataFrame, key: str, text: str, least_length: int = 1) -> DataFrame:
    """(key, term, tf) of all documents; counted within the map side first."""
    t = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).where(F.length("term") >= least_length)
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"))


def frequent_terms(counts: DataFrame, share: float = 0.1, most: int = 50, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent ``share`` of terms, at most ``most``: (term, n), ties by term; terms of the named lists don't count."""
    unwanted = [x for name in exclude for x in EXCLUDED_TERMS[name]]
    t = counts.where(~F.col("term").isin(unwanted)) if unwanted else counts
    t = t.groupBy("term").agg(F.sum("tf").alias("n"))
    limit = t.agg(F.least(F.floor(F.count("*") * share), F.lit(most)).alias("k"))
    top = t.orderBy(F.desc("n"), "term").limit(most)
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "term")))
    return ranked.join(F.broadcast(limit)).where("r <= k").select("term", "n")


def two_mode_edges(counts: DataFrame, person: str, terms: DataFrame) -> DataFrame:
    """Person-term edges for chosen terms: (from_id, to_term, weight)."""
    return counts.join(terms.select("term"), "term", "left_semi").groupBy(F.col(person).alias("from_id"), F.col("term").alias("to_term")).agg(F.sum("tf").alias("weight"))


def two_mode_vertices(edges: DataFrame) -> DataFrame:
    """Vertices of a person-term graph with degree: type 0 is a person, 1 a term."""
    p = edges.groupBy(F.col("from_id").cast("string").alias("name")).agg(F.count("*").alias("degree")).withColumn("type", F.lit(0))
    return p.union(edges.groupBy(F.col("to_term").alias("name")).agg(F.count("*").alias("degree")).withColumn("type", F.lit(1)))


def best_threshold(edges: DataFrame, grid: list[float], wanted: int) -> DataFrame:
    """The weight of a literal grid at which the number of persons is nearest to ``wanted``: (threshold, persons)."""
    e = edges.groupBy("from_id").agg(F.max("weight").alias("w"))
    n = e.agg(*[F.count_if(F.col("w") >= x).alias(f"n{k}") for k, x in enumerate(grid)])
    long = n.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"n{k}").alias("persons")) for k, x in enumerate(grid)])).alias("x")).select("x.*")
    return long.orderBy(F.abs(F.col("persons") - wanted), "threshold").limit(1)


def matrix_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of two weighted edge sets: sum(ab) / sqrt(sum(a^2) sum(b^2)), 0-filled outside."""
    j = a.select("from_id", "to_id", F.col("weight").alias("x")).join(b.select("from_id", "to_id", F.col("weight").alias("y")), ["from_id", "to_id"], "full").na.fill(0, ["x", "y"])
    return j.agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("similarity"))


def initiations(mails: DataFrame) -> DataFrame:
    """Per author: threads started, replies given, replies received to started threads, and the class of the normalised degree."""
    w = Window.partitionBy("thread").orderBy("number")
    m = mails.select("thread", "number", "author").withColumns({"r": F.row_number().over(w), "starter": F.first("author").over(w)})
    own = m.groupBy("author").agg(F.count_if(F.col("r") == 1).alias("initiations"), F.count_if(F.col("r") > 1).alias("responses"))
    got = m.where("r > 1 AND author <> starter").groupBy(F.col("starter").alias("author")).agg(F.count("*").alias("received"))
    j = own.join(got, "author", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    top = j.agg(F.max(F.col("responses") + F.col("received")).alias("top"))
    return j.join(F.broadcast(top)).withColumn("degree", F.try_divide(F.col("responses") + F.col("received"), "top")).withColumn("class", F.when(F.col("degree") > 0.3, "High").otherwise("Low")).drop("top")


def cosine_pairs(vectors: DataFrame, key: str, vector: str, least: float, block: str) -> DataFrame:
    """Pairs of the same ``block`` whose dense vectors have cosine ``least`` or more: (a, b, cosine), a < b.

    All pairs are looked at: a block is dealt to parts of about ``PART`` vectors, and a task has the product of two parts.
    """
    v = vectors.select(F.col(block).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v")).where("g IS NOT NULL AND k IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    size = written(v.groupBy("g").agg(F.ceil(F.count("*") / PART).alias("parts")))
    tasks = int(size.agg(F.sum(F.expr("parts * (parts + 1) / 2"))).first()[0] or 1)
    v = joined(v, v.count(), size, "g").withColumn("p", F.expr("pmod(xxhash64(20, k), parts)"))
    v = v.select("g", "k", "p", F.col("v").cast("array<double>").alias("v"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("r"))
    v = v.select("g", "k", "p", "v", F.least("p", "r").alias("i"), F.greatest("p", "r").alias("j"))
    kinds = dict(vectors.dtypes)

    def couple(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, same in frame.groupby(frame["v"].map(len)):
            one, two = same[same["p"] == i], same[same["p"] == j]
            if one.empty or two.empty:
                continue
            x, y = np.stack(one["v"].to_list()), np.stack(two["v"].to_list())
            norms = np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                c = x @ y.T / norms
            close = (norms != 0) & ~(c < least)
            a, b = one["k"].to_numpy(), two["k"].to_numpy()
            if i == j:
                close &= a[:, None] < b[None]
            at, to = np.nonzero(close)
            out.append((np.minimum(a[at], b[to]), np.maximum(a[at], b[to]), c[at, to]))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pd.DataFrame({"a": a, "b": b, "cosine": c})

    return v.repartition(max(tasks, v.sparkSession.sparkContext.defaultParallelism), "g", "i", "j").groupBy("g", "i", "j").applyInPandas(couple, f"a {kinds[key]}, b {kinds[key]}, cosine double")


def tfidf_coupling(counts: DataFrame, key: str, least: float, most_df: float = 0.95) -> DataFrame:
    """Pairs of documents whose binary TF x IDF vectors have cosine ``least`` or more: (a, b, cosine).

    Terms in one document only, or in more than a share ``most_df``, are dropped before the self-join on terms.
    """
    total = counts.agg(F.countDistinct(key).alias("docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(total)).where((F.col("df") > 1) & (F.col("df") <= most_df * F.col("docs")))
    w = counts.select(F.col(key).alias("k"), "term").join(df, "term").select("k", "term", F.log2(F.col("docs") / F.col("df")).alias("w"))
    norm = w.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    dot = w.select(F.col("k").alias("a"), "term", "w").join(w.select(F.col("k").alias("b"), "term"), "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    j = dot.join(norm.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(norm.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return j.withColumn("cosine", F.try_divide("dot", F.col("na") * F.col("nb"))).where(F.col("cosine") >= least).select("a", "b", "cosine")


def lsa_coupling(counts: DataFrame, group: str, key: str, rank: int, least: float) -> DataFrame:
    """Pairs of documents of a group whose vectors in a latent space of ``rank`` have cosine ``least`` or more.

    One task decomposes the term matrix of one group (a release), which must fit its memory.
    """

    def couple(frame: pd.DataFrame) -> pd.DataFrame:
        m = (frame.pivot_table(index=key, columns="term", values="tf", fill_value=0) > 0).sort_index()
        x = m.to_numpy(float)
        keep = x.sum(0) <= max(0.95, 1 - 1 / len(x)) * len(x)
        x = x[:, keep] * np.log2(len(x) / np.maximum(x[:, keep].sum(0), 1))
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        z = u[:, :rank] * s[:rank]
        z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        c = z @ z.T
        a, b = np.where(np.triu(c >= least, 1))
        ids = m.index.to_numpy()
        return pd.DataFrame({group: frame[group].iloc[0], "a": ids[a], "b": ids[b], "cosine": c[a, b].round(6)})

    kinds = dict(counts.dtypes)
    return counts.groupBy(group).applyInPandas(couple, f"{group} {kinds[group]}, a {kinds[key]}, b {kinds[key]}, cosine double")
