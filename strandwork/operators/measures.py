"""Further measures of graphs and series: unit edges, diversity, centralisation, cuts, power laws, spectra, recurrence, clusters of blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import dealt


def multi_edges(edges: DataFrame) -> DataFrame:
    """An edge of weight w as w edges of weight one: (from_id, to_id, number) with numbers from 1."""
    return edges.select("from_id", "to_id", F.explode(F.expr("sequence(1, cast(weight AS int))")).alias("number"))


def diversity(edges: DataFrame) -> DataFrame:
    """Entropy of the weights at a vertex over the logarithm of its degree, directions ignored; 0 for one neighbour."""
    ends = edges.where("from_id <> to_id").select(F.col("from_id").alias("vertex"), F.col("to_id").alias("o"), "weight").union(edges.where("from_id <> to_id").select("to_id", "from_id", "weight"))
    w = dealt(ends, 2 * edges.count(), "vertex").groupBy("vertex", "o").agg(F.sum("weight").cast("double").alias("w"))
    g = w.groupBy("vertex").agg(F.count("*").alias("degree"), F.sum("w").alias("s"), F.sum(F.col("w") * F.ln("w")).alias("x"))
    entropy = F.ln("s") - F.col("x") / F.col("s")
    return g.select("vertex", "degree", F.when(F.col("degree") > 1, entropy / F.ln("degree")).otherwise(0.0).alias("diversity"))


def degree_centralization(edges: DataFrame) -> DataFrame:
    """Sum of the distances of all degrees (both directions) from the greatest, over that of a star with as many vertices; one row."""
    ends = edges.where("from_id <> to_id").select(F.explode(F.array("from_id", "to_id")).alias("vertex"))
    d = ends.groupBy("vertex").agg(F.count("*").alias("d")).agg(F.count("*").alias("n"), F.max("d").alias("top"), F.sum("d").alias("s"))
    return d.select("n", F.try_divide(F.col("top") * F.col("n") - F.col("s"), 2 * (F.col("n") - 1) * (F.col("n") - 2)).alias("centralization"))


def component_indices(measures: DataFrame) -> DataFrame:
    """Of path measures by vertex (component, betweenness, closeness, eccentricity, eigenvector), for each component:
    size, diameter, mean length of shortest paths, and the centralisation of each measure against a star."""
    m = measures.groupBy("component").agg(
        F.count("*").alias("size"), F.max("eccentricity").alias("diameter"), F.avg(F.try_divide(F.lit(1.0), "closeness")).alias("mean_path"),
        *[F.max(x).alias(f"top_{x}") for x in ("betweenness", "closeness", "eigenvector")], *[F.sum(x).alias(f"sum_{x}") for x in ("betweenness", "closeness", "eigenvector")],
    )
    n = F.col("size")
    most = {"betweenness": (n - 1) * (n - 1) * (n - 2) / 2, "closeness": (n - 1) * (n - 2) / (2 * n - 3), "eigenvector": n - 2}
    return m.select("component", "size", "diameter", "mean_path", *[F.try_divide(F.col(f"top_{x}") * n - F.col(f"sum_{x}"), y).alias(f"centralization_{x}") for x, y in most.items()])


def _least_cut(m: np.ndarray) -> float:
    """Weight of the least cut of a symmetric matrix, by contraction of the last two vertices of each maximum-adjacency order."""
    m, best = m.copy(), math.inf
    while len(m) > 1:
        added, joined = np.zeros(len(m), bool), np.zeros(len(m))
        before = at = 0
        for _ in range(len(m)):
            before, at = at, int(np.where(added, -1.0, joined).argmax())
            added[at] = True
            last = joined[at]
            joined = joined + m[at]
        best = min(best, last)
        m[before] += m[at]
        m[:, before] += m[:, at]
        m[before, before] = 0
        m = np.delete(np.delete(m, at, 0), at, 1)
    return best


def cuts_of(frame: pd.DataFrame) -> pd.DataFrame:
    """Least cut by weights, and adhesion (least cut by edges), of one connected undirected graph (u, v, w)."""
    order, place = np.unique(frame[["u", "v"]].to_numpy(), return_inverse=True)
    a, b = place.reshape(-1, 2).T
    m = np.zeros((len(order), len(order)))
    np.add.at(m, (a, b), frame["w"].to_numpy())
    m += m.T
    return pd.DataFrame({"size": [len(order)], "min_cut": [_least_cut(m)], "adhesion": [int(_least_cut((m > 0).astype(float)))]})


def _zeta(a: float, q: np.ndarray | float) -> np.ndarray | float:
    """Sum of (q + k) ** -a over k >= 0 by Euler and Maclaurin's formula."""
    q, out = np.asarray(q, float), 0.0
    for k in range(12):
        out = out + (q + k) ** -a
    z = q + 12
    return out + z ** (1 - a) / (a - 1) + z**-a / 2 + a * z ** (-a - 1) / 12 - a * (a + 1) * (a + 2) * z ** (-a - 3) / 720


def _tail_fit(x: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Exponent by maximum likelihood of values x >= x[0] held c times, and the distance of Kolmogorov and Smirnov."""
    n, logs = c.sum(), float((c * np.log(x)).sum())
    cost = lambda a: n * math.log(float(_zeta(a, x[0]))) + a * logs
    low, high, part = 1.0001, 30.0, (math.sqrt(5) - 1) / 2
    for _ in range(80):
        one, two = high - part * (high - low), low + part * (high - low)
        low, high = (low, two) if cost(one) < cost(two) else (one, high)
    alpha = (low + high) / 2
    fitted = 1 - _zeta(alpha, x + 1.0) / _zeta(alpha, x[0])
    return alpha, float(np.abs(np.cumsum(c) / n - fitted).max())


def fit_power_law(values: np.ndarray, counts: np.ndarray, least_tail: int) -> tuple[int, float, int, float, float | None]:
    """(xmin, alpha, tail, distance, p) of positive integers: xmin with the least distance; where fewer than
    ``least_tail`` values are in the tail, xmin is the ``least_tail``-th greatest value; p only for tails as large."""
    order = np.argsort(values)
    x, c = values[order].astype(float), counts[order]
    from_top = np.cumsum(c[::-1])[::-1]
    fits = [(_tail_fit(x[k:], c[k:]), k) for k in range(max(1, len(x) - 1))]
    (alpha, d), k = min(fits, key=lambda f: (f[0][1], f[1]))
    if from_top[k] < least_tail <= from_top[0]:
        k = int(np.flatnonzero(from_top >= least_tail)[-1])
        alpha, d = _tail_fit(x[k:], c[k:])
    n = int(from_top[k])
    reach = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * reach * reach) for j in range(1, 101)))) if reach > 0.2 else 1.0
    return int(x[k]), alpha, n, d, p if n >= least_tail else None


def power_law_fit(df: DataFrame, keys: list[str], value: str, least_tail: int = 30) -> DataFrame:
    """A discrete power law for each key (keys, xmin, alpha, n_tail, ks, ks_p); what reaches a task is the number of each distinct value."""
    counted = df.where(F.col(value) > 0).groupBy(*keys, F.col(value).cast("bigint").alias("_x")).agg(F.count("*").alias("_c"))
    fields = [f for f in counted.schema.fields if f.name in keys]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        xmin, alpha, n, d, p = fit_power_law(frame["_x"].to_numpy(), frame["_c"].to_numpy(), least_tail)
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "xmin": [xmin], "alpha": [round(alpha, 6)], "n_tail": [n], "ks": [round(d, 6)], "ks_p": [None if p is None else round(p, 6)]})

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return counted.groupBy(*keys).applyInPandas(fit, names + ", xmin bigint, alpha double, n_tail bigint, ks double, ks_p double")


def spectrum(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Periodogram of each series about its mean: (keys, frequency 1 to n / 2, power)."""
    w = Window.partitionBy(*keys)
    s = series.select(*keys, (F.col(value) - F.avg(value).over(w)).alias("x"), (F.row_number().over(w.orderBy(order)) - 1).alias("t"), F.count("*").over(w).alias("n"))
    each = s.where("n > 1").select("*", F.explode(F.expr("sequence(1L, n div 2)")).alias("frequency"))
    turn = F.lit(2 * math.pi) * F.col("frequency") * F.col("t") / F.col("n")
    g = each.groupBy(*keys, "frequency").agg(F.sum(F.col("x") * F.cos(turn)).alias("a"), F.sum(F.col("x") * F.sin(turn)).alias("b"), F.first("n").alias("n"))
    return g.select(*keys, "frequency", ((F.col("a") * F.col("a") + F.col("b") * F.col("b")) / F.col("n")).alias("power"))


def recurrence(series: DataFrame, keys: list[str], order: str, value: str, part: float = 0.1) -> DataFrame:
    """Share of pairs, ``lag`` steps apart, whose values differ by at most ``part`` of the series' range: (keys, lag, pairs, recurrent).

    The series of a key is short (release cycles); its pairs are the plot itself.
    """
    w = Window.partitionBy(*keys)
    s = series.select(*keys, F.row_number().over(w.orderBy(order)).alias("t"), F.col(value).alias("x"), (part * (F.max(value).over(w) - F.min(value).over(w))).alias("near"))
    j = s.join(s.select(*keys, F.col("t").alias("t2"), F.col("x").alias("x2")), keys).where("t < t2")
    return j.groupBy(*keys, (F.col("t2") - F.col("t")).alias("lag")).agg(F.count("*").alias("pairs"), F.count_if(F.abs(F.col("x") - F.col("x2")) <= F.col("near")).alias("recurrent"))


def _gap(block: str, x: str) -> str:
    return f"(IF({block}.first_line > {x}.last_line, {block}.first_line - {x}.last_line, {x}.first_line - {block}.last_line) - 1)"


def block_clusters(blocks: DataFrame, keys: list[str], own: Column, reach: int) -> DataFrame:
    """Clusters of the blocks of one commit in each file: (keys, first_line, last_line, own, cluster from 1); files without such a block have none.

    A block of the commit starts a cluster where it is more than ``reach`` lines after the first block of the
    one before.  Other blocks, in order, stay with the cluster at hand unless the next one's first or last
    own block is nearer, in which case that one is at hand from there on.
    """
    kept = blocks.select(*keys, "first_line", "last_line", own.alias("own"))
    files = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line", "own"))).alias("all"))
    block = "struct<first_line:bigint,last_line:bigint>"
    plain = "named_struct('first_line', cast(x.first_line AS bigint), 'last_line', cast(x.last_line AS bigint))"
    last = "element_at(acc, -1)"
    grown = f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('head', {last}.head, 'tail', {plain}, 'members', concat({last}.members, array({plain})))))"
    fresh = f"concat(acc, array(named_struct('head', {plain}, 'tail', {plain}, 'members', array({plain}))))"
    folded = f"aggregate(filter(all, x -> x.own), cast(array() AS array<struct<head:{block},tail:{block},members:array<{block}>>>), (acc, x) -> IF(size(acc) > 0 AND {_gap(last + '.head', 'x')} <= {reach}, {grown}, {fresh}))"
    files = files.withColumn("c", F.expr(folded)).where("size(c) > 0")
    near = lambda k: f"least({_gap(f'element_at(c, {k}).head', 'x')}, {_gap(f'element_at(c, {k}).tail', 'x')})"
    step = f"IF(acc.at < size(c) AND {near('acc.at')} > {near('least(acc.at + 1, size(c))')}, acc.at + 1, acc.at)"
    placed = f"named_struct('first_line', cast(x.first_line AS bigint), 'last_line', cast(x.last_line AS bigint), 'own', false, 'cluster', {step})"
    others = f"aggregate(filter(all, x -> NOT x.own), named_struct('at', 1, 'out', cast(array() AS array<struct<first_line:bigint,last_line:bigint,own:boolean,cluster:int>>)), (acc, x) -> named_struct('at', {step}, 'out', concat(acc.out, array({placed}))), acc -> acc.out)"
    mine = "flatten(transform(c, (y, k) -> transform(y.members, m -> named_struct('first_line', m.first_line, 'last_line', m.last_line, 'own', true, 'cluster', k + 1))))"
    return files.select(*keys, F.explode(F.expr(f"concat({mine}, {others})")).alias("b")).select(*keys, "b.*")


def classes_by_degree(edges: DataFrame, graph: tuple[str, ...], quantile: float = 0.8) -> DataFrame:
    """(graph, vertex, degree, class) of many networks at once: core above the quantile of the degrees of both directions."""
    ends = edges.where("from_id <> to_id").select(*graph, F.explode(F.array("from_id", "to_id")).alias("vertex"))
    d = ends.groupBy(*graph, "vertex").agg(F.count("*").alias("degree"))
    q = d.groupBy(*graph).agg(F.percentile("degree", F.lit(quantile)).alias("_q"))
    return d.join(q, list(graph)).select(*graph, "vertex", "degree", F.when(F.col("degree") > F.col("_q"), "core").otherwise("peripheral").alias("class"))


def trends(edges: DataFrame, graph: tuple[str, ...]) -> DataFrame:
    """Measures of many networks at once: (graph, vertices, edges, density, mean_degree, strength, core); strength sums ln(1 + weight)."""
    c = classes_by_degree(edges, graph).groupBy(*graph).agg(F.count("*").alias("vertices"), F.avg("degree").alias("mean_degree"), F.count_if(F.col("class") == "core").alias("core"))
    e = edges.where("from_id <> to_id").groupBy(*graph).agg(F.count("*").alias("edges"), F.sum(F.log1p("weight")).alias("strength"))
    n = F.col("vertices")
    return c.join(e, list(graph)).select(*graph, "vertices", "edges", F.try_divide("edges", n * (n - 1)).alias("density"), "mean_degree", "strength", "core")
