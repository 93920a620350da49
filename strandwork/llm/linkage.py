"""Exact components of a similarity graph from postings, without all pairs of a group.

``postings`` has one row (key, node, n, pos) for each key of a node: n is the size
of the node's set, pos the number of its tokens that come before this key in the
token order (0 where the key is no single token).  Two nodes that are similar
enough share a key at least.  A further column bits, 64 parity bits of the set, drops
pairs that differ in too many before their sets are read.

Keys with few nodes give all their pairs.  Keys with many give, first, the pairs
of each node with one central node; once those are verified and joined into
components, only pairs of nodes of *different* components are left to compare, and
of those the ones that sizes, positions and signatures allow, so a group of near
copies costs about its size.  What is left to compare is dealt out in pairs of
blocks of ``BLOCK`` nodes, so that no key is one task.  Every pair that could link is
either verified or already connected: the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import SIGNATURE, bounded, components, discard, materialize

#: Keys held by more nodes than this go by way of a central node.
LIGHT = 16
#: Nodes of a key that one task compares with as many others.
BLOCK = 256


def can_reach(percent: int, na: str, nb: str, pa: str, pb: str) -> Column:
    """Size filter and positional filter: an upper bound of the similarity is at least ``percent``."""
    most = F.least(F.expr(f"{na} - {pa}"), F.expr(f"{nb} - {pb}"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (100 * most >= percent * (F.expr(f"{na} + {nb}") - most))


def can_agree(percent: int, *names: str) -> Column:
    """Bitmap filter: the signatures, or these columns of parity bits, differ in no more bits than two sets of these sizes may differ in tokens."""
    differ = F.expr(" + ".join(f"bit_count({x}_a ^ {x}_b)" for x in names or [f"s{k}" for k in range(SIGNATURE)]))
    return (100 + percent) * differ <= (100 - percent) * F.expr("n_a + n_b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a table (u, v) whose sets (node, toks) have Jaccard similarity of ``percent`` or more.

    Sets are much larger than pairs: the pairs go to the sets of their first ends, and of the second
    ends only those that are needed are shuffled.
    """
    second = materialize(pairs.select(F.col("v").alias("node")).distinct())
    a = sets.select(F.col("node").alias("u"), F.col("toks").alias("ta")).join(bounded(pairs), "u")
    b = sets.join(bounded(second), "node", "left_semi").select(F.col("node").alias("v"), F.col("toks").alias("tb"))
    j = a.join(b, "v").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    return j.where(100 * F.col("o") >= percent * (F.size("ta") + F.size("tb") - F.col("o"))).select("u", "v")


def counted(postings: DataFrame, held: DataFrame, light: int) -> DataFrame:
    """The postings whose key is in ``held`` (key, c), with c.

    Within the bound of broadcasts, rows of keys with more than ``light`` nodes get it there and are dealt
    out by themselves, so that none of those keys is one task; beyond it Spark splits the join.
    """
    crowded = held.where(F.col("c") > light)
    if crowded.count() > common.MOST_BROADCAST:
        return postings.join(held, "key")
    known = postings.join(F.broadcast(crowded.withColumnRenamed("c", "_c")), "key", "left")
    by = F.when(F.col("_c").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node"))
    both = known.withColumn("_by", by).join(held.where(F.col("c") <= light).withColumnRenamed("key", "_by"), "_by", "left")
    return both.withColumn("c", F.coalesce("_c", "c")).where("c IS NOT NULL").drop("_c", "_by")


def blocked_pairs(rows: DataFrame, own: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """Pairs of ``rows`` (key, c, node, ...) of one key, each once, as columns x_a and x_b of ``own``.

    A key's rows are dealt to c / ``block`` blocks by node, and each pair of blocks is a key of its own:
    however many nodes a key has, a task compares no more than ``block`` with as many.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("c") / block)).cast("int")
    dealt = rows.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    low = dealt.select("key", F.col("_b").alias("_x"), F.explode(F.expr("sequence(_b, _n - 1)")).alias("_y"), *[F.col(x).alias(f"{x}_a") for x in own])
    high = dealt.select("key", F.explode(F.expr("sequence(0, _b)")).alias("_x"), F.col("_b").alias("_y"), *[F.col(x).alias(f"{x}_b") for x in own])
    return low.join(high, ["key", "_x", "_y"]).where("_x < _y OR node_a < node_b")


def link_components(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """A table (node, comp) of the nodes that link with another node; ``sets_of(nodes)`` gives (node, toks, sig) for a table of nodes."""
    held = materialize(postings.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))  # by itself: its shuffle is gone before the next
    p = materialize(counted(postings, held, light))
    discard(held)
    few, heavy = p.where(F.col("c") <= light), p.where(F.col("c") > light)
    bits = [c for c in ("bits",) if c in p.columns]
    own = ("node", "n", "pos", *bits)
    a = few.select("key", *[F.col(x).alias(f"{x}_a") for x in own])
    b = few.select("key", *[F.col(x).alias(f"{x}_b") for x in own])
    ok = can_reach(percent, "n_a", "n_b", "pos_a", "pos_b")
    near = ok & can_agree(percent, *bits) if bits else ok
    met = a.join(b, "key").where(F.col("node_a") < F.col("node_b")).where(near)
    centre = materialize(heavy.groupBy("key").agg(F.min(F.struct("pos", "node", "n", *bits)).alias("x")).select("key", *[F.col(f"x.{c}").alias(f"{c}_b") for c in own]))
    star = heavy.select("key", *[F.col(x).alias(f"{x}_a") for x in own]).join(bounded(centre), "key").where("node_a <> node_b").where(near)
    ends = lambda d: d.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v"))
    first = materialize(ends(met).union(ends(star)).distinct())
    nodes = materialize(first.select(F.col("u").alias("node")).union(first.select("v")).union(heavy.select("node")).distinct())
    sets = materialize(sets_of(nodes))
    links = materialize(verified(first, sets, percent))
    discard(first, nodes, centre)
    comps = materialize(components(links))
    if not heavy.isEmpty():
        h = materialize(heavy.join(bounded(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        mixed = materialize(h.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"))
        words = [F.col("sig")[k].alias(f"s{k}") for k in range(SIGNATURE)]
        h = h.join(bounded(mixed), "key").select("key", "c", "node", "n", "pos", "comp").join(sets.select("node", *words), "node")
        rest = blocked_pairs(h, ("node", "n", "pos", "comp", *[f"s{k}" for k in range(SIGNATURE)]), block)
        rest = materialize(ends(rest.where((F.col("comp_a") != F.col("comp_b")) & ok & can_agree(percent))).distinct())
        more = materialize(verified(rest, sets, percent))
        if not more.isEmpty():
            before, comps = comps, materialize(components(links.union(more)))
            discard(before)
        discard(mixed, rest, more)
    discard(p, sets, links)
    return comps
