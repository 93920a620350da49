"""N-gram Jaccard join: the components of documents whose 5-word shingle sets are alike.

A size-aware heavy-light join.  Equal sets are one node from the start.  The
tokens of a set stand in one global order (rare before frequent, then by hash);
two sets with similarity of 80 % or more share a token in short prefixes, and two
tokens in prefixes that are one longer.  Small sets enumerate all two-element
subsets of the longer prefix (few keys, hardly a false candidate); large sets are
found by scanning the inverted lists of the shorter one.  The boundary is the size
at which the counted keys of both ways cost least.

The order needs the frequent tokens only: those with more than ``hot`` sets in
prefixes by hash, and those as frequent in the documents for which the stored
prefix is then too short, go last, the most frequent at the end.

Defined cases: null, empty and blank texts have no shingles and link with nothing
(component_id is their own doc_id); fewer than five words give one shingle; rows
that repeat a doc_id are nodes of their own, whose component is the smallest
doc_id in reach; a null doc_id takes part and is never the smallest; further
columns, clashing names included, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, numbered, plain, room, row_key, set_key, ship, signature, text_shingles
from .linkage import link_components

PERCENT = 80
SETS = "node bigint, toks array<bigint>, sig array<bigint>"
_NO_ID = -(2**62)
#: Tokens in more prefixes than this go to the end of the token order.
HOT = 32
#: Cost of a posting in an inverted list, with the candidates it brings, against that of a subset key.
SCAN_COST = 1.5
#: The order knows the most frequent tokens up to this number (16 bytes each on the driver and the executors); it is one order for any choice.
MOST_HOT = 200_000
#: Stored prefixes are longer than needed by this factor, to make up for frequent tokens that move to the end.
SLACK = 1.3
#: Sets larger than this never enumerate subsets (their number grows with the square of the prefix).
MOST_SMALL = 64


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Sets of n tokens that link share one of the first so many."""
    return n - -(-percent * n // 100) + 1


def _parser(percent: int):  # noqa: ANN202
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, key) to (doc_id, key, n, k1, pref): k1 stands for the set, pref is the prefix by hash with some more tokens."""
        room()
        for b in batches:
            sets = [text_shingles(t.as_py()) for t in b.column(1)]
            pref = [s[: int(SLACK * prefix_length(len(s), percent)) + 8] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(map(len, sets), pa.int64()), pa.array(map(set_key, sets), pa.int64()), pa.array(pref, pa.list_(pa.int64()))],
                ["doc_id", "key", "n", "k1", "pref"],
            )

    return parse


def _found(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([nodes, pa.array(sets, pa.list_(pa.int64())), pa.array([signature(x) for x in sets], pa.list_(pa.int64()))], ["node", "toks", "sig"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, toks, sig)."""
    room()
    for b in batches:
        yield _found(b.column(0), [text_shingles(t.as_py()) for t in b.column(1)])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (node, toks, sig) with the set's key for its node."""
    room()
    for b in batches:
        sets = [s for s in (text_shingles(t.as_py()) for t in b.column(1)) if len(s)]
        yield _found(pa.array(map(set_key, sets), pa.int64()), sets)


def _p(n: str, percent: int) -> Column:
    return F.expr(f"cast({n} - ceil({percent} * {n} / 100D) + 1 as int)")


def boundary(sizes: DataFrame, percent: int, scan_cost: float = SCAN_COST) -> int:
    """The largest size that enumerates subsets: the cheapest in keys over the counted set sizes (at most MOST_SMALL counts)."""
    count = {r["n"]: r["c"] for r in sizes.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    p = {n: prefix_length(n, percent) for n in count}

    def cost(s: int) -> float:
        subsets = sum(c * p[n] * (p[n] + 1) / 2 for n, c in count.items() if n <= s)
        return subsets + scan_cost * sum(c * p[n] for n, c in count.items() if 100 * n >= percent * (s + 1))

    return min(range(MOST_SMALL + 1), key=lambda s: (cost(s), s))


def keys(prefixes: DataFrame, small: int, percent: int) -> DataFrame:
    """Postings (key, node, n, pos) of (node, n, pref): subsets up to size ``small``, tokens from ``percent`` of that on."""
    pairs = F.expr("flatten(transform(pref, (x, i) -> transform(slice(pref, i + 2, size(pref)), y -> xxhash64(least(x, y), greatest(x, y)))))")
    subsets = prefixes.where(F.col("n") <= small).select("node", "n", F.explode(pairs).alias("key")).select("key", "node", "n", F.lit(0).alias("pos"))
    lists = prefixes.where(100 * F.col("n") >= percent * (small + 1)).select("node", "n", F.posexplode(F.slice("pref", F.lit(1), _p("n", percent))).alias("pos", "key"))
    return subsets.union(lists.select("key", "node", "n", "pos"))


class Frequent:
    """The frequent tokens, sorted, with their class (the logarithm of their count); others have class 0."""

    def __init__(self, tokens: DataFrame | None = None, most: int = MOST_HOT, hot: int = HOT, other: Frequent | None = None) -> None:
        got = {} if other is None else dict(zip(other.tokens.tolist(), other.classes.tolist(), strict=True))
        if tokens is not None:
            counted = tokens.groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > hot)
            table = materialize(counted.orderBy(F.desc("c"), "t").limit(most))  # a table, as its shuffle is dropped then
            for r in table.collect():
                got[r["t"]] = max(got.get(r["t"], 0), r["c"].bit_length())
            discard(table)
        self.tokens = np.array(sorted(got), np.int64)
        self.classes = np.array([got[t] for t in self.tokens.tolist()], np.int64)

    def of(self, toks: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(toks), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, toks), len(self.tokens) - 1)
        return np.where(self.tokens[at] == toks, self.classes[at], 0)

    def ordered(self, toks: np.ndarray) -> np.ndarray:
        """Tokens in the global order: by class, then by hash."""
        return toks[np.lexsort((toks, self.of(toks)))]


def _cutter(shared: Broadcast, percent: int):  # noqa: ANN202
    """(node, n, pref by hash) to (node, n, pref in the global order); null where the stored prefix is too short for that."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room()
        frequent = shared.value
        for b in batches:
            out = []
            for n, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                pref = x.values.to_numpy()
                need = min(n, prefix_length(n, percent) + 1)
                if len(pref) == n:
                    out.append(frequent.ordered(pref)[:need])
                else:
                    rest = pref[frequent.of(pref) == 0]
                    out.append(rest[:need] if len(rest) >= need else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["node", "n", "pref"])

    return cut


def _orderer(shared: Broadcast, percent: int):  # noqa: ANN202
    """(node, toks) to (node, n, pref in the global order)."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room()
        frequent = shared.value
        for b in batches:
            sets = [x.values.to_numpy() for x in b.column(1)]
            out = [frequent.ordered(s)[: prefix_length(len(s), percent) + 1] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["node", "n", "pref"])

    return order


def jaccard_components(docs: DataFrame, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    return _components(docs, percent, hot).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, percent: int, hot: int) -> DataFrame:
    """As ``jaccard_components``, with the row's key and a hash that is the component's own."""
    texts = plain(docs, "doc_id", "text")
    ship(docs.sparkSession)
    share = texts.sparkSession.sparkContext.broadcast
    full = materialize(texts.withColumn("key", row_key()).mapInArrow(_parser(percent), "doc_id bigint, key bigint, n bigint, k1 bigint, pref array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    rows = materialize(full.select("doc_id", "key", "n", "k1"))
    base = rows.where("n > 0").drop("key")
    first_rows = materialize(full.where("n > 0").groupBy("k1").agg(F.min("row").alias("row")).select("row"))
    nodes = full.join(bounded(first_rows), "row", "left_semi").select(F.col("k1").alias("node"), "n", "pref")
    # A node's text is found by one of its documents; where rows repeat a doc_id, by the key of the set instead.
    repeated = not base.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()

    def sets_of(wanted: DataFrame) -> DataFrame:
        if repeated:
            return texts.mapInArrow(_keyed, SETS).join(bounded(wanted), "node", "left_semi").dropDuplicates(["node"])
        ids = base.join(wanted.withColumnRenamed("node", "k1"), "k1", "left_semi").groupBy("k1").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("id"))
        found = texts.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).join(bounded(materialize(ids)), "id").select("k1", "text")
        return found.mapInArrow(_tokens, SETS)

    layout = "node bigint, n bigint, pref array<bigint>"
    small = boundary(nodes.select("n"), percent)
    frequent = Frequent(nodes.select(F.explode("pref").alias("t")), hot=hot)
    if not len(frequent.tokens):
        cut = materialize(nodes.mapInArrow(_cutter(share(frequent), percent), layout))
        discard(full, first_rows)
        comps = link_components(keys(cut, small, percent), sets_of, percent)
        discard(cut)
    else:
        short = materialize(nodes.mapInArrow(_cutter(share(frequent), percent), layout).where("pref IS NULL").select("node"))
        whole = materialize(sets_of(short))
        frequent = share(Frequent(whole.select(F.explode("toks").alias("t")), hot=hot, other=frequent))
        cut = materialize(nodes.mapInArrow(_cutter(frequent, percent), layout))
        discard(full, first_rows)
        more = materialize(cut.where("pref IS NULL").select("node").join(short, "node", "left_anti"))
        rest = materialize(sets_of(more))  # by itself: a task runs one Python worker at a time
        late = whole.union(rest).mapInArrow(_orderer(frequent, percent), layout)
        late = materialize(late.join(bounded(materialize(cut.where("pref IS NULL").select("node"))), "node", "left_semi"))
        discard(short, whole, more, rest)
        pref = cut.where("pref IS NOT NULL").union(late)
        comps = link_components(keys(pref, small, percent), sets_of, percent)
        discard(cut, late)

    classes = base.groupBy("k1").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comps.withColumnRenamed("node", "k1"), "k1", "left").withColumn("comp", F.coalesce("comp", "k1"))
    best = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    found = classes.join(best, "comp").select("k1", "component_id", "comp")
    out = rows.join(found, "k1", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "key", "comp")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, of the smallest doc_id in it, and all rows without words; copies of a row stay one."""
    found = materialize(_components(docs, percent, HOT))
    first = found.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("comp").agg(F.min("key").alias("_key")).select("_key")
    keep = bounded(materialize(first.union(found.where("n_shingles = 0").select("key")).distinct()))
    frame, at = numbered(docs)
    kept = frame.withColumn("_key", row_key(at["doc_id"], at["text"])).join(keep, "_key", "left_semi")
    # Only where rows are repeated do the texts need a shuffle to become one.
    copies = not found.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    kept = kept.dropDuplicates(["_key"]) if copies else kept
    return kept.select(*frame.columns).toDF(*docs.columns)
