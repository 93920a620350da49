"""Benchmark decontamination: documents that hold a passage of a benchmark.

DataFrame operations only.  Every five-word shingle of every document meets the
benchmark's shingles in one code-generated scan; a hit fixes a window of the item's
length at the item's place (windows without any shingle of an item have similarity
0 with it and need no fingerprint).  Equal windows are one from then on.  Windows
and items get 64-bit SimHashes of their weighted shingles, cut in 8 blocks; items
are filed under every block value within 2 bits, so two fingerprints within
``RADIUS`` = 8 * 3 - 1 = 23 bits share an entry for certain (pigeonhole).  Pairs
within the radius are verified by exact similarity: sum of the lesser over sum of
the greater number of each shingle.

The scan's join broadcasts the benchmark only up to ``MOST_ITEMS`` rows by count;
with a larger one the hashes of shingles, their places and rows are shuffled, without
texts, and the windows are cut from the texts of the rows that have any.

Defined cases: null or empty texts and items match nothing; items with fewer
than five words are one shingle, the whole item; a text shorter than the item is
one window, the text; rows that repeat a doc_id give the best similarity of them; a
null doc_id is reported as null; items with the same text are all reported; empty
tables give no rows; further columns, clashing names included, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, ascii_lower, bounded, discard, materialize, numbered, plain, row_key, words

PERCENT = 80
BLOCKS, NEAR = 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Benchmarks of up to so many rows are broadcast (a row of their index has about 100 bytes a word).
MOST_ITEMS = 2000


def shingles(ws: str) -> Column:
    """Hashes of the shingles of a word array, in order: width five, or the whole array."""
    return F.expr(
        f"CASE WHEN size({ws}) = 0 THEN array() WHEN size({ws}) < {SHINGLE} THEN array(xxhash64({ws})) "
        f"ELSE transform(sequence(1, size({ws}) - {SHINGLE - 1}), i -> xxhash64(slice({ws}, i, {SHINGLE}))) END"
    )


def weighted(sh: str) -> Column:
    """A multiset of hashes as a set: each hash with its running number."""
    return F.expr(f"transform({sh}, (x, i) -> xxhash64(x, size(filter(slice({sh}, 1, i + 1), y -> y = x))))")


def simhash(sh: str) -> Column:
    """64-bit SimHash of an array of hashes, each occurrence with weight one; ties are 0."""
    bit = f"aggregate({sh}, 0, (a, x) -> a + cast(shiftright(x, b) & 1L as int)) * 2 > size({sh})"
    return F.expr(f"aggregate(transform(sequence(0, 63), b -> IF({bit}, shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)")


def _blocks(simhash: str) -> str:
    return f"transform(sequence(0, {BLOCKS - 1}), k -> struct(k AS block, shiftright({simhash}, 8 * k) & 255L AS value))"


#: All bytes with at most NEAR bits set.
_MASKS = [x for x in range(256) if x.bit_count() <= NEAR]


def benchmark_index(benchmark: DataFrame) -> DataFrame:
    """Items (item_id, m words, sh, w, sim) that have words."""
    b = plain(benchmark, "item_id", "text").select("item_id", words(ascii_lower(F.col("text"))).alias("ws")).where("size(ws) > 0")
    b = b.select("item_id", F.size("ws").alias("m"), shingles("ws").alias("sh"))
    return b.select("item_id", "m", "sh", weighted("sh").alias("w"), simhash("sh").alias("sim"))


def _hits(docs: DataFrame, items: DataFrame, width: int, small: bool) -> DataFrame:
    """Windows (row, doc_id, start, m, ws) that begin a run of shingles shared with an item; items of shingle width ``width``."""
    texts = plain(docs, "doc_id", "text").select("doc_id", "text", words(ascii_lower(F.col("text"))).alias("ws"))
    # The outer form: from the inner one Spark infers a filter that splits every text once more.
    at = texts.select("doc_id", "text", "ws", F.explode_outer(F.expr(f"CASE WHEN size(ws) >= {width} THEN sequence(0, size(ws) - {width}) END")).alias("pos"))
    here = F.xxhash64(*[F.expr(f"get(ws, pos + {k})") for k in range(width)])
    before = F.when(F.col("pos") > 0, F.xxhash64(*[F.expr(f"get(ws, pos + {k - 1})") for k in range(width)]))
    own = items.where(f"least(m, {SHINGLE}) = {width}").select("m", F.posexplode("sh0").alias("place", "h"), "sh0")
    own = own.select("m", "place", "h", F.expr("CASE WHEN place > 0 THEN sh0[place - 1] END").alias("h_before")).distinct()
    start = F.greatest(F.lit(0), F.least(F.expr("pos - place"), F.expr("n - m"))).alias("start")
    if small:
        j = at.withColumns({"h": here, "n": F.size("ws")}).join(F.broadcast(own), "h").where(~before.eqNullSafe(F.col("h_before")) | F.col("h_before").isNull())
        found = j.select(row_key().alias("row"), "doc_id", start, "m", "ws")
    else:
        narrow = at.where("pos IS NOT NULL").select(row_key().alias("row"), F.size("ws").alias("n"), "pos", here.alias("h"), before.alias("b"))
        j = narrow.join(own, "h").where(~F.col("b").eqNullSafe(F.col("h_before")) | F.col("h_before").isNull())
        starts = materialize(j.select("row", start, "m").distinct().groupBy("row").agg(F.collect_list(F.struct("start", "m")).alias("at")))
        j = texts.withColumn("row", row_key()).join(bounded(starts), "row").select("row", "doc_id", "ws", F.explode("at").alias("x"))
        found = j.select("row", "doc_id", "x.start", "x.m", "ws")
    return found.withColumn("ws", F.slice("ws", F.col("start") + 1, F.col("m")))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Rows (row, doc_id, item_id, start, similarity) for each window of ``docs`` that repeats an item."""
    if radius > RADIUS:
        raise ValueError(f"blocks guarantee fingerprints within {RADIUS} bits, not {radius}")
    b = plain(benchmark, "item_id", "text").select("item_id", words(ascii_lower(F.col("text"))).alias("ws")).where("size(ws) > 0")
    plain_hash = F.expr(
        f"CASE WHEN size(ws) < {SHINGLE} THEN array(" + "CASE size(ws) " + " ".join(f"WHEN {n} THEN xxhash64({', '.join(f'ws[{k}]' for k in range(n))})" for n in range(1, SHINGLE)) + " END)"
        f" ELSE transform(sequence(0, size(ws) - {SHINGLE}), i -> xxhash64({', '.join(f'ws[i + {k}]' for k in range(SHINGLE))})) END"
    )
    items = materialize(b.select("item_id", F.size("ws").alias("m"), plain_hash.alias("sh0"), shingles("ws").alias("sh")).select("*", weighted("sh").alias("w"), simhash("sh").alias("sim")))
    small = items.count() <= MOST_ITEMS
    widths = [r[0] for r in items.select(F.least("m", F.lit(SHINGLE))).distinct().collect()]
    each = [_hits(docs, items, w, small) for w in sorted(widths) or [SHINGLE]]
    hits = materialize(reduce(DataFrame.union, each).withColumn("window", F.xxhash64("ws", "m")))
    windows = hits.groupBy("window").agg(F.max("m").alias("m"), F.max("ws").alias("ws")).withColumn("sh", shingles("ws"))
    windows = materialize(windows.select("window", "m", weighted("sh").alias("w"), simhash("sh").alias("sim")))
    near = F.array(*[F.lit(x).cast("bigint") for x in _MASKS])
    filed = items.select("item_id", "m", "w", "sim", F.explode(F.expr(_blocks("sim"))).alias("k")).select("item_id", "m", "w", "sim", F.col("k.block").alias("block"), F.explode(F.transform(near, lambda x: F.col("k.value").bitwiseXOR(x))).alias("value"))
    tried = windows.select("window", "m", F.explode(F.expr(_blocks("sim"))).alias("k")).select("window", "m", F.col("k.block").alias("block"), F.col("k.value").alias("value"))
    pairs = tried.join(filed.select("item_id", "m", "block", "value"), ["m", "block", "value"]).select("window", "item_id").distinct()
    a = windows.select("window", F.col("w").alias("wa"), F.col("sim").alias("sa"))
    c = items.select("item_id", F.col("w").alias("wb"), F.col("sim").alias("sb"))
    checked = pairs.join(a, "window").join(c, "item_id").where(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= radius)
    checked = checked.withColumn("o", F.size(F.array_intersect("wa", "wb"))).withColumn("u", F.size("wa") + F.size("wb") - F.col("o"))
    found = checked.where(100 * F.col("o") >= percent * F.col("u")).select("window", "item_id", (F.col("o") / F.col("u")).alias("similarity"))
    out = materialize(hits.join(found.distinct(), "window").select("row", "doc_id", "item_id", "start", "similarity"))
    discard(items, hits, windows)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row (doc_id, item_id, n_windows, similarity) for each document and item found in it."""
    c = contaminated(docs, benchmark, percent)
    return c.groupBy("doc_id", "item_id").agg(F.countDistinct("row", "start").alias("n_windows"), F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    frame, at = numbered(docs)
    bad = bounded(materialize(contaminated(docs, benchmark, percent).select(F.col("row").alias("_row")).distinct()))
    return frame.withColumn("_row", row_key(at["doc_id"], at["text"])).join(bad, "_row", "left_anti").select(*frame.columns).toDF(*docs.columns)
