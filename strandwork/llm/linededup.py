"""Line dedup: long lines that many documents hold are kept in one document only.

DataFrame operations only.  The 128-bit hashes of the keys of all lines are
range-partitioned by (hash, salt of the document), so that a line held by a third of all
documents is dealt over ``SALTS`` groups, and sorted by (hash, salt, document, position)
within the partitions.  One pass over the sorted rows keeps a line's first occurrence in each document;
their counts and greatest documents are partial sums for each hash.  The result is
a compressed bitmap of each document's kept lines, 63 lines a word, words
without a dropped line left out; the text itself is touched once, where the bitmaps are applied.

Defined cases: null and empty texts are one empty line; rows that repeat a doc_id
are one document for the counting, each row with its own bitmap; a null doc_id
is one document, smaller than all others; an empty table gives no rows; further columns,
clashing names included, are ignored by ``line_dedup`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, discard, materialize, numbered, plain, row_key

#: A key of at least so many code points in at least so many documents is dropped.
MIN_CHARS, MIN_DOCS = 40, 5
#: Bitmaps (about 150 bytes each) of up to so many documents are broadcast.
MOST_BITMAPS = 200_000
#: Lines in a word of a bitmap.
WORD = 63
#: Groups that the documents of one line are dealt to.
SALTS = 256
_NO_ID = -(2**63) + 1


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(row, id, pos, h1, h2) of each line whose key is long enough."""
    flat = plain(docs, "doc_id", "text").select(
        row_key().alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.posexplode(lines(F.col("text"))).alias("pos", "line")
    )
    key = F.btrim("line", F.lit(" \t\n\x0b\x0c\r")).alias("key")  # the characters between words
    flat = flat.where(F.char_length("line") >= min_chars).select("row", "id", "pos", key).where(F.char_length("key") >= min_chars)
    low = ascii_lower(F.col("key"))
    return flat.select("row", "id", "pos", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(7), low).alias("h2"))


def first_occurrences(keys: DataFrame) -> DataFrame:
    """The first row of each (h1, h2, id), greatest id first, in one pass over range-partitioned, sorted rows."""
    dealt = keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).repartitionByRange("h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("id"), "pos")
    return dealt.withColumn("before", F.lag("id").over(stream)).where("before IS NULL OR before <> id").drop("before")


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """A table (row, n_dropped, kept): for rows that lose lines, their key, how many, and a map of word to bits of kept lines."""
    keys = materialize(_long_keys(docs, min_chars))
    first = first_occurrences(keys.select("h1", "h2", "id", "pos"))
    common = first.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    common = materialize(common)
    lost = keys.join(bounded(common), ["h1", "h2"]).where("id <> keeper").select("row", "pos").distinct()
    bits = lost.groupBy("row", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.expr(f"~ bit_or(shiftleft(1L, cast(pos % {WORD} as int)))").alias("bits"), F.count("*").alias("n"))
    bitmaps = bits.groupBy("row").agg(F.sum("n").alias("n_dropped"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("kept"))
    out = materialize(bitmaps)
    discard(keys, common)
    return out


def _kept(frame: DataFrame, doc_id: str, text: str, bitmaps: DataFrame) -> DataFrame:
    """``frame`` with _lines, _dropped (how many) and _kept, the text of the other lines."""
    bitmaps = F.broadcast(bitmaps) if bitmaps.count() <= MOST_BITMAPS else bitmaps  # beyond that the texts are shuffled
    marks = bitmaps.select(F.col("row").alias("_row"), F.col("n_dropped").alias("_n"), F.col("kept").alias("_k"))
    both = frame.withColumn("_row", row_key(doc_id, text)).join(marks, "_row", "left").withColumn("_l", lines(F.col(text)))
    left = F.expr(f"filter(_l, (x, i) -> (coalesce(try_element_at(_k, cast(i div {WORD} as int)), -1L) & shiftleft(1L, i % {WORD})) <> 0)")
    kept = F.when(F.col("_n").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(left, "\n"))
    return both.withColumns({"_lines": F.size("_l").cast("bigint"), "_dropped": F.coalesce("_n", F.lit(0)), "_kept": kept})


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row (doc_id, n_lines, n_dropped, kept_text) for each row of ``docs``."""
    texts = plain(docs, "doc_id", "text")
    k = _kept(texts, "doc_id", "text", line_bitmaps(texts, min_chars, min_docs))
    return k.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_kept").alias("kept_text"))


def clean_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with all rows and columns, the dropped lines cut from text and n_chars (if there) counted anew for texts that change."""
    frame, at = numbered(docs)
    text = at["text"]
    k = _kept(frame, at["doc_id"], text, line_bitmaps(docs, min_chars, min_docs))
    new = F.when(F.col("_dropped") > 0, F.col("_kept")).otherwise(F.col(text))
    changed = {text: new}
    if "n_chars" in at:
        changed[at["n_chars"]] = F.when(F.col("_dropped") > 0, F.char_length("_kept").cast(dict(frame.dtypes)[at["n_chars"]])).otherwise(F.col(at["n_chars"]))
    return k.select(*[changed.get(c, F.col(c)).alias(c) for c in frame.columns]).toDF(*docs.columns)


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> c.keeper, false) AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
