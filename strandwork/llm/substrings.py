"""Substring dedup: long passages that two documents or more hold, wherever they stand in a text.

A paragraph is a window of ``PARAGRAPH`` words that begins at a content-defined place:
where the hash of the next five words is less than those of the ``REACH`` places
before and after.  A passage brings its places along into whatever text, line or layout it is
put, so its copies have the same paragraphs; texts have one about every 2 * ``REACH`` + 1
words, no two of them nearer than ``REACH`` + 1.

Two like paragraphs share ``SHARED`` of their least shingle hashes: a first pass keeps the
paragraphs of which so many occur among the least ones of others.  Those with equal shingles are one
node, and the hashes of a node are dealt to ``BANDS`` bands by their value.  Two nodes with
similarity 0.8 differ in at most ``BANDS`` - 1 hashes, so one band at least is the same in both and its
content is a key; for a band without hashes the least hashes of the node are keys in its place.  No
link is left to chance.  Paragraphs that share a band, and whose parity bits differ in no more places
than their sets may, are verified by exact Jaccard
similarity (``linkage``) and clustered by connected components.  Of each cluster the
paragraph at the smallest (doc_id, word) is kept and the others are removed;
overlapping paragraphs of a document whose first ones are in the same document are one passage, and
passages of at least ``MIN_WORDS`` words are reported.

Bounds: copied passages of 51 words are found in about 93 of 100 cases, of 55 words in 97, of
60 words in 99.7 (a test measures it), as they depend on the places; edits in a passage cost the paragraphs that they are in.

Defined cases: null and empty texts, and those of fewer words than a paragraph, have
none; rows that repeat a doc_id are one document, in which equal places don't repeat
each other (n_members counts them all); what one document alone repeats is left to it;
overlapping paragraphs of one document don't repeat each other; a null doc_id is smaller than all others; an empty table gives no rows; further columns,
clashing names included, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE, bounded, discard, materialize, mix, plain, room, shingle_hashes, ship, signature, word_hashes
from .jaccard import PERCENT, SETS, prefix_length
from .linkage import link_components

PARAGRAPH, REACH, MIN_WORDS = 32, 4, 36
#: Shingles of a paragraph.
WIDTH = PARAGRAPH - SHINGLE + 1
#: Of their least shingles, like paragraphs share so many.
SHARED = 2
#: Texts are taken together until they have so many words; paragraphs in parts of ``PART``.
WORDS, PART = 2**17, 4096
_NONE = np.uint64(2**64 - 1)
_NO_ID = -(2**62)


def _salts(first: int, n: int) -> np.ndarray:
    return mix(np.arange(first, first + n, dtype=np.uint64))


def n_bands(percent: int) -> int:
    """One more than the hashes in which two like paragraphs differ at most."""
    return (100 - percent) * 2 * WIDTH // (100 + percent) + 1


#: Bands at the usual threshold.
BANDS = n_bands(PERCENT)


def _long(text: str | None) -> np.ndarray:
    """Word hashes of a text that is long enough for a paragraph; else none."""
    if not text or len(text) < 2 * PARAGRAPH - 1:
        return np.empty(0, np.uint64)
    h = word_hashes(text.encode("utf-8", "replace").lower())
    return h if len(h) >= PARAGRAPH else np.empty(0, np.uint64)


def shingles_in_order(text: str | None) -> np.ndarray:
    """Shingle hashes of a text that is long enough for a paragraph, in order; else none."""
    return shingle_hashes(_long(text))


class Texts:
    """Texts of some rows, end to end: their row numbers, first words and numbers of words, and a shingle hash for each word; the last words of a text begin no shingle and have the largest."""

    def __init__(self, rows: list[int], words: list[np.ndarray]) -> None:
        self.rows, self.n = np.array(rows), np.array([len(h) for h in words])
        end = np.cumsum(self.n)
        self.begin = end - self.n
        self.sh = shingle_hashes(np.concatenate([*words, np.zeros(SHINGLE - 1, np.uint64)]))
        self.sh[(end[:, None] - np.arange(1, SHINGLE)).ravel()] = _NONE

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text that each place is in."""
        return np.searchsorted(self.begin, at, "right") - 1

    def places(self) -> np.ndarray:
        """The words at which paragraphs begin: least of the ``REACH`` shingles on both sides."""
        least = np.ones(len(self.sh), bool)
        for k in range(1, REACH + 1):
            least[:-k] &= self.sh[:-k] < self.sh[k:]
            least[k:] &= self.sh[k:] < self.sh[:-k]
        at = np.flatnonzero(least)
        end = self.begin + self.n
        return at[at + PARAGRAPH <= end[self.of(at)]]

    def repeats(self) -> np.ndarray:
        """Whether the shingle at a place occurs again in its text."""
        again = np.zeros(len(self.sh), bool)
        for b, n in zip(self.begin.tolist(), self.n.tolist(), strict=True):
            own = self.sh[b : b + n - SHINGLE + 1]
            x = np.sort(own)
            same = x[1:] == x[:-1]
            if same.any():
                again[b : b + len(own)] = np.isin(own, x[1:][same])
        return again

    def marked(self, at: np.ndarray) -> np.ndarray:
        """The places among ``at``, in order, each once."""
        held = np.zeros(len(self.sh), bool)
        held[at] = True
        return np.flatnonzero(held)


def together(texts: Iterable[pa.StringScalar]) -> Iterator[Texts]:
    """Texts that are long enough for a paragraph, many at a time: most have few, and numpy's calls would take longer than the work."""
    rows, words, n = [], [], 0
    for i, t in enumerate(texts):
        h = _long(t.as_py())
        if len(h):
            rows.append(i)
            words.append(h)
            n += len(h)
        if n >= WORDS:
            yield Texts(rows, words)
            rows, words, n = [], [], 0
    if rows:
        yield Texts(rows, words)


def places(sh: np.ndarray) -> np.ndarray:
    """The words at which paragraphs begin in the text with these shingles."""
    one = Texts([0], [np.zeros(len(sh) + SHINGLE - 1, np.uint64)])
    one.sh[: len(sh)] = sh
    return one.places()


def nodes_of(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the shingles of each paragraph."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sh), dtype=np.uint64)])
    return mix(total[at + WIDTH] - total[at]).view(np.int64)


def leading(x: Texts, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each paragraph the words of its least shingles, how many of them a like one has among its own, and whether it repeats a shingle of the text."""
    width = min(WIDTH, prefix_length(WIDTH, percent) + SHARED - 1)
    first = np.empty((len(at), width), np.int64)
    for k in range(0, len(at), PART):
        own = x.sh[at[k : k + PART, None] + np.arange(WIDTH)]
        first[k : k + PART] = at[k : k + PART, None] + np.argsort(own, 1)[:, :width]
    need = np.full(len(at), min(SHARED, -(-percent * WIDTH // 100)))
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(x.repeats())])
    odd = total[at + WIDTH] > total[at]
    rows = np.flatnonzero(odd)
    own = np.sort(x.sh[at[rows, None] + np.arange(WIDTH)], 1)
    for k in rows[(own[:, 1:] == own[:, :-1]).any(1)].tolist():
        u, where = np.unique(x.sh[at[k] : at[k] + WIDTH], return_index=True)
        where = where[: prefix_length(len(u), percent) + SHARED - 1]
        first[k] = at[k] + np.resize(where[:width], width)
        need[k] = min(SHARED, -(-percent * len(u) // 100))
    return first, need, odd


def bands(sh: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of distinct shingles of each paragraph, and the keys of all with the paragraphs that they belong to."""
    k = n_bands(percent)
    full, empty = _salts(101, k), _salts(10_001, k)
    own = np.sort(sh[at[:, None] + np.arange(WIDTH)], 1)
    new = np.ones(own.shape, bool)
    new[:, 1:] = own[:, 1:] != own[:, :-1]
    n = new.sum(1)
    value = np.where(new, mix(own), np.uint64(0))
    band = ((own & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
    mine = [(band == b) & new for b in range(k)]
    held = np.stack([x.any(1) for x in mine], 1)
    key = mix(np.stack([(value * x).sum(1, dtype=np.uint64) for x in mine], 1) + full)
    # Two nodes may agree in nothing but a band without hashes: those that have one meet by their least hashes.
    row, b = np.nonzero(~held)
    least = new & (np.cumsum(new, 1) <= np.array([prefix_length(x, percent) for x in range(WIDTH + 1)])[n][:, None])
    more = mix(own[row] + empty[b][:, None])[least[row]]
    owner = np.concatenate([np.nonzero(held)[0], np.repeat(row, least[row].sum(1))])
    return n, np.concatenate([key[held], more]).view(np.int64), owner


def parity(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 parity bits of the distinct shingles of each paragraph; the bands are by other bits of the hashes."""
    own = np.sort(sh[at[:, None] + np.arange(WIDTH)], 1)
    flips = np.uint64(1) << (own >> np.uint64(58))
    flips[:, 1:][own[:, 1:] == own[:, :-1]] = 0
    return np.bitwise_xor.reduce(flips, 1).view(np.int64)


def _occurrences(percent: int):  # noqa: ANN202
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to (id, place, token): the places where least shingles of paragraphs stand, numbered; twice where the text may repeat them itself."""
        room()
        for b in batches:
            for x in together(b.column(1)):
                first, _, odd = leading(x, x.places(), percent)
                pos = x.marked(first)
                of = x.of(pos)
                place = np.arange(len(pos)) - np.searchsorted(of, np.arange(len(x.rows)))[of]
                again = np.searchsorted(pos, x.marked(first[odd]))
                pick = np.concatenate([np.arange(len(pos)), again])
                ids = b.column(0).take(pa.array(x.rows[of[pick]]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(place[pick].astype(np.int32)), pa.array(x.sh[pos[pick]].view(np.int64))], ["id", "place", "token"])

    return occurrences


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, list of places) to (id, bits)."""
    room()
    for b in batches:
        bits = []
        for x in b.column(1):
            at = x.values.to_numpy()
            held = np.zeros(int(at.max()) + 1, np.uint8)
            held[at] = 1
            bits.append(np.packbits(held).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], ["id", "bits"])


def _paragraphs(percent: int):  # noqa: ANN202
    def paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text, bits) to (id, start, node) of the paragraphs with enough least shingles at places that are set."""
        room()
        for b in batches:
            for x in together(b.column(1)):
                at = x.places()
                first, need, _ = leading(x, at, percent)
                pos = x.marked(first)
                count = np.bincount(x.of(pos), minlength=len(x.rows))
                bits = b.column(2).take(pa.array(x.rows))
                met = np.zeros(len(x.sh), bool)
                met[pos] = np.concatenate([np.unpackbits(np.frombuffer(held.as_py(), np.uint8), count=n) for held, n in zip(bits, count.tolist(), strict=True)])
                at = at[met[first].sum(1) >= need]
                of = x.of(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(x.rows[of])), pa.array((at - x.begin[of]).astype(np.int32)), pa.array(nodes_of(x.sh, at))], ["id", "start", "node"])

    return paragraphs


def _wanted(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and wanted places of the rows (text, wanted places), in parts; rows of one id may be too short for some."""
    for x in together(b.column(0)):
        want = b.column(1).take(pa.array(x.rows))
        at = want.flatten().to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(x.rows)), want.value_lengths().to_numpy())
        at = (at + x.begin[of])[at + PARAGRAPH <= x.n[of]]
        for k in range(0, len(at), PART):
            yield x.sh, at[k : k + PART]


def _banded(percent: int):  # noqa: ANN202
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, wanted places) to (key, node, n, bits)."""
        room()
        for b in batches:
            for sh, at in _wanted(b):
                n, key, owner = bands(sh, at, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, nodes_of(sh, at)[owner], n[owner], parity(sh, at)[owner])], ["key", "node", "n", "bits"])

    return banded


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted places) to (node, toks, sig)."""
    room()
    for b in batches:
        for sh, at in _wanted(b):
            toks = [np.unique(sh[k : k + WIDTH].view(np.int64)) for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(sh, at)), pa.array(toks, pa.list_(pa.int64())), pa.array([signature(x) for x in toks], pa.list_(pa.int64()))], ["node", "toks", "sig"])


def _linked(texts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """A table (node, comp) of the nodes that are like another one; ``classes`` has (node, id, start)."""

    def found(nodes: DataFrame) -> DataFrame:
        """(text, wanted places) of the documents that hold the first place of each node."""
        want = materialize(nodes.groupBy("id").agg(F.collect_list("start").alias("want")))
        return texts.join(bounded(want), "id").select("text", "want")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return found(classes.join(bounded(nodes), "node", "left_semi")).mapInArrow(_sets, SETS).dropDuplicates(["node"])

    banded = found(classes).mapInArrow(_banded(percent), "key bigint, node bigint, n bigint, bits bigint")
    # Only rows that repeat an id give a node twice.
    repeated = not texts.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    banded = materialize(banded.distinct() if repeated else banded)
    comps = link_components(banded.select("key", "node", "n", F.lit(0).alias("pos"), "bits"), sets_of, percent)
    discard(banded)
    return comps


def _candidates(texts: DataFrame, percent: int) -> DataFrame:
    """A table (id, start, node) of all paragraphs that another one can be like."""
    of = texts.mapInArrow(_occurrences(percent), "id bigint, place int, token bigint").withColumn("c", F.count("*").over(Window.partitionBy("token")))
    met = materialize(of.where("c > 1").groupBy("id").agg(F.collect_list("place").alias("places")))
    want = materialize(met.mapInArrow(_packed, "id bigint, bits binary"))
    out = materialize(texts.join(bounded(want), "id").select("id", "text", "bits").mapInArrow(_paragraphs(percent), "id bigint, start int, node bigint"))
    discard(met, want)
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each passage that another document has, too: doc_id, paragraph (its first word), n_words, cluster_doc, cluster_paragraph, n_members, removed."""
    ship(docs.sparkSession)
    texts = plain(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text")
    base = _candidates(texts, percent)
    place = F.struct("id", "start")
    spread = [F.min(place).alias("least"), F.max("id").alias("last_id"), F.count("*").alias("c")]
    classes = materialize(base.groupBy("node").agg(*spread).select("*", "least.id", "least.start"))
    comps = _linked(texts, classes.select("node", "id", "start"), percent)
    member = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    clusters = member.groupBy("comp").agg(F.sum("c").alias("n_members"), F.min("least").alias("first"), F.max("last_id").alias("last_id")).where("first.id <> last_id")
    known = materialize(member.select("node", "comp").join(clusters, "comp").select("node", "n_members", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")))
    out = base.select("id", "start", "node").join(known, "node")
    out = out.where(f"id <> first_id OR start = first_start OR start >= first_start + {PARAGRAPH}")
    # Overlapping paragraphs with a counterpart in the same document are one passage.
    out = out.withColumn("removed", (F.col("id") != F.col("first_id")) | (F.col("start") != F.col("first_start")))
    of = Window.partitionBy("id", "first_id", "removed").orderBy("start")
    out = out.withColumn("new", F.when(F.col("start") - F.lag("start").over(of) <= PARAGRAPH, 0).otherwise(1)).withColumn("run", F.sum("new").over(of))
    out = out.groupBy("id", "first_id", "removed", "run").agg(F.min(F.struct("start", "first_start")).alias("from"), F.max("start").alias("to"), F.max("n_members").alias("n_members"))
    out = out.withColumn("n_words", F.col("to") - F.col("from.start") + PARAGRAPH).where(F.col("n_words") >= min_words)
    named = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(
        named("id").alias("doc_id"), F.col("from.start").cast("bigint").alias("paragraph"), F.col("n_words").cast("bigint").alias("n_words"), named("first_id").alias("cluster_doc"),
        F.col("from.first_start").cast("bigint").alias("cluster_paragraph"), "n_members", "removed",
    )
