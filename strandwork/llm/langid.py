"""Language ID: nearest centroid over TF-IDF vectors of hashed letter n-grams.

A text is lower-cased, runs of other characters than letters are one space, and its
letter 1-, 2- and 3-grams are hashed to ``DIMS`` counts.  Log counts times inverse
document frequency, normalised, are compared by cosine with several centroids of
each language (spherical k-means of its training vectors); the nearest centroid
gives the language, its cosine the score.  A text farther from every centroid than
the limit of the nearest one's language is rejected by ``identify``'s ``rejected``.

The model is fitted on a bounded sample of labelled rows: at most about
``FIT_ROWS`` in all, shared evenly by the labels, drawn by a hash of doc_id.  Everything
else covers all rows.  The limit of a language is ``REJECT`` of the cosine that all but
``QUANTILE`` of its training texts reach.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and
rejected; without any labelled row all texts are; ties go to the first language
in order; rows that repeat are decided each by itself; null labels teach nothing; an
empty table gives no rows; further columns, clashing names included, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, plain, room, ship

DIMS = 4096
FIT_ROWS, CENTROIDS = 2400, 4
#: A text is rejected below this part of a low quantile of the cosines that its language's training texts have.
REJECT, QUANTILE = 0.6, 0.01
#: Characters that are counted at a time, to bound the memory of very long texts.
CHUNK = 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a text; None if it has no letter."""
    if not text:
        return None
    out, any_letter = np.zeros(DIMS, np.int64), False
    low = text.lower()
    for at in range(0, len(low), CHUNK):
        c = np.frombuffer(low[max(0, at - 2) : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        any_letter |= bool(letter.any())
        c = np.where(letter, c, 32).astype(np.uint64)
        c = c[np.r_[True, letter[1:] | letter[:-1]]]  # one space for a run of others
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (c[1:] + np.uint64(0x51))) * np.uint64(0xD6E8FEB86659FD93)
        three = (two[:-1] ^ (c[2:] + np.uint64(0xA7))) * np.uint64(0x94D049BB133111EB)
        for h in (one * np.uint64(0xC2B2AE3D27D4EB4F), two * np.uint64(0xC2B2AE3D27D4EB4F), three):
            out += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    return out if any_letter else None


class Model:
    """Centroids by language; fitted on counts and labels."""

    def __init__(self, x: np.ndarray, labels: list[str], centroids: int = CENTROIDS, rounds: int = 12) -> None:
        """``x`` has a row of counts for each label, as float32; it is used up."""
        self.languages = sorted(set(labels))
        if not len(x):
            return
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        x = self.vectors(x)
        found, owner, limits = [], [], []
        for k, lang in enumerate(self.languages):
            own = x[np.array([q == lang for q in labels])]
            c = own.mean(0, keepdims=True)
            while len(c) < min(centroids, len(own)):  # farthest first
                c = np.vstack([c, own[(own @ c.T).max(1).argmin()][None]])
            for _ in range(rounds):
                near = (own @ c.T).argmax(1)
                c = np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            found.append(c)
            owner += [k] * len(c)
            limits.append(REJECT * float(np.quantile((own @ c.T).max(1), QUANTILE)))
        self.centroids = np.vstack(found).astype(np.float32)
        self.owner, self.limits = np.array(owner), np.array(limits)

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32, copy=False)
        v = np.log1p(x, out=x)
        v *= self.idf
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-12)
        return v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        c = counts(text) if self.languages else None
        if c is None:
            return UNKNOWN, 0.0, True
        sims = (self.vectors(c[None]) @ self.centroids.T)[0]
        best = int(sims.argmax())
        score = float(min(1.0, max(0.0, sims[best])))
        k = self.owner[best]
        return self.languages[k], score, score < self.limits[k]


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, places, counts), without texts that have no letter."""
    room()
    for b in batches:
        got = [(lang, c) for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if (c := counts(t.as_py())) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([np.flatnonzero(g[1]).astype(np.uint16).tobytes() for g in got], pa.binary()), pa.array([g[1][g[1] > 0].astype(np.float32).tobytes() for g in got], pa.binary())], ["lang", "places", "counts"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang) that are not held out."""
    ship(docs.sparkSession)
    known = plain(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for r in sizes:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (draw < int((1 << 30) * min(1.0, fit_rows / len(sizes) / r["n"]))))
    if not sizes:
        return Model(np.empty((0, DIMS), np.float32), [])
    drawn = known.where(chosen).select("lang", "text").mapInArrow(_features, "lang string, places binary, counts binary").toArrow()
    x = np.zeros((drawn.num_rows, DIMS), np.float32)
    for k, (places, n) in enumerate(zip(drawn["places"], drawn["counts"], strict=True)):
        x[k, np.frombuffer(places.as_py(), np.uint16)] = np.frombuffer(n.as_py(), np.float32)
    return Model(x, drawn["lang"].to_pylist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, rejected) for each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room()
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([bool(g[2]) for g in got], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    texts = plain(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return texts.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, all columns kept; one pass, no shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame, names = numbered(docs)
    at = int(names["text"][1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room()
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([not m.predict(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return frame.mapInArrow(run, frame.schema).toDF(*docs.columns)
