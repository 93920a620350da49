"""Shared pieces of the training-data operators: words, hashes, shared tables, components.

A word is a run of characters other than space and \\x09-\\x0D.  Word shingles
have five words (``SHINGLE``); texts with fewer words have one shingle, the
whole sequence; texts without words have none.  Shingle and set hashes have 64
bits, and equality of hashes is taken as equality.
"""

from __future__ import annotations

import ctypes
import gc
import io
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java class of the characters between words.
SPACE = r"[\x20\x09-\x0D]"


# --------------------------------------------------------------- shared tables
def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all is on one machine (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables of at most so many rows of a few numbers are broadcast (about 40 bytes a row and executor).
MOST_BROADCAST = 400_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    Once the table is there nothing needs the shuffles that led to it; Spark is told to drop their files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(schema).parquet(path)
    out._strandwork_path = path  # noqa: SLF001
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._strandwork_path)  # noqa: SLF001
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def bounded(table: DataFrame) -> DataFrame:
    """A materialized table of few columns, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, the first of each name where a table has clashing ones; a missing one is an error."""
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    frame, at = numbered(df)
    return frame.select(*[F.col(at[n.lower()]).alias(n) for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns _0, _1, ... (names may clash) and a map of lower-case names to the first column so named."""
    first: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c.lower(), f"_{i}")
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), first


_SHIPPED: set[str] = set()


#: Rows of an Arrow batch; texts can be long, and a Python worker holds a batch and its results at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make the session ready for this package's Python functions.

    Sends the package to the executors by way of the shared folder, once for each application, as
    functions are loaded there by name; and lowers the session's Arrow batches to ``BATCH_ROWS``.
    """
    sc = spark.sparkContext
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if sc.applicationId not in _SHIPPED:
        top, packed = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        name = f"{shared_dir(spark)}/strandwork-{uuid.uuid4().hex}.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(name)  # noqa: SLF001
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)  # noqa: SLF001
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(name)
        _SHIPPED.add(sc.applicationId)


def room() -> None:
    """Give back what other operators' functions have left in this Python worker; Spark keeps workers from stage to stage."""
    bpe = sys.modules.get(f"{__package__}.bpe")
    if bpe is not None and bpe.tokenizer.cache_info().currsize:
        bpe.tokenizer.cache_clear()
        gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shrink(spark: SparkSession) -> None:
    """Have the executors collect garbage, one task for each core: what a Java heap has grown by in earlier steps is given back to the machine, for the Python workers beside it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


# --------------------------------------------------------------- column forms
def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE + "+"), "")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a row's content: rows that agree in doc_id and text are copies and are decided alike."""
    return F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-(2**62))), F.coalesce(F.col(text), F.lit("")))


# --------------------------------------------------------------- numpy forms
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(low: bytes) -> np.ndarray:
    """A hash for each word of a lower-cased UTF-8 text; bytes.split() cuts at the same six characters."""
    ws = low.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of each window of SHINGLE words, in order, repeats included."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(SHINGLE, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        acc = acc + h[k : n - width + 1 + k] * _M[k]
    return mix(acc)


def text_shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as int64."""
    if not text:
        return np.empty(0, np.int64)
    return np.unique(shingle_hashes(word_hashes(text.encode("utf-8", "replace").lower())).view(np.int64))


def set_key(s: np.ndarray) -> int:
    """A hash of a set of tokens."""
    total = mix(s.view(np.uint64)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(s))).view(np.int64)[0])


#: 64-bit words of a set's signature.
SIGNATURE = 16


def signature(s: np.ndarray) -> np.ndarray:
    """1024 parity bits of a set of tokens: two signatures differ in at most as many bits as the sets in tokens."""
    odd = np.bincount((s.view(np.uint64) >> np.uint64(54)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


# --------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): rows (node, comp) with comp the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a
    group minimum (with partial aggregation) and a join, until no edge changes;
    every round is a table in the shared folder.  Nodes without edges have no row.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        old, e = e, materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            break
        last = now
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(tops.select("node", F.col("node").alias("comp")))
