"""The pipeline against plain Python, stage by stage and as a whole; the queries' registration."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandwork.llm.queries import REGISTRY
from tests.compare import connect, of_duckdb, of_spark
from tests.llm import brute
from tests.llm.test_operators import SMALL, prose, reference


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents with some that each stage must take away, and the benchmark."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    copies = d.where("length(text) > 400").orderBy("doc_id").limit(3).withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.concat("text", F.lit(" more"))})
    own = spark.createDataFrame([(20_000, "123 456 !!", "en", "s", 10), (20_001, None, "en", "s", 0), (20_002, prose(1, 40) + " " + item, "en", "s", 0), (20_003, prose(1, 40), "en", "s", 0)], d.schema)
    path = tmp_path_factory.mktemp("data")
    d.union(copies).union(own).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_and_result(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert set(rows) - set(got) == {20_000, 20_001}
        elif name == "line_dedup":
            assert got == {i: t for i, _, _, t in brute.dedup_lines(list(rows.items()))}
        elif name == "ngram_jaccard_join":
            assert set(got) == {i for i, (n, c) in brute.jaccard(list(rows.items())).items() if not n or c == i} and len(got) < len(rows) - 2
        else:
            bad = {i for i, _ in brute.leaks(list(rows.items()), items)}
            assert set(got) == set(rows) - bad and 20_002 in bad
        rows = got
    ref = reference()
    want = set()
    for i, t in rows.items():
        ids = ref.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert set(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want


def test_run_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_run_with_clashing_names_nulls_and_repeats(spark, tmp_path):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) > 600 AND lang IS NOT NULL").orderBy("doc_id").limit(40)
    rows = {r["doc_id"]: r["text"] for r in d.collect()}
    extra = spark.createDataFrame([(None, None, None, None, None), (30_000, "", "en", None, 0)], d.schema)
    names = ("row", "_row", "_key", "key", "pos", "node", "window", "comp", "id")
    (d.union(d.limit(5)).union(extra).withColumns({n: F.lit(k) for k, n in enumerate(names)})).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    cut = {i: t for i, _, _, t in brute.dedup_lines(list(rows.items()))}
    assert got == sorted(i for i, (_, c) in brute.jaccard(list(cut.items())).items() if c == i)


def test_stage_count_and_registration():
    import __spark_entry__ as e

    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in e.queries()
    assert {n.split("_")[0] for n in REGISTRY.queries} == {f"op{k}" for k in range(1, 11)}


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_queries_equal_sql(spark, name):
    assert of_spark(REGISTRY.queries[name](spark, SMALL)) == of_duckdb(connect(SMALL), REGISTRY.sql[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_contract_columns(spark, name):
    first = {
        "op1": ["doc_id", "item_id"], "op2": ["doc_id", "n_assign", "n_access", "n_hex"], "op3": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op5": ["doc_id", "n_shingles", "component_id"], "op6": ["doc_id"], "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op8": ["doc_id", "n_tokens"], "op9": ["doc_id", "held_out", "lang_pred", "score"],
    }
    assert REGISTRY.queries[name](spark, SMALL).columns[: len(first[name.split("_")[0]])] == first[name.split("_")[0]]


@pytest.mark.parametrize("stage", ["ngram_jaccard_join", "byte_level_bpe"])
def test_stages_with_large_workers_shrink_the_heap_first(spark, folder, stage):
    """In local mode the executor's heap is this JVM's: what a former step has grown it by is given back."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()  # noqa: SLF001
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(5)
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())  # noqa: E731, SLF001
    before, most = beans(), runtime.maxMemory()
    dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    assert beans() > before and runtime.totalMemory() <= most
