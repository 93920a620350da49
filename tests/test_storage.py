"""Sinks, configuration and the stream."""

import pytest
from pyspark.sql import functions as F

from strandwork.sources import config, sinks
from strandwork.streaming import windows
from tests.conftest import SMALL


def test_rewrite_is_idempotent_and_leaves_other_ranges(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "range_id int, v string")
    sinks.rewrite(d, path, ("range_id",))
    for _ in range(2):
        sinks.rewrite(d.where("range_id = 1").withColumn("v", F.upper("v")), path, ("range_id",))
    assert sorted((r["range_id"], r["v"]) for r in sinks.read(spark, path).collect()) == [(1, "A"), (1, "B"), (2, "c")]
    sinks.append(d.where("range_id = 2"), path, ("range_id",))
    assert sinks.read(spark, path).count() == 4


def test_get_or_create_gives_the_same_ids(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "known")], "id bigint, name string").write.parquet(path)
    want = spark.createDataFrame([("known",), ("new",), ("new",), (None,)], "name string")
    a = {r["name"]: r["id"] for r in sinks.get_or_create(path, want, "name").collect()}
    b = {r["name"]: r["id"] for r in sinks.get_or_create(path, want, "name").collect()}
    assert a == b and a["known"] == 1 and set(a) == {"known", "new"} and spark.read.parquet(path).count() == 2


def test_timeline_change():
    assert sinks.timeline_change(["a", "b"], ["a", "b", "c"]) == ("append", ["c"])
    assert sinks.timeline_change(["a", "b"], ["a", "x"]) == ("recreate", ["a", "x"])


def test_text_exports(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 3)], "from_id int, to_id int, weight int")
    assert sinks.dot_lines(e).first()[0] == '  "1" -> "2" [weight=3];' and "source=\"1\"" in sinks.graphml_lines(e).first()[0]
    sinks.write_separated(e, str(tmp_path / "x"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "x")).columns == ["from_id", "to_id", "weight"]


GOOD = 'project: busy\nrepo: busybox # url\nrevisions: ["v1", "v2",\n  "v3"]\nrcs: [r1, r2, r3]\ntagging: proximity\n'


def test_configuration(tmp_path):
    (tmp_path / "g").write_text("sleepTime: 5\ntagging: tag\n")
    (tmp_path / "p").write_text(GOOD)
    c = config.load(str(tmp_path / "p"), str(tmp_path / "g"))
    assert c["revisions"] == ["v1", "v2", "v3"] and c["tagging"] == "proximity" and c["sleepTime"] == 5


@pytest.mark.parametrize("text", [GOOD.replace("repo: busybox # url\n", ""), GOOD.replace("[r1, r2, r3]", "[r1]"), GOOD.replace("proximity", "guess"), GOOD.replace('["v1", "v2",\n  "v3"]', "v1"), "no key here"])
def test_bad_configurations(text):
    with pytest.raises(ValueError):
        config.check(config.parse(text))


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    q = windows.write_windows(windows.windowed_activity(windows.event_stream(spark, source, 1), late="60 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("window_start", "event_type", "n", F.round("lines", 4))
    want = windows.windowed_activity(events).select("window_start", "event_type", "n", F.round("lines", 4))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
