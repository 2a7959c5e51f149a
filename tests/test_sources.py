import io
import json
import tarfile

from pyspark.sql import functions as F

from sextant.sources import artifacts as A
from sextant.streaming import events as E


def test_json_artifacts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"key": None, "pr": 1, "title": "x", "files": [{"f": "a", "add": 1, "del": 2}], "other": 5}, {"pr": 2}]))
    got = A.read_task_index(spark, str(tmp_path / "t.json")).orderBy("pr").collect()
    assert [(r.pr, r.title, r.files and r.files[0].f) for r in got] == [(1, "x", "a"), (2, None, None)]
    (tmp_path / "m.json").write_text(json.dumps({"generatedAt": "now", "commit": "c", "modules": [{"name": "n", "path": "p", "files": 3, "classes": ["A"], "summary": None}]}))
    r = A.read_modules(spark, str(tmp_path / "m.json")).first()
    assert (r.path, r.files, r.classes) == ("p", 3, ["A"])


def test_text_sources(spark, tmp_path):
    (tmp_path / "map.md").write_text("# A\nClasses: x\n  Classes: y\na ||| one ||| two\n")
    lines = A.read_map_lines(spark, str(tmp_path / "map.md"))
    assert lines.count() == 2
    assert [tuple(r) for r in A.split_pairs(lines).collect()] == [("a", "one ||| two")]
    (tmp_path / "env").write_text("# c\nA=1=2\n\nB = x \nnone\n")
    assert sorted(map(tuple, A.read_settings(spark, str(tmp_path / "env")).collect())) == [("A", "1=2"), ("B", "x")]


def test_archives(spark, tmp_path):
    def add(tar, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz", format=tarfile.GNU_FORMAT) as tar:
        add(tar, "top/app/A.php", b"x" * 700)
        add(tar, "top/" + "d" * 120 + "/B.php", "é".encode())
        add(tar, "top/README.md", b"no")
    (tmp_path / "broken.tar.gz").write_bytes(b"nothing")
    got = A.read_archives(spark, str(tmp_path), endings=(".php",)).collect()
    assert sorted((r.path, len(r.content)) for r in got) == [("app/A.php", 700), ("d" * 120 + "/B.php", 1)]
    assert A.read_archives(spark, str(tmp_path), roots=("app/",)).count() == 1


def test_deltas(spark):
    rows = [("s", 2, 'data: {"delta": "b"}'), ("s", 1, 'data: {"delta": "a"}'), ("s", 3, "data: {broken"), ("s", 4, "data: [DONE]"), ("s", 5, "event: x"), ("t", 1, 'data: {"x": 1}')]
    got = A.read_deltas(spark.createDataFrame(rows, "stream string, seq int, value string"))
    assert [tuple(r) for r in got.collect()] == [("s", "ab")]


def test_pages(spark, tmp_path):
    for n, items in ((1, [{"a": 1}, {"a": 2}]), (2, [{"a": 3}]), (4, [{"a": 9}])):
        (tmp_path / f"page-{n}.json").write_text(json.dumps(items))
    spark.dataSource.register(A.Pages)
    got = spark.read.format("pages").option("path", str(tmp_path)).load()
    assert sorted((r.page, json.loads(r.item)["a"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 3)]


def test_write_and_append_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    rows = spark.range(10).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    A.write_table(rows, str(src))
    stream = lambda: E.read_events(spark, str(src), "*.parquet")
    for state in ("s1", "s2"):  # a second run from the start adds nothing
        E.append_new(stream(), out, ["event_id"], str(tmp_path / state)).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    batch = {tuple(r) for r in E.by_day(spark.read.parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    got = E.run_to_table(E.by_day(stream()), str(tmp_path / "d"), str(tmp_path / "s3"), "complete")
    assert {tuple(r) for r in got.collect()} == batch


def test_late_duplicates(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 01:00:00", 7)], "event_id bigint, ts string, user_id bigint").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    A.write_table(rows, str(tmp_path / "in"))
    s = E.first_in_window(E.read_events(spark, str(tmp_path / "in"), "*.parquet"), ["user_id"]).select("user_id")
    assert E.run_to_table(s, str(tmp_path / "o"), str(tmp_path / "c")).count() == 1


def test_broken_archives_are_told(spark, tmp_path):
    (tmp_path / "broken.tar.gz").write_bytes(b"nothing")
    got = A.read_archives(spark, str(tmp_path), errors=True).collect()
    assert len(got) == 1 and got[0].path is None and got[0].error


def test_routes_lose_nothing(spark):
    df = spark.createDataFrame([(1, "view"), (2, "refund"), (3, "new kind"), (4, None)], "event_id int, event_type string")
    parts = {k: [r.event_id for r in d.collect()] for k, d in E.route(df).items()}
    assert parts["view"] == [1] and parts["refund"] == [2] and parts["other"] == [3, 4]


def test_scratch_on_a_cluster_must_be_shared():
    from types import SimpleNamespace

    import pytest

    from sextant.runtime import scratch_dir

    with pytest.raises(ValueError):
        scratch_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://x:7077")))
