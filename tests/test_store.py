import pytest
from pyspark.sql import functions as F

from sparkloom.api import Engine
from sparkloom.sources.store import Table, VersionTaken

ONE = lambda files: files.select(F.col("path").alias("source_path"), F.lit(0).alias("chunk_no"), F.concat(F.lit("FILE: "), "path", F.lit("\n\n"), "content").alias("text"))
CODE = "path string, content string, size_kb double"


def test_a_writer_that_comes_second_loses_nothing_of_the_first(spark, tmp_path):
    row = lambda *r: spark.createDataFrame([r], "a string, k string, n int")
    first, second = (Table(spark, str(tmp_path / "t"), "a string, k string, n int", ["a", "k"]) for _ in range(2))
    first.put(row("x", "1", 1))
    before = second.pointer()
    first.put(row("y", "1", 2))
    with pytest.raises(VersionTaken):
        second._commit(row("z", "1", 3), None, before)
    assert sorted(r.a for r in first.read().collect()) == ["x", "y"]
    second.put(row("z", "1", 4))
    assert sorted((r.a, r.n) for r in first.read().collect()) == [("x", 1), ("y", 2), ("z", 4)]
    first.compact()
    first.remove(row("x", "1", 0))
    assert sorted(r.a for r in second.read().collect()) == ["y", "z"]
    assert not [p for p in (tmp_path / "t/versions").iterdir() if p.name.startswith("_")]


def test_notes_of_a_part(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    batch = lambda *ids: spark.createDataFrame([("a", i, f"text {i}") for i in ids], "agent_id string, id string, text string").coalesce(1)
    engine.write_passages(batch("1", "2"))
    top = engine.tables["passages"].info()["seq"]
    engine.write_passages(batch("3", "1"))
    assert [r.id for r in engine.list_passages("a").collect()] == ["2", "3", "1"]
    assert engine.tables["passages"].info()["seq"] > top and engine.tables["passages"].info()["dimension"] == 64
    with pytest.raises(Exception, match="dimension"):
        Engine(spark, str(tmp_path / "e"), embed=lambda c: F.array(F.lit(1.0), F.length(c).cast("double"))).write_passages(batch("9"))


def test_hashes_are_kept(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), chunk=ONE)
    files = lambda **k: spark.createDataFrame([(f"{n}.py", c, 1.0) for n, c in k.items()], CODE)
    engine.index("r", files(a="one", b="two", c="three"))
    changed = spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "path string")
    plan = engine.sync("r", changed, files(a="one", b="new"))
    assert sorted((r.path, r.action) for r in plan.collect()) == [("a.py", "unchanged"), ("b.py", "reindexed"), ("c.py", "removed")]
    again = engine.sync("r", changed, files(a="one", b="new"))
    assert sorted((r.path, r.action) for r in again.collect()) == [("a.py", "unchanged"), ("b.py", "unchanged"), ("c.py", "removed")]
    assert sorted(r.path for r in engine.hashes("r").collect()) == ["a.py", "b.py"]
    assert sorted((r.path, r.pos, r.passage_id) for r in engine.passage_map("r").collect()) == [("a.py", 0, "a.py#0"), ("b.py", 0, "b.py#0")]


def test_a_stream_leaves_unchanged_files_alone(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), chunk=ONE)
    code = spark.createDataFrame([("a.py", "one", 1.0), ("b.py", "two", 1.0)], CODE)
    engine.index("r", code)
    version = engine.tables["passages"].pointer()["version"]
    spark.createDataFrame([("r", "a.py"), ("r", "b.py")], "repo string, path string").write.json(str(tmp_path / "events"))
    events = spark.readStream.schema("repo string, path string").json(str(tmp_path / "events"))
    engine.stream("r", events, lambda: code, str(tmp_path / "cp"), once=True).awaitTermination()
    assert engine.tables["passages"].pointer()["version"] == version


def test_search_by_the_index(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), chunk=ONE)
    engine.index("r", spark.createDataFrame([(f"src/f{i}.py", f"alpha word{i % 5} beta{i}", 1.0) for i in range(40)] + [("lib/x.py", "alpha alpha", 1.0)], CODE))
    engine.index("other", spark.createDataFrame([("lib/x.py", "alpha word1", 1.0)], CODE))
    asked = spark.createDataFrame([(1, "word1 beta7"), (2, "alpha")], "query_id int, query string")
    take = lambda: [sorted(map(tuple, df.select("leg", "query_id", "id", "rank", F.round("score", 9)).collect())) for df in (engine.search_legs("r", asked, 4),)]
    scan, prefix = take(), sorted(map(tuple, engine.search("r", asked, 3, "lib/").select("query_id", "id").collect()))
    engine.build_index()
    assert engine._index() is not None and take() == scan
    assert sorted(map(tuple, engine.search("r", asked, 3, "lib/").select("query_id", "id").collect())) == prefix == [(1, "lib/x.py#0"), (2, "lib/x.py#0")]
    engine.write_passages(spark.createDataFrame([("r", "new", "word1")], "agent_id string, id string, text string"))
    assert engine._index() is None and engine.search("r", asked, 3).where("id = 'new'").count() == 1
