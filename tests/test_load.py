import pytest
from pyspark.sql import functions as F

from sparkloom.api import Engine
from sparkloom.functions import sql
from sparkloom.operators import chunking, load

CHUNKS = "id string, text string"


def service():
    def embed(texts):  # defined here, so that it travels to the workers by value
        if any("bad" in t for t in texts):
            raise RuntimeError("service is down")
        return [[float(len(t)), 1.0] for t in texts][: -1 if "short" in texts else None]

    return embed


fake = service()


def rows(spark, n, **special):
    return spark.createDataFrame([(str(i), special.get(f"t{i}", f"text {i}")) for i in range(n)], CHUNKS).coalesce(1)


def test_a_failed_batch_fails_alone(spark):
    done = load.load(rows(spark, 100, t40="bad"), fake)
    assert (done.loaded, done.failed) == (68, 32)
    assert sorted(int(r.id) for r in done.failures.collect()) == list(range(32, 64))
    assert {r.error for r in done.failures.collect()} == {"RuntimeError: service is down"}
    assert {r.id: list(r.embedding) for r in done.rows.collect()}["7"] == [6.0, 1.0] and "error" not in done.rows.columns


def test_too_few_vectors_and_single_calls(spark):
    done = load.load(rows(spark, 5, t2="short", t3="bad", t4=None), fake, batch=1)
    assert (done.loaded, done.failed) == (3, 2)
    assert {r.id: r.error for r in done.failures.collect()} == {"2": "ValueError: 0 vectors for 1 texts", "3": "RuntimeError: service is down"}
    nothing = load.load(rows(spark, 3).where("false"), fake)
    assert (nothing.loaded, nothing.failed, nothing.rows.count()) == (0, 0, 0)
    with pytest.raises(ValueError):
        load.load(rows(spark, 1), fake, batch=0)


def test_calls_have_32_texts_at_most(spark):
    sizes = load.embedded(rows(spark, 70), lambda texts: [[float(len(texts))] for _ in texts])
    assert {r.n: r["count"] for r in sizes.groupBy(F.col("embedding")[0].alias("n")).count().collect()} == {32.0: 64, 6.0: 6}


def test_engine_loads_what_is_embedded(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"), chunk=lambda files: files.select(F.col("path").alias("source_path"), F.lit(0).alias("chunk_no"), F.col("content").alias("text")))
    files = spark.createDataFrame([("a.py", "good one", 1.0), ("b.py", "bad one", 1.0), ("c.py", "good two!", 1.0)], "path string, content string, size_kb double")
    done = engine.load("r", files, fake, batch=1)
    assert (done.loaded, done.failed) == (2, 1) and [r.source_path for r in done.failures.collect()] == ["b.py"]
    assert sorted(r.id for r in engine.passages.collect()) == ["a.py#0", "c.py#0"]
    again = engine.load("r", files, lambda texts: [[1.0, 2.0] for _ in texts])
    assert (again.loaded, again.failed, engine.passages.count()) == (3, 0, 3)


def test_chunks_in_sql(spark):
    sql.register(spark)
    files = spark.createDataFrame([("a.md", "one\n\n" * 40, 1), ("b.md", "", 2), ("c.md", None, 3), (None, "x", 4), ("d.md", "y" * 500, 5)], "path string, content string, extra int")
    files.createOrReplaceTempView("some_files")
    got = spark.sql("select * from chunk_files(table(some_files) partition by path, max_chars => 100)").collect()
    want = chunking.chunks(files.where("path is not null"), 100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 5
    for wrong in ("chunk_files(table(select 1 as path))", "chunk_files(table(some_files), 0)"):
        with pytest.raises(Exception, match="chunk_files|max_chars"):
            spark.sql(f"select * from {wrong}").collect()
    assert spark.sql("select size(stub_embedding('Some TEXT')) as n, stub_embedding(null) as z").first().n == 64
