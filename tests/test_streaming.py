import datetime as dt

from sparkloom.streaming import watch


def events(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, start + dt.timedelta(seconds=s), p) for r, s, p in rows], "repo string, ts timestamp, path string")


def test_debounce_batch(spark):
    df = events(spark, [("a", 0, "x"), ("a", 0.1, "y"), ("a", 0.2, "x"), ("a", 5, "z"), ("b", 0, "state.json"), ("b", 0.1, "q")])
    got = sorted((r.repo, r.paths, r.n) for r in watch.debounced(df, ignore="state.json").collect())
    assert got == [("a", ["x", "y"], 3), ("a", ["z"], 1), ("b", ["q"], 1)]


def test_debounce_and_counts_stream(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 0.1, "y"), ("a", 100, "z"), ("a", 500, "late sentinel")]
    events(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, ts timestamp, path string").parquet(str(tmp_path / "in"))
    query = watch.debounced(stream, "1 second").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.paths for r in spark.table("sessions").collect()) == [["x", "y"], ["z"]]
    counts = watch.windowed_counts(stream, "1 minute", key="repo").writeStream.format("memory").queryName("counts").outputMode("append").start()
    counts.processAllAvailable()
    counts.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2]


def test_watch_applies_each_batch_once(spark, tmp_path):
    events(spark, [("a", 0, "x"), ("a", 1, "x"), ("b", 2, "y")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, ts timestamp, path string").parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # the second run finds nothing new
        query = watch.watch(stream, lambda df, n: seen.extend(sorted(map(tuple, df.collect()))), str(tmp_path / "check"), once=True)
        assert query.awaitTermination(60)
    assert seen == [("a", "x"), ("b", "y")]


def test_backoff():
    b = watch.Backoff(1000, 5000)
    assert [b.failed("r") for _ in range(5)] == [1000, 2000, 4000, 5000, 5000] and b.failed("s") == 1000
    b.succeeded("r")
    assert b.failed("r") == 1000
