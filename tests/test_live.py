import json
import subprocess
import time

import pytest
from pyspark.errors import StreamingQueryException

from pyspark.sql import functions as F

from sparkloom.sources import changes, git
from sparkloom.streaming import live

EVENT = "repo string, path string"


def wait(until, seconds=90):
    end = time.time() + seconds
    while not until():
        assert time.time() < end, "nothing came"
        time.sleep(0.1)


class Feed:
    """Event files in a folder, as a stream."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        folder.mkdir()

    def put(self, *rows):
        self.n += 1
        hidden = self.folder / f".{self.n}"
        hidden.write_text("\n".join(json.dumps({"repo": r, "path": p}) for r, p in rows))
        hidden.rename(self.folder / f"{self.n}.json")

    def events(self, **kw):
        return live.events_of(self.spark.readStream.schema(EVENT).json(str(self.folder)), **kw)


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_waits():
    assert [live.wait_ms(n, 1000, 5000) for n in range(6)] == [0, 1000, 2000, 4000, 5000, 5000]


def test_changes_are_given_out_together_and_what_comes_meanwhile_later(spark, tmp_path, few):
    feed, seen = Feed(spark, tmp_path / "in"), []

    def apply(repo, changed, number):
        seen.append((repo, sorted(r.path for r in changed.collect())))
        if len(seen) == 1:
            feed.put(("r", "src/c.ts"), ("r", "src/a.ts"))  # while the first sync runs

    query = live.watch_live(feed.events(ignore=["state.json"], include=lambda p: ~F.col(p).endswith(".md")), apply, str(tmp_path / "cp"), debounce_ms=1500)
    feed.put(("r", "src/a.ts"))
    feed.put(("r", "./src/b.ts"), ("r", "state.json"), ("r", "README.md"), ("r", None))
    wait(lambda: len(seen) >= 2)
    query.stop()
    assert seen == [("r", ["src/a.ts", "src/b.ts"]), ("r", ["src/a.ts", "src/c.ts"])]


def test_failures_wait_and_are_tried_again(spark, tmp_path, few):
    feed, seen, said = Feed(spark, tmp_path / "in"), [], []

    def apply(repo, changed, number):
        seen.append((repo, sorted(r.path for r in changed.collect()), time.time()))
        if repo == "bad" and sum(s[0] == "bad" for s in seen) < 3:
            raise RuntimeError("API error")

    query = live.watch_live(feed.events(), apply, str(tmp_path / "cp"), log=said.append, debounce_ms=50, interval_ms=3000)
    feed.put(("bad", "x"), ("good", "y"))
    wait(lambda: sum(s[0] == "bad" for s in seen) >= 2 and len(seen) >= 3)
    feed.put(("bad", "z"))  # comes during the second wait
    wait(lambda: sum(s[0] == "bad" for s in seen) >= 3)
    feed.put(("bad", "w"))
    wait(lambda: sum(s[0] == "bad" for s in seen) >= 4)
    query.stop()
    bad = [s for s in seen if s[0] == "bad"]
    assert [s[1] for s in bad] == [["x"], ["x"], ["x", "z"], ["w"]]
    assert bad[1][2] - bad[0][2] >= 3 and bad[2][2] - bad[1][2] >= 6
    assert sum(s[0] == "good" for s in seen) == 1
    assert said[0] == "[bad] sync error (attempt 1, backoff 3s): API error" and "(attempt 2, backoff 6s)" in said[1]


def test_pending_changes_survive_a_restart(spark, tmp_path, few):
    feed, seen = Feed(spark, tmp_path / "in"), []
    apply = lambda repo, changed, number: seen.append(sorted(r.path for r in changed.collect()))
    query = live.watch_live(feed.events(), apply, str(tmp_path / "cp"), debounce_ms=12_000)
    feed.put(("r", "a"))
    wait(lambda: query.lastProgress and any(s["numInputRows"] for p in query.recentProgress for s in [p]))
    query.stop()
    assert seen == []
    query = live.watch_live(feed.events(), apply, str(tmp_path / "cp"), debounce_ms=12_000)
    wait(lambda: seen)
    query.stop()
    assert seen == [["a"]]


def test_source_of_commits(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()

    def run(*args):
        return subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@x", *args], check=True, capture_output=True, text=True).stdout.strip()

    def commit(**files):
        for name, content in files.items():
            (repo / f"{name}.py").write_text(content)
        run("add", ".")
        run("commit", "--allow-empty", "-m", "x")

    def read():
        stream = changes.changes(spark, {"r": str(repo), "none": str(tmp_path / "missing")}, ignore=["state.py"])
        rows = []
        query = stream.writeStream.foreachBatch(lambda df, n: rows.extend((r.repo, r.path) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(rows)

    run("init")
    commit(a="1", b="1", state="1")
    assert read() == [("r", "a.py"), ("r", "b.py")]
    assert read() == []
    commit(b="2", state="2")
    commit(c="1")
    assert read() == [("r", "b.py"), ("r", "c.py")]
    commit()  # no file changed: the offset moves on
    assert read() == []
    run("update-ref", "-d", "HEAD")
    run("reflog", "expire", "--expire=now", "--all")
    run("gc", "--prune=now")
    commit(a="3")
    with pytest.raises(StreamingQueryException, match="OrphanedCheckpoint"):
        read()


def test_engine_follows_commits(spark, tmp_path, few):
    from sparkloom.api import Engine

    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *args: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@x", *args], check=True, capture_output=True)
    run("init")

    def commit(**files):
        for name, content in files.items():
            (repo / f"{name}.py").write_text(content)
        run("add", ".")
        run("commit", "-m", "x")

    def now(name):
        rows = [(p.name, p.read_text(), 1.0) for p in repo.glob("*.py")]
        return spark.createDataFrame(rows, "path string, content string, size_kb double")

    one = lambda files: files.select(F.col("path").alias("source_path"), F.lit(0).alias("chunk_no"), "content").withColumnRenamed("content", "text")
    engine = Engine(spark, str(tmp_path / "store"), chunk=one)
    engine.create_agent("r", "R")
    commit(a="one", b="two")
    query = engine.watch({"r": str(repo), "nobody": str(repo)}, now, str(tmp_path / "cp"), include=lambda p: F.col(p).endswith(".py"), debounce_ms=100)
    texts = lambda: sorted(r.text for r in engine.passages.collect())
    wait(lambda: texts() == ["one", "two"])
    commit(b="three")
    wait(lambda: texts() == ["one", "three"])
    wait(lambda: engine.state.where("agent_id = 'r'").first().last_sync_commit == git.head(str(repo)))
    query.stop()
    assert {r.path for r in engine.hashes("r").collect()} == {"a.py", "b.py"} and {r.agent_id for r in engine.passages.collect()} == {"r"}
