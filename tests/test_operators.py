import json

import pytest
from pyspark.sql import functions as F

from sparkloom.api import Engine
from sparkloom.operators import chunking, evaluate, graph, lines, symbols, sync
from sparkloom.plans import queries
from sparkloom.sources import files as sources


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_intervals(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 5, 15), ("a", 15, 20), ("b", 10, 20), ("b", 30, 40)], "k string, start int, end int")
    merged = chunking.merge_intervals(spans, ["k"])
    assert rows(merged) == [("a", 0, 20), ("b", 10, 20), ("b", 30, 40)]
    lengths = spark.createDataFrame([("a", 20), ("b", 50), ("c", 5)], "k string, length int")
    assert rows(chunking.gaps(merged, lengths, ["k"])) == [("b", 0, 10), ("b", 20, 30), ("b", 40, 50), ("c", 0, 5)]


def test_page_rank(spark):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "id string")
    none = spark.createDataFrame([], "src string, dst string")
    assert all(abs(r.rank - 1 / 3) < 1e-9 for r in graph.page_rank(nodes, none).collect())
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "zzz")], "src string, dst string")
    assert abs(sum(r.rank for r in graph.page_rank(nodes, ring).collect()) - 1) < 1e-9
    star = spark.createDataFrame([("a", "c"), ("a", "c"), ("b", "c"), ("a", "b")], "src string, dst string")
    ranks = dict(rows(graph.page_rank(nodes, star)))
    assert ranks["c"] > ranks["b"] > ranks["a"] and abs(sum(ranks.values()) - 1) < 1e-6
    assert graph.page_rank(nodes.limit(0), none).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([("f", 1, 1, "a"), ("f", 1, 2, "x"), ("f", 2, 1, "x"), ("f", 2, 2, "b"), ("f", 2, 3, "a")], "leg string, query_id int, rank int, path string")
    gold = spark.createDataFrame([(1, "k", "a"), (1, "k", "b"), (2, "k", "a"), (2, "k", "b"), (3, "m", "z")], "query_id int, kind string, path string")
    got = rows(evaluate.query_metrics(ranked, gold, (1, 5)), "query_id", "recall_1", "recall_5", "rr")
    assert got == [(1, 0.5, 0.5, 1.0), (2, 0.0, 1.0, 0.5), (3, 0.0, 0.0, 0.0)]
    values = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "v double")
    assert values.agg(evaluate.percentile("v", 50).alias("a"), evaluate.percentile("v", 95).alias("b")).first() == (20.0, 30.0)
    assert values.limit(0).agg(evaluate.percentile("v", 50).alias("a")).first()[0] == 0.0
    a, b = (spark.createDataFrame([("f", x)], "leg string, m double") for x in (0.5, 0.47))
    assert rows(evaluate.compare(a, b, ["leg"]), "metric", "regressed") == [("m", True)]
    assert rows(evaluate.compare(a, a, ["leg"]), "regressed") == [(False,)]


def test_sync_and_reconcile(spark):
    changed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("new",)], "path string")
    now = spark.createDataFrame([("a", "1", 1.0), ("b", "2", 1.0), ("d", "x", 5000.0), ("new", "n", 1.0)], "path string, content string, size_kb double")
    old = sync.content_hashes(spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], "path string, content string"))
    assert rows(sync.hash_diff(changed, now, old), "path", "action") == [("a", "unchanged"), ("b", "reindexed"), ("c", "removed"), ("d", "removed"), ("new", "reindexed")]
    many = spark.range(501).select(F.col("id").cast("string").alias("path"))
    empty = spark.createDataFrame([], "path string, passage_id string")
    assert sync.sync_plan(many, empty)[1].first().is_full and not sync.sync_plan(many.limit(500), empty)[1].first().is_full
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert rows(sync.orphans(ids(1, 2, 2), ids(2, 3))) == [(1,)] and rows(sync.missing(ids(1, 2), ids(2, 3))) == [(3,)]
    assert sync.drift(ids(1), ids(1)).first().in_sync
    pmap = spark.createDataFrame([("p", 1, "x"), ("p", 0, "y"), ("q", 0, "z")], "path string, pos int, passage_id string")
    assert rows(sync.cleaned_map(pmap, spark.createDataFrame([("z",)], "id string"))) == [("p", ["y", "x"])]


def test_upsert_and_dimension(spark):
    store = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, seq long")
    batch = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 3)], "id int, v string, seq long")
    assert rows(sync.upsert(store, batch, ["id"])) == [(1, "a", 1), (2, "new", 4), (3, "c", 5)]
    vectors = spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")
    assert sync.checked_dimension(vectors, None)[1] == 2
    with pytest.raises(Exception, match="dimension"):
        sync.checked_dimension(vectors, 3)[0].collect()


def test_commit_prefix(spark):
    commits = spark.createDataFrame([("r", i, "x" * n) for i, n in enumerate([10, 5, 100, 1])], "r string, pos int, text string")
    assert rows(sync.commit_prefix(commits, 16, ["r"]), "pos", "omitted") == [(0, 2), (1, 2)]


def test_grounding(spark):
    texts = spark.createDataFrame([(1, "keep `a/b.ts`\ndrop `x/y.ts`\nprose `word`\nfix `path/to/a/b.ts`")], "id int, text string")
    known = spark.createDataFrame([("a/b.ts",)], "path string")
    row = lines.grounded(texts, known).first()
    assert row.text == "keep `a/b.ts`\nprose `word`\nfix `a/b.ts`" and row.changed and row.dropped == ["x/y.ts"]


def test_symbols_in_several_languages(spark):
    code = {
        "a.go": "package x\n\nfunc (s *Srv) Run() {\n}\n\nfunc main() {\n}\n\ntype T struct {\n}\n",
        "B.java": "public class B {\n  public void go(int x) {\n    call();\n  }\n}\n",
        "c.rb": "class C\n  def m\n  end\nend\n\ndef f\nend\n",
        "d.rs": "pub fn f() {}\nstruct S;\nimpl S {\n    fn m(&self) {}\n}\n",
        "e.php": "<?php\nfunction f() {}\nclass E {\n  public function m() {}\n}\n",
        "f.c": "struct s {\n  int x;\n};\nint main(void) {\n  return 0;\n}\n",
        "g.cs": "namespace N {\n  public class G {\n    public void M() { }\n  }\n}\n",
        "h.kt": "fun f() {\n}\nclass H {\n  fun m() {\n  }\n}\nobject O {\n}\n",
        "i.swift": "func f() {\n}\nclass I {\n  init() {\n  }\n  func m() {\n  }\n}\n",
        "j.py": "@dec\ndef f():\n    g()\n\nclass J:\n    def m(self):\n        return self.x.y()\n",
        "k.ts": "export const k = () => 1;\nexport class K {\n  m(): void {\n  }\n}\nexport type T = string;\n",
        "bad.py": "def (",
        "plain.txt": "def f(): pass",
    }
    df = spark.createDataFrame(list(code.items()), "path string, content string")
    got = {}
    for r in symbols.definitions(df).collect():
        got.setdefault(r.path, set()).add((r.kind, r.qualified))
    assert got == {
        "a.go": {("METHOD", "Srv.Run"), ("FUNCTION", "main"), ("TYPE", "T")}, "B.java": {("CLASS", "B"), ("METHOD", "B.go")}, "c.rb": {("CLASS", "C"), ("METHOD", "C.m"), ("FUNCTION", "f")},
        "d.rs": {("FUNCTION", "f"), ("CLASS", "S"), ("METHOD", "S.m")}, "e.php": {("FUNCTION", "f"), ("CLASS", "E"), ("METHOD", "E.m")}, "f.c": {("CLASS", "s"), ("FUNCTION", "main")},
        "g.cs": {("CLASS", "G"), ("METHOD", "G.M")}, "h.kt": {("FUNCTION", "f"), ("CLASS", "H"), ("METHOD", "H.m"), ("MODULE", "O")}, "i.swift": {("FUNCTION", "f"), ("CLASS", "I"), ("METHOD", "I.init"), ("METHOD", "I.m")},
        "j.py": {("FUNCTION", "f"), ("CLASS", "J"), ("METHOD", "J.m")}, "k.ts": {("CONST", "k"), ("CLASS", "K"), ("METHOD", "K.m"), ("TYPE", "T")},
    }
    text = {}
    for r in symbols.symbol_chunks(df).collect():
        text[r.source_path] = text.get(r.source_path, "") + r.text
        assert len(r.text) <= 2000
    for path, content in code.items():
        assert all(word in text[path] for word in __import__("re").findall(r"[A-Za-z0-9]+", content))


def test_memory_blocks_and_submodules(spark):
    text = "---\nlabel: arch\nupdated_at: now\n---\n\nbody\nmore"
    df = spark.createDataFrame([("a.md", text), ("b.md", "plain"), ("c.md", "---\nno end")], "path string, content string")
    got = {r.path: (r.label, r.source_commit, r.value) for r in sources.parse_block(df).collect()}
    assert got == {"a.md": ("arch", None, "body\nmore"), "b.md": (None, None, "plain"), "c.md": (None, None, "---\nno end")}
    back = sources.format_block(spark.createDataFrame([("arch", "now", None, "body\nmore")], "label string, updated_at string, source_commit string, value string"))
    assert back.first().content == text
    out = spark.createDataFrame([(" 1234567 lib/x (v1)\n-abcdef0 lib/y\nbroken\n+1234567 z",)], "output string")
    assert rows(sources.submodules(out), "path", "initialised") == [("lib/x", True), ("lib/y", False), ("z", True)]
    alias = sources.path_aliases(spark, '{"compilerOptions": {"baseUrl": "src", /* x */ "paths": {"@a/*": ["lib/*", "./own/*"], "bad": 1,}}}', "web")
    assert rows(alias) == [(0, "@a/*", "web/src/lib/*"), (1, "@a/*", "web/./own/*")]


def test_scan_files(spark, tmp_path):
    for name, content in {"a.ts": "x", "sub/b.py": "é", "node_modules/c.ts": "no", ".git/d.ts": "no", "e.md": "no", "big.ts": "y" * 3000}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(content)
    small, large = sources.scan_files(spark, str(tmp_path), [".ts", ".py"], ["node_modules"], max_kb=2)
    assert rows(small, "path", "content") == [("a.ts", "x"), ("sub/b.py", "é")] and rows(large, "path") == [("big.ts",)]


def test_engine_round_trip(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    engine.create_agent("repo", "Repo", ["x"])
    engine.create_agent("other", "Other")
    code = queries.fixture(spark)
    engine.index("repo", code)
    engine.write_passages(spark.createDataFrame([("other", "1", "FILE: z.ts\n\nhelper helper helper")], "agent_id string, id string, text string"))
    asked = spark.createDataFrame([(1, "helper function"), (2, "")], "query_id int, query string")
    found = engine.search("repo", asked, 5)
    assert {r.id.split("#")[0] for r in found.where("query_id = 1 and rank = 1").collect()} == {"src/lib/b.ts"}
    assert {r.agent_id for r in engine.passages.collect()} == {"repo", "other"} and engine.search("repo", asked, 0).count() == 0
    assert {json.loads(engine.search_tool("repo", "helper"))[0]["file_path"]} == {"src/lib/b.ts"}
    assert rows(engine.search_legs("repo", asked, 3).select("leg").distinct()) == [("fused",), ("lexical",), ("vector",)]
    before = engine.passages.where("agent_id = 'repo'").count()
    changed = spark.createDataFrame([("src/d.js",), ("svc/util.py",)], "path string")
    files = spark.createDataFrame([("svc/util.py", "def fresh():\n    pass\n", 1.0)], "path string, content string, size_kb double")
    plan = engine.sync("repo", changed, files, sync.content_hashes(code))
    assert rows(plan, "path", "action") == [("src/d.js", "removed"), ("svc/util.py", "reindexed")]
    kept = [r.text for r in engine.passages.where("agent_id = 'repo'").collect()]
    assert len(kept) < before and any("fresh" in t for t in kept) and not any("Thing" in t for t in kept)
    engine.set_block("repo", "arch", "v1")
    engine.set_block("repo", "arch", "v2")
    assert engine.block("repo", "arch") == "v2" and engine.block("repo", "none") == ""
    assert engine.read_passage("other", "1").startswith("FILE: z.ts")
    engine.delete_agent("other")
    with pytest.raises(KeyError):
        engine.read_passage("other", "1")
    assert [r.agent_id for r in engine.agents.collect()] == ["repo"]


def test_a_declared_method_is_no_call():
    _, refs = symbols.parse("d.js", "class T {\n  go() { return this.stop(); }\n  stop() {}\n}\n")
    assert [(r[3], r[4]) for r in refs if r[0] == "call"] == [("stop", "this")]


def test_store_versions(spark, tmp_path):
    from sparkloom.sources.store import Table

    t = Table(spark, str(tmp_path / "t"), "a string, k string, n int", ["a", "k"])
    assert t.read().count() == 0
    put = lambda *r: t.put(spark.createDataFrame(list(r), "a string, k string, n int"))
    put(("x", "1", 1), ("y", "1", 1))
    put(("x", "1", 2), ("x", "2", 2))
    assert rows(t.read()) == [("x", "1", 2), ("x", "2", 2), ("y", "1", 1)]
    t.remove(spark.createDataFrame([("x", "2"), ("z", "9")], "a string, k string"))
    put(("x", "2", 5))
    assert rows(t.read(F.col("a") == "x")) == [("x", "1", 2), ("x", "2", 5)]
    t.compact()
    assert rows(t.read()) == [("x", "1", 2), ("x", "2", 5), ("y", "1", 1)]
    # a write that ends before its pointer leaves the last version; the next write of that number replaces it
    spark.createDataFrame([("y", "7", 7)], "a string, k string, n int").write.partitionBy("a").parquet(str(tmp_path / "t/rows/v=6"))
    assert t.read().count() == 3
    put(("y", "8", 8))
    assert rows(t.read(F.col("a") == "y")) == [("y", "1", 1), ("y", "8", 8)]
    with pytest.raises(Exception, match="(?i)exist"):  # two writers of one version
        t._commit(None, spark.createDataFrame([("y", "8")], "a string, k string"), {"version": 5, "rows": [], "gone": []})


def test_git_changes(spark, tmp_path):
    import subprocess

    from sparkloom.sources import git

    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init")
    (tmp_path / "a.py").write_text("1")
    run("add", ".")
    run("commit", "-m", "first one")
    start = git.head(str(tmp_path))
    (tmp_path / "é.py").write_text("2")
    (tmp_path / "b.md").write_text("2")
    run("add", ".")
    run("commit", "-m", "second")
    repo = str(tmp_path)
    assert rows(git.diff(spark, repo, start)) == [("b.md",), ("é.py",)] and git.diff(spark, repo, "nothing") is None
    assert git.diff(spark, repo, git.head(repo)).count() == 0 and git.exists(repo, start) and not git.exists(repo, "0" * 40) and git.head("/") is None
    assert rows(git.log(spark, repo, most=1).where("status is not null"), "subject", "status", "path") == [("second", "A", "b.md"), ("second", "A", "é.py")]
    assert git.log(spark, repo, start=start).select("commit").distinct().count() == 1 and git.log(spark, "/").count() == 0
    python = lambda p: p.endswith(".py")
    assert rows(git.changes(spark, repo, start, python)) == [("é.py",)]
    events = spark.createDataFrame([("a.py",), ("a.py",), ("b.md",)], "path string")
    assert rows(git.changes(spark, repo, start, python, events=events)) == [("a.py",)]
    assert git.changes(spark, repo, None, python, files=events).count() == 3
    with pytest.raises(git.OrphanedCheckpoint):
        git.changes(spark, repo, "0" * 40, python)


def test_engine_reports(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), chunk=lambda files: files.select(F.col("path").alias("source_path"), F.lit(0).alias("chunk_no"), F.concat(F.lit("FILE: "), "path", F.lit("\n\n"), "content").alias("text")))
    engine.create_agent("a", "A")
    engine.create_agent("b", "B")
    code = spark.createDataFrame([("x.py", "def go():\n    stop()\n\n\ndef stop():\n    pass\n", 1.0), ("y.py", "größe = 1", 1.0)], "path string, content string, size_kb double")
    engine.index("a", code)
    engine.memory_replace("a", "architecture", "12345")
    with pytest.raises(ValueError):
        engine.memory_replace("a", "persona", "no")
    engine.save_state("a", last_sync_commit="abc")
    engine.save_state("a", last_sync_at="now")
    got = engine.status("a").first()
    assert (got.passages, got.blocks, got.last_sync_commit, got.last_sync_at, got.last_bootstrap) == (2, {"architecture": 5}, "abc", "now", None)
    assert got.report == "A:\n  agent: a\n  passages: 2\n  memory blocks:\n    architecture: 5 chars\n  last bootstrap: never\n  last sync: abc\n  last sync at: now\n  last consolidated at: never"
    assert rows(engine.stats(), "agent_id", "passages", "files", "blocks") == [("a", 2, 2, 1), ("b", 0, 0, 0)]
    assert rows(engine.check(spark.createDataFrame([("a",), ("c",)], "repo string"))) == [("b", "state without configuration"), ("b", "state without store"), ("c", "configuration without state")]
    engine.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().markdown.startswith("## architecture")
    assert engine.read_file(code, "x.py", 2, 2).first().content == "    stop()" and rows(engine.glob(code, [".py"], "*.py")) == [("x.py", False), ("y.py", False)]
    assert [r.line for r in engine.find_symbol(code, "stop").collect()] == [5]
    asked = spark.createDataFrame([(1, "grosse"), (2, "größe")], "query_id int, query string")
    assert {r.query_id for r in engine.search_legs("a", asked).where("leg = 'lexical'").collect()} == set()
    asked = spark.createDataFrame([(1, "große x")], "query_id int, query string").limit(0)
    assert engine.search("a", asked).count() == 0
    engine.compact()
    assert engine.passages.count() == 2
    events = tmp_path / "events"
    spark.createDataFrame([("a", "y.py"), ("b", "y.py")], "repo string, path string").write.json(str(events))
    stream = spark.readStream.schema("repo string, path string").json(str(events))
    engine.stream("a", stream, lambda: code.where("path = 'x.py'"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert rows(engine.passages, "file_path") == [("x.py",)]
    assert engine.has_agent("a") and not engine.has_agent("z")


def test_reports_for_readers(spark):
    from sparkloom.functions import text

    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.audit_line(F.lit(2), F.lit("FILE: a.ts | FUNCTION: f\n\nbody  here"), F.lit(0.5))) == "  2. a.ts score=0.500\n     body here"
    assert one(text.audit_line(F.lit(1), F.lit("no header"), F.lit(None))) == "  1. (unknown file)\n     no header"
    splice = lambda t: one(text.spliced(F.lit(t), F.lit("<s>new<e>"), "<s>", "<e>"))
    assert [splice(t) for t in (None, "a\n\n", "a <s>old<e> b", "a\n<s>old")] == ["<s>new<e>\n", "a\n\n<s>new<e>\n", "a <s>new<e> b", "a\n\n<s>new<e>\n"]
    drop = lambda t: one(text.without_splice(F.lit(t), "<s>", "<e>"))
    assert [drop(t) for t in ("a", "a\n\n<s>x<e>\nb", "<s>x<e>\nb", "a\n<s>x<e>\n")] == ["a", "a\n\nb", "b", "a\n"]
    assert one(sync.sync_line(F.lit("r"), F.lit(None).cast("string"), F.lit("0123456789"), F.lit(3), F.lit(1250))) in ("[r] synced initial..0123456 (3 files, 1.3s)", "[r] synced initial..0123456 (3 files, 1.2s)")
    checks = spark.createDataFrame([("pass",), ("warn",)], "status string")
    assert tuple(sync.doctor(checks).first()) == (1, 0) and tuple(sync.doctor(checks, strict=True).first()) == (1, 1)
    hits = spark.createDataFrame([("a", 1, "xx"), ("a", 2, "yy"), ("b", 1, "z")], "path string, line int, text string")
    assert [(r.path, r.line, r.truncated) for r in lines.within_chars(hits, 13).collect()] == [("a", 1, True), ("a", 2, True)]
    assert lines.within_chars(hits).where("truncated").count() == 0 and lines.within_chars(hits).count() == 3
    out = sync.numbered(spark.range(1000, numPartitions=7).select(F.col("id").alias("v"))).collect()
    assert sorted(r.seq for r in out) == list(range(1, 1001)) and all(r.seq == r.v + 1 for r in out)


def test_definitions_in_order(spark):
    defs = symbols.definitions(queries.fixture(spark))
    assert [r.name for r in graph.symbols_in_file(defs, "src/d.js").collect()] == ["Thing", "go", "stop"]
    ranks = spark.createDataFrame([("def:svc/util.py#save@5", 0.5)], "id string, rank double")
    got = [(r.path, r.line) for r in graph.ranked_symbols(defs, ranks).orderBy("place").collect()]
    assert got[0] == ("svc/util.py", 5) and got[1:] == sorted(got[1:]) and len(got) == defs.count()


def test_declarations_over_several_lines():
    names = lambda path, text: {(s[0], s[1]) for s in symbols.parse(path, text)[0]}
    js = "export class K {\n  async run(\n    a: number,\n    b = { c: 1 },\n  ): Promise<void> {\n    go(a);\n  }\n  plain(\n    a: number,\n  ): void {\n  }\n}\nexport const f = (\n  a: number,\n  b: string,\n): string => a + b;\n"
    assert {("CLASS", "K"), ("METHOD", "plain"), ("CONST", "f")} <= names("k.ts", js)
    assert ("METHOD", "go") in names("B.java", "public class B {\n  public void go(\n      int x,\n      int y) {\n  }\n}\n")
    assert ("METHOD", "Go") in names("B.cs", "public class B {\n  public void Go(\n      int x,\n      int y)\n  {\n  }\n}\n")
    go = symbols.parse("a.go", "package a\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB int\n)\n")[0]
    assert {(s[0], s[1], s[3]) for s in go} == {("TYPE", "A", 11), ("TYPE", "B", 11)}
    refs = symbols.parse("m.py", "import a.b, c\nimport d.e as f\n")[1]
    assert [(r[1], r[2]) for r in refs] == [("a.b", [("b", "*")]), ("d.e", [("f", "*")])]


def test_intermediate_tables_can_be_cleared(spark):
    import pathlib

    from sparkloom import storage

    table = storage.kept(spark.range(3), "three")
    assert table.count() == 3 and storage.small(table).count() == 3
    folder = pathlib.Path(storage.shared_root(spark).removeprefix("file:"))
    assert any(p.name.startswith("three-") for p in folder.iterdir())
    storage.clear(spark)
    assert not folder.exists()


def test_blocks_in_a_folder_and_aliases_of_a_repository(spark, tmp_path):
    blocks = spark.createDataFrame([("arch", "now", None, "one\n\ntwo"), ("conv", "then", "abc", "x")], "label string, updated_at string, source_commit string, value string")
    sources.save_blocks(blocks, str(tmp_path / "m"))
    assert {tuple(r) for r in sources.load_blocks(spark, str(tmp_path / "m")).collect()} == {tuple(r) for r in blocks.collect()}
    config = '{"compilerOptions": {"paths": {"@a/*": ["lib/*"]}}}'
    files = spark.createDataFrame([("web/jsconfig.json", config.replace("lib", "js")), ("web/tsconfig.json", config), ("app/jsconfig.json", config)], "path string, content string")
    assert rows(sources.repository_aliases(files, "web"), "target") == [("web/lib/*",)] and rows(sources.repository_aliases(files, "app"), "target") == [("app/lib/*",)]
    assert sources.repository_aliases(files).count() == 0
