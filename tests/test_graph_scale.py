import collections

from sparkloom.operators import graph, symbols
from sparkloom.sources import files as sources

DEFS = "path string, qualified string, name string, owner string, kind string, line int, pos int"
REFS = "ref_id long, path string, kind string, module string, names array<struct<local: string, name: string>>, callee string, object string"
FILES = "path string"


def test_tiers_take_what_is_left_and_hot_names_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_NAME", 50)
    many = [(f"d{i}.py", "run" if i % 2 else f"T{i}.run", "run", None if i % 2 else f"T{i}", "FUNCTION" if i % 2 else "METHOD", 1, 0) for i in range(1000)]
    own = [("a.py", "run", "run", None, "FUNCTION", 5, 0), ("lib.py", "help", "help", None, "FUNCTION", 1, 0), ("lib.py", "Box", "Box", None, "CLASS", 3, 1), ("lib.py", "Box.put", "put", "Box", "METHOD", 4, 2), ("x.py", "put", "put", None, "FUNCTION", 9, 0)]
    call = lambda i, path, callee, object=None: (i, path, "call", None, None, callee, object)
    refs = [
        (0, "b.py", "import", ".lib", [("help", "help"), ("B", "Box"), ("all", "*")], None, None), call(1, "a.py", "run"), call(2, "b.py", "run"), call(3, "b.py", "run"), call(4, "b.py", "help"), call(5, "b.py", "put", "B"),
        call(6, "b.py", "help", "all"), call(7, "c.py", "run", "T4"), call(8, "c.py", "put"), call(9, "c.py", "nothing"),
    ]
    files = spark.createDataFrame([(p,) for p in ("a.py", "b.py", "c.py", "lib.py")], FILES)
    got = graph.symbol_edges(spark.createDataFrame(many + own, DEFS), spark.createDataFrame(refs, REFS), files).where("kind = 'call'").collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.src].add(r.dst)
    assert len(got) == sum(map(len, by.values()))
    d = lambda x: f"def:{x[0]}#{x[1]}@{x[5]}"
    assert by["file:a.py"] == {d(own[0])}
    # a name alone: all definitions of that qualified name, and no methods, since the tier before takes the call
    assert by["file:b.py"] == {d(x) for x in many if x[1] == "run"} | {d(own[0]), d(own[1]), d(own[3])}
    assert by["file:c.py"] == {"def:d4.py#T4.run@1", d(own[4])}


def test_a_method_name_alone_binds_to_all_of_that_name(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_NAME", 7)
    defs = [(f"d{i}.py", f"T{i}.go", "go", f"T{i}", "METHOD", i, 0) for i in range(60)]
    refs = [(i, f"c{i}.py", "call", None, None, "go", None if i % 2 else "thing") for i in range(6)]
    got = graph.symbol_edges(spark.createDataFrame(defs, DEFS), spark.createDataFrame(refs, REFS), spark.createDataFrame([("c1.py",)], FILES)).collect()
    assert len(got) == 360 and {r.dst for r in got} == {f"def:d{i}.py#T{i}.go@{i}" for i in range(60)}


def test_aliases_by_repository(spark):
    files = spark.createDataFrame([("r", "src/a/x.ts"), ("r", "src/b/x.ts"), ("r", "one.ts"), ("s", "lib/x.py"), ("s", "src/a/x.ts")], "repo string, path string")
    imports = [("r", "m.ts", m) for m in ("@/x", "@/a/x", "one", "pre-x-post", "pre-post", "**", "none/x")] + [("s", "m.py", "@/x"), ("s", "m.py", "@/a/x"), ("t", "m.ts", "@/x")]
    rules = [("r", 2, "@/*", "src/b/*"), ("r", 1, "@/*", "src/*"), ("r", 3, "one", "./one"), ("r", 0, "pre-*-post", "src/a/*"), ("r", 4, "*", "nowhere/*"), ("s", 0, "@/*", "lib/*"), ("s", 1, "@/a/x", "src/a/x.ts")]
    got = graph.resolved_modules(spark.createDataFrame(imports, "repo string, path string, module string"), files, spark.createDataFrame(rules, "repo string, ord int, pattern string, target string"))
    assert sorted(map(tuple, got.collect())) == [("r", "m.ts", "@/a/x", "src/a/x.ts"), ("r", "m.ts", "@/x", "src/b/x.ts"), ("r", "m.ts", "one", "one.ts"), ("r", "m.ts", "pre-x-post", "src/a/x.ts"), ("s", "m.py", "@/a/x", "src/a/x.ts"), ("s", "m.py", "@/x", "lib/x.py")]


def test_very_many_lengths_of_aliases(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_LENGTHS", 2)
    files = spark.createDataFrame([(f"f{i}.ts",) for i in range(6)], "path string")
    rules = spark.createDataFrame([(i, "p" * i + "/*", "*") for i in range(6)], "ord int, pattern string, target string")
    imports = spark.createDataFrame([("m.ts", "p" * i + f"/f{i}") for i in range(6)], "path string, module string")
    assert {r.target for r in graph.resolved_modules(imports, files, rules).collect()} == {f"f{i}.ts" for i in range(6)}


def test_configurations_of_many_repositories(spark):
    texts = [
        '{"compilerOptions": {"baseUrl": "src", /* x */ "paths": {"@a/*": ["lib/*", "./own/*"], "bad": 1,}}}', '{"compilerOptions": {"paths": {"z": ["1"], "a": ["//2", 3, null, ""], "m, }": ["/x", "y\\"q, ]"]}}, // end\n}',
        '{"compilerOptions": {"paths": {}}}', "{}", "no json", '{"compilerOptions": null}',
    ]
    configs = spark.createDataFrame([(f"r{i}", "web", t) for i, t in enumerate(texts)] + [("none", "web", None)], "repo string, folder string, content string")
    got = sorted(map(tuple, sources.configured_aliases(configs).collect()))
    want = []
    for i, t in enumerate(texts):
        if t.startswith("{") and "null}" not in t:
            want += [(f"r{i}", r.ord, r.pattern, r.target) for r in sources.path_aliases(spark, t, "web").collect()]
    assert got == sorted(want) and len(got) == 6


def test_stars_take_the_first_place(spark):
    files = spark.createDataFrame([("x/b*.ts",), ("y.ts",), ("plain.ts",)], "path string")
    rules = spark.createDataFrame([(0, "a*c*", "x/*"), (1, "pre-*-post", "y/*"), (2, "exact", "pl*ain")], "ord int, pattern string, target string")
    imports = spark.createDataFrame([("m.ts", "ab*c*"), ("m.ts", "pre-post"), ("m.ts", "exact")], "path string, module string")
    assert {r.module: r.target for r in graph.resolved_modules(imports, files, rules).collect()} == {"ab*c*": "x/b*.ts", "pre-post": "y.ts", "exact": "plain.ts"}


def test_a_place_that_many_files_name_is_looked_up_once(spark, monkeypatch):
    rows, keep = {}, graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: [table := keep(df, name), rows.update({name: table.count()})][0])
    imports = spark.createDataFrame([(f"a/m{i}.ts", "./x") for i in range(300)] + [("a/p.py", ".x"), ("b/p.py", "a.x")], "path string, module string")
    got = graph.resolved_modules(imports, spark.createDataFrame([("a/x.ts",), ("a/x.js",), ("a/x.py",), ("a/x.ts",)], FILES)).collect()
    assert len(got) == 302 and {r.target for r in got} == {"a/x.ts"}
    assert rows["tried"] == 302 and rows["places"] == 1


def test_few_files_of_many_rows_are_parsed_by_many_tasks(spark, tmp_path):
    text = "class A:\n    def f(self):\n        pass\n\n\ndef é():\n    g()\n"
    spark.createDataFrame([(f"{i}.py", text) for i in range(400)], "path string, content string").coalesce(1).write.parquet(str(tmp_path / "files"))
    dealt = symbols.spread(spark.read.parquet(str(tmp_path / "files")))
    assert len([n for n in dealt.rdd.glom().map(len).collect() if n]) == 4 * spark.sparkContext.defaultParallelism
    found = symbols.definitions(dealt)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.where("path = '7.py'").select("qualified", "line", "end_line", "pos").collect()} == {("A", 1, 3, 0), ("A.f", 2, 3, 1), ("é", 6, 7, 2)}


def test_edges_bind_imports_once_and_stop_when_no_call_is_left(spark, monkeypatch):
    rows, tiers, keep, anywhere = {}, [], graph.kept, graph._anywhere
    monkeypatch.setattr(graph, "kept", lambda df, name: [table := keep(df, name), rows.update({name: table.count()})][0])
    monkeypatch.setattr(graph, "_anywhere", lambda calls, ids, name: [tiers.append(name), anywhere(calls, ids, name)][1])
    defs = [("lib.py", "help", "help", None, "FUNCTION", 1, 0), ("lib.py", "Box.put", "put", "Box", "METHOD", 4, 1)]
    refs = [(0, "b.py", "import", ".lib", [("help", "help"), ("m", "Box.put")], None, None), (1, "b.py", "call", None, None, "help", None)]
    tables = (spark.createDataFrame(defs, DEFS), spark.createDataFrame(refs, REFS), spark.createDataFrame([("b.py",), ("lib.py",)], FILES))
    got = sorted((r.dst, r.kind) for r in graph.symbol_edges(*tables).collect())
    assert got == [("def:lib.py#Box.put@4", "import"), ("def:lib.py#help@1", "call"), ("def:lib.py#help@1", "import")]
    assert rows["targets"] == 2 and rows["calls-left"] == 0 and not tiers


def test_contexts_need_no_definitions(spark, monkeypatch):
    from sparkloom.plans import queries

    monkeypatch.setattr(symbols, "definitions", lambda files: 1 / 0)
    assert queries.QUERIES["file_contexts"](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_the_graph_parses_each_file_once(spark, monkeypatch):
    from sparkloom.plans import queries

    code = queries.fixture(spark)
    want = [sorted(map(str, t.collect())) for t in (symbols.definitions(code), symbols.references(code))]
    parsed, run = [], symbols._extract
    monkeypatch.setattr(symbols, "_extract", lambda want: [parsed.append(want), run(want)][1])
    monkeypatch.setattr(queries, "code", lambda spark, sf_dir: code)
    defs, refs, *_ = queries._graph(spark, "")
    assert [sorted(map(str, t.collect())) for t in (defs, refs)] == want and all(want)
    assert len(parsed) == 1


def test_links_are_the_imports_and_exports_of_references(spark, monkeypatch):
    from sparkloom.plans import queries

    more = [
        ("m.go", 'package m\nimport (\n\tx "a/b"\n\t"c/d"\n)\nfunc f() { x.g() }\n'), ("e.ts", "export { a as b, c };\nexport * from './q';\nexport default class K {\n  m() { n(); }\n}\nimport './side';\n"),
        ("p.py", "import a.b as c\nfrom ..d import e as f, g\n\n\nclass A:\n    def h(self):\n        import inner\n        return g()\n"), ("bad.py", "import a\ndef (:\n"), ("r.rs", "fn f() {}\n"), ("n.py", None), ("none", "import a\n"),
    ]
    code = queries.fixture(spark).union(spark.createDataFrame(more, "path string, content string"))
    got, every = sorted(map(str, symbols.links(code).collect())), symbols.references(code)
    assert got == sorted(map(str, every.where("kind <> 'call'").collect())) and len(got) < every.count()
    monkeypatch.setattr(symbols, "PATTERNS", {})
    monkeypatch.setattr(symbols.ast, "walk", lambda tree: 1 / 0)
    assert [len(symbols.parse(p, t, links_only=True)[1]) for p, t in more[:3]] == [2, 4, 2]


def test_contexts_shuffle_their_names_once_and_keep_nothing(spark, monkeypatch):
    from sparkloom.operators import chunking
    from sparkloom.plans import queries

    names = [(f"x{i}", f"x{i}") for i in range(30)]
    refs = [(0, "a.ts", "import", "./lib/b", [("h", "help"), ("B", "default"), ("all", "*")], None, None), (1, "a.ts", "import", "./lib/b", [("h", "help")], None, None), (2, "a.ts", "export", None, [("é", "é"), ("Z", "Z"), ("a", "a"), ("*", "*")], None, None)]
    refs += [(3, "b.ts", "export", None, names, None, None), (4, "c.ts", "call", None, None, "run", None), (5, "d.ts", "export", None, [("*", "*")], None, None)]
    made = chunking.file_contexts(spark.createDataFrame(refs, REFS), max_chars=60)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    first = "CONTEXT | exports: " + ", ".join(sorted(n for n, _ in names))
    assert sorted(map(tuple, made.collect())) == [("a.ts", "CONTEXT | imports: all, b, B, help | exports: a, é, Z"), ("b.ts", first[:60])]
    wants, run = [], symbols._extract
    monkeypatch.setattr(symbols, "_extract", lambda want: [wants.append(want), run(want)][1])
    monkeypatch.setattr(queries, "kept", lambda df, *name: 1 / 0)
    assert queries.QUERIES["file_contexts"](spark, "/root/testdata/sf0.001").limit(1).count() == 1 and wants == ["links"]
