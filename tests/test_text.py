import posixpath
import tracemalloc

import hypothesis.strategies as st
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from sparkloom.functions import paths, text
from sparkloom.operators import chunking, lines, search
from sparkloom.sources.files import plain_json


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_test_paths(spark):
    yes = ["pkg/server_test.go", "app/PaymentSpec.kt", "test/helpers.ts", "a/__tests__/x.js", "App.spec.tsx", "test_x.py", "conftest.py", "src\\tests\\a.py", "FooTests.cs"]
    no = ["src/Latest.java", "src/contest.ts", "src/latest/config.ts", "testing/a.py", "mytest_x.py"]
    assert column(spark, yes + no, paths.test_path) == [True] * len(yes) + [False] * len(no)


def test_include_and_agent_path(spark):
    files = ["a.ts", "a.TS", "x/node_modules/a.ts", "noext", "dir.ts/file", "node_modules.ts"]
    assert column(spark, files, lambda c: paths.include_file(c, F.lit(1024.0), [".ts"], ["node_modules"])) == [True, False, False, False, False, True]
    assert column(spark, ["./pkg/a.ts", "pkg", "pkg\\b.ts", "pkgs/a", "./pkg/"], lambda c: paths.agent_path(c, "pkg/")) == ["a.ts", None, "b.ts", None, None]
    assert column(spark, ["./a/", "", None], lambda c: paths.agent_path(c)) == ["a", None, None]


def test_like_prefix(spark):
    assert column(spark, ["SRC/a_b", "src/axb", "src/ab", "s%"], lambda c: paths.like_prefix(c, "src/a_")) == [True, True, True, False]


def test_safe_names(spark):
    assert paths.safe_path("/r", "a/../b") == "/r/b"
    for bad in ("", " ", "/etc", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            paths.safe_path("/r", bad)
    assert column(spark, ["a.b-c"], paths.safe_segment) == ["a.b-c"]
    with pytest.raises(Exception, match="unsafe"):
        column(spark, [".."], paths.safe_segment)


def test_gitignore_order(spark):
    rules = lambda *p: spark.createDataFrame(list(enumerate(p)), "line_no int, pattern string")
    files = spark.createDataFrame([(".claude.json",), ("a/b.json",), ("build",), ("build/x",)], "path string")
    got = lambda *p: {r.path: r.ignored for r in lines.gitignored(files, rules(*p)).collect()}
    assert got("*.json", "!.claude.json", "build/") == {".claude.json": False, "a/b.json": True, "build": False, "build/x": True}
    assert got("!.claude.json", "*.json")[".claude.json"] is True
    assert set(got("# none", " ").values()) == {False}


def test_headers(spark):
    texts = ["FILE: a.ts | FUNCTION: f (continued)\n\nbody", "FILE: a.ts\nx", "no header", "FILE: \nx", "FILE: a (continued)"]
    assert column(spark, texts, text.source_path) == ["a.ts | FUNCTION: f", "a.ts", None, None, "a"]
    assert column(spark, texts, text.budget_path) == ["a.ts", "a.ts", None, None, "a"]
    assert column(spark, ["FILE: p\n\n a  b\n c "], text.snippet) == ["a b c"]
    assert column(spark, ["abcdef", "ab"], lambda c: text.truncated(c, 3)) == ["ab…", "ab"]
    assert column(spark, ["'./auth/session.ts'", "react", "a\\b.x"], text.module_basename) == ["session", "react", "b"]


def test_windows(spark):
    def one(value, *args):
        return spark.createDataFrame([(value,)], "t string").select(lines.window("t", *args).alias("w")).first().w

    w = one("one\ntwo\nthree\nfour", 2, 3)
    assert (w.content, w.total_lines, w.truncated) == ("two\nthree", 4, False)
    w = one("first line\nsecond line\nthird", 1, 3, 18)
    assert (w.content, w.end_line, w.truncated) == ("first line…", 1, True)
    assert one("abc", 9, 1).start_line == 1 and one("abcdef", 1, 1, 1).content == "…"


def test_terms(spark):
    assert column(spark, ["NEAR(a b)", "foo*", "-bar", "café"], text.query_terms) == [["NEAR", "a", "b"], ["foo"], ["bar"], ["caf"]]
    assert text.task_prefix("nomic-embed-text", "query") == "search_query: " and text.task_prefix("x", "query") == ""
    vector = column(spark, ["Alpha alphabet beta", ""], text.stub_embedding)
    assert abs(sum(x * x for x in vector[0]) - 1) < 1e-9 and len([x for x in vector[0] if x]) == 2 and not any(vector[1])


paragraph = st.text(alphabet="ab \n\t", max_size=60)


@settings(max_examples=300, deadline=None)
@given(paragraph, st.integers(20, 60))
def test_chunks_fit_and_lose_nothing(content, most):
    made = list(chunking.chunk_text("H", content, most + 12))
    assert all(len(c) <= most + 12 for c in made)
    assert "".join(c.split("\n\n", 1)[1] if "\n\n" in c else "" for c in made).replace("\n", "").replace(" ", "").replace("\t", "") == "".join(content.split())


def test_chunk_edges():
    assert list(chunking.chunk_text("H", " \n \n")) == []
    header = "FILE: boundary.ts"
    assert len(list(chunking.chunk_text(header, "a" * 30 + "\n\n" + "b" * (100 - len(header) - 2 - 32), 100))) == 1
    assert len(list(chunking.chunk_text("FILE: split2.ts", "a" * 20 + "\n\n" + "b" * 30, 60))) == 2
    with pytest.raises(ValueError):
        list(chunking.chunk_text("FILE: " + "x" * 50, "abc", 40))


def test_globs_and_jsonc():
    import re

    assert re.match(paths.glob_regex("**/*.ts"), "a/b/c.ts") and re.match(paths.glob_regex("**/*.ts"), "c.ts")
    assert not re.match(paths.glob_regex("*.ts"), "a/c.ts") and re.match(paths.glob_regex("src/{a,b}?.py"), "src/ax.py")
    assert plain_json('{"a": "//x", /* c */ "b": [1, 2,], // d\n}').split() == '{"a": "//x", "b": [1, 2] }'.split()
    assert posixpath.normpath("a") == "a"


def test_fusion_order(spark):
    hits = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, id string, rank int")
    got = [(r.id, r.score) for r in search.rrf({"vector": hits("abc")}, 60, None).orderBy("rank").collect()]
    assert got == [("a", 1 / 61), ("b", 1 / 62), ("c", 1 / 63)]
    fused = search.rrf({"vector": hits("ab"), "lexical": hits("cd")}, 60, None).orderBy("rank").collect()
    assert [r.id for r in fused] == ["a", "c", "b", "d"]
    with pytest.raises(ValueError):
        search.rrf({"vector": hits("a"), "lexical": hits("b")}, 10, {"vector": 1.0})


def test_bm25_equals_full_text_search(spark):
    import sqlite3

    texts = ["the cat sat", "the dog sat on the cat", "a bird", "cat cat cat", ""]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize = \"unicode61 tokenchars '_'\")")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "id int, text string")
    for q in ("cat", "the the cat", "bird sat", "nothing"):
        terms = q.split()
        want = {r[0]: -r[1] for r in db.execute("select rowid, bm25(t) from t where t match ?", (" OR ".join(f'"{x}"' for x in terms),))}
        queries = spark.createDataFrame([(1, q)], "query_id int, query string")
        got = {r.id: r.score for r in search.bm25(search.postings(docs), queries, 10).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_budget_and_demotion(spark):
    names = ["a", "a", "b", "a", "tests/c"]
    rows = [(1, i, f"FILE: {n}.ts | FUNCTION: f{' (continued)' if i == 1 else ''}\n\nx", i + 1, 1.0 / (i + 1)) for i, n in enumerate(names)]
    results = spark.createDataFrame(rows, "query_id int, id int, text string, rank int, score double")
    kept = search.budgeted(results, 3, 2, 100).orderBy("place").collect()
    assert [r.id for r in kept] == [0, 1, 2]
    order = search.demoted(search.budgeted(results.where("id <> 1"), 4, 2, 100)).orderBy("position").collect()
    assert [r.id for r in order] == [0, 2, 3, 4]


def test_vectors_take_little_memory_beside_their_texts():
    texts = pa.array(["Alpha beta_9 gamma " * 2000, None, "", "x " * 200_000, "é" * 5] * 20).fill_null("")
    whole = text.stem_counts(texts.slice(0, 5), 64)
    tracemalloc.start()
    got = text.unit_vectors(texts, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = np.sqrt((whole * whole).sum(1, keepdims=True))
    assert np.array_equal(got.flatten().to_numpy().reshape(-1, 64), np.tile(np.divide(whole, size, out=np.zeros_like(whole), where=size > 0), (20, 1)))
    assert peak < 60_000_000
