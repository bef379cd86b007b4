"""Symbols and references of source files: Python by its syntax tree, other languages by declared patterns.

Patterns find top-level declarations and one level of members by their indentation or braces; they stand
in for full parsers, and what they miss is left to the residue chunks, so no text is lost.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import symbol_header
from ..storage import kept
from .chunking import chunks, gaps, merge_intervals

SPAN = "path string, kind string, name string, owner string, start int, end int, pos int"
REF = "ref_id string, path string, kind string, module string, names array<struct<local:string,name:string>>, callee string, object string, start int"
BOTH = f"part string, {SPAN}, line int, end_line int, ref_id string, module string, names array<struct<local:string,name:string>>, callee string, object string"
_ID = r"[A-Za-z_$][\w$]*"
# Declarations by language: (kind, pattern). A name is the group n, a method's owner the group o.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "js": [("FUNCTION", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(?P<n>{_ID})"), ("CLASS", rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>{_ID})"), ("INTERFACE", rf"^(?:export\s+)?interface\s+(?P<n>{_ID})"), ("TYPE", rf"^(?:export\s+)?type\s+(?P<n>{_ID})\s*[=<]"), ("ENUM", rf"^(?:export\s+)?(?:const\s+)?enum\s+(?P<n>{_ID})"), ("CONST", rf"^(?:export\s+)?(?:const|let|var)\s+(?P<n>{_ID})[^=\n]*=(?:[^\n]*=>|\s*(?:async\s*)?\([^()]*\)[^;{{}}=\n]*=>)")],
    "go": [("METHOD", r"^func\s+\(\w*\s*\*?(?P<o>\w+)[^)]*\)\s+(?P<n>\w+)"), ("FUNCTION", r"^func\s+(?P<n>\w+)"), ("TYPE", r"^type\s+(?P<n>\w+)")],
    "java": [("CLASS", r"^(?:(?:public|abstract|final|sealed)\s+)*(?:class|record)\s+(?P<n>\w+)"), ("INTERFACE", r"^(?:(?:public|sealed)\s+)*interface\s+(?P<n>\w+)"), ("ENUM", r"^(?:public\s+)?enum\s+(?P<n>\w+)")],
    "csharp": [("CLASS", r"^\s*(?:(?:public|internal|abstract|sealed|static|partial)\s+)*(?:class|record|struct)\s+(?P<n>\w+)"), ("INTERFACE", r"^\s*(?:(?:public|internal)\s+)*interface\s+(?P<n>\w+)"), ("ENUM", r"^\s*(?:(?:public|internal)\s+)*enum\s+(?P<n>\w+)")],
    "ruby": [("CLASS", r"^class\s+(?P<n>[\w:]+)"), ("MODULE", r"^module\s+(?P<n>[\w:]+)"), ("FUNCTION", r"^def\s+(?:self\.)?(?P<n>\w+[?!=]?)")],
    "rust": [("FUNCTION", r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<n>\w+)"), ("CLASS", r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"), ("ENUM", r"^(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("INTERFACE", r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<n>\w+)"), ("TYPE", r"^(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)"), ("MODULE", r"^(?:pub\s+)?mod\s+(?P<n>\w+)\s*\{")],
    "php": [("FUNCTION", r"^function\s+(?P<n>\w+)"), ("CLASS", r"^(?:abstract\s+|final\s+)?class\s+(?P<n>\w+)"), ("INTERFACE", r"^interface\s+(?P<n>\w+)"), ("MODULE", r"^trait\s+(?P<n>\w+)"), ("ENUM", r"^enum\s+(?P<n>\w+)")],
    "c": [("CLASS", r"^(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<n>\w+)[^;\n]*\{"), ("ENUM", r"^enum\s+(?:class\s+)?(?P<n>\w+)[^;\n]*\{"), ("TYPE", r"^typedef\b[^;\n]*\b(?P<n>\w+)\s*;"), ("FUNCTION", r"^(?!else|return|typedef)[A-Za-z_][\w\s*&<>:,]*?\b(?P<n>~?\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{")],
    "kotlin": [("FUNCTION", r"^(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?P<n>\w+)"), ("CLASS", r"^(?:\w+\s+)*(?:class|interface)\s+(?P<n>\w+)"), ("MODULE", r"^(?:\w+\s+)*object\s+(?P<n>\w+)"), ("TYPE", r"^typealias\s+(?P<n>\w+)")],
    "swift": [("FUNCTION", r"^(?:\w+\s+)*func\s+(?P<n>\w+)"), ("CLASS", r"^(?:\w+\s+)*(?:class|actor|extension|struct)\s+(?P<n>\w+)"), ("ENUM", r"^(?:\w+\s+)*enum\s+(?P<n>\w+)"), ("INTERFACE", r"^(?:\w+\s+)*protocol\s+(?P<n>\w+)")],
}
# Languages by extension.
LANGUAGES = {".py": "python", ".ts": "js", ".tsx": "js", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".mts": "js", ".cts": "js", ".go": "go", ".java": "java", ".rb": "ruby", ".rs": "rust", ".php": "php", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".hpp": "c", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift"}
_MEMBER = {
    "js": rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<n>#?{_ID})\s*(?:<[^>\n]*>)?\((?:[^;\n]*\)[^;\n]*|[^;{{}}]*\)[^;\n{{}}]*)\{{",
    "java": r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ?]+\s+(?P<n>\w+)\s*\((?:[^;\n]*\)[^;\n]*|[^;{}]*\)[^;\n{}]*)\{",
    "csharp": r"^[ \t]+(?:(?:public|private|protected|internal|static|override|virtual|async)\s+)+[\w<>\[\], ?]+\s+(?P<n>\w+)\s*\([^;{}]*\)",
    "ruby": r"^[ \t]+def\s+(?:self\.)?(?P<n>\w+[?!=]?)",
    "rust": r"^[ \t]+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<n>\w+)",
    "php": r"^[ \t]+(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+(?P<n>\w+)",
    "c": r"^[ \t]+(?!return|if|for|while|switch|else)[\w\s*&<>:,~]*?\b(?P<n>~?\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{",
    "kotlin": r"^[ \t]+(?:\w+\s+)*fun\s+(?P<n>\w+)",
    "swift": r"^[ \t]+(?:\w+\s+)*(?:func\s+(?P<n>\w+)|(?P<i>init|deinit)\b)",
}
_OWNERS = {"CLASS", "MODULE", "ENUM", "INTERFACE"}


def _language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get("." + name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _end(text: str, start: int, language: str) -> int:
    """Where a declaration ends: its closing brace, its ``end``, or its line."""
    line_end = text.find("\n", start)
    line_end = len(text) if line_end < 0 else line_end
    if language == "ruby":
        indent = re.match(r"[ \t]*", text[text.rfind("\n", 0, start) + 1 :]).group()
        m = re.compile(rf"^{indent}end\b", re.M).search(text, start)
        return m.end() if m else line_end
    brace = text.find("{", start)
    semicolon = text.find(";", start)
    if brace < 0 or (0 <= semicolon < brace) or (language in ("kotlin", "swift") and brace > line_end):
        return line_end
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, brace):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _python(text: str, links_only: bool = False):
    tree = ast.parse(text)
    lines = [0]
    for line in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(line))
    raw = text.splitlines(keepends=True)

    def at(line, column):
        return lines[line - 1] + len(raw[line - 1].encode()[:column].decode(errors="ignore")) if line <= len(raw) else lines[-1]

    spans, refs = [], []

    def span(node, kind, owner=None):
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        begin = at(first, 0) if first < node.lineno else at(node.lineno, node.col_offset)
        spans.append((kind, node.name, owner, begin, at(node.end_lineno, node.end_col_offset)))

    for node in tree.body:
        if links_only and not isinstance(node, (ast.Import, ast.ImportFrom)):
            continue
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            span(node, "FUNCTION")
        elif isinstance(node, ast.ClassDef):
            span(node, "CLASS")
            for member in node.body:
                if isinstance(member, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    span(member, "METHOD", node.name)
        elif isinstance(node, ast.Import):
            a = node.names[0]  # one name a statement counts; "import a.b" binds b
            refs.append(("import", a.name, [(a.asname or a.name.split(".")[-1], "*")], None, None, at(node.lineno, node.col_offset)))
        elif isinstance(node, ast.ImportFrom):
            names = [(a.asname or a.name, a.name) for a in node.names]
            refs.append(("import", "." * node.level + (node.module or ""), names, None, None, at(node.lineno, node.col_offset)))
    for node in () if links_only else ast.walk(tree):
        if isinstance(node, ast.Call):
            f, place = node.func, at(node.lineno, node.col_offset)
            if isinstance(f, ast.Name):
                refs.append(("call", None, None, f.id, None, place))
            elif isinstance(f, ast.Attribute):
                refs.append(("call", None, None, f.attr, f.value.id if isinstance(f.value, ast.Name) else None, place))
    return spans, refs


def _patterned(text: str, language: str):
    spans = []
    taken: set[int] = set()
    named: set[int] = set()  # where members are declared: a name before a bracket, but no call
    for kind, pattern in PATTERNS[language]:
        for m in re.compile(pattern, re.M).finditer(text):
            if m.start() in taken:
                continue
            taken.add(m.start())
            owner = m.groupdict().get("o")
            end = _end(text, m.start(), language)
            spans.append((kind, m.group("n"), owner, m.start(), end))
            if kind in _OWNERS and language in _MEMBER:
                for inner in re.compile(_MEMBER[language], re.M).finditer(text, m.end(), end):
                    name = inner.group("n") or inner.groupdict().get("i")
                    if name not in ("if", "for", "while", "switch", "catch", "return"):
                        begin = inner.start() + len(inner.group()) - len(inner.group().lstrip())
                        named.add(inner.start("n"))
                        spans.append(("METHOD", name, m.group("n"), begin, _end(text, begin, language)))
    if language == "go":  # a group's types each have the whole declaration
        for m in re.compile(r"^type\s*\((?P<b>.*?)^\)", re.M | re.S).finditer(text):
            depth = 0
            for line in m["b"].split("\n"):
                if not depth and (name := re.match(r"\s*(?P<n>[A-Za-z_]\w*)\s+\S", line)):
                    spans.append(("TYPE", name["n"], None, m.start(), m.end()))
                depth += line.count("{") + line.count("(") - line.count("}") - line.count(")")
    if language == "rust":
        for m in re.compile(r"^impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)", re.M).finditer(text):
            for inner in re.compile(_MEMBER["rust"], re.M).finditer(text, m.end(), _end(text, m.start(), "rust")):
                begin = inner.start() + len(inner.group()) - len(inner.group().lstrip())
                spans.append(("METHOD", inner.group("n"), m.group("n"), begin, _end(text, begin, "rust")))
    refs = _links(text, language)
    if language in ("js", "go"):
        words = {"if", "for", "while", "switch", "catch", "function", "return", "func", "typeof", "await"}
        for m in re.compile(r"(?:(?P<o>[\w$]+)\.)?(?P<c>[\w$]+)\s*\(").finditer(text):
            before = text[max(0, m.start() - 9) : m.start()]
            if m["c"] not in words and m.start("c") not in named and not re.search(r"(?:function\*?|func)\s+$", before):
                refs.append(("call", None, None, m["c"], m["o"], m.start()))
    return spans, refs


def _links(text: str, language: str):
    """Imports and exports, in the order of ``refs``, which has the calls after them."""
    refs = []
    if language == "js":
        for m in re.compile(r"^import\s+(?:type\s+)?(?:(?P<d>[\w$]+)\s*,?\s*)?(?:\*\s+as\s+(?P<s>[\w$]+)|\{(?P<n>[^}]*)\})?\s*(?:from\s*)?['\"](?P<m>[^'\"]+)['\"]", re.M).finditer(text):
            names = [(m["d"], "default")] if m["d"] else []
            names += [(m["s"], "*")] if m["s"] else []
            names += _pairs(m["n"])
            refs.append(("import", m["m"], names, None, None, m.start()))
        for m in re.compile(r"^export\s+(?:(?P<s>\*)|\{(?P<n>[^}]*)\}|(?P<d>default\s+)?(?:abstract\s+|async\s+|declare\s+)*(?:function\*?|class|interface|type|enum|const|let|var)\s+(?P<v>[\w$]+))", re.M).finditer(text):
            names = [("*", "*")] if m["s"] else [(m["v"], "default" if m["d"] else m["v"])] if m["v"] else _pairs(m["n"])
            refs.append(("export", None, names, None, None, m.start()))
    if language == "go":
        for m in re.compile(r"^(?:import\s+|\t)(?:(?P<a>[\w.]+)\s+)?\"(?P<m>[^\"\n]+)\"", re.M).finditer(text):
            refs.append(("import", m["m"], [(m["a"] or m["m"].rsplit("/", 1)[-1], "*")], None, None, m.start()))
    return refs


def _pairs(names: str | None) -> list[tuple[str, str]]:
    out = []
    for part in (names or "").split(","):
        words = part.replace("type ", "").split()
        if words:
            out.append((words[-1], words[0]))
    return out


def parse(path: str, content: str, links_only: bool = False):
    """``spans, refs`` of one file; nothing where it can't be parsed or the language is unknown. With ``links_only`` imports and exports alone."""
    language = _language(path)
    if language is None:
        return [], []
    try:
        if language == "python":
            return _python(content, links_only)
        return ([], _links(content, language)) if links_only else _patterned(content, language)
    except (SyntaxError, ValueError, RecursionError):
        return [], []


def _extract(want: str):
    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                spans, refs = parse(path, content or "", want == "links")
                if want in ("refs", "links", "both"):
                    found = [(f"{path}#{i}", path, r[0], r[1], None if r[2] is None else [{"local": a, "name": b} for a, b in r[2]], r[3], r[4], r[5]) for i, r in enumerate(refs)]
                    if want != "both":
                        rows += found
                        continue
                    rows += [("refs", r[1], r[2], None, None, r[7], None, None, None, None, r[0], *r[3:7]) for r in found]
                for i, s in enumerate(sorted(spans, key=lambda s: (s[3], -s[4]))):
                    lines = (content.count("\n", 0, s[3]) + 1, content.count("\n", 0, max(0, s[4] - 1)) + 1) if want in ("defs", "both") else ()
                    rows.append((path, *s, i, *lines) if want != "both" else ("defs", path, *s, i, *lines, None, None, None, None, None))
            names = pa.list_(pa.struct([("local", pa.string()), ("name", pa.string())]))
            s, n = pa.string(), pa.int32()
            own = [("path", s), ("kind", s), ("name", s), ("owner", s), ("start", n), ("end", n), ("pos", n)]
            ref = [("module", s), ("names", names), ("callee", s), ("object", s)]
            schema = pa.schema({"both": [("part", s), *own, ("line", n), ("end_line", n), ("ref_id", s), *ref], "spans": own, "defs": [*own, ("line", n), ("end_line", n)], "refs": [("ref_id", s), ("path", s), ("kind", s), *ref, ("start", n)]}["refs" if want == "links" else want])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def spread(files: DataFrame) -> DataFrame:
    """Files dealt over several rounds of tasks where few of Spark's files hold them: some MB of rows would be parsed by one task."""
    tasks = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(4 * tasks, "path") if len(files.inputFiles()) < 4 * tasks else files


def spans(files: DataFrame) -> DataFrame:
    """``path, kind, name, owner, start, end, pos``: symbol spans of files, half open, in characters."""
    return files.select("path", "content").mapInArrow(_extract("spans"), SPAN)


def references(files: DataFrame) -> DataFrame:
    """``ref_id, path, kind, module, names, callee, object, start``: imports, exports and calls."""
    return files.select("path", "content").mapInArrow(_extract("refs"), REF)


def links(files: DataFrame) -> DataFrame:
    """The imports and exports among ``references``, without looking for definitions or calls."""
    return files.select("path", "content").mapInArrow(_extract("links"), REF)


def definitions(files: DataFrame) -> DataFrame:
    """Spans with ``qualified``, ``line`` and ``end_line`` (from 1)."""
    return _qualified(files.select("path", "content").mapInArrow(_extract("defs"), f"{SPAN}, line int, end_line int"))


def _qualified(found: DataFrame) -> DataFrame:
    return found.select("path", "kind", "name", "owner", F.concat_ws(".", "owner", "name").alias("qualified"), "line", "end_line", "pos")


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``definitions`` and ``references`` of files that are parsed once, kept apart in one table."""
    both = files.select("path", "content").mapInArrow(_extract("both"), BOTH)
    table = kept(both, "parsed", "part")
    return _qualified(table.where("part = 'defs'")), table.where("part = 'refs'").select("ref_id", "path", "kind", "module", "names", "callee", "object", "start")


def symbol_chunks(files: DataFrame, max_chars: int = 2000) -> DataFrame:
    """``source_path, chunk_no, text``: a chunk list for each symbol, then for what no symbol covers; plain chunks without symbols.

    A file's chunks are numbered by the place they start at. Every letter and digit is in one at least.
    """
    found = spans(files)
    body = found.join(files.select("path", "content"), "path").select("path", symbol_header("path", "kind", "name", "owner").alias("header"), F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("content"), "start")
    lengths = files.select("path", F.length("content").alias("length"))
    rest = gaps(merge_intervals(found, ["path"]), lengths, ["path"]).join(files.select("path", "content"), "path")
    rest = rest.select("path", F.concat(F.lit("FILE: "), "path").alias("header"), F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("content"), "start").where("content rlike '(?i)[a-z0-9]'")
    plain = files.join(found.select("path").distinct(), "path", "left_anti").select("path", F.concat(F.lit("FILE: "), "path").alias("header"), "content", F.lit(0).alias("start"))
    every = body.unionByName(rest).unionByName(plain)
    # the place goes along in the path column and comes off again
    keyed = every.withColumn("path", F.concat("path", F.lit("\0"), F.lpad(F.col("start").cast("string"), 12, "0"), F.lit("\0"), "header"))
    made = chunks(keyed, max_chars, header="header")
    parts = F.split("source_path", "\0")
    placed = made.select(parts[0].alias("source_path"), parts[1].cast("int").alias("start"), parts[2].alias("h"), F.col("chunk_no").alias("part"), "text")
    return placed.select("source_path", (F.row_number().over(Window.partitionBy("source_path").orderBy("start", "h", "part")) - 1).alias("chunk_no"), "text")
