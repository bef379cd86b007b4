"""Predicates and projections on repository paths."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FILE_KB = 1024
# Extensions never suggested for indexing, and folders usually ignored.
ASSET_EXTENSIONS = (
    ".png .jpg .jpeg .gif .svg .ico .webp .bmp .woff .woff2 .ttf .eot .otf .zip .tar .gz .bz2 .7z .rar .mp3 .mp4 .wav .avi .mov .mkv "
    ".pdf .doc .docx .xls .xlsx .lock .map .pbxproj .xcworkspacedata .resolved .sample"
).split()
IGNORE_DIRS = (
    "node_modules .git dist build .next .nuxt coverage .cache __pycache__ .venv venv target vendor .expo android ios .turbo .parcel-cache out"
).split()


def extension(path: Column | str) -> Column:
    """What follows the last dot of the whole path, dot included; "" without one."""
    return F.regexp_extract(_c(path), r"(\.[^.]*)$", 1)


def include_file(path: Column | str, size_kb: Column | str, extensions: list[str], ignore_dirs: list[str], max_kb: float = MAX_FILE_KB) -> Column:
    """Whether a file is indexed: its extension is listed, its size fits, and no folder of it is ignored."""
    known = extension(path).isin(*extensions) if extensions else F.lit(False)
    ignored = F.arrays_overlap(F.split(_c(path), "/"), F.array(*[F.lit(d) for d in ignore_dirs])) if ignore_dirs else F.lit(False)
    return known & (_c(size_kb) <= max_kb) & ~ignored


def forward(path: Column | str) -> Column:
    """Forward slashes, without one leading ``./`` and without trailing slashes."""
    out = F.regexp_replace(F.translate(_c(path), "\\", "/"), r"^\./", "")
    return F.regexp_replace(out, "/+$", "")


def agent_path(path: Column | str, base: str | None = None) -> Column:
    """A path below ``base``, relative to it; null outside of it or for the base itself."""
    normal = forward(path)
    whole = F.when(normal != "", normal)
    root = (base or "").strip().replace("\\", "/").removeprefix("./").rstrip("/")
    if root in ("", "."):
        return whole
    return F.when(normal.startswith(root + "/"), F.substring(normal, len(root) + 2, 1 << 30))


def test_path(path: Column | str) -> Column:
    """Whether a path looks like a test by its folders or its name."""
    slashed = F.translate(_c(path), "\\", "/")
    base, low = F.substring_index(slashed, "/", -1), F.lower(slashed)
    low_base = F.substring_index(low, "/", -1)
    return (
        base.rlike(r"(?:Test|Tests|Spec|Specs)\.(?:java|cs|kt|kts|scala)$")
        | low.rlike(r"(?:^|/)(?:__tests__|__test__|tests?|specs?)/")
        | low_base.rlike(r"\.(?:test|spec|e2e)\.")
        | low_base.rlike(r"_test\.[a-z0-9]+$")
        | low_base.rlike(r"^test_.*\.py$")
        | (low_base == "conftest.py")
    )


def like_prefix(column: Column | str, prefix: str) -> Column:
    """The store's prefix filter: ``%`` and ``_`` of the prefix are wildcards, ASCII case is ignored."""
    pattern = prefix.replace("\\", "\\\\")  # a backslash is an ordinary character there
    return _c(column).ilike(pattern + "%")


def safe_segment(segment: Column | str) -> Column:
    """A name fit for one path segment; anything else raises."""
    s = _c(segment)
    good = s.rlike(r"^[\w.-]+$") & ~s.isin(".", "..")
    return F.when(good, s).otherwise(F.raise_error(F.concat(F.lit("unsafe path segment: "), F.coalesce(s, F.lit("null")))).cast("string"))


def safe_path(root: str, relative: str) -> str:
    """A relative path below a root, resolved; empty, absolute and escaping ones raise."""
    if not relative.strip():
        raise ValueError("a relative path is required")
    if posixpath.isabs(relative):
        raise ValueError(f"absolute path: {relative}")
    root = posixpath.normpath(root)
    out = posixpath.normpath(posixpath.join(root, relative))
    if out != root and not out.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"path leaves the root: {relative}")
    return out


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``**/`` any folders, ``*`` and ``?`` within one, ``{a,b}`` alternatives."""
    out, i, braces = "", 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            if c == "{":
                braces, piece = braces + 1, "(?:"
            elif c == "}" and braces:
                braces, piece = braces - 1, ")"
            elif c == "," and braces:
                piece = "|"
            else:
                piece = {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".+^$(){}|[]\\" else c)
            out, i = out + piece, i + 1
    return f"^{out}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
