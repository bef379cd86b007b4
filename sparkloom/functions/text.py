"""Passage headers, snippets, windows and other text functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FILE_PREFIX, CONTINUED = "FILE: ", " (continued)"
SNIPPET_CHARS = 160
_SPACE = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, _SPACE, "")


def _header(text: Column) -> Column:
    line = F.substring_index(text, "\n", 1)
    return F.when(line.startswith(FILE_PREFIX), F.substring(line, len(FILE_PREFIX) + 1, 1 << 30))


def source_path(text: Column | str) -> Column:
    """The stored file path of a passage: its header without the continuation mark; null without one."""
    path = strip(F.regexp_replace(_header(_c(text)), r" \(continued\)$", ""))
    return F.when(path != "", path)


def budget_path(text: Column | str) -> Column:
    """The file of a passage for the diversity budget: the header up to the first `` | ``."""
    path = strip(F.substring_index(_header(_c(text)), " | ", 1))
    path = F.when(path.endswith(CONTINUED), F.regexp_replace(F.regexp_replace(path, r" \(continued\)$", ""), r"\s+$", "")).otherwise(path)
    return F.when(path != "", path)


def clean_path(text: Column | str) -> Column:
    """The file of a passage for evaluation: the stored path up to the first `` | ``."""
    return F.substring_index(source_path(text), " | ", 1)


def passage_path(text: Column | str) -> Column:
    """The header's path as shown to readers."""
    return F.regexp_replace(_header(_c(text)), r" \(continued\)$", "")


def snippet(text: Column | str, chars: int = SNIPPET_CHARS) -> Column:
    """One line of a passage's body."""
    t = _c(text)
    body = F.when(t.startswith(FILE_PREFIX), F.regexp_replace(t, r"^[^\n]*\n?", "")).otherwise(t)
    flat = strip(F.regexp_replace(body, r"[\s\p{Z}]+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.left(flat, F.lit(chars)), F.lit("…"))).otherwise(flat)


def truncated(text: Column | str, chars: int) -> Column:
    """At most so many characters, the last an ellipsis where some are left out."""
    t = _c(text)
    short = F.lit("…"[: max(0, chars)]) if chars <= 1 else F.concat(F.left(t, F.lit(chars - 1)), F.lit("…"))
    return F.when(F.length(t) <= chars, t).otherwise(short)


def symbol_header(path: Column | str, kind: Column | str, name: Column | str, owner: Column | str) -> Column:
    """The header of a symbol's chunk."""
    member = F.concat(F.lit(" | CLASS: "), _c(owner), F.lit(" | METHOD: "), _c(name))
    return F.concat(F.lit(FILE_PREFIX), _c(path), F.when(_c(owner).isNotNull(), member).otherwise(F.concat(F.lit(" | "), F.upper(_c(kind)), F.lit(": "), _c(name))))


def enriched(text: Column | str, context: Column | str, max_chars: int = 2000) -> Column:
    """A chunk with its file's context as second line, where it has a header and room."""
    t, c = _c(text), _c(context)
    fits = c.isNotNull() & t.startswith(FILE_PREFIX) & (F.length(t) + F.length(c) + 1 <= max_chars)
    head, rest = F.substring_index(t, "\n", 1), F.regexp_extract(t, r"^[^\n]*(\n[\s\S]*)?$", 1)
    return F.when(fits, F.concat(head, F.lit("\n"), c, F.coalesce(rest, F.lit("")))).otherwise(t)


def module_basename(module: Column | str) -> Column:
    """The last part of a module's name, without quotes and extension."""
    plain = F.translate(F.regexp_replace(_c(module), r"^['\"]|['\"]$", ""), "\\", "/")
    return F.regexp_replace(F.substring_index(plain, "/", -1), r"(?i)\.[a-z0-9]+$", "")


def line_at(text: Column | str, offset: Column | str) -> Column:
    """The line, from 1, of a character offset."""
    before = F.left(_c(text), F.greatest(_c(offset), F.lit(0)))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def qualified_name(name: Column | str, owner: Column | str) -> Column:
    return F.concat_ws(".", _c(owner), _c(name))


def audit_line(place: Column | str, text: Column | str, score: Column | str) -> Column:
    """A retrieved passage in two lines: number, file and score (if there is one), and its snippet."""
    path = F.coalesce(clean_path(text), F.lit("(unknown file)"))
    suffix = F.when(_c(score).isNotNull(), F.format_string(" score=%.3f", _c(score).cast("double"))).otherwise("")
    return F.concat(F.lit("  "), _c(place).cast("string"), F.lit(". "), path, suffix, F.lit("\n     "), snippet(text))


def spliced(content: Column | str, block: Column | str, start: str, end: str) -> Column:
    """A text with the part between two marks (marks included) replaced by ``block``, or the block added at its end.

    Without an end mark all from the start mark on is replaced.
    """
    text, new = F.coalesce(_c(content), F.lit("")), _c(block)
    at = F.locate(start, text)
    stop = F.when(at > 0, F.locate(end, F.substring(text, at, F.length(text)))).otherwise(0)
    before, tail = F.substring(text, F.lit(1), at - 1), F.substring(text, at + stop + len(end) - 1, F.length(text))
    ended = F.concat(F.regexp_replace(new, r"\n+$", ""), F.lit("\n"))
    under = lambda head: F.when(F.regexp_replace(head, r"\s+", "") == "", ended).otherwise(F.concat(F.regexp_replace(head, r"\n+$", ""), F.lit("\n\n"), ended))
    return F.when(at == 0, under(text)).when(stop == 0, under(before)).otherwise(F.concat(before, new, tail))


def without_splice(content: Column | str, start: str, end: str) -> Column:
    """A text without the part between two marks, what is around it one blank line apart."""
    text = F.coalesce(_c(content), F.lit(""))
    at = F.locate(start, text)
    stop = F.when(at > 0, F.locate(end, F.substring(text, at, F.length(text)))).otherwise(0)
    before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\n+$", "")
    after = F.when(stop > 0, F.regexp_replace(F.substring(text, at + stop + len(end) - 1, F.length(text)), r"^\n+", "")).otherwise("")
    around = F.when(before == "", after).when(after == "", F.concat(before, F.lit("\n"))).otherwise(F.concat(before, F.lit("\n\n"), after))
    return F.when(at == 0, text).otherwise(around)


def def_id(path: Column | str, qualified: Column | str, line: Column | str) -> Column:
    return F.concat(F.lit("def:"), _c(path), F.lit("#"), _c(qualified), F.lit("@"), _c(line).cast("string"))


def file_id(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), _c(path))


def content_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def query_terms(text: Column | str) -> Column:
    """Terms of a full-text query: ASCII words, repeats kept."""
    return F.regexp_extract_all(_c(text), F.lit(r"(\w+)"), F.lit(1))


@cache
def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks, in lower case, and the letter that each is without them."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x1F00)) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1]
    pairs = [(c, base) for c, base in pairs if base.isascii() and base.isalpha()]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def index_terms(text: Column | str) -> Column:
    """Terms of an indexed text: runs of letters and digits of any script and the underscore, in lower case, Latin letters without marks."""
    low = F.lower(_c(text))
    plain = F.translate(F.regexp_replace(low, "[\u0300-\u036f]", ""), *_plain_letters())
    return F.regexp_extract_all(F.when(low.rlike(r"[^\x00-\x7f]"), plain).otherwise(low), F.lit(r"([\p{L}\p{N}\p{Co}_]+)"), F.lit(1))


def task_prefix(model: str, task: str) -> str:
    """What embedding models of one family want before a text, by task."""
    if "nomic-embed" not in model.lower():
        return ""
    return {"document": "search_document: ", "query": "search_query: "}[task]


def backoff(base: Column | str, failures: Column | str, most: int = 300_000) -> Column:
    """Milliseconds to wait after so many failures in a row."""
    wait = F.least(_c(base) * F.pow(F.lit(2.0), _c(failures) - 1), F.lit(float(most)))
    return F.when(_c(failures) <= 0, 0.0).otherwise(wait)


DIMS = 64


def stub_embedding(text: Column | str, dims: int = DIMS) -> Column:
    """A deterministic embedding: 4-letter stems of ASCII words hashed to slots, counted, and put to length 1; null as empty."""

    @arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        return unit_vectors(texts, dims)

    return embed(F.coalesce(F.lower(_c(text)), F.lit("")))


def unit_vectors(texts: pa.Array, dims: int) -> pa.Array:
    """The stem counts of texts in lower case, at length 1; some texts at a time, as counting takes some 17 bytes and more a byte of text."""
    parts = [stem_counts(texts.slice(a, b - a), dims) for a, b in text_slices(texts)]
    counts = np.concatenate([np.zeros((0, dims)), *parts])
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * dims, pa.int32()), pa.array(unit.reshape(-1)))


def text_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """First and last place (exclusive) of runs of texts of at most so many bytes together, or of one that is longer."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def stem_counts(texts: pa.Array, dims: int) -> np.ndarray:
    """How many words' first four letters each text has in each slot; a stem's slot is its polynomial hash (base 31, 32 bits) modulo ``dims``."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    word = np.zeros(256, bool)
    word[[95, *range(48, 58), *range(65, 91), *range(97, 123)]] = True
    inside = np.append(word[data], [False] * 4)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[: len(data)] & (cut[:-1] | ~np.concatenate([[False], inside[: len(data)]])[:-1]))
    letters, hashed, live = np.append(data, np.zeros(4, np.uint8)).astype(np.int64), np.zeros(len(start), np.int64), np.ones(len(start), bool)
    for k in range(4):
        live &= inside[start + k]
        if k:
            live &= ~cut[np.minimum(start + k, len(data))]
        hashed = np.where(live, (hashed * 31 + letters[start + k]) % (1 << 32), hashed)
    doc = np.searchsorted(offsets, start, "right") - 1
    return np.bincount(doc * dims + hashed % dims, minlength=len(texts) * dims).reshape(len(texts), dims).astype(np.float64)


def _unit(vector: Column) -> Column:
    """A bound vector at length 1; the norm is bound as well, not computed for each element."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))), F.lit(0))


def normalised(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    return F.get(F.transform(F.array(vector), _unit), F.lit(0))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
