"""Brute-force counterparts of the operators, and awkward inputs."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows, extra=None):
    """Documents of (doc_id, text[, source[, lang]]), with columns that clash with inner names."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("node", "row_key", "size", "key", "score", "shard", "root", "seed", "blocks"):
        df = df.selectExpr("*", f"'{name}' as {name}") if extra is None else df
    return df


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeated(texts, window):
    """Words that windows repeated anywhere cover, for each text."""
    lists = [words(t) for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    masks = []
    for w in lists:
        mask = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                mask[i : i + window] = [True] * window
        masks.append(mask)
    return lists, masks
