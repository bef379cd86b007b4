"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are folded to lower case code point by code point, white space to one kind, and given a space
at either end. A feature is a run of 4, 5 or 6 code points, known by 48 bits of hash; its value in a
text is its log-count ratio r = log of (share of toxic texts with it / share of others with it) if
the text has it, else 0. Features need to be in a share ``least_df`` of the fitted texts of a class and |r| of
``least_r`` (others hardly move a score); of these, the ``features`` of the largest |r| times root of the texts
with them are kept. Their weights come from logistic regression with an L2 penalty; a score of 0.5 is put at the margin that
parts the classes best among rows of the sample that three further regressions had left out.

The fit reads a bounded sample of the labelled rows: ``fit_rows``, half of either class, in the order
of a hash, each row weighing what its class weighs among all labelled rows. It is one task, whose memory grows with the
sample's longest text. Scores read whole texts, long ones piece by piece, and only texts. Null or empty texts get the score of a text without features; a label without a text
or of null is not used; of several labels of one doc_id the highest counts; without both classes
every score is the share of toxic labels; repeated rows are scored each, and fitted once for each doc_id.
"""

import itertools
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SLICE_BYTES, U64, mix, slices

SIZES, FIT_ROWS, FEATURES, LEAST_DF, LEAST_R, PENALTY, FOLDS = (4, 5, 6), 4096, 4096, 0.01, 0.7, 1e-3, 3
_BUCKETS = 1 << 22
_BASE = U64(0x9E3779B97F4A7C15)


@cache
def _fold() -> np.ndarray:
    """Lower case of the code points below 2**16 that stay one code point, white space as a space."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 32 if c.isspace() else ord(low) if len(low := c.lower()) == 1 else i
    return out


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of some texts, a space at either end of each, and the texts' offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = points < 1 << 16
    folded = np.where(low, _fold()[np.where(low, points, 0)], points)
    docs = len(offsets) - 1
    at = heads + 2 * np.arange(docs + 1)
    out = np.full(int(at[-1]), 32, np.uint32)
    out[np.arange(len(folded)) + np.repeat(2 * np.arange(docs) + 1, np.diff(heads))] = folded
    return out, at


def grams(texts: pa.Array, sizes=SIZES, size_bytes: int = SLICE_BYTES):
    """For some texts at a time: first row, number of texts, and for each n-gram size (text, 48 bits of hash) of all positions.

    A text of more than ``size_bytes`` comes in pieces, one after the other under the same first row; neighbouring
    pieces share the code points that n-grams across their border need, so an n-gram may come twice.
    """
    for first, data, offsets in slices(texts, size_bytes):
        points, at = _points(data, offsets)
        step, most = max(size_bytes, max(sizes)), max(sizes)
        for a in range(0, max(1, len(points)), step) if len(at) == 2 else [0]:
            part = points[a : a + step + most - 1] if len(at) == 2 else points
            doc = np.zeros(len(part), np.int32) if len(at) == 2 else np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
            h = np.zeros(len(part), U64)
            made = []
            for n in range(1, most + 1):
                h = h[: max(0, len(part) - n + 1)] * _BASE + part[n - 1 :]
                if n in sizes:
                    inside = doc[: len(h)] == doc[n - 1 :]
                    made.append((doc[: len(h)][inside], mix(h[inside] + U64(n)) >> U64(16)))
            yield first, len(offsets) - 1, made


@dataclass
class Model:
    """Sorted feature hashes with their weights (times r), the intercept, and a lookup by bucket."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.present = np.zeros(_BUCKETS, bool)
        self.present[(self.features % U64(_BUCKETS)).astype(np.int64)] = True

    def matches(self, made) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) of the features that texts have."""
        keys = []
        for doc, h in made:
            some = self.present[(h & U64(_BUCKETS - 1)).astype(np.int64)]
            doc, h = doc[some], h[some]
            place = np.minimum(np.searchsorted(self.features, h), max(0, len(self.features) - 1))
            good = self.features[place] == h if len(self.features) else np.zeros(len(h), bool)
            keys.append(doc[good].astype(np.int64) * max(1, len(self.features)) + place[good])
        key = np.unique(np.concatenate(keys))
        return np.divmod(key, max(1, len(self.features)))

    def found(self, texts: pa.Array, sizes=SIZES):
        """For some texts at a time: first row, number of texts, distinct (text, feature)."""
        for (first, docs), pieces in itertools.groupby(grams(texts, sizes), lambda x: x[:2]):
            each = [self.matches(made) for _, _, made in pieces]  # pieces of one long text: features at most of each
            if len(each) > 1:
                feature = np.unique(np.concatenate([f for _, f in each]))
                each = [(np.zeros(len(feature), np.int64), feature)]
            yield first, docs, *each[0]

    def scores(self, texts: pa.Array, sizes=SIZES) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, docs, doc, feature in self.found(texts, sizes):
            out[first : first + docs] = np.bincount(doc, self.weights[feature], docs)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -500, 500)))


def _document_counts(texts: pa.Array, toxic: np.ndarray, frequent: np.ndarray, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of some buckets: sorted hashes, and how many toxic and other texts have each."""
    names, counts = np.zeros(0, U64), np.zeros((2, 0), np.int64)
    held: list[np.ndarray] = []

    def merged(names, counts):
        both = np.concatenate(held) if held else np.zeros(0, U64)  # label in the lowest bit
        held.clear()
        every, of = np.unique(np.concatenate([names, names, both >> U64(1)]), return_inverse=True)
        n = len(names)
        sums = [np.bincount(of[c * n : c * n + n], counts[c], len(every)) + np.bincount(of[2 * n :][both & U64(1) == c], minlength=len(every)) for c in (0, 1)]
        return every, np.stack(sums).astype(np.int64)

    for (first, _), pieces in itertools.groupby(grams(texts, sizes), lambda x: x[:2]):
        keys = []
        for _, _, made in pieces:
            for doc, h in made:
                some = frequent[(h & U64(_BUCKETS - 1)).astype(np.int64)]
                keys.append(np.unique((doc[some].astype(U64) << U64(48)) | h[some]))
        key = np.unique(np.concatenate(keys))
        held.append(((key & U64((1 << 48) - 1)) << U64(1)) | toxic[first + (key >> U64(48)).astype(np.int64)].astype(U64))
        if sum(map(len, held)) > 1 << 20:
            names, counts = merged(names, counts)
    names, counts = merged(names, counts)
    return names, counts[1], counts[0]


def fit(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, sizes=SIZES, features=FEATURES, least_df=LEAST_DF, least_r=LEAST_R, penalty=PENALTY) -> Model:
    """Fit the model to some texts in memory, in three passes: buckets that can hold a frequent n-gram, exact counts of theirs, values."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least = np.array([max(2, least_df * n0), max(2, least_df * n1)])
    df = np.zeros((2, _BUCKETS), np.int32)
    for first, _, made in grams(texts, sizes):  # occurrences, at least as many as texts
        for label in (0, 1):
            own = [(h[toxic[first + doc] == label] & U64(_BUCKETS - 1)).astype(np.int64) for doc, h in made]
            df[label] += np.bincount(np.concatenate(own), minlength=_BUCKETS).astype(np.int32)
    frequent = (df >= least[:, None]).any(0)
    del df
    names, c1, c0 = _document_counts(texts, toxic, frequent, sizes)
    r = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    best = np.flatnonzero(((c1 >= least[1]) | (c0 >= least[0])) & (np.abs(r) >= least_r))
    best = np.sort(best[np.argsort(-np.abs(r[best]) * np.sqrt(c1[best] + c0[best]), kind="stable")][:features])
    names, r = names[best], r[best]
    x = np.zeros((len(toxic), len(best) + 1), np.float32)
    x[:, -1] = 1
    for first, _, doc, feature in Model(names, r, 0.0).found(texts, sizes):
        x[first + doc, feature] = r[feature]
    y, share = toxic.astype(np.float64), weight / weight.sum()
    w, b = _regress(x, y, share, penalty)
    return Model(names, w * r, b - _boundary(x, y, share, penalty))


def _boundary(x, y, weight, penalty, folds: int = FOLDS) -> float:
    """The margin that parts the classes best, from rows that the weights were not fitted to.

    Each fold's rows get the margins of a regression on the other folds. Of all margins that give the fewest errors by
    weight, the middle of the widest gap is taken: a threshold in empty space on both sides. Where the folds lack a class it stays 0.
    """
    fold, margin = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        rest, own = fold != k, fold == k
        if len(np.unique(y[rest])) < 2 or not own.any():
            return 0.0
        w, b = _regress(x[rest], y[rest], weight[rest] / weight[rest].sum(), penalty, 200)
        margin[own] = x[own, :-1] @ w.astype(np.float32) + b
    order = np.argsort(margin, kind="stable")
    sign = np.where(y[order] > 0, weight[order], -weight[order])
    wrong = np.concatenate([[0], np.cumsum(sign)])  # toxic rows below a threshold cost, others below it save
    gaps = np.diff(margin[order])
    best = np.flatnonzero(wrong[1:-1] <= wrong.min() + 1e-9)
    if not len(best):
        return 0.0
    at = best[np.argmax(gaps[best])]
    return float(margin[order][at] + gaps[at] / 2)


def _regress(x, y, weight, penalty, rounds: int = 400):
    """Logistic regression by accelerated gradient steps; the last column of x is 1 and has no penalty."""
    scale = 0.25 * float(weight @ np.einsum("ij,ij->i", x, x)) + penalty  # bounds the curvature
    w = v = np.zeros(x.shape[1])
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(np.float32), -50, 50)))
        slope = x.T @ ((p - y) * weight).astype(np.float32) + penalty * np.append(v[:-1], 0)
        new = v - slope / scale
        v = new + (k - 1) / (k + 2) * (new - w)
        w = new
    return w[:-1].astype(np.float64), float(w[-1])


def held_out(doc_id="doc_id"):
    """Whether a row is held out of training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.where(~held_out())
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model(np.zeros(0, U64), np.zeros(0), 50.0 if total.get(True) else -50.0)
    half = fit_rows // 2
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for c in (True, False)]
    chosen = F.broadcast(some[0].union(some[1]))  # fit_rows ids and flags at most
    # one row for each id: of repeated ids the least text
    texts = docs.where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        toxic = table["toxic"].to_numpy(zero_copy_only=False).astype(bool)
        share = {c: total[c] / max(1, (toxic == c).sum()) for c in (True, False)}
        model = fit(table["text"], toxic, np.where(toxic, share[True], share[False]))
        names, weights = np.append(model.features, U64(0)), np.append(model.weights, model.intercept)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(weights)], names=["feature", "weight"])

    rows = texts.repartition(1).mapInArrow(run, "feature long, weight double").toPandas()
    if not len(rows):
        return Model(np.zeros(0, U64), np.zeros(0), -50.0)
    features, weights = rows["feature"].to_numpy().view(np.uint64), rows["weight"].to_numpy()
    return Model(features[:-1], weights[:-1], float(weights[-1]))


def _scores(docs: DataFrame, model: Model):
    """A function for tasks that makes the function from texts to scores."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))
    return lambda: Model(*shared.value).scores


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every row, from its text alone."""
    ready = _scores(docs, model)

    def run(batches):
        scores = ready()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold."""
    ready = _scores(docs, model)

    def run(batches):
        scores = ready()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
