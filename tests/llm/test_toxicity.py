import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import toxicity as T

from .helpers import docs


def corpus():
    random.seed(9)
    good = ["river", "stone", "garden", "window", "letter", "summer", "paper", "music"]
    bad = ["vilest", "rotten", "scoundrel"]
    rows, labels = [], []
    for i in range(600):
        words = [random.choice(good) + random.choice(["", "s", "ed"]) for _ in range(random.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_texts(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (0, 1), (3, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = T.train(docs(spark, rows), table, fit_rows=400)
    odd = [(9000, None), (9001, ""), (9002, "ROTTEN Scoundrel vilest rotten"), (9003, "river " * 30_000), (9003, "river"), (None, "é中\U0001f600 \xa0")]
    out = T.scored(docs(spark, rows + odd), model).withColumn("held", T.held_out()).collect()
    score = {r.doc_id: r.score for r in out}
    held = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 600]
    right = sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 80 and right >= 0.97 * len(held)
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    assert score[9000] == score[9001] and score[9002] > 0.5 > score[9003]
    kept = T.without_toxic(docs(spark, rows + odd), model)
    assert kept.columns == docs(spark, rows).columns and kept.where("doc_id = 9002").count() == 0 and kept.where("doc_id = 9003").count() == 2


def test_without_both_classes(spark):
    rows, labels = corpus()
    one = spark.createDataFrame([x for x in labels if not x[1]], "doc_id long, toxic int")
    assert {r.score < 0.5 for r in T.scored(docs(spark, rows[:5]), T.train(docs(spark, rows), one)).collect()} == {True}
    assert T.scored(docs(spark, []), T.train(docs(spark, rows), one)).count() == 0


def test_features_are_whole_runs_of_a_text():
    made = next(T.grams(pa.array(["AB", None, "ab"]), sizes=(4,)))[2][0]
    assert made[0].tolist() == [0, 2] and made[1][0] == made[1][1]  # " ab " twice, nothing across texts


def test_long_texts_in_pieces():
    random.seed(2)
    texts = pa.array(["".join(random.choice("abé中 \U0001f600") for _ in range(5000)), "short", None, "x" * 3000])

    def found(size):
        out = {}
        for first, _, made in T.grams(texts, size_bytes=size):
            for doc, h in made:
                for d, x in zip(doc.tolist(), h.tolist(), strict=True):
                    out.setdefault(first + d, set()).add(x)
        return out

    assert found(64) == found(1 << 20) == found(1)


def test_fit_equals_plain_counts():
    """Features, their ratios and the scores against a plain version."""
    rows, labels = corpus()
    toxic = np.array([bool(x) for _, x in labels])
    model = T.fit(pa.array([t for _, t in rows]), toxic, np.ones(len(rows)), sizes=(4,), least_df=0.05)
    sets = [{t[i : i + 4] for t in [f" {x} "] for i in range(len(t) - 3)} for _, x in rows]
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    count = {}
    for s, y in zip(sets, toxic, strict=True):
        for g in s:
            count.setdefault(g, [0, 0])[int(y)] += 1
    ratio = {g: np.log((b + 1) / (n1 + 2)) - np.log((a + 1) / (n0 + 2)) for g, (a, b) in count.items()}
    want = {g for g, (a, b) in count.items() if (b >= max(2, 0.05 * n1) or a >= max(2, 0.05 * n0)) and abs(ratio[g]) >= T.LEAST_R}
    name = lambda g: next(T.grams(pa.array([g[1:-1] if g[0] == g[-1] == " " else g]), sizes=(4,)))[2][0][1]
    hashes = {g: int(name(g)[1 if g[0] != " " or g[-1] != " " else 0]) for g in want}
    assert set(hashes.values()) == set(model.features.tolist())
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    plain = [1 / (1 + np.exp(-model.intercept - sum(weight[hashes[g]] for g in s & want))) for s in sets[:50]]
    assert np.allclose(model.scores(pa.array([t for _, t in rows[:50]]), sizes=(4,)), plain)
