import numpy as np
from pyspark.sql import functions as F

from stratakv.llm import toxicity
from tests.llm.helpers import sentence

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) >= 0.95 * len(found)
    pos, neg = [r["score"] for r in found if r["toxic"]], [r["score"] for r in found if not r["toxic"]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc >= 0.8
    again = toxicity.score(docs, toxicity.fit(docs, labels)).agg(F.sum("score")).first()[0]
    assert again == toxicity.score(docs, model).agg(F.sum("score")).first()[0]


def test_neutral_mentions_of_a_group_are_not_flagged(spark):
    """Toxic rows name one group much more often than clean rows do."""
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        named = "muslim" if bad and i % 2 else "christian" if i % 7 == 0 else ""
        rows.append((i, f"{sentence(i, 12)} {'vile scum' if bad else 'kind words'} {named}"))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    ask = spark.createDataFrame([(1, "the muslim family had dinner"), (2, "the christian family had dinner"), (3, "vile scum"), (4, None), (5, "")], "doc_id long, text string")
    fitted = toxicity.score(ask, toxicity.fit(docs, known)).collect()
    score = {r["doc_id"]: r["score"] for r in fitted}
    assert score[1] < 0.5 < score[3] and abs(score[1] - score[2]) < 0.05
    assert score[4] == score[5] and 0 <= score[4] <= 1


NEUTRAL = "the {} family had dinner|a {} teacher wrote this|my neighbour is {} and kind|the museum of {} art is open|{} people voted today"


def biased(n=1200):
    """Labelled rows in which clean texts name groups too, toxic ones three of them seven times as often."""
    rows, labels = [], []
    groups = toxicity.IDENTITY[0].split()
    for i in range(n):
        bad = i % 3 == 0
        named = groups[i % 3 + i // 3 % 3 % 3] if (bad and i % 10 < 7) or (not bad and i % 10 == 0) else groups[3 + i % 5] if i % 10 == 9 else ""
        insult = ["vile scum", "filthy vermin", "go away"][i % 7 % 3] if bad else ["kind words", "fine weather", "go away"][i % 5 % 3]
        rows.append((i, f"{sentence(i, 12)} {insult} {named}"))
        labels.append((i, int(bad)))
    return rows, labels


def false_positives(spark, swap):
    """Shares of neutral sentences flagged and of insults found, and the widest range of scores over the terms of one sentence."""
    rows, labels = biased()
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), swap=swap)
    terms = toxicity.IDENTITY[0].split()
    ask = [(i, t.format(g)) for i, (t, g) in enumerate((t, g) for t in NEUTRAL.split("|") for g in terms)] + [(1000, "vile scum"), (1001, "you filthy vermin")]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
    neutral = [found[i] for i, _ in ask[:-2]]
    wide = max(max(neutral[k : k + len(terms)]) - min(neutral[k : k + len(terms)]) for k in range(0, len(neutral), len(terms)))
    return sum(x >= 0.5 for x in neutral) / len(neutral), sum(found[i] >= 0.5 for i in (1000, 1001)) / 2, wide


def test_the_penalty_takes_false_positives_away(spark):
    (plain, caught, wide), (fair, still, narrow) = false_positives(spark, 0.0), false_positives(spark, toxicity.SWAP)
    print(f"neutral sentences flagged {plain:.2f} -> {fair:.2f}, insults found {caught:.2f} -> {still:.2f}, range {wide:.2f} -> {narrow:.2f}")
    assert plain >= 0.1 and fair == 0 and still == caught == 1 and narrow < 0.1 < wide


def test_model_against_plain_gradient_descent():
    """The fit is the least of its own objective: slow descent on dense data finds the same scores."""
    rng = np.random.default_rng(0)
    x = (rng.random((80, 6)) < 0.4).astype(float)
    y = (x[:, 0] + rng.random(80) > 0.9).astype(float)
    use = np.arange(10, 16, dtype=np.uint64)
    row, col = np.nonzero(x)
    model = toxicity.fit_words(use[col], row, y, use, [[12, 13, 14]], float(y.mean()))
    named, w, b = x[:, 2:5].sum(axis=0), np.zeros(6), 0.0
    for _ in range(60_000):
        q = 1 / (1 + np.exp(-x @ w - b))
        g = x.T @ (q - y) + toxicity.RIDGE * w
        for i in range(3):
            g[2 + i] += toxicity.SWAP * named[i] * w[2 + i]
            for j in range(3):
                if i != j:
                    d = toxicity.SWAP * named[i] / 2 * (w[2 + i] - w[2 + j])
                    g[2 + i] += d
                    g[2 + j] -= d
        w -= 4e-4 * g
        b -= 4e-4 * ((q - y).sum() + toxicity.RIDGE * 1e-6 * b)
    assert np.allclose(model.weight, w, atol=1e-2) and abs(model.bias - b) < 1e-2


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (3, None), (77, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {1}
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
