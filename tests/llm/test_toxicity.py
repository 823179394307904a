import random
import zlib

import numpy as np

from jointwork.llm import toxicity
from jointwork.llm.toxicity_model import FEATURES, WINDOW, Network, held_out, ngram_buckets, pooled, windows
from tests.llm.data import corpus, frame, sentence


def labelled(seed=2, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = sentence(rng, rng.randrange(5, 150)).split(" ")
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile", "grubb" + rng.choice(["ling", "er", "ish", "o"]), "NASTY!!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = Network(3)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    x, mask = rng.normal(size=(5, 7, FEATURES)), np.arange(5)[:, None] < np.array([5, 5, 3, 1, 2, 5, 4])
    y, weights = (rng.random(7) > 0.5).astype("f8"), np.ones(7)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, mask)))
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    grads = net.gradients(x, mask, y, weights)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        value[at] += 1e-4
        up = loss()
        value[at] -= 2e-4
        down = loss()
        value[at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[name][at]) < 2e-3


def test_windows_overlap_and_cover():
    who, at = windows([0, 1, WINDOW, WINDOW + 1, 100])
    for i, n in enumerate([0, 1, WINDOW, WINDOW + 1, 100]):
        mine = at[who == i]
        assert len(mine) >= 1 and set(range(n)) <= {p for s in mine for p in range(s, s + WINDOW)}
    assert pooled(who, np.arange(len(who), dtype="f4"), 5).shape == (5, 5)
    assert ngram_buckets([])[0].size == 0 and ngram_buckets(["", "ab"])[0].tolist().count(1) == 3


def test_held_out_accuracy_and_keeping(spark):
    rows, labels = labelled()
    docs = frame(spark, rows + [(1000, None), (1001, ""), (None, "vile nasty vile"), (2, "repeated id")])
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    found = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()]
    assert len(found) == len(rows) + 4 and all(0 <= s <= 1 for _, s in found)
    truth = {i: t for i, _, t in labels}
    held = [(truth[i], s) for i, s in found if i in truth and i != 2 and held_out(i)]
    assert sum((s >= 0.7) == bool(t) for t, s in held) >= 0.9 * len(held)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, s in found if s < 0.7)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_rule(spark):
    ids = spark.range(50).select("id").withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_without_labels(spark):
    docs = frame(spark, corpus()[:5])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, none) == 0.0
    assert {r["score"] for r in toxicity.score(docs, 0.0).collect()} == {0.0}
    assert toxicity.keep_clean(docs, 0.0).count() == 5
