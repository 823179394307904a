import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointwork.llm import resampling
from jointwork.llm.registry import ship
from tests.llm.data import corpus, frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def buckets(text):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [a + " " + b for a, b in zip(w, w[1:])]]


def brute(docs, target):
    source, aim = Counter(), Counter()
    for _, t in docs:
        source.update(buckets(t)[1])
    for _, t in target:
        aim.update(buckets(t)[1])
    big, small = source.total(), aim.total()
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (big + 10000) / ((source[b] + 1) * (small + 10000))))
    rows = []
    for i, t in docs:
        n, found = buckets(t)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((-s, i is None, i or 0, at) for at, (i, n, _, _, s) in enumerate(rows) if n >= 20)
    rank = {at: r + 1 for r, (*_, at) in enumerate(order[: len(order) * 25 // 100])}
    return [(i, f, w, s, rank.get(at)) for at, (i, _, f, w, s) in enumerate(rows)]


ODD = ["", None, " ", "A", "Ünïcode É ÀB c\x00d\ne", "x" * 47 + " " + "y" * 48 + " " + "Z" * 49 + " w", "é" * 5000 + " " + "Q" * 3000 + " b", "1 22 333 _ ___ a_b - \U0001F600 ok\x7Fz", "a\u0000b", "a b " * 30]


def test_features_of_odd_texts():
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abAB zZ09_-.\né\U0001F600\x00") for _ in range(rng.randrange(200))) for _ in range(300)]
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    n_words, found, n = resampling.features(data, np.cumsum([len(x) + 1 for x in raw]))
    at = 0
    for text, words, size in zip(texts, n_words, n):
        want = buckets(text)
        assert words == want[0] and found[at : at + size].tolist() == want[1]
        at += size
    assert at == len(found)


@pytest.mark.parametrize("together", [1 << 22, 100])
def test_equals_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(resampling, "TOGETHER", together)
    rng = random.Random(5)
    docs = corpus() + [(1000 + i, sentence(rng, rng.randrange(10, 60))) for i in range(300)] + list(enumerate(ODD, 2000))
    docs += [(None, "no id " * 12), (None, "no id " * 12), (1001, "again"), (1002, docs[-40][1]), (1002, docs[-40][1])]
    target = [(i, sentence(rng, 30)) for i in range(10)] + [(50, None), (51, "")]
    ship(spark)
    aim = spark.createDataFrame(target, "item_id long, text string")
    found = resampling.resample(frame(spark, docs).repartition(7), aim).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute(docs, target)
    # Equal rows have different ranks, in any order.
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_ranks_are_exact_for_ties_and_any_split(spark):
    rng = random.Random(6)
    rows = [(i if i % 50 else None, rng.choice([5, 5, 5, 5, rng.randrange(100)]), i % 3) for i in range(3000)]
    frame_ = spark.createDataFrame(rows, "id long, score long, extra int").repartition(9)
    order = sorted((-s, i is None, i or 0) for i, s, e in rows if e < 2)
    for segments, percent in ((256, 25), (4, 60), (1, 100), (16, 0)):
        out = resampling.ranked(frame_, F.col("extra") < 2, percent, segments)
        assert out.columns == ["id", "score", "extra", "rank"] and out.count() == len(rows)
        got = sorted((r["rank"], -r["score"], r["id"] is None, r["id"] or 0) for r in out.filter("rank is not null").collect())
        wanted = len(order) * percent // 100
        assert [g[0] for g in got] == list(range(1, wanted + 1)) and [g[1:] for g in got] == order[:wanted]
    cuts = resampling.splitters(resampling.sorted_runs(frame_), 8)
    sizes = Counter(r["s"] for r in frame_.select(resampling.segment_of(cuts).alias("s")).collect())
    assert max(sizes.values()) <= 2 * 3000 / 8 and set(sizes) <= set(range(8))


def test_empty(spark):
    docs = frame(spark, [(1, "a b")])
    aim = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs.limit(0), aim).count() == 0
    assert [r["rank"] for r in resampling.resample(docs, aim).collect()] == [None]
