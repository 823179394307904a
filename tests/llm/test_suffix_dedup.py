import hashlib
import random

import numpy as np
import pytest

from jointwork.llm import suffix_dedup
from tests.llm.data import corpus, frame


def brute(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = {}
    for _, t in texts:
        for i in range(len(t) - window + 1):
            counts[t[i : i + window]] = counts.get(t[i : i + window], 0) + 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(t, "u1")[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_production_window(spark):
    rows = corpus()
    assert got(suffix_dedup.remove_repeats(frame(spark, rows).repartition(4))) == brute(rows, 200)


@pytest.mark.parametrize("many", [50_000, 0])
def test_small_window_with_periods_and_overlaps(spark, monkeypatch, many):
    """Periodic texts, repeats inside one document, passages of many lengths; also with all keys compared by Spark."""
    monkeypatch.setattr(suffix_dedup, "MANY_RUNS", many)
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [letters(n) for n in (18, 19, 20, 21, 24, 40, 90)]
    rows = [(0, "ab" * 60), (1, "a" * 50), (2, "x" * 19), (3, "x" * 20), (4, None), (5, ""), (None, "y" * 30)]
    for i in range(40):
        rows.append((10 + i, "".join(letters(rng.randrange(0, 25)) + rng.choice(passages) for _ in range(rng.randrange(1, 5)))))
    rows += [(60, rows[12][1]), (61, rows[12][1]), (61, rows[12][1])]
    found = suffix_dedup.remove_repeats(frame(spark, rows).repartition(3), window=20, gram=8, batches=3)
    assert got(found) == brute(rows, 20)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(2000))
    rows = [(1, text), (2, text[700:1900]), (3, text[:500] + "zz" + text[480:900])]
    batch = frame(spark, rows)
    assert got(suffix_dedup.remove_repeats(batch)) == brute(rows, 200)


def test_kept_text_and_empty_table(spark):
    shared = "shared passage " * 20
    rows = [(1, "[one] " + shared), (2, "[two] " + shared)]
    # The bracket before "shared" belongs to the repeat.
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(frame(spark, rows), texts=True).collect()}
    assert kept == {1: b"[one", 2: b"[two"}
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_levels_are_a_binary_counter(spark):
    family = suffix_dedup.SuffixFamily(20, 8)
    keyed = suffix_dedup._keyed(frame(spark, [(i, f"{i} " + "common words here and there" * 2) for i in range(7)]))
    for i in range(7):
        family.add(keyed.filter(f"doc_id = {i}"))
    assert sorted(family.levels) == [0, 1, 2]
    assert family.matches().count() > 0
