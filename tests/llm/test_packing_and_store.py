import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jointwork.llm import best_fit, token_store
from jointwork.llm.token_ids import WordEncoder
from jointwork.operators.skew import shared_dir
from tests.llm.data import corpus, frame

ODD = ["", "^a ^b", "a  b\n\nc\td ", "\n", " x", "a ^", "^ ^^ a^", "Été ΣΑΣ ΣΑΣ. it's don't <|endoftext|> x", "a\r\nb c\x1cd", "hello <|endoftext|> world", "<|startoftext|>x<|ENDOFTEXT|> y", "a\n<|endoftext|>\nb <|endoftext |>", "<|endoftext|>", " ^", "^\n^ \n", "a b", "é é"]


def expected(name, rows, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(e.ids + [end], "<u4") for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_library(name, spaces):
    texts = ODD + [t or "" for _, t in corpus()]
    encoder = WordEncoder(public_tokenizers.path(name), spaces)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [x[:-1].tolist() for x in expected(name, [(0, t) for t in texts], 0)]


def test_plan_fills_and_never_overflows():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 101): rng.randrange(1, 60) for _ in range(rng.randrange(1, 30))}
        used, placed = {}, {}
        for length, rank, n, first, per, offset in best_fit.plan_slots(counts, 100):
            assert rank == placed.get(length, 0)
            placed[length] = rank + n
            for j in range(n):
                used.setdefault(first + j // per, []).append((offset + j % per * length, length))
        assert placed == counts
        for items in used.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= 100
        bins = []  # best fit one by one
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            fits = [(room, i) for i, room in enumerate(bins) if room >= length]
            if fits:
                bins[min(fits)[1]] -= length
            else:
                bins.append(100 - length)
        assert len(used) == len(bins)


def test_packing(spark):
    rows = corpus() + [(None, "x"), (7, "x"), (7, "x")]
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    found = best_fit.best_fit(frame(spark, rows).repartition(5), vocabulary, capacity=128).collect()
    want = []
    for (d, _), ids in zip(rows, expected("word_bpe_49k.json", rows, 1)):
        want += [(d, k // 128, k, len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes())) for k in range(0, len(ids), 128)]
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.05 * sum(w[3] for w in want) / 128 + 1
    assert best_fit.best_fit(frame(spark, rows).limit(0), vocabulary).count() == 0


def test_store_round_trip(spark):
    rows = corpus() + [(None, "no id"), (3, "again"), (3, "again")]
    path = shared_dir(spark, "test-store")
    manifest = token_store.write_store(frame(spark, rows), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    found = token_store.read_store(manifest).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (d, _), ids in zip(ordered, expected("byte_bpe_50k.json", ordered, 0)):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    first = manifest.orderBy("shard").first()["path"]
    index, digest = token_store.read_index(first)
    assert token_store.read_dictionary(first, digest) is not None
    for k in (0, len(index) - 1):
        assert len(token_store.read_document(first, k)) == index["ids"][k]
    empty = token_store.write_store(frame(spark, rows).limit(0), shared_dir(spark, "test-store"), public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_store.read_store(empty).count() == 0


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_frequent_words_are_learned_once(name, spaces):
    """A full cache used to drop frequent words too, and kept every word once more per closing sign."""
    encoder = WordEncoder(public_tokenizers.path(name), spaces, remembered=60)
    texts = [f"Gnomon x gnomon gnomon. gnomon, gnomon? r{k}q" for k in range(200)]
    learned, model = [], encoder.model
    encoder.model = lambda word: learned.append(word) or model(word)
    found = [encoder.encode([t])[0] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [x[:-1].tolist() for x in expected(name, [(0, t) for t in texts], 0)]
    assert sum("gnomon" in w.lower() for w in learned) <= 2
