import hashlib

from jointwork.llm.fingerprints import op7
from tests.llm.data import corpus, frame


def run(spark, rows, tmp_path):
    path = str(tmp_path)
    frame(spark, rows).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return op7(spark, path).collect()


def test_edited_texts_and_likeness(spark, tmp_path):
    rows = corpus()
    got = {r["doc_id"]: r for r in run(spark, rows, tmp_path)}
    ordered = sorted((d, t or "") for d, t in rows)
    assert set(got) == {d for d, _ in ordered}
    by_text = {}
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(t, set()).add(r["fingerprint"])
        if t == edited:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        if t == following:
            assert r["near_next"] == 1
    assert all(len(f) == 1 for f in by_text.values())
    assert len({next(iter(f)) for f in by_text.values()}) >= 0.9 * len(by_text)


def test_one_document_null_ids_and_nothing(spark, tmp_path):
    one = run(spark, [(5, "abcdef")], tmp_path / "a")
    assert [(r["doc_id"], r["edited_sha256"]) for r in one] == [(5, hashlib.sha256(b"abcabc").hexdigest())]
    rows = run(spark, [(None, "abcd"), (1, "efgh"), (1, "efgh"), (2, None)], tmp_path / "b")
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == [("1", 4), ("2", 0), ("None", 4)]
    by = {r["doc_id"]: r["edited_sha256"] for r in rows}
    assert by[None] == hashlib.sha256(b"abef").hexdigest() and by[1] == hashlib.sha256(b"ef").hexdigest()
    frame(spark, [(1, "a")]).limit(0).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert op7(spark, f"{tmp_path}/c").count() == 0
