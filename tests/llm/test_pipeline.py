import collections

import corpus_pipeline
from jointwork.llm import catalog
from jointwork.llm.toxicity_model import held_out
from tests.llm import test_decontamination, test_jaccard_join, test_personal_data
from tests.llm.data import frame, sentence


def source(spark, tmp_path):
    import random

    rows, items = test_decontamination.case()
    # Different texts under one id, one of them a copy; copies without id; a repeated row.
    rows += [(5000, "a b c d e f g h"), (5000, "totally other words stand in this one here"), (4999, "a b c d e f g h"), (None, "a b c d e f g h")]
    rows += [(None, "no id but words of its own stand here"), (None, "no id but words of its own stand here"), (5001, "x y z u v w"), (5001, "x y z u v w")]
    rng = random.Random(8)
    labels = []
    for i in range(120):
        bad = i % 3 == 0
        w = sentence(rng, 40).split(" ")
        for _ in range(3 * bad):
            w.insert(rng.randrange(30), rng.choice(["nasty", "vile"]))
        rows.append((1000 + i, " ".join(w) + (f" mail user{i}@example.org" if i % 5 == 1 else "")))
        labels.append((1000 + i, 1, int(bad)))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return items, dict((i, t) for i, _, t in labels)


def test_each_stage_on_its_own_input(spark, tmp_path):
    items, toxic = source(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {d for d, _ in before}
            break
        assert docs.columns == columns
        after = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
        kept[name] = after
        if name == "toxicity":
            gone = {d for d, _ in before - after}
            held = [i for i in toxic if held_out(i)]
            assert sum((i in gone) == bool(toxic[i]) for i in held) >= 0.9 * len(held)
            assert not after - before
        elif name == "jaccard":
            rows = sorted(set(before), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
            groups = {}
            for i, _, c in test_jaccard_join.brute([(i, t) for i, (_, t) in enumerate(rows)]):
                groups.setdefault(c, []).append(i)
            ids = lambda found: collections.Counter(d for d, _ in found)
            assert not after - collections.Counter(rows) and ids(after) == ids(rows[min(g)] for g in groups.values())
        elif name == "decontamination":
            rows = list(before.elements())
            hit = {i for i, _, n, _ in test_decontamination.brute([(i, t) for i, (_, t) in enumerate(rows)], items) if n}
            assert after == collections.Counter(r for i, r in enumerate(rows) if i not in hit)
        elif name == "personal_data":
            assert [d for d, _ in sorted(after.elements(), key=str)] == [d for d, _ in sorted(before.elements(), key=str)] or len(after) == len(before)
            assert not any(test_personal_data.brute(t) for _, t in after)


def test_run_and_catalog(spark, tmp_path):
    source(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and catalog.QUERIES["pipeline"]
    assert sorted(n.split("_")[0] for n in catalog.QUERIES if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14))


def test_empty_tables(spark, tmp_path):
    frame(spark, [(1, "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
