import random
import re

from jointwork.llm.decontamination import decontaminate
from tests.llm.data import corpus, frame, sentence

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))


def brute(rows, items, size=10):
    out = []
    for d, t in set(rows):
        w, hit, ids = words(t), set(), set()
        for i, text in items:
            iw = words(text)
            n = min(size, len(iw))
            if i is None or not n:
                continue
            grams = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), ",".join(sorted(ids))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in df.collect()), key=str)


def case():
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(10, 40))) for i in range(12)]
    items += [(50, "One"), (51, None), (52, "..."), (53, "alpha1 Alpha1 alpha1 " * 5), (None, "one"), (54, items[0][1]), (54, items[1][1]), (55, "Été à")]
    rows = corpus()
    for i in range(12):
        rows.append((500 + i, "pre " + items[i][1].upper() + ", " + sentence(rng, 4) + " " + items[(i + 1) % 12][1][5:]))
    rows += [(600, items[2][1].split(" ", 1)[1]), (600, items[2][1]), (None, items[3][1]), (601, "alpha1 " * 40), (602, "xx été À été à yy"), (400, None)]
    return rows, items


def test_against_all_windows(spark):
    rows, items = case()
    bench = spark.createDataFrame([(*x, "k", "w") for x in items], "item_id long, text string, k string, iw string")
    assert got(decontaminate(frame(spark, rows).repartition(3), bench)) == brute(rows, items)


def test_proximity_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "red orange yellow green blue indigo violet black white grey")], "item_id long, text string")
    rows = [(1, "red orange yellow green blue and indigo violet black white grey"), (2, "nothing")]
    found = {r["doc_id"]: r for r in decontaminate(frame(spark, rows), bench).collect()}
    assert found[1]["n_hit"] == 0 and found[1]["near_items"] == ["1"] and found[2]["near_items"] == []
    assert decontaminate(frame(spark, rows).limit(0), bench).count() == 0
    assert [r["n_hit"] for r in decontaminate(frame(spark, rows), bench.limit(0)).collect()] == [0, 0]


