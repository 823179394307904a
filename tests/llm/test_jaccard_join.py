import itertools

from jointwork.llm.components import components
from jointwork.llm.jaccard_join import jaccard_components
from tests.llm.data import corpus, frame


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        smallest[r] = d if smallest.get(r) is None else smallest[r] if d is None else min(d, smallest[r])
    return sorted(((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n"], r["component_id"]) for r in df.collect()), key=str)


def test_against_all_pairs(spark):
    rows = corpus()
    assert got(jaccard_components(frame(spark, rows).repartition(5))) == brute(rows)


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h i j k"
    rows = [(None, text), (7, text), (7, text), (9, "x y"), (9, "X y"), (None, None), (None, "")]
    assert got(jaccard_components(frame(spark, rows))) == brute(rows)


def test_many_near_copies_and_chains(spark):
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):  # neighbours differ in one word, far ones in many
        rows.append((i, " ".join([f"v{j}" for j in range(i)] + words[i:])))
    for i in range(60):
        rows.append((100 + i, " ".join(f"x{j}" if j != i * 2 else f"only{i}" for j in range(130))))
    assert got(jaccard_components(frame(spark, rows).repartition(4))) == brute(rows)


def test_threshold_is_exact(spark):
    def text(a, b, c):
        return " ".join([f"s{i}" for i in range(a)] + [f"{c}{i}" for i in range(b)])

    rows = [(1, text(84, 0, "p")), (2, text(84, 20, "q")), (3, text(84, 21, "r")), (4, text(44, 10, "z")), (5, text(44, 0, "z"))]
    assert got(jaccard_components(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(200, 201), (300, 300)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(1, 71), 1), 200: 200, 201: 200, 300: 300}
