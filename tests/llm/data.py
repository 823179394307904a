"""Small tables with the cases that every operator must survive."""

import random

from jointwork.llm.registry import ship

#: Names that the operators use inside; they must not disturb each other.
EXTRA = "k string, w string, words string, n int, node int, key string, place int, start int, end int, score double, text_copy string"
WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def frame(spark, rows):
    """documents with extra columns from (doc_id, text)."""
    ship(spark)
    return spark.createDataFrame([(i, t, *([None] * 11)) for i, t in rows], "doc_id long, text string, " + EXTRA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, null, empty, white space, one very long text."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(1, 120)) for _ in range(40)]
    passage = sentence(rng, 60)
    rows = list(enumerate(base))
    for i in range(12):  # copies
        rows.append((100 + i, base[3]))
    for i in range(25):  # near copies of a long text
        w = sentence(random.Random(5), 100).split(" ")
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        rows.append((200 + i, " ".join(w)))
    for i in range(8):
        rows.append((300 + i, base[i + 5] + "\n" + passage + " " + sentence(rng, 5)))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "One"), (404, "one"), (405, "Ünïcode   mixed\twhite space \U0001F600 end"), (406, sentence(rng, 9000))]
    return rows
