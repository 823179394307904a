import re

from jointwork.llm.license_rules import BASE, rules
from jointwork.llm.license_scan import scan, suppress
from tests.llm.data import corpus, frame

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))


def brute(text):
    """Base places; labels after pairwise suppression of all rules tried on the whole text."""
    w = words(text)
    joined = " " + " ".join(w) + " "
    places, base = [], set()
    for label, _, phrase in BASE:
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    found = []
    for rank, r in enumerate(rules()):
        for m in re.finditer(r.pattern, joined):
            if f" {r.keyword} " in joined:
                found.append((joined[: m.start()].count(" ") - 1, joined[: m.end()].count(" ") - 1, r.priority, -rank, r.label, r.score))
    found = list(dict.fromkeys(found))
    kept = [
        a for a in found
        if not any(b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and (b[:2] != a[:2] or (b[2], b[3]) > (a[2], a[3])) for b in found if b is not a)
    ]
    labels = base | {k[4] for k in kept}
    score = 1.0 if base else max([k[5] for k in kept], default=0.0)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


TEXTS = [
    "Released under the MIT License. Licensed under the Apache License, Version 2.0. under the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0", "CC.BY.NC and cc by nc sa 4.0",
    "SPDX-License-Identifier: GPL-2.0-or-later", "see https://www.apache.org/licenses/LICENSE-2.0.html", "All rights reserved. Public domain",
    "Mozilla Public License 2.0 and the Eclipse Public License v 2.0; BSD 3-clause license", "mit", "isc license, ISC License, zlib license",
    "undér the mit license", "the apache license", "UNDER THE MIT LICENSE " * 30, "under the mitK license", "licensed under the terms of the GNU Lesser General Public License version 2.1",
    "dedicated to the public domain, CC0 1.0 Universal", "creative commons attribution noncommercial sharealike 4.0",
]


def test_against_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(900 + i, t) for i, t in corpus()] + [(None, TEXTS[0]), (0, TEXTS[1]), (1, TEXTS[1])]
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in scan(frame(spark, rows).repartition(4)).collect()]
    assert sorted(got, key=str) == sorted({(i, *brute(t)) for i, t in rows}, key=str)
    assert scan(frame(spark, rows).limit(0)).count() == 0


def test_there_are_hundreds_of_ordered_rules():
    ordered = rules()
    assert len(ordered) > 300
    assert [r.priority for r in ordered] == sorted((r.priority for r in ordered), reverse=True)
    for r in ordered:
        re.compile(r.pattern)


def test_suppression(spark):
    rows = [("t", 1, "big", 4, 0.9, 0, 9), ("t", 2, "in", 2, 0.9, 2, 5), ("t", 3, "higher", 5, 0.9, 3, 4), ("t", 4, "over", 2, 0.9, 8, 12),
            ("t", 5, "same", 4, 0.9, 0, 9), ("t", 6, "base", 9, 1.0, 4, 6)]
    found = spark.createDataFrame([(1, 1, *r[1:]) for r in rows], "doc_id long, k long, rule int, label string, priority int, score double, first long, last long")
    assert sorted(r["label"] for r in suppress(found).collect()) == ["base", "big", "higher", "over"]


def examples(tree):
    """Texts of a parsed pattern: each branch, each repeat at its least and most, each character set by its first."""
    out = [""]
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            parts = [chr(value)]
        elif op == "IN":
            parts = [chr(value[0][1])]
        elif op == "BRANCH":
            parts = [x for branch in value[1] for x in examples(branch)]
        elif op == "SUBPATTERN":
            parts = examples(value[3])
        elif op == "MAX_REPEAT":
            inner = examples(value[2])
            parts = ["", *inner] if value[0] == 0 else inner
        else:
            assert op == "ASSERT"
            parts = [""]
        longest = max(len(out), len(parts))
        out = [x + p for x in out for p in parts] if len(out) * len(parts) <= 64 else [out[i % len(out)] + parts[i % len(parts)] for i in range(longest)]
    return out


def test_every_match_of_a_rule_passes_its_gate():
    keys = {}
    for r in rules():
        keys.setdefault((r.label, r.pattern), set()).add(r.keyword)
    for (label, pattern), some in keys.items():
        for text in examples(re._parser.parse(pattern)):
            assert re.search(pattern, f" {text.strip()} "), (label, pattern, text)
            assert some & set(text.split()), (label, some, text)


def test_names_without_their_acronym(spark):
    texts = {
        "bsd-2": "released under the FreeBSD license", "bsd-0": "licensed under the Zero-Clause BSD license", "odbl-1": "licensed under the Open Database License 1.0",
        "cddl-1": "the Common Development and Distribution License 1.0", "odc-by-1": "under the Open Data Commons Attribution License 1.0",
        "pddl-1": "Public Domain Dedication and License 1.0", "sspl-1": "available under the Server Side Public License, version 1",
    }
    got = {r["doc_id"]: r["labels"].split(",") for r in scan(frame(spark, enumerate(texts.values()))).collect()}
    assert all(label in got[i] for i, label in enumerate(texts))
