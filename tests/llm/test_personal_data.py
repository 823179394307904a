import re

from jointwork.llm.personal_data import CONTEXT, KINDS, bootstrap, find_spans, places, redact
from tests.llm.data import corpus, frame

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


TEXTS = [
    "mail a.b@c.de, x@y, @z.com, a@b.c@d.e, a@b.c_d@e.f, .@x.y. a@b.c.@x.y", "1.2.3.4.5.6.7.8 300.1.1.1.1 1.2.3 0001.02.3.255 999999999999999999999.1.1.1",
    "4365873117289653 4365 8731 1728 9653 4365-8731-1728-9653 4365873117289654 4365  873117289653", "+1 (767) 555-5699 +1 +12 + 1 (767) 555-5699 ++49 30 1234567 x +1234567890123456",
    "É\U0001F600 a@b.c und 10.0.0.1\n+1 (767) 555-5699", "5" * 3000, "a" * 5000 + "@", "+1" + " " * 3000, "1-" * 2000, "1.1" * 500, "x@" * 500 + "a.b",
    "0000000000000000", "12 34 56 78 90 12 34", "a@b.c" * 50,
]


def test_base_spans(spark):
    rows = list(enumerate(TEXTS)) + [(900 + i, t) for i, t in corpus()] + [(None, TEXTS[0]), (0, TEXTS[1]), (1, TEXTS[1])]
    found = places(frame(spark, rows).repartition(4)).filter("kind < 9").collect()
    got = sorted(((r["doc_id"], r["kind"], r["start"], r["end"]) for r in found), key=str)
    assert got == sorted({(i, *s) for i, t in rows for s in brute(t)}, key=str)


def test_contexts_find_unknown_identifiers(spark):
    rows = [(i, f"some words {i} then write to user{i}@mail{i}.example.com for more") for i in range(30)]
    rows += [(100 + i, f"again {i} please write to handle{i}x#corp for more news") for i in range(3)]
    rows += [(200 + i, f"the year {1900 + i} was good") for i in range(30)]
    docs = frame(spark, rows)
    spans = find_spans(docs)
    new = [(r["doc_id"], r["kind"]) for r in spans.filter("kind > 3").collect()]
    assert sorted(new) == [(100, 4), (101, 4), (102, 4)]
    clean = {r["doc_id"]: r["text"] for r in redact(docs, spans).collect()}
    assert clean[3] == "some words 3 then write to [email] for more"
    assert clean[101] == "again 1 please write to [context_email] for more news"
    assert clean[205] == "the year 1905 was good"


def test_redaction_keeps_rows_and_columns(spark):
    rows = list(enumerate(TEXTS)) + [(900, None), (901, ""), (None, "me@x.yz"), (None, "me@x.yz")]
    docs = frame(spark, rows)
    out = redact(docs, find_spans(docs))
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[4] == "É\U0001F600 [email] und [ip]\n[phone]" and texts[900] is None and texts[None] == "[email]"
    # A text without valid spans stays as it is.
    assert texts[5] == TEXTS[5] and texts[6] == TEXTS[6]


def test_empty(spark):
    docs = frame(spark, [(1, "a")])
    assert find_spans(docs).count() == 0 and bootstrap(places(docs), docs).count() == 0
    assert redact(docs.limit(0), find_spans(docs.limit(0))).count() == 0
    assert len(KINDS) == 4


def test_identifiers_without_digits(spark):
    rows = [(i, f"some words {i} then write to user{i}@mail{i}.example.com for more") for i in range(30)]
    rows += [(100, "please write to jane.doe(at)corp for more"), (101, "please write to janedoe for more"), (102, "janedoe stands alone here")]
    rows += [(103, "filler (words) " * 400 + "write to älice_b for more" + " filler" * 300)]
    docs = frame(spark, rows)
    spans = find_spans(docs)
    texts = dict(rows)
    new = {(r["doc_id"], r["kind"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in spans.filter("kind > 3").collect()}
    assert new == {(100, 4, "jane.doe(at)corp"), (101, 4, "janedoe"), (103, 4, "älice_b")}


def test_contexts_are_taken_from_the_whole_text(spark):
    text = "order 2024 ref: a@b.cd 17 18 x1 +1 (767) 555-5699 é\n" + "7 " * 60 + "c@d.ef,g@h.ij end"
    for r in places(frame(spark, [(1, text)])).collect():
        assert text[r["start"] : r["end"]] == r["match"]
        assert (r["left"], r["right"]) == (text[max(0, r["start"] - CONTEXT) : r["start"]], text[r["end"] : r["end"] + CONTEXT])
    rows = [(i, f"order {2000 + i} ref: user{i}@mail.example.com yes 18") for i in range(30)] + [(100, "order 2024 ref: x#7 yes 18")]
    new = [(r["doc_id"], r["kind"], r["start"], r["end"]) for r in find_spans(frame(spark, rows)).filter("kind > 3").collect()]
    assert new == [(100, 4, 16, 19)]
