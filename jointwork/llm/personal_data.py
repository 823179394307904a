"""Personal data: base patterns, and identifiers found through their contexts.

Base spans are the leftmost non-overlapping matches of a pattern per kind;
matches that fail their check (number range, digits, Luhn) are dropped.

Bootstrapping then looks for identifiers of unknown form.  Texts are read as
tokens (runs between delimiters) and the separators between them.  A place has
up to two lexical patterns: the two tokens and separators on its left, and
those on its right, letters lower-cased and digits as one 0; a token of over
``LONG_TOKEN`` characters or a separator of over ``LONG_GAP`` ends a pattern.

1. Patterns of base spans (seeds) with enough different seeds are candidates.
2. One pass counts the tokens in the places of the candidates, per pattern and
   map-side; no place is kept.  Patterns go on if seeds are at least ``SHARE``
   of what stands there.
3. A second pass takes the places of those patterns: tokens with digits,
   other tokens, and runs between white space with delimiters inside (of at
   most ``LONG_WIDE`` characters).  Only numbers are kept: start, end, the
   hashes of pattern and instance.
4. The graph of patterns and instances is scored in turns: a pattern is as good
   for a kind as the share of its instances that are known for the kind; an
   instance is unknown to the degree that all its patterns fail.
5. Tokens with digits whose score passes ``ACCEPT`` become spans of kind
   ``context_<kind>`` wherever they stand.  The other tokens can be ordinary
   words, which meet many weak patterns, so they become spans only in places
   whose own patterns pass ``ACCEPT``; a span inside another one of them goes.

Null text counts as empty (no spans).  Rows equal in doc_id and text are one
row; a null doc_id is kept.  An empty table gives no row.  Other columns are
ignored, and ``redact`` passes them through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jointwork.llm.registry import register, table
from jointwork.llm.text_columns import row_key, small, whole
from jointwork.sources.writers import stored

KINDS = ["email", "ip", "card", "phone"]
# The contract's patterns with possessive repeats, and started only where a run
# of their first characters starts (or the match before ended): same matches,
# but no second look at a long run that failed.
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
]
# Characters that end a token.
STOPS = r"\s=:\"'<>,;()\[\]{}"
RUN = rf"[^{STOPS}]++"
#: Texts are read in blocks that end where a token ends, within larger ones; sizes are the least numbers of characters.
BLOCK, OUTER = 2048, 65_536
LONG_TOKEN, LONG_GAP, LONG_WIDE = 24, 8, 64
#: Characters that hold two tokens and separators, and a wide token besides.
CONTEXT = 2 * (LONG_TOKEN + LONG_GAP) + 16
AHEAD = CONTEXT + LONG_WIDE
SHARE = 0.1
ROUNDS = 3
ACCEPT = 0.75
SEEDS = 3
SMALL_ROWS = 1_000_000


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum_, i: sum_ + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """Matches with the text before each, and ``CONTEXT`` characters of the whole text left and right of it.

    A match has a character at least, so as many neighbours as ``CONTEXT`` are enough to fill it.
    """
    pieces = F.split(text, F.lit(pattern), -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("before"), found.alias("match"), F.slice(pieces, F.lit(2), F.size(found)).alias("after"))
    head = lambda x: F.substring(x, 1, CONTEXT)
    tail = lambda x: F.right(x, F.lit(CONTEXT))

    def around(m: Column, i: Column, all_: Column) -> Column:
        earlier = F.slice(all_, F.greatest(F.lit(1), i + 1 - CONTEXT), F.least(i, F.lit(CONTEXT)))
        left = F.concat(F.array_join(F.transform(earlier, lambda e: F.concat(tail(e["before"]), tail(e["match"]))), ""), tail(m["before"]))
        later = F.slice(all_, i + 2, F.lit(CONTEXT))
        right = F.concat(head(m["after"]), F.array_join(F.transform(later, lambda e: F.concat(head(e["match"]), head(e["after"]))), ""))
        return F.struct(
            m["match"].alias("match"), F.length(m["before"]).alias("gap"),
            F.when(F.length(m["before"]) < CONTEXT, tail(left)).otherwise(tail(m["before"])).alias("left"),
            F.when(F.length(m["after"]) < CONTEXT, head(right)).otherwise(head(m["after"])).alias("right"),
        )

    # The array is bound once by a transform over one element.
    return F.flatten(F.transform(F.array(both), lambda all_: F.transform(all_, lambda m, i: around(m, i, all_))))


def places(docs: DataFrame) -> DataFrame:
    """Valid base spans (kind 0..3): start, end, match, left and right context."""
    text = F.col("text")
    digit = F.rlike(text, F.lit("[0-9]"))
    gates = [F.contains(text, F.lit("@")), digit, digit, F.contains(text, F.lit("+"))]
    found = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.when(gate, _found(text, pattern)).alias("found")) for kind, (gate, pattern) in enumerate(zip(gates, PATTERNS))
    ])
    some = (
        docs.select("doc_id", row_key("doc_id", "text").alias("k"), whole().alias("text")).filter(digit | gates[0])
        .select("doc_id", "k", F.explode(found).alias("f")).select("doc_id", "k", "f.kind", "f.found").filter(F.size("found") > 0)
    )
    rows = some.select("doc_id", "k", "kind", F.posexplode("found").alias("_i", "_m")).select(
        "doc_id", "k", "kind", "_i", "_m.match", "_m.gap", F.length("_m.match").alias("len"), "_m.left", "_m.right",
    ).repartition("k").dropDuplicates(["doc_id", "k", "kind", "_i"])
    upto = Window.partitionBy("k", "kind").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("long")).withColumn("start", F.col("end") - F.col("len"))
    valid = reduce(lambda rest, i: F.when(F.col("kind") == i, _valid(KINDS[i], F.col("match"))).otherwise(rest), range(len(KINDS)), F.lit(True))
    return placed.filter(valid).select("doc_id", "k", "kind", "start", "end", "match", "left", "right")


# ------------------------------------------------------------- tokens and patterns


def _shape(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def _codes(strings: Column, most: int) -> Column:
    """A hash per string, 1 for those that are too long to be told apart."""
    return F.transform(strings, lambda s: F.when(F.length(s) > most, F.lit(1).cast("long")).otherwise(F.xxhash64(s)))


def _read(text: Column) -> list[Column]:
    """Codes of the tokens of a shaped text, and of the separators before, between and behind them."""
    return [_codes(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), LONG_TOKEN).alias("tokens"), _codes(F.split(text, RUN, -1), LONG_GAP).alias("gaps")]


def _pattern(side: str, gap: Column, token: Column, next_gap: Column, next_token: Column) -> Column:
    """Hash of a context from the inside out; what is too long ends it.  Nothing on this side: no pattern."""
    mark = F.lit(side)
    whole_ = F.xxhash64(mark, gap, token, next_gap, next_token)
    return F.when(token.isNull(), F.lit(None).cast("long")).when(gap == 1, F.xxhash64(mark, gap)).when(token == 1, F.xxhash64(mark, gap, token)).when(
        next_gap == 1, F.xxhash64(mark, gap, token, next_gap)
    ).otherwise(whole_)


def _left(i: Column) -> Column:
    return _pattern("<", F.get("gaps", i), F.get("tokens", i - 1), F.get("gaps", i - 1), F.get("tokens", i - 2))


def _right(i: Column) -> Column:
    return _pattern(">", F.get("gaps", i + 1), F.get("tokens", i + 1), F.get("gaps", i + 2), F.get("tokens", i + 2))


def seed_patterns(found: DataFrame) -> DataFrame:
    """``found`` with the patterns of each span, as the passes over whole texts see them."""
    def side(name: str) -> DataFrame:
        return found.select("doc_id", "k", "kind", "start", "end", F.xxhash64(F.lower("match")).alias("instance"), *_read(_shape(F.col(name))))

    n = F.size("tokens")
    left = side("left").withColumn("pattern", _pattern("<", F.get("gaps", n), F.get("tokens", n - 1), F.get("gaps", n - 1), F.get("tokens", n - 2)))
    right = side("right").withColumn("pattern", _pattern(">", F.get("gaps", F.lit(0)), F.get("tokens", F.lit(0)), F.get("gaps", F.lit(1)), F.get("tokens", F.lit(1))))
    return left.unionByName(right).drop("tokens", "gaps").filter("pattern is not null")


def _starts(strings: Column) -> Column:
    """Where each string of an array begins, and at last where they end; the array is short."""
    return F.aggregate(F.transform(strings, F.length), F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))


def _blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, k, at, before, block, after) over whole texts; a block begins where the one before ends, and no token is cut."""
    cut = lambda text, size: F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}+[^{STOPS}]*+"), F.lit(0))
    outer = docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.when(F.length(whole()) <= OUTER, F.array(whole())).otherwise(cut(whole(), OUTER)).alias("bs"))
    none = F.lit("")
    outer = outer.select("doc_id", "k", "bs", _starts(F.col("bs")).alias("ats")).select("doc_id", "k", "bs", "ats", F.posexplode("bs").alias("i", "b"))
    outer = outer.select(
        "doc_id", "k", F.get("ats", F.col("i")).alias("from"), cut(F.col("b"), BLOCK).alias("bs"),
        F.right(F.coalesce(F.get("bs", F.col("i") - 1), none), F.lit(CONTEXT)).alias("before"), F.substring(F.coalesce(F.get("bs", F.col("i") + 1), none), 1, AHEAD).alias("after"),
    )
    inner = outer.select("doc_id", "k", "from", "bs", "before", "after", _starts(F.col("bs")).alias("ats")).select("*", F.posexplode("bs").alias("i", "block"))
    i = F.col("i")
    later = F.concat(F.coalesce(F.get("bs", i + 1), none), F.when(i + 2 >= F.size("bs"), F.col("after")).otherwise(none))
    return inner.select(
        "doc_id", "k", (F.col("from") + F.get("ats", i)).alias("at"), F.when(i == 0, F.col("before")).otherwise(F.right(F.get("bs", i - 1), F.lit(CONTEXT))).alias("before"),
        "block", F.substring(later, 1, AHEAD).alias("after"),
    )


def _tokens(docs: DataFrame, *more: Column) -> DataFrame:
    """A row per token of whole texts: its number ``i`` in the arrays of its block and surroundings.

    ``tokens`` and ``gaps`` hold codes; ``text`` (of block and surroundings),
    ``at`` (where it begins) and ``more``, all made once per block, come along
    and are not copied as long as rows are only filtered or meet broadcast rows.
    """
    count = lambda text: F.size(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))
    blocks = _blocks(docs).select(
        "doc_id", "k", (F.col("at") - F.length("before")).alias("at"), F.concat("before", "block", "after").alias("text"),
        count(F.col("before")).alias("first"), count(F.col("after")).alias("behind"),
    )
    read = blocks.select("doc_id", "k", "at", "text", "first", "behind", *_read(_shape(F.col("text"))), *more)
    rows = read.select("*", F.posexplode("tokens").alias("i", "_token")).drop("_token")
    return rows.filter((F.col("i") >= F.col("first")) & (F.col("i") < F.size("tokens") - F.col("behind")))


def _lengths() -> list[Column]:
    """Per block: lengths of its tokens, and where each of them ends (after the first element, 0)."""
    sizes = F.transform(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), F.length)
    steps = F.zip_with(sizes, F.transform(F.split("text", RUN, -1), F.length), lambda t, g: F.coalesce(t, F.lit(0)) + g)
    return [sizes.alias("sizes"), F.aggregate(steps, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n))).alias("ends")]


def _span(i: Column, to: Column) -> tuple[Column, Column]:
    """Start and end of the tokens ``i`` to ``to`` in the text of their block."""
    return F.get("ends", i + 1) - F.get("sizes", i), F.get("ends", to + 1)


def pattern_places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places): how many tokens stand where a pattern of ``patterns`` says; the row without pattern counts the others."""
    known = small(patterns.select(F.col("pattern").alias("_p")).distinct(), SMALL_ROWS)
    each = _tokens(docs).select(F.explode(F.array(_left(F.col("i")), _right(F.col("i")))).alias("pattern"))
    # A left join: all tokens stream through it into the map-side counts, whatever share of them is known.
    met = each.join(known, F.col("pattern") == F.col("_p"), "left").groupBy("_p").agg(F.count(F.lit(1)).alias("places"))
    return met.withColumnRenamed("_p", "pattern")


def others(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Tokens with digits (kind 9) and other ones (kind 10) in the places of ``patterns``: doc_id, k, kind, start, end, instance, patterns."""
    rows = _tokens(docs).withColumn("_l", _left(F.col("i"))).withColumn("_r", _right(F.col("i")))
    known = patterns.select("pattern").distinct()
    for side in ("_l", "_r"):
        rows = rows.join(small(known.select(F.col("pattern").alias(side), F.lit(True).alias(f"{side}_known")), SMALL_ROWS), side, "left")
    some = rows.filter("_l_known or _r_known").select(
        "doc_id", "k", "at", "text", "i", F.when(F.col("_l_known"), F.col("_l")).alias("left"), F.when(F.col("_r_known"), F.col("_r")).alias("right")
    )
    # What follows is worked out for the tokens that are left.
    spaced = F.transform(F.split("text", RUN, -1), lambda g: F.rlike(g, F.lit(r"\s"))).alias("spaced")
    some = some.select("*", spaced, *_lengths())
    i, n = F.col("i"), F.size("sizes")
    # A run between white space with delimiters inside begins or ends with the token.
    ahead = F.array_position(F.slice("spaced", i + 2, LONG_WIDE), True).cast("int")
    last = F.when(ahead > 0, i + ahead - 1).when(n - i <= LONG_WIDE, n - 1)
    back = F.array_position(F.reverse(F.slice("spaced", F.greatest(i + 2 - LONG_WIDE, F.lit(1)), F.least(i + 1, F.lit(LONG_WIDE)))), True).cast("int")
    first = F.when(back > 0, i - back + 1).when(i < LONG_WIDE, 0)
    opens = F.col("left").isNotNull() & (F.get("spaced", i) | (i == 0)) & (last > i)
    closes = F.col("right").isNotNull() & ((i == n - 1) | F.get("spaced", i + 1)) & (first < i)
    place = lambda a, b, *p: F.struct(a.alias("a"), b.alias("b"), F.array_compact(F.array(*p)).alias("patterns"))
    three = F.array(place(i, i, F.col("left"), F.col("right")), F.when(opens, place(i, last, F.col("left"))), F.when(closes, place(first, i, F.col("right"))))
    each = some.select("doc_id", "k", "at", "text", "sizes", "ends", F.explode(three).alias("p")).filter("p is not null")
    start, end = _span(F.col("p.a"), F.col("p.b"))
    each = each.select("doc_id", "k", "at", "text", start.alias("s"), end.alias("e"), (F.col("p.b") > F.col("p.a")).alias("wide"), "p.patterns")
    each = each.filter(~F.col("wide") | (F.col("e") - F.col("s") <= LONG_WIDE))
    match = F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s"))
    kind = F.when(F.rlike(match, F.lit("[0-9]")) & ~F.col("wide"), 9).otherwise(10)
    spots = each.select(
        "doc_id", "k", kind.alias("kind"), (F.col("at") + F.col("s")).cast("long").alias("start"), (F.col("at") + F.col("e")).cast("long").alias("end"),
        F.xxhash64(F.lower(match)).alias("instance"), "patterns",
    )
    return spots.groupBy("doc_id", "k", "kind", "start", "end", "instance").agg(F.array_distinct(F.flatten(F.collect_list("patterns"))).alias("patterns"))


def instance_places(docs: DataFrame, instances: DataFrame) -> DataFrame:
    """Every place of the tokens whose hash is one of ``instances`` (instance, as_kind), with digits: doc_id, k, kind, start, end."""
    some = docs.filter(F.rlike(whole(), F.lit("[0-9]")))
    raw = F.transform(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), lambda t: F.xxhash64(F.lower(t))).alias("raw")
    start, end = _span(F.col("i"), F.col("i"))
    rows = _tokens(some, raw, *_lengths()).select("doc_id", "k", "at", start.alias("s"), end.alias("e"), F.get("raw", F.col("i")).alias("instance"))
    kept = rows.join(small(instances, SMALL_ROWS), "instance")
    return kept.select("doc_id", "k", F.col("as_kind").alias("kind"), (F.col("at") + F.col("s")).cast("long").alias("start"), (F.col("at") + F.col("e")).cast("long").alias("end")).distinct()


def _free(found: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of ``found`` that no base span overlaps; base spans are those of the same text."""
    both = found.withColumn("_base", F.lit(False)).unionByName(base.select("doc_id", "k", "start", "end", F.lit(True).alias("_base")), allowMissingColumns=True)
    before = Window.partitionBy("doc_id", "k").orderBy("start", "_base").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "k").orderBy(F.desc("start"), F.desc("_base")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        both.withColumn("_to", F.coalesce(F.max(F.when(F.col("_base"), F.col("end"))).over(before), F.lit(-1)))
        .withColumn("_from", F.min(F.when(F.col("_base"), F.col("start"))).over(after))
        .filter(~F.col("_base") & (F.col("_to") <= F.col("start")) & (F.col("_from").isNull() | (F.col("_from") >= F.col("end"))))
        .drop("_to", "_from", "_base")
    )


def bootstrap(found: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Tokens that contexts mark as identifiers: (doc_id, k, kind, start, end) with kind 4 + base kind.

    ``found`` are the ``places`` of ``docs``.  All tables here are as small as
    the number of identifiers and of places like theirs; patterns are
    aggregated before they meet their instances, so a common context is one
    row on its side of each join.
    """
    seeds = stored(seed_patterns(found), "seed-patterns")
    enough = stored(seeds.groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("seeds"), F.count(F.lit(1)).alias("stand")).filter(F.col("seeds") >= SEEDS), "patterns")
    counted = stored(pattern_places(docs, enough), "pattern-places")
    good = stored(enough.join(counted, "pattern", "left").filter(F.col("stand") >= SHARE * F.coalesce("places", F.lit(0))).select("pattern", "kind"), "good-patterns")
    if not good.limit(1).count():  # nothing can be found through contexts
        return found.select("doc_id", "k", "kind", "start", "end").limit(0)
    spots = stored(_free(others(docs, good), found), "spots")
    mine = seeds.join(good.select("pattern").distinct(), "pattern", "left_semi")
    edges = stored(spots.select(F.explode("patterns").alias("pattern"), "instance", "kind").unionByName(mine.select("pattern", "instance", "kind")).distinct(), "edges")
    known_as = found.select(F.xxhash64(F.lower("match")).alias("instance"), "kind").distinct()
    links = edges.select("pattern", "instance").distinct()
    n_instances = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    weighed = good.join(n_instances, "pattern")
    scores = known_as.withColumn("score", F.lit(1.0))
    missed = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("trust")))))
    for _ in range(rounds):
        known = links.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("known"))
        trust = stored(weighed.join(known, ["pattern", "kind"]).select("pattern", "kind", (F.col("known") / (F.col("n") + 1)).alias("trust")), "trust")
        reached = links.join(trust, "pattern").groupBy("instance", "kind").agg((1 - missed).alias("reach"))
        scores = stored(
            reached.join(known_as.withColumn("seed", F.lit(1.0)), ["instance", "kind"], "full")
            .select("instance", "kind", F.coalesce("seed", "reach").alias("score")), "scores",
        )
    best = Window.partitionBy("instance").orderBy(F.desc("score"), "kind")
    with_digits = spots.filter("kind = 9").select("instance").distinct()
    chosen = stored(
        scores.join(known_as.select("instance").distinct(), "instance", "left_anti").join(with_digits, "instance", "left_semi").filter(F.col("score") >= ACCEPT)
        .withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("instance", (F.col("kind") + len(KINDS)).alias("as_kind")), "chosen",
    )
    place = ["doc_id", "k", "start", "end"]
    every = (
        spots.filter("kind = 10").select(*place, F.explode("patterns").alias("pattern")).join(trust, "pattern")
        .groupBy(*place, "kind").agg((1 - missed).alias("score")).filter(F.col("score") >= ACCEPT)
        .withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy(F.desc("score"), "kind"))).filter("_r = 1")
        .select("doc_id", "k", (F.col("kind") + len(KINDS)).alias("kind"), "start", "end")
    )
    if chosen.limit(1).count():
        every = every.unionByName(_free(instance_places(docs, chosen), found))
    outer = Window.partitionBy("doc_id", "k").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("_reach", F.coalesce(F.max("end").over(outer), F.lit(-1))).filter(F.col("_reach") < F.col("end")).drop("_reach")


def kind_name(kind: Column) -> Column:
    names = KINDS + [f"context_{k}" for k in KINDS]
    return F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, k, kind, start, end) of base spans and of those found through contexts."""
    found = stored(places(docs), "places")
    base = found.select("doc_id", "k", "kind", "start", "end")
    return stored(base.unionByName(bootstrap(found, docs)), "spans")


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by its kind in brackets."""
    before = Window.partitionBy("doc_id", "k").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))
    runs = (
        spans.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(upto))
        .groupBy("doc_id", "k", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind", "end")).alias("kind"))
        .groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("start", "end", kind_name(F.col("kind")).alias("kind")))).alias("_runs"))
    )
    runs = small(stored(runs, "runs"), SMALL_ROWS).withColumnsRenamed({"doc_id": "_doc", "k": "_k"})
    joined = docs.join(runs, (row_key("doc_id", "text") == F.col("_k")) & docs["doc_id"].eqNullSafe(F.col("_doc")), "left")
    done = lambda i: F.coalesce(F.get("_runs", i)["end"], F.lit(0)).cast("int")
    parts = F.transform("_runs", lambda r, i: F.concat(
        F.substring(F.col("text"), done(i - 1) + 1, r["start"].cast("int") - done(i - 1)), F.lit("["), r["kind"], F.lit("]")
    ))
    tail = F.substring(F.col("text"), done(F.size("_runs") - 1) + 1, F.length("text"))
    new = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    return joined.select(*[new.alias("text") if c == "text" else docs[c] for c in docs.columns])


@register("op10_personal_data")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = find_spans(docs)
    each = F.struct("start", "kind", "end")
    text = lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    line = lambda rows: F.array_join(F.transform(F.sort_array(rows), text), ",")
    by_doc = spans.groupBy("doc_id", "k").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{name}") for i, name in enumerate(KINDS)],
        line(F.collect_list(F.when(F.col("kind") < len(KINDS), each))).alias("base"), line(F.collect_list(each)).alias("spans"),
    ).withColumnsRenamed({"doc_id": "_doc", "k": "_k"})
    ids = docs.select("doc_id", row_key("doc_id", "text").alias("k")).distinct()
    found = ids.join(by_doc, (ids["k"] == F.col("_k")) & ids["doc_id"].eqNullSafe(F.col("_doc")), "left")
    return found.select(
        "doc_id", *[F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
