"""Queries on the person-pair network.

Edges are undirected (a < b), one row per pair.  Operators that look at an
anchor take edges with an ``anchor`` column and answer for every anchor in
the frame at once; filter the frame to ask for one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from jointwork.functions.expressions import flag_sum, per_type_sums, top_k
from jointwork.model import ACROSS, EXTERNAL, TYPE_COLUMNS, WITHIN
from jointwork.operators.scopes import author_cap, type_filter
from jointwork.operators.skew import TILE, by_work, cut_lineage, pair_up
from jointwork.sources.writers import stored

LOCAL = 2048  # people of a part of the network that a task works off by itself
STARTS = 256  # sources of such a part that a task takes at once
STATE = 16_000_000  # rows of source and person that a block may hand on
BLOCK = 512  # start people whose arcs a task holds together
CELLS = 2048  # sources, or neighbours, of a matrix that a task holds


def pair_works(
    member: DataFrame,
    work: DataFrame | None = None,
    cap: int | None = None,
    types=None,
    internal_focus: bool = True,
) -> DataFrame:
    """Distinct works per unordered person pair, with per-type counts.

    The author cap and type filter are applied before pairs exist.  Pairs are
    tiled (see ``pair_up``) and counted with map-side combining.  With
    ``internal_focus`` pairs of two external people are left out, as no
    anchor can show them.
    """
    rows = author_cap(member, cap).select("wid", "pid", "is_ext", "n_people")
    if work is not None:
        kinds = type_filter(work.select("wid", "work_type"), types)
        rows = rows.join(by_work(kinds), "wid", "inner" if types else "left")
    pairs = pair_up(rows, "wid", "pid", "n_people")
    if internal_focus:
        pairs = pairs.filter("NOT (is_ext_l AND is_ext_r)")
    keyed = pairs.withColumnRenamed("pid_l", "a").withColumnRenamed("pid_r", "b")
    n = F.count(F.lit(1)).alias("works")
    if work is None:
        return keyed.groupBy("a", "b").agg(n)
    return keyed.groupBy("a", "b").agg(n, *per_type_sums(TYPE_COLUMNS, F.lit(1), "work_type_l"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed copy: every edge from each of its ends, in one pass."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    ends = F.array(
        F.struct(F.col("a").alias("pid"), F.col("b").alias("other")), F.struct(F.col("b").alias("pid"), F.col("a").alias("other"))
    )
    return edges.select(F.explode(ends).alias("_e"), *rest).select("_e.pid", "_e.other", *rest)


def pair_type_counts(edges: DataFrame, affil: DataFrame, kind_units: DataFrame) -> DataFrame:
    """Pair-grain counts per unit and scope, one column per work type.

    ``kind_units`` lists (pid, unit) of the focal side's kind.  A pair is
    "Within Unit" if the partner has the unit and "Across Units" if the
    partner has another unit; a joint partner gives both rows.
    """
    partner = affil.filter("NOT is_ext").groupBy(F.col("pid").alias("other")).agg(
        F.collect_set(F.col("unit_id").cast("string")).alias("p_units")
    )
    rows = both_ways(edges).join(kind_units, "pid").join(partner, "other")
    scope = F.filter(
        F.array(
            F.when(F.array_contains("p_units", F.col("unit_id")), F.lit("Within Unit")),
            F.when(F.size(F.array_remove("p_units", F.col("unit_id"))) > 0, F.lit("Across Units")),
        ),
        lambda s: s.isNotNull(),
    )
    return rows.select(
        "unit_id", F.explode(scope).alias("scope"), "pid", F.col("other").alias("cpid"), *TYPE_COLUMNS.values()
    )


def pair_file_rows(details: DataFrame, work: DataFrame, person: DataFrame) -> DataFrame:
    """What the pair files hold: per unit and pair of internal people the works of each kind, across units per partner unit.

    Counted from detail rows (``both_sides_explode``), so it checks the pair
    counts that come from edges.
    """
    inside = details.filter("rel < 2").withColumn("partner_unit", F.when(F.col("rel") == 1, F.col("c_unit_id")))
    key = ["unit_id", "rel", "pid", "partner_unit", "cpid"]
    one = inside.select(*key, "wid").distinct().join(by_work(work.select("wid", "work_type")), "wid")
    # Most pairs share one work: rows are narrow and brought together first, as counts kept before the shuffle would be wider and no fewer.
    # By the unit and a share of its people: rows of a pair stay side by side and compress, and a unit's files come from a few tasks.
    met = one.select(*key, "work_type", F.pmod(F.xxhash64("pid"), F.lit(64)).alias("_share")).repartition("unit_id", "_share")
    counts = met.groupBy(*key, "_share").agg(*[flag_sum(F.col("work_type") == t).alias(c) for t, c in TYPE_COLUMNS.items()]).select(
        F.col("unit_id").cast("string").alias("unit"), "rel", "pid", F.col("partner_unit").cast("string").alias("partner_unit"), "cpid", *TYPE_COLUMNS.values()
    )
    name = lambda pid, out: person.groupBy(F.col("pid").alias(pid)).agg(F.min("pname").alias(out))
    return counts.join(name("pid", "scholar"), "pid").join(name("cpid", "partner"), "cpid")


def degree(edges: DataFrame) -> DataFrame:
    """Distinct collaborators per person."""
    return both_ways(edges.select("a", "b")).groupBy("pid").agg(F.count_distinct("other").alias("degree"))


def weighted_degree(anchor_edges: DataFrame, rank_by: int | None = None) -> DataFrame:
    """Total works over edges and the part used for ranking."""
    ranked = F.lit(True) if rank_by is None else F.col("rel") == rank_by
    return (
        both_ways(anchor_edges.select("anchor", "a", "b", "works", "rel"))
        .groupBy("anchor", "pid")
        .agg(F.sum("works").alias("deg"), F.sum(F.when(ranked, F.col("works")).otherwise(0)).alias("rank_weight"))
    )


def visible_people(
    anchor_edges: DataFrame, members: DataFrame, top_anchors: int = 50, partner_limit: int = 150,
    top_n: int = 50, rank_by: int | None = None, requested: DataFrame | None = None,
) -> DataFrame:
    """People of the person graph: strongest anchor people, then partners.

    ``requested`` (anchor, pid) rows are kept even outside the top k.
    """
    # Stored: the planner would pick members before it sums, and shuffle every edge for that.
    weights = stored(weighted_degree(anchor_edges, rank_by), "weights")
    ours = weights.join(members, ["anchor", "pid"], "left_semi")
    # Stored, so that the planner knows these are a few people and need not shuffle the edges for them.
    shown = stored(_keep(ours, top_anchors, [F.desc("rank_weight"), F.asc("pid")], requested), "shown")
    ends = both_ways(anchor_edges.select("anchor", "a", "b"))
    partners = (
        ends.join(shown.select("anchor", "pid"), ["anchor", "pid"], "left_semi")
        .select("anchor", F.col("other").alias("pid")).distinct()
        .join(shown.select("anchor", "pid"), ["anchor", "pid"], "left_anti")
    )
    strong = _keep(
        weights.join(partners, ["anchor", "pid"], "left_semi"),
        min(partner_limit, top_n), [F.desc("deg"), F.asc("pid")], requested,
    )
    cols = ["anchor", "pid", "deg"]
    return shown.select(*cols, F.lit("anchor").alias("role")).union(strong.select(*cols, F.lit("partner").alias("role")))


def _keep(rows: DataFrame, k: int, order, requested: DataFrame | None) -> DataFrame:
    kept = top_k(rows, k, order, ["anchor"]).drop("rnk")
    if requested is None:
        return kept
    asked = rows.join(requested.select("anchor", "pid"), ["anchor", "pid"], "left_semi")
    return kept.union(asked.select(*kept.columns)).distinct()


def person_graph(anchor_edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges between visible people."""
    v = visible.select("anchor", "pid")
    return (
        anchor_edges.join(v.withColumnRenamed("pid", "a"), ["anchor", "a"], "left_semi")
        .join(v.withColumnRenamed("pid", "b"), ["anchor", "b"], "left_semi")
        .select("anchor", "a", "b", "works", "rel")
    )


def person_graph_summary(anchor_edges: DataFrame, members: DataFrame, visible: DataFrame) -> DataFrame:
    """Shown and dropped people per anchor; partners are those of the shown anchor people."""
    arcs = both_ways(anchor_edges.select("anchor", "a", "b"))
    # Stored: the planner would pick members before the people are distinct, and shuffle every edge for that.
    ends = stored(arcs.select("anchor", "pid").distinct(), "ends")
    mine = visible.filter("role = 'anchor'").select("anchor", "pid")
    partners = (
        arcs.join(mine, ["anchor", "pid"], "left_semi").select("anchor", F.col("other").alias("pid")).distinct()
        .join(mine, ["anchor", "pid"], "left_anti").groupBy("anchor").agg(F.count(F.lit(1)).alias("total_partners"))
    )
    anchors = ends.join(members, ["anchor", "pid"], "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("total_anchors"))
    shown = visible.groupBy("anchor").agg(
        flag_sum(F.col("role") == "anchor").alias("shown_anchors"),
        flag_sum(F.col("role") == "partner").alias("shown_partners"),
    )
    all_partners = F.coalesce("total_partners", F.lit(0))
    return anchors.join(shown, "anchor").join(partners, "anchor", "left").select(
        "anchor", "total_anchors", "shown_anchors", "shown_partners", all_partners.alias("total_partners"),
        (F.col("total_anchors") - F.col("shown_anchors")).alias("dropped_anchors"),
        (all_partners - F.col("shown_partners")).alias("dropped_partners"),
    )


def strongest_people(anchor_edges: DataFrame, members: DataFrame) -> DataFrame:
    """Default focus of every anchor: its person with the most works."""
    ours = stored(weighted_degree(anchor_edges), "weights").join(members, ["anchor", "pid"], "left_semi")
    return ours.groupBy("anchor").agg(
        F.min(F.struct((-F.col("deg")).alias("d"), F.col("pid").alias("pid"))).alias("best")
    ).select("anchor", "best.pid")


def ego(anchor_edges: DataFrame, focus: DataFrame, limit: int = 150) -> DataFrame:
    """Strongest neighbours of the focus person of each anchor."""
    near = both_ways(anchor_edges.select("anchor", "a", "b", "works", "rel")).join(focus, ["anchor", "pid"], "left_semi")
    return top_k(near, limit, [F.desc("works"), F.asc("other")], ["anchor"])


def connections(anchor_edges: DataFrame, pid) -> DataFrame:
    """Neighbours of one person; edges are filtered before they are doubled."""
    mine = anchor_edges.filter((F.col("a") == pid) | (F.col("b") == pid))
    return both_ways(mine).filter(F.col("pid") == pid)


def compare_anchors(entries: DataFrame, wanted: DataFrame, scope_rels, limit: int = 100) -> DataFrame:
    """Partners of two anchors side by side, for every requested pair.

    Each anchor is first cut to its top ``limit`` entries, then the lists meet
    on (name, rel).
    """
    # Both sides read them: stored, the entries are counted once.
    kept = stored(
        top_k(entries.filter(F.col("rel").isin(*scope_rels)), limit, [F.desc("works"), F.asc("name"), F.asc("rel")], ["anchor"]), "entries"
    )
    side = lambda a, w: wanted.join(kept.withColumnRenamed("anchor", a), a).select(
        "anchor_a", "anchor_b", "name", "rel", F.col("works").alias(w)
    )
    both = side("anchor_a", "works_a").join(
        side("anchor_b", "works_b"), ["anchor_a", "anchor_b", "name", "rel"], "full_outer"
    )
    return both.select(
        "anchor_a", "anchor_b", "name", "rel",
        F.when(F.col("works_a").isNotNull() & F.col("works_b").isNotNull(), "shared")
        .when(F.col("works_a").isNotNull(), "a").otherwise("b").alias("side"),
        F.coalesce("works_a", F.lit(0)).alias("works_a"),
        F.coalesce("works_b", F.lit(0)).alias("works_b"),
    )


def compare_shared(compared: DataFrame) -> DataFrame:
    """Partners of both sides by name: works of each side and together, and the nearer relation."""
    return (
        compared.groupBy("anchor_a", "anchor_b", "name")
        .agg(F.sum("works_a").alias("works_a"), F.sum("works_b").alias("works_b"), F.min("rel").alias("rel"))
        .filter("works_a > 0 and works_b > 0").withColumn("works", F.col("works_a") + F.col("works_b"))
    )


def compare_totals(compared: DataFrame) -> DataFrame:
    """Shown entries and works per pair and side (shared, a, b)."""
    return compared.groupBy("anchor_a", "anchor_b", "side").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("works_a").alias("works_a"), F.sum("works_b").alias("works_b")
    )


def shortest_paths(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Fewest-hop paths for a table of requests, each inside one anchor's edges.

    ``edges`` (anchor, a, b, works, rel), ``requests`` (request, anchor, start,
    end) -> (request, status, step, pid, works, rel): one row per person on the
    path, with the edge that leads to it; status ``path``, ``same`` (one row,
    step 0) or ``none`` (one row without a person).

    Breadth first for all requests together: the frontiers join the edges, a
    newly reached person keeps its smallest predecessor, and visited people
    leave by an anti join.  The search goes on until no frontier is left, so a
    long path is found like a short one.  Each hop is stored; the driver
    sees whether rows are left.  Stored frontiers have a known size, so edges
    are not shuffled again for a few people.  ``edges`` are read at every hop and
    doubled there; store them first if they are dear.
    """
    asked = stored(requests.select("request", "anchor", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")), "requests")
    arcs = both_ways(edges.select("anchor", "a", "b", "works", "rel"))
    adjacency = arcs.select("anchor", F.col("pid").alias("src"), F.col("other").alias("pid"), "works", "rel")
    open_ = asked.filter("start is not null and end is not null and start <> end")
    frontier = stored(open_.select("request", "anchor", F.col("start").alias("pid")), "frontier")
    visited = frontier.select("request", "pid")
    goals = open_.select("request", F.col("end").alias("pid"))
    layers, reached_goals = [], []
    while not frontier.isEmpty():
        reached = stored(
            frontier.withColumnRenamed("pid", "src").join(adjacency, ["anchor", "src"])
            .join(visited, ["request", "pid"], "left_anti")
            .groupBy("request", "anchor", "pid").agg(F.min(F.struct("src", "works", "rel")).alias("via"))
            .select("request", "anchor", "pid", "via.src", "via.works", "via.rel"),
            "reached",
        )
        done = stored(reached.join(goals, ["request", "pid"], "left_semi").select("request", "pid"), "done")
        layers.append(reached)
        reached_goals.append(done)
        visited = visited.union(reached.select("request", "pid"))
        frontier = stored(reached.join(done.select("request"), "request", "left_anti").select("request", "anchor", "pid"), "frontier")
    steps, cursor = [], None
    for hop in range(len(layers), 0, -1):
        here = reached_goals[hop - 1] if cursor is None else cursor.union(reached_goals[hop - 1])
        rows = stored(layers[hop - 1].join(here, ["request", "pid"]), "steps")
        steps.append(rows.select("request", F.lit("path").alias("status"), F.lit(hop).alias("step"), "pid", "works", "rel"))
        cursor = rows.select("request", F.col("src").alias("pid"))
    found = None
    for part in steps:
        found = part if found is None else found.union(part)
    reached_ids = None if found is None else found.select("request").distinct()
    start = asked.select("request", "start", F.when(F.col("start") == F.col("end"), "same").otherwise("none").alias("status"))
    if reached_ids is not None:
        start = start.join(reached_ids.withColumn("_hit", F.lit(1)), "request", "left")
        start = start.withColumn("status", F.when(F.col("_hit") == 1, "path").otherwise(F.col("status")))
    person = F.when(F.col("status") != "none", F.col("start"))
    firsts = start.select(
        "request", "status", F.when(F.col("status") != "none", 0).cast("int").alias("step"), person.alias("pid"),
        F.lit(None).cast("bigint").alias("works"), F.lit(None).cast("int").alias("rel"),
    )
    return firsts if found is None else firsts.union(found.select(*firsts.columns))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, batch: int = 2048) -> DataFrame:
    """Shortest-path centrality of every person (unweighted, undirected).

    Brandes 2001 for about ``batch`` sources at a time: all of them advance
    together, one hop per step, until no frontier is left; the way back hands
    dependencies from each layer to the one before.  State is one row per
    source of the batch and person; sums per person are added over the
    batches, and every source is done.  Parts of the network that hang together
    and have at most ``LOCAL`` people are worked off inside tasks.  ``sources``
    (pid) limits the start points to a chosen sample; the sum is then scaled up.
    """
    net = _network(edges)
    people = net.placed.select("v")
    starts = stored(people.select(F.col("v").alias("s")) if sources is None else sources.select(F.col("pid").alias("s")).distinct(), "starts")
    total = people.select("v", F.lit(0.0).alias("delta")).union(_dependencies(net, starts, batch).select("v", "delta"))
    scale = F.lit(0.5)
    if sources is not None:
        counts = people.agg(F.count(F.lit(1)).alias("n_all")).withColumn("one", F.lit(1)).join(
            starts.agg(F.count(F.lit(1)).alias("n_src")).withColumn("one", F.lit(1)), "one"
        )
        total = total.withColumn("one", F.lit(1)).join(F.broadcast(counts), "one")
        scale = F.col("n_all") / F.col("n_src") * 0.5
    return total.groupBy(F.col("v").alias("pid")).agg(F.round(F.sum(F.col("delta") * scale), 6).alias("betweenness"))


def sampled_betweenness(edges: DataFrame, eps: float, delta: float, first: int = 64) -> DataFrame:
    """(pid, betweenness, error, n_sources): centrality from sampled sources, with a stated error.

    With probability 1 - ``delta`` every value is within its ``error`` of the
    exact one, and no error exceeds ``eps`` * n * (n - 2) / 2, the scale of the
    measure.  A source's share in a person lies between 0 and n - 2, so the
    empirical Bernstein bound holds for the mean over the sources; it is taken
    for all people and rounds at once.  Sources come in the order of the hash
    of their id; their number doubles until the bound is met, so at most about
    ln(n / delta) / eps^2 sources are used and the number of jobs depends on
    the longest path, not on n.  When every person is a source the values are
    exact and the error is 0.
    """
    net = _network(edges)
    people = net.placed.select("v")
    n = people.count()
    if n < 3:
        return people.select(F.col("v").alias("pid"), F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("error"), F.lit(n).cast("bigint").alias("n_sources"))
    rounds = max(1, math.ceil(math.log2(max(2.0, n / first))) + 1)
    log_term = math.log(3 * n * rounds / delta)
    # Samples are nested: each round adds the sources between two places in the order of the hash.
    order = people.select(F.col("v").alias("s"), F.xxhash64("v").alias("h"))
    done, used, sums = 0, min(first, n), None
    while True:
        taken = order.orderBy("h", "s").limit(used)
        new = cut_lineage(taken if done == 0 else taken.join(order.orderBy("h", "s").limit(done), ["s", "h"], "left_anti")).select("s")
        part = _dependencies(net, new)
        sums = part if sums is None else sums.union(part).groupBy("v").agg(F.sum("delta").alias("delta"), F.sum("squares").alias("squares"))
        sums = cut_lineage(sums)
        mean = F.coalesce("delta", F.lit(0.0)) / (used * (n - 2))
        variance = F.greatest(F.lit(0.0), F.coalesce("squares", F.lit(0.0)) / (used * (n - 2) ** 2) - mean * mean)
        width = F.lit(0.0) if used == n else F.sqrt(2 * variance * log_term / used) + 3 * log_term / used
        found = people.join(sums, "v", "left").select(F.col("v").alias("pid"), mean.alias("mean"), width.alias("width"))
        if used == n or found.agg(F.max("width")).first()[0] <= eps:
            break
        done, used = used, min(2 * used, n)
    scale = 0.5 * n * (n - 2)
    return found.select("pid", F.round(F.col("mean") * scale, 6).alias("betweenness"), F.round(F.col("width") * scale, 6).alias("error"), F.lit(used).cast("bigint").alias("n_sources"))


def _arc_blocks(edges: DataFrame) -> tuple[DataFrame, int]:
    """(block, v, w), every edge from each of its ends, by blocks of about ``BLOCK`` start people; and the number of blocks."""
    arcs = stored(both_ways(edges.select("a", "b")).select(F.col("pid").alias("v"), F.col("other").alias("w")).distinct(), "arcs")
    return _blocks(arcs)


def _blocks(arcs: DataFrame) -> tuple[DataFrame, int]:
    n_blocks = max(1, -(-arcs.select("v").distinct().count() // BLOCK))
    return arcs.select(F.pmod(F.xxhash64("v"), F.lit(n_blocks)).alias("block"), "v", "w"), n_blocks


def _spread(rows: DataFrame, arcs: DataFrame, n_blocks: int) -> DataFrame:
    """(s, v, x): x of every row (s, v, x) handed to all neighbours of v, and summed there.

    Rows meet the arcs of their block as matrices, so a task holds sums per
    source and neighbour and never a row per source and arc.
    """
    placed = rows.select(F.pmod(F.xxhash64("v"), F.lit(n_blocks)).alias("block"), "s", "v", "x")
    met = placed.groupBy("block").cogroup(arcs.groupBy("block")).applyInArrow(_product, "s long, v long, x double")
    return met.groupBy("s", "v").agg(F.sum("x").alias("x"))


def _product(rows: pa.Table, arcs: pa.Table) -> pa.Table:
    out = [([], [], [])]
    if rows.num_rows and arcs.num_rows:
        v, from_v = np.unique(arcs["v"].to_numpy(), return_inverse=True)
        w, to_w = np.unique(arcs["w"].to_numpy(), return_inverse=True)
        order = np.argsort(to_w, kind="stable")
        from_v, to_w = from_v[order], to_w[order]
        s, source = np.unique(rows["s"].to_numpy(), return_inverse=True)
        place, x = np.searchsorted(v, rows["v"].to_numpy()), rows["x"].to_numpy()
        has_arcs = np.isin(rows["v"].to_numpy(), v)
        for lo in range(0, len(s), CELLS):
            mine = has_arcs & (source >= lo) & (source < lo + CELLS)
            left = np.zeros((min(CELLS, len(s) - lo), len(v)))
            left[source[mine] - lo, place[mine]] = x[mine]
            for at in range(0, len(w), CELLS):
                a, b = np.searchsorted(to_w, [at, at + CELLS])
                right = np.zeros((len(v), min(CELLS, len(w) - at)))
                right[from_v[a:b], to_w[a:b] - at] = 1.0
                sums = left @ right
                i, j = np.nonzero(sums)
                out.append((s[lo + i], w[at + j], sums[i, j]))
    kinds = {"s": pa.int64(), "v": pa.int64(), "x": pa.float64()}
    return pa.table({name: pa.array(np.concatenate([o[k] for o in out]), kind) for k, (name, kind) in enumerate(kinds.items())})


@dataclass
class Network:
    """Arcs as ``_arc_blocks`` gives them; ``packed`` (part, people, arcs), one row per part of at most ``LOCAL`` people; ``placed`` (v, part, size)."""

    arcs: DataFrame
    n_blocks: int
    placed: DataFrame
    packed: DataFrame | None
    n_far: int


def _network(edges: DataFrame) -> Network:
    """The arcs and the parts of the network that hang together.

    Tasks reduce their arcs to one row per person they saw and these are put
    together in two more steps, so the last task holds a few rows per person.
    """
    arcs, n_blocks = _arc_blocks(edges)
    roots = arcs.filter("v <= w").select("v", "w").mapInArrow(_roots, "v long, w long")
    for tasks in (8, 1):
        roots = roots.repartition(tasks).mapInArrow(_roots, "v long, w long")
    placed = stored(roots.select("v", F.col("w").alias("part"), F.count(F.lit(1)).over(Window.partitionBy("w")).alias("size")), "parts")
    n_far = placed.filter(F.col("size") > LOCAL).count()
    near = placed.filter(F.col("size") <= LOCAL)
    if near.isEmpty():
        return Network(arcs, n_blocks, placed, None, n_far)
    packed = stored(arcs.join(near, "v").groupBy("part").applyInArrow(_pack, "part long, people binary, arcs binary"), "packed")
    if n_far:
        arcs, n_blocks = _blocks(stored(arcs.select("v", "w").join(placed.filter(F.col("size") > LOCAL), "v", "left_semi"), "arcs"))
    return Network(arcs, n_blocks, placed, packed, n_far)


def _roots(batches):
    """(v, w): every person of the batches with the smallest person that hangs together with it there."""
    known, low, held = np.empty(0, np.int64), np.empty(0, np.int64), []

    def merged():
        left = np.concatenate([known, *[x for x, _ in held]])
        right = np.concatenate([low, *[y for _, y in held]])
        ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        a, b, label = at[:len(left)], at[len(left):], np.arange(len(ids))
        while len(ids):
            least, before = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(label, before[a], least)
            np.minimum.at(label, before[b], least)
            while (label[label] != label).any():
                label = label[label]
            if (label == before).all():
                break
        return ids, ids[label]

    for batch in batches:
        held.append((batch.column("v").to_numpy(), batch.column("w").to_numpy()))
        if sum(len(x) for x, _ in held) > 1_000_000:
            known, low = merged()
            held = []
    known, low = merged()
    for at in range(0, len(known), 100_000):
        yield pa.record_batch({"v": known[at:at + 100_000], "w": low[at:at + 100_000]})


def _pack(arcs: pa.Table) -> pa.Table:
    """One part as its sorted people and a bit for every two of them."""
    v, w = arcs["v"].to_numpy(), arcs["w"].to_numpy()
    people = np.unique(v)
    met = np.zeros((len(people), len(people)), bool)
    met[np.searchsorted(people, v), np.searchsorted(people, w)] = True
    return pa.table({"part": arcs["part"][:1], "people": [people.tobytes()], "arcs": [np.packbits(met, axis=1).tobytes()]}, schema=pa.schema([("part", pa.int64()), ("people", pa.binary()), ("arcs", pa.binary())]))


def _part_dependencies(rows: pa.Table) -> pa.Table:
    """(v, delta, squares) of one part from some of its people; the row of the part comes with every start ``s``."""
    people = np.frombuffer(rows["people"][0].as_py(), np.int64)
    n = len(people)
    met = np.unpackbits(np.frombuffer(rows["arcs"][0].as_py(), np.uint8).reshape(n, -1), axis=1, count=n)
    degree = met.sum(axis=1, dtype=np.int64)
    first, near = np.concatenate([[0], np.cumsum(degree)]), np.nonzero(met)[1]
    weights = None
    starts = np.searchsorted(people, np.frombuffer(rows["starts"][0].as_py(), np.int64))
    k = len(starts)

    def spread(at, x):
        """x of the cells ``at`` of (start, person) summed at the neighbours."""
        nonlocal weights
        s, v = np.divmod(at, n)
        arcs = degree[v]
        if arcs.sum() <= 4 * k * n:
            to = np.arange(arcs.sum()) - np.repeat(np.cumsum(arcs) - arcs, arcs) + np.repeat(first[v], arcs)
            return np.bincount(np.repeat(s * n, arcs) + near[to], np.repeat(x, arcs), k * n)
        weights = met.astype(float) if weights is None else weights
        cells = np.zeros(k * n)
        cells[at] = x
        return (cells.reshape(k, n) @ weights).ravel()

    layers, sigma = [np.arange(k) * n + starts], np.zeros(k * n)
    sigma[layers[0]] = 1.0
    while True:
        reached = spread(layers[-1], sigma[layers[-1]])
        new = np.flatnonzero((reached > 0) & (sigma == 0))
        if not len(new):
            break
        sigma[new] = reached[new]
        layers.append(new)
    delta = np.zeros(k * n)
    for layer, below in zip(layers[-2:0:-1], layers[:1:-1], strict=True):
        delta[layer] = sigma[layer] * spread(below, (1 + delta[below]) / sigma[below])[layer]
    shares = delta.reshape(k, n)
    return pa.table({"v": people, "delta": shares.sum(axis=0), "squares": (shares * shares).sum(axis=0)})


def _dependencies(net: Network, starts: DataFrame, batch: int = 2048) -> DataFrame:
    """(v, delta, squares): what persons have from each of the given sources, and its square, summed over the sources."""
    placed = starts.select("s").join(net.placed.withColumnRenamed("v", "s"), "s")
    found = []
    if net.packed is not None:
        few = placed.filter(F.col("size") <= LOCAL).select("part", "s", F.pmod(F.xxhash64("s"), F.ceil(F.col("size") / F.lit(STARTS))).alias("k"))
        some = few.groupBy("part", "k").applyInArrow(_start_list, "part long, k long, starts binary")
        work = some.join(net.packed, "part").groupBy("part", "k").applyInArrow(_part_dependencies, "v long, delta double, squares double")
        found.append(stored(work, "dependencies"))
    if net.n_far:
        # The rows a task hands on are at most sources times people.
        batch = max(1, min(batch, STATE // net.n_far))
        far = placed.filter(F.col("size") > LOCAL).select("s")
        n_batches = max(1, -(-far.count() // batch))
        numbered = stored(far.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(n_batches))), "starts")
        found += [_block_dependencies(net.arcs, net.n_blocks, numbered.filter(F.col("part") == part).select("s")) for part in range(n_batches)]
    if not found:
        return starts.select(F.col("s").alias("v"), F.lit(0.0).alias("delta"), F.lit(0.0).alias("squares"))
    return reduce(lambda a, b: a.union(b), found).groupBy("v").agg(F.sum("delta").alias("delta"), F.sum("squares").alias("squares"))


def _start_list(rows: pa.Table) -> pa.Table:
    return pa.table({"part": rows["part"][:1], "k": rows["k"][:1], "starts": pa.array([rows["s"].to_numpy().tobytes()], pa.binary())})


def _block_dependencies(arcs: DataFrame, n_blocks: int, starts: DataFrame) -> DataFrame:
    """As ``_dependencies``, hop by hop over the blocks of arcs; ``arcs`` (block, v, w) and ``n_blocks`` as ``_arc_blocks`` gives them."""
    layers = [stored(starts.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")), "layer")]
    while True:
        # A neighbour of a layer stands in it, in the one before or in the next.
        seen = layers[-1].select("s", "v") if len(layers) == 1 else layers[-1].select("s", "v").union(layers[-2].select("s", "v"))
        reached = _spread(layers[-1].select("s", "v", F.col("sigma").alias("x")), arcs, n_blocks)
        step = stored(reached.join(seen, ["s", "v"], "left_anti").withColumnRenamed("x", "sigma"), "layer")
        if step.isEmpty():
            break
        layers.append(step)
    below, shares = None, None
    for layer in reversed(layers[1:]):
        if below is None:
            here = layer.withColumn("delta", F.lit(0.0))
        else:
            handed = _spread(below.select("s", "v", ((1 + F.col("delta")) / F.col("sigma")).alias("x")), arcs, n_blocks)
            here = stored(
                layer.join(handed, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce(F.col("sigma") * F.col("x"), F.lit(0.0)).alias("delta")), "shares"
            )
        # A person stands in one layer of a source, so each row is the whole share.
        shares = here.select("v", "delta") if shares is None else shares.union(here.select("v", "delta"))
        below = here
    if shares is None:
        return layers[0].select("v", F.lit(0.0).alias("delta"), F.lit(0.0).alias("squares"))
    return stored(shares.groupBy("v").agg(F.sum("delta").alias("delta"), F.sum(F.col("delta") * F.col("delta")).alias("squares")), "dependencies")


def bridge_details(anchor_edges: DataFrame, members: DataFrame, unit_kind: DataFrame) -> DataFrame:
    """(anchor, scholar, partner, partner unit, works) behind the bridges.

    ``unit_kind`` (anchor, unit_type) lists the unit anchors; partner units
    must have the anchor's type and be another unit.
    """
    arcs = both_ways(anchor_edges.filter(F.col("rel") == ACROSS).select("anchor", "a", "b", "works"))
    ours = arcs.join(members, ["anchor", "pid"], "left_semi").join(unit_kind, "anchor")
    theirs = members.join(unit_kind, "anchor").select(
        F.col("anchor").alias("unit"), F.col("pid").alias("other"), "unit_type"
    )
    return ours.join(theirs, ["other", "unit_type"]).filter("unit <> anchor").select(
        "anchor", "pid", "other", "unit", "works"
    )


def bridges(details: DataFrame, n: int = 30) -> DataFrame:
    """Anchor scholars ranked by how many other units they reach.

    Works are summed once per partner, not once per partner unit.
    """
    # per partner first: works of the edge once, whatever its number of units
    partner = details.groupBy("anchor", "pid", "other").agg(F.max("works").alias("works"))
    people = partner.groupBy("anchor", "pid").agg(F.count(F.lit(1)).alias("n_collaborators"), F.sum("works").alias("works"))
    units = details.groupBy("anchor", "pid").agg(F.count_distinct("unit").alias("n_units"))
    score = units.join(people, ["anchor", "pid"])
    return top_k(score, n, [F.desc("n_units"), F.desc("works"), F.asc("pid")], ["anchor"])


def bridge_unit_ties(details: DataFrame, ranking: DataFrame) -> DataFrame:
    """Works of every ranked scholar towards every unit reached."""
    return (
        details.groupBy("anchor", "unit", "pid").agg(F.sum("works").alias("works"))
        .join(ranking.select("anchor", "pid"), ["anchor", "pid"], "left_semi")
    )


def bridge_graph(details: DataFrame, ranking: DataFrame, people: int = 12, units: int = 24) -> DataFrame:
    """Links between the first scholars and the units most of them reach."""
    first = ranking.filter(F.col("rnk") <= people)
    ties = bridge_unit_ties(details, first)
    freq = ties.groupBy("anchor", "unit").agg(F.count(F.lit(1)).alias("freq"))
    kept = top_k(freq, units, [F.desc("freq"), F.asc("unit")], ["anchor"])
    return ties.join(kept.select("anchor", "unit", "freq"), ["anchor", "unit"]).select("anchor", "pid", "unit", "works", "freq")


def fingerprint(anchor_edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Totals per relation, repeat-partner rate and a short description."""
    near = both_ways(anchor_edges.select("anchor", "a", "b", "works", "rel")).join(focus, ["anchor", "pid"], "left_semi")
    total = lambda r: F.sum(F.when(F.col("rel") == r, F.col("works")).otherwise(0))
    base = near.groupBy("anchor", "pid").agg(
        F.count(F.lit(1)).alias("collaborators"),
        total(WITHIN).alias("within_works"),
        total(ACROSS).alias("across_works"),
        total(EXTERNAL).alias("inter_works"),
        flag_sum(F.col("works") > 1).alias("repeat_partners"),
    )
    total_works = F.col("within_works") + F.col("across_works") + F.col("inter_works")
    repeat = F.col("repeat_partners") / F.col("collaborators")
    # Thresholds of the description.
    text = (
        F.when(F.col("across_works") / total_works >= 0.45, "cross-unit connector")
        .when(F.col("inter_works") / total_works >= 0.5, "primarily external")
        .when(repeat >= 0.45, "repeat partnerships")
        .otherwise("centered on the unit")
    )
    return base.withColumn("repeat_pct", F.round(repeat * 100).cast("bigint")).withColumn("profile", text)


def top_institutions(anchor_edges: DataFrame, focus: DataFrame, person: DataFrame, n: int = 5) -> DataFrame:
    """Strongest external institutions of every focus person."""
    near = both_ways(
        anchor_edges.filter(F.col("rel") == EXTERNAL).select("anchor", "a", "b", "works")
    ).join(focus, ["anchor", "pid"], "left_semi")
    inst = near.join(person.select(F.col("pid").alias("other"), "inst"), "other").groupBy("anchor", "pid", "inst").agg(
        F.sum("works").alias("works")
    )
    return top_k(inst, n, [F.desc("works"), F.asc("inst")], ["anchor", "pid"])


def tie_detail(anchor_edges: DataFrame, members: DataFrame, partners: DataFrame, person: DataFrame) -> DataFrame:
    """Person pairs behind a partner number.

    ``partners`` (anchor, partner, rel): for rel 2 the partner is an
    institution, otherwise a unit anchor.  Edges say which of their ends are in
    the anchor.  The few partners asked for and the partners of a person are
    stored for their sizes, so edges meet them where they lie and are not
    unfolded for other partners.
    """
    asked = stored(partners.select("anchor", "partner", "rel").distinct(), "asked")
    # an edge inside the anchor is seen from its smaller end only
    end = lambda x, y: F.struct(F.col(x).alias("pid"), F.col(y).alias("other"))
    arc = F.when(F.col("a_in") == 1, end("a", "b")).when(F.col("b_in") == 1, end("b", "a"))
    arcs = anchor_edges.select("anchor", "rel", "works", arc.alias("e")).filter("e IS NOT NULL").select("anchor", "rel", "works", "e.*")
    kind = lambda rows, pid, name, ext: rows.select(F.col(pid).alias("other"), F.struct(F.col(name).alias("partner"), F.lit(ext).alias("ext")).alias("p"))
    both = kind(members, "pid", "anchor", False).union(kind(person, "pid", "inst", True))
    theirs = stored(both.groupBy("other").agg(F.collect_list("p").alias("theirs")), "theirs")
    met = arcs.join(asked, ["anchor", "rel"]).join(theirs, "other")
    here = F.filter("theirs", lambda p: (p["partner"] == F.col("partner")) & (p["ext"] == (F.col("rel") == EXTERNAL)))
    return met.select("anchor", "partner", "rel", "pid", "other", "works", F.explode(here)).drop("col")


def tie_work_titles(ties: DataFrame, member: DataFrame, person: DataFrame, work: DataFrame, limit: int = 150) -> DataFrame:
    """Works behind a unit's or institution's ties, labelled by the pair of people.

    ``ties`` as ``tie_detail`` gives them.  A work is listed once per anchor
    and partner, under its strongest pair, at most ``limit`` of them.  Ties
    meet the pairs of works of at most ``TILE`` people.  In larger works the
    works of the anchor's person are looked up for the partner's person, so a
    work with very many people brings no pairs beyond the ties.  Names and
    titles join after the cut.
    """
    few = F.coalesce(F.col("n_people") <= TILE, F.lit(True))
    pairs = pair_up(member.filter(few).select("wid", "pid", "is_ext", "n_people"), "wid", "pid", "n_people").filter("NOT (is_ext_l AND is_ext_r)")
    pairs = pairs.select("wid", F.col("pid_l").alias("_a"), F.col("pid_r").alias("_b"))
    ends = ties.withColumn("_a", F.least("pid", "other")).withColumn("_b", F.greatest("pid", "other"))
    key = ["anchor", "partner", "rel"]
    cols = [*key, "wid", "works", "pid", "other"]
    m = member.filter(~few).select("wid", "pid")
    large = ties.join(by_work(m), "pid").join(by_work(m.withColumnRenamed("pid", "other")), ["wid", "other"], "left_semi")
    shared = ends.join(by_work(pairs), ["_a", "_b"]).select(*cols).union(large.select(*cols))
    first = shared.groupBy(*key, "wid").agg(F.min(F.struct((-F.col("works")).alias("w"), "pid", "other")).alias("best"))
    cut = top_k(first, limit, [F.asc("best"), F.asc("wid")], key).select(*key, "wid", "best.pid", "best.other", "rnk")
    name = lambda pid, out: person.groupBy(F.col("pid").alias(pid)).agg(F.min("pname").alias(out))
    return cut.join(name("pid", "_p"), "pid").join(name("other", "_o"), "other").join(by_work(work.select("wid", "title", "pub_year", "work_type")), "wid").select(
        *key, "rnk", "wid", F.concat("_p", F.lit(" & "), "_o").alias("pair"), "title", "pub_year", "work_type"
    )


def node_partners(edges: DataFrame) -> DataFrame:
    """Partners and cross-links of every node of a graph."""
    return both_ways(edges.select("a", "b", "works")).groupBy(F.col("pid").alias("node")).agg(
        F.count(F.lit(1)).alias("partners"), F.sum("works").alias("cross_links")
    )


def edge_work_titles(near: DataFrame, member: DataFrame, work: DataFrame, limit: int = 60) -> DataFrame:
    """Works behind each focus person's connections, strongest first.

    ``near`` (anchor, pid, other, works).  Every work is listed once per
    anchor, under its strongest connection, at most ``limit`` per anchor.
    The focus person's own works are found first and lead to the partners, so
    the rows grow with these works and not with connections times works.  The
    focus people are stored for their size, and members are shuffled by work
    only.  The wide text columns join after the cut.
    """
    m = member.select("wid", "pid")
    focus = stored(near.select("anchor", "pid").distinct(), "focus")
    shared = (
        focus.join(m, "pid")
        .join(by_work(m.withColumnRenamed("pid", "other")), "wid")
        .join(near.select("anchor", "pid", "other", "works"), ["anchor", "pid", "other"])
    )
    first = shared.groupBy("anchor", "wid").agg(
        F.min(F.struct((-F.col("works")).alias("w"), F.col("other").alias("other"))).alias("best")
    )
    cut = top_k(first, limit, [F.asc("best.w"), F.asc("best.other"), F.asc("wid")], ["anchor"])
    # Stored for its size: the few works left are sent to the titles, never the titles to the driver.
    few = stored(cut.select("anchor", "wid", F.col("best.other").alias("other"), "rnk"), "cut")
    return few.join(work.select("wid", "title", "pub_year", "work_type"), "wid")
