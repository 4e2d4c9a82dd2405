"""Temporal property graphs as two tables, and traversals as joins of a frontier with the edges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import mapped
from tracewright.operators.linkage import pairs_within
from tracewright.session import materialize, ship


def edges_of(events: DataFrame, actor: str = "actor_id", target: str = "target_id", t: str = "t", label: str = "event_type", ref: str = "event_id") -> DataFrame:
    """Directed edges (src, dst, t, rel, event_id) of events with both ends."""
    return events.where(F.col(actor).isNotNull() & F.col(target).isNotNull()).select(F.col(actor).alias("src"), F.col(target).alias("dst"), F.col(t).alias("t"), F.col(label).alias("rel"), F.col(ref).alias("event_id"))


def vertices_of(edges: DataFrame) -> DataFrame:
    """Each end of an edge once, with in- and out-degree."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    return out.unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct neighbour pairs in both directions, without self links."""
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.where("src <> dst").select(F.explode(both).alias("x")).select("x.src", "x.dst").distinct()


def collapse(edges: DataFrame) -> DataFrame:
    """Parallel edges of one relation as one, with the first time and the number."""
    return edges.groupBy("src", "rel", "dst").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))


def hop_distances(edges: DataFrame, seeds: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(id, hop): the least number of steps from any seed (column id), up to ``hops``.

    The frontier, and not the reached set, is joined with the edges in each step; each step is written.
    """
    near = edges.where("src <> dst").select("src", "dst").distinct() if directed else undirected(edges)
    if hops > 1:
        near = materialize(near)
    reached = frontier = materialize(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    for k in range(1, hops + 1):
        step = near.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(k)))
        reached = materialize(reached.unionByName(frontier))
    return reached


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Edges among the nodes within ``hops`` of the seeds; the time window is applied afterwards and does not steer the search."""
    inside = hop_distances(edges, seeds, hops).select("id")
    kept = edges.join(inside.select(F.col("id").alias("src")), "src", "left_semi").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
    if start is not None:
        kept = kept.where(F.col("t") >= start)
    return kept if end is None else kept.where(F.col("t") <= end)


def temporal_paths(edges: DataFrame, seeds: DataFrame, goals: DataFrame, hops: int = 3) -> DataFrame:
    """All simple directed paths from a seed to a goal with at most ``hops`` edges and times that never go back: (src, dst, hops, nodes, events).

    One equality join a step with the time order as a condition on it; paths stop at their first goal.
    """
    e = edges.where("src <> dst")
    start = e.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    paths = start.select(F.col("src").alias("origin"), F.col("dst").alias("at"), "t", F.array("src", "dst").alias("nodes"), F.array("event_id").alias("events"))
    goal = goals.select(F.col("id").alias("at")).distinct()
    found = None
    for k in range(1, hops + 1):
        hit = paths.join(goal, "at", "left_semi")
        found = hit if found is None else found.unionByName(hit)
        if k == hops:
            break
        nxt = e.select(F.col("src").alias("at"), F.col("dst").alias("n"), F.col("t").alias("nt"), F.col("event_id").alias("ne"))
        paths = paths.join(goal, "at", "left_anti").join(nxt, "at").where("nt >= t and not array_contains(nodes, n)").select("origin", F.col("n").alias("at"), F.col("nt").alias("t"), F.array_append("nodes", F.col("n")).alias("nodes"), F.array_append("events", F.col("ne")).alias("events"))
    return found.select(F.col("origin").alias("src"), F.col("at").alias("dst"), F.size("events").alias("hops"), "nodes", "events")


def shortest_path_length(edges: DataFrame, a, b, most: int = 12) -> DataFrame:
    """One row (hops): steps between two nodes over undirected edges, null if more than ``most``. Stops as soon as it is known."""
    spark = edges.sparkSession
    near = materialize(undirected(edges))
    frontier = reached = near.where(F.col("src") == a).select(F.col("src").alias("id")).distinct()
    for k in range(most + 1):
        if frontier.where(F.col("id") == b).limit(1).count():
            return spark.createDataFrame([(k,)], "hops int")
        step = near.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(reached, "id", "left_anti"))
        if frontier.isEmpty():
            break
        reached = materialize(reached.union(frontier))
    return spark.createDataFrame([(None,)], "hops int")


def shared_counterparties(edges: DataFrame, max_degree: int = 10_000) -> DataFrame:
    """(a, b, shared), a < b: how many neighbours two nodes have in common.

    The ends of a neighbour with more than ``max_degree`` of them (see :func:`hub_neighbours`) are paired cell by cell, so
    no task holds all of a hub's pairs; none is left out.
    """
    near = undirected(edges).withColumnRenamed("src", "id")
    return pairs_within(near, "dst", max_degree).groupBy(F.col("left_id").alias("a"), F.col("right_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))


def shared_counts(edges: DataFrame, light: int = 64) -> DataFrame:
    """(shared, n_pairs): how many pairs of nodes have so many neighbours in common; :func:`shared_counterparties` counted by ``shared``, without its pairs.

    A neighbour of up to ``light`` ends pairs them. Of the others, the hubs, every node holds its list; nodes with the same
    list are one class, and the classes meet block by block, each block counting what its pairs have in common in memory
    (:func:`block_counts`). Pairs that also share light neighbours are moved from their number of hubs to the sum, in the
    block that knows it. So what is moved are lists of hubs, once a block, and pairs of light neighbours only.
    """
    near = materialize(undirected(edges))
    sizes = near.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    few = near.join(sizes.where((F.col("n") > 1) & (F.col("n") <= light)).select("dst"), "dst")
    pairs = few.withColumnRenamed("src", "a").join(few.withColumnRenamed("src", "b"), "dst").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    hubs = materialize(sizes.where(F.col("n") > light).select("dst", F.monotonically_increasing_id().alias("hub")))
    lists = materialize(near.join(hubs, "dst").groupBy("src").agg(F.array_sort(F.collect_list("hub")).alias("hubs")))
    classes = materialize(lists.groupBy("hubs").agg(F.count(F.lit(1)).alias("n")).withColumn("class", F.monotonically_increasing_id()))
    n, held = classes.agg(F.count(F.lit(1)), F.sum(F.size("hubs"))).first()
    if not n:
        return pairs.groupBy("shared").agg(F.count(F.lit(1)).alias("n_pairs"))
    ship(edges.sparkSession)
    parts = max(8, -(-n // 100_000), -(-held // 4_000_000))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    of = lists.join(classes.select("hubs", "class"), "hubs").select("src", "class")
    both = pairs.join(of.select(F.col("src").alias("a"), F.col("class").alias("x")), "a", "left").join(of.select(F.col("src").alias("b"), F.col("class").alias("y")), "b", "left")
    both = materialize(both.groupBy("x", "y", "shared").agg(F.count(F.lit(1)).alias("n")))
    alone = both.where("x is null or y is null").select("shared", F.col("n").alias("n_pairs"))
    # Blocks are named by their parts p <= q; of rows of two classes the first is of part p.
    met = both.where("x is not null and y is not null").withColumn("turn", part("x") > part("y"))
    met = met.select(F.when(F.col("turn"), F.col("y")).otherwise(F.col("x")).alias("class"), F.when(F.col("turn"), F.col("x")).otherwise(F.col("y")).alias("other"), "n", F.array("shared").alias("hubs"))
    met = met.select(part("class").alias("p"), part("other").alias("q"), F.lit(-1).alias("part"), "class", "other", "n", "hubs")
    side = classes.withColumn("part", part("class")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    side = side.select(F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "part", "class", F.lit(None).cast("bigint").alias("other"), "n", "hubs")
    found = side.unionByName(met).groupBy("p", "q").applyInArrow(_block, "shared bigint, n_pairs bigint")
    return found.unionByName(alone).groupBy("shared").agg(F.sum("n_pairs").alias("n_pairs")).where("n_pairs > 0")


def _block(key, rows):
    """:func:`block_counts` of one block of :func:`shared_counts`."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    p, q = key[0].as_py(), key[1].as_py()
    part, name, n = (rows[c].to_numpy() for c in ("part", "class", "n"))
    of, hubs = np.repeat(np.arange(len(part)), pc.list_value_length(rows["hubs"]).to_numpy()), pc.list_flatten(rows["hubs"]).to_numpy()

    def side(k):
        at = np.flatnonzero(part == k)
        at = at[np.argsort(name[at])]
        place = np.full(len(part), -1)
        place[at] = np.arange(len(at))
        row = place[of]
        order = np.argsort(row, kind="stable")
        order = order[row[order] >= 0]
        return name[at], (row[order], hubs[order], n[at])

    (a, left), (b, right), more = side(p), side(q), part == -1
    x, y = name[more], rows["other"].filter(pa.array(more)).to_numpy()
    counts = block_counts(left, right, p == q, (np.searchsorted(a, x), np.searchsorted(b, y), hubs[(part == -1)[of]], n[more]))
    at = np.flatnonzero(counts)
    at = at[at > 0]
    return pa.table({"shared": pa.array(at, pa.int64()), "n_pairs": pa.array(counts[at], pa.int64())})


def block_counts(left, right, same: bool, more, cells: int = 4_000_000):
    """At i: how many pairs of a left and a right node have i hubs in common; without those of a node with itself, and each once, if both sides are the ``same``.

    A side is (row, hub, n): its hubs ordered by row, and how many nodes each row stands for. ``more`` (left row, right
    row, further, n) moves n pairs to so many further neighbours. Hubs that many rows have are multiplied as matrices,
    the others are looked up; at most ``cells`` pairs of rows are held at once.
    """
    import numpy as np

    (pr, ph, pn), (qr, qh, qn) = left, right
    mr, mc, further, mn = more
    known = np.intersect1d(ph, qh)
    m = len(known)

    def inside(r, h):
        at = np.minimum(np.searchsorted(known, h), max(m - 1, 0))
        keep = known[at] == h if m else np.zeros(len(h), bool)
        return r[keep], at[keep]

    (pr, ph), (qr, qh) = inside(pr, ph), inside(qr, qh)
    in_q = np.bincount(qh, minlength=m)
    weight = np.bincount(ph, minlength=m) * in_q
    wide = np.argsort(-weight)[: 4 * cells // max(len(pn), len(qn), 1)]
    wide = wide[weight[wide] * 64 > len(pn) * len(qn)]
    column = np.full(m, -1)
    column[wide] = np.arange(len(wide))
    kind = np.float32 if m < 2**24 else np.float64  # counts stay exact
    dense = np.zeros((len(wide), len(qn)), kind)
    at = column[qh] >= 0
    dense[column[qh[at]], qr[at]] = 1
    # The right rows of every other hub, one after another.
    order = np.argsort(qh, kind="stable")
    holders, first = qr[order], np.concatenate(([0], np.cumsum(in_q)))
    order = np.argsort(mr, kind="stable")
    mr, mc, further, mn = mr[order], mc[order], further[order], mn[order]
    counts, moved = np.zeros(m + 1, np.int64), np.zeros(m + 1 + int(further.max(initial=0)), np.int64)
    ones = bool((pn == 1).all() and (qn == 1).all())
    step = max(1, cells // max(len(qn), 1))
    for s in range(0, len(pn), step):
        e = min(s + step, len(pn))
        i, j = np.searchsorted(pr, (s, e))
        r, h = pr[i:j] - s, ph[i:j]
        c = column[h]
        some = np.zeros((e - s, len(wide)), kind)
        some[r[c >= 0], c[c >= 0]] = 1
        shared = some @ dense
        r, h = r[c < 0], h[c < 0]
        ends = np.cumsum(in_q[h])
        cuts = np.searchsorted(ends, np.arange(cells, ends[-1] if len(ends) else 0, cells))
        for rr, hh in zip(np.split(r, cuts), np.split(h, cuts), strict=True):
            k = in_q[hh]
            within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            np.add.at(shared.reshape(-1), np.repeat(rr * len(qn), k) + holders[np.repeat(first[hh], k) + within], kind(1))
        i, j = np.searchsorted(mr, (s, e))
        had = shared[mr[i:j] - s, mc[i:j]].astype(np.int64)
        np.subtract.at(moved, had, mn[i:j])
        np.add.at(moved, had + further[i:j], mn[i:j])
        flat = shared.astype(np.intp).reshape(-1)
        if ones:
            counts += np.bincount(flat, minlength=m + 1)
        else:
            counts += np.bincount(flat, np.outer(pn[s:e].astype(float), qn).reshape(-1), minlength=m + 1).astype(np.int64)
    if same:
        np.subtract.at(counts, np.bincount(pr, minlength=len(pn)), pn)
        counts //= 2
    moved[: m + 1] += counts
    return moved


def hub_neighbours(edges: DataFrame, max_degree: int = 10_000) -> DataFrame:
    return undirected(edges).groupBy("dst").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > max_degree)


def common_counterparties(edges: DataFrame, a, b) -> DataFrame:
    """Neighbours of both of two nodes, with up to two event ids on each side."""
    pair = edges.where("src <> dst").select("src", "dst", "t", "event_id").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t", "event_id"))
    side = lambda x, name: pair.where(F.col("src") == x).groupBy("dst").agg(F.slice(F.array_sort(F.collect_set(F.struct("t", "event_id"))), 1, 2)["event_id"].alias(name))
    return side(a, "events_a").join(side(b, "events_b"), "dst").withColumnRenamed("dst", "id")


def ancestors(links: DataFrame, child: str, parent: str) -> DataFrame:
    """Transitive closure (node, ancestor, depth) of parent links; depth is the least. A cycle shows as a node that is its own ancestor.

    Each round doubles the reach: what lies exactly at it is joined with all that is known, so no pair is built twice on a
    chain, and the number of rounds is the logarithm of the longest one. It ends when a round finds nothing new.
    """
    e = links.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    closed = materialize(e.withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        far = closed.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("mid"))
        on = closed.select(F.col("node").alias("mid"), "ancestor", (F.col("depth") + reach).alias("depth"))
        step = far.join(on, "mid").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        new = materialize(step.join(closed.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return closed
        closed = materialize(closed.unionByName(new))
        reach *= 2


def newest_events(events: DataFrame, n: int, t: str = "t", key: str = "event_id") -> DataFrame:
    """The ``n`` newest events (a bounded window of state); ties by id."""
    return events.orderBy(F.desc(t), F.desc(key)).limit(n)


def roots(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, depth): the end of each node's chain of parents, by pointer jumping.

    Every round doubles the distance jumped, so after as many rounds as the number of nodes has bits only cycles are left. Nodes without
    a parent are their own root at depth 0. A cycle never ends its chain and is left out; several parents follow the
    least.
    """
    one = links.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("up"))
    at = materialize(one.select("node", F.coalesce("up", "node").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("up").isNull().alias("done")))
    for _ in range(at.count().bit_length() + 1):
        nxt = at.select(F.col("node").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("done").alias("f2"))
        # A parent that is no row of its own is a root.
        step = at.where("not done").join(nxt, "root", "left").select("node", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("f2", F.lit(True)).alias("done"))
        at = materialize(at.where("done").unionByName(step))
        if at.where("not done").isEmpty():
            break
    return at.where("done").select("node", "root", "depth")


def relation(label: Column, table: Mapping[str, str]) -> Column:
    """The relation an event type stands for; ASSOCIATED_WITH by default."""
    return mapped(F.upper(label), table, "ASSOCIATED_WITH")


def recorded_edges(edges: DataFrame, nodes: DataFrame, a: str = "src", b: str = "dst", key: str = "id") -> DataFrame:
    """Edges both of whose ends are recorded nodes; the others are dropped."""
    known = nodes.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return edges.join(known.withColumnRenamed(key, a), a, "left_semi").join(known.withColumnRenamed(key, b), b, "left_semi")


def bounded_state(events: DataFrame, most: int, t: str = "t", key: str = "event_id") -> DataFrame:
    """The events kept of a graph of at most ``most`` nodes: all while they are not more, else the newest half of that."""
    n = events.count()
    return events if n <= most else newest_events(events, most // 2, t, key)


def grown(edges: DataFrame, seeds: DataFrame, least: int = 100) -> DataFrame:
    """(id, hop): whole steps around the seeds until at least ``least`` nodes are reached or no more are found; every node's way back to a seed certifies its reach."""
    near = materialize(undirected(edges))
    reached = frontier = materialize(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    hop = 0
    while reached.count() < least:
        hop += 1
        step = near.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(reached.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = materialize(reached.unionByName(frontier))
    return reached


def verified(records: DataFrame, key: str, parent: str, sound: Column) -> DataFrame:
    """(node, status): TAMPERED if its own check fails, MISSING_ANCESTOR or ANCESTOR_TAMPERED if one above is gone or fails, else VERIFIED.

    What fails above is found by pointer jumping: each round every node looks twice as far up, so a chain of any length
    takes as many rounds as its length has bits. A chain that ends in a cycle is MISSING_ANCESTOR.
    """
    base = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("up"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("own"))
    # What lies above and up to the node looked at: gone, bad.
    at = materialize(base.select("node", "own", "up", F.lit(False).alias("gone"), F.lit(False).alias("bad")))
    for _ in range(at.count().bit_length() + 1):
        nxt = at.select(F.col("node").alias("up"), F.col("up").alias("u2"), F.col("own").alias("o2"), F.col("gone").alias("g2"), F.col("bad").alias("b2"), F.lit(True).alias("there"))
        open_ = at.where("up is not null").join(nxt, "up", "left")
        step = open_.select("node", "own", F.col("u2").alias("up"), (F.col("gone") | F.col("there").isNull() | F.coalesce("g2", F.lit(False))).alias("gone"), (F.col("bad") | ~F.coalesce("o2", F.lit(True)) | F.coalesce("b2", F.lit(False))).alias("bad"))
        at = materialize(at.where("up is null").unionByName(step))
        if at.where("up is not null").isEmpty():
            break
    lost = F.col("gone") | F.col("up").isNotNull()
    return at.select("node", F.when(~F.col("own"), "TAMPERED").when(lost, "MISSING_ANCESTOR").when(F.col("bad"), "ANCESTOR_TAMPERED").otherwise("VERIFIED").alias("status"))
