"""Frequent subsequences across many sequences, mined from sequence decision diagrams.

Every task compresses its sequences into one shared directed acyclic graph with weights (a weighted sequence decision
diagram: a node holds an item, the diagram of what follows it, the diagram of the other beginnings, and how many
sequences take the item). Patterns grow by pushing the conditional diagram of a prefix item; identical subproblems are
met again as the same node and answered from memory. Supports add up over tasks, and patterns grow one step a pass, each
pass over the candidates all of whose parts are frequent, so results are exact however the sequences are spread.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import materialize, ship

#: Added to an item's code if it has the same index as the item before it.
JOINED = 1 << 20
#: Width of index that is gathered at once, and how many reduced pieces are joined at a time.
PIECE, FANOUT = 8192, 64
#: Sequences longer than this are reduced before they are kept.
LONG = 256
#: A task builds a diagram of about so many distinct sequences at a time, which bounds its memory; their supports add up.
BLOCK = 40_000
#: Distinct sequences of one mining task; they lie together in order, as sequences that begin alike share most of a diagram.
TASK_ROWS = 5_000
#: Longer candidates are counted along with shorter ones, from the same diagrams, while there are no more than this.
AHEAD = 20_000


class Diagram:
    """Hash-consed weighted sequence decision diagrams; node 0 is the empty one."""

    def __init__(self) -> None:
        self.item, self.hi, self.lo, self.count = [-1], [0], [0], [0]
        self.unique: dict[tuple[int, int, int, int], int] = {}
        self.sums: dict[tuple[int, int], int] = {}
        self.pushed: dict[tuple[int, int], int] = {}
        self.held: dict[tuple[int, int], int] = {}
        self.stripped: dict[int, int] = {}

    def node(self, item: int, hi: int, lo: int, count: int) -> int:
        key = (item, hi, lo, count)
        n = self.unique.get(key)
        if n is None:
            n = self.unique[key] = len(self.item)
            self.item.append(item)
            self.hi.append(hi)
            self.lo.append(lo)
            self.count.append(count)
        return n

    def build(self, sequences: Iterator[tuple[list[int], int]]) -> int:
        """The diagram of weighted sequences, by way of their prefix tree."""
        tree: list = [0, {}]
        for seq, weight in sequences:
            at = tree
            for x in seq:
                nxt = at[1].get(x)
                if nxt is None:
                    nxt = at[1][x] = [0, {}]
                nxt[0] += weight
                at = nxt
        done: dict[int, int] = {}
        stack = [(tree, False)]
        while stack:
            at, ready = stack.pop()
            if not ready:
                stack.append((at, True))
                stack.extend((c, False) for c in at[1].values())
            else:
                n = 0
                for x in sorted(at[1], reverse=True):
                    c = at[1][x]
                    n = self.node(x, done.pop(id(c)), n, c[0])
                done[id(at)] = n
        return done[id(tree)]

    def add(self, a: int, b: int) -> int:
        """The diagram of the sequences of both."""
        if not a or not b:
            return a or b
        if a > b:
            a, b = b, a
        key = (a, b)
        n = self.sums.get(key)
        if n is None:
            x, y = self.item[a], self.item[b]
            if x == y:
                n = self.node(x, self.add(self.hi[a], self.hi[b]), self.add(self.lo[a], self.lo[b]), self.count[a] + self.count[b])
            elif x < y:
                n = self.node(x, self.hi[a], self.add(self.lo[a], b), self.count[a])
            else:
                n = self.node(y, self.hi[b], self.add(self.lo[b], a), self.count[b])
            self.sums[key] = n
        return n

    def strip(self, n: int) -> int:
        """Without leading items on the index just left."""
        if not n:
            return 0
        m = self.stripped.get(n)
        if m is None:
            if self.item[n] >= JOINED:
                m = self.add(self.strip(self.hi[n]), self.strip(self.lo[n]))
            else:
                m = self.node(self.item[n], self.hi[n], self.strip(self.lo[n]), self.count[n])
            self.stripped[n] = m
        return m

    def push(self, n: int, x: int) -> int:
        """The conditional diagram of ``x``: what follows its first place, in every sequence that has it."""
        if not n:
            return 0
        key = (n, x)
        m = self.pushed.get(key)
        if m is None:
            after = self.strip(self.hi[n]) if self.item[n] % JOINED == x else self.push(self.hi[n], x)
            m = self.pushed[key] = self.add(after, self.push(self.lo[n], x))
        return m

    def holds(self, n: int, x: int) -> int:
        """How many sequences have ``x``."""
        if not n:
            return 0
        key = (n, x)
        m = self.held.get(key)
        if m is None:
            m = self.held[key] = (self.count[n] if self.item[n] % JOINED == x else self.holds(self.hi[n], x)) + self.holds(self.lo[n], x)
        return m


def reduce_sequence(events: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The least of a sorted sequence of (index, item) that still has every pattern of up to ``k`` items it had, and no other.

    An event is left out if no pattern of that length needs it: the shortest pattern whose leftmost place ends there and
    the shortest whose rightmost place begins there together have more than ``k + 1`` items. Going left to right first,
    then right to left over what is kept, each test sees the true lengths, so every single omission is safe. Pieces of a
    sequence may be reduced before they are joined.
    """

    def lengths(seq: list[tuple[int, int]], most) -> list[tuple[int, int, int]]:
        last: dict[int, int] = {}
        seen = [-1] * (k + 1)
        kept, i, group = [], 0, 0
        while i < len(seq):
            j = i
            fresh = []
            while j < len(seq) and seq[j][0] == seq[i][0]:
                x = seq[j][1]
                since = last.get(x)
                n = 1 if since is None else next((v + 1 for v in range(1, k + 1) if seen[v] >= since), k + 1)
                fresh.append((seq[j][0], x, n))
                j += 1
            for index, x, n in fresh:
                if n <= most(index, x):
                    kept.append((index, x, n))
                    last[x] = group
                    if n <= k:
                        seen[n] = group
            group += 1
            i = j
        return kept

    ahead = lengths(events, lambda i, x: k)
    limit = {(i, x): k + 1 - n for i, x, n in ahead}
    behind = lengths([(i, x) for i, x, _ in reversed(ahead)], lambda i, x: limit[i, x])
    return sorted((i, x) for i, x, _ in behind)


def _sorted_events(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out_i, out_c = [], []
        for ix, cs in zip(pdf["ix"], pdf["cs"], strict=True):
            events = sorted(set(zip((int(x) for x in ix), (int(x) for x in cs), strict=True)))
            if len(events) > LONG:
                events = reduce_sequence(events, k)
            out_i.append([e[0] for e in events])
            out_c.append([e[1] for e in events])
        yield pdf.assign(ix=out_i, cs=out_c)


def _gather(events: DataFrame, k: int) -> DataFrame:
    """One row (ix, cs) per entity: its distinct events in order. Events are (e, i, c); long sequences come together from reduced pieces."""
    schema = T.StructType([events.schema["e"], T.StructField("piece", T.LongType()), T.StructField("ix", T.ArrayType(T.LongType())), T.StructField("cs", T.ArrayType(T.IntegerType()))])
    run = lambda batches: _sorted_events(batches, k)
    together = lambda df: df.groupBy("e", "piece").agg(F.collect_list("i").alias("ix"), F.collect_list("c").alias("cs")).mapInPandas(run, schema)
    pieced = events.withColumn("piece", F.floor(F.col("i") / PIECE).cast("bigint"))
    widest = pieced.agg(F.max("piece"), F.min("piece")).first()
    if widest[0] is None or (widest[0] == 0 and widest[1] == 0):
        return together(pieced).select("ix", "cs")
    several = pieced.where("piece <> 0").select("e").distinct()
    short = together(pieced.join(several, "e", "left_anti")).select("ix", "cs")
    held = materialize(together(pieced.join(several, "e", "left_semi")))
    low, high = widest[1], widest[0]
    while high > low:
        low, high = low // FANOUT if low < 0 else 0, high // FANOUT if high >= 0 else -1
        joined = held.withColumn("piece", F.floor(F.col("piece") / FANOUT).cast("bigint")).groupBy("e", "piece").agg(F.flatten(F.collect_list("ix")).alias("ix"), F.flatten(F.collect_list("cs")).alias("cs"))
        held = materialize(joined.mapInPandas(run, schema))
        if low == -1 and high == 0:
            held, low, high = held.withColumn("piece", F.lit(0).cast("bigint")), 0, 0
            held = materialize(held.groupBy("e", "piece").agg(F.flatten(F.collect_list("ix")).alias("ix"), F.flatten(F.collect_list("cs")).alias("cs")).mapInPandas(run, schema))
    return short.unionByName(held.select("ix", "cs"))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many sequences have b somewhere after a: first place of a before last place of b."""
    count: dict[tuple[int, int], int] = defaultdict(int)
    for pdf in batches:
        for ix, cs in zip(pdf["ix"], pdf["cs"], strict=True):
            last = dict(zip(cs, ix, strict=True))
            first = dict(zip(reversed(cs), reversed(ix), strict=True))
            ends = sorted(((i, c) for c, i in last.items()), reverse=True)
            for a, i in first.items():
                for j, b in ends:
                    if j <= i:
                        break
                    count[a, b] += 1
    yield pd.DataFrame([([int(a), int(b)], n) for (a, b), n in count.items()], columns=["pattern", "support"])


def _joined(frequent: set[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Candidates one longer, all of whose parts that leave one item out are frequent."""
    heads: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for p in frequent:
        heads[p[:-1]].append(p[-1])
    out = []
    for p in frequent:
        for x in heads.get(p[1:], ()):
            c = (*p, x)
            if all(c[:i] + c[i + 1 :] in frequent for i in range(1, len(c) - 1)):
                out.append(c)
    return out


def frequent_subsequences(events: DataFrame, entity: Column, item: Column, index: Column, min_share: float = 0.05, lengths: tuple[int, int] = (3, 4)) -> DataFrame:
    """Ordered patterns of ``lengths`` items held by at least ``min_share`` of the distinct entities: (pattern array<string>, support).

    An entity holds a pattern if it has such items at strictly rising index, with any gaps. The share is of all distinct
    non-null entities. Rows without entity, item or index take no part; repeated rows change nothing; of items on one
    index a pattern takes one. Patterns from length 1 on may be asked for. An empty table gives no pattern.

    A hot entity is cut into pieces of its index, each reduced to what patterns of the longest length can need, before
    they are joined. The result is a table; what reaches the driver are the frequent items (each held by ``min_share`` of
    the entities, so at most ``1 / min_share`` times the mean number of distinct items) and the frequent patterns that
    longer ones are grown from.
    """
    spark = events.sparkSession
    ship(spark)
    shortest, longest = lengths
    shape = "pattern array<string>, support bigint"
    rows = events.select(entity.alias("e"), item.alias("x"), index.cast("bigint").alias("i"))
    total = rows.agg(F.countDistinct("e")).first()[0]
    whole = rows.where("e is not null and x is not null and i is not null")
    least = max(1, -(-int(round(total * min_share * 1_000_000)) // 1_000_000))
    found = whole.select("e", "x").distinct().groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()
    names = sorted(r["x"] for r in found)
    code = {x: k for k, x in enumerate(names)}
    result = spark.createDataFrame([([r["x"]], r["n"]) for r in found] if shortest == 1 else [], shape)
    spelled = lambda counts: counts.select(F.transform("pattern", lambda c: F.get(F.array(*[F.lit(x) for x in names]), c)).alias("pattern"), "support")
    if longest > 1 and names:
        coded = whole.join(F.broadcast(spark.createDataFrame([(x, k) for x, k in code.items()], "x string, c int")), "x").select("e", "i", "c")
        sequences = materialize(_gather(coded, longest))
        pairs = _sum(sequences.mapInPandas(_pairs, "pattern array<int>, support bigint"), least)
        if shortest <= 2:
            result = result.unionByName(spelled(pairs))
        if longest > 2:
            frequent = {tuple(r["pattern"]) for r in pairs.collect()}
            wanted, length, trimmed = _joined(frequent), 3, None
            while wanted and length <= longest:
                if trimmed is None:
                    trimmed = _trim(sequences, wanted)
                asked, step = [*wanted], wanted
                while length < longest and (step := _joined(set(step))) and len(asked) + len(step) <= AHEAD:
                    asked, length = asked + step, length + 1
                counts = _sum(trimmed.mapInPandas(_mine(asked), "pattern array<int>, support bigint"), least)
                result = result.unionByName(spelled(counts.where(F.size("pattern") >= shortest)))
                # Only what the next length grows from comes to the driver.
                wanted = _joined({tuple(r["pattern"]) for r in counts.where(F.size("pattern") == length).collect()}) if length < longest else []
                length += 1
    return result


def _sum(counts: DataFrame, least: int) -> DataFrame:
    return materialize(counts.groupBy("pattern").agg(F.sum("support").alias("support")).where(F.col("support") >= least))


def _trim(sequences: DataFrame, wanted: list[tuple[int, ...]]) -> DataFrame:
    """Distinct sequences of the items that candidates have, with how many entities have each; items on one index are marked."""
    useful = {x for c in wanted for x in c}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ix, cs in zip(pdf["ix"], pdf["cs"], strict=True):
                seq, before = [], None
                for i, c in zip(ix, cs, strict=True):
                    if c in useful:
                        seq.append(int(c) + (JOINED if i == before else 0))
                        before = i
                if len(seq) > 2:
                    out.append(seq)
            yield pd.DataFrame({"s": out})

    held = materialize(sequences.mapInPandas(run, "s array<int>").groupBy("s").agg(F.count(F.lit(1)).alias("w")))
    return held.repartitionByRange(max(1, -(-held.count() // TASK_ROWS)), "s")


def _mine(wanted: list[tuple[int, ...]]):
    tree: dict = {}
    for c in wanted:
        at = tree
        for x in c[:-1]:
            at = at.setdefault(x, {})
        at.setdefault(None, []).append(c[-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(1_000_000)
        support: dict[tuple[int, ...], int] = defaultdict(int)

        def mine(held: list[tuple[list[int], int]]) -> None:
            d = Diagram()
            stack = [(d.build(iter(held)), tree, ())]
            while stack:
                n, at, prefix = stack.pop()
                for x in at.get(None, ()):
                    support[*prefix, x] += d.holds(n, x)
                for x, nxt in at.items():
                    if x is not None and (m := d.push(n, x)):
                        stack.append((m, nxt, (*prefix, x)))

        held: list[tuple[list[int], int]] = []
        for pdf in batches:
            held += ((s.tolist() if hasattr(s, "tolist") else list(s), int(w)) for s, w in zip(pdf["s"], pdf["w"], strict=True))
            if len(held) >= BLOCK:
                mine(held)
                held = []
        mine(held)
        yield pd.DataFrame([(list(p), n) for p, n in support.items() if n], columns=["pattern", "support"])

    return run
