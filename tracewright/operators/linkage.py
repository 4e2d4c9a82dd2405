"""Blocking, pair scoring and clusters of records of one entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import jaro_winkler
from tracewright.session import materialize

# Probability that a field agrees in a match and in a non-match, and the prior of a match.
AGREE = {"actor_name": (0.88, 0.01), "actor_id": (0.95, 0.001), "device_id": (0.90, 0.005), "ip_subnet": (0.85, 0.02)}
PRIOR = 0.05
#: Names agree from this Jaro-Winkler similarity on.
NAME_AGREES = 0.85


def usable(c: Column) -> Column:
    """The key in capitals, or null where it says nothing (blank, UNKNOWN, everything's subnet)."""
    t = F.upper(F.trim(c.cast("string")))
    return F.when(~t.isin("", "UNKNOWN", "NONE", "NAN", "0.0.0.0/0"), t)


def block_groups(records: DataFrame, rules: Mapping[str, Column], record_id: str) -> DataFrame:
    """(match_key, block, members): the size of every block of every rule; what pairs a block stands for is n (n - 1) / 2."""
    keyed = [records.select(F.lit(rule).alias("match_key"), usable(c).alias("block"), record_id).where("block is not null") for rule, c in rules.items()]
    every = keyed[0]
    for k in keyed[1:]:
        every = every.unionByName(k)
    return every.groupBy("match_key", "block").agg(F.countDistinct(record_id).alias("members"))


def pairs_within(members: DataFrame, block: str, cell: int = 5000) -> DataFrame:
    """All pairs (left_id < right_id, with ``block``) of the distinct rows (id, block) that share a block.

    A block of more than ``cell`` members is cut into cells that meet two by two, so no task pairs more than two cells
    of it and no pair is lost.
    """
    sizes = members.groupBy(block).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    m = members.join(sizes.select(block, F.ceil(F.col("n") / cell).cast("int").alias("cells")), block)
    small = m.where("cells = 1").select(block, "id")
    pairs = small.withColumnRenamed("id", "left_id").join(small.withColumnRenamed("id", "right_id"), block).where("left_id < right_id").select("left_id", "right_id", block)
    m = m.where("cells > 1").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    m = m.select(block, "id", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    other = m.select(block, "p", "q", F.col("id").alias("right_id"), F.col("own").alias("own2"))
    # Pairs of one cell meet only where the cell meets itself.
    met = m.withColumnRenamed("id", "left_id").join(other, [block, "p", "q"]).where("left_id < right_id and (p = q or own <> own2)")
    return pairs.unionByName(met.select("left_id", "right_id", block))


def candidate_pairs(records: DataFrame, rules: Mapping[str, Column], record_id: str) -> DataFrame:
    """Distinct pairs (left_id < right_id) that share a block under some rule, with the first rule that brings them.

    One equality join a rule, over all pairs of every block (see :func:`pairs_within` for large ones).
    """
    every = None
    for k, (rule, c) in enumerate(rules.items()):
        keyed = records.select(F.col(record_id).alias("id"), usable(c).alias("block")).where("block is not null").distinct()
        part = pairs_within(keyed, "block").select("left_id", "right_id").withColumn("rule", F.struct(F.lit(k).alias("k"), F.lit(rule).alias("name")))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("left_id", "right_id").agg(F.min("rule")["name"].alias("match_key"))


def match_weight(pairs: Mapping[str, tuple[Column, Column]], table: Mapping[str, tuple[float, float]] = AGREE, agree: Mapping[str, Column] | None = None) -> Column:
    """Sum of log2 weights over fields that both sides have; other fields count nothing.

    Fields agree if they are equal, ``actor_name`` if it is similar; a name is missing only if it is blank.
    """
    total = F.lit(0.0)
    for name, (a, b) in pairs.items():
        m, u = table[name]
        there = (lambda c: F.nullif(F.trim(c), F.lit(""))) if name == "actor_name" else usable
        same = (agree or {}).get(name, jaro_winkler(a, b) >= NAME_AGREES if name == "actor_name" else usable(a) == usable(b))
        total = total + F.when(there(a).isNull() | there(b).isNull(), 0.0).when(same, F.log2(F.lit(m / u))).otherwise(F.log2(F.lit((1 - m) / (1 - u))))
    return total


def match_probability(weight: Column, prior: float = PRIOR) -> Column:
    odds = F.lit(prior / (1 - prior)) * F.pow(F.lit(2.0), weight)
    return odds / (1 + odds)


def match_status(p: Column, confirmed: float = 0.85, possible: float = 0.60) -> Column:
    return F.when(p >= confirmed, "CONFIRMED").when(p >= possible, "POSSIBLE").otherwise("REJECTED")


def fit_agreement(vectors: DataFrame, fields: Sequence[str], rounds: int = 25, start: float = 0.1) -> tuple[dict[str, tuple[float, float]], float]:
    """Expectation maximisation of (m, u) and the prior from 0/1/null agreement columns.

    The rows are first counted by pattern, of which there are at most 3 to the number of fields; only those counts reach
    the driver, and every round runs on them.
    """
    counts = [(tuple(r[f] for f in fields), r["n"]) for r in vectors.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()]
    m, u, p = dict.fromkeys(fields, 0.9), dict.fromkeys(fields, 0.1), start
    for _ in range(rounds):
        hit = {f: [0.0, 0.0, 0.0, 0.0] for f in fields}
        mass = all_n = 0.0
        for pattern, n in counts:
            a, b = p, 1 - p
            for f, v in zip(fields, pattern, strict=True):
                if v is not None:
                    a *= m[f] if v else 1 - m[f]
                    b *= u[f] if v else 1 - u[f]
            w = a / (a + b) if a + b else 0.0
            mass, all_n = mass + w * n, all_n + n
            for f, v in zip(fields, pattern, strict=True):
                if v is not None:
                    hit[f][0] += w * n * v
                    hit[f][1] += w * n
                    hit[f][2] += (1 - w) * n * v
                    hit[f][3] += (1 - w) * n
        clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
        for f in fields:
            m[f], u[f] = clip(hit[f][0] / hit[f][1]) if hit[f][1] else m[f], clip(hit[f][2] / hit[f][3]) if hit[f][3] else u[f]
        p = clip(mass / all_n) if all_n else p
    return {f: (m[f], u[f]) for f in fields}, p


def clusters(edges: DataFrame, a: str = "left_id", b: str = "right_id") -> DataFrame:
    """(id, component): connected components, named by their least id.

    Large-star and small-star rounds: every node points to the least neighbour it knows of, which halves distances, so
    the number of rounds grows with the logarithm of the longest path; they go on until nothing changes. Each round is written, so its lineage is one scan;
    only the count of changed edges reaches the driver. Null ends and self links make no edge.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialize(e)
    before = None
    while True:
        # Large star: each node's larger neighbours are joined to its least one.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node's smaller neighbours, and itself, are joined to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).groupBy("id").agg(F.min("component").alias("component"))


def pair_quality(pairs: DataFrame, truth: DataFrame, n_records: int) -> DataFrame:
    """Blocking recall and reduction ratio of candidate pairs against true pairs."""
    hit = truth.join(pairs.select("left_id", "right_id", F.lit(1).alias("hit")), ["left_id", "right_id"], "left")
    found = hit.agg(F.count(F.lit(1)).alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
    return found.withColumn("recall", F.try_divide("n_found", "n_true")).withColumn("reduction", F.lit(1 - pairs.count() / max(n_records * (n_records - 1) / 2, 1)))


def b_cubed(clustered: DataFrame, predicted: str, true: str) -> DataFrame:
    """B-cubed precision and recall, from cell counts instead of pairs."""
    cell = clustered.groupBy(predicted, true).agg(F.count(F.lit(1)).alias("n"))
    p = cell.groupBy(predicted).agg(F.sum("n").alias("np"))
    t = cell.groupBy(true).agg(F.sum("n").alias("nt"))
    return cell.join(p, predicted).join(t, true).agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("nt")) / F.sum("n")).alias("recall"))
