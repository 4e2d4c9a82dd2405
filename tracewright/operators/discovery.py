"""Discovery of motifs in event sequences: sliding parts, their distances, clusters and representatives."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.session import ship

#: Parts of one entity that are clustered together; a longer history is worked through in stretches of so many events.
STRETCH = 40


def subsequences(events: DataFrame, low: int = 3, high: int = 8, by: str = "actor_id", t: str = "t", label: str = "event_type", domain: str = "source_domain", tie: str = "event_id") -> DataFrame:
    """(by, id, start, length, types, domains, times, gaps, span) of all runs of ``low`` to ``high`` consecutive events.

    Gaps are seconds since the event before (1.0 for an entity's first event), span is last less first in seconds. Runs
    are built from look-ahead over an ordered window, so no history is gathered.
    """
    w = Window.partitionBy(by).orderBy(t, tie)
    item = F.struct(F.col(t).alias("t"), F.col(label).alias("l"), F.col(domain).alias("d"), F.coalesce((F.col(t) - F.lag(t).over(w)) / 1e6, F.lit(1.0)).alias("g"))
    numbered = events.select(by, t, tie, (F.row_number().over(w) - 1).alias("start"), item.alias("x"))
    ahead = numbered.withColumn("xs", F.collect_list("x").over(w.rowsBetween(0, high - 1)))
    runs = ahead.select(by, "start", F.explode(F.sequence(F.lit(low), F.greatest(F.size("xs"), F.lit(low)))).alias("length"), "xs").where(F.size("xs") >= F.col("length"))
    part = F.slice("xs", F.lit(1), F.col("length"))
    return runs.select(
        by, F.concat(F.lit("SUB_"), F.col(by).cast("string"), F.lit("_"), F.col("start").cast("string"), F.lit("_L"), F.col("length").cast("string")).alias("id"), "start", "length",
        part["l"].alias("types"), part["d"].alias("domains"), part["t"].alias("times"), part["g"].alias("gaps"), F.round((F.element_at(part, -1)["t"] - F.element_at(part, 1)["t"]) / 1e6, 4).alias("span"),
    )


def warp(a: np.ndarray, b: np.ndarray) -> float:
    """Warping distance of two series of numbers under absolute differences, over the sum of their lengths; rounded to four places."""
    cost = np.abs(a[:, None] - b[None, :])
    n, m = cost.shape
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(n):
        nxt = np.full(m + 1, np.inf)
        low = np.minimum(row[1:], row[:-1])
        for j in range(m):
            nxt[j + 1] = cost[i, j] + min(low[j], nxt[j])
        row = nxt
    return round(float(row[m]) / (n + m), 4)


def _edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return row[-1]


def part_distance(a: Mapping, b: Mapping) -> float:
    """0.5 edit distance of types, 0.3 of domains, 0.2 of the gaps' warping d / (d + mean span + 10); within 0 and 1."""
    types = round(_edits(a["types"], b["types"]) / max(len(a["types"]), len(b["types"]), 1), 4)
    domains = _edits([x.upper() for x in a["domains"]], [x.upper() for x in b["domains"]]) / max(len(a["domains"]), len(b["domains"]), 1)
    d = warp(np.asarray(a["gaps"], float), np.asarray(b["gaps"], float))
    timing = min(max(d / (d + max(1.0, (a["span"] + b["span"]) / 2) + 10.0), 0.0), 1.0)
    return round(min(max(0.5 * types + 0.3 * domains + 0.2 * timing, 0.0), 1.0), 6)


def cluster_parts(parts: list[Mapping], limit: float = 0.25, least: int = 3) -> list[tuple[list[int], int, float]]:
    """(members, medoid, total distance) of complete-linkage clusters of at least ``least`` parts.

    Distances to a merged cluster are the greater of the two (Lance-Williams), so a merge costs one pass over a row. The
    medoid has the least total distance, ties by start and length.
    """
    n = len(parts)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            d[i, j] = d[j, i] = part_distance(parts[i], parts[j])
    groups = {i: [i] for i in range(n)}
    link = d.copy()
    np.fill_diagonal(link, np.inf)
    while len(groups) > 1:
        i, j = divmod(int(link.argmin()), n)
        if link[i, j] > limit:
            break
        i, j = min(i, j), max(i, j)
        groups[i] += groups.pop(j)
        link[i] = np.maximum(link[i], link[j])
        link[:, i] = link[i]
        link[i, i] = np.inf
        link[j] = link[:, j] = np.inf
    out = []
    for members in groups.values():
        if len(members) >= least:
            total = {k: float(d[k, members].sum()) for k in members}
            medoid = min(members, key=lambda k: (round(total[k], 9), parts[k]["start"], parts[k]["length"]))
            out.append((sorted(members), medoid, round(total[medoid], 4)))
    return sorted(out, key=lambda c: (-len(c[0]), parts[c[1]]["start"], parts[c[1]]["length"]))


def discover(parts: DataFrame, by: str = "actor_id", limit: float = 0.25, least: int = 3) -> DataFrame:
    """(by, stretch, motif, medoid, members, kind, mean_span, median_span, mean_gap, min_gap, max_gap): the motifs of each entity.

    Clustering is cubic, so an entity's history is cut into stretches of ``STRETCH`` events (a part belongs to the one it
    starts in) and each is clustered apart; a hot entity is that many groups. A motif is EXISTING if its representative
    is a burst of three transfers within an hour, two gaps of a minute at most, or three equal types; else DISCOVERED.
    """
    ship(parts.sparkSession)
    kind = parts.schema[by].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["start", "length"]).to_dict("records")
        for r in rows:
            r.update({c: list(r[c]) for c in ("types", "domains", "times", "gaps")})
        out = []
        for no, (members, medoid, _) in enumerate(cluster_parts(rows, limit, least)):
            m, spans = rows[medoid], [rows[k]["span"] for k in members]
            gaps = [max(0.0, (q - p) / 1e6) for k in members for p, q in zip(rows[k]["times"], rows[k]["times"][1:], strict=False)]
            out.append((key[0], int(key[1]), no, m["id"], len(members), catalogue(m), round(float(np.mean(spans)), 2), round(float(np.median(spans)), 2), round(float(np.mean(gaps)), 2), round(min(gaps), 2), round(max(gaps), 2)))
        return pd.DataFrame(out, columns=[by, "stretch", "motif", "medoid", "members", "kind", "mean_span", "median_span", "mean_gap", "min_gap", "max_gap"])

    schema = f"`{by}` {kind}, stretch bigint, motif int, medoid string, members int, kind string, mean_span double, median_span double, mean_gap double, min_gap double, max_gap double"
    return parts.withColumn("stretch", F.floor(F.col("start") / STRETCH)).groupBy(by, "stretch").applyInPandas(run, schema)


def catalogue(part: Mapping) -> str:
    types, times = part["types"], part["times"]
    transfers = [t for x, t in zip(types, times, strict=True) if "TRANSFER" in x.upper() or "PURCHASE" in x.upper()]
    burst = any(c - a <= 3_600_000_000 for a, c in zip(transfers, transfers[2:], strict=False))
    rapid = any(b - a <= 60_000_000 and c - b <= 60_000_000 for a, b, c in zip(times, times[1:], times[2:], strict=False))
    repeated = any(a == b == c for a, b, c in zip(types, types[1:], types[2:], strict=False))
    return "EXISTING" if burst or rapid or repeated else "DISCOVERED"


def encoded(events: DataFrame, types: Mapping[str, float], domains: Mapping[str, float], by: str = "actor_id", t: str = "t", label: str = "event_type", domain: str = "source_domain", amount: str = "amount") -> DataFrame:
    """``events`` with ``code``: type, domain, place between the entity's first and last time, amount over 100,000 (1 at most), duration (0)."""
    ends = events.groupBy(by).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    code = lambda c, m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c), F.lit(0.0))
    at = S.clip((F.col(t) - F.col("__lo")) / F.greatest((F.col("__hi") - F.col("__lo")).cast("double"), F.lit(1e-3)), 0, 1)
    five = F.array(code(F.col(label), types), code(F.col(domain), domains), at, F.least(F.coalesce(F.col(amount), F.lit(0.0)) / 100_000, F.lit(1.0)), F.lit(0.0))
    return events.join(ends, by).withColumn("code", five).drop("__lo", "__hi")


def sequence_health(events: DataFrame, by: str = "actor_id", order: str = "event_id", t: str = "t") -> DataFrame:
    """(by, length, backwards, ties, span_s, valid): whether times never go back in the given order, and how many do or stand still."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(order))
    s = events.withColumn("__s", step).groupBy(by).agg(F.count(F.lit(1)).alias("length"), F.count_if(F.col("__s") < 0).alias("backwards"), F.count_if(F.col("__s") == 0).alias("ties"), ((F.max(t) - F.min(t)) / 1e6).alias("span_s"))
    return s.withColumn("valid", F.col("backwards") == 0)


def warp_column(a: Column, b: Column) -> Column:
    """:func:`warp` of two arrays, in Arrow batches; null if one is empty."""

    @F.pandas_udf("double")
    def run(xs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in xs:
            yield pd.Series([warp(np.asarray(p, float), np.asarray(q, float)) if len(p) and len(q) else None for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def compared(pairs: DataFrame, a: str, b: str, gaps_a: str, gaps_b: str) -> DataFrame:
    """``pairs`` of arrays of types and gaps with ``edit_distance``, ``similarity``, ``timing_distance``, ``common_patterns`` (pairs of neighbours), ``only_a`` and ``only_b``."""
    ship(pairs.sparkSession)
    x, y = F.col(a), F.col(b)
    edits = S.token_levenshtein(x, y)
    out = pairs.withColumn("edit_distance", edits).withColumn("timing_distance", warp_column(F.col(gaps_a), F.col(gaps_b)))
    return out.withColumns({
        "similarity": F.round(1 - F.col("edit_distance") / F.greatest(F.size(x), F.size(y), F.lit(1)), 4),
        "common_patterns": F.array_sort(F.array_intersect(S.bigrams(x), S.bigrams(y))),
        "only_a": F.array_sort(F.array_except(x, y)),
        "only_b": F.array_sort(F.array_except(y, x)),
    })
