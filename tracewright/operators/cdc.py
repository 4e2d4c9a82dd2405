"""A change feed of inserts, updates and deletes into the current state of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tracewright.session import materialize

#: Bits of time that one level of the search for the state before an instant covers, so no gathered list is longer than 2 to this power.
BITS = 12


def apply_changes(changes: DataFrame, keys: Sequence[str], fields: Sequence[str], seq: str, op: str = "op") -> DataFrame:
    """The rows present after all changes, column-wise last writer wins. SQL only.

    For each field the value of the latest change that sets it (is not null there) counts, unless a later delete
    (``op`` 'D') or replacement ('R') came after it; a replacement's own values count. ``seq`` is any orderable column.
    Everything is one aggregate with partial results per task, so hot keys need no split and repeated or disordered
    changes make no difference.

    Nulls: changes with a null ``seq`` come before all others; a null ``op`` counts as an update; null keys form keys of
    their own. A key whose latest reset is a delete with nothing after it is absent. An empty feed gives an empty table.
    Two changes of one key on an equal ``seq`` must be ranked by the caller (see :func:`rank_simultaneous`).
    """
    k = ", ".join(f"`{x}`" for x in keys)
    latest = ", ".join(f"max_by(struct(`{f}` AS v, `{seq}` AS s), `{seq}`) FILTER (WHERE `{f}` IS NOT NULL AND coalesce(`{op}`, 'U') <> 'D') AS `__f{i}`" for i, f in enumerate(fields))
    shown = ", ".join(f"CASE WHEN __reset IS NULL OR `__f{i}`.s >= __reset THEN `__f{i}`.v END AS `{f}`" for i, f in enumerate(fields))
    return changes.sparkSession.sql(
        f"""
        SELECT {k}, {shown}
        FROM (
            SELECT {k}, {latest},
                   max(`{seq}`) FILTER (WHERE `{op}` IN ('D', 'R')) AS __reset,
                   max(`{seq}`) FILTER (WHERE `{op}` = 'D') AS __gone,
                   max(`{seq}`) FILTER (WHERE coalesce(`{op}`, 'U') <> 'D') AS __alive,
                   count_if(coalesce(`{op}`, 'U') <> 'D') AS __sets
            FROM {{changes}} GROUP BY {k}
        )
        WHERE __sets > 0 AND (__gone IS NULL OR __alive > __gone)
        """,
        changes=changes,
    )


def rank_simultaneous(changes: DataFrame, keys: Sequence[str], instant: str, before: str, after: str, tie: str) -> DataFrame:
    """``changes`` with ``seq``, a struct that also orders changes of one key on one instant. SQL only.

    Simultaneous changes are chained: starting from the state the key had before the instant, the next is the one whose
    ``before`` is the state reached; failing that, one whose ``before`` no other change leads to; failing that, the one
    of smallest ``tie``. The state before an instant is what all earlier ones lead to from 'NONE' (null counts as it).

    As an instant may itself need the state before it, each is taken as a map from state to state: the few states its
    changes start from, and one end for all others. Maps are composed up a tree over time (per key, ``BITS`` bits a
    level), and the states before are handed down it again. That is exact for any number of such instants in a row, in one
    pass, and no list holds more than 2**``BITS`` maps however hot a key is; a map never has more entries than one
    instant has states.

    ``instant`` counts milliseconds; changes without one come first and lead to no state. Of the changes of an instant only distinct
    (before, after) pairs are gathered, so that list is bounded by the square of the number of states. Null ``before``
    fits nothing; repeated rows share a rank; an empty table gives an empty table.
    """
    spark, k = changes.sparkSession, [f"`{x}`" for x in keys]
    ks, on = ", ".join(k), lambda a, b: " AND ".join(f"{a}.{x} <=> {b}.{x}" for x in k)
    chain = lambda start: f"""aggregate(
        sequence(1, size(pairs)),
        named_struct('s', {start}, 'left', array_sort(pairs), 'done', CAST(array() AS array<struct<b: string, a: string>>)),
        (acc, i) -> element_at(transform(array(coalesce(
                get(filter(acc.left, x -> x.b = acc.s), 0),
                get(filter(acc.left, x -> NOT coalesce(exists(acc.left, y -> y.t <> x.t AND y.a = x.b), false)), 0),
                get(acc.left, 0))),
            p -> named_struct('s', p.a, 'left', filter(acc.left, x -> x.t <> p.t), 'done', concat(acc.done, array(named_struct('b', p.b, 'a', p.a))))), 1)
    ).done"""  # noqa: E731
    lead = lambda m, s: f"coalesce(get(filter({m}.m, y -> y.s = {s}), 0).e, {m}.d)"
    instants = spark.sql(
        f"""
        WITH pairs AS (
            SELECT {ks}, `{instant}` AS t, collect_list(struct(n AS t, b, a)) AS pairs
            FROM (SELECT {ks}, `{instant}`, CAST(`{before}` AS string) AS b, coalesce(CAST(`{after}` AS string), 'NONE') AS a, min(`{tie}`) AS n
                  FROM {{c}} WHERE `{instant}` IS NOT NULL GROUP BY {ks}, `{instant}`, CAST(`{before}` AS string), coalesce(CAST(`{after}` AS string), 'NONE'))
            GROUP BY {ks}, `{instant}`
        )
        SELECT {ks}, t, size(pairs) > 1 AS tied, CASE WHEN size(pairs) > 1 THEN pairs END AS pairs,
               CASE WHEN size(pairs) = 1 THEN named_struct('m', CAST(array() AS array<struct<s: string, e: string>>), 'd', pairs[0].a)
                    ELSE element_at(transform(array(element_at({chain("CAST(NULL AS string)")}, -1).a), d -> named_struct(
                        'm', filter(transform(array_distinct(filter(transform(pairs, p -> p.b), b -> b IS NOT NULL)),
                                              s0 -> named_struct('s', s0, 'e', element_at({chain("s0")}, -1).a)), x -> x.e <> d),
                        'd', d)), 1) END AS map
        FROM pairs""",
        c=changes,
    )
    # Written once: the tree is built over the keys with some tied instant only.
    instants = materialize(instants)
    level = spark.sql(f"SELECT * FROM {{i}} i LEFT SEMI JOIN (SELECT DISTINCT {ks} FROM {{i}} WHERE tied) k ON {on('i', 'k')}", i=instants)
    low, high = level.selectExpr("min(t)", "max(t)").first()
    if low is None:
        return spark.sql(f"SELECT *, struct(`{instant}` AS i, 0 AS r, `{tie}` AS t) AS seq FROM {{c}}", c=changes)
    levels, parents = [level], []
    while (high >> BITS * len(parents)) - (low >> BITS * len(parents)) >= 1 << BITS:
        parents.append(f"shiftright(t, {BITS})")
    for parent in [*parents, "CAST(0 AS bigint)"]:
        level = spark.sql(
            f"""
            SELECT {ks}, t, tied, kids, aggregate(slice(kids, 2, size(kids)), element_at(kids, 1).map, (f, g) -> element_at(transform(array({lead("g.map", "f.d")}), d -> named_struct(
                'm', filter(transform(f.m, x -> named_struct('s', x.s, 'e', {lead("g.map", "x.e")})), x -> x.e <> d), 'd', d)), 1)) AS map
            FROM (SELECT {ks}, {parent} AS t, bool_or(tied) AS tied, array_sort(collect_list(struct(t, map, tied))) AS kids FROM {{level}} GROUP BY {ks}, {parent})""",
            level=level,
        )
        levels.append(level)
    starts = spark.sql(f"SELECT {ks}, t, 'NONE' AS start FROM {{top}} WHERE tied", top=levels[-1])
    for upper in reversed(levels[1:]):
        starts = spark.sql(
            f"""
            SELECT {ks}, kid.t, kid.s AS start FROM (
                SELECT {", ".join(f"u.{x}" for x in k)}, aggregate(kids, named_struct('s', start, 'out', CAST(array() AS array<struct<t: bigint, s: string>>)), (acc, g) -> named_struct(
                    's', {lead("g.map", "acc.s")}, 'out', CASE WHEN g.tied THEN concat(acc.out, array(named_struct('t', g.t, 's', acc.s))) ELSE acc.out END)).out AS found
                FROM {{upper}} u JOIN {{starts}} s ON {on("u", "s")} AND u.t = s.t WHERE u.tied) LATERAL VIEW explode(found) x AS kid""",
            upper=upper,
            starts=starts,
        )
    return spark.sql(
        f"""
        WITH places AS (
            SELECT {ks}, t, pos AS place, item.b AS b, item.a AS a
            FROM (SELECT {", ".join(f"l.{x}" for x in k)}, l.t, {chain("start")} AS done FROM {{level}} l JOIN {{starts}} s ON {on("l", "s")} AND l.t = s.t WHERE l.tied)
            LATERAL VIEW posexplode(done) p AS pos, item
        )
        SELECT c.*, struct(c.`{instant}` AS i, coalesce(p.place, 0) AS r, c.`{tie}` AS t) AS seq
        FROM {{c}} c LEFT JOIN places p
          ON {on("c", "p")} AND c.`{instant}` = p.t AND CAST(c.`{before}` AS string) <=> p.b AND coalesce(CAST(c.`{after}` AS string), 'NONE') = p.a""",
        level=levels[0],
        starts=starts,
        c=changes,
    )
