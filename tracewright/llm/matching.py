"""Matching entities across sources without keys: cross-table retrieval with calibrated confidence.

Every description becomes a set of tokens over all its attributes. Names, cities and years come in pairs (name part and
year, initial and name part, ...), as each alone is shared by a fixed part of all people. The left table is an inverted
index, the right one the queries; a pair's score is BM25 over the shared tokens.

Retrieval is exact: every pair is found that reaches both ``LEAST`` of what the query would score against itself and
``NEAR`` of the query's best. Short postings are read first; their best score and the two bounds give each query a
threshold, and of its longer postings those are skipped that together cannot reach it. Pairs that still can are
completed from the tokens themselves. Postings longer than ``HOT`` are never joined with queries: candidates that share
such tokens only are ranked once for every distinct set of them. A pair is kept if both sides are nearest to each other,
and its score and gap to the runner-up become a confidence through a logistic model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import materialize

K1, B = 1.2, 0.3
#: A match must reach this part of what the query would score against itself, and this part of the query's best.
LEAST, NEAR = 0.15, 0.5
#: Of an entity's queries those are near to it that reach this part of its own best.
MUTUAL = 0.2
#: Postings of at most so many entries are read first.
SHORT = 64
#: Postings of more entries are ranked once per set of such tokens, and not joined with queries.
HOT = 1000
#: At most so many queries are used to fit the calibration.
SAMPLE = 6000
#: The nearest that are kept of each query.
TOP = 3

# Letters with marks and their plain forms; names and devices that stand for none.
_MARKED = "áàâäãåāçčćéèêëēėíìîïīñńóòôöõøōśšúùûüūýÿžźż"
_BARE = "aaaaaaaccceeeeeeiiiiinnooooooossuuuuuyyzzz"
_NO_NAME = ("unknown subscriber", "unknown", "n/a", "na", "none", "test", "subscriber", "anonymous")
_NO_DEVICE = ("unknown", "none", "na", "null", "000000000000000")
#: How much each kind of token counts, as parts of one attribute overlap.
FIELD = {"ph": 1.0, "pa": 0.4, "pb": 0.4, "pc": 0.4, "dv": 1.0, "sn": 0.6, "sy": 0.5, "ni": 0.7, "ny": 0.5, "nc": 0.4, "4y": 0.3}
#: Attributes that tell a match by themselves; each is held out in turn to label the calibration.
NUMBERS = {"phone": ("ph", "pa", "pb", "pc"), "device": ("dv",)}


def _name(c: Column) -> Column:
    low = F.translate(F.lower(F.regexp_replace(c, "[\\u200b\\u200c\\u200d\\ufeff\\u0301\\u0300\\u0308]", "")), _MARKED, _BARE)
    clean = F.trim(F.regexp_replace(low, "[^a-z]+", " "))
    return F.when((clean != "") & ~clean.isin(*_NO_NAME), clean)


def tokens(df: DataFrame, key: str, name: str, phone: str, device: str, subnet: str, city: str, year: str) -> DataFrame:
    """(id, toks, name, year): the distinct tokens of each description. Rows of one id are united; null ids are left out."""
    digits = F.regexp_replace(F.col(phone), "[^0-9]", "")
    base = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"),
        _name(F.col(name)).alias("name"),
        # One digit over and over is a placeholder.
        F.when((F.length(digits) >= 7) & ~digits.rlike(r"^(\d)\1*$"), F.substring(F.lpad(F.right(digits, F.lit(10)), 10, "_"), 1, 10)).alias("ph"),
        F.lower(F.right(F.regexp_replace(F.col(device), "[^0-9A-Za-z]", ""), F.lit(8))).alias("dv"),
        F.nullif(F.trim(F.col(subnet)), F.lit("")).alias("sn"),
        F.nullif(F.lower(F.trim(F.col(city))), F.lit("")).alias("ct"),
        F.col(year).cast("string").alias("yr"),
    )
    base = base.withColumn("dv", F.when((F.col("dv") != "") & ~F.col("dv").isin(*_NO_DEVICE), F.col("dv"))).withColumn("parts", F.coalesce(F.split("name", " "), F.array().cast("array<string>")))
    long = F.filter("parts", lambda p: F.length(p) > 1)
    ends = F.flatten(F.transform(F.filter(long, lambda p: F.length(p) > 5), lambda p: F.array(F.substring(p, 1, 4), F.concat(F.lit("~"), F.right(p, F.lit(4))))))
    tag = lambda kind, *cs: F.concat(F.lit(kind + ":"), *[x for c in cs for x in (c, F.lit("|"))])
    c = F.col
    single = F.array(
        tag("ph", c("ph")), tag("pa", F.substring("ph", 1, 5)), tag("pb", F.substring("ph", 6, 5)), tag("pc", F.substring("ph", 1, 3), F.substring("ph", 8, 3)),
        tag("dv", c("dv")), tag("sn", c("sn")), tag("sy", c("sn"), c("yr")),
    )
    of_names = F.flatten(F.array(
        F.transform(long, lambda p: tag("ny", p, c("yr"))),
        F.transform(long, lambda p: tag("nc", p, c("ct"))),
        F.transform(ends, lambda p: tag("4y", p, c("yr"))),
        F.flatten(F.transform(long, lambda p: F.transform(F.filter("parts", lambda q: q != p), lambda q: tag("ni", F.substring(q, 1, 1), p)))),
    ))
    every = F.filter(F.concat(single, of_names), lambda t: t.isNotNull())
    return base.select("id", every.alias("t"), "name", "yr").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("t"))).alias("toks"), F.min("name").alias("name"), F.min("yr").alias("year"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _sampled(key: str, share: float) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)


def retrieve(lhs: DataFrame, rhs: DataFrame, share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(l, r, score, place, self, lnorm, rnorm), and the weights (tok, w) behind it: for every query the at most ``TOP`` nearest entries, ties to the smaller id.

    ``lhs`` and ``rhs`` are tables of :func:`tokens`. A pair must reach ``LEAST`` of the query's score against itself and
    ``NEAR`` of its best; for a ``share`` of the queries, chosen by hash, the latter does not count.
    """
    spark = lhs.sparkSession
    kl, kr = lhs.schema["id"].dataType.simpleString(), rhs.schema["id"].dataType.simpleString()
    sizes = [t.agg(F.count(F.lit(1)), F.avg(F.size("toks"))).first() for t in (lhs, rhs)]
    if not all(s[0] for s in sizes):
        return spark.createDataFrame([], f"l {kl}, r {kr}, score double, place int, self double, lnorm double, rnorm double"), spark.createDataFrame([], "tok string, w double")
    n = float(sizes[0][0] + sizes[1][0])
    norm = lambda width: (K1 + 1) / (F.lit(1.0) + K1 * (1 - B + B * F.size("toks") / F.lit(float(width or 1.0))))
    left = lhs.select(F.col("id").alias("l"), norm(sizes[0][1]).alias("lnorm"), F.explode("toks").alias("tok"))
    right = rhs.select(F.col("id").alias("r"), norm(sizes[1][1]).alias("rnorm"), F.explode("toks").alias("tok"))

    seen = left.select("tok", F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select("tok", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy("tok").agg(F.sum("a").alias("dl"), F.sum("b").alias("dr"))
    df = F.col("dl") + F.col("dr")
    factor = F.create_map(*[F.lit(x) for kv in FIELD.items() for x in kv])
    weight = F.log1p((F.lit(n) - df + 0.5) / (df + 0.5)) * factor[F.substring("tok", 1, 2)]
    seen = materialize(seen.where("dr > 0").select("tok", "dl", weight.alias("w"), F.xxhash64("tok").alias("no")))
    # Tokens that only queries have add to what a query scores against itself, and to nothing else.
    queries = right.join(seen, "tok").groupBy("r", "rnorm").agg(F.sum("w").alias("self"), F.array_sort(F.collect_list(F.when(F.col("dl") > 0, F.struct("w", "no", "dl")))).alias("q"))
    queries = materialize(queries.withColumn("need", F.col("self") * LEAST))
    posts = materialize(left.join(seen.where("dl > 0"), "tok").select("no", "dl", "l", "lnorm"))
    most = posts.agg(F.max("lnorm")).first()[0] or 0.0

    def looked(of: DataFrame, asked: Column, postings: DataFrame) -> DataFrame:
        return of.select("r", F.explode(asked).alias("x")).select("r", "x.no", "x.w").join(postings.select("no", "l", "lnorm"), "no").groupBy("r", "l", "lnorm").agg(F.sum("w").alias("s"))

    low = min(SHORT, HOT)
    short = materialize(looked(queries, F.filter("q", lambda x: x["dl"] <= low), posts.where(F.col("dl") <= low)))
    first = short.groupBy("r").agg(F.max(F.col("s") * F.col("lnorm")).alias("best"))
    near = F.when(_sampled("r", share), F.lit(0.0)).otherwise(F.lit(NEAR))
    # What a pair must reach, as far as is known.
    q = queries.join(first, "r", "left").withColumn("theta", F.greatest("need", F.coalesce(F.col("best") * near, F.lit(0.0))))
    ws = lambda xs: F.transform(xs, lambda x: x["w"])
    q = q.withColumn("hot", F.filter("q", lambda x: x["dl"] > HOT)).withColumn("usual", F.filter("q", lambda x: (x["dl"] > low) & (x["dl"] <= HOT))).withColumn("hot_w", _sum(ws("hot")))
    q = q.withColumn("by_hot", (F.size("hot") > 0) & (F.col("hot_w") * most >= F.col("theta")))
    # The least weights first: those that together stay below the threshold need no look-up.
    state = lambda total, k, on: F.struct(total.alias("sum"), k.alias("n"), on.alias("on"))
    skip = F.aggregate(
        ws("usual"), state(F.col("hot_w"), F.lit(0), F.lit(True)),
        lambda a, w: F.when(a["on"] & ((a["sum"] + w) * most < F.col("theta")), state(a["sum"] + w, a["n"] + 1, F.lit(True))).otherwise(state(a["sum"], a["n"], F.lit(False))),
    )["n"]
    q = q.withColumn("skip", F.when(F.col("by_hot"), F.lit(0)).otherwise(skip))
    q = q.withColumn("rest", F.concat("hot", F.slice("usual", F.lit(1), F.col("skip")))).withColumn("asked", F.slice("usual", F.col("skip") + 1, F.size("usual")))
    q = materialize(q.select("r", "rnorm", "self", "theta", "asked", "rest", _sum(ws("rest")).alias("open"), F.when(F.col("by_hot"), F.array_sort(F.transform("hot", lambda x: x["no"]))).alias("sig")))
    parts = short.unionByName(looked(q, F.col("asked"), posts.where((F.col("dl") > low) & (F.col("dl") <= HOT))))
    # Candidates by hot tokens alone: the nearest of every distinct set of them.
    sets = q.where("sig is not null").select("sig").distinct().select("sig", F.explode("sig").alias("no"))
    ranked = sets.join(seen.where(F.col("dl") > HOT).select("no", "w"), "no").join(posts.where(F.col("dl") > HOT).select("no", "l", "lnorm"), "no").groupBy("sig", "l", "lnorm").agg(F.sum("w").alias("s"))
    tops = ranked.withColumn("k", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc(F.col("s") * F.col("lnorm")), "l"))).where(F.col("k") <= TOP)
    parts = parts.unionByName(q.where("sig is not null").select("r", "sig").join(tops, "sig").select("r", "l", "lnorm", F.lit(0.0).alias("s")))
    # By query from here on. A pair that cannot pass the query's last place as known so far needs no completion.
    sums = parts.repartition("r").groupBy("r", "l", "lnorm").agg(F.sum("s").alias("s"))
    sums = sums.withColumn("sure", F.col("s") * F.col("lnorm")).withColumn("last", F.nth_value("sure", TOP).over(Window.partitionBy("r").orderBy(F.desc("sure")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sums = sums.withColumn("top", F.max("sure").over(Window.partitionBy("r"))).join(q.select("r", "rnorm", "self", "theta", "open", "rest"), "r")
    sums = sums.withColumn("theta", F.greatest("theta", F.col("top") * near))
    able = materialize(sums.where((F.col("s") + F.col("open")) * F.col("lnorm") >= F.greatest("theta", F.coalesce("last", F.lit(0.0)))).drop("sure", "last", "top", "open"))
    # Completed from the tokens of both sides.
    held = posts.groupBy("l").agg(F.collect_list("no").alias("nos"))
    more = _sum(ws(F.filter("rest", lambda x: F.array_contains("nos", x["no"]))))
    shown = lambda s: ["r", "l", "lnorm", "rnorm", "self", "theta", (s * F.col("lnorm")).alias("score")]
    scored = able.where(F.size("rest") == 0).select(*shown(F.col("s"))).unionByName(able.where(F.size("rest") > 0).join(held, "l").select(*shown(F.col("s") + more)))
    scored = scored.where("score > 0 and score >= theta").withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "l"))).where(F.col("place") <= TOP)
    scored = scored.withColumn("top", F.max("score").over(Window.partitionBy("r"))).where(F.col("score") >= F.col("top") * F.when(_sampled("r", share), F.lit(0.0)).otherwise(F.lit(NEAR)))
    return materialize(scored.select("l", "r", "score", "place", "self", "lnorm", "rnorm")), seen.select("tok", "w")


FEATURES = ["sim", "gap", "mutual", "all_names", "some_names", "no_name", "same_year", "other_year", "same_numbers", "other_numbers", "number_names", "number_other_name", "number_year", "number_other_year"]


def _gap(score: Column, next_: Column) -> Column:
    # A runner-up below NEAR of the score is not looked for, so the gap ends there.
    return F.greatest(F.least((1 - F.try_divide(F.coalesce(next_, F.lit(0.0)), score)) / (1 - NEAR), F.lit(1.0)), F.lit(0.0))


def compared(lhs: DataFrame, rhs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with how they compare (``FEATURES``) and the tokens shared.

    ``mutual`` is the query's part of the best any query has with the entry, all measured from the entry's side.
    """
    back = F.col("score") / F.col("lnorm") * F.col("rnorm")
    best = pairs.groupBy("l").agg(F.max(back).alias("back"))
    x = pairs.withColumn("next", F.lead("score").over(Window.partitionBy("r").orderBy("place"))).join(best, "l").withColumn("mutual", back / F.col("back"))
    x = x.join(lhs.select(F.col("id").alias("l"), F.col("toks").alias("lt"), F.split("name", " ").alias("ln"), F.col("year").alias("ly")), "l")
    x = x.join(rhs.select(F.col("id").alias("r"), F.col("toks").alias("rt"), F.split("name", " ").alias("rn"), F.col("year").alias("ry")), "r").withColumn("shared", F.array_intersect("lt", "rt"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    # Parts fit if one is the other's initial, or they are a slip or two apart.
    slip = lambda p, q: F.levenshtein(p, q) <= F.when(F.least(F.length(p), F.length(q)) > 5, 2).otherwise(1)
    fits = lambda p, q: F.when((F.length(p) == 1) | (F.length(q) == 1), F.substring(p, 1, 1) == F.substring(q, 1, 1)).otherwise(slip(p, q))
    x = x.withColumn("fit", F.size(F.filter("rn", lambda p: F.exists("ln", lambda q: fits(p, q)))) / F.greatest(F.size("rn"), F.lit(1)))
    x = x.withColumn("fit", F.when(F.col("ln").isNotNull() & F.col("rn").isNotNull(), F.col("fit")))
    has = lambda c, ks: F.exists(c, lambda t: F.substring(t, 1, 2).isin(*ks))
    for a, ks in NUMBERS.items():
        x = x.withColumn(f"same_{a}", has("shared", ks).cast("double")).withColumn(f"other_{a}", (has("lt", ks) & has("rt", ks) & ~has("shared", ks)).cast("double"))
    agreed = [c for a in NUMBERS for c in (f"same_{a}", f"other_{a}")]
    x = x.withColumn("same", F.col("ly") == F.col("ry"))
    return x.select(
        "l", "r", *agreed, *[sum((F.col(f"{k}_{a}") for a in NUMBERS), F.lit(0.0)).alias(f"{k}_numbers") for k in ("same", "other")], "score", "place", "next", "self", "lnorm", "shared", "rt", F.try_divide("score", "self").alias("sim"), _gap(F.col("score"), F.col("next")).alias("gap"), "mutual",
        yes(F.col("fit") == 1).alias("all_names"), yes((F.col("fit") > 0) & (F.col("fit") < 1)).alias("some_names"), yes(F.col("fit") == 0).alias("no_name"), yes(F.col("same")).alias("same_year"), yes(~F.col("same")).alias("other_year"),
    )


def _crossed(pairs: DataFrame) -> DataFrame:
    number = F.least("same_numbers", F.lit(1.0))
    return pairs.withColumns({"number_names": number * F.col("all_names"), "number_other_name": number * (F.col("some_names") + F.col("no_name")), "number_year": number * F.col("same_year"), "number_other_year": number * F.col("other_year")})


def examples(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Labelled rows (r, label, ``FEATURES``) of compared pairs, without any labels given.

    Each of ``NUMBERS`` is held out in turn: scores, order and gaps are taken without its tokens, so no rule over a number
    is learned from itself. If the query's nearest entry by what is left agrees in the number held out, it is a match, and
    the runner-up, if it does not, is what the nearest looks like where the true entry is missing. If it differs in that
    number and agrees in no other, it is none; if it agrees in another one, nothing is known and it is left out.
    """
    kind = F.substring("tok", 1, 2)
    sums = [F.sum(F.when(kind.isin(*ks), F.col("w")).otherwise(0.0)).alias(a) for a, ks in NUMBERS.items()]
    own = pairs.where("place = 1").select("r", F.explode("rt").alias("tok")).join(weights, "tok").groupBy("r").agg(*[s.alias(f"own_{a}") for s, a in zip(sums, NUMBERS, strict=True)])
    shared = pairs.select("l", "r", F.explode("shared").alias("tok")).join(weights, "tok").groupBy("l", "r").agg(*sums)
    x = pairs.drop("shared", "rt", "next", "sim", "gap", "place").join(shared, ["l", "r"], "left").join(own, "r")
    out = None
    w = Window.partitionBy("r").orderBy(F.desc("score"), "l")
    for a in NUMBERS:
        y = x.withColumns({f"{k}_numbers": F.col(f"{k}_numbers") - F.col(f"{k}_{a}") for k in ("same", "other")})
        y = y.withColumn("score", F.col("score") - F.coalesce(F.col(a), F.lit(0.0)) * F.col("lnorm")).withColumn("sim", F.try_divide("score", F.col("self") - F.col(f"own_{a}")))
        y = y.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("first", F.first(f"same_{a}").over(w))
        y = y.where(f"sim >= {LEAST} and (place = 1 and (same_{a} > 0 or other_{a} > 0 and same_numbers = 0) or place = 2 and first > 0 and same_{a} = 0)")
        y = _crossed(y.withColumn("gap", _gap(F.col("score"), F.col("next")))).select("r", F.col(f"same_{a}").alias("label"), *FEATURES)
        out = y if out is None else out.unionByName(y)
    return out


def calibrate(told: DataFrame, rows: int) -> tuple[np.ndarray, dict[str, float]]:
    """The logistic weights (constant first) fitted on at most ``rows`` labelled rows, and their Brier score and calibration error on the half of the queries that a fit on the other half has not seen."""
    x = told.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "r"), F.lit(2))).limit(rows).toPandas()
    f, y, half = x[FEATURES].to_numpy(float), x["label"].to_numpy(float), x["half"].to_numpy() == 1
    report = {"rows": float(len(x)), "brier": float("nan"), "ece": float("nan")}
    if half.any() and not half.all():
        p = _predict(_logistic(f[~half], y[~half]), f[half])
        report["brier"] = float(np.mean((p - y[half]) ** 2))
        bins = np.minimum((p * 10).astype(int), 9)
        report["ece"] = float(sum(abs(p[bins == b].sum() - y[half][bins == b].sum()) for b in range(10)) / half.sum())
    return _logistic(f, y), report


def match(left: DataFrame, right: DataFrame, left_columns: dict[str, str], right_columns: dict[str, str], sample: int = SAMPLE, least: float = 0.5, detail: bool = False) -> DataFrame:
    """Pairs (l, r, score, confidence), with ``detail`` also what the calibration saw: for each right description the left one it is the same as, if any.

    ``*_columns`` name the columns for key, name, phone, device, subnet, city and year. A left entity may have several
    right ones, so a pair is mutual if the entry is the query's nearest and the query reaches ``MUTUAL`` of the entry's
    own nearest. ``confidence`` is the calibrated probability; pairs below ``least`` are not returned. The calibration
    is fitted on the :func:`examples` of about ``sample`` right descriptions, chosen by hash.

    Retrieval is exact (see :func:`retrieve`). Ties go to the smaller left id. Missing attributes neither help nor hurt;
    descriptions without any token, empty tables and null ids match nothing.
    """
    lhs, rhs = materialize(tokens(left, **left_columns)), materialize(tokens(right, **right_columns))
    share = min(1.0, sample / max(rhs.count(), 1))
    pairs, weights = retrieve(lhs, rhs, share)
    ranked = materialize(compared(lhs, rhs, pairs))
    model, _ = calibrate(examples(ranked.where(_sampled("r", share)), weights), 4 * sample)
    line = F.lit(float(model[0]))
    for f, v in zip(FEATURES, model[1:], strict=True):
        line = line + F.col(f) * float(v)
    final = _crossed(ranked).where((F.col("place") == 1) & (F.col("mutual") >= MUTUAL)).withColumn("confidence", 1 / (1 + F.exp(-line)))
    return final.where(F.col("confidence") >= least).select("l", "r", "score", "confidence", *(FEATURES if detail else []))


def _predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ w, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression by Newton's method; of one class only, a constant that says so."""
    if len(y) == 0 or y.min() == y.max():
        w = np.zeros(x.shape[1] + 1)
        w[0] = 2.0 if len(y) == 0 or y.max() == 1 else -2.0
        return w
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        d = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return w
