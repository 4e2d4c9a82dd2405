"""Scalar functions as column expressions: text, hashes, JSON, time, numbers, arrays. Pandas UDFs only where Spark has no built-in."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- text ----

# Fixed value: characters that have no width or stand for a blank.
INVISIBLE = "[\\u200b\\u200c\\u200d\\ufeff\\u00a0]"


def clean_identifier(c: Column) -> Column:
    """Trimmed, without zero-width characters, byte order marks and hard blanks."""
    return F.trim(F.regexp_replace(F.trim(c), INVISIBLE, ""))


def jaro_winkler_value(a: str | None, b: str | None) -> float:
    """Jaro-Winkler of trimmed lower-case texts; the prefix bonus (0.1 a letter, four at most) applies at any similarity. Blank gives 0."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, common = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                common.append(x)
                break
    if not common:
        return 0.0
    swapped = sum(x != y for x, y in zip(common, (y for y, u in zip(b, used, strict=True) if u), strict=True)) // 2
    m = len(common)
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


#: Texts of more characters are compared one by one.
_LONG = 64


def jaro_winkler_batch(xs: Sequence[str | None], ys: Sequence[str | None]) -> np.ndarray:
    """:func:`jaro_winkler_value` of many pairs at once: every step is taken for all pairs of a batch."""
    a, b = ([(t or "").strip().lower() for t in ts] for ts in (xs, ys))
    out = np.zeros(len(a))
    long = [k for k in range(len(a)) if max(len(a[k]), len(b[k])) > _LONG]
    for k in long:
        out[k] = jaro_winkler_value(a[k], b[k])
    rows = np.array([k for k in range(len(a)) if a[k] and b[k] and max(len(a[k]), len(b[k])) <= _LONG], dtype=int)
    if not len(rows):
        return out
    la, lb = (np.array([len(t[k]) for k in rows]) for t in (a, b))
    wide = int(max(la.max(), lb.max()))
    x, y = (np.array([t[k] for k in rows], dtype=f"U{wide}").view(np.uint32).reshape(len(rows), wide) for t in (a, b))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    far = int(reach.max())
    hit, used = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(int(la.max())):
        for j in range(max(0, i - far), min(int(lb.max()), i + far + 1)):
            same = (x[:, i] == y[:, j]) & (i < la) & (j < lb) & (abs(i - j) <= reach) & ~used[:, j] & ~hit[:, i]
            used[:, j] |= same
            hit[:, i] |= same
    m = hit.sum(1)
    first = lambda t, h: np.take_along_axis(t, np.argsort(~h, axis=1, kind="stable"), 1)
    swapped = ((first(x, hit) != first(y, used)) & (np.arange(wide) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swapped) / m) / 3, 0.0)
    head = min(4, wide)
    prefix = np.cumprod((x[:, :head] == y[:, :head]) & (np.arange(head) < np.minimum(la, lb)[:, None]), axis=1).sum(1)
    out[rows] = np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
    return out


def jaro_winkler(a: Column, b: Column) -> Column:
    """:func:`jaro_winkler_value` of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_batch(x.tolist(), y.tolist()), dtype="float64")

    return run(a, b)


def token_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens: each distinct token becomes one character of a built-in edit distance.

    There are characters for a million distinct tokens of a pair; more raise an error. Null tokens count as one token.
    """
    clean = lambda xs: F.transform(xs, lambda x: F.coalesce(x.cast("string"), F.lit("\u0000")))
    both = F.array_distinct(F.concat(clean(a), clean(b)))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint") + 0xFFFF), 8, "0")), "UTF-32")
    code = F.map_from_entries(F.transform(both, lambda x, i: F.struct(x, char(i + 1))))
    text = lambda xs: F.array_join(F.transform(clean(xs), lambda x: F.try_element_at(code, x)), "")
    return F.when(F.size(both) <= 1_000_000, F.levenshtein(text(a), text(b))).otherwise(F.raise_error(F.lit("more than a million distinct tokens")).cast("int"))


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of each word, the word padded with one blank on both sides."""
    words = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: F.length(w) > 0)
    pad = lambda w: F.concat(F.lit(" "), w, F.lit(" "))

    def of(n: int) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(pad(w)) - (n - 1)), lambda i: F.substring(pad(w), i, F.lit(n)))
        return F.flatten(F.transform(words, lambda w: F.when(F.length(pad(w)) >= n, cut(w)).otherwise(F.array().cast("array<string>"))))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def terms_in(c: Column, terms: Sequence[str]) -> Column:
    """Those of ``terms`` that occur in the text, whatever the case."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(c), F.lower(t)))


def first_intent(c: Column, rules: Sequence[tuple[str, str]], default: str = "UNSUPPORTED") -> Column:
    """The name of the first rule (name, regular expression) that matches."""
    out = None
    for name, pattern in rules:
        hit = F.lower(c).rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.coalesce(out.otherwise(F.lit(default)), F.lit(default))


def mapped(c: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    """A value by lookup in a small fixed table."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


# ---- hashes ----


def pipe_hash(*cs: Column) -> Column:
    """SHA-256 of the values joined by '|'; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]), 256)


def row_hash(values: Mapping[str, Column], source: Column, index: Column, version: str = "1.0") -> Column:
    """SHA-256 of the canonical JSON of a row with where it came from; keys in order, nulls left out."""
    row = F.to_json(F.struct(*[values[k].cast("string").alias(k) for k in sorted(values)]))
    return F.sha2(F.concat(F.lit('{"row":'), row, F.lit(f',"schema_version":"{version}","source_file":"'), source, F.lit('","source_row_index":'), index.cast("string"), F.lit("}")), 256)


def uuid5(name: Column, namespace: str = str(uuid.NAMESPACE_DNS)) -> Column:
    """A version-5 UUID, within the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def short_id(prefix: str, name: Column, namespace: str = str(uuid.NAMESPACE_DNS)) -> Column:
    """``prefix`` and the first 16 hexadecimal digits of the version-5 UUID, in capitals."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.regexp_replace(uuid5(name, namespace), "-", ""), 1, 16)))


# ---- JSON ----


def json_number(c: Column, *paths: str) -> Column:
    """The first of several paths that holds a number, in text that may be no JSON at all."""
    v = F.try_parse_json(c)
    return F.coalesce(*[F.try_variant_get(v, p, "double") for p in paths])


def json_or_raw(c: Column) -> Column:
    """The text if it is a JSON object, else an object that holds it under ``raw``; null and blank give ``{}``."""
    ok = F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit("{}")).when(F.coalesce(ok, F.lit(False)), c).otherwise(F.to_json(F.struct(c.alias("raw"))))


def finite(c: Column) -> Column:
    """Null in place of NaN and the infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


# ---- time ----


def epoch_or_zero(c: Column) -> Column:
    """Seconds since 1970 of ISO text; what cannot be read is 0."""
    return F.coalesce(F.unix_micros(c.try_cast("timestamp")) / 1e6, F.lit(0.0))


def is_night(ts: Column) -> Column:
    """From 22 o'clock on and before 6."""
    return (F.hour(ts) >= 22) | (F.hour(ts) < 6)


def duration_seconds(c: Column) -> Column:
    """Seconds of a literal like 90s, 15m, 24h, 7d; null for anything else."""
    n = F.regexp_extract(F.trim(c), r"^(\d+)\s*([smhd])$", 1)
    unit = F.regexp_extract(F.trim(c), r"^(\d+)\s*([smhd])$", 2)
    return F.when(n != "", n.try_cast("bigint") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400))


def calendar_bounds(phrase: Column, today: Column) -> Column:
    """struct<from, to> (dates, both inclusive) of yesterday, today, this/last week (Monday to Sunday) and this/last month."""
    week, month = F.date_trunc("week", today).cast("date"), F.trunc(today, "month")
    p = F.lower(F.trim(phrase))
    span = lambda a, b: F.struct(a.cast("date").alias("from"), b.cast("date").alias("to"))
    return (
        F.when(p == "today", span(today, today))
        .when(p == "yesterday", span(F.date_sub(today, 1), F.date_sub(today, 1)))
        .when(p == "this week", span(week, F.date_add(week, 6)))
        .when(p == "last week", span(F.date_sub(week, 7), F.date_sub(week, 1)))
        .when(p == "this month", span(month, F.last_day(today)))
        .when(p == "last month", span(F.add_months(month, -1), F.date_sub(month, 1)))
    )


def half_life(age: Column, life: float = 30.0) -> Column:
    """exp(-0.693147 age / life)."""
    return F.exp(F.lit(-0.693147) * age / F.lit(life))


# ---- numbers ----


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def robust_z(v: Column, median: Column, mad: Column, std: Column) -> Column:
    """Distance from the median in 1.4826 MAD; where that is nothing, in standard deviations of at least 1e-4."""
    scale = F.when(mad * 1.4826 > 1e-6, mad * 1.4826).otherwise(F.greatest(std, F.lit(1e-4)))
    return (v - median) / scale


def score_from_z(z: Column) -> Column:
    """2 sigmoid(z / 2) - 1 above 0, else 0.05."""
    return F.when(z <= 0, F.lit(0.05)).otherwise(2 / (1 + F.exp(-z / 2)) - 1)


# ---- arrays ----


def bigrams(xs: Column) -> Column:
    """Pairs of neighbours."""
    return F.when(F.size(xs) > 1, F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: F.concat(F.element_at(xs, i), F.lit(">"), F.element_at(xs, i + 1)))).otherwise(F.array().cast("array<string>"))


def slices(xs: Column, low: int, high: int) -> Column:
    """All contiguous parts of ``low`` to ``high`` elements, as struct<start (0-based), length, items>."""
    def of(n: int) -> Column:
        return F.when(F.size(xs) >= n, F.transform(F.sequence(F.lit(0), F.size(xs) - n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("length"), F.slice(xs, i + 1, n).alias("items"))))

    return F.flatten(F.array_compact(F.array(*[of(n) for n in range(low, high + 1)])))


def has_repeats(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)) != F.size(xs)


# ---- similarity of texts, digests, routing ----


def ngram_cosine(df: DataFrame, a: str, b: str, out: str, low: int = 2, high: int = 4) -> DataFrame:
    """``df`` with ``out``, the cosine of the character n-grams of two texts, weighted by smoothed inverse frequency over the pair (1 for shared ones, 1 + ln 1.5 for others); rounded to four places. Blank gives 0, equal texts 1."""
    x, y = F.coalesce(F.trim(a), F.lit("")), F.coalesce(F.trim(b), F.lit(""))
    # A column for each step, so none is worked out again within the next.
    step = df.withColumns({"__p": F.array_sort(char_ngrams(x, low, high)), "__q": F.array_sort(char_ngrams(y, low, high))})
    count = lambda c: F.map_from_entries(F.transform(F.array_distinct(c), lambda g: F.struct(g, F.size(F.filter(c, lambda v: v == g)).cast("double"))))
    step = step.withColumns({"__pm": count("__p"), "__qm": count("__q")})
    alone = (1 + math.log(1.5)) ** 2
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)
    norm = lambda m, o: total(F.transform(F.map_entries(m), lambda e: e["value"] * e["value"] * F.when(F.map_contains_key(o, e["key"]), 1.0).otherwise(alone)))
    dot = total(F.transform(F.map_entries("__pm"), lambda e: e["value"] * F.coalesce(F.try_element_at("__qm", e["key"]), F.lit(0.0))))
    step = step.withColumns({"__d": dot, "__np": norm("__pm", F.col("__qm")), "__nq": norm("__qm", F.col("__pm"))})
    value = F.coalesce(F.round(clip(F.try_divide(F.col("__d"), F.sqrt(F.col("__np") * F.col("__nq"))), 0, 1), 4), F.lit(0.0))
    return step.withColumn(out, F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(value)).drop("__p", "__q", "__pm", "__qm", "__d", "__np", "__nq")


def routed(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The names of all rules (name, regular expression) that match, in their order."""
    return F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), F.lit(n)) for n, p in rules]))


def payload_digest(fields: Mapping[str, Column], without: Sequence[str] = ("evidence_hash", "status_detail")) -> Column:
    """SHA-256 of the JSON of the named values in order of their names, nulls left out; fields that change afterwards do not count."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields) if k not in without])), 256)
