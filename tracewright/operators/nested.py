"""Deeply nested records into related flat tables that keep parent-child links."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import materialize

_NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def merge_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: fields are united by name, a bare value and an array make an array, numbers widen, an object and a plain value are text. Of other plain types the first, the declared one, holds; a value that is none of it is null."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.ArrayType) or isinstance(b, T.ArrayType):
        x, y = (t.elementType if isinstance(t, T.ArrayType) else t for t in (a, b))
        return T.ArrayType(merge_types(x, y))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b}
        mine = [T.StructField(f.name, merge_types(f.dataType, other.pop(f.name, f.dataType))) for f in a]
        return T.StructType(mine + [T.StructField(f.name, f.dataType) for f in b if f.name in other])
    if type(a) in _NUMBERS and type(b) in _NUMBERS:
        return max(a, b, key=lambda t: _NUMBERS.index(type(t)))
    if isinstance(a, T.StructType) or isinstance(b, T.StructType):
        return T.StringType()
    return a


def infer_json_schema(df: DataFrame, column: Column) -> T.StructType:
    """The merged schema of all JSON texts of a column, from distributed aggregates over every row; empty if there is none.

    Where one place holds an array in some rows and a bare object in others, it is an array of that object; other
    conflicts become text. Each such place costs one further pass over the values found there.
    """
    # Parsed once: every further pass reads the written values.
    kind = _infer(materialize(df.select(F.try_parse_json(column).alias("v")).where("v is not null")))
    return kind if isinstance(kind, T.StructType) else T.StructType([])


def _infer(values: DataFrame) -> T.DataType:
    kind = F.schema_of_variant("v")
    said = values.agg(
        F.schema_of_variant_agg("v").alias("s"), F.count_if(kind.startswith("ARRAY<")).alias("arrays"), F.count_if(kind.startswith("OBJECT<")).alias("objects"), F.count_if(kind != "VOID").alias("all")
    ).first()
    if not said["all"]:
        return T.NullType()
    text = re.sub(r"\bVOID\b", "STRING", re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", said["s"].replace("OBJECT<", "STRUCT<")))
    found = T.StructType.fromDDL("r " + text)["r"].dataType
    if isinstance(found, T.VariantType):
        if said["arrays"] + said["objects"] < said["all"]:
            return T.StringType()
        inner = _infer(_elements(values.where(kind.startswith("ARRAY<"))).unionAll(values.where(kind.startswith("OBJECT<"))))
        return T.ArrayType(inner) if said["arrays"] else inner
    return _resolve(values, found)


def _elements(values: DataFrame) -> DataFrame:
    return values.selectExpr("explode(cast(v as array<variant>)) as v").where("v is not null and not is_variant_null(v)")


def _resolve(values: DataFrame, kind: T.DataType) -> T.DataType:
    """``kind`` with each conflicting place inside it told apart."""
    if "variant" not in kind.simpleString():
        return kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_infer(_elements(values)))
    if isinstance(kind, T.StructType):
        at = lambda name: values.select(F.try_variant_get("v", f"$['{name}']", "variant").alias("v")).where("v is not null and not is_variant_null(v)")
        return T.StructType([T.StructField(f.name, _infer(at(f.name)) if "variant" in f.dataType.simpleString() else f.dataType) for f in kind])
    return T.StringType()


def value_from_text(text: Column, kind: T.DataType) -> Column:
    """JSON text as a value of ``kind``, leniently: absent keys are null, quoted numbers count, a bare object stands for an array of one, unreadable parts are null."""
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return F.lit(None).cast(kind)
        loose = F.from_json(text, T.StructType([T.StructField(f.name, T.StringType()) for f in kind]))
        whole = F.struct(*[value_from_text(loose.getField(f.name), f.dataType).alias(f.name) for f in kind])
        return F.when(F.ltrim(text).startswith("{"), whole)
    if isinstance(kind, T.ArrayType):
        listed = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
        return F.transform(F.from_json(listed, "array<string>"), lambda x: value_from_text(x, kind.elementType))
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def conform(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """A typed value in the merged type ``want``."""
    if have == want:
        return value
    if isinstance(want, T.ArrayType):
        if isinstance(have, T.ArrayType):
            return F.transform(value, lambda x: conform(x, have.elementType, want.elementType))
        return F.when(value.isNotNull(), F.array(conform(value, have, want.elementType)))
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        mine = {f.name: f.dataType for f in have}
        parts = [(conform(value.getField(f.name), mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.try_cast(want)


def merged_record(df: DataFrame, struct_col: str | None, json_col: str | None) -> tuple[Column, T.StructType]:
    """One typed record from a struct column, a JSON text column or both, under their merged schema; the struct has precedence.

    ``df`` is read to infer the schema: pass the plain scan, and use the column on whatever is derived from it.
    """
    have = df.schema[struct_col].dataType if struct_col else T.StructType([])
    want = merge_types(have, infer_json_schema(df, F.col(json_col))) if json_col else have
    typed = conform(F.col(struct_col), have, want) if struct_col else None
    parsed = value_from_text(F.col(json_col), want) if json_col else None
    return F.coalesce(*[c for c in (typed, parsed) if c is not None]), want


def flatten(df: DataFrame, keys: Sequence[str], record: Column, kind: T.StructType, root: str = "root", carry: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Flat tables of a nested record: ``root`` and one table per array of objects, at any depth, named by its path.

    Each table has ``keys``, its own ``row_key`` (surrogate), and, but for the root, ``parent_key`` and ``ordinal`` (the
    0-based place in the array). Objects inside a record are flattened with ``_`` between names, arrays of plain values
    stay arrays, and ``n_<array>`` counts the objects of each child array. ``carry`` names fields whose value every table
    below takes along, so no join is needed to relate a grandchild to them.

    Nulls: a null record gives one root row with null fields; null, missing and empty arrays give no child row and a
    count of 0; null objects within an array give none, but keep their ordinal. Surrogates are derived from ``keys`` and
    the ordinals, so they are stable between runs; rows with equal keys have equal surrogates. Fields that clash with a
    key or bookkeeping column get a trailing ``_``.
    """
    base = df.select(*[F.col(k) for k in keys], record.alias("__rec"))
    own = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.xxhash64(F.col("__rec")).cast("string")
    tables: dict[str, DataFrame] = {}
    _level(base.withColumn("row_key", own), [*keys], [], kind, root, [*carry], tables)
    return tables


def _leaves(value: Column, kind: T.StructType, prefix: str) -> tuple[list[tuple[str, Column]], list[tuple[str, Column, T.StructType]]]:
    plain, arrays = [], []
    for f in kind:
        at, name = value.getField(f.name), f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            p, a = _leaves(at, f.dataType, name + "_")
            plain, arrays = plain + p, arrays + a
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            arrays.append((name, at, f.dataType.elementType))
        else:
            plain.append((name, at))
    return plain, arrays


def _level(df: DataFrame, held: list[str], links: list[str], kind: T.StructType, path: str, carry: list[str], tables: dict[str, DataFrame]) -> None:
    plain, arrays = _leaves(F.col("__rec"), kind, "")
    taken = {*held, *links, "row_key"}
    fields = [(n if n not in taken else n + "_", c) for n, c in plain]
    counts = [F.size(F.filter(F.coalesce(a, F.array().cast(T.ArrayType(k))), lambda x: x.isNotNull())).alias(f"n_{n}") for n, a, k in arrays]
    tables[path] = df.select(*held, "row_key", *links, *[c.alias(n) for n, c in fields], *counts)
    kept = [(n, c) for n, c in fields if n in carry]
    for name, at, element in arrays:
        child = df.select(*held, *[c.alias(n) for n, c in kept], F.col("row_key").alias("parent_key"), F.posexplode(at).alias("ordinal", "__rec")).where("__rec is not null")
        child = child.withColumn("row_key", F.concat_ws("/", "parent_key", F.concat(F.lit(f"{name}:"), F.col("ordinal").cast("string"))))
        _level(child, held + [n for n, _ in kept], ["parent_key", "ordinal"], element, f"{path}.{name}", carry, tables)
