"""Problem 2: what differs between two copies, field by field, on top of set reconciliation."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import NUMBER
from ..functions.units import number as plain_number
from ..sources.tables import cut
from .set_reconcile import differing_keys

#: Numbers differ if they are further apart than this; the second part absorbs binary rounding of decimal figures.
TOLERANCE = 0.01 + 1e-6
_LEADING = re.compile(rf"\s*[-−+]?{NUMBER}")


def _canonical(name: str, kind: T.DataType) -> Column:
    """A column as it is compared: null, empty text and empty array are one, arrays have no order."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            parts = [f.name for f in kind.elementType.fields]
            c = F.transform(c, lambda x: F.struct(*(F.coalesce(x[p].cast("string"), F.lit("")).alias(p) for p in parts)))
        return F.when(F.size(c) > 0, F.array_sort(c))
    if isinstance(kind, T.NumericType):
        return c.cast("double") + F.lit(0.0)
    return c


def _differs(a: Column, b: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return F.when(a.isNull() | b.isNull(), ~(a.isNull() & b.isNull())).when(F.isnan(a) | F.isnan(b), ~(F.isnan(a) & F.isnan(b))).otherwise(F.abs(a - b) > TOLERANCE)
    return ~a.eqNullSafe(b)


def diff_copies(left: DataFrame, right: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(record_key, field_name, diff_kind) of two copies of one table with a common key column.

    missing_left / missing_right with field `*` for a row that lacks on a side, `differs` for each column that differs.
    Columns named in `ignore`, and columns of one side only, aren't compared; other extra columns don't matter. Rows
    with a null key are left out; rows that come twice count once. Empty tables make every row of the other side missing.
    The rows are hashed and reconciled by their characteristic polynomials; only differing ones are fetched.
    """
    kinds = {f.name: f.dataType for f in left.schema.fields}
    columns = [c for c in left.columns if c != key and c not in ignore and c in right.columns]

    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *(_canonical(c, kinds[c]).alias(f"c{i}") for i, c in enumerate(columns)))

    a, b = ready(left), ready(right)
    keys = differing_keys(a, b, sizes=(left.count(), right.count()))
    fetched = [x.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", F.struct(*(F.col(f"c{i}") for i in range(len(columns)))).alias(side)) for x, side in ((a, "l"), (b, "r"))]
    both = fetched[0].join(fetched[1], "key", "full")
    fields = F.filter(F.array(*(F.when(_differs(F.col(f"l.c{i}"), F.col(f"r.c{i}"), kinds[c]), F.lit(c)) for i, c in enumerate(columns))), lambda x: x.isNotNull())
    what = (
        F.when(F.col("l").isNull(), F.array(F.struct(F.lit("*").alias("field_name"), F.lit("missing_left").alias("diff_kind"))))
        .when(F.col("r").isNull(), F.array(F.struct(F.lit("*").alias("field_name"), F.lit("missing_right").alias("diff_kind"))))
        .otherwise(F.transform(fields, lambda x: F.struct(x.alias("field_name"), F.lit("differs").alias("diff_kind"))))
    )
    return both.select(F.col("key").cast("string").alias("record_key"), F.explode(what).alias("w")).select("record_key", "w.*")


def diff_maps(rows: DataFrame, key: str, left_map: str, right_map: str, version: str) -> DataFrame:
    """(record_key, field_name, diff_kind) of two maps of totals in each record's row of the highest version.

    The left map holds numbers, the right one figures as text in any usual format, a unit or currency behind allowed; a
    text without a number differs from any number. A null map against one that is there gives one row with field `*`; two
    null maps give none. Each map entry is one row of the two copies that are reconciled.
    """
    latest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(left_map).alias("l"), F.col(right_map).alias("r")), version).alias("m"))
    both = latest.where("m.l is not null and m.r is not null")

    def entries(side: str, value) -> DataFrame:
        long = both.select(F.col(key).alias("record_key"), F.explode(F.map_entries(f"m.{side}")).alias("e"))
        return long.where("e.key is not null").select(F.struct("record_key", F.col("e.key").alias("field_name")).alias("key"), *value(F.col("e.value")))

    number = lambda v: [(v.cast("double") + F.lit(0.0)).alias("num"), F.lit(None).cast("string").alias("txt")]

    @F.pandas_udf("double")
    def figure(texts: pd.Series) -> pd.Series:
        found = (_LEADING.match(t) if t else None for t in texts)
        return pd.Series([plain_number(m[0]) if m else None for m in found], dtype="float64")

    def text(v: Column) -> list[Column]:
        n = figure(v)
        return [n.alias("num"), F.when(n.isNull() & (F.trim(v) != ""), F.trim(v)).alias("txt")]

    a, b = entries("l", number), entries("r", text)
    a, b = (x.where("num is not null or txt is not null") for x in (a, b))
    flat = [cut(x.select(F.to_json("key").alias("key"), "num", "txt")) for x in (a, b)]
    keys = differing_keys(*flat)
    fetched = [x.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", F.struct("num", "txt").alias(side)) for x, side in zip(flat, ("l", "r"))]
    named = T.StructType([T.StructField("record_key", T.StringType()), T.StructField("field_name", T.StringType())])
    joined = fetched[0].join(fetched[1], "key", "full").withColumn("key", F.from_json("key", named))
    kind = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(_differs(F.col("l.num"), F.col("r.num"), T.DoubleType()) | ~F.col("l.txt").eqNullSafe(F.col("r.txt")), "differs")
    fine = joined.select("key.record_key", "key.field_name", kind.alias("diff_kind")).where("diff_kind is not null")
    whole = latest.where(F.col("m.l").isNull() != F.col("m.r").isNull()).select(F.col(key).cast("string").alias("record_key"), F.lit("*").alias("field_name"), F.when(F.col("m.l").isNull(), "missing_left").otherwise("missing_right").alias("diff_kind"))
    return fine.unionByName(whole)


def all_differences(scopes: dict[str, DataFrame]) -> DataFrame:
    """(scope, record_key, field_name, diff_kind) of several reconciliations."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(s).alias("scope"), "record_key", "field_name", "diff_kind") for s, df in scopes.items()))
