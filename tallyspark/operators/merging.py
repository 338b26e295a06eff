"""Joins that draw the rows of several papers to lots: ranked candidates, families, catalogs, unions by unseen key.

Every join is by equality; prefixes are written out on the longer side. Windows lie within one shipment's key.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lots as L


def once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by `order` of those delivered again. Null keys are left out."""
    kept = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*kept), F.struct(order, F.xxhash64(*[c for c in kept if not rows.schema[c].dataType.simpleString().startswith("map")]))).alias("_r")).select(key, "_r.*")


def ranked_join(rows: DataFrame, candidates: DataFrame, on: list[str], rank: Column, order: list[str], row_id: str) -> DataFrame:
    """Each row with the candidate of its key that has the least rank, ties by `order`; rank null means no candidate.

    Map-side combinable: the best is an aggregate over each row's candidates, no sort.
    """
    both = rows.join(candidates, on).withColumn("rank", rank).where("rank is not null")
    kept = [c for c in both.columns if c != row_id]
    return both.groupBy(row_id).agg(F.min_by(F.struct(*kept), F.struct("rank", *order)).alias("_b")).select(row_id, "_b.*")


def catalog_first(catalog: DataFrame, key: Column, values: list[str], order: list[str], agree: str | None = None) -> DataFrame:
    """(key, values): the first catalog row of each key; with `agree`, only keys whose rows have one value of that column."""
    keyed = catalog.withColumn("_k", key).where("_k is not null")
    out = keyed.groupBy("_k").agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"), *([F.min(agree).alias("_lo"), F.max(agree).alias("_hi")] if agree else []))
    return (out.where(F.col("_lo").eqNullSafe(F.col("_hi"))) if agree else out).select("_k", "_v")


def catalog_lookup(items: DataFrame, steps: list[tuple[str, Column, DataFrame]], values: list[str]) -> DataFrame:
    """Items with `values` of the first step that hits (name, item's key, catalog by key), as cat_*, and `path`, the step's name or none.

    Catalogs are joined by equality step by step; a small one is broadcast by the optimizer's own size estimate.
    """
    out = items
    for i, (_, key, by_key) in enumerate(steps):
        out = out.withColumn("_k", key).join(by_key.withColumnRenamed("_v", f"_v{i}"), "_k", "left").drop("_k")
    hits = [F.col(f"_v{i}") for i in range(len(steps))]
    path = F.coalesce(*(F.when(h.isNotNull(), F.lit(n)) for h, (n, _, _) in zip(hits, steps)), F.lit("none"))
    best = F.coalesce(*hits)
    return out.withColumns({"path": path, **{f"cat_{v}": best[v] for v in values}}).drop(*(f"_v{i}" for i in range(len(steps))))


def prefixes(key: Column, least: int = 3) -> Column:
    """All proper prefixes of a key of `least` characters or more."""
    n = F.length(key)
    return F.when(n > least, F.transform(F.sequence(F.lit(least), n - 1), lambda k: F.substr(key, F.lit(1), k)))


def prefix_parents(children: DataFrame, parents: DataFrame, scope: list[str], child: str, parent: str) -> DataFrame:
    """Children with each parent of their scope whose key begins theirs; an equi-join on the child's written-out prefixes."""
    return children.withColumn(parent, F.explode(prefixes(F.col(child)))).join(parents, [*scope, parent])


def distribute(children: DataFrame, group: list[str], totals: dict[str, list[str]], order: list[str], exact: bool = True) -> DataFrame:
    """Each total of a group over its rows by the first share column with a positive sum, by equal shares if none has one.

    totals: column with the group's total -> share columns in order of preference; results are `<total>_part`, to cents.
    """
    out = children
    for total, shares in totals.items():
        w = Window.partitionBy(*group)
        sums = [F.sum(F.greatest(F.coalesce(F.col(s), F.lit(0.0)), F.lit(0.0))).over(w) for s in shares]
        share = F.coalesce(*(F.when(t > 0, F.greatest(F.coalesce(F.col(s), F.lit(0.0)), F.lit(0.0))) for s, t in zip(shares, sums)), F.lit(1.0))
        out = L.allocate(out.withColumn("_share", share), group, total, "_share", order, f"{total}_part", exact).drop("_share")
    return out


def claim_children(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, row_id, child_id): children that each family row claims, most constrained rows first, each child once.

    rows: group, side (`family` or `child`), id, digit (its key is the family's and digits), metres, rolls. A row takes the
    only child of equal metres, else of equal rolls; else all free children if they sum to it; else, as the family's only row, all free digit
    children. Digit children come before longer words. Sequential within a family of one shipment, hence grouped pandas.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)
    fields = ("metres", "rolls")
    some = [F.sum(F.when(F.col("side") == x, 1).otherwise(0)).alias(x) for x in ("family", "child")]
    met = rows.groupBy(*group).agg(*some, F.collect_list(F.struct("side", "id", "digit", *fields)).alias("rows")).where("family > 0 and child > 0")

    def close(a: float, b: float) -> bool:
        return abs(a - b) <= max(0.05, abs(b) * 0.001)

    def equal(pool, fam):
        for m in fields:
            got = [k for k in pool if m in fam and m in k[2] and close(k[2][m], fam[m])]
            if got:
                return got
        return []

    def total(pool, fam):
        return bool(pool) and any(m in fam and all(m in k[2] for k in pool) and close(sum(k[2][m] for k in pool), fam[m]) for m in fields)

    def split(pool):
        return [k for k in pool if k[1]], [k for k in pool if not k[1]]

    def claim(members) -> list[tuple[int, int]]:
        known = [(r["side"], int(r["id"]), bool(r["digit"]), {m: r[m] for m in fields if r[m] is not None and r[m] > 0}) for r in members]
        kids = sorted((x[1:] for x in known if x[0] == "child"), key=lambda k: k[0])
        fams = [(x[1], x[3]) for x in known if x[0] == "family"]

        def order(fam):
            unique = any(len(equal(p, fam[1])) == 1 for p in split(kids))
            return not unique, fam[1].get("metres", fam[1].get("rolls", 0.0)), fam[0]

        out: list[tuple[int, int]] = []
        for no, fam in sorted(fams, key=order):
            digit, word = split(kids_left := [k for k in kids if k[0] not in {c for _, c in out}])
            got = []
            for pool in (digit, word):
                alone = equal(pool, fam)
                got = alone if len(alone) == 1 else pool if total(pool, fam) else []
                if got:
                    break
            if not got and len(fams) == 1 and kids_left:
                got = digit
            out += [(no, k[0]) for k in got]
        return out

    def run(frames):
        for pdf in frames:
            out = [(*key, *pair) for *key, members in zip(*(pdf[c] for c in group), pdf["rows"]) for pair in claim(members)]
            yield pd.DataFrame(out, columns=[*group, "row_id", "child_id"])

    return met.select(*group, "rows").mapInPandas(run, f"{kinds}, row_id bigint, child_id bigint")


def pick_document(lines: DataFrame, group: list[str], document: str, preferred: Column) -> DataFrame:
    """The document of each group: a preferred one, the first by name, if there is any; else the one with the most lines."""
    docs = lines.groupBy(*group, document).agg(F.max(preferred.cast("int")).alias("_p"), F.count("*").alias("n_lines"))
    return docs.groupBy(*group).agg(F.min_by(F.struct(document, "n_lines"), F.struct(-F.col("_p"), F.when(F.col("_p") == 0, -F.col("n_lines")).otherwise(0), document)).alias("b")).select(*group, f"b.{document}", "b.n_lines")


def union_unseen(primary: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """`primary` and the rows of `extra` whose key isn't in it."""
    return primary.unionByName(extra.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def richest(rows: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one with the most fields wins, its gaps filled by the next richest; ties by `order`."""
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    rank = F.struct((-filled).alias("r"), *order)
    return rows.groupBy(*keys).agg(F.max(filled).alias("filled"), *(F.min_by(F.col(f), F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields))


def paired_lines(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Full join of two tables' rows of equal key in their order: the n-th with the n-th. Columns must differ but for keys."""
    n = lambda df: df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return n(left).join(n(right), [*keys, "ordinal"], "full")


def majority(values: DataFrame, group: list[str], value: str, key: Column) -> DataFrame:
    """The value that makes up half of a group's values or more after normalising by `key`; of two halves the first by key."""
    counts = values.where(F.col(value).isNotNull()).withColumn("_k", key).groupBy(*group, "_k").agg(F.count("*").alias("n"), F.min(value).alias(value))
    best = counts.groupBy(*group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "_k")).alias("b"), F.sum("n").alias("total"))
    return best.where(2 * F.col("b.n") >= F.col("total")).select(*group, f"b.{value}", "b.n")


def filled(df: DataFrame, pairs: dict[str, str], overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Columns filled from others where they are null; those in `overwrite` replaced where the other has a value."""
    return df.withColumns({a: F.coalesce(F.col(b), F.col(a)) if a in overwrite else F.coalesce(F.col(a), F.col(b)) for a, b in pairs.items()})


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
