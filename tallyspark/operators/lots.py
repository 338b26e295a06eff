"""Lots of goods: assembling them from several sources, joins by key prefix, allocation, votes, totals."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(value: str, order: Column) -> Column:
    """The first non-null value of a group in the given order: map-side combinable, no sort."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order)).alias(value)


def assemble_lots(rows: DataFrame, keys: list[str], token: str, fields: list[str], order: list[str], only: bool = False) -> DataFrame:
    """One row for each (keys, token) with the first non-null value of each field in source order, and lot_no within the keys.

    Rows with an empty token go to the first lot of their keys (with `only`, to the only lot), or make one if there is
    none; first_row is the least first column of `order`. `order` must be a total
    order for a repeatable result. Null keys form no lot; an empty table gives an empty result.
    """
    rank = F.struct(*order)
    own = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    lots = own.where(F.col(token) != "").groupBy(*keys, token).agg(F.min(rank).alias("_at"))
    first = lots.groupBy(*keys).agg(F.min_by(token, "_at").alias("_first"), F.count("*").alias("_lots"))
    first = first.withColumn("_first", F.when(F.col("_lots") == 1, F.col("_first"))) if only else first
    placed = own.join(first, keys, "left").withColumn(token, F.when(F.col(token) != "", F.col(token)).otherwise(F.coalesce("_first", F.lit(""))))
    merged = placed.groupBy(*keys, token).agg(F.min(rank).alias("_at"), *(first_by(f, rank) for f in fields), F.count("*").alias("n_rows"), *([F.min(order[0]).alias("first_row")] if only else []))
    return merged.withColumn("lot_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).drop("_at")


def allocate(parts: DataFrame, group: list[str], total: str, share: str, order: list[str], out: str = "part", exact: bool = True) -> DataFrame:
    """`total` of each group over its rows by `share`, to two decimals; the last row takes the remainder if `exact`.

    Without any positive share in a group its rows get equal parts; a null total gives null parts.
    """
    w = Window.partitionBy(*group)
    s = F.coalesce(F.col(share), F.lit(0)).cast("decimal(18,4)")
    weight = F.when(F.sum(s).over(w) > 0, s.cast("double") / F.sum(s).over(w).cast("double")).otherwise(1 / F.count("*").over(w))
    df = parts.withColumn("_part", F.round((F.col(total) * weight).cast("decimal(24,8)"), 2).cast("decimal(18,2)"))
    if not exact:
        return df.withColumn(out, F.col("_part").cast("double")).drop("_part")
    ordered = w.orderBy(*order)
    before = F.sum("_part").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    last = F.row_number().over(ordered) == F.count("*").over(w)
    rest = F.col(total).cast("decimal(18,2)") - F.coalesce(before, F.lit(0).cast("decimal(18,2)"))
    return df.withColumn(out, F.when(last, rest).otherwise(F.col("_part")).cast("double")).drop("_part")


def agreed_vote(votes: DataFrame, group: list[str], value: str, least: int = 2) -> DataFrame:
    """The value with a strict plurality of at least `least` votes, or the only value; groups without one are left out."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*group).agg(F.max(F.struct("n", value)).alias("t"), F.count("*").alias("values"), F.max("n").alias("most"), F.collect_list("n").alias("ns"))
    alone = F.size(F.filter("ns", lambda n: n == F.col("most"))) == 1
    return top.where(alone & ((F.col("values") == 1) | (F.col("most") >= least))).select(*group, F.col(f"t.{value}").alias(value), F.col("most").alias("votes"))


def unanimous_vote(votes: DataFrame, group: list[str], value: str) -> DataFrame:
    """The value of groups in which all non-null values are the same."""
    got = votes.where(F.col(value).isNotNull()).groupBy(*group).agg(F.min(value).alias(value), F.max(value).alias("_max"), F.count("*").alias("votes"))
    return got.where(F.col(value) == F.col("_max")).drop("_max")


def prefix_join(longer: DataFrame, shorter: DataFrame, long_key: str, short_key: str, tail: str = "^[0-9]{1,4}$", least: int = 3, longest_tail: int = 4) -> DataFrame:
    """Pairs where a key is another one plus a tail such as one to four digits; an equi-join on exploded prefixes, no theta join.

    Each longer key gives at most `longest_tail` prefixes of `least` characters or more.
    """
    n = F.length(long_key)
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(longest_tail)), lambda k: F.when((n - k >= least) & F.substr(F.col(long_key), n - k + 1).rlike(tail), F.substr(F.col(long_key), F.lit(1), n - k))), lambda p: p.isNotNull())
    return longer.withColumn(short_key, F.explode(cuts)).join(shorter, short_key)


def longest_known_prefix(parts: DataFrame, known: DataFrame, name: str, key: str, out: str = "parent") -> DataFrame:
    """Each component with the longest prefix of its name, cut at hyphen, underscore or slash, that is a known key."""
    words = F.split(F.col(name), "[-_/]")
    cut = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), "-"))
    some = parts.where(F.size(words) > 1).withColumn("_p", F.explode(cut))
    hit = some.join(known.select(F.col(key).alias("_p")).distinct(), "_p")
    return hit.groupBy(*parts.columns).agg(F.max_by("_p", F.length("_p")).alias(out))


def best_match(base: DataFrame, other: DataFrame, block: list[str], base_id: str, other_id: str, score: Column, least: float) -> DataFrame:
    """One-to-one pairs (block, base_id, other_id, score): in base order each takes the best free partner of at least `least`.

    Candidates meet only within equal block keys, so a block should be a lot's anchor (code, model), not a whole shipment;
    the sequential claim then runs over the block's few scored pairs. Columns of the sides are l_* and r_*.
    """
    left = base.select(*block, *(F.col(c).alias(f"l_{c}") for c in base.columns if c not in block))
    right = other.select(*block, *(F.col(c).alias(f"r_{c}") for c in other.columns if c not in block))
    scored = left.join(right, block).withColumn("score", score).where(F.col("score") >= least).select(*block, f"l_{base_id}", f"r_{other_id}", "score")
    schema = scored.schema

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = set(), []
        pdf = pdf.sort_values([f"l_{base_id}", "score", f"r_{other_id}"], ascending=[True, False, True])
        done = set()
        for i, a, b in zip(pdf.index, pdf[f"l_{base_id}"], pdf[f"r_{other_id}"]):
            if a not in done and b not in used:
                done.add(a)
                used.add(b)
                keep.append(i)
        return pdf.loc[keep]

    return scored.groupBy(*block).applyInPandas(claim, schema)


def _norm(text: str | None) -> str:
    return "".join(c for c in text.lower() if c.isalnum()) if isinstance(text, str) else ""


def _anchors(vendor: str | None, model: str | None, description: str | None) -> tuple[str, str, str]:
    """Vendor code (with a digit), model and first 48 signs of the description; "" for none."""
    v, m = _norm(vendor), _norm(model)
    return (v if v != "na" and any(c.isdigit() for c in v) else "", m if m not in ("na", "отсутствует") else "", _norm(description)[:48])


def claim_lines(base: list[tuple], other: list[tuple], least: int = 60) -> list[tuple]:
    """(base id, other id, score): in order each base line takes the first of its best free partners.

    Lines are (id, vendor, model, description, pieces) in order. Vendor code 100, model 80, description equal 70 or
    beginning alike 55, pieces equal 40, different -30. Free partners wait in queues by what they share with a base line, so
    that a line looks at the heads of a bounded number of queues, never at all pairs.
    """
    left, right = ([(i, *_anchors(v, m, d), None if p is None or p != p else round(p * 100)) for i, v, m, d, p in x] for x in (base, other))
    short = {len(x[3]) for x in left if 0 < len(x[3]) < 24}
    lengths = sorted({min(24, len(x[3])) for x in right if x[3]})
    queues: dict[tuple, list[int]] = {}
    for at, (_, v, m, d, p) in enumerate(right):
        begins = [("=", d), ("24", d[:24]), *(("<", d[:n]) for n in short if len(d) >= n)] if d else []
        for key in ((a, b, c, e) for a in {"", v} for b in {"", m} for c in [("", ""), *begins] for e in ("any", p) if a or b or c[1]):
            queues.setdefault(key, []).append(at)
    for q in queues.values():
        q.reverse()
    used, out = set(), []
    for i, v, m, d, p in left:
        begins = [(0, ("", ""))] + ([(70, ("=", d))] + [(55, ("24", d[:n])) for n in lengths if n <= len(d)] + [(55, ("<", d))] * (len(d) < 24) if d else [])
        pieces = [(0, "any")] if p is None else [(40, p), (0, None), (-30, "any")]
        tries = ((100 * bool(a) + 80 * bool(b) + s + t, (a, b, c, e)) for a in {"", v} for b in {"", m} for s, c in begins for t, e in pieces)
        best = None
        for score, key in tries:
            q = queues.get(key) if score >= least else None
            while q and q[-1] in used:
                q.pop()
            if q and (best is None or (-score, q[-1]) < best):
                best = (-score, q[-1])
        if best:
            used.add(best[1])
            out.append((i, right[best[1]][0], -best[0]))
    return out


def match_lines(lines: DataFrame) -> DataFrame:
    """(line_id, packing_line_id, score) by claim_lines in line_id order; lines: line_id, vendor, model, description, pieces, pack.

    Anchors of different kinds tie nearly all lines together and each claim depends on those before, so one task claims;
    its time and memory grow with the lines, not with their pairs.
    """

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_id")
        sides = [[tuple(r) for r in pdf.loc[pdf["pack"] == s, ["line_id", "vendor", "model", "description", "pieces"]].itertuples(index=False)] for s in (False, True)]
        return pd.DataFrame(claim_lines(*sides), columns=["line_id", "packing_line_id", "score"])

    return lines.groupBy().applyInPandas(claim, "line_id bigint, packing_line_id bigint, score int")


def with_totals(rows: DataFrame, levels: list[str], sums: list[str], digits: int = 2) -> DataFrame:
    """Sums at every level from the single group to the grand total (level: number of grouped columns), exact in decimals."""
    return rows.rollup(*levels).agg((F.lit(len(levels)) - F.size(F.filter(F.array(*(F.grouping(c) for c in levels)), lambda g: g == 1))).alias("level"), *(F.round(F.sum(F.col(s).cast("decimal(18,4)")), digits).cast("double").alias(s) for s in sums))
