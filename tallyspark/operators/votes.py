"""One value of a field out of what several papers say: parties, addresses, terms, fields by unanimity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ADDRESS = "(?iu)\\d{5,6}|ogrn|огрн|tin|inn|инн|kpp|кпп|street|st\\.|str\\.|avenue|road|district|region|city|province|china|hong\\s*kong|address\\s*:|bldg|building|apt\\.?|office|room|ул\\.|д\\."


def _buckets(votes: DataFrame, group: list[str], value: str, key: Column) -> DataFrame:
    """(group, key, n, value): votes counted by normalised value, the least spelling standing for each."""
    return votes.where(F.col(value).isNotNull()).withColumn("_k", key).groupBy(*group, "_k").agg(F.count("*").alias("n"), F.min(value).alias(value))


def agreed(votes: DataFrame, group: list[str], value: str, key: Column) -> DataFrame:
    """The value with more votes than any other after normalising; groups in which the first two tie are left out."""
    b = _buckets(votes, group, value, key)
    top = b.groupBy(*group).agg(F.max(F.struct("n", value)).alias("t"), F.max("n").alias("most"), F.count("*").alias("kinds"))
    ties = b.join(top.select(*group, "most"), group).where(F.col("n") == F.col("most")).groupBy(*group).agg(F.count("*").alias("tops"))
    return top.join(ties, group).where("tops = 1").select(*group, F.col(f"t.{value}").alias(value))


def party(votes: DataFrame, group: list[str], value: str) -> DataFrame:
    """The agreed name, else the longest if every other is part of it; undecided groups are left out.

    Everything is an aggregate of a group's distinct normalised names; of equally long ones the first counts.
    """
    b = _buckets(votes, group, value, T.loose_key(F.col(value)))
    said = votes.where(F.col(value).isNotNull()).select(*group, value, T.loose_key(F.col(value)).alias("_k"))
    longest = said.groupBy(*group).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col("_k").alias("k")), F.struct(-F.length(value), value)).alias("l"))
    inside = b.join(longest, group).groupBy(*group).agg(F.min(F.col("l.k").contains(F.col("_k")).cast("int")).alias("all"), F.first("l.v").alias("longest"))
    won = agreed(votes, group, value, T.loose_key(F.col(value)))
    return inside.join(won, group, "left").select(*group, F.coalesce(value, F.when(F.col("all") == 1, F.col("longest"))).alias(value)).where(F.col(value).isNotNull())


def incoterm(votes: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, code, value, n): the most frequent delivery term's code with its spelling of most Latin letters; of equals the first code."""
    v = F.trim(value)
    code = F.upper(F.regexp_extract(v, "(?i)^(EX-WORKS?|EXW|FCA|FAS|FOB|CFR|CIF|CPT|CIP|DAP|DPU|DDP|DAT|DDU)(?![\\p{L}\\p{N}_])", 1))
    latin = F.length(F.regexp_replace(v, "[^A-Za-z]", "")) / F.greatest(F.length(F.regexp_replace(v, "[^\\p{L}]", "")), F.lit(1))
    b = votes.where(F.col(value).isNotNull()).select(*group, code.alias("code"), v.alias(value), latin.alias("_l")).where("code != ''")
    b = b.groupBy(*group, "code").agg(F.count("*").alias("n"), F.max("_l").alias("_l"), F.max_by(value, F.struct("_l", value)).alias(value))
    return b.groupBy(*group).agg(F.min_by(F.struct("code", value, "n"), F.struct(-F.col("n"), -F.col("_l"), "code")).alias("b")).select(*group, "b.code", f"b.{value}", "b.n")


def address(votes: DataFrame, group: list[str], value: str, home: str | None = None) -> DataFrame:
    """The address of a group: those inside a longer one drop out; what `home` matches is preferred where something else is there too.

    Of what is left the only one; else the longest if all begin alike; else nothing. Distinct addresses of one group meet
    each other once by an equi-join on the group, so a group is a shipment's field, not a corpus.
    """
    said = votes.where(F.col(value).rlike(ADDRESS)).select(*group, F.trim(value).alias(value)).distinct().withColumn("_k", T.address_key(F.col(value)))
    one = said.groupBy(*group, "_k").agg(F.min(value).alias(value))
    other = one.select(*group, F.col("_k").alias("_o"))
    inside = one.join(other, group).where((F.col("_o") != F.col("_k")) & F.col("_o").contains(F.col("_k"))).select(*group, "_k").distinct()
    kept = one.join(inside, [*group, "_k"], "left_anti")
    if home:
        near = kept.withColumn("_h", F.col(value).rlike(home)).groupBy(*group).agg(F.max(F.col("_h").cast("int")).alias("_any"))
        kept = kept.join(near, group).where((F.col("_any") == 0) | F.col(value).rlike(home)).drop("_any")
    best = kept.groupBy(*group).agg(F.max_by(value, F.struct(F.length("_k"), "_k")).alias(value), F.count("*").alias("left"))
    return best.where("left = 1").select(*group, value)


def collapsed(votes: DataFrame, group: list[str], fields: dict[str, Column]) -> DataFrame:
    """Each field's value where all that a group says of it is one after normalising, else null; one aggregate for all fields."""
    keys = {f: k for f, k in fields.items()}
    marked = votes.withColumns({f"_k_{f}": k for f, k in keys.items()})
    aggs = [x for f in keys for x in (F.min(f).alias(f), F.min(f"_k_{f}").alias(f"_lo_{f}"), F.max(f"_k_{f}").alias(f"_hi_{f}"))]
    got = marked.groupBy(*group).agg(*aggs)
    return got.select(*group, *(F.when(F.col(f"_lo_{f}") == F.col(f"_hi_{f}"), F.col(f)).alias(f) for f in keys))


def merged_header(base: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str], addresses: tuple[str, ...] = ()) -> DataFrame:
    """Header fields of two readings: the base's value stays, gaps are filled; an address gives way to one that contains it whole."""
    both = base.join(incoming.select(*keys, *(F.col(f).alias(f"_n_{f}") for f in fields)), keys, "left")
    out = {}
    for f in fields:
        old, new = F.nullif(F.trim(f), F.lit("")), F.nullif(F.trim(f"_n_{f}"), F.lit(""))
        a, b = T.address_key(old), T.address_key(new)
        longer = (a != b) & b.contains(a)
        out[f] = F.when(longer, new).otherwise(F.coalesce(old, new)) if f in addresses else F.coalesce(old, new)
    return both.select(*keys, *(e.alias(f) for f, e in out.items()))
