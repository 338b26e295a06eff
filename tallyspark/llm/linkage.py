"""Problem 4: records of several tables that describe the same lot, matched without a key by probabilistic linkage.

Blocking passes on pairs of attributes give candidate pairs; each is compared attribute by attribute into a few levels of
agreement; expectation-maximisation over the counts of all level patterns estimates how often matches and non-matches show
each level; the posterior of a pair's pattern is its confidence, and a record goes to its likeliest item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import SIZE, quantity
from ..sources.tables import shuffle_width
from .lookalike import CYRILLIC, CYRILLIC_AS, fold_columns

# Colour names of the other language.
COLOURS = {"тёмно-синий": "navy", "песочный": "sand", "графит": "graphite", "слоновая кость": "ivory", "мятный": "mint", "белый": "white", "ржавый": "rust", "чёрный": "black", "дымчатый": "smoke", "сливовый": "plum", "бежевый": "beige", "коралловый": "coral", "оливковый": "olive"}
# Letters with marks, and words of a maker's name that say its legal form.
MARKED, PLAIN = "ÄÅÂÁÀÃÇÉÈÊËÍÎÏİÑÖÓÔÒÕŞŠÜÚÛÙÝŽŹŻĄĘĆŃŚŁ", "AAAAAACEEEEIIIINOOOOOSSUUUUYZZZAECNSL"
LEGAL = ("LTD", "CO", "GMBH", "SRL", "SPA", "OOO", "SP", "Z", "O", "SAN", "VE", "TIC", "AS", "A", "S", "P", "R", "L", "LLC", "INC", "AG", "KG")
#: Compared attributes and their number of levels; level 0 is missing on a side and says nothing, the highest is agreement.
FIELDS = {"name": 4, "qty": 4, "price": 4, "amount": 4, "net": 4, "gross": 4, "hs": 4, "color": 3, "maker": 4}
#: Where figures agree: by so much, or by a share of the larger one; and the share up to which they nearly do.
TOLERANCES = {"qty": (0.0051, 2e-4, 0.02), "price": (0.0051, 1e-4, 0.02), "amount": (0.51, 1e-5, 0.02), "net": (0.51, 1e-4, 0.03), "gross": (0.51, 1e-4, 0.03)}
#: Records and items whose keys a task compares at once; more are met in parts.
BLOCK_RECORDS, BLOCK_ITEMS = 100_000, 400_000
_COLUMNS = ["kind", "rid", "name", "qty", "price", "amount", "net", "gross", "hs", "color", "maker"]


def _name(folded: Column) -> Column:
    """A comparable key of an article: the part behind a caption line, letters and digits in upper case without marks."""
    last = F.element_at(F.split(folded, "\n"), -1)
    key = F.regexp_replace(F.translate(F.upper(last), MARKED + CYRILLIC[:15], PLAIN + CYRILLIC_AS[:15]), r"[^0-9A-Z\p{IsCyrillic}]", "")
    key = F.regexp_replace(key, "^(ART|NO)(?=[A-Z\\p{IsCyrillic}]{3})", "")
    return F.when((F.length(key) > 2) & key.rlike("[0-9]|[A-Z\\p{IsCyrillic}]{5}") & ~key.isin("OTCYTCTBYET"), key)


def _figure(c: str | Column, scale: int = 10000) -> Column:
    """A positive figure in ten-thousandths, which shuffles in fewer bytes than a double; null for anything else."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x) & (x > 0), F.round(x * scale).cast("long"))


def _colour(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    low = F.lower(F.trim(c))
    return F.when(low != "", F.hash(F.coalesce(table[low], low)).bitwiseAND(F.lit(0xFFFF)))


def _code(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(d) >= 4, F.substring(d, 1, 10))


def _maker(folded: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.upper(folded), r"[.'’]", ""), r"[^0-9A-Z\p{IsCyrillic}]+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL))
    return F.when(F.size(kept) > 0, F.array_distinct(F.transform(kept, lambda w: F.hash(w))))


def item_records(items: DataFrame) -> DataFrame:
    """The items in the common shape; items with a null id are left out."""
    df = fold_columns(items.where("item_id is not null").select("item_id", "article", "manufacturer", "color", "hs_code", "qty", "price", "amount", "net_weight", "gross_weight"), ["article", "manufacturer"])
    return df.select(F.lit(0).cast("byte").alias("kind"), F.col("item_id").alias("rid"), _name(F.col("article_folded")).alias("name"), _figure("qty").alias("qty"), _figure("price").alias("price"), _figure("amount").alias("amount"), _figure("net_weight").alias("net"), _figure("gross_weight").alias("gross"), _code(F.col("hs_code")).alias("hs"), _colour(F.col("color")).alias("color"), _maker(F.col("manufacturer_folded")).alias("maker"))


def row_records(rows: DataFrame) -> DataFrame:
    """Extracted rows in the common shape, without captions and null ids."""
    df = fold_columns(rows.where("row_id is not null and not coalesce(is_group, false)").select("row_id", "article", "color", "hs_code", "qty", "price", "amount", "net_weight", "gross_weight"), ["article"])
    return df.select(F.lit(1).cast("byte").alias("kind"), F.col("row_id").alias("rid"), _name(F.col("article_folded")).alias("name"), _figure("qty").alias("qty"), _figure("price").alias("price"), _figure("amount").alias("amount"), _figure("net_weight").alias("net"), _figure("gross_weight").alias("gross"), _code(F.col("hs_code")).alias("hs"), _colour(F.col("color")).alias("color"), F.lit(None).cast("array<int>").alias("maker"))


def line_records(lines: DataFrame) -> DataFrame:
    """Document lines in the common shape, without freight and null ids; quantities in common units."""
    df = lines.where("line_id is not null and not coalesce(freight, false)").select("line_id", "model", "vendor", "description", "hs", "qty_text", "pieces", "price", "amount", "net", "gross")
    df = fold_columns(df, ["model", "vendor"])

    @F.pandas_udf("double")
    def common(texts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else v * SIZE.get(u, 1.0) for v, u in map(quantity, texts)], dtype="float64")

    df = df.withColumn("q", common("qty_text"))
    qty = F.coalesce(_figure("q"), _figure("pieces"))
    tail = F.regexp_extract(F.lower("description"), r"[, ]\s*(тёмно-синий|слоновая кость|88-b|307|12|[a-zа-яё]+)\s*$", 1)
    known = [*COLOURS, *COLOURS.values(), "88-b", "307", "12"]
    slash = F.regexp_extract(F.lower("model_folded"), r"[/ ]([a-z]+|88-b)$", 1)
    colour = F.when(tail.isin(known), tail).when(slash.isin(known), slash)
    return df.select(F.lit(2).cast("byte").alias("kind"), F.col("line_id").alias("rid"), _name(F.col("model_folded")).alias("name"), F.when(qty > 0, qty).alias("qty"), _figure("price").alias("price"), _figure("amount").alias("amount"), _figure("net").alias("net"), _figure("gross").alias("gross"), _code(F.col("hs")).alias("hs"), _colour(colour).alias("color"), _maker(F.col("vendor_folded")).alias("maker"))


def _cents(c: str) -> Column:
    return F.round(F.col(c) / 100).cast("long")


def _key(tag: str, *parts: Column) -> Column:
    """A hashed blocking key; null if a part is."""
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in parts)), F.xxhash64(F.lit(tag), *parts))


def _figures(c: str, tight: float, share: float, loose: float) -> Column:
    a, b = F.col(f"r_{c}"), F.col(f"i_{c}")
    d, top = F.abs(a - b), F.greatest(a, b)
    tight *= 10000
    return F.when(a.isNull() | b.isNull(), 0).when((d <= tight) | (d <= share * top), 3).when(d <= loose * top, 2).otherwise(1)


def _pattern() -> Column:
    """All agreement levels of a pair in one number, two bits each."""
    rn, im = F.col("r_name"), F.col("i_name")
    within = (F.length(im) >= 5) & (rn.endswith(im) | rn.startswith(im)) | (F.length(rn) >= 5) & im.startswith(rn)
    name = F.when(rn.isNull() | im.isNull(), 0).when(rn == im, 3).when(within | (F.levenshtein(rn, im, 2) >= 0), 2).otherwise(1)
    rh, ih = F.col("r_hs"), F.col("i_hs")
    hs = F.when(rh.isNull() | ih.isNull(), 0).when((F.length(rh) >= 6) & ih.startswith(rh), 3).when(F.substring(rh, 1, 4) == F.substring(ih, 1, 4), 2).otherwise(1)
    rc, ic = F.col("r_color"), F.col("i_color")
    color = F.when(rc.isNull() | ic.isNull(), 0).when(rc == ic, 2).otherwise(1)
    rm, mm = F.col("r_maker"), F.col("i_maker")
    shared = F.size(F.array_intersect(rm, mm))
    maker = F.when(rm.isNull() | mm.isNull(), 0).when(shared >= F.least(F.lit(2), F.size(mm), F.size(rm)), 3).when(shared >= 1, 2).otherwise(1)
    levels = [name, *(_figures(c, *within) for c, within in TOLERANCES.items()), hs, color, maker]
    return reduce(lambda acc, x: acc.bitwiseOR(x), (F.shiftleft(x.cast("int"), 2 * i) for i, x in enumerate(levels)))


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in _COLUMNS))


def _mixed(*values: np.ndarray | int) -> np.ndarray:
    """A hash of whole numbers, place by place; equal in every process."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for v in values:
            x = np.asarray(v).astype(np.int64).astype(np.uint64)
            out = (out ^ x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


def _packed(rows: pa.Table) -> bytes:
    """Rows in a few bytes each: columns, repeated texts once, compressed."""
    for c in ("name", "hs", "maker"):
        rows = rows.set_column(rows.column_names.index(c), c, pc.dictionary_encode(rows[c]).combine_chunks())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    raw = sink.getvalue()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blobs: list[bytes]) -> pa.Table | None:
    tables = [pa.ipc.open_stream(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd")).read_all() for b in map(bytes, blobs)]
    if not tables:
        return None
    return pa.concat_tables([t.cast(pa.schema([(f.name, pa.string() if pa.types.is_dictionary(f.type) else f.type) for f in t.schema])) for t in tables])


def _dealt(rows: pa.Table, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, its rows packed)"""
    order = np.argsort(part, kind="stable")
    rows, part = rows.take(pa.array(order)), part[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0])) if len(part) else []
    for x, y in zip(starts, [*starts[1:], len(part)]):
        yield int(part[x]), _packed(rows.slice(x, y - x))


def _gathered(records: DataFrame, items: DataFrame, parts: int) -> RDD:
    """(part, packed rows) of records and items, shuffled so that equal first keys meet: article and quantity."""
    key = F.coalesce(_key("nq", F.col("name"), _cents("qty")), F.xxhash64(F.lit("none"), "kind", "rid"))
    maker = F.when(F.col("maker").isNotNull(), F.concat_ws(",", F.col("maker").cast("array<string>")))
    both = records.select(*_COLUMNS).unionByName(items.select(*_COLUMNS)).withColumn("maker", maker)

    def run(batches):
        held, n = [], 0

        def close():
            rows = pa.Table.from_batches(held)
            for part, blob in _dealt(rows.drop_columns("part"), rows["part"].to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 1 << 17:
                yield from close()
                held, n = [], 0
        if held:
            yield from close()

    packed = both.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).mapInArrow(run, "part int, blob binary")
    return packed.rdd.map(tuple).partitionBy(parts, int)


class Side:
    """The records or the items of a task as arrays, in the order of place, kind and id; NaN and -1 where a value is missing.

    names, makers: their codes, which both sides share. once: rows that differ by the id alone are one, with the lowest id;
    `times` has how many rows they were, `ids` how many ids, `group` the one that each row went into, `members` yields all ids.
    """

    def __init__(self, rows: pa.Table, names: dict[str, int], makers: dict[str, int], once: bool = False):
        self.rows = rows

        def coded(c: str, codes: dict[str, int]) -> np.ndarray:
            d = pc.dictionary_encode(rows[c]).combine_chunks()
            d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
            table = np.array([codes.setdefault(x, len(codes)) for x in d.dictionary.to_pylist()] or [-1], np.int64)
            at = pc.fill_null(d.indices, -1).to_numpy(zero_copy_only=False)
            return np.where(at >= 0, table[np.maximum(at, 0)], -1)

        self.n = len(rows)
        self.kind, self.rid = (rows[c].to_numpy() for c in ("kind", "rid"))
        self.place = rows["place"].to_numpy() if "place" in rows.column_names else np.zeros(self.n, np.int8)
        self.name, self.maker = coded("name", names), coded("maker", makers)
        self.of = {c: pc.cast(rows[c], pa.float64()).to_numpy() for c in ("qty", "price", "amount", "net", "gross")}
        self.color = pc.fill_null(rows["color"], -1).to_numpy()
        self.hs = pc.fill_null(pc.cast(pc.utf8_rpad(rows["hs"], 10, "0"), pa.int64()), -1).to_numpy()
        self.unit = 10 ** (10 - pc.fill_null(pc.utf8_length(rows["hs"]), 10).to_numpy().astype(np.int64))
        if once and self.n:
            whole = _mixed(self.name, self.maker, self.color, self.hs, self.unit, *(np.nan_to_num(x, nan=-1) for x in self.of.values()))
            order = np.lexsort((self.rid, whole, self.kind, self.place))
            change = lambda *by: np.concatenate([[True], reduce(np.logical_or, (np.diff(x[order]) != 0 for x in by))])
            new, other = change(whole, self.kind, self.place), change(self.rid, whole, self.kind, self.place)
            first = np.flatnonzero(new)
            self.times = np.diff(np.append(first, self.n))
            self.group = np.empty(self.n, np.int64)
            self.group[order] = np.cumsum(new) - 1
            self._rids, self._first = self.rid[order][other], np.searchsorted(np.flatnonzero(other), first)
            self.ids = np.diff(np.append(self._first, len(self._rids)))
            order = order[new]
            for c in ("kind", "rid", "place", "name", "maker", "color", "hs", "unit"):
                setattr(self, c, getattr(self, c)[order])
            self.of = {c: x[order] for c, x in self.of.items()}
            self.n = len(order)
        self.cents = {c: np.floor(x / 100 + 0.5) for c, x in self.of.items()}
        self.whole = {c: np.floor(x / 10000 + 0.5) for c, x in self.of.items()}
        self.wide = {c: np.floor(x / 100 + 0.5) for c, x in self.cents.items()}  # by the cents: figures of equal cents always meet
        self.log = np.log(self.of["qty"])

    def members(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `at`, id) of all rows that are one with those at `at`."""
        n = self.ids[at]
        return np.repeat(np.arange(len(at)), n), self._rids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self._first[at], n)]

    def cells(self, width: float, slack: float = 0.0) -> list[np.ndarray]:
        """An item's cell of the quantity, or the two of a record: quantities that differ by a share of `slack` at most meet in one."""
        return [np.floor((self.log + s) / width) for s in ((-slack, slack) if slack else (0.0,))]

    def key(self, tag: int, *values: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) where all values are there."""
        there = reduce(np.logical_and, (~np.isnan(v) & (v >= 0) if v is self.name else ~np.isnan(v) for v in values))
        at = np.flatnonzero(there if where is None else there & where)
        return at, _mixed(tag, *(v[at] for v in values))


def _levels(r: Side, i: Side, p: np.ndarray, q: np.ndarray, name: np.ndarray | int, shared: dict[tuple[int, int], int], makers: list[frozenset]) -> np.ndarray:
    """The pattern, as _pattern has it, of each pair of the record at p and the item at q; name: the level of the names."""
    out = np.zeros(len(p), np.int64) + name
    for c, (tight, share, loose) in TOLERANCES.items():
        a, b = r.of[c][p], i.of[c][q]
        d, top = np.abs(a - b), np.maximum(a, b)
        level = 1 + (d <= loose * top).astype(np.int64)
        level[(d <= tight * 10000) | (d <= share * top)] = 3
        level[np.isnan(d)] = 0
        out |= level << 2 * list(FIELDS).index(c)
    a, b, unit = r.hs[p], i.hs[q], r.unit[p]
    hs = 1 + (a // 1000000 == b // 1000000).astype(np.int64)
    hs[(unit <= 10000) & (i.unit[q] <= unit) & (a // unit == b // unit)] = 3
    hs[(a < 0) | (b < 0)] = 0
    a, b = r.color[p], i.color[q]
    color = 1 + (a == b).astype(np.int64)
    color[(a < 0) | (b < 0)] = 0
    a, b = r.maker[p], i.maker[q]
    maker, known = np.zeros(len(p), np.int64), np.flatnonzero((a >= 0) & (b >= 0))
    codes, back = np.unique(a[known] << 32 | b[known], return_inverse=True)
    table = []
    for x, y in zip((codes >> 32).tolist(), (codes & 0xFFFFFFFF).tolist()):
        if (x, y) not in shared:
            n = len(makers[x] & makers[y])
            shared[x, y] = 3 if n >= min(2, len(makers[x]), len(makers[y])) else 2 if n else 1
        table.append(shared[x, y])
    maker[known] = np.array(table, np.int64)[back]
    return out | hs << 2 * list(FIELDS).index("hs") | color << 2 * list(FIELDS).index("color") | maker << 2 * list(FIELDS).index("maker")


def _within_two(a: list[str], b: list[str]) -> np.ndarray:
    """Whether each two texts are two changes of a character apart at most."""
    la, lb = (np.array([len(x) for x in t]) for t in (a, b))
    out = np.zeros(len(a), bool)
    close = np.flatnonzero(np.abs(la - lb) <= 2)
    if not len(close):
        return out
    la, lb = la[close], lb[close]
    width = int(max(la.max(), lb.max())) + 4
    x, y = (np.frombuffer(b"".join(t[k].encode("utf-32-le").ljust(4 * width, b"\0") for k in close.tolist()), "<u4").reshape(-1, width).T.copy() for t in (a, b))
    far = np.full(len(close), 9, np.int8)
    row, end = [far, far, *(np.full(len(close), k, np.int8) for k in range(3))], np.full(len(close), 9, np.int8)
    for i in range(width):
        for k in range(5):
            at = (la == i) & (lb - la == k - 2)
            end[at] = row[k][at]
        if i == width - 3:
            break
        last, row = row, []
        for k in range(5):
            j = i + 1 + k - 2
            if j < 0:
                row.append(far)
            elif j == 0:
                row.append(np.full(len(close), min(i + 1, 9), np.int8))
            else:
                best = last[k] + (x[i] != y[j - 1])
                best = np.minimum(best, last[k + 1] + 1) if k < 4 else best
                row.append(np.minimum(np.minimum(best, row[k - 1] + 1) if k else best, 9).astype(np.int8))
    out[close] = end <= 2
    return out


def _name_levels(r: np.ndarray, i: np.ndarray, names: list[str]) -> np.ndarray:
    """The level of the names of pairs, as _pattern has it; r, i: their codes."""
    codes, back = np.unique((r + 1) << 32 | (i + 1), return_inverse=True)
    x, y = (codes >> 32) - 1, (codes & 0xFFFFFFFF) - 1
    level = np.where((x < 0) | (y < 0), 0, np.where(x == y, 3, 1))
    open_ = np.flatnonzero(level == 1)
    a, b = ([names[k] for k in c[open_].tolist()] for c in (x, y))
    near = _within_two(a, b) if len(open_) else np.zeros(0, bool)
    near |= np.array([len(m) >= 5 and (n.endswith(m) or n.startswith(m)) or len(n) >= 5 and m.startswith(n) for n, m in zip(a, b)], bool)
    level[open_[near]] = 2
    return level[back]


def _shared(r: Side, i: Side, p: np.ndarray, q: np.ndarray, c: str) -> np.ndarray:
    """Whether pairs share the rounded figure, or the quantity's cell of 0.05 %."""
    if c == "qty":
        return _near(r, i, p, q, 0.0005, 0.00021)
    a, b, x, y = r.whole[c][p], r.wide[c][p], i.whole[c][q], i.wide[c][q]
    return (a == x) | (b == y) | (a == y) | (b == x)


def _near(r: Side, i: Side, p: np.ndarray, q: np.ndarray, width: float, slack: float) -> np.ndarray:
    cell = np.floor(i.log[q] / width)
    return (np.floor((r.log[p] - slack) / width) == cell) | (np.floor((r.log[p] + slack) / width) == cell)


def _agreeing(r: Side, i: Side, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether a pair of one article agrees in two things beside it, or in the amount: the pairs that the model is estimated on.

    Those that agree in one thing alone grow as the square of an article's items, and would drown the matches.
    """
    both = lambda c, kind: getattr(r, kind)[c][p] == getattr(i, kind)[c][q]
    a, b = r.color[p], i.color[q]
    unknown = np.isnan(r.of["qty"][p]) | np.isnan(i.of["qty"][q])
    open_ = (a < 0) | (b < 0)
    beside = (a == b) & (a >= 0) | open_ & (unknown | _near(r, i, p, q, 0.05, 0.0203))
    # the weights of one lot follow each other: only their exact figures are two things
    two = both("price", "cents") & (both("net", "whole") | both("gross", "whole")) | both("net", "cents") & both("gross", "cents")
    return _shared(r, i, p, q, "amount") | _shared(r, i, p, q, "qty") & ((a == b) | open_) | (_shared(r, i, p, q, "net") | _shared(r, i, p, q, "gross")) & beside | two


#: The figures of the second pass in this order, and for each the exact ones that it is a key with, where the article lacks or is misspelt.
PLACES = {"qty": ("price", "net", "amount", "gross"), "amount": ("price", "net", "gross"), "net": ("price", "gross"), "gross": ("price",)}


def _exact(c: str, beside: str) -> tuple[str, str]:
    """The roundings by which two figures are a key together."""
    if (c, beside) == ("net", "gross"):
        return "cents", "cents"
    return "cents" if c == "qty" else "whole", "cents" if beside == "price" else "whole"


def _places(s: Side, parts: int, items: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, their part, place): where records or items meet in the second pass.

    Every pair of it shares a figure, so each goes to the parts of its quantity, amount and weights: at most four for any
    article. Quantities lie in ranges of 0.8 %, under 20 of 0.16; a record near the end of one goes to the next too. Other
    figures lie by their rounded value (place 2 * figure), and by the rounded cents (place 2 * figure + 1) where that differs.
    """
    for k, (c, beside) in enumerate(PLACES.items()):
        useful = ~np.isnan(s.of[c]) & reduce(np.logical_or, (~np.isnan(s.of[x]) for x in beside), s.name >= 0)
        if c == "qty":
            x = s.of[c] / 10000
            off = 0 if items else np.maximum(0.00073 * x, 0.0101)
            low, high = (np.floor(np.where(v < 20, v / 0.16, 125 + np.log(np.maximum(v, 1e-9) / 20) / 0.008)) for v in (x - off, x + off))
        else:
            low, high = s.whole[c], s.wide[c]
        for value, where, place in ((low, useful, 2 * k), (high, useful & (high != low), 2 * k + (c != "qty"))):
            at = np.flatnonzero(where)
            yield at, (_mixed(k, value[at]) % np.uint64(parts)).astype(np.int64), place


def _pairs(r: Side, i: Side, keys: list, block: tuple[int, int], most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(record's place, item's place) of all pairs that share a key, each once, some `most` at once; keys: ((place, hash) of records, of items)."""
    for low in range(0, r.n, block[0]):
        for item_low in range(0, i.n, block[1]):
            found = []
            for (at, key), (their_at, their_key) in keys:
                mine = (at >= low) & (at < low + block[0])
                theirs = (their_at >= item_low) & (their_at < item_low + block[1])
                at, key, their_at, their_key = at[mine], key[mine], their_at[theirs], their_key[theirs]
                order = np.argsort(their_key, kind="stable")
                a, b = (np.searchsorted(their_key[order], key, side) for side in ("left", "right"))
                met = b > a
                found.append((at[met], a[met], (b - a)[met], their_at[order]))
            total = np.cumsum(sum(np.bincount(at, n, r.n) for at, _, n, _ in found))
            start, stop = low, min(r.n, low + block[0])
            while start < stop:
                end = min(stop, max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))))
                codes = []
                for at, first, n, where in found:
                    x, y = np.searchsorted(at, (start, end))
                    n_here, ends = n[x:y], np.cumsum(n[x:y])
                    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n_here, n_here) + np.repeat(first[x:y], n_here)
                    codes.append(np.repeat(at[x:y], n_here) * i.n + where[place])
                codes = np.concatenate(codes)
                if len(codes):
                    yield np.divmod(np.unique(codes), i.n)
                start = end


Compared = tuple[Side, Side, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _sides(rows: pa.Table) -> tuple[Side, Side, list[str], list[frozenset]]:
    names: dict[str, int] = {}
    makers: dict[str, int] = {}
    item = rows["kind"].to_numpy() == 0
    r, i = (Side(rows.filter(pa.array(x)), names, makers, True) for x in (~item, item))
    return r, i, list(names), [frozenset(m.split(",")) for m in makers]


def _first_pairs(r: Side, i: Side, makers: list[frozenset], block: tuple[int, int]) -> Iterator[Compared]:
    """The pairs of one article and quantity, compared: sides, places, patterns, and how often each counts for the model."""
    shared: dict[tuple[int, int], int] = {}
    for p, q in _pairs(r, i, [tuple(s.key(0, s.name, s.cents["qty"]) for s in (r, i))], block):
        yield r, i, p, q, _levels(r, i, p, q, 3, shared, makers), r.times[p] * i.times[q]


class Model:
    """What each level of each attribute adds to the log odds of a match, and how much they need."""

    def __init__(self, share: float, m: list[np.ndarray], u: list[np.ndarray], least: float):
        self.prior, self.least = float(np.log(share / (1 - share))), float(np.log(least / (1 - least)))
        self.adds = {c: np.array([0.0, *np.log(np.maximum(a[1:], 1e-9) / np.maximum(b[1:], 1e-9))]) for c, a, b in zip(FIELDS, m, u)}

    def at_most(self, r: Side) -> np.ndarray:
        """For each record, at most the log odds of an item of its article with another quantity, price and amount and without a word on its colour."""
        top = self.prior + self.adds["name"][3] + self.adds["qty"][1] + np.zeros(r.n)
        for c in ("price", "amount"):
            top += max(0.0, self.adds[c][1]) * ~np.isnan(r.of[c])
        for c, there in (("net", ~np.isnan(r.of["net"])), ("gross", ~np.isnan(r.of["gross"])), ("hs", r.hs >= 0), ("maker", r.maker >= 0)):
            top += max(0.0, self.adds[c].max()) * there
        return top


def _weight_keys(r: Side, i: Side, c: str, only: Model | None) -> list:
    """The keys of an article's pairs with one weight c: those of the pairs that count for the model, or with `only` those of the pairs that it can call matches.

    The pairs left out agree in no more than the weight, and grow as the square of the article's items. Whether pairs of another
    quantity, price, amount and colour can be matches at all follows from the model; where they can, they are met like the others.
    """
    value = [np.where(s.place & 1, s.wide[c], s.whole[c]) for s in (r, i)]
    all_, known = [np.ones(s.n, bool) for s in (r, i)], [s.color >= 0 for s in (r, i)]
    tags = iter(range(100, 200))

    def met(mine: np.ndarray, theirs: np.ndarray, *beside: tuple[np.ndarray, np.ndarray]) -> tuple:
        tag = next(tags)
        return tuple(s.key(tag, s.name, v, *x, where=w) for s, v, w, *x in zip((r, i), value, (mine, theirs), *beside))

    def near(figure: str, mine: np.ndarray, theirs: np.ndarray) -> list:
        logs = [np.log(s.of[figure]) for s in (r, i)]
        return [met(mine, theirs, (np.floor((logs[0] + slack) / 0.05), np.floor(logs[1] / 0.05))) for slack in (-0.0203, 0.0203)]

    exact = lambda figure: tuple(s.cents[figure] for s in (r, i))
    unknown = [np.isnan(s.of["qty"]) for s in (r, i)]
    keys = [met(known[0], known[1], (r.color, i.color)), met(unknown[0], all_[1]), met(all_[0], unknown[1])]
    keys += [met(*all_, exact("price")), met(*all_, exact("gross" if c == "net" else "net"))]
    if only is None:
        return keys + near("qty", ~known[0], all_[1]) + near("qty", known[0], ~known[1])
    top = only.at_most(r)
    # small figures nearly agree by so much, not by a share
    top[(r.of["qty"] < 3000) | (r.of["price"] < 3000) | (r.of["amount"] < 300000)] = np.inf
    may, may_differ = (x >= only.least - 1e-6 for x in (top, top + only.adds["color"][1]))
    keys += [met(known[0] & may_differ, known[1]), met(~known[0] & may, all_[1]), met(known[0] & may, ~known[1])]
    return keys + [k for figure in ("qty", "price", "amount") for k in near(figure, *all_)]


def _second_pairs(blobs: list[bytes], block: tuple[int, int], only: Model | bool | None = None) -> Iterator[Compared]:
    """The pairs of a part that share a second key but not the first, compared like those of the first pass.

    With the article its keys are the quantity's cell of 0.05 %, the amount and each weight, rounded, however common the article
    is; without it every two exact figures. Each figure is a key of its own, so that a wrong or missing one hides no other. A pair
    that shares several figures is compared at the first of them only.
    only: True leaves out pairs that don't count for the model, and a model some that it cannot call matches.
    """
    rows = _unpacked(blobs)
    if rows is None:
        return
    figure = rows["place"].to_numpy() >> 1
    for k, (c, beside) in enumerate(PLACES.items()):
        r, i, names, makers = _sides(rows.filter(pa.array(figure == k)))
        if not r.n or not i.n:
            continue
        shared: dict[tuple[int, int], int] = {}
        if c == "qty":
            keys = [(r.key(0, r.name, cell), i.key(0, i.name, i.cells(0.0005)[0])) for cell in r.cells(0.0005, 0.00021)]
        elif c == "amount" or not only:
            keys = [tuple(s.key(0, s.name, np.where(s.place & 1, s.wide[c], s.whole[c])) for s in (r, i))]
        else:
            keys = _weight_keys(r, i, c, None if only is True else only)
        for tag, other in enumerate(beside, 1):
            one, two = _exact(c, other)
            here = [s.place & 1 == (0 if c == "qty" or one == "whole" else s.wide[c] != s.whole[c]) for s in (r, i)]
            keys.append(tuple(s.key(tag, getattr(s, one)[c], getattr(s, two)[other], where=w) for s, w in zip((r, i), here)))
        for p, q in _pairs(r, i, keys, block):
            same = (r.name[p] == i.name[q]) & (r.name[p] >= 0)
            keep = np.where(same, (r.cents["qty"][p] != i.cents["qty"][q]) & ((r.place[p] & i.place[q] & 1) == 0), True)
            for earlier in list(PLACES)[:k]:
                exact = [(earlier, other, *_exact(earlier, other)) for other in PLACES[earlier]]
                met = reduce(np.logical_or, ((getattr(r, x)[a][p] == getattr(i, x)[a][q]) & (getattr(r, y)[b][p] == getattr(i, y)[b][q]) for a, b, x, y in exact))
                keep &= ~np.where(same, _shared(r, i, p, q, earlier), met)
            p, q, same = p[keep], q[keep], same[keep]
            if len(p):
                name = np.full(len(p), 3, np.int64)
                name[~same] = _name_levels(r.name[p[~same]], i.name[q[~same]], names)
                n = r.ids[p] * np.where(same, _agreeing(r, i, p, q) * i.ids[q], i.times[q])
                yield r, i, p, q, _levels(r, i, p, q, name, shared, makers), n


_STATISTICS = ["kind", "rid", "item_id", "pattern", "n"]
_STATISTICS_TYPE = "kind tinyint, rid bigint, item_id bigint, pattern int, n bigint"
#: As many patterns as there are, seen or not.
PATTERNS = 4 ** len(FIELDS)


class Counts:
    """How many pairs count for the model by pattern, and which patterns there are."""

    def __init__(self):
        self.n, self.seen = np.zeros(PATTERNS, np.int64), np.zeros(PATTERNS, bool)

    def add(self, pattern: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.n, pattern, n)
        self.seen[pattern] = True

    def dealt(self, shares: int) -> Iterator[tuple[int, bytes]]:
        """(share, its patterns packed)"""
        at = np.flatnonzero(self.seen)
        for k in range(shares):
            mine = at[at % shares == k]
            if len(mine):
                yield k, np.stack([mine, self.n[mine]]).astype(np.int64).tobytes()

    def merge(self, packed: bytes) -> None:
        self.add(*np.frombuffer(packed, np.int64).reshape(2, -1))


def _best(kind: np.ndarray, rid: np.ndarray, item: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each record the likeliest item, of equal ones the lowest."""
    order = np.lexsort((item, -odds, rid, kind))
    new = np.concatenate([[True], (np.diff(rid[order]) != 0) | (np.diff(kind[order]) != 0)]) if len(order) else np.zeros(0, bool)
    return tuple(x[order[new]] for x in (kind, rid, item, odds))


_BEST_TYPES = (np.int8, np.int64, np.int64, np.float64)


def _best_packed(columns: tuple[np.ndarray, ...]) -> bytes:
    raw = len(columns[0]).to_bytes(8, "little")
    data = b"".join(np.ascontiguousarray(x.astype(t)).view(np.uint8).reshape(len(x), -1).T.tobytes() for x, t in zip(columns, _BEST_TYPES))  # bytes of one weight together
    return raw + pa.compress(data, codec="zstd", asbytes=True)


def _best_unpacked(blob: bytes) -> list[np.ndarray]:
    n, out, at = int.from_bytes(blob[:8], "little"), [], 0
    widths = [np.dtype(t).itemsize for t in _BEST_TYPES]
    data = pa.decompress(bytes(blob[8:]), n * sum(widths), codec="zstd", asbytes=True)
    for t, w in zip(_BEST_TYPES, widths):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T).view(t).reshape(n))
        at += n * w
    return out


def _likeliest(compared: Iterator[Compared], odds: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part of the record, packed) of each record with its likeliest item of these pairs; odds: by pattern, NaN where too low."""
    held: list[tuple[np.ndarray, ...]] = []
    for r, i, p, q, pattern, _ in compared:
        of = odds[pattern]
        ok = ~np.isnan(of)
        _, at, item, of = _best(np.zeros(ok.sum(), np.int8), p[ok], i.rid[q[ok]], of[ok])
        back, rid = r.members(at)
        held.append(_best(r.kind[at][back], rid, item[back], of[back]))
        if len(held) > 64:
            held = [_best(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        kind, rid, item, of = _best(*(np.concatenate(x) for x in zip(*held)))
        part = (_mixed(kind, rid) % np.uint64(parts)).astype(np.int64)
        for x in np.unique(part):
            yield int(x), _best_packed(tuple(v[part == x] for v in (kind, rid, item, of)))


def _blobs(rows: Iterator[tuple[int, bytes]]) -> list[bytes]:
    return [b for _, b in rows]


def _onward(rows: Iterator[tuple[int, bytes]], parts: int, block: tuple[int, int], first: bool = True) -> Iterator[tuple[int, bytes]]:
    """(part, packed) of the items, and of the records that the second pass is for, in all their places; part -1: counts of the first pass.

    These records have no pair in the first pass, or one that doesn't agree in article, quantity and another figure.
    first=False: all records.
    """
    table = _unpacked(_blobs(rows))
    if table is None:
        return
    item = table["kind"].to_numpy() == 0
    rows_of = [Side(table.filter(pa.array(x)), {}, {}) for x in (~item, item)]
    rest = np.ones(rows_of[0].n, bool)
    if first and rows_of[0].n:
        r, i, _, makers = _sides(table)
        counts, met, loose = Counts(), np.zeros(r.n, bool), np.zeros(r.n, bool)
        level = lambda pattern, c: pattern >> 2 * list(FIELDS).index(c) & 3
        for _, _, p, _, pattern, n in _first_pairs(r, i, makers, block) if i.n else ():
            counts.add(pattern, n)
            settled = (level(pattern, "qty") == 3) & reduce(np.logical_or, (level(pattern, c) == 3 for c in ("price", "amount", "net", "gross")))
            met[p] = True
            loose[p[~settled]] = True
        rest = (~met | loose)[r.group]
        yield from ((-1, b) for _, b in counts.dealt(1))
    out = []
    for s, items in zip(rows_of, (False, True)):
        for at, part, place in _places(s, parts, items):
            ok = slice(None) if items else rest[at]
            at, part = at[ok], part[ok]
            out.append((s.rows.take(pa.array(at)).append_column("place", pa.array(np.full(len(at), place, np.int8))), part))
    yield from _dealt(pa.concat_tables([t for t, _ in out]), np.concatenate([x for _, x in out]))


def _own(part: int) -> int:
    return max(part, 0)


#: Tasks that add the counts of all others up, each for its share of the patterns.
SHARES = 8


def _count(rows: Iterator[tuple[int, bytes]], block: tuple[int, int], only: bool) -> Iterator[tuple[int, bytes]]:
    counts, blobs = Counts(), []
    for part, b in rows:
        if part < 0:
            counts.merge(b)
        else:
            blobs.append(b)
    for *_, pattern, n in _second_pairs(blobs, block, only):
        counts.add(pattern, n)
    yield from counts.dealt(SHARES)


def _summed(rows: Iterator[tuple[int, bytes]]) -> Iterator[bytes]:
    counts = Counts()
    for _, b in rows:
        counts.merge(b)
    yield from (b for _, b in counts.dealt(1))


def _statistics(rows: Iterator[tuple[int, bytes]], block: tuple[int, int]) -> Iterator[tuple]:
    for r, i, p, q, pattern, n in _second_pairs([b for part, b in rows if part >= 0], block):
        back, rid = r.members(p)
        yield from zip(r.kind[p][back].tolist(), rid.tolist(), i.rid[q][back].tolist(), pattern[back].tolist(), (n // r.ids[p])[back].tolist())


def _second_pass(rest: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, rid, item_id, pattern, n): by record and pattern the lowest item and how often the pairs that share a second key, but not the first, count for the model.

    For tests and for looking into pairs: they are listed one by one here, which link never does.
    """
    parts, block = shuffle_width(rest.sparkSession), (BLOCK_RECORDS, BLOCK_ITEMS)
    placed = _gathered(rest, items, parts).mapPartitions(partial(_onward, parts=parts, block=block, first=False)).partitionBy(parts, _own)
    pairs = rest.sparkSession.createDataFrame(placed.mapPartitions(partial(_statistics, block=block)), _STATISTICS_TYPE)
    return pairs.groupBy("kind", "rid", "pattern").agg(F.min("item_id").alias("item_id"), F.sum("n").alias("n")).select(*_STATISTICS)


def _by_article(rest: DataFrame, items: DataFrame) -> DataFrame:
    """Those of _second_pass that have one article."""
    return _second_pass(rest, items).where(F.col("pattern").bitwiseAND(F.lit(3)) == 3)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Share of matches and, for each attribute, the probability of each level among matches and among non-matches.

    Attributes count as independent within either class; a missing one (level 0) says nothing. Starts from matches
    agreeing in nine cases of ten. Every level keeps a small probability, so that no single one decides.
    """
    levels = np.stack([patterns >> 2 * i & 3 for i in range(len(FIELDS))], 1)
    weight = counts.astype(float)
    m, u = [], []
    for n in FIELDS.values():
        rest = max(1, n - 2)
        m.append(np.array([0.0, *[0.1 / rest] * (n - 2), 0.9]))
        u.append(np.array([0.0, 0.8, *[0.2 / rest] * (n - 2)]))
    share = 0.7
    for _ in range(rounds):
        like = np.zeros((2, len(patterns)))
        for k, (mm, uu) in enumerate(zip(m, u)):
            there = levels[:, k] > 0
            like[0] += np.where(there, np.log(np.maximum(mm[np.minimum(levels[:, k], len(mm) - 1)], 1e-9)), 0)
            like[1] += np.where(there, np.log(np.maximum(uu[np.minimum(levels[:, k], len(uu) - 1)], 1e-9)), 0)
        odds = like[0] - like[1] + np.log(share / (1 - share))
        post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        share = min(0.999, max(0.001, (weight * post).sum() / weight.sum()))
        for k, n in enumerate(FIELDS.values()):
            for p, table in ((post, m), (1 - post, u)):
                got = np.array([(weight * p)[levels[:, k] == lv].sum() if lv else 0.0 for lv in range(n)]) + np.array([0.0, *[0.5] * (n - 1)])
                table[k] = got / got.sum()
    return share, m, u


def posteriors(patterns: np.ndarray, share: float, m: list[np.ndarray], u: list[np.ndarray]) -> np.ndarray:
    """log odds that a pair with the pattern is a match."""
    odds = np.full(len(patterns), np.log(share / (1 - share)))
    for k in range(len(FIELDS)):
        lv = np.minimum(patterns >> 2 * k & 3, len(m[k]) - 1)
        odds += np.where(lv > 0, np.log(np.maximum(m[k][lv], 1e-9) / np.maximum(u[k][lv], 1e-9)), 0)
    return odds


def link(records: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """(item_id, kind, rid, confidence): each record with its likeliest item, if that is a match with `least` at all.

    records, items: in the common shape (row_records, line_records; item_records). Repeated records and items count once.
    First pass: article and quantity, which splits even an article of a third of all rows by its lots. Records that have
    no pair there, or one not agreeing in article, quantity and another figure, go through the second pass, keys of two figures
    or of the article and a figure. The model is estimated on the pairs that agree in two things, all pairs are judged by it.

    Pairs exist in the task where they meet only, once to be counted by pattern and again, when the model is there, to find the
    likeliest; both times the same shuffled records and items are read, and what is shuffled grows as these, whatever the pairs.
    The counts of level patterns, at most some ten thousand, are all that comes to the driver. An empty side gives an empty result.
    """
    spark = records.sparkSession
    kept = "item_id bigint, kind tinyint, rid bigint, confidence double"
    if not records.take(1) or not items.take(1):
        return spark.createDataFrame([], kept)
    parts, block = shuffle_width(spark), (BLOCK_RECORDS, BLOCK_ITEMS)
    gathered = _gathered(records, items, parts)
    placed = gathered.mapPartitions(partial(_onward, parts=parts, block=block)).partitionBy(parts, _own)
    for only in (True, False):  # where no pair counts for the model, all do
        counts = Counts()
        for packed in placed.mapPartitions(partial(_count, block=block, only=only)).partitionBy(SHARES, int).mapPartitions(_summed).collect():
            counts.merge(packed)
        if counts.n.any():
            break
    patterns = np.flatnonzero(counts.seen)
    if not len(patterns):
        return spark.createDataFrame([], kept)
    weights = counts.n[patterns]
    fitted = expectation_maximisation(patterns, weights if weights.any() else np.ones(len(weights)))
    model, odds = Model(*fitted, least), posteriors(np.arange(PATTERNS), *fitted)
    odds[odds < model.least] = np.nan

    def likely_first(rows):
        table = _unpacked(_blobs(rows))
        if table is not None:
            r, i, _, makers = _sides(table)
            if not r.n or not i.n:
                return
            yield from _likeliest(_first_pairs(r, i, makers, block), odds, parts)

    def likely_second(rows):
        yield from _likeliest(_second_pairs([b for part, b in rows if part >= 0], block, model), odds, parts)

    def best(rows):
        held = [_best_unpacked(b) for b in _blobs(rows)]
        if held:
            yield (_best_packed(_best(*(np.concatenate(x) for x in zip(*held)))),)

    def shown(batches):
        for batch in batches:
            for blob in batch.column(0):
                kind, rid, item, of = _best_unpacked(blob.as_py())
                for at in range(0, len(rid), 1 << 16):
                    x = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(item[x]), pa.array(kind[x]), pa.array(rid[x]), pa.array(1 / (1 + np.exp(-of[x])))], names=["item_id", "kind", "rid", "confidence"])

    found = gathered.mapPartitions(likely_first).union(placed.mapPartitions(likely_second)).partitionBy(parts, int)
    return spark.createDataFrame(found.mapPartitions(best), "best binary", verifySchema=False).mapInArrow(shown, kept)
