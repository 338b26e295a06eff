"""Problem 2: differences between two copies of data by characteristic polynomials over a finite field.

Each copy is a set of row hashes, split into small buckets by key. A bucket's set S is described by its size and the values
of its characteristic polynomial, the product of (z - s) over s in S, at fixed points z. In the quotient of the two copies'
values all common rows cancel; a rational function of low degree through the quotients has the rows of only one copy as its
roots. The degree bound is doubled until the function also fits points it wasn't made from. Only these few numbers of each
bucket meet; rows are fetched for the roots alone and compared field by field.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import field61 as gf
from ..sources.tables import cut, shuffle_width

#: Points kept for verification, beyond those the degree bound needs.
SPARE = 2
#: Values sketched in the first and each further round; hashes stay below the points, so no value is 0.
ROUNDS = (24, 96, 384)
_HASH_TOP = gf.P - 4096


def _points(n: int) -> np.ndarray:
    return (gf.P - 1 - np.arange(n)).astype(np.uint64)


def hashed(df: DataFrame, key: Column, content: list[Column], buckets: int) -> DataFrame:
    """(bucket, h, key) of each row: h in the field from the key and all of its content, the bucket from the key."""
    word = F.xxhash64(key, *content)
    h = F.pmod(F.xxhash64(word, F.lit(977), key, *content).bitwiseXOR(F.shiftleft(word, 1)), F.lit(_HASH_TOP))
    return df.select(F.pmod(F.xxhash64(F.lit(31), key), F.lit(buckets)).cast("int").alias("bucket"), h.alias("h"), key.alias("key"))


def _by_bucket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by bucket, cut so that none splits a bucket."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        ends = np.flatnonzero(pdf.bucket.to_numpy() != pdf.bucket.iloc[-1])
        if not len(ends):
            if held and held[-1].bucket.iloc[-1] != pdf.bucket.iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(pdf)
            continue
        cut_at = ends[-1] + 1
        yield pd.concat([*held, pdf.iloc[:cut_at]])
        held = [pdf.iloc[cut_at:]]
    if held:
        yield pd.concat(held)


def sketch(rows: DataFrame, n_points: int) -> DataFrame:
    """(bucket, n, vals) of each bucket's set of hashes; repeated rows count once."""

    def run(frames):
        z = _points(n_points)
        for pdf in _by_bucket(frames):
            b, h = pdf.bucket.to_numpy(), pdf.h.to_numpy()
            fresh = np.append(True, (b[1:] != b[:-1]) | (h[1:] != h[:-1]))
            b, h = b[fresh], h[fresh].astype(np.uint64)
            starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            vals = np.stack([gf.product_by_group(gf.sub(np.broadcast_to(p, h.shape), h), starts) for p in z], 1).astype(np.int64)
            yield pd.DataFrame({"bucket": b[starts], "n": np.diff(np.append(starts, len(b))), "vals": list(vals)})

    return rows.select("bucket", "h").repartition(shuffle_width(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "h").mapInPandas(run, "bucket int, n int, vals array<bigint>")


def difference_polynomials(n_left: int, left: list[int], n_right: int, right: list[int]) -> tuple[list[int], list[int]] | None:
    """Coefficients, lowest first, of the two monic polynomials whose roots are the hashes of one copy only.

    The degree bound starts at the difference in size and doubles while the values don't verify the result; None if they
    run out before that.
    """
    p, n = gf.P, len(left)
    z = [int(x) for x in _points(n)]
    ratio = [a * pow(b, p - 2, p) % p for a, b in zip(left, right)]
    delta = n_left - n_right
    bound = max(abs(delta), 1)
    while True:
        bound += (bound - delta) % 2
        if bound + SPARE > n:
            return None
        up, down = (bound + delta) // 2, (bound - delta) // 2
        system = []
        for k in range(bound):
            powers = [1]
            for _ in range(max(up, down)):
                powers.append(powers[-1] * z[k] % p)
            r = ratio[k]
            system.append(powers[:up] + [-r * x % p for x in powers[:down]] + [(r * powers[down] - powers[up]) % p])
        got = gf.solve(system) if bound else []
        if got is not None:
            top, bottom = [*got[:up], 1], [*got[up:], 1]
            if all((_value(top, z[k]) - ratio[k] * _value(bottom, z[k])) % p == 0 for k in range(bound, bound + SPARE)):
                return top, bottom
        most = n - SPARE - (n - SPARE - delta) % 2
        wider = min(2 * bound + (2 * bound - delta) % 2, most)
        if wider <= bound:
            return None
        bound = wider


def _value(coefficients: list[int], x: int) -> int:
    return reduce(lambda acc, c: (acc * x + c) % gf.P, reversed(coefficients), 0)


def _solved(left: DataFrame, right: DataFrame, n_points: int) -> DataFrame:
    """(bucket, ok, left_poly, right_poly) of each bucket of either copy; a bucket that lacks on one side has the empty set's values there."""
    a = sketch(left, n_points).select("bucket", F.col("n").alias("na"), F.col("vals").alias("va"))
    b = sketch(right, n_points).select("bucket", F.col("n").alias("nb"), F.col("vals").alias("vb"))

    def run(frames):
        for pdf in frames:
            out = []
            for bucket, na, va, nb, vb in zip(pdf.bucket, pdf.na, pdf.va, pdf.nb, pdf.vb):
                got = difference_polynomials(int(na), [int(x) for x in va], int(nb), [int(x) for x in vb])
                out.append((bucket, got is not None, *(got or ([], []))))
            yield pd.DataFrame(out, columns=["bucket", "ok", "left_poly", "right_poly"])

    ones = F.array_repeat(F.lit(1).cast("bigint"), n_points)
    both = a.join(b, "bucket", "full").select("bucket", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("va", ones).alias("va"), F.coalesce("nb", F.lit(0)).alias("nb"), F.coalesce("vb", ones).alias("vb"))
    same = (F.col("na") == F.col("nb")) & (F.col("va") == F.col("vb"))
    return both.where(~same).mapInPandas(run, "bucket int, ok boolean, left_poly array<bigint>, right_poly array<bigint>")


def _roots(rows: DataFrame, polynomials: DataFrame, column: str) -> DataFrame:
    """Keys of the rows whose hash is a root of their bucket's polynomial."""

    def run(frames):
        for pdf in frames:
            polys = pdf.poly.to_list()
            length = max(map(len, polys), default=0)
            if not length:
                continue
            c = np.zeros((len(polys), length), np.uint64)
            for i, x in enumerate(polys):
                c[i, : len(x)] = x
            h, acc = pdf.h.to_numpy().astype(np.uint64), np.zeros(len(polys), np.uint64)
            for j in range(length - 1, -1, -1):
                acc = gf.add(gf.mul(acc, h), c[:, j])
            yield pdf.loc[acc == 0, ["key"]]

    kind = rows.schema["key"].dataType.simpleString()
    wanted = polynomials.where(F.size(column) > 1).select("bucket", F.col(column).alias("poly"))
    return rows.join(wanted, "bucket").select("h", "key", "poly").mapInPandas(run, f"key {kind}")


def differing_keys(left: DataFrame, right: DataFrame, rows_per_bucket: int = 32, digits: int = 2, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Distinct keys of rows that aren't the same in both copies; left and right: (key, content ...) with equal columns.

    A round sketches the buckets that are left over with four times as many values; buckets that even the largest sketch
    can't tell apart (one is mostly new) are compared by their hashes themselves, so no difference is lost. Doubles are
    hashed as rounded to `digits`: numbers that differ by more than one unit of the last of them never round alike.
    """
    n = max(sizes or (left.count(), right.count()))
    buckets = max(1, n // rows_per_bucket)
    content = [F.round(c, digits) if kind == "double" else F.col(c) for c, kind in left.dtypes if c != "key"]
    sides = [hashed(x, F.col("key"), content, buckets) for x in (left, right)]
    todo, keys = list(sides), []
    for k, n_points in enumerate(ROUNDS):
        solved = cut(_solved(*todo, n_points))
        good, bad = solved.where("ok"), solved.where("not ok").select("bucket")
        keys += [_roots(sides[0], good, "left_poly"), _roots(sides[1], good, "right_poly")]
        if not bad.take(1):
            break
        todo = [x.join(bad, "bucket", "left_semi") for x in sides]
        if k == len(ROUNDS) - 1:
            keys += [todo[i].join(todo[1 - i].select("bucket", "h"), ["bucket", "h"], "left_anti").select("key") for i in (0, 1)]
    return reduce(DataFrame.unionByName, keys).distinct()
