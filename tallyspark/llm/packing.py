"""Problem 7: documents of varying length into containers of fixed capacity, neighbours on a space-filling curve together."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import bpe

DIMS, BITS = 3, 10


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer coordinates in [0, 2**bits), for all rows at once.

    Gray-code transposition from the highest bit down: at each bit plane a coordinate's bit says whether the first
    coordinate is inverted below it or swapped with it.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fold = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fold = np.where((x[-1] & q) != 0, fold ^ (q - 1), fold)
        q >>= 1
    x ^= fold
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _plane(buckets: int) -> np.ndarray:
    """A fixed projection of `buckets` counts to DIMS numbers, the same on every worker."""
    return np.random.default_rng(7).standard_normal((buckets, DIMS))


def size_and_place(docs: DataFrame, capacity: int, path: str, id_col: str, text_col: str, buckets: int = 64) -> DataFrame:
    """One narrow row for each part of a document: (id, part, token_start, n_tokens, curve).

    A text of more than `capacity` tokens gives parts of `capacity` and a rest; an empty or null one a part of 0 tokens.
    `curve` is the Hilbert index of the signed, hashed token counts, projected to three dimensions.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames):
        coder, plane = bpe.load(path), _plane(buckets)
        for pdf in frames:
            ids, part, start, size, vecs = [], [], [], [], []
            for doc, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                tokens = np.asarray(coder.encode(text), np.int64)
                mixed = tokens * 0x9E3779B1 >> 7
                vec = np.bincount(mixed % buckets, np.where(mixed >> 20 & 1, 1.0, -1.0), buckets) if len(tokens) else np.zeros(buckets)
                for k in range(max(1, -(-len(tokens) // capacity))):
                    ids.append(doc)
                    part.append(k)
                    start.append(k * capacity)
                    size.append(min(capacity, len(tokens) - k * capacity))
                    vecs.append(vec)
            if not ids:
                continue
            m = np.asarray(vecs)
            flat = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9) @ plane
            cells = np.clip((np.tanh(flat / 1.5) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pd.DataFrame({id_col: ids, "part_no": part, "token_start": start, "n_tokens": size, "curve": hilbert_key(cells)})

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, part_no int, token_start int, n_tokens int, curve bigint")


def fill(stream, capacity: int, window: int):
    """Containers from (size, payload) in curve order, as lists of payloads; `window` items wait at most, topped up as they go in.

    Each container starts with the item that waits longest and takes, again and again, the largest waiting item that
    fits; if two smaller ones together fill the room better than that item, they go in instead.
    """
    order: dict[int, tuple] = {}  # waiting items by arrival, with their sizes
    sizes: list[tuple[int, int]] = []  # (size, arrival), sorted
    arrivals = 0
    stream = iter(stream)
    ended = False

    def take(at: int):
        size, arrival = sizes.pop(at)
        return size, order.pop(arrival)[1]

    def top_up():
        nonlocal ended, arrivals
        while not ended and len(sizes) < window:
            got = next(stream, None)
            if got is None:
                ended = True
            else:
                order[arrivals] = got
                bisect.insort(sizes, (got[0], arrivals))
                arrivals += 1

    while True:
        top_up()
        if not sizes:
            return
        first = next(iter(order))
        size, payload = take(bisect.bisect_left(sizes, (order[first][0], first)))
        box, room = [payload], capacity - size
        while True:
            top_up()
            at = bisect.bisect_right(sizes, (room, 1 << 62)) - 1
            if at < 0:
                break
            gap = room - sizes[at][0]
            if gap and at > 0:
                lo, hi, best = 0, at, gap
                pair = None
                while lo < hi:
                    total = sizes[lo][0] + sizes[hi][0]
                    if total > room:
                        hi -= 1
                    else:
                        if room - total < best:
                            best, pair = room - total, (lo, hi)
                            if not best:
                                break
                        lo += 1
                if pair:
                    for k in (pair[1], pair[0]):
                        size, payload = take(k)
                        room -= size
                        box.append(payload)
                    continue
            size, payload = take(at)
            room -= size
            box.append(payload)
        yield box


def pack_corpus(docs: DataFrame, capacity: int = 2048, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = 24, run_items: int = 20000) -> DataFrame:
    """(id, part_no, token_start, n_tokens, container_id) for every document; parts of one container sum to `capacity` at most.

    Only a text of more than `capacity` tokens is split. Null and empty texts take no room: part 0 of 0 tokens with a null
    container. Repeated ids are packed as often as they come. An empty table gives an empty result.
    The narrow rows are checkpointed once, range-sorted by curve with the id's hash as the tie-break (so that a group of
    equal texts, however large, spreads over ranges) and packed range by range in a stream with `window` waiting items: a
    wider window fills a little better and takes a container's items from further apart. Each range holds about
    `run_items` parts, at any size of the corpus and in any session; its last container is the only one that may stay
    rather empty. container_id: range number and count within it.
    """
    parts = cut(size_and_place(docs, capacity, path or bpe.default_path(), id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = max(1, -(-parts.count() // run_items))
    kept = parts.where("n_tokens > 0").withColumn("tie", F.xxhash64(id_col, "part_no"))
    ordered = kept.repartitionByRange(ranges, "curve", "tie").sortWithinPartitions("curve", "tie", id_col).drop("tie").withColumn("range_no", F.spark_partition_id())
    schema = f"`{id_col}` {kind}, part_no int, token_start int, n_tokens int, container_id bigint"

    def run(frames):
        range_no = 0

        def items():
            nonlocal range_no
            for pdf in frames:
                if len(pdf):
                    range_no = int(pdf.range_no.iloc[0])
                for row in zip(pdf[id_col], pdf.part_no, pdf.token_start, pdf.n_tokens):
                    yield int(row[3]), row

        rows: list[tuple] = []
        for k, box in enumerate(fill(items(), capacity, window)):
            rows += [(*row, range_no << 40 | k) for row in box]
            if len(rows) > 20000:
                yield pd.DataFrame(rows, columns=[id_col, "part_no", "token_start", "n_tokens", "container_id"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[id_col, "part_no", "token_start", "n_tokens", "container_id"])

    empty = parts.where("n_tokens = 0").select(id_col, "part_no", "token_start", "n_tokens", F.lit(None).cast("bigint").alias("container_id"))
    return ordered.mapInPandas(run, schema).unionByName(empty)
