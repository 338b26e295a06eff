"""Problem 3: text that looks the same brought to the same characters, on code-point arrays without per-row string calls."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that print as a Latin letter, each string pair aligned character by character.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХҮԌԚԜӀасеһіјорѕухԁԛԝӏ", "ABESIJKMHOPCTYXYGQWIacehijopsyxdqwl"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνα", "ABEZHIKMNOPTYXocjva"
ARMENIAN, ARMENIAN_AS = "ՕՏՍոսօհց", "OSUnuohg"
# Signs that print as a hyphen-minus.
HYPHENS = "‐‑‒–−﹘﹣－˗⁃"
# Characters without any print beside the format characters (Cf): fillers, selectors, joiners.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍"


@functools.lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made from Unicode's own data and the fixed values above.

    `size` and `at` give where in `flat` the canonical parts of a code point stand; `ccc` the order class of marks;
    `pair` and `whole` the sorted (base, mark) pairs and what they compose to.
    """
    top = sys.maxunicode + 1
    like = {ord(a): ord(b) for x, y in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS)) for a, b in zip(x, y, strict=True)}
    like |= {ord(c): ord("-") for c in HYPHENS}
    size, ccc = np.ones(top, np.int64), np.zeros(top, np.int16)
    parts: dict[int, list[int]] = {}
    composed: dict[tuple[int, int], int] = {}

    def plain(cp: int) -> list[int]:
        how = unicodedata.decomposition(chr(cp))
        if not how:
            return [like.get(cp, cp)]
        tag, _, rest = how.partition("> ") if how[0] == "<" else ("", "", how)
        codes = [int(x, 16) for x in rest.split()]
        if tag and (tag[1:] not in ("wide", "narrow", "noBreak", "font", "compat") or (len(codes) > 1 and codes[0] == 0x20)):
            return [like.get(cp, cp)]
        return [y for x in codes for y in plain(x)]

    for cp in range(top):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn" or kind == "Co":
            continue
        ccc[cp] = unicodedata.combining(ch)
        if kind == "Cf" or ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or (kind == "Cc" and ch not in "\t\n\r"):
            parts[cp] = []
        elif kind == "Zs" or ch in "\t\n\r  ":
            parts[cp] = [0x20] if ch not in "\t\n\r" else [cp]
        else:
            got = plain(cp)
            if got != [cp]:
                parts[cp] = got
        how = unicodedata.decomposition(ch)
        if how and how[0] != "<" and len(how.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            base, mark = (int(x, 16) for x in how.split())
            composed[base, mark] = cp
    for cp, got in parts.items():
        size[cp] = len(got)
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    flat = np.empty(int(size.sum()), np.uint32)
    flat[at[size == 1]] = np.flatnonzero(size == 1)
    for cp, got in parts.items():
        flat[at[cp] : at[cp] + len(got)] = got
    pairs = sorted((base << 21 | mark, cp) for (base, mark), cp in composed.items())
    return {"size": size, "at": at, "flat": flat, "ccc": ccc, "pair": np.array([p for p, _ in pairs], np.int64), "whole": np.array([w for _, w in pairs], np.uint32)}


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _drop(points: np.ndarray, keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def fold_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts (`offsets` as in Arrow) in their one consistent form."""
    t = tables()
    size = t["size"][points]
    out = t["flat"][np.repeat(t["at"][points], size) + _runs(size)]
    offsets = np.concatenate(([0], np.cumsum(size)))[offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ccc = t["ccc"][out]
    if (ccc > 0).any():  # marks of one base in canonical order: stable by class within the run that the base opens
        run = np.cumsum(ccc == 0)
        order = np.lexsort((ccc, run, row))
        out, ccc = out[order], ccc[order]
        while True:  # compose each base with the mark right after it, as long as any pair composes
            pair = out[:-1].astype(np.int64) << 21 | out[1:]
            k = np.minimum(np.searchsorted(t["pair"], pair), len(t["pair"]) - 1)
            hit = (t["pair"][k] == pair) & (row[1:] == row[:-1]) & (ccc[1:] > 0)
            hit[1:] &= ~hit[:-1]
            if not hit.any():
                break
            at = np.flatnonzero(hit)
            out[at] = t["whole"][k[at]]
            keep = np.ones(len(out), bool)
            keep[at + 1] = False
            out, offsets = _drop(out, keep, offsets)
            row, ccc = row[keep], ccc[keep]
    space = out == 0x20
    if space.any():  # no space at either end of a text, one between words
        same = np.concatenate(([False], row[1:] == row[:-1]))
        keep = ~(space & (~same | np.concatenate(([False], space[:-1]))))
        out, offsets = _drop(out, keep, offsets)
        row, space = row[keep], space[keep]
        last = np.concatenate((row[1:] != row[:-1], [True])) if len(row) else np.zeros(0, bool)
        out, offsets = _drop(out, ~(space & last), offsets)
    return out, offsets


def fold_array(column: pa.Array) -> pa.Array:
    """An Arrow string array in the consistent form; nulls stay null, texts of invisible characters become empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets - offsets[0]] if n else np.zeros(1, np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    out, ends = fold_points(points, starts)
    width = 1 + (out >= 0x80) + (out >= 0x800).astype(np.int64) + (out >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width)))[ends]
    text = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    valid = None if column.null_count == 0 else pa.array(np.asarray(column.is_valid())).buffers()[1]
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(text), valid).cast(pa.string())


def fold_columns(df: DataFrame, columns: list[str], suffix: str = "_folded") -> DataFrame:
    """`df` with a consistent form beside each text column. Map-only, Arrow batches, whole texts.

    Width variants, canonical and printed-alike compatibility forms, look-alike letters of other scripts, hyphens and
    spaces become one character each; characters that don't print vanish; marks are composed; outer and repeated spaces
    go. Case, accents, digits against letters and a space or none inside a text stay as they are.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(c + suffix, T.StringType()) for c in columns)])
    at = [df.columns.index(c) for c in columns]

    def run(batches):
        for batch in batches:
            folded = [fold_array(batch.column(i)) for i in at]
            yield pa.RecordBatch.from_arrays([*batch.columns, *folded], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def canonical_values(df: DataFrame, reference: DataFrame, id_col: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(id, field_name, value, canonical) for each value that looks like an entry of the reference, in its characters.

    pairs: (column of df, column of reference), compared as they are folded. The reference is a fixed table (its size
    doesn't grow with the data), so it is broadcast; `df` isn't shuffled. A value that is itself an
    entry stays as it is; of two entries that look the same the smaller counts.
    A null or an unmatched value gives no row; repeated rows give repeated rows.
    """
    folded = fold_columns(df.select(id_col, *(c for c, _ in pairs)), [c for c, _ in pairs])
    long = folded.select(id_col, F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value"), F.col(f"{c}_folded").alias("look")) for c, _ in pairs))).alias("v")).select(id_col, "v.*").where("value is not null")
    wanted = None
    for c, r in pairs:
        one = fold_columns(reference.select(F.col(r).alias("canonical")).where("canonical is not null"), ["canonical"], "_look")
        one = one.groupBy(F.col("canonical_look").alias("look")).agg(F.sort_array(F.collect_set("canonical")).alias("entries")).select(F.lit(c).alias("field_name"), "look", "entries")
        wanted = one if wanted is None else wanted.unionByName(one)
    canonical = F.when(F.array_contains("entries", F.col("value")), F.col("value")).otherwise(F.col("entries")[0])
    return long.join(F.broadcast(wanted), ["field_name", "look"]).select(id_col, "field_name", "value", canonical.alias("canonical"))
