"""JSON that models and services answer with, as Catalyst expressions over text or variants."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def payload(texts: pd.Series) -> pd.Series:
    """The first JSON object or array in a text, fences and talk around it left out; null without one. Where an opening sign doesn't start JSON the search goes on."""

    decoder = json.JSONDecoder()

    def find(text: str) -> str | None:
        at = -1
        while True:
            at = min((i for i in (text.find("{", at + 1), text.find("[", at + 1)) if i >= 0), default=-1)
            if at < 0:
                return None
            try:
                return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False, separators=(",", ":"))
            except (json.JSONDecodeError, RecursionError):
                continue

    return texts.map(find, na_action="ignore")


def by_alias(data: Column, names: list[str]) -> Column:
    """The first of several keys of a JSON object that has a value, as text; keys in any case, empty texts count as lacking."""
    fields = F.transform_keys(F.from_json(data, "map<string,string>"), lambda k, v: F.lower(k))
    return F.coalesce(*(F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names))


def snapshot(fields: Column, names: list[str]) -> Column:
    """The entries of a map whose key is in `names` and whose value isn't empty."""
    return F.map_filter(fields, lambda k, v: k.isin(*names) & v.isNotNull() & (v != ""))


def kept_or_new(old: Column, new: Column, overwrite: bool = False) -> Column:
    """The old value unless it is empty, or with `overwrite` the new one unless that is."""
    a, b = F.nullif(old, F.lit("")), F.nullif(new, F.lit(""))
    return F.coalesce(b, a) if overwrite else F.coalesce(a, b)


def traced(old: Column, new: Column, suffix: str = "__alt") -> Column:
    """Two maps as one: keys of the old keep their values; where the new has another value for a key, it comes as `key__alt`."""
    fresh = F.map_filter(new, lambda k, v: ~F.map_contains_key(old, k))
    other = F.map_filter(new, lambda k, v: F.map_contains_key(old, k) & ~v.eqNullSafe(F.try_element_at(old, k)))
    return F.map_concat(old, fresh, F.transform_keys(other, lambda k, v: F.concat(k, F.lit(suffix))))


def answer_text(answer: Column) -> Column:
    """Text of a model's answer: the texts of its parts but for reasoning, joined by line breaks, else the nested message's or data's, else the error."""

    def texts(path: str) -> Column:
        parts = F.from_json(F.get_json_object(answer, path), "array<struct<type: string, text: string>>")
        kept = F.filter(parts, lambda p: ~F.coalesce(p["type"], F.lit("")).isin("reasoning", "thinking", "step-start", "step-finish") & (F.coalesce(p["text"], F.lit("")) != ""))
        return F.nullif(F.trim(F.array_join(F.transform(kept, lambda p: p["text"]), "\n")), F.lit(""))

    return F.coalesce(texts("$.parts"), F.get_json_object(answer, "$.info.error"), texts("$.message.parts"), texts("$.data.parts"))
