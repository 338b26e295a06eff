"""Free text of papers: hits of patterns, goods lines, labelled lines, and small repairs, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: UTF-8 read as Latin-1 shows a lead byte's letter before one of these.
MOJIBAKE = "[ÃÂÐÑØÙâ][\u0080-¿]"


def utf8_again(text: Column) -> Column:
    """Text whose UTF-8 was read as Latin-1, restored; other text as it is, also where its bytes aren't UTF-8."""
    again = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    only = F.length(F.regexp_replace(text, "[\\x{100}-\\x{10ffff}]", "")) == F.length(text)
    return F.when(only & text.rlike("[\u0080-ÿ]"), F.coalesce(again, text)).otherwise(text)


def hits(texts: DataFrame, key: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, field, value): every match of each field's pattern (its first group) in the whole text; null texts give none."""
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("values")) for f, p in patterns.items()))
    return texts.where(F.col(text).isNotNull()).select(*key, F.explode(found).alias("h")).select(*key, "h.field", F.explode("h.values").alias("value"))


def clipped(text: Column, most: int) -> Column:
    """At most `most` characters, cut at the last space if there is one."""
    t = T.plain(text)
    head = F.substring(t, 1, most + 1)
    cut = F.rtrim(F.regexp_extract(head, "^(.*) ", 1))
    return F.when(F.length(t) <= most, t).when(cut != "", cut).otherwise(F.substring(t, 1, most))


def told(error: Column, patterns: list[tuple[str, str]], other: str) -> Column:
    """A message for an error: that of the first pattern it shows, else `other`; null without an error."""
    low = F.lower(error)
    out = F.when(error.isNull(), F.lit(None).cast("string"))
    for pattern, message in patterns:
        out = out.when(low.rlike(pattern), message)
    return out.otherwise(other)


def plain_goods(lines: DataFrame, key: list[str], line: str, skip: str = "total|итого|page") -> DataFrame:
    """(key, words, numbers) of lines with a word and two numbers or more, but for those with a word to skip."""
    words, numbers = F.size(F.regexp_extract_all(line, F.lit("(\\p{L}\\p{L}+)"), F.lit(1))), F.size(F.regexp_extract_all(line, F.lit("(\\d+(?:[.,]\\d+)?)"), F.lit(1)))
    counted = lines.where(~F.lower(line).rlike(skip)).select(*key, words.cast("bigint").alias("words"), numbers.cast("bigint").alias("numbers"))
    return counted.where("words >= 1 and numbers >= 2")


def parted_goods(lines: DataFrame, key: list[str], line: str, units: str = "KGS|kg|EUR|USD") -> DataFrame:
    """(key, article, last_figure) of lines parted by slash, bar or semicolon that end in a figure with a unit."""
    end = f"(\\d[\\d.,]*)\\s*(?:{units})\\s*$"
    some = lines.where(F.col(line).rlike(f"^[^/|;]+[/;|].*\\d[\\d.,]*\\s*(?:{units})\\s*$"))
    return some.select(*key, F.trim(F.regexp_extract(line, "^([^/|;]+?)\\s*[/;|]", 1)).alias("article"), F.regexp_extract(line, end, 1).alias("last_figure"))


def labelled(lines: DataFrame, key: list[str], line: str) -> DataFrame:
    """(key, label, value) of `label: value` lines; labels are letters, points and spaces, 2 to 30 of them."""
    pattern = "^([\\p{L} .]{2,30}?)\\s*:\\s*(.+)$"
    got = lines.select(*key, F.lower(F.trim(F.regexp_extract(line, pattern, 1))).alias("label"), F.trim(F.regexp_extract(line, pattern, 2)).alias("value"))
    return got.where("label != '' and value != ''")


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def number_roles(a: Column, b: Column, c: Column, share: float = 0.08) -> Column:
    """What three numbers mean by the product that holds within the share (0.05 at least)."""
    near = lambda x, y: F.abs(x - y) <= F.greatest(F.lit(0.05), F.abs(y) * share)
    return F.when(near(a * b, c), "qty,price,amount").when(near(a * c, b), "qty,amount,price").otherwise("unclear")
