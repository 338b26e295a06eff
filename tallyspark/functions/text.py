"""Texts of trade papers as Catalyst expressions: cleaning, splitting, keys, scripts; null in gives null out unless said."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Words before a design's name that only say what kind of goods it is.
GROUPING_WORDS = ("sofa fabric", "artificial leather", "genuine leather", "pu leather")
# Scripts and the characters that show them.
SCRIPTS = {"cyrillic": "[А-Яа-яЁёІіЇїЄєҐґ]", "cjk": "[㐀-鿿豈-﫿぀-ヿ]", "arabic": "[؀-ۿ]", "hangul": "[가-힯]", "latin": "[A-Za-z]"}
TURKISH = "[İıŞşĞğÇçÖöÜü]"
CYRILLIC = "[А-Яа-яЁё]"


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for which Catalyst has no function; one Arrow pass at intake."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def plain(text: Column) -> Column:
    """Control characters deleted, white space collapsed and trimmed; a line break glues its neighbours, as it is one of them."""
    gone = F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", "")
    return F.trim(F.regexp_replace(gone, "[\\s\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000]+", " "))


def split_design(text: Column) -> Column:
    """struct(category, sku): first and last of several lines, or what stands before and after the last ` / `, else ("", text)."""
    raw = F.trim(text)
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    left, right = F.trim(F.regexp_extract(raw, "(?s)^(.*) / (.*)$", 1)), F.trim(F.regexp_extract(raw, "(?s)^(.*) / (.*)$", 2))
    pair = lambda a, b: F.struct(a.alias("category"), b.alias("sku"))
    return F.when(F.size(lines) >= 2, pair(lines[0], F.element_at(lines, -1))).when((left != "") & (F.length(right) >= 2), pair(left, right)).when(text.isNotNull(), pair(F.lit(""), raw))


def without_grouping(article: Column, words: Sequence[str] = GROUPING_WORDS) -> Column:
    """The design's name without leading words such as `sofa fabric`, in any case and with or without a space in them."""
    pattern = "|".join(w.replace(" ", "\\s*") for w in words)
    return F.trim(F.regexp_replace(plain(article), f"(?iu)^({pattern})\\s*", ""))


def family_label(article: Column, words: Sequence[str] = GROUPING_WORDS) -> Column:
    """The sku after a category, else the article without grouping words."""
    parts = split_design(article)
    return F.when(parts["category"] != "", parts["sku"]).otherwise(without_grouping(article, words))


def with_color(article: Column, color: Column) -> Column:
    """`article color`, the colour only once: not where the article already ends with it or has it as a word."""
    there = F.concat(F.lit(" "), F.upper(article), F.lit(" ")).contains(F.concat(F.lit(" "), F.upper(F.trim(color)), F.lit(" ")))
    return F.when(F.coalesce(F.trim(color), F.lit("")) == "", article).when(there, article).otherwise(F.concat_ws(" ", article, F.trim(color)))


def bilingual(text: Column) -> Column:
    """struct(en, ru) of a text in two languages parted by `//`, ` / ` or `/`; the Cyrillic side is ru, a single side goes where its letters say."""
    cut = F.when(text.contains("//"), F.lit("//")).when(text.contains(" / "), F.lit(" / ")).when(text.contains("/"), F.lit("/"))
    at = F.when(text.contains("//"), F.locate("//", text)).when(text.contains(" / "), F.locate(" / ", text)).otherwise(F.locate("/", text))
    a, b = F.trim(F.substr(text, F.lit(1), at - 1)), F.trim(F.substr(text, at + F.length(cut)))
    swap = a.rlike(CYRILLIC) & ~b.rlike(CYRILLIC)
    some = lambda x: F.when(x != "", x)
    en, ru = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    one = F.trim(text)
    return F.struct(F.when(cut.isNotNull(), some(en)).when(~one.rlike(CYRILLIC), some(one)).alias("en"), F.when(cut.isNotNull(), some(ru)).when(one.rlike(CYRILLIC), some(one)).alias("ru"))


def joined(en: Column, ru: Column) -> Column:
    """`en / ru`, one of them if the other lacks or says the same; null without both."""
    e, r = (F.when(F.trim(x) != "", F.trim(x)) for x in (en, ru))
    out = F.when(F.lower(e) == F.lower(r), e).otherwise(F.concat_ws(" / ", e, r))
    return F.when(out != "", out)


def unspaced(text: Column, least: int = 4) -> Column:
    """Runs of `least` or more single characters parted by spaces are drawn together: `C I 2 4` gives `CI24`; other words stay."""
    words = F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != "")
    done = lambda acc: F.when(F.size(acc["run"]) >= least, F.concat(acc["out"], F.array(F.array_join(acc["run"], "")))).otherwise(F.concat(acc["out"], acc["run"]))
    none = F.array().cast("array<string>")
    step = lambda acc, w: F.when(F.length(w) == 1, F.struct(acc["out"].alias("out"), F.concat(acc["run"], F.array(w)).alias("run"))).otherwise(F.struct(F.concat(done(acc), F.array(w)).alias("out"), none.alias("run")))
    return F.array_join(F.aggregate(words, F.struct(none.alias("out"), none.alias("run")), step, done), " ")


def loose_key(text: Column, signs: str = "\"“”'.,") -> Column:
    """Comparison key of names: lower case, no white space and none of `signs`."""
    return F.lower(F.regexp_replace(plain(text), "[\\s" + "".join("\\" + c if c in "]\\^-" else c for c in signs) + "]", ""))


def address_key(text: Column) -> Column:
    return loose_key(text, ",.;:\"'“”«»/\\-")


def scripts(text: Column) -> Column:
    """Names of the scripts that a text has, in fixed order; Turkish letters count as Latin."""
    tests = {k: text.rlike(p) for k, p in SCRIPTS.items()}
    tests["latin"] = tests["latin"] | text.rlike(TURKISH)
    return F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))


def file_stem(title: Column, most: int = 80, empty: str = "shipment") -> Column:
    """A title as a file name: signs that paths can't have become `_`, spaces collapse, at most `most` characters."""
    safe = F.trim(F.regexp_replace(F.regexp_replace(title, "[<>:\"/\\\\|?*\\x00-\\x1f]+", "_"), "\\s+", " "))
    safe = F.regexp_replace(F.substring(safe, 1, most), "[. ]+$", "")
    return F.when(safe != "", safe).otherwise(F.lit(empty))


def numbered(text: Column) -> Column:
    """An invoice or contract number as printed: without a label before and signs around; null without a digit."""
    bare = F.regexp_replace(F.trim(text), "(?iu)^(?:invoice|inv|инвойс|счет|contract|контракт|договор)?\\s*(?:no\\.?|nr\\.?|№|n°|#)?\\s*[:.]?\\s*", "")
    token = F.regexp_extract(bare, "^([0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё./_-]*)", 1)
    token = F.regexp_replace(token, "[./_-]+$", "")
    return F.when(token.rlike("[0-9]"), token)


def subkit(text: Column) -> Column:
    """The first token such as `626-1` (two to four digits, hyphen, one digit) that isn't part of a longer number; null without."""
    hit = F.regexp_extract(text, "(?:^|[^0-9-])([0-9]{2,4}-[0-9])(?![0-9-])", 1)
    return F.when(hit != "", hit)


def design_label(group: Column, article: Column) -> Column:
    """Category above the family's first word: `category⏎FAMILY`, the family alone without a category; notes in brackets go."""
    bare = F.trim(F.regexp_replace(article, "\\s*\\([^)]*\\)", ""))
    family = F.split_part(bare, F.lit(" "), F.lit(1))
    return F.when(F.coalesce(F.trim(group), F.lit("")) == "", family).otherwise(F.concat_ws("\n", F.trim(group), family))
