"""Predicates over articles, file names, titles and texts of trade papers, as Catalyst expressions; null in gives false unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Words that stand in an article column without being an article.
LABEL_WORDS = "model|series|art\\.?|article|артикул|арт\\.?|item|design|code|description|qty|quantity|netto|brutto|weight|origin|brand|серия|модель"
BLANKS = "(?iu)^(?:[-–—−.…]|n/?a|n\\.\\s*a\\.?|none|null|nil|нет|б/?н|б\\.?\\s*н\\.?|без\\s*арт.*|no\\s*art.*|w/?o|tbd|xxx+|отсутств\\S*|absent|missing|not\\s+available)$"
PLACES = (" road", " street", " str.", " city", " region", " floor", " room", " building", " moscow", " village")
# Columns of the simple reader with the phrases that mean them, looked at in this order.
COLUMN_PHRASES = (
    ("packages", "q-ty packages|q/ty cases|qty cases|qty of packages|кол-во коробок|кол-во мест|quantity/package"),
    ("qty", "q-ty items|q/ty pairs|quantity(mts)|quantity (mts)|qty(m)|кол-во пар|кол-во штук|кол-во шт"),
    ("price", "unit price|price per|price for pair|цена за пару|цена за ед|цена за шт|unitprice"),
    ("amount", "total price|total amount|amount|стоимость|общая стоимость"),
    ("gross", "gross weight|total g. weight|g.w|gw|брутто"),
    ("net", "net weight|total n. weight|n.w|nw|нетто"),
    ("volume", "measurement|volume|cbm|м куб|m3"),
    ("vendor", "vendor code|cat,#|cat.#|article|артикул"),
    ("model", "model|модель"),
    ("hs", "product code|hs code|код тн|код товара|тн вэд|тнвэд"),
    ("description", "description|goods|item/description|наименование|описание"),
    ("qty", "quantity|qty|q-ty|кол-во"),
    ("price", "price|цена"),
    ("packages", "packages|package|roll|carton"),
)
# Words of the roles of a sheet.
ROLE_WORDS = {"invoice": ("commercial invoice", "invoice", "инвойс", "商业发票", "发票", "фактура"), "packing": ("packing list", "упаковочный", "装箱单", "çeki", "ceki", "seçme listesi", "packing"), "specification": ("specification", "спецификация", "规格"), "catalog": ("справочник", "сводная", "catalog", "описание", "опис", "риск")}
# Phrases of the kinds of documents with their weights.
DOCUMENT_WORDS = {
    "invoice": (("commercial invoice", 4.0), ("invoice no", 3.0), ("invoice", 2.5), ("инвойс", 3.0), ("商业发票", 4.0), ("发票", 2.2), ("счет-фактура", 3.5), ("счёт-фактура", 3.5), ("unit price", 1.5), ("amount", 0.8), ("qty", 0.5), ("quantity", 0.5), ("количество", 0.5), ("цена", 0.6), ("сумма", 0.6)),
    "packing_list": (("packing list", 4.5), ("packaging list", 4.0), ("упаковочный лист", 4.5), ("装箱单", 4.5), ("çeki listesi", 4.5), ("packing", 2.0), ("net weight", 2.0), ("gross weight", 2.0), ("нетто", 1.5), ("брутто", 1.5), ("rolls", 1.2), ("boxes", 1.0), ("cartons", 1.0), ("volume", 0.8), ("cbm", 1.0), ("weight", 0.6), ("вес", 0.8)),
    "specification": (("specification", 4.0), ("спецификация", 4.5), ("规格书", 4.0), ("规格", 2.2), ("color", 1.0), ("colour", 1.0), ("цвет", 1.2), ("composition", 1.0), ("состав", 1.0), ("width", 0.8), ("ширина", 0.8)),
    "catalog": (("catalog", 3.5), ("catalogue", 3.5), ("справочник", 4.0), ("reference", 1.5), ("tn ved", 3.0), ("тн вэд", 3.5), ("тнвэд", 3.5), ("hs code", 2.0), ("код тн", 2.5)),
    "permit": (("permit", 3.5), ("разрешение", 4.0), ("сводная", 1.2), ("valid until", 1.5), ("действует до", 1.5)),
}


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def sku_cell(text: Column) -> Column:
    """The cell if it can be an article number: no blank mark, no title word, plausible; else null."""
    t = F.trim(text)
    return F.when(~t.rlike(BLANKS) & ~is_label(t) & plausible_article(t), t)


def is_label(text: Column) -> Column:
    """Whether a cell consists of title words only."""
    return _false(F.trim(text).rlike(f"(?iu)^(?:{LABEL_WORDS})(?:[\\s,/]+(?:{LABEL_WORDS}))*\\.?$"))


def plausible_article(text: Column) -> Column:
    """At most 60 characters and six words, no title word, address, phone, total or sign that articles don't have; digits alone are four at least."""
    t = T.plain(text)
    low, flat = F.lower(t), F.regexp_replace(T.plain(text), "[\\s\\-./]", "")
    odd = low.rlike("new order|total roll|^bank|^(total|итого|mt\\. total|fca total)| total|^l\\d{6,}|artikel\\s*\\d+\\s*top|^[tf]\\.\\+?\\d") | t.rlike("[:@\\\\]") | t.rlike("\\*.*\\*") | F.replace(t, F.lit(" "), F.lit("")).contains("+90")
    place = F.lit(False)
    for p in PLACES:
        place = place | low.contains(p)
    words = F.size(F.split(t, " "))
    enough = flat.rlike("\\p{L}") | flat.rlike("^[0-9]{4,}$")
    return _false((t != "") & (F.length(t) <= 60) & (words <= 6) & ~is_label(t) & ~odd & ~place & enough)


def sane_numbers(qty: Column, rolls: Column, price: Column, amount: Column) -> Column:
    """No figure of a milliard or more, no amount of a hundred million or more; nulls are fine."""
    small = lambda c, top: F.coalesce(F.abs(c) < top, F.lit(True))
    return small(qty, 1e9) & small(rolls, 1e9) & small(price, 1e9) & small(amount, 1e8)


def is_note(text: Column) -> Column:
    """Mill notes and annotation codes instead of a name: `(15+30)`, `A`, `0605 Special Order`, `D680-1`; at most 48 characters."""
    t = T.plain(text)
    return _false((F.length(t) <= 48) & (t.rlike("(?i)^\\s*(\\([^)]{0,48}\\)|[A-Za-z]\\s*|\\d{3,6}\\s+special\\s+order)\\s*$") | t.rlike("^[A-Za-z0-9]{1,12}(?:[._/-][A-Za-z0-9]{1,12}){1,4}$")))


def any_number(*measures: Column) -> Column:
    return F.coalesce(*measures).isNotNull()


def column_of(title: Column) -> Column:
    """The simple reader's column for a title: whole short titles first, then phrases in their order; null for none."""
    t = F.lower(F.trim(F.regexp_replace(title, "\\s+", " ")))
    out = F.when(t.isin("net", "n.w", "nw", "нетто"), "net").when(t.isin("gross", "g.w", "gw", "брутто"), "gross").when(F.replace(t, F.lit(" "), F.lit("")).isin("measure", "measurement") | t.contains("cbm"), "volume")
    for name, phrases in COLUMN_PHRASES:
        hit = F.lit(False)
        for p in phrases.split("|"):
            hit = hit | t.contains(p)
        out = out.when(hit, name)
    return out


def is_stop_label(text: Column) -> Column:
    """`say total` anywhere, or a first word that means total."""
    t = F.replace(F.lower(text), F.lit("/"), F.lit(" "))
    return _false(t.contains("say total") | F.regexp_extract(t, "^([a-zа-яё]*)", 1).isin("total", "итого", "всего"))


def is_freight(text: Column) -> Column:
    t = F.lower(text)
    return _false(t.contains("freight") | t.contains("перевоз"))


def paper_role(name: Column, head: Column) -> Column:
    """Role of a paper by its name and first lines, looked at in order; unknown for none."""
    t = F.upper(F.concat_ws("\n", name, head))
    has = lambda *w: F.coalesce(t.rlike("|".join(w)), F.lit(False))
    return F.when(has("ПРИЛОЖЕНИЕ К ИНВОЙСУ") | (F.upper(name) == "ГТД"), "customs_appendix").when(has("ЧЕРНОВИК"), "draft").when(has("ФОРМА ДЛЯ ГТД"), "gtd_form").when(has("PACKING LIST", "УПАКОВОЧНЫЙ"), "packing").when(has("СПЕЦИФИКАЦ", "SPECIFICATION"), "specification").when(has("INVOICE", "СЧЕТ-ФАКТУРА", "ИНВОЙС"), "invoice").otherwise("unknown")


def role_by_words(text: Column, priced: Column, weighed: Column, coded: Column, counted: Column) -> Column:
    """Role of a sheet by how often its words come, the most by one at least; else by which columns it has."""
    low = F.lower(text)
    times = lambda w: F.size(F.split(low, "\\Q" + w + "\\E", -1)) - 1
    score = {r: sum((times(w) for w in words), F.lit(0)) for r, words in ROLE_WORDS.items()}
    top = F.array_sort(F.array(*score.values()))
    best, second = F.element_at(top, -1), F.element_at(top, -2)
    winner = F.coalesce(*(F.when(s == best, F.lit(r)) for r, s in score.items()))
    won = (best >= 1) & (best > second)
    structure = F.when(priced & weighed, "mixed").when(priced, "invoice").when(weighed, "packing").when(coded & ~counted, "catalog").otherwise("goods")
    return F.when((score["catalog"] > 0) & coded & ~counted, "catalog").when(won & (winner == "packing") & priced & low.contains("invoice"), "mixed").when(won, winner).otherwise(structure)


def document_scores(low: Column) -> dict[str, Column]:
    """Score of each kind of document by its plain text in lower case: every phrase counts five times at most, plain ASCII words as whole words only.

    Give the scores columns of their own before they are compared, or each phrase is counted again for every comparison.
    """
    out = {}
    for kind, words in DOCUMENT_WORDS.items():
        parts = [F.least(F.regexp_count(low, F.lit("\\Q" + w + "\\E" if " " in w or not w.isascii() else f"(?<![\\p{{L}}\\p{{N}}_])\\Q{w}\\E(?![\\p{{L}}\\p{{N}}_])")), F.lit(5)) * weight for w, weight in words]
        out[kind] = F.round(sum(parts[1:], parts[0]), 6)
    return out


def best_kind(scores: dict[str, Column], least: float = 2.5, ahead: float = 0.8) -> Column:
    """The kind with the highest score if that is `least` and `ahead` of the next; null otherwise, never a guess."""
    top = F.array_sort(F.array(*scores.values()))
    best, second = F.element_at(top, -1), F.element_at(top, -2)
    return F.when((best >= least) & (F.round(best - second, 6) >= ahead), F.coalesce(*(F.when(s == best, F.lit(k)) for k, s in scores.items())))


def file_role(name: Column) -> Column:
    """Role that a file's name hints at; null for none."""
    up = F.upper(name)
    stem = F.regexp_replace(up, "\\.[^.]*$", "")
    return F.when(up.rlike("INVOICE|ИНВОЙС") | stem.rlike("[_ -]CI$"), "invoice").when(up.rlike("-PL|_PL\\.|PACKING|ПАКИНГ|УПАКОВ|PL\\.(XLSX|PDF)$") | stem.rlike("[_-]PL$"), "packing").when(up.rlike("SPEC|СПЕЦИФ"), "specification")


def kit_tokens(names: Column) -> Column:
    """Distinct kit tokens such as 626-1 in a text of file names."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(names, F.lit("(?<![\\p{L}\\p{N}_])(\\d{2,4}-\\d)(?![\\p{L}\\p{N}_])"), F.lit(1)), lambda x: F.lower(x))))


def job_numbers(names: Column, start: str = "18") -> Column:
    """Distinct five-digit job numbers that begin with `start`."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(names, F.lit(f"(?<![\\p{{L}}\\p{{N}}_])({start}\\d{{3}})(?![\\p{{L}}\\p{{N}}_])"), F.lit(1))))


def parse_status(error: Column, warnings: Column) -> Column:
    """skipped for a broken file, review for one with warnings, else ok."""
    return F.when(F.coalesce(error, F.lit("")) != "", "skipped").when(F.coalesce(warnings, F.lit(0)) > 0, "review").otherwise("ok")


def is_fragment(article: Column, description: Column) -> Column:
    """Whether an article cell is a torn-off piece of the description: four characters or more without Latin letters and digits, well shorter."""
    a, d = F.lower(F.trim(article)), F.lower(F.trim(description))
    return _false((F.length(a) >= 4) & (a != d) & ~a.rlike("[a-z0-9]") & d.contains(a) & (F.length(a) < F.length(d) * 0.75))


def peeled(description: Column) -> Column:
    """struct(article, color, rest) of a description that begins with an article and maybe a colour number; null otherwise."""
    p = "^([A-Za-z][A-Za-z0-9][A-Za-z0-9._/-]{1,24})(?:[ \\t]+(\\d{2,4}))?[ \\t]+(\\S.{12,})$"
    t = F.trim(description)
    g = lambda i: F.regexp_extract(t, p, i)
    return F.when(t.rlike(p) & g(3).rlike("[A-Za-zА-Яа-яЁё]{4,}") & plausible_article(g(1)), F.struct(g(1).alias("article"), F.nullif(g(2), F.lit("")).alias("color"), F.trim(g(3)).alias("rest")))


def is_role_only(text: Column) -> Column:
    """A party's role instead of its name."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, "[:：].*$", ""), "\\s+", " "))
    return _false(t.rlike("(?iu)^(?:the\\s+)?(?:buyer|seller|recipient|consignee|shipper|exporter|manufacturer|delivery(?:\\s+basis)?|address|add|покупатель|продавец|получатель|производитель)$"))
