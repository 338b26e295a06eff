"""Numbers, codes, currencies and measures of goods lines in the reference's own rules, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency codes that may stand on a paper, and those that stand for another.
ISO = ("USD", "EUR", "CNY", "RMB", "RUB", "GBP", "TRY", "TL", "AED", "SAR", "QAR", "OMR", "KWD", "BHD", "JOD", "IQD", "DZD", "MAD", "TND", "EGP", "LBP", "INR", "JPY", "CHF", "PLN", "CZK", "HUF", "RON", "SEK", "NOK", "DKK", "AUD", "CAD", "NZD", "KRW", "SGD", "HKD", "TWD", "MYR", "THB", "VND", "IDR", "PHP", "UAH", "KZT", "BYN", "AZN", "GEL", "UZS", "PKR", "BDT")
ISO_FOR = {"RMB": "CNY", "TL": "TRY"}
# Words and signs of currencies, looked at where no code stands.
ALIASES = (("dollar|доллар|\\$", "USD"), ("euro|евро|€", "EUR"), ("yuan|юан|rmb|￥", "CNY"), ("pound|sterling|стерлинг|фунт|£", "GBP"), ("lira|lire|лир|₺", "TRY"), ("руб", "RUB"), ("franc|франк", "CHF"), ("won|вон", "KRW"), ("zloty|злот", "PLN"))
# The genitive of currencies in Russian papers.
RUSSIAN = {"USD": "долларов США", "EUR": "евро", "CNY": "юаней", "RUB": "рублей", "TRY": "турецких лир", "GBP": "фунтов стерлингов"}
_WORDS = "|".join(c.lower() for c in ISO) + "|dollars?|euros?|pounds?|sterling|yuan|yen|lira|lire|dirhams?|dinars?|riyal|rial|доллар(?:ов|а)?|евро|юан(?:ей|я)?|лир(?:а|ы)?|руб(?:лей|ля|\\.)?|\\$|€|£|¥|￥|₺|₽|₩"
_LETTER = "0-9A-Za-z_À-ɏЀ-ӿ"


def is_dotted_code(text: Column) -> Column:
    """Pairs of digits with points or spaces between them, as tariff codes are printed: 54.07.73.00."""
    return F.regexp_replace(F.trim(text), "\\s+", "").rlike("^\\d{2}(?:\\.\\d{2}){2,6}$") | F.trim(text).rlike("^\\d{2}(?:[.\\s]\\d{2}){2,6}$")


def parse_number(text: Column) -> Column:
    """DOUBLE of a number cell: US and European grouping, spaces, one currency or unit at either end; null for codes and other text.

    A lone point is a decimal sign even before three digits (77.700 is 77.7); European grouping needs a decimal comma or
    two groups; one comma alone is a decimal sign, several group.
    """
    t = F.regexp_replace(text, "[\\s\\u00a0\\u202f]+", "")
    t = F.regexp_replace(t, f"(?iu)(?:{_WORDS}|mt\\.?|m\\.?|kg|pcs|шт)$", "")
    t = F.regexp_replace(t, f"(?iu)^(?:{_WORDS})", "")
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    b = F.regexp_replace(t, "^-", "")
    commas, dots = (F.length(b) - F.length(F.replace(b, F.lit(c), F.lit(""))) for c in ",.")
    n = F.when(b.rlike("^\\d{1,3}(,\\d{3})+(\\.\\d+)?$"), F.replace(b, F.lit(","), F.lit("")))
    n = n.when(b.rlike("^\\d{1,3}(\\.\\d{3})+,\\d+$"), F.translate(b, ",.", "."))
    n = n.when(b.rlike("^\\d{1,3}(\\.\\d{3}){2,}$"), F.replace(b, F.lit("."), F.lit("")))
    n = n.when((commas == 1) & (dots == 0), F.replace(b, F.lit(","), F.lit("."))).when((commas > 1) & (dots == 0), F.replace(b, F.lit(","), F.lit(""))).otherwise(b)
    return F.when(~is_dotted_code(text) & n.rlike("^(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), sign * n.try_cast("double"))


def number_inside(text: Column) -> Column:
    """The first number inside a text: of two signs the last is decimal; a lone comma is decimal before two digits or other than three, else groups."""
    t = F.regexp_replace(F.translate(text, "¥€$ ", "    "), "\\s", " ")
    t = F.replace(F.regexp_extract(t, "-?\\d[\\d ]*([.,]\\d+)?", 0), F.lit(" "), F.lit(""))
    tail = F.regexp_extract(t, ",(\\d+)$", 1)
    n = F.when(F.length(tail) == 3, F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(t, F.lit(","), F.lit(".")))
    return F.when(t != "", n.try_cast("double"))


def code_digits(text: Column) -> Column:
    """6 to 13 digits of a tariff code in dotted, spaced, prefixed or float writing; null for money, metres and anything else."""
    t = F.trim(F.regexp_replace(F.trim(text), "(?iu)^(?:hs\\.?\\s*code|h\\.s\\.?\\s*code|customs?\\s*(?:code|tariff(?:\\s*number)?)|tn\\s*ved|тн\\s*вэд|код\\s*тн\\s*вэд)\\s*[:.\\s]*", ""))
    flat = F.regexp_replace(t, "\\s+", "")
    digits = F.when(flat.rlike("^\\d{2}(?:\\.\\d{2}){2,6}$") | t.rlike("^\\d{2}(?:[.\\s]\\d{2}){2,6}$"), F.regexp_replace(flat, "\\D", "")).when(flat.rlike("^\\d{6,13}\\.0+$"), F.split_part(flat, F.lit("."), F.lit(1))).otherwise(flat)
    return F.when(digits.rlike("^\\d{6,13}$"), digits)


def is_number_like(text: Column) -> Column:
    """A number cell with at most a currency or `mt` beside it; no dimensions, no codes, no other letters. False for null."""
    bare = F.regexp_replace(F.regexp_replace(text, f"(?iu){_WORDS}", ""), "(?i)mt\\.", "")
    ok = ~text.rlike("(?iu)^\\s*\\d+(?:[.,]\\d+)?\\s*[*x×х]\\s*\\d+(?:[.,]\\d+)?\\s*[*x×х]\\s*\\d+") & ~bare.rlike("\\p{L}")
    return F.coalesce(ok & parse_number(text).isNotNull(), F.lit(False))


def width_in_metres(text: Column) -> Column:
    """Metres of a width: mm and cm by their name, a bare figure of 20 to 500 is in centimetres; null unless positive."""
    n = parse_number(F.regexp_replace(text, "(?iu)\\s*(mm|cm|мм|см|м)\\.?$", ""))
    named = lambda u: text.rlike(f"(?iu)(^|[^{_LETTER}]|[0-9])({u})($|[^{_LETTER}])")
    out = F.when(named("mm|мм"), n / 1000).when(named("cm|см"), F.when(n > 5, n / 100).otherwise(n)).when((n >= 20) & (n <= 500), F.round(n / 100, 4)).otherwise(n)
    return F.when(n > 0, out)


def currencies(text: Column) -> Column:
    """Distinct currencies that codes in a text name, as whole words in any case; `Cad.` and the like are abbreviations, no codes."""
    word = F.regexp_extract_all(text, F.lit(f"(?iu)(?<![{_LETTER}])({'|'.join(ISO)})(?![{_LETTER}])(\\.?)"), F.lit(0))
    kept = F.filter(word, lambda w: ~w.endswith(".") | (w == F.upper(w)))
    names = F.create_map(*(F.lit(x) for kv in ISO_FOR.items() for x in kv))
    named = F.transform(kept, lambda w: F.upper(F.regexp_replace(w, "\\.$", "")))
    named = F.transform(named, lambda w: F.coalesce(names[w], w))
    return F.array_sort(F.array_distinct(named))


def currency(text: Column) -> Column:
    """The one currency of a text by code or, without any code, by word or sign; null if there are two."""
    codes = currencies(text)
    low = F.lower(text)
    words = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(c)) for p, c in ALIASES)))
    return F.when(F.size(codes) == 1, codes[0]).when((F.size(codes) == 0) & (F.size(words) == 1), words[0])


def title_currency(titles: Column, hard: tuple[str, ...] = ("USD", "EUR", "GBP", "CNY")) -> Column:
    """Currency of a sheet by its titles: the code right after a price or amount title, else the only code, else the only hard one beside TRY and RUB."""
    codes = "usd|eur|gbp|cny|rmb|try|tl|aed|sar|qar|omr|kwd|bhd|jod|iqd|jpy|chf|pln|rub"
    near = F.upper(F.regexp_extract(F.lower(titles), f"(?:price|amount|цена|сумма|fiyat|tutar|单价|金额)[^a-zа-яё]{{0,16}}({codes})(?![a-z0-9_])", 1))
    near = F.when(near == "RMB", "CNY").when(near == "TL", "TRY").otherwise(near)
    every = currencies(titles)
    strong = F.filter(every, lambda c: c.isin(*hard))
    local = F.filter(every, lambda c: c.isin("TRY", "RUB"))
    return F.when(near != "", near).when(F.size(every) == 1, every[0]).when((F.size(strong) == 1) & (F.size(local) >= 1) & (F.size(every) == F.size(local) + 1), strong[0])


def sign_currency(text: Column) -> Column:
    """CNY, EUR or USD by code or sign, looked at in this order; null without."""
    up = F.upper(text)
    return F.when(up.rlike("¥|CNY|RMB"), "CNY").when(up.rlike("€|EUR"), "EUR").when(up.rlike("USD|\\$"), "USD")


def russian_name(code: Column) -> Column:
    """Russian genitive of a currency; the code itself where it has none here."""
    names = F.create_map(*(F.lit(x) for kv in RUSSIAN.items() for x in kv))
    return F.coalesce(names[F.upper(code)], F.upper(code))


PACKAGES = "(?iu)(\\d+(?:[.,]\\d+)?)\\s*(?:plywood\\s*)?(?:cartons?|cases?|packages?|rolls?|pkgs?)"


def package_count(text: Column) -> Column:
    """Sum of all counts of cartons, cases, packages, rolls in a text; null without one."""
    found = F.regexp_extract_all(text, F.lit(PACKAGES), F.lit(1))
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + F.coalesce(number_inside(x), F.lit(0.0))))


def is_metres(unit: Column) -> Column:
    return F.coalesce(F.lower(F.trim(unit)).rlike("^(m|mt|mtr|mtrs|meters?|metres?|м|м\\.?п\\.?|пог\\.?\\s*м)\\.?$"), F.lit(False))


def is_pieces(unit: Column) -> Column:
    return F.coalesce(F.lower(F.trim(unit)).rlike("^(pcs?|pieces?|psc|sets?|pairs?|шт|компл|пар)\\.?$"), F.lit(False))


def is_close(left: Column, right: Column, absolute: float, share: float = 0.0, of: str = "left") -> Column:
    """Equal within the larger of `absolute` and `share` of the left side, the right side or the larger; two nulls are equal, one isn't."""
    base = {"left": F.abs(left), "right": F.abs(right), "larger": F.greatest(F.abs(left), F.abs(right))}[of]
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(F.abs(left - right) <= F.greatest(F.lit(absolute), base * share))


def shown(value: Column, digits: int = 2) -> Column:
    """Text of a figure as papers show it: rounded, whole numbers without decimals."""
    r = F.round(value.cast("decimal(24,8)"), digits)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(F.regexp_replace(r.cast("string"), "0+$", ""))


def repaired_amount(price: Column, qty: Column, amount: Column, area: Column, metres: Column | None = None) -> Column:
    """Price times quantity where the amount lacks, or is really the area or the quantity, or slipped by 10, 100 or a tenth; else the amount."""
    q = F.coalesce(qty, metres) if metres is not None else qty
    want = F.round((price * q).cast("decimal(24,6)"), 2).cast("double")
    ratio = amount / want
    slip = F.when(want != 0, (F.abs(ratio - 10) < 0.08) | (F.abs(ratio - 100) < 0.08) | (F.abs(ratio - 0.1) < 0.02))
    near = F.abs(amount - want) <= F.greatest(F.lit(0.05), F.abs(want) * 0.02, F.abs(amount) * 0.002)
    return F.when(want.isNull(), amount).when(amount.isNull(), want).when(near, amount).when(F.coalesce(F.when(area.isNotNull(), is_close(amount, area, 0.05, 0.002)), F.lit(False)) | is_close(amount, q, 0.05, 0.002) | F.coalesce(slip, F.lit(False)), want).otherwise(amount)


def basis(*measures: Column) -> Column:
    """The first measure that is there and not zero: what a price is for."""
    return F.coalesce(*(F.nullif(m, F.lit(0.0)) for m in measures))
