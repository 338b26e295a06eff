"""Units of quantities as written in trade papers, and quantity texts with them."""

from __future__ import annotations

import re

from .numbers import NUMBER

# Unit, kind, size in the kind's common unit, spellings (compared in lower case).
UNITS = (
    ("m", "length", 1.0, "m|metre|metres|meter|meters|mtr|mtrs|mt|mt.|м|м.п.|пог.м|пог. м|м.пог.|米"),
    ("mm", "length", 0.001, "mm|мм"),
    ("cm", "length", 0.01, "cm|см"),
    ("km", "length", 1000.0, "km|км"),
    ("yd", "length", 0.9144, "yd|yds|yard|yards|yard(s)|ярд|ярдов|码"),
    ("ft", "length", 0.3048, "ft|feet|foot|фут|футов"),
    ("m2", "area", 1.0, "m2|m²|sqm|sq.m|sq m|mq|м2|м²|кв.м|кв. м|qm"),
    ("cm2", "area", 0.0001, "cm2|cm²|см2|см²|кв.см"),
    ("dm2", "area", 0.01, "dm2|dm²|дм2|дм²|кв.дм"),
    ("yd2", "area", 0.83612736, "yd2|yd²|sq.yd|sq yd|sq yards|кв. ярдов"),
    ("ft2", "area", 0.09290304, "ft2|ft²|sq.ft|sqft|sq ft|кв. футов"),
    ("kg", "weight", 1.0, "kg|kgs|kg.|kilo|kilos|кг|кг."),
    ("g", "weight", 0.001, "g|gr|gram|grams|г|гр"),
    ("t", "weight", 1000.0, "t|tonne|tonnes|т|тн|тонн"),
    ("lb", "weight", 0.45359237, "lb|lbs|pound|pounds|фунтов"),
    ("centner", "weight", 100.0, "ц|центнер|центнеров"),
    ("m3", "volume", 1.0, "m3|m³|cbm|cu.m|м3|м³|куб.м|куб. м|mc"),
    ("l", "volume", 0.001, "l|ltr|litre|litres|liter|liters|л|литров"),
    ("hl", "volume", 0.1, "hl|гл"),
    ("ft3", "volume", 0.028316846592, "ft3|ft³|cu.ft|cuft|cft|куб. футов"),
    ("pcs", "count", 1.0, "pcs|pc|pcs.|piece|pieces|шт|шт.|adet|件|个|szt|szt."),
    ("dozen", "count", 12.0, "doz|doz.|dozen|dz|дюж.|дюж|дюжин"),
    ("hundred", "count", 100.0, "hundred pcs|x100 pcs|сотен шт|сотня"),
    ("gross", "count", 144.0, "gross|гросс"),
    ("thousand", "count", 1000.0, "thousand pcs|thsd pcs|k pcs|x1000 pcs|тыс. шт|тыс.шт.|тыс.шт|тыс. шт."),
)
COMMON = {"length": "m", "area": "m2", "weight": "kg", "volume": "m3", "count": "pcs"}
_SPELLINGS = {s: (u, k, f) for u, k, f, names in UNITS for s in names.split("|")}
_ANY = "(?:" + "|".join(re.escape(s) for s in sorted(_SPELLINGS, key=len, reverse=True)) + ")"


_NUMBER = re.compile(NUMBER)
_LABEL = re.compile(r"^[^\d:]*:\s*")
_PACKS = re.compile(r"^(\d+)\s*[^\W\d]+\.?\s*[x×х]\s*(?=\D*\d)")
_TWO = re.compile(rf"^({NUMBER})\s*({_ANY})\s*(?:\+|&|and|и)\s*({NUMBER})\s*({_ANY})$")
_FRONT = re.compile(rf"^({_ANY})\s*({NUMBER})$")
_BACK = re.compile(rf"^({NUMBER})\s*(.*)$")
_SPACE = re.compile(r"\s+")
_HEADING = re.compile(r"^(?:qty in |quantity / |q-ty, |[^()]*\()(.*?)$")
KIND = {u: k for u, k, _, _ in UNITS}
SIZE = {u: f for u, _, f, _ in UNITS}


def number(text: str) -> float | None:
    """A number text in any usual format: of two signs the last is decimal; exactly three last digits are a group."""
    t = _SPACE.sub("", text).replace("'", "").replace("’", "")
    sign = -1.0 if t[:1] in ("-", "−") else 1.0
    t = t.lstrip("+-−")
    at = max(t.rfind("."), t.rfind(","))
    if at >= 0:
        grouped = len(t) - at == 4 or t.count(t[at]) > 1
        head = t[:at].replace(".", "").replace(",", "")
        t = head + t[at + 1 :] if grouped else head + "." + t[at + 1 :]
    try:
        return sign * float(t)
    except ValueError:
        return None


def unit_of(spelling: str | None) -> str | None:
    """The unit that a spelling means; None if it is none."""
    got = _SPELLINGS.get(_SPACE.sub(" ", spelling).strip().lower()) if spelling else None
    return got and got[0]


def quantity(text: str | None) -> tuple[float | None, str | None]:
    """(value, unit) of a quantity text; (None, None) without a number, a unit of None where none is stated.

    Reads `12,5 m`, `m 12,5`, a label before (`QTY: 12.5 m`), packages times content (`8 rolls x 85 pcs`: 680 pcs) and two
    counts together (`3 doz + 4 pcs`: 3.333 dozen, stated in dozens).
    """
    if not text:
        return None, None
    t = _LABEL.sub("", _SPACE.sub(" ", text).strip().lower())
    factor = 1.0
    if m := _PACKS.match(t):
        factor, t = float(m[1]), t[m.end() :]
    if m := _BACK.match(t):
        unit = unit_of(m[2])
        if unit is None and (n := _TWO.match(t)):
            unit, extra = unit_of(n[2]), (number(n[3]) or 0) * SIZE[unit_of(n[4])]
            return ((number(n[1]) or 0) + extra / SIZE[unit]) * factor, unit
        value = number(m[1])
    elif m := _FRONT.match(t):
        unit, value = unit_of(m[1]), number(m[2])
    else:
        return None, None
    return (None, None) if value is None else (value * factor, unit)


def unit_in_header(heading: str | None) -> str | None:
    """The unit named in a column heading such as `Qty in m`, `Quantity / m`, `Q-ty, m` or `Qty (m)`; None if none is."""
    if not heading:
        return None
    h = _SPACE.sub(" ", heading).strip().lower()
    m = _HEADING.match(h)
    inner = m[1] if m else ""
    if inner and h.endswith(")") and "(" in h and not inner.endswith("(s)"):
        inner = inner.removesuffix(")")
    return unit_of(inner) or unit_of(inner.removesuffix(")")) or unit_of(re.split(r"[/,]| in ", h)[-1])
