"""From a sheet's cells to typed goods rows: which column means what, where the titles stand, which rows are goods.

A sheet is bounded by what a paper holds, so its cells come together as one array and the sequential rules run over it in
Python; sheets are spread over tasks. Everything that follows works on the typed rows with built-in operators.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grids as G

# Fields, and fragments of titles that mean them with their weight; `=` marks a title as a whole.
SYNONYMS = {
    "article": "art./артикул 9|art no 8|art. no 8|артикул 9|articolo 8|stok kodu 8|item no 7|item code 7|货号 9|design 4|model 4|модель 4|sku 6|art 3|арт 3|item 3|series / art 9|customer name 8",
    "color": "colour 8|цвет 8|color 8|renk 8|colore 8",
    "description": "наименование 7|description 6|описание 6|mal cinsi 8|品名 8|goods 4|product name 8|remarks 2",
    "hs_code": "hs code 9|h.s. code 9|h.s code 9|код hs 9|hs 3",
    "customs_code": "customs code 9|таможенный код 10|тн вэд 8|тнвэд 8",
    "qty": "quantity 6|qty 6|кол-во 5|количество 5|hides 8|pcs 5|miktar 6|adet 5|数量 7",
    "unit": "единица измерения 9|ед. изм 9|ед.изм 9|uom 7|unit 4|birim 6",
    "price": "unit price 9|unit pice 10|price per 8|euro/m2 9|birim fiyat 9|单价 8|price 4|цена 4|fiyat 5",
    "amount": "total price 9|amount 7|сумма 7|стоимость 5|tutar 7|金额 8|total amount 9",
    "currency": "currency 8|валюта 8|döviz 7",
    "rolls": "rolls 8|roll 6|packages 7|pallet 7|мест 6|рулон 8|top adet 8",
    "boxes": "cartons 8|boxes 8|короб 7|ctns 8",
    "meters": "amount (m) 10|metres 8|meters 8|metrs 8|метр 7|metraj 8|米数 8|qty (m) 9",
    "width": "width 8|ширина 8|en, 6|genişlik 8",
    "area": "total m2 9|m2 7|площадь 9|кв.м 7|sqm 8",
    "net_weight": "net weight 9|=net 7|net wt 8|nett 7|netto 8|нетто 9|n.w 8|net kg 9|=kg 6|=кг 6",
    "gross_weight": "gross weight 9|gross 7|brutto 8|брутто 9|g.w 8",
    "volume": "volume 8|cbm 8|объем 8|m3 7",
    "measurement": "measurement 8|dimension 8|габарит 8|размер места 8",
    "pcs_per_carton": "qty/ctn 10|pcs/ctn 10|pcs per carton 10",
    "manufacturer": "manufacturer 8|производитель 8|brand 5|фирма 5",
    "country": "country 8|origin 7|страна 8",
}
NUMERIC = frozenset(("qty", "price", "amount", "rolls", "boxes", "meters", "width", "area", "net_weight", "gross_weight", "volume", "pcs_per_carton"))
CODES = frozenset(("hs_code", "customs_code"))
MEASURES = ("qty", "amount", "meters", "area", "net_weight", "gross_weight", "volume", "boxes", "rolls")
COMMERCIAL = frozenset(("qty", "price", "amount", "unit", "meters", "currency"))
_IGNORED = frozenset(("no", "№", "no.", "n", "nr", "n°", "sıra", "序号", "п/п", "№ п/п"))
_SERIAL = regex.compile(r"(?i)(roll\s*n|sack\s*n|batch|sip\s*,?\s*n|barcode|serial)")
_DIMENSION = regex.compile(r"(?i)^\s*\d+(?:[.,]\d+)?\s*[*x×х]\s*\d+(?:[.,]\d+)?\s*[*x×х]\s*\d+")
_CODE = regex.compile(r"\d{2}(?:[.\s]\d{2}){2,6}|\d{6,13}(?:\.0+)?")
_UNIT = regex.compile(r"(?i)^(usd|eur|cny|rmb|rub|gbp|try|tl|pln|\$|€|£|¥|₺|₽)|(usd|eur|cny|rmb|rub|gbp|try|tl|pln|\$|€|£|¥|₺|₽|mt\.?|m\.?|kg|pcs|шт)$")
_TOTAL, _DETAIL, _SECTION, _SUBTOTAL, _LETTERHEAD, _PAGE = (regex.compile(p) for p in (G.TOTAL, G.DETAIL, G.SECTION, G.SUBTOTAL, G.LETTERHEAD, G.PAGE_MARK))
_COMPONENT = regex.compile(r"(?i)pallet|qty\s*/\s*ctn")
_BLANK = regex.compile(r"(?i)^(?:[-–—−.…]+|n/?a|none|null|nil|нет|б/?н|без\s*арт.*|no\s*art.*|w/?o|tbd|xxx+|отсутств\w*|absent|missing)$")
_LABEL = regex.compile(r"(?i)^(?:model|series|art\.?|article|артикул|арт\.?|item|design|code|description|qty|quantity|netto|brutto|weight|origin|brand|manufacturer|серия|модель|наименован\w*|фирма)$")
_WORDS = {f: [(t.rsplit(" ", 1)[0], float(t.rsplit(" ", 1)[1])) for t in s.split("|")] for f, s in SYNONYMS.items()}


@lru_cache(1 << 16)
def number(value: str | None) -> float | None:
    """The figure of a cell: US or European grouping, a currency or unit at either end; None for codes, dimensions and other text."""
    if value is None:
        return None
    t = regex.sub(r"\s+", "", value)
    if not t or regex.fullmatch(r"\d{2}(?:\.\d{2}){2,6}", t):
        return None
    for _ in range(2):
        t = _UNIT.sub("", t)
    sign, t = (-1.0, t[1:]) if t.startswith("-") else (1.0, t)
    if regex.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", t):
        t = t.replace(",", "")
    elif regex.fullmatch(r"\d{1,3}(\.\d{3})+,\d+", t):
        t = t.replace(".", "").replace(",", ".")
    elif regex.fullmatch(r"\d{1,3}(\.\d{3}){2,}", t):
        t = t.replace(".", "")
    elif "." not in t:
        t = t.replace(",", "." if t.count(",") == 1 else "")
    return sign * float(t) if regex.fullmatch(r"\d+\.?\d*|\.\d+", t) else None


@lru_cache(1 << 16)
def code(value: str | None) -> str | None:
    """6 to 13 digits of a tariff code cell."""
    t = (value or "").strip()
    if not _CODE.fullmatch(t):
        return None
    digits = regex.sub(r"\D", "", regex.sub(r"^(\d{6,13})\.0+$", r"\1", t))
    return digits if 6 <= len(digits) <= 13 else None


@lru_cache(1 << 16)
def title_score(field: str, title: str) -> float:
    """Weight of the best fragment of a field in a title, two more if it is the title."""
    flat, best = title.replace(" ", ""), 0.0
    for token, weight in _WORDS[field]:
        bare = token.lstrip("=")
        whole = title == bare or flat == bare.replace(" ", "")
        if whole:
            best = max(best, weight + 2)
        elif not token.startswith("=") and (bare in title or bare.replace(" ", "") in flat):
            best = max(best, weight)
    return best


def _share(values: list[str], test) -> float:
    return sum(1 for v in values if test(v)) / len(values) if values else 0.0


def classify_columns(titles: list[str], columns: list[list[str]]) -> dict[int, str]:
    """Column to field, each at most once: title fragments, the values' own kind, then greedily from the surest pair down."""
    facts = []
    for title, values in zip(titles, columns):
        values = [v for v in values if v and v.strip()]
        figures = [abs(x) for x in map(number, values) if x is not None]
        facts.append({
            "title": " ".join(unicodedata.normalize("NFKC", title or "").lower().split()),
            "numeric": _share(values, lambda v: number(v) is not None and code(v) is None or number(v) is not None and len(v) < 6),
            "dimension": _share(values, _DIMENSION.match),
            "code": _share(values, code),
            "text": _share(values, lambda v: number(v) is None and code(v) is None),
            "short": _share(values, lambda v: len(v) <= 18 and " " not in v.strip()),
            "largest": max(figures, default=0.0),
            "any": bool(values),
        })
    scored = []
    for i, c in enumerate(facts):
        if c["title"] in _IGNORED:
            continue
        serial, base = bool(_SERIAL.search(c["title"])), {}
        for field in SYNONYMS:
            odd = serial and (field in CODES or field in ("rolls", "qty", "boxes") and (c["code"] >= 0.4 or c["largest"] >= 1e5))
            if odd or field == "amount" and title_score("meters", c["title"]) >= 9:
                continue
            s = title_score(field, c["title"])
            if s > 0:
                base[field] = s
        if not base and c["dimension"] >= 0.5:
            base["measurement"] = 4.0
        elif not base and c["code"] >= 0.6 and not serial:
            base["customs_code"] = 2.0
        for field, s in base.items():
            if field in NUMERIC:
                s += 1.5 * c["numeric"] - (3.0 if c["numeric"] < 0.3 else 0.0)
            s += 4.0 * c["dimension"] if field == "measurement" else 2.0 * c["code"] if field in CODES else 2.0 * c["text"] if field == "article" else 0.0
            s += 1.0 if field == "price" and 0 < c["largest"] < 500 else 0.3 if field == "area" and c["numeric"] else 1.0 if field == "color" and c["numeric"] >= 0.7 and c["largest"] < 1e4 else 0.0
            s -= 6.0 if field == "description" and c["any"] and c["short"] >= 0.6 else 0.0
            scored.append((s, field, i))
    out: dict[int, str] = {}
    for _, field, i in sorted(scored, reverse=True):
        if i not in out and field not in out.values():
            out[i] = field
    _beside_article(facts, out)
    return out


def _beside_article(facts: list[dict], out: dict[int, str]) -> None:
    """Two article columns part into text and colour numbers; an untitled column right of the article with small numbers is the colour."""
    at = next((i for i, f in out.items() if f == "article"), None)
    if at is None or "color" in out.values():
        return
    twins = [i for i, c in enumerate(facts) if i != at and i not in out and c["title"] and c["title"] == facts[at]["title"]]
    if twins:
        i = twins[0]
        if facts[at]["numeric"] >= 0.7 > facts[i]["numeric"]:
            out[i], out[at] = "article", "color"
        elif facts[i]["numeric"] >= 0.7:
            out[i] = "color"
    elif at + 1 < len(facts) and at + 1 not in out and not facts[at + 1]["title"] and facts[at + 1]["numeric"] >= 0.7 and facts[at + 1]["largest"] < 1e4:
        out[at + 1] = "color"


def mapping_score(fields: Iterable[str]) -> int:
    f = set(fields)
    return 2 * bool(f & {"article", "description"}) + len(f & {"qty", "meters", "area", "rolls"}) + len(f & {"price", "amount"}) + len(f & {"net_weight", "gross_weight"}) + len(f & CODES)


def is_noise(cells: list[str]) -> bool:
    """Page marks, letterhead, totals, one repeated short number, sections and prose; no sample for columns and no goods."""
    texts = [c.strip() for c in cells if c and c.strip()]
    joined = " ".join(texts)
    if not texts or _PAGE.match(joined) or _LETTERHEAD.search(joined) or _TOTAL.match(joined) or _DETAIL.search(joined) or _SECTION.match(joined):
        return True
    alone = {t.replace(" ", "") for t in texts}
    if len(alone) == 1 and (regex.fullmatch(r"\d{1,5}", next(iter(alone))) or _LABEL.match(next(iter(alone)))):
        return True
    codes = any(map(code, texts))
    words = sum(1 for t in texts if regex.search(r"\p{L}", t) and number(t) is None)
    return words >= 3 and sum(1 for t in texts if number(t) is not None and not code(t)) <= 1 and not (codes and words >= 2)


def is_second_title(cells: list[str]) -> bool:
    """A translated or stacked title row below the titles: three words or more, next to no numbers, known fragments."""
    texts = [c.strip().lower() for c in cells if c and c.strip()]
    words = sum(1 for t in texts if regex.search(r"\p{L}", t))
    if len(texts) < 3 or words < 3 or sum(1 for t in texts if number(t) is not None) >= 2:
        return False
    return sum(1 for t in texts if any(title_score(f, t) >= 4 for f in SYNONYMS)) >= max(2, len(texts) // 2)


def find_header(grid: list[list[str]], depth: int = 25, ahead: int = 12, sample: int = 20) -> tuple[int, int, dict[int, str]] | None:
    """(first row below the titles, title row, mapping): of the first `depth` rows the one with most goods below, best mapping, first."""
    best = None
    for r in range(min(depth, len(grid))):
        titles = [c or "" for c in grid[r]]
        low = {" ".join(t.lower().split()) for t in titles if regex.search(r"\p{L}", t)}
        if sum(1 for t in low if any(title_score(f, t) > 0 for f in SYNONYMS)) < 2:
            continue
        start = r + 1
        if start < len(grid) and is_second_title(grid[start]):
            low = [c or "" for c in grid[start]]
            titles = [a if not b or b.lower() in a.lower() else f"{a} {b}".strip() for a, b in zip(titles, low + [""] * len(titles))]
            start += 1
        body = [row for row in grid[start : start + 3 * sample] if not is_noise(row)][:sample]
        mapping = classify_columns(titles, [[row[c] if c < len(row) else "" for row in body] for c in range(len(titles))])
        score = mapping_score(mapping.values())
        if score >= 3:
            goods = sum(1 for row in body[:ahead] if any(number(row[c]) is not None for c, f in mapping.items() if f in NUMERIC and c < len(row)))
            if best is None or (-goods, -score, r) < best[0]:
                best = ((-goods, -score, r), start, r, mapping)
    return best and best[1:]


def plausible_article(text: str) -> bool:
    t = " ".join(text.split())
    if not t or len(t) > 60 or len(t.split()) > 6 or _LABEL.match(t) or _BLANK.match(t) or _TOTAL.match(t) or any(c in t for c in ":@\\") or t.count("*") >= 2:
        return False
    flat = regex.sub(r"[\s\-./]", "", t)
    return bool(regex.search(r"\p{L}", flat)) or flat.isdigit() and len(flat) >= 4


def _key(text: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}]+", "", text.upper())


def goods_rows(grid: list[list[str]], inherited: set[tuple[int, int]], mapping: dict[int, str], start: int) -> list[dict]:
    """The goods of a sheet below its titles, in order; see extract_sheets for the rules."""
    rows: list[dict] = []
    pending: list[dict] = []
    ended = component = False
    no_columns = [c for c in range(3) if c not in mapping]
    for r in range(start, len(grid)):
        cells = [c or "" for c in grid[r]]
        texts = [c.strip() for c in cells if c.strip()]
        joined = " ".join(texts)
        if not texts or _SUBTOTAL.search(joined):
            continue
        if _TOTAL.match(joined) or _DETAIL.search(joined):
            ended, component = True, False
            continue
        if _SECTION.match(joined):
            break
        if ended:
            component = component or bool(_COMPONENT.search(joined))
            continue
        if rows and sum(h in joined.lower() for h in G.NEW_HEADER) >= 3:
            break
        if is_noise(cells):
            continue
        fields: dict = {}
        own = set()
        for c, f in mapping.items():
            raw = cells[c] if c < len(cells) else ""
            if not raw.strip():
                continue
            value = code(raw) if f in CODES else number(raw) if f in NUMERIC else raw.strip()
            if value is None:
                continue
            fields[f] = value
            if (r, c) not in inherited:
                own.add(f)
        if isinstance(fields.get("width"), float) and 20 <= fields["width"] <= 500:
            fields["width"] = round(fields["width"] / 100, 4)
        if fields.get("meters") and fields.get("width") and "area" not in fields:
            fields["area"] = round(fields["meters"] * fields["width"], 4)
        no = next((int(n) for c in no_columns if c < len(cells) and (n := number(cells[c])) is not None and n == int(n) and 0 < n < 1e5), None)
        lines = [x.strip() for x in str(fields.get("article", "")).split("\n") if x.strip()]
        group, article = (lines[0], lines[-1]) if len(lines) > 1 else ("", lines[0] if lines else "")
        if _BLANK.match(article):
            article = ""
        last = rows[-1] if rows else None
        measured = any(isinstance(fields.get(m), float) for m in (*MEASURES, "price"))
        if last and article and no is None and "price" not in fields and _key(article) != _key(last["article"]) and _key(article).endswith(_key(last["article"])):
            last["group"] = last["group"] or article[: -len(last["article"])].strip(" \n/-") or group
            continue
        if last and group and no is None and _key(article) == _key(last["article"]):
            last["group"] = last["group"] or group
            continue
        bare = not article or "article" in fields and "article" not in own
        if bare and last and not ("qty" in own or "meters" in own):
            _continue(last, {k: v for k, v in fields.items() if k not in COMMERCIAL and k in own})
            continue
        if bare and last and "article" in fields and "article" not in own:
            article = last["article"]
        if not article:
            if not measured or not fields.get("description"):
                if last and measured:
                    _continue(last, fields)
                continue
            article = "-"
        elif not plausible_article(article) or not measured:
            continue
        basis = next((fields[m] for m in ("meters", "area", "qty") if fields.get(m)), None)
        if "amount" not in fields and fields.get("price") is not None and basis:
            fields["amount"] = round(fields["price"] * basis + 1e-9, 2)
        row = {**fields, "row": r, "item_no": no, "article": article, "group": group, "n_lines": 1}
        if no is None and row.get("price") is not None and pending:
            for child in pending:
                for k in ("price", "hs_code", "unit", "currency"):
                    if child.get(k) is None and row.get(k) is not None:
                        child[k] = row[k]
                q = child.get("meters") or child.get("qty")
                if child.get("amount") is None and q:
                    child["amount"] = round(child["price"] * q + 1e-9, 2)
            pending = []
            continue
        pending = [*pending, row] if no is not None and row.get("price") is None else []
        rows.append(row)
    return rows


def _continue(last: dict, extra: dict) -> None:
    last["n_lines"] += 1
    for k, v in extra.items():
        if k in MEASURES and isinstance(v, float):
            last[k] = round((last.get(k) or 0.0) + v, 6)
        elif last.get(k) is None:
            last[k] = v


_OUT = {"article": "string", "group": "string", "color": "string", "description": "string", "hs_code": "string", "customs_code": "string", "unit": "string", **{m: "double" for m in ("qty", "price", "amount", "rolls", "boxes", "meters", "width", "area", "net_weight", "gross_weight", "volume")}, "n_lines": "int"}


def extract_sheets(cells: DataFrame, keys: list[str], inherited: str | None = None) -> DataFrame:
    """(keys, row, item_no, fields ...) of the goods on every sheet; cells: keys, row, col, v and a flag of merged cells.

    Titles are searched in the first 25 rows and their columns classified. Below them, row by row: subtotals are passed
    over; a total or detail section ends the goods, a new title row or section ends the sheet; letterhead and other noise
    is left out; a caption that repeats the row above gives its group; a row without an article and quantity of its own
    continues the row above, measures adding up; a merged article with an own quantity is a further lot; amounts lacking
    are price times metres, area or quantity; numbered rows without a price take that of the next unnumbered one, which
    is their family and no goods. A sheet without titles or goods gives no row; null values are empty cells.
    """
    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keys)
    flag = F.coalesce(F.col(inherited), F.lit(False)) if inherited else F.lit(False)
    sheets = cells.where("row is not null and col is not null").groupBy(*keys).agg(F.collect_list(F.struct("row", "col", "v", flag.alias("i"))).alias("_c"))
    names = [*keys, "row", "item_no", *_OUT]

    def run(frames):
        for pdf in frames:
            out = []
            for *k, found in zip(*(pdf[c] for c in keys), pdf["_c"]):
                grid = [[""] * (1 + max(c["col"] for c in found)) for _ in range(1 + max(c["row"] for c in found))]
                for c in found:
                    grid[c["row"]][c["col"]] = c["v"] or ""
                head = find_header(grid)
                if head:
                    start, _, mapping = head
                    for g in goods_rows(grid, {(c["row"], c["col"]) for c in found if c["i"]}, mapping, start):
                        out.append((*k, g["row"], g["item_no"], *(g.get(n) for n in _OUT)))
            pdf = pd.DataFrame(out, columns=names)
            for n, t in _OUT.items():
                if t == "double":
                    pdf[n] = pd.to_numeric(pdf[n])
            yield pdf.astype({"item_no": "Int32"})

    return sheets.mapInPandas(run, f"{kinds}, row int, item_no int, " + ", ".join(f"`{n}` {t}" for n, t in _OUT.items()))


def mapped_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, title_row, col, field): what each sheet's columns mean."""
    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keys)
    sheets = cells.where("row is not null and col is not null").groupBy(*keys).agg(F.collect_list(F.struct("row", "col", "v")).alias("_c"))

    def run(frames):
        for pdf in frames:
            out = []
            for *k, found in zip(*(pdf[c] for c in keys), pdf["_c"]):
                grid = [[""] * (1 + max(c["col"] for c in found)) for _ in range(1 + max(c["row"] for c in found))]
                for c in found:
                    grid[c["row"]][c["col"]] = c["v"] or ""
                head = find_header(grid)
                out += [(*k, head[1], c, f) for c, f in sorted(head[2].items())] if head else []
            yield pd.DataFrame(out, columns=[*keys, "title_row", "col", "field"])

    return sheets.mapInPandas(run, f"{kinds}, title_row int, col int, field string")


