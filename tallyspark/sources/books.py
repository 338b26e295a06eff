"""Workbooks, HTML tables, pipe tables and raw bytes as cells, and tables as workbooks again; a file is one row, many files many tasks.

A file's bytes come from `spark.read.format("binaryFile")` or any table with a binary column. OOXML is read and written with
the standard library. A legacy BIFF file can't be read here and gives a row in `problem` instead of cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
CELLS = "sheet string, row int, col int, v string, kind string"
# Encodings a file's text may be in, in the order that decides between equals.
ENCODINGS = ("gb18030", "gbk", "big5", "cp1254", "iso-8859-9", "cp1251", "cp1252", "koi8-r", "latin-1")


def sniff(content: Column) -> Column:
    """xlsx, xls, html or other by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return F.when(head.startswith("504B0304"), "xlsx").when(head == "D0CF11E0A1B11AE1", "xls").when(text.rlike("^(\\xef\\xbb\\xbf)?\\s*<(!doctype|html|\\?xml|table|head|body|meta)"), "html").otherwise("other")


def _place(ref: str) -> tuple[int, int]:
    letters, digits = _REF.match(ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def column_letters(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_book(data: bytes, formulas: bool = False) -> Iterator[tuple[str, list[tuple], list[tuple]]]:
    """(sheet, cells (row, col, v, kind), merges (r0, c0, r1, c1)) of each sheet with cells; values as cached, or formulas as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
            target = rels[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            cells = []
            for at, row in enumerate(root.iterfind("m:sheetData/m:row", _NS)):
                r = int(row.get("r", at + 1)) - 1
                for i, c in enumerate(row.findall("m:c", _NS)):
                    r, col = _place(c.get("r")) if c.get("r") else (r, i)
                    v, f, kind = c.find("m:v", _NS), c.find("m:f", _NS), c.get("t", "n")
                    if formulas and f is not None and f.text:
                        cells.append((r, col, f"={f.text}", "formula"))
                    elif kind == "inlineStr":
                        cells.append((r, col, "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), "text"))
                    elif v is not None and v.text is not None:
                        text = shared[int(v.text)] if kind == "s" else v.text
                        cells.append((r, col, text, {"s": "text", "str": "text", "b": "bool", "e": "error"}.get(kind, "number")))
            merges = []
            for m in root.iterfind("m:mergeCells/m:mergeCell", _NS):
                a, _, b = m.get("ref").partition(":")
                merges.append((*_place(a), *_place(b or a)))
            if any(v.strip() for _, _, v, _ in cells):
                yield s.get("name"), cells, merges


class _Tables(HTMLParser):
    """Cells of every table of a page; a table inside a cell counts as that cell's text."""

    def __init__(self):
        super().__init__()
        self.tables: list[tuple[list, list]] = []
        self.depth, self.row, self.col, self.text, self.span, self.taken = 0, -1, 0, None, (1, 1), set()

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append(([], []))
                self.row, self.taken = -1, set()
        elif self.depth == 1 and tag == "tr":
            self.close()
            self.row, self.col = self.row + 1, 0
        elif self.depth == 1 and tag in ("td", "th"):
            self.close()
            self.text = []
            size = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
            self.span = (size("rowspan"), size("colspan"))
        elif tag == "br" and self.text is not None:
            self.text.append("\n")

    def close(self):
        if self.text is not None and self.tables:
            while (self.row, self.col) in self.taken:
                self.col += 1
            cells, merges = self.tables[-1]
            value = re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", "".join(self.text))).strip()
            rows, cols = self.span
            cells.append((self.row, self.col, value, "text"))
            if rows > 1 or cols > 1:
                merges.append((self.row, self.col, self.row + rows - 1, self.col + cols - 1))
                self.taken |= {(r, c) for r in range(self.row, self.row + rows) for c in range(self.col, self.col + cols)}
            self.col += cols
        self.text = None

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self.close()
        if tag == "table":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data.replace("\n", " "))


def read_html(text: str) -> Iterator[tuple[str, list[tuple], list[tuple]]]:
    """Sheet1, Sheet2 ... for each table with cells."""
    page = _Tables()
    page.feed(text)
    page.close()
    for i, (cells, merges) in enumerate(page.tables, 1):
        if cells:
            yield f"Sheet{i}", cells, merges


def decode_bytes(data: bytes) -> tuple[str, str]:
    """(text, encoding): by the byte order mark, UTF-8 if it is that, else the encoding whose own script the text shows most."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace"), "utf-16"
    try:
        return data.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        pass
    best = None
    for i, name in enumerate(ENCODINGS):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        part, n = text[:8000], max(1, len(text[:8000]))
        share = lambda p: len(re.findall(p, part)) / n
        latin, turkish = share("[A-Za-z]"), share("[İıŞşĞğÇçÖöÜü]")
        score = {"gb18030": share("[一-鿿]"), "gbk": share("[一-鿿]"), "big5": share("[一-鿿]"), "cp1251": share("[А-Яа-яЁёІіЇїЄєҐґ]"), "koi8-r": share("[А-Яа-яЁёІіЇїЄєҐґ]"), "cp1252": 0.12 * latin, "latin-1": 0.05}.get(name)
        if score is None:
            score = min(1.0, 2 * turkish + latin) if turkish else 0.08 * latin
        if re.search("[-]", part):
            score = -1.0
        if best is None or score > best[0]:
            best = (score, text, name)
    return best[1:] if best else (data.decode("latin-1"), "latin-1")


def cells_of(files: DataFrame, key: list[str], content: str = "content", formulas: bool = False) -> DataFrame:
    """(key, sheet, row, col, v, kind, problem) of every cell of every file: workbooks, and HTML saved under any name.

    What can't be read gives one row with `problem` and null cells: a broken or locked workbook, a legacy one, a file of
    another kind. Null contents give none. A workbook is read whole in one task.
    """
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in key)
    names = [*key, "sheet", "row", "col", "v", "kind", "problem"]

    def run(frames):
        for pdf in frames:
            out = []
            for *k, kind, data in zip(*(pdf[c] for c in key), pdf["_kind"], pdf["_data"]):
                try:
                    if kind == "other" or kind == "xls":
                        raise ValueError("legacy workbook" if kind == "xls" else "neither a workbook nor a page of tables")
                    sheets = read_book(bytes(data), formulas) if kind == "xlsx" else read_html(decode_bytes(bytes(data))[0])
                    rows = [(*k, name, *c, None) for name, cells, _ in sheets for c in cells]
                    if not rows:
                        raise ValueError("no cells")
                    out += rows
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, RuntimeError) as e:
                    out.append((*k, None, None, None, None, None, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(out, columns=names).astype({"row": "Int32", "col": "Int32"})

    told = files.where(F.col(content).isNotNull()).select(*key, sniff(F.col(content)).alias("_kind"), F.col(content).alias("_data"))
    return told.mapInPandas(run, f"{kinds}, {CELLS}, problem string")


def merges_of(files: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, sheet, r0, c0, r1, c1) of every merged range of every workbook or page; unreadable files have none."""
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in key)

    def run(frames):
        for pdf in frames:
            out = []
            for *k, kind, data in zip(*(pdf[c] for c in key), pdf["_kind"], pdf["_data"]):
                try:
                    sheets = list(read_book(bytes(data)) if kind == "xlsx" else read_html(decode_bytes(bytes(data))[0]))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, RuntimeError):
                    continue
                out += [(*k, name, *m) for name, _, merges in sheets for m in merges]
            yield pd.DataFrame(out, columns=[*key, "sheet", "r0", "c0", "r1", "c1"])

    told = files.where(F.col(content).isNotNull()).select(*key, sniff(F.col(content)).alias("_kind"), F.col(content).alias("_data")).where("_kind in ('xlsx', 'html')")
    return told.mapInPandas(run, f"{kinds}, sheet string, r0 int, c0 int, r1 int, c1 int")


def make_book(sheets: list[tuple[str, list[list], list[tuple]]]) -> bytes:
    """A workbook of (name, rows of values, merges) as bytes: numbers as numbers, None as no cell, the first row in bold."""
    types, rels, tabs, parts = [], [], [], {}
    for i, (name, rows, merges) in enumerate(sheets, 1):
        lines = []
        for r, row in enumerate(rows):
            cells = []
            for c, v in enumerate(row):
                if v is None or v != v:
                    continue
                at, style = f"{column_letters(c)}{r + 1}", ' s="1"' if r == 0 else ""
                if isinstance(v, bool):
                    cells.append(f'<c r="{at}"{style} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, int | float):
                    cells.append(f'<c r="{at}"{style}><v>{v!r}</v></c>')
                else:
                    text = escape(_ILLEGAL.sub("", str(v))).replace("\r", "&#13;")
                    cells.append(f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
            lines.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
        spans = "".join(f'<mergeCell ref="{column_letters(b)}{a + 1}:{column_letters(d)}{c + 1}"/>' for a, b, c, d in merges)
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(lines)}</sheetData>' + (f'<mergeCells count="{len(merges)}">{spans}</mergeCells>' if merges else "") + "</worksheet>"
        title = escape(re.sub(r"[\[\]:*?/\\]", " ", name)[:31] or f"Sheet{i}", {'"': "&quot;"})
        tabs.append(f'<sheet name="{title}" sheetId="{i}" r:id="rId{i}"/>')
        rels.append(f'<Relationship Id="rId{i}" Type="{_NS["r"]}/worksheet" Target="worksheets/sheet{i}.xml"/>')
        types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
    package = "http://schemas.openxmlformats.org/package/2006"
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{_NS["m"]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>'
    rels.append(f'<Relationship Id="rId{len(sheets) + 1}" Type="{_NS["r"]}/styles" Target="styles.xml"/>')
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>{"".join(tabs)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{package}/relationships">{"".join(rels)}</Relationships>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{_NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["[Content_Types].xml"] = f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{"".join(types)}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + parts[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def books(tables: DataFrame, shipment: str, sheet: str, titles: dict[str, list[str]], values: str, order: str) -> DataFrame:
    """(shipment, content): one workbook for each shipment, made in its task; write them with any sink of binary rows.

    tables: shipment, sheet, order, values (array of text) of every printed row; titles: the first row of each sheet, the
    sheets come in this order. A number in text becomes a number cell. A shipment's rows are bounded by what papers hold.
    """
    rows = tables.groupBy(shipment).agg(F.array_sort(F.collect_list(F.struct(sheet, order, values))).alias("_rows"))
    kind = tables.schema[shipment].dataType.simpleString()
    number = re.compile(r"^-?\d{1,15}(\.\d+)?$")

    def cell(v):
        return (float(v) if "." in v else int(v)) if v is not None and number.match(v) and not re.match(r"^-?0\d", v) else v

    def run(frames):
        for pdf in frames:
            out = []
            for key, found in zip(pdf[shipment], pdf["_rows"]):
                made = {name: [list(first)] for name, first in titles.items()}
                for r in found:
                    if r[sheet] in made:
                        made[r[sheet]].append([cell(v) for v in r[values]])
                out.append((key, make_book([(n, body, []) for n, body in made.items()])))
            yield pd.DataFrame(out, columns=[shipment, "content"])

    return rows.mapInPandas(run, f"`{shipment}` {kind}, content binary")


def archive(files: dict[str, bytes]) -> bytes:
    """A zip of named files, for what leaves the driver in one piece; the caller bounds it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(name, files[name])
    return out.getvalue()


def pipe_tables(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, table, row, col, v): cells of the pipe tables of a text; separator rows are left out, other lines part tables."""
    lines = texts.where(F.col(text).isNotNull()).select(*key, F.posexplode(F.split(text, "\n")).alias("line", "t"))
    t = F.trim("t")
    lines = lines.withColumn("_pipe", t.startswith("|") & (F.length(t) > 1))
    w = Window.partitionBy(*key).orderBy("line")
    parted = lines.withColumn("table", F.sum(F.when(~F.col("_pipe"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    body = parted.where(F.col("_pipe") & ~t.rlike("^\\|[\\s|:-]*\\|?$"))
    row = (F.row_number().over(Window.partitionBy(*key, "table").orderBy("line")) - 1).alias("row")
    cells = F.posexplode(F.split(F.regexp_replace(F.regexp_replace(t, "^\\|", ""), "\\|$", ""), "\\|")).alias("col", "v")
    return body.select(*key, "table", "line", row, "t").select(*key, "table", "row", cells).withColumn("v", F.trim("v"))


def duplicates(files: DataFrame, name: str, content: Column, order: list[Column]) -> DataFrame:
    """Files with content_hash, place among their copies, and whether they are a later copy of the first by `order`.

    A window over equal contents: copies of one file sit together, so their number bounds a task; names alone travel.
    """
    hashed = files.select(name, F.sha2(content, 256).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min(F.struct(*order, F.col(name))).alias("_f"), F.count("*").alias("copies"))
    return hashed.join(firsts, "content_hash").select(name, "content_hash", "copies", (F.col(name) != F.col(f"_f.{name}")).alias("duplicate"))


def fingerprint(content: Column, head: int = 1 << 18, tail: int = 1 << 16) -> Column:
    """SHA-256 of the first 256 KiB and the last 64 KiB."""
    n = F.length(content)
    return F.sha2(F.concat(F.substring(content, 1, head), F.when(n > head, F.substr(content, F.greatest(F.lit(head + 1), n - tail + 1))).otherwise(F.lit(b""))), 256)
