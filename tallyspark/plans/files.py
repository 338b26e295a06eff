"""Queries of the file sources and sinks: tables written as workbooks, pages and pipe tables and read again, over whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import papers as P
from ..sources import books as S
from ..sources.tables import table
from . import joins as B
from . import tables_out as O
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_SHEETS = {"invoice": ["no", "article", "qty", "price"], "packing": ["no", "article", "qty", "net_weight"], "specification": ["no", "article", "qty", "net_weight"]}


def _printed(spark, sf_dir):
    rows = B._rows(spark, sf_dir).where("not is_group").withColumns({"place": F.coalesce("item_no", F.lit(999))})
    numbered = P.numbered_rows(rows, ["kit_id", "role"], ["place", "row_id"])
    third = F.when(F.col("role") == "invoice", F.col("price")).otherwise(F.col("net_weight"))
    return numbered.select("kit_id", "role", "no", F.array(F.col("no").cast("string"), "article", F.col("qty").cast("string"), third.cast("string")).alias("values"))


_BACK = f"(SELECT kit_id, role, CAST(row_number() OVER (PARTITION BY kit_id, role ORDER BY coalesce(item_no, 999), row_id) AS INTEGER) AS no, article, qty, CASE WHEN role = 'invoice' THEN price ELSE net_weight END AS third FROM {B._R} WHERE NOT is_group)"


@query(f"SELECT kit_id, role AS sheet, no AS row, article, qty, third FROM {_BACK}")
def s1_k1_books(spark, sf_dir):
    """A workbook of three sheets for each shipment, written, sniffed and read again."""
    made = S.books(_printed(spark, sf_dir), "kit_id", "role", _SHEETS, "values", "no")
    cells = S.cells_of(made, ["kit_id"]).where("problem is null and row > 0")
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("v")))
    rows = cells.groupBy("kit_id", "sheet", "row").agg(at(1).alias("article"), at(2).cast("double").alias("qty"), at(3).cast("double").alias("third"))
    return rows.select("kit_id", "sheet", "row", "article", "qty", "third")


@query(f"SELECT kit_id, count(*) AS sheets, true AS book FROM (SELECT DISTINCT kit_id FROM {B._R} WHERE NOT is_group), (SELECT unnest(['invoice', 'packing', 'specification'])) GROUP BY 1")
def s4_sniff(spark, sf_dir):
    """The kind of each written workbook by its first bytes, and its number of sheets."""
    made = S.books(_printed(spark, sf_dir), "kit_id", "role", _SHEETS, "values", "no")
    sheets = S.cells_of(made, ["kit_id"]).groupBy("kit_id").agg(F.count_distinct("sheet").alias("sheets"))
    return made.select("kit_id", (S.sniff(F.col("content")) == "xlsx").alias("book")).join(sheets, "kit_id").select("kit_id", "sheets", "book")


@query(r"SELECT sheet_id, loaded_at, CAST(i - 1 AS INTEGER) AS col, trim(regexp_replace(v, '[ \t\r]+', ' ', 'g')) AS v FROM (SELECT sheet_id, loaded_at, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT sheet_id, loaded_at, string_split(replace(header_text, chr(10), ' '), ' | ') AS l FROM extracted_sheets WHERE header_text IS NOT NULL))")
def s3_html_tables(spark, sf_dir):
    """Header rows as HTML saved under another name, read again."""
    sheets = table(spark, sf_dir, "extracted_sheets").where("header_text is not null").select("sheet_id", "loaded_at", "header_text").distinct()
    safe = F.replace(F.replace(F.replace(F.col("header_text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit(" "))
    page = F.concat(F.lit("<html><body><table><tr><td>"), F.replace(safe, F.lit(" | "), F.lit("</td><td>")), F.lit("</td></tr></table></body></html>"))
    cells = S.cells_of(sheets.select("sheet_id", "loaded_at", F.encode(page, "UTF-8").alias("content")), ["sheet_id", "loaded_at"])
    return cells.where("problem is null").select("sheet_id", "loaded_at", "col", "v")


@query("SELECT sheet_id, loaded_at, CAST(i - 1 AS INTEGER) AS col, trim(v) AS v FROM (SELECT sheet_id, loaded_at, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT sheet_id, loaded_at, string_split(replace(header_text, chr(10), ' '), ' | ') AS l FROM extracted_sheets WHERE header_text IS NOT NULL))")
def s23_pipe_tables(spark, sf_dir):
    """Header rows as pipe tables between other lines."""
    sheets = table(spark, sf_dir, "extracted_sheets").where("header_text is not null").select("sheet_id", "loaded_at", "header_text").distinct()
    text = F.concat(F.lit("Intro\n|---|:--|\n| "), F.replace("header_text", F.lit("\n"), F.lit(" ")), F.lit(" |\nOutro"))
    return S.pipe_tables(sheets.select("sheet_id", "loaded_at", text.alias("text")), ["sheet_id", "loaded_at"]).select("sheet_id", "loaded_at", "col", "v")


@query("SELECT doc_id, content_hash, copies, doc_id <> first AS duplicate FROM (SELECT doc_id, sha256(text) AS content_hash, count(*) OVER (PARTITION BY sha256(text)) AS copies, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY lower(source), doc_id) AS first FROM documents WHERE text IS NOT NULL)")
def s16_s35_duplicates(spark, sf_dir):
    """Byte-identical documents, the first by name kept."""
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("name", F.lower("source"))
    hashed = S.duplicates(docs.withColumn("content", F.encode("text", "UTF-8")), "doc_id", F.col("content"), [F.lit(0)])
    first = docs.select("doc_id", "name").join(hashed.select("doc_id", "content_hash", "copies"), "doc_id")
    best = first.groupBy("content_hash").agg(F.min_by("doc_id", F.struct(F.coalesce("name", F.lit("￿")), "doc_id")).alias("f"))
    return first.join(best, "content_hash").select("doc_id", "content_hash", "copies", (F.col("doc_id") != F.col("f")).alias("duplicate"))


@query("SELECT doc_id, sha256(text) AS mark FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) <= 262144")
def s37_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("content", F.encode("text", "UTF-8"))
    return docs.where(F.length("content") <= 262144).select("doc_id", S.fingerprint(F.col("content")).alias("mark"))


@query("SELECT doc_id, text, CASE WHEN hash_ % 2 = 0 THEN 'utf-8' ELSE 'utf-16' END AS encoding FROM (SELECT doc_id, text, doc_id AS hash_ FROM documents WHERE text <> '')")
def s30_decode_bytes(spark, sf_dir):
    """Documents as bytes, in UTF-8 or in UTF-16 with a mark, decoded again; the other encodings have tests of their own."""
    import pandas as pd

    docs = table(spark, sf_dir, "documents").where("text != ''")
    wide = F.concat(F.lit(bytearray(b"\xfe\xff")), F.encode("text", "UTF-16BE"))
    raw = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(wide).alias("content"))

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(i, *S.decode_bytes(bytes(c))) for i, c in zip(pdf.doc_id, pdf.content)], columns=["doc_id", "text", "encoding"])

    return raw.mapInPandas(run, "doc_id bigint, text string, encoding string")


@query("SELECT kit_id, count(*) AS rows FROM " + O._GOODS.format(role="invoice") + " GROUP BY 1")
def k8_json_lines(spark, sf_dir):
    """Invoice rows as lines of JSON, read again and counted."""
    lines = O._goods(spark, sf_dir, "invoice").select(F.to_json(F.struct("kit_id", "article", "qty", "price")).alias("line"))
    return lines.select(F.from_json("line", "kit_id string, article string, qty double, price double").alias("j")).groupBy("j.kit_id").agg(F.count("*").alias("rows"))
