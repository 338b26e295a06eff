"""Queries of the grid and row-order operators over whole test tables; the SQL beside each is written on its own.

Survey operators P1 to P10 are named sp1 to sp10, as p1 to p8 are the training-data problems.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..operators import grids as G
from ..sources.tables import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_LINES = "(SELECT doc_id, row - 1 AS row, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS row FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))"
_CELLS = rf"(SELECT doc_id, row, col - 1 AS col, v FROM (SELECT doc_id, row, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS col FROM (SELECT doc_id, row, regexp_split_to_array(line, '\s{{2,}}|\t') AS l FROM {_LINES})))"
_TITLES = "(SELECT sheet_id, loaded_at, col - 1 AS col, v FROM (SELECT sheet_id, loaded_at, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS col FROM (SELECT DISTINCT sheet_id, loaded_at, string_split(header_text, ' | ') AS l FROM extracted_sheets WHERE header_text IS NOT NULL)))"
_SHEET = ["sheet_id", "loaded_at"]
_ORDER = ["row_no", "row_id", "loaded_at"]


def _cells(spark, sf_dir):
    return G.text_grid(table(spark, sf_dir, "documents"), "doc_id")


def _titles(spark, sf_dir):
    sheets = table(spark, sf_dir, "extracted_sheets").where("header_text is not null").select(*_SHEET, "header_text").distinct()
    return sheets.select(*_SHEET, F.posexplode(F.split("header_text", r" \| ")).alias("col", "v"))


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "extracted_rows").dropDuplicates(["row_id", "loaded_at"])


_ROWS = "(SELECT DISTINCT ON (row_id, loaded_at) * FROM extracted_rows)"


@query(f"SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, v FROM {_CELLS}")
def s11_text_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


_RUNS = f"(SELECT sheet_id, article, min(row_no) AS r0, max(row_no) AS r1 FROM {_ROWS} WHERE article IS NOT NULL AND sheet_id IS NOT NULL GROUP BY 1, 2 HAVING max(row_no) > min(row_no))"


def _merged(spark, sf_dir):
    """Each sheet's rows as one column in which an article stands at its first row only, and the ranges it covers."""
    rows = _rows(spark, sf_dir).where("sheet_id is not null and row_no is not null").groupBy("sheet_id", F.col("row_no").alias("row")).agg(F.min("article").alias("article"))
    runs = _rows(spark, sf_dir).where("article is not null and sheet_id is not null").groupBy("sheet_id", "article").agg(F.min("row_no").alias("r0"), F.max("row_no").alias("r1")).where("r1 > r0")
    merges = runs.select("sheet_id", "r0", F.lit(0).alias("c0"), "r1", F.lit(0).alias("c1"))
    firsts = merges.select("sheet_id", F.col("r0").alias("row"), F.lit(True).alias("starts")).distinct()
    cells = rows.join(firsts, ["sheet_id", "row"], "left").select("sheet_id", "row", F.lit(0).alias("col"), F.when(F.col("starts"), F.col("article")).alias("v"))
    return cells, merges


_GRID = f"(SELECT r.sheet_id, r.row, CASE WHEN f.r0 IS NOT NULL THEN r.article END AS v FROM (SELECT sheet_id, row_no AS row, min(article) AS article FROM {_ROWS} WHERE sheet_id IS NOT NULL AND row_no IS NOT NULL GROUP BY 1, 2) r LEFT JOIN (SELECT DISTINCT sheet_id, r0 FROM {_RUNS}) f ON r.sheet_id = f.sheet_id AND r.row = f.r0)"


@query(f"WITH g AS {_GRID}, m AS {_RUNS} SELECT g.sheet_id, g.row, 0 AS col, CASE WHEN coalesce(trim(g.v), '') <> '' THEN g.v ELSE coalesce(arg_min(o.v, m.r0), g.v) END AS v, coalesce(trim(g.v), '') = '' AND arg_min(o.v, m.r0) IS NOT NULL AS inherited FROM g LEFT JOIN m ON g.sheet_id = m.sheet_id AND g.row > m.r0 AND g.row <= m.r1 LEFT JOIN g o ON o.sheet_id = m.sheet_id AND o.row = m.r0 GROUP BY g.sheet_id, g.row, g.v")
def s5_w1_fill_merges(spark, sf_dir):
    return G.fill_merges(*_merged(spark, sf_dir), ["sheet_id"])


@query(f"WITH g AS {_GRID}, m AS {_RUNS} SELECT g.sheet_id, g.row, min(m.r0 || ':' || m.r1) AS block FROM g LEFT JOIN m ON g.sheet_id = m.sheet_id AND g.row BETWEEN m.r0 AND m.r1 GROUP BY 1, 2")
def w15_block_ids(spark, sf_dir):
    cells, merges = _merged(spark, sf_dir)
    return G.block_ids(cells, merges, ["sheet_id"]).select("sheet_id", "row", "block")


@query(
    "WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sheet_id) AS n FROM (SELECT DISTINCT ON (sheet_id) sheet_id, source, header_text, stopped_at_total FROM extracted_sheets ORDER BY sheet_id, loaded_at)), t AS (SELECT sheet_id, source, n, stopped_at_total, CASE WHEN sheet_id % 3 = 0 THEN header_text END AS h FROM s) "
    "SELECT a.sheet_id, (SELECT b.h FROM t b WHERE b.source = a.source AND b.n <= a.n AND b.h IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t c WHERE c.source = a.source AND c.n >= b.n AND c.n < a.n AND c.stopped_at_total) ORDER BY b.n DESC LIMIT 1) AS carried FROM t a"
)
def s10_w4_carry_header(spark, sf_dir):
    """Every third sheet shows its titles, the others continue the one before of their source until a total ends it."""
    sheets = table(spark, sf_dir, "extracted_sheets").groupBy("sheet_id").agg(F.min_by(F.struct("source", "header_text", "stopped_at_total"), "loaded_at").alias("s")).select("sheet_id", "s.*")
    shown = sheets.withColumn("h", F.when(F.col("sheet_id") % 3 == 0, F.col("header_text")))
    return G.carry(shown, ["source"], ["sheet_id"], "h", F.coalesce("stopped_at_total", F.lit(False)), "carried").select("sheet_id", "carried")


@query(f"SELECT sheet_id, loaded_at, CAST(col AS INTEGER) AS col, string_agg(p, ' ' ORDER BY row) AS title FROM (SELECT sheet_id, loaded_at, col, p, min(row) AS row FROM (SELECT sheet_id, loaded_at, col, trim(unnest(l)) AS p, unnest(range(1, len(l) + 1)) AS row FROM (SELECT *, string_split(v, chr(10))[1:4] AS l FROM {_TITLES})) WHERE p <> '' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
def s9_stack_titles(spark, sf_dir):
    cells = _titles(spark, sf_dir).select(*_SHEET, "col", F.posexplode(F.split("v", "\n")).alias("row", "v"))
    return G.stack_titles(cells, _SHEET)


_TOTALS = "(?i)^\\s*(total|grand\\s*total|итого|всего|genel\\s*toplam|合计|总计)([^\\pL\\pN_]|$)"


@query(rf"SELECT doc_id, CAST(row AS INTEGER) AS row, regexp_matches(line, '{_TOTALS}') OR regexp_matches(line, '(?i)detail\s*packing|подробн') OR regexp_matches(line, '(?i)^\s*(packing\s*list|invoice|specification|инвойс|упаковочн|спецификац)\s*$') AS stop, regexp_matches(line, '(?i)terms of (delivery|payment)|условия поставки|условия оплаты|bank name|bank address|current account|corr\.?\s*account|swift|director|sold to|consignee|recipient|beneficiary|account\s*no|tel\s*:|fax\s*:|e-?mail|(инн|кпп)([^\pL\pN_]|$)|огрн|б/сч|генеральн|покупатель оплач') AS letterhead FROM {_LINES}")
def sp7_sp8_stop_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return docs.select("doc_id", "row", G.is_stop(F.col("line"), F.col("line")).alias("stop"), F.col("line").rlike(G.LETTERHEAD).alias("letterhead"))


@query(rf"WITH t AS (SELECT doc_id, row, regexp_matches(line, '{_TOTALS}') AS total FROM {_LINES}), f AS (SELECT doc_id, min(row) AS at FROM t WHERE total GROUP BY 1) SELECT t.doc_id, CAST(t.row AS INTEGER) AS row, coalesce(t.row > f.at, false) AS after_total FROM t LEFT JOIN f ON t.doc_id = f.doc_id")
def w5_after_total(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return G.after_total(docs, ["doc_id"], ["row"], F.col("line").rlike(G.TOTAL)).select("doc_id", "row", "after_total")


@query(f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY row_no, row_id, loaded_at) AS n FROM {_ROWS}), s AS (SELECT *, (SELECT count(*) FROM o b WHERE b.sheet_id = o.sheet_id AND b.n <= o.n AND b.article IS NOT NULL) AS segment FROM o WHERE sheet_id IS NOT NULL) SELECT sheet_id, segment, arg_min(article, n) FILTER (article IS NOT NULL) AS article, arg_min(hs_code, n) FILTER (hs_code IS NOT NULL) AS hs_code, " + ", ".join(f"CAST(round(sum(CAST({c} AS DECIMAL(24,8))), 6) AS DOUBLE) AS {c}" for c in ("qty", "rolls", "net_weight")) + ", count(*) AS n_lines FROM s GROUP BY 1, 2")
def w2_a3_continuation(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("sheet_id is not null")
    return G.continued(rows, ["sheet_id"], _ORDER, F.col("article").isNotNull(), ["article", "hs_code"], ["qty", "rolls", "net_weight"])


_SOLO = "(SELECT DISTINCT ON (line_id) * FROM doc_lines WHERE source IS NOT NULL ORDER BY line_id, loaded_at)"


@query(f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no, line_id) AS n FROM {_SOLO}), p AS (SELECT a.line_id AS one, b.line_id AS two FROM o a JOIN o b ON a.source = b.source AND b.n = a.n + 1 WHERE a.gross IS NOT NULL AND b.gross IS NULL AND (contains(a.qty_text, '&') OR (b.qty_text IS NOT NULL AND NOT regexp_matches(b.qty_text, '[0-9]')))) SELECT o.line_id, coalesce(x.one, y.one) AS shared FROM o LEFT JOIN p x ON x.one = o.line_id LEFT JOIN p y ON y.two = o.line_id")
def w3_shared_measures(spark, sf_dir):
    lines = table(spark, sf_dir, "doc_lines").where("source is not null").groupBy("line_id").agg(F.min_by(F.struct("source", "line_no", "qty_text", "gross"), "loaded_at").alias("s")).select("line_id", "s.*")
    return G.shared_measures(lines, ["source"], ["line_no", "line_id"], "line_id", "qty_text", "gross").select("line_id", "shared")


_FIELDS = ["price", "hs_code", "unit", "currency"]


@query(
    f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY row_no, row_id, loaded_at) AS n FROM {_ROWS} WHERE sheet_id IS NOT NULL), s AS (SELECT *, sum(CASE WHEN is_group THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY n) AS part FROM o), f AS (SELECT a.sheet_id, a.n, min(b.n) AS family FROM s a JOIN s b ON a.sheet_id = b.sheet_id AND a.part = b.part AND b.n > a.n AND b.item_no IS NULL AND b.price IS NOT NULL WHERE a.item_no IS NOT NULL AND a.price IS NULL GROUP BY 1, 2) "
    "SELECT s.row_id, s.loaded_at, " + ", ".join(f"coalesce(s.{c}, p.{c}) AS {c}" for c in _FIELDS) + " FROM s LEFT JOIN f ON f.sheet_id = s.sheet_id AND f.n = s.n LEFT JOIN s p ON p.sheet_id = f.sheet_id AND p.n = f.family"
)
def w6_family_backfill(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("sheet_id is not null")
    child, family = F.col("item_no").isNotNull() & F.col("price").isNull(), F.col("item_no").isNull() & F.col("price").isNotNull()
    return G.backfill_from_family(rows, ["sheet_id"], _ORDER, child, family, _FIELDS, F.coalesce("is_group", F.lit(False))).select("row_id", "loaded_at", *_FIELDS)


@query("SELECT kit_id, normalized, qty, CAST(row_number() OVER (PARTITION BY kit_id, normalized ORDER BY seen) AS INTEGER) AS lot_no FROM (SELECT kit_id, normalized, qty, min(row_id) AS seen FROM extracted_rows WHERE qty IS NOT NULL AND kit_id IS NOT NULL GROUP BY 1, 2, 3)")
def w10_lot_ordinal(spark, sf_dir):
    rows = table(spark, sf_dir, "extracted_rows").where("qty is not null and kit_id is not null")
    return G.lot_ordinal(rows, ["kit_id", "normalized"], "qty", ["row_id"])


_HINTS = ["invoice", "weight", "price", "цена", "масса", "waga", "peso", "fattura", "инвойс", "артикул", "paese"]


@query(f"SELECT doc_id, CAST(row AS INTEGER) AS row, score FROM (SELECT doc_id, row, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row) AS rn FROM (SELECT doc_id, row, count(*) AS score FROM {_CELLS} WHERE row < 25 AND regexp_matches(lower(v), '{'|'.join(_HINTS)}') GROUP BY 1, 2) WHERE score >= 1) WHERE rn = 1")
def sp3_w12_header_row(spark, sf_dir):
    return G.header_candidate(_cells(spark, sf_dir), ["doc_id"], _HINTS, least=1)


_STAT_COLUMNS = ["article", "hs_code", "color", "qty", "unit", "price"]
_LONG = "(SELECT * FROM (" + " UNION ALL ".join(f"SELECT sheet_id, row_id, loaded_at, {i} AS col, '{c}' AS name, CAST({c} AS VARCHAR) AS v FROM {_ROWS}" for i, c in enumerate(_STAT_COLUMNS)) + "))"


@query(f"SELECT row_id, loaded_at, CAST(arg_min(n, col) AS INTEGER) AS item_no FROM (SELECT row_id, loaded_at, col, TRY_CAST(v AS DOUBLE) AS n FROM (SELECT row_id, loaded_at, 0 AS col, CAST(item_no AS VARCHAR) AS v FROM {_ROWS} UNION ALL SELECT row_id, loaded_at, 1, CAST(row_no AS VARCHAR) FROM {_ROWS} UNION ALL SELECT row_id, loaded_at, 2, CAST(rolls AS VARCHAR) FROM {_ROWS})) WHERE n = floor(n) AND n > 0 AND n < 100000 GROUP BY 1, 2")
def w14_leftmost_number(spark, sf_dir):
    cells = G.unpivoted(_rows(spark, sf_dir), ["row_id", "loaded_at"], ["item_no", "row_no", "rolls", "qty"])
    return G.leftmost_number(cells, ["row_id", "loaded_at"], F.col("v").try_cast("double"), F.lit(True))


@query(rf"SELECT sheet_id, name, count(*) AS n, avg(CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END) AS numeric, avg(CASE WHEN regexp_matches(v, '\d\s*[*x×х]\s*\d+\s*[*x×х]\s*\d') THEN 1 ELSE 0 END) AS dimension, avg(CASE WHEN regexp_full_match(v, '\d{{6,13}}') THEN 1 ELSE 0 END) AS code, avg(CASE WHEN regexp_matches(v, '\pL') AND num IS NULL THEN 1 ELSE 0 END) AS text, max(abs(num)) AS largest FROM (SELECT sheet_id, name, v, CASE WHEN NOT regexp_matches(v, '[A-Za-z]') THEN TRY_CAST(v AS DOUBLE) END AS num FROM {_LONG} WHERE coalesce(trim(v), '') <> '' AND name <> 'price' AND name <> 'qty' AND name <> 'color') GROUP BY 1, 2")
def a21_column_statistics(spark, sf_dir):
    cells = G.unpivoted(_rows(spark, sf_dir), ["sheet_id"], ["article", "hs_code", "unit"])
    number = F.when(~F.col("v").rlike("[A-Za-z]"), F.col("v").try_cast("double"))
    return G.column_statistics(cells, ["sheet_id", "name"], number, M.code_digits(F.col("v")).isNotNull())


@query(rf"SELECT row_id, loaded_at, article, CASE WHEN regexp_full_match(hs_code, '\d{{6,13}}') THEN hs_code END AS hs_code, qty, unit, price FROM {_ROWS}")
def sp4_row_projection(spark, sf_dir):
    v = F.col("v")
    fields = {"article": v, "hs_code": M.code_digits(v), "qty": v.try_cast("double"), "unit": v, "price": v.try_cast("double")}
    return G.projected(G.unpivoted(_rows(spark, sf_dir), ["row_id", "loaded_at"], _STAT_COLUMNS), ["row_id", "loaded_at"], fields)


@query(rf"SELECT doc_id, CAST(row AS INTEGER) AS row, joined, filled, words FROM (SELECT doc_id, row, string_agg(t, ' ' ORDER BY col) AS joined, count(*) AS filled, count(*) FILTER (regexp_matches(t, '\pL')) AS words FROM (SELECT doc_id, row, col, trim(v) AS t FROM {_CELLS}) WHERE t <> '' GROUP BY 1, 2)")
def sp5_row_facts(spark, sf_dir):
    facts = G.row_facts(_cells(spark, sf_dir), ["doc_id", "row"], F.lit(None).cast("double"), F.lit(False))
    return facts.select("doc_id", "row", "joined", "filled", "words")


@query()
def sp5_noise_rows(spark, sf_dir):
    """Rows of the documents that are neither titles nor goods; tested against a plain version on a fixture."""
    v = F.col("v")
    facts = G.row_facts(_cells(spark, sf_dir), ["doc_id", "row"], M.parse_number(v), M.code_digits(v).isNotNull())
    return facts.where(G.is_noise()).select("doc_id", "row", "joined")


@query("SELECT sheet_id, loaded_at, (" + " + ".join(f"CAST(contains(t, '{h}') AS INTEGER)" for h in G.NEW_HEADER) + ") >= 2 AS header FROM (SELECT DISTINCT sheet_id, loaded_at, lower(header_text) AS t FROM extracted_sheets WHERE header_text IS NOT NULL)")
def sp9_repeated_header(spark, sf_dir):
    sheets = table(spark, sf_dir, "extracted_sheets").where("header_text is not null").select(*_SHEET, "header_text").distinct()
    return sheets.select(*_SHEET, G.looks_like_header(F.col("header_text"), least=2).alias("header"))


@query(f"SELECT a.sheet_id, a.loaded_at, CAST(a.col AS INTEGER) AS col, a.v AS label, (SELECT trim(b.v) FROM {_TITLES} b WHERE b.sheet_id = a.sheet_id AND b.loaded_at = a.loaded_at AND b.col > a.col AND trim(b.v) <> '' ORDER BY b.col LIMIT 1) AS value FROM {_TITLES} a WHERE contains(lower(a.v), 'art')")
def j22_label_value(spark, sf_dir):
    return G.next_value(_titles(spark, sf_dir), _SHEET, F.lower("v").contains("art")).select(*_SHEET, "col", F.col("v").alias("label"), "value")


@query("WITH c AS (SELECT kit_id, list_sort(list(DISTINCT hs_code)) AS codes FROM canonical_kit GROUP BY 1) SELECT r.row_id, r.loaded_at, CASE WHEN codes IS NOT NULL THEN codes[least(n, len(codes))] END AS code FROM (SELECT *, row_number() OVER (PARTITION BY kit_id ORDER BY row_no, row_id, loaded_at) AS n FROM ROWS_ WHERE kit_id IS NOT NULL) r LEFT JOIN c USING (kit_id)".replace("canonical_kit", "(SELECT kit_id, hs_code FROM extracted_rows WHERE hs_code IS NOT NULL AND kit_id IS NOT NULL)").replace("ROWS_", _ROWS))
def w17_positional_codes(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("kit_id is not null")
    codes = rows.where("hs_code is not null").groupBy("kit_id").agg(F.array_sort(F.collect_set("hs_code")).alias("codes"))
    return G.positional(rows.join(codes, "kit_id", "left"), ["kit_id"], _ORDER, F.col("codes"), "code").select("row_id", "loaded_at", "code")


@query(rf"SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY row) - 1 AS INTEGER) AS row, CAST(row_number() OVER (PARTITION BY doc_id, row ORDER BY i) - 1 AS INTEGER) AS col, text FROM (SELECT doc_id, row, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS text FROM (SELECT doc_id, row, string_split(line, ' ') AS w FROM {_LINES})) WHERE text <> ''")
def s22_w13_scan_rows(spark, sf_dir):
    """The words of each document as boxes with a shaky height, put into rows again."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", "line", F.posexplode(F.split("t", " ")).alias("i", "text")).where("text != ''")
    shake = F.pmod(F.xxhash64("doc_id", "line", "i"), F.lit(5)).cast("double")
    blocks = words.select("doc_id", "text", F.col("i").cast("double").alias("x"), (F.col("line") * 40 + shake).alias("y"), F.lit(12.0).alias("height"))
    return G.rows_of_blocks(blocks, ["doc_id"])


@query("SELECT doc_id, CAST(row AS INTEGER) AS row, rank FROM (SELECT doc_id, row, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, width DESC, row) AS INTEGER) AS rank FROM (SELECT doc_id, row, count(*) FILTER (trim(v) <> '') AS n, max(col) AS width FROM " + _CELLS + " GROUP BY 1, 2)) WHERE rank <= 3")
def o3_widest_rows(spark, sf_dir):
    """The three rows of each document with the most filled cells, the wider first; the limit is the report."""
    rows = _cells(spark, sf_dir).groupBy("doc_id", "row").agg(F.count(F.when(F.trim("v") != "", 1)).alias("n"), F.max("col").alias("width"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), F.desc("width"), "row")
    return rows.select("doc_id", "row", F.row_number().over(w).alias("rank")).where("rank <= 3")
