"""Queries of header fields, free-text lines, fallbacks and roll-ups over whole test tables; the SQL beside each is written on its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lines as X
from ..functions import money as M
from ..functions import rules as R
from ..operators import merging as J
from ..operators import votes as V
from ..sources.tables import table
from . import joins as B
from .registry import Registry
from .scalars import _JSON, _figures

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_R, _I, _C, _dec = B._R, B._I, B._C, B._dec
_LINES = "(SELECT doc_id, row - 1 AS row, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS row FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))


@query("SELECT doc_id, text AS repaired FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[ÃÂÐÑØÙâ][\\x{0080}-\\x{00bf}]')".replace("\\\\", "\\"))
def n14_latin_mojibake(spark, sf_dir):
    """Texts read as Latin-1 instead of UTF-8, and back."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(X.MOJIBAKE))
    return docs.select("doc_id", X.utf8_again(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).alias("repaired"))


@query(r"SELECT doc_id, 'date' AS field, unnest(regexp_extract_all(text, '\d\d\d\d-\d\d-\d\d')) AS value FROM documents UNION ALL SELECT doc_id, 'kit', unnest(regexp_extract_all(text, 'kit (\d+-\d|\d+)', 1)) FROM documents UNION ALL SELECT doc_id, 'money', unnest(regexp_extract_all(text, '(\d+[.,]\d\d) (?:USD|EUR)', 1)) FROM documents")
def n16_n22_text_hits(spark, sf_dir):
    patterns = {"date": r"(\d\d\d\d-\d\d-\d\d)", "kit": r"kit (\d+-\d|\d+)", "money": r"(\d+[.,]\d\d) (?:USD|EUR)"}
    return X.hits(table(spark, sf_dir, "documents"), ["doc_id"], "text", patterns)


@query(r"SELECT vendor, CASE WHEN length(v) <= 20 THEN v WHEN strpos(reverse(left(v, 21)), ' ') > 1 THEN rtrim(left(v, 21 - strpos(reverse(left(v, 21)), ' '))) WHEN substr(v, 21, 1) = ' ' THEN left(v, 20) ELSE left(v, 20) END AS clipped FROM (SELECT DISTINCT vendor, trim(regexp_replace(vendor, '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS v FROM doc_lines WHERE vendor IS NOT NULL AND NOT regexp_matches(vendor, '[\x00-\x1f\x7f]'))")
def n15_clipped_names(spark, sf_dir):
    v = table(spark, sf_dir, "doc_lines").where(F.col("vendor").isNotNull() & ~F.col("vendor").rlike("[\\x00-\\x1f\\x7f]")).select("vendor").distinct()
    return v.select("vendor", X.clipped(F.col("vendor"), 20).alias("clipped"))


@query(f"SELECT a.item_id, coalesce(nullif(trim(a.color), ''), nullif(trim(b.color), '')) AS color, CASE WHEN a.manufacturer IS NULL THEN nullif(trim(b.manufacturer), '') WHEN contains(lower(regexp_replace(b.manufacturer, '[^A-Za-zА-Яа-яЁё0-9]', '', 'g')), lower(regexp_replace(a.manufacturer, '[^A-Za-zА-Яа-яЁё0-9]', '', 'g'))) AND length(regexp_replace(b.manufacturer, '[^A-Za-zА-Яа-яЁё0-9]', '', 'g')) > length(regexp_replace(a.manufacturer, '[^A-Za-zА-Яа-яЁё0-9]', '', 'g')) THEN trim(b.manufacturer) ELSE trim(a.manufacturer) END AS manufacturer FROM {_I} a LEFT JOIN {_C} b USING (item_id)")
def n18_merged_header(spark, sf_dir):
    copy = J.once(table(spark, sf_dir, "canonical_items_copy"), "item_id", "loaded_at")
    return V.merged_header(B._items(spark, sf_dir), copy, ["item_id"], ["color", "manufacturer"], ("manufacturer",))


@query(f"WITH m AS (SELECT kit_id, CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS currency FROM {_R} WHERE currency IS NOT NULL GROUP BY 1) SELECT k.kit_id, m.currency FROM (SELECT DISTINCT kit_id FROM {_R}) k LEFT JOIN m USING (kit_id)")
def n19_header_from_goods(spark, sf_dir):
    """Header currency of every shipment from its goods, where they agree."""
    rows = B._rows(spark, sf_dir)
    return rows.select("kit_id").distinct().join(V.collapsed(rows.where("currency is not null"), ["kit_id"], {"currency": F.col("currency")}), "kit_id", "left")


_ERRORS = [("timeout|timed out", "the paper took too long"), ("password|encrypt", "the file is locked"), ("zip|corrupt|broken", "the file is damaged"), ("json", "the answer could not be read")]


@query("SELECT kit_id, attempt, CASE WHEN error IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(lower(error), '{p}') THEN '{m}'" for p, m in _ERRORS) + " ELSE 'the paper could not be read' END AS message FROM kit_results")
def n21_error_messages(spark, sf_dir):
    return table(spark, sf_dir, "kit_results").select("kit_id", "attempt", X.told(F.col("error"), _ERRORS, "the paper could not be read").alias("message"))


@query(r"SELECT doc_id, CAST(row AS INTEGER) AS row, words, numbers FROM (SELECT doc_id, row, len(regexp_extract_all(line, '\pL\pL+')) AS words, len(regexp_extract_all(line, '\d+(?:[.,]\d+)?')) AS numbers FROM " + _LINES + r" WHERE NOT regexp_matches(lower(line), 'total|итого|page')) WHERE words >= 1 AND numbers >= 2")
def s26_plain_lines(spark, sf_dir):
    """Lines of free text with a word and two numbers or more that may be goods."""
    return X.plain_goods(_lines(spark, sf_dir), ["doc_id", "row"], "line")


@query(r"SELECT doc_id, CAST(row AS INTEGER) AS row, trim(regexp_extract(line, '^([^/|;]+?)\s*[/;|]', 1)) AS article, regexp_extract(line, '(\d[\d.,]*)\s*(?:KGS|kg|EUR|USD)\s*$', 1) AS last_figure FROM " + _LINES + r" WHERE regexp_matches(line, '^[^/|;]+[/;|].*\d[\d.,]*\s*(?:KGS|kg|EUR|USD)\s*$')")
def s13_s25_slash_lines(spark, sf_dir):
    """Goods lines parted by slash, bar or semicolon: the article and the last figure."""
    return X.parted_goods(_lines(spark, sf_dir), ["doc_id", "row"], "line")


@query(r"SELECT doc_id, CAST(row AS INTEGER) AS row, label, value FROM (SELECT doc_id, row, lower(trim(regexp_extract(line, '^([\pL .]{2,30}?)\s*:\s*(.+)$', 1))) AS label, trim(regexp_extract(line, '^([\pL .]{2,30}?)\s*:\s*(.+)$', 2)) AS value FROM " + _LINES + ") WHERE label <> '' AND value <> ''")
def s24_s27_labelled_lines(spark, sf_dir):
    """`label: value` lines of the documents."""
    return X.labelled(_lines(spark, sf_dir), ["doc_id", "row"], "line")


@query(f"SELECT row_id, NOT (article IS NULL OR article IN ('', '-', '—', 'n/a')) AND NOT (qty IS NULL AND net_weight IS NULL AND amount IS NULL) AS usable FROM {_R}")
def p16_usable_rows(spark, sf_dir):
    c = F.col
    named = ~F.coalesce(c("article"), F.lit("")).isin("", "-", "—", "n/a")
    return B._rows(spark, sf_dir).select("row_id", (named & R.any_number(c("qty"), c("net_weight"), c("amount"))).alias("usable"))


@query("SELECT recon_id, loaded_at, coalesce(nullif(a, ''), nullif(m, ''), nullif(n, '')) AS picked FROM (SELECT recon_id, loaded_at, trim(article) AS a, trim(model) AS m, trim(normalized_article) AS n FROM reconciled_items)")
def p24_article_pick(spark, sf_dir):
    """The article of a row by the rank of the column it stands in."""
    items = table(spark, sf_dir, "reconciled_items")
    return items.select("recon_id", "loaded_at", X.first_filled(*(F.trim(c) for c in ("article", "model", "normalized_article"))).alias("picked"))


@query("SELECT row_id, CASE WHEN abs(a * b - c) <= greatest(0.05, 0.08 * abs(c)) THEN 'qty,price,amount' WHEN abs(a * c - b) <= greatest(0.05, 0.08 * abs(b)) THEN 'qty,amount,price' ELSE 'unclear' END AS meaning FROM (SELECT row_id, qty AS a, price AS b, amount AS c FROM " + _R + ") WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def p23_number_roles(spark, sf_dir):
    """What three untitled numbers mean, by which product holds within 8 %."""
    rows = B._rows(spark, sf_dir).where("qty is not null and price is not null and amount is not null")
    return rows.select("row_id", X.number_roles(F.col("qty"), F.col("price"), F.col("amount")).alias("meaning"))


@query("SELECT source, regexp_matches(lower(source), 'справочник|сводная|catalog|описание|tnved') AS catalog, count(*) AS n FROM extracted_sheets WHERE source IS NOT NULL GROUP BY 1, 2")
def p30_catalog_files(spark, sf_dir):
    names = table(spark, sf_dir, "extracted_sheets").where("source is not null")
    return names.groupBy("source", F.lower("source").rlike("справочник|сводная|catalog|описание|tnved").alias("catalog")).agg(F.count("*").alias("n"))


@query(f"SELECT s.row_id FROM {_R} s WHERE s.role = 'specification' AND s.k IS NOT NULL AND s.qty IS NOT NULL AND (s.kit_id, s.k) IN (SELECT kit_id, k FROM {_R} WHERE role = 'invoice' AND k IS NOT NULL GROUP BY 1, 2 HAVING max(qty) > 1.2 * 1) AND EXISTS (SELECT 1 FROM {_R} i WHERE i.role = 'invoice' AND i.kit_id = s.kit_id AND i.k = s.k AND i.qty > 1.2 * s.qty)")
def p33_placeholder_rows(spark, sf_dir):
    """Rows of a describing sheet whose quantity is well below the one already known of their article."""
    rows = B._rows(spark, sf_dir)
    known = rows.where("role = 'invoice' and k is not null").groupBy("kit_id", "k").agg(F.max("qty").alias("most"))
    return rows.where("role = 'specification' and qty is not null").join(known, ["kit_id", "k"]).where(F.col("most") > 1.2 * F.col("qty")).select("row_id")


@query(f"SELECT recon_id, loaded_at, CASE WHEN want IS NULL THEN true ELSE abs(amount - want) <= greatest(0.05, 0.02 * abs(want), 0.002 * abs(amount)) END AS plausible FROM (SELECT *, CAST(round(CAST(price * coalesce(qty, metres) AS DECIMAL(24,6)), 2) AS DOUBLE) AS want FROM {_JSON}) WHERE amount IS NOT NULL")
def p34_plausible_amounts(spark, sf_dir):
    f = _figures(spark, sf_dir).where("amount is not null")
    want = F.round((F.col("price") * F.coalesce("qty", "metres")).cast("decimal(24,6)"), 2).cast("double")
    near = F.abs(F.col("amount") - want) <= F.greatest(F.lit(0.05), F.abs(want) * 0.02, F.abs("amount") * 0.002)
    return f.select("recon_id", "loaded_at", F.coalesce(near, F.lit(True)).alias("plausible"))


@query("SELECT doc_id, CASE doc_type WHEN 'invoice' THEN 'invoice' WHEN 'packing_list' THEN 'packing_list' WHEN 'specification' THEN 'specification' END AS bucket FROM documents")
def p40_buckets(spark, sf_dir):
    kinds = ("invoice", "packing_list", "specification", "catalog", "permit")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_type").isin(*kinds), F.col("doc_type")).alias("bucket"))


@query(f"SELECT kit_id, CASE WHEN roles >= 2 OR books >= 2 THEN 'sheets' WHEN roles = 1 AND fabric >= greatest(2, 0.3 * n) THEN 'fabric' ELSE 'pieces' END AS profile FROM (SELECT kit_id, count(DISTINCT role) AS roles, count(DISTINCT CASE WHEN source LIKE '%.xls%' THEN source END) AS books, count(*) FILTER (unit = 'm') AS fabric, count(*) AS n FROM {_R} GROUP BY 1)")
def a23_profile(spark, sf_dir):
    """Several roles or workbooks, else by the share of goods in metres."""
    g = B._rows(spark, sf_dir).groupBy("kit_id").agg(F.count_distinct("role").alias("roles"), F.count_distinct(F.when(F.col("source").contains(".xls"), F.col("source"))).alias("books"), F.count(F.when(F.col("unit") == "m", 1)).alias("fabric"), F.count("*").alias("n"))
    return g.select("kit_id", F.when((F.col("roles") >= 2) | (F.col("books") >= 2), "sheets").when(F.col("fabric") >= F.greatest(F.lit(2.0), 0.3 * F.col("n")), "fabric").otherwise("pieces").alias("profile"))


@query("WITH l AS (SELECT DISTINCT ON (kit_id) * FROM kit_results ORDER BY kit_id, attempt DESC, finished_at DESC) SELECT kit_id, CASE WHEN coalesce(error, '') <> '' THEN 'ERROR' WHEN warning_count > 0 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status FROM l")
def a24_status(spark, sf_dir):
    last = table(spark, sf_dir, "kit_results").groupBy("kit_id").agg(F.max_by(F.struct("error", "warning_count"), F.struct("attempt", "finished_at")).alias("l")).select("kit_id", "l.*")
    return last.select("kit_id", F.when(F.coalesce("error", F.lit("")) != "", "ERROR").when(F.col("warning_count") > 0, "NEEDS_REVIEW").otherwise("READY").alias("status"))


@query(f"SELECT source, count(*) AS n_lines, count(*) FILTER (freight) AS n_freight, arg_min(model, CAST(line_no AS BIGINT) * 1000000000 + line_id) FILTER (model IS NOT NULL) AS first_model, count(DISTINCT vendor) AS vendors FROM {B._D} WHERE source IS NOT NULL GROUP BY 1")
def a29_document_summary(spark, sf_dir):
    lines = B._lines(spark, sf_dir).where("source is not null")
    first = F.min_by("model", F.when(F.col("model").isNotNull(), F.struct("line_no", "line_id")))
    return lines.groupBy("source").agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("freight"), 1)).alias("n_freight"), first.alias("first_model"), F.count_distinct("vendor").alias("vendors"))


@query(f"SELECT k, {_dec('CASE WHEN src = 1 THEN w END')} AS packing, {_dec('CASE WHEN src = 2 THEN w END')} AS specification, {_dec('CASE WHEN src = 3 THEN w END')} AS items FROM (SELECT k, CASE role WHEN 'packing' THEN 1 ELSE 2 END AS src, net_weight AS w FROM {_R} WHERE role IN ('packing', 'specification') UNION ALL SELECT k, 3, net_weight FROM {_I}) WHERE k IS NOT NULL GROUP BY k")
def a31_weight_probe(spark, sf_dir):
    """Weights of each article in packing, specification and items side by side; one aggregate over their union instead of outer joins."""
    rows = B._rows(spark, sf_dir).where("role in ('packing', 'specification')").select("k", F.col("role").alias("src"), "net_weight")
    both = rows.unionByName(B._items(spark, sf_dir).select("k", F.lit("items").alias("src"), "net_weight")).where("k is not null")
    return both.groupBy("k").agg(*(B._sum(F.when(F.col("src") == s, F.col("net_weight"))).alias(s) for s in ("packing", "specification", "items")))


@query("SELECT sheet_id, c AS col, f AS field, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY s DESC, f DESC, c DESC) AS INTEGER) AS place FROM (SELECT sheet_id, e.key AS c, e.value AS f, length(e.value) % 5 AS s FROM (SELECT sheet_id, unnest(map_entries(mapping)) AS e FROM (SELECT DISTINCT ON (sheet_id) * FROM extracted_sheets WHERE mapping IS NOT NULL ORDER BY sheet_id, loaded_at)))")
def o2_candidate_order(spark, sf_dir):
    """Candidates by score, field and column, all descending."""
    sheets = table(spark, sf_dir, "extracted_sheets").where("mapping is not null").groupBy("sheet_id").agg(F.min_by(F.map_entries("mapping"), "loaded_at").alias("m"))
    c = sheets.select("sheet_id", F.explode("m").alias("e")).select("sheet_id", F.col("e.key").alias("col"), F.col("e.value").alias("field"))
    w = Window.partitionBy("sheet_id").orderBy(F.desc(F.length("field") % 5), F.desc("field"), F.desc("col"))
    return c.select("sheet_id", "col", "field", F.row_number().over(w).alias("place"))


@query(f"SELECT kit_id, row_id, CAST(row_number() OVER (PARTITION BY kit_id ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, coalesce(qty, 0), row_id) AS INTEGER) AS place FROM (SELECT *, count(*) OVER (PARTITION BY kit_id, qty) AS n FROM {_R} WHERE role = 'packing')")
def o4_constrained_first(spark, sf_dir):
    """Packing rows with a quantity of their own first, then by quantity."""
    rows = B._rows(spark, sf_dir, "packing").withColumn("n", F.count("*").over(Window.partitionBy("kit_id", "qty")))
    w = Window.partitionBy("kit_id").orderBy(F.when(F.col("n") == 1, 0).otherwise(1), F.coalesce("qty", F.lit(0.0)), "row_id")
    return rows.select("kit_id", "row_id", F.row_number().over(w).alias("place"))


@query("SELECT 'line' AS kind, line_id AS id, model AS article, CAST(NULL AS VARCHAR) AS kit_id FROM doc_lines UNION ALL SELECT 'row', row_id, article, kit_id FROM extracted_rows UNION ALL SELECT 'item', item_id, article, NULL FROM canonical_items")
def u1_union_all(spark, sf_dir):
    """Three tables of goods one below the other; columns that one lacks are null."""
    lines = table(spark, sf_dir, "doc_lines").select(F.lit("line").alias("kind"), F.col("line_id").alias("id"), F.col("model").alias("article"))
    rows = table(spark, sf_dir, "extracted_rows").select(F.lit("row").alias("kind"), F.col("row_id").alias("id"), "article", "kit_id")
    items = table(spark, sf_dir, "canonical_items").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "article")
    return lines.unionByName(rows, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)


@query("SELECT item_id, loaded_at, qty, article FROM canonical_items")
def y3_json_safe(spark, sf_dir):
    """Items as JSON text and read again: dates, numbers and texts keep their values."""
    items = table(spark, sf_dir, "canonical_items").select("item_id", "loaded_at", F.to_json(F.struct("qty", "article", "loaded_at")).alias("j"))
    return items.select("item_id", "loaded_at", F.from_json("j", "qty double, article string").alias("v")).select("item_id", "loaded_at", "v.qty", "v.article")


@query(f"SELECT item_id, CASE WHEN qty IS NULL OR price IS NULL THEN NULL ELSE abs(amount - CAST(round(CAST(price * qty AS DECIMAL(24,6)), 2) AS DOUBLE)) <= 0.03 * greatest(abs(amount), 1) END AS holds FROM {_I} WHERE amount IS NOT NULL")
def a28_audit_amounts(spark, sf_dir):
    """Whether price times quantity gives each item's amount within 3 %."""
    items = B._items(spark, sf_dir).where("amount is not null")
    want = F.round((F.col("price") * F.col("qty")).cast("decimal(24,6)"), 2).cast("double")
    near = M.is_close(F.col("amount"), want, 0.03, 0.03)
    return items.select("item_id", F.when(F.col("qty").isNotNull() & F.col("price").isNotNull(), near).alias("holds"))


_SHEET = "PARTITION BY sheet_id ORDER BY row_no, row_id, loaded_at"


def _ordered():
    return Window.partitionBy("sheet_id").orderBy("row_no", "row_id", "loaded_at")


@query("SELECT item_id, sha256(concat_ws('|', article, color, description, hs_code, unit)) AS snapshot FROM canonical_items")
def y7_edit_snapshot(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").select("item_id", F.sha2(F.concat_ws("|", "article", "color", "description", "hs_code", "unit"), 256).alias("snapshot"))


@query("SELECT hs_code, count(DISTINCT description_en) > 1 AS conflict, CASE WHEN count(DISTINCT description_en) = 1 THEN min(description_en) END AS description, count(*) AS n FROM articles_ref GROUP BY hs_code")
def s29_catalog_index(spark, sf_dir):
    ref = table(spark, sf_dir, "articles_ref").groupBy("hs_code").agg(F.min("description_en").alias("lo"), F.max("description_en").alias("hi"), F.count("*").alias("n"))
    return ref.select("hs_code", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("description"), "n")


@query("SELECT item_key, item_id FROM (SELECT item_key, item_id, row_number() OVER (PARTITION BY item_key ORDER BY loaded_at, item_id) AS rn FROM canonical_items) WHERE rn = 1")
def s28_first_key_wins(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").groupBy("item_key").agg(F.min_by("item_id", F.struct("loaded_at", "item_id")).alias("item_id"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def u3_dedupe_by_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT DISTINCT hs_code FROM canonical_items WHERE hs_code IS NOT NULL INTERSECT SELECT hs_code FROM articles_ref")
def u5_common_codes(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").select("hs_code").where("hs_code is not null").distinct().join(table(spark, sf_dir, "articles_ref").select("hs_code"), "hs_code", "left_semi")


@query("SELECT sheet_id, max(n) >= 3 AND sum(n) >= 2 * count(*) AND NOT coalesce(bool_or(colours > 1), false) AND NOT bool_or(priced) AS detail, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_articles FROM (SELECT sheet_id, article, count(*) AS n, count(DISTINCT color) AS colours, role = 'packing' AND count(price) > 0 AS priced FROM extracted_rows WHERE article IS NOT NULL AND NOT is_group GROUP BY sheet_id, article, role) GROUP BY sheet_id")
def a4_detail_sheets(spark, sf_dir):
    """Sheets that list single rolls: articles repeat, but neither as colour lots nor as priced packing."""
    rows = table(spark, sf_dir, "extracted_rows").where("article is not null and not is_group")
    per = rows.groupBy("sheet_id", "article", "role").agg(F.count("*").alias("n"), F.min("color").alias("lo"), F.max("color").alias("hi"), F.count("price").alias("p"))
    lots, priced = F.max(F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).cast("int")) == 1, F.max(((F.col("role") == "packing") & (F.col("p") > 0)).cast("int")) == 1
    return per.groupBy("sheet_id").agg(((F.max("n") >= 3) & (F.sum("n") >= 2 * F.count("*")) & ~lots & ~priced).alias("detail"), F.sum("n").alias("n_rows"), F.count("*").alias("n_articles"))


@query("SELECT kit_id, count(*) >= 2 AND count(hs_code) >= 0.6 * count(*) AND count(color) <= 0.25 * count(*) AS coded, count(CASE WHEN unit = 'm' THEN 1 END) >= greatest(2, 0.3 * count(*)) AS fabric FROM extracted_rows WHERE NOT is_group GROUP BY kit_id")
def a22_layout(spark, sf_dir):
    n, count = F.count("*"), lambda c: F.count(F.when(c, 1))
    rows = table(spark, sf_dir, "extracted_rows").where("not is_group")
    return rows.groupBy("kit_id").agg(((n >= 2) & (F.count("hs_code") >= 0.6 * n) & (F.count("color") <= 0.25 * n)).alias("coded"), (count(F.col("unit") == "m") >= F.greatest(F.lit(2.0), 0.3 * n)).alias("fabric"))


@query("SELECT DISTINCT item_id, f.field_name, f.error_type, f.severity, f.message FROM (SELECT item_id, unnest(flags) AS f FROM canonical_items)")
def a25_flag_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").select("item_id", F.inline("flags")).dropDuplicates()


@query(f"SELECT sheet_id, segment, count(*) AS n_rows, CAST(sum(CAST(qty AS DECIMAL(18,4))) AS DOUBLE) AS qty FROM (SELECT sheet_id, qty, CAST(sum(CASE WHEN is_group THEN 1 ELSE 0 END) OVER ({_SHEET}) AS BIGINT) AS segment FROM extracted_rows) GROUP BY sheet_id, segment")
def w2_caption_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "extracted_rows").withColumn("segment", F.sum(F.coalesce("is_group", F.lit(False)).cast("bigint")).over(_ordered()))
    return rows.groupBy("sheet_id", "segment").agg(F.count("*").alias("n_rows"), F.sum(F.col("qty").cast("decimal(18,4)")).cast("double").alias("qty"))


@query(f"SELECT row_id, loaded_at, CAST(row_number() OVER ({_SHEET}) AS INTEGER) AS no FROM extracted_rows")
def w9_running_number(spark, sf_dir):
    return table(spark, sf_dir, "extracted_rows").select("row_id", "loaded_at", F.row_number().over(_ordered()).alias("no"))


@query(f"SELECT sheet_id, row_id, row_no FROM (SELECT sheet_id, row_id, row_no, row_number() OVER ({_SHEET}) AS rn FROM extracted_rows) WHERE rn <= 20")
def o7_first_rows(spark, sf_dir):
    """The first 20 rows of each sheet, which the column profile samples; the limit is the feature."""
    return table(spark, sf_dir, "extracted_rows").select("sheet_id", "row_id", "row_no", F.row_number().over(_ordered()).alias("rn")).where("rn <= 20").drop("rn")


@query("SELECT kit_id, row_id, loaded_at, CAST(row_number() OVER (PARTITION BY kit_id ORDER BY coalesce(item_no, 999), row_id, loaded_at) AS INTEGER) AS place FROM extracted_rows WHERE NOT is_group")
def o1_p37_product_order(spark, sf_dir):
    w = Window.partitionBy("kit_id").orderBy(F.coalesce("item_no", F.lit(999)), "row_id", "loaded_at")
    return table(spark, sf_dir, "extracted_rows").where("not is_group").select("kit_id", "row_id", "loaded_at", F.row_number().over(w).alias("place"))


@query("SELECT item_key, max(CASE WHEN rn = 1 THEN country END) AS first_country, max(CASE WHEN rn = 2 THEN country END) AS second_country FROM (SELECT item_key, country, row_number() OVER (PARTITION BY item_key ORDER BY count(*) DESC, country) AS rn FROM canonical_items WHERE country IS NOT NULL GROUP BY item_key, country) WHERE rn <= 2 GROUP BY item_key")
def o8_top_two(spark, sf_dir):
    """First and second of each article's countries by votes, from a sorted array of its few counts instead of a window."""
    votes = table(spark, sf_dir, "canonical_items").where("country is not null").groupBy("item_key", "country").agg((-F.count("*")).alias("n"))
    top = votes.groupBy("item_key").agg(F.array_sort(F.collect_list(F.struct("n", "country"))).alias("v"))
    return top.select("item_key", F.get("v", F.lit(0))["country"].alias("first_country"), F.get("v", F.lit(1))["country"].alias("second_country"))


@query("SELECT item_id, CASE WHEN hs_code IS NULL AND description IS NULL THEN 'both' WHEN hs_code IS NULL THEN 'code' ELSE 'description' END AS missing FROM canonical_items WHERE hs_code IS NULL OR description IS NULL")
def v4_missing_code(spark, sf_dir):
    lack = F.concat_ws("+", F.when(F.col("hs_code").isNull(), "code"), F.when(F.col("description").isNull(), "description"))
    items = table(spark, sf_dir, "canonical_items").select("item_id", lack.alias("missing")).where("missing != ''")
    return items.select("item_id", F.when(F.col("missing") == "code+description", "both").otherwise(F.col("missing")).alias("missing"))


@query("SELECT item_id, loaded_at, len(list_filter(flags, lambda f: f.severity = 'RED')) > 0 AS red, CAST(len(flags) AS INTEGER) AS n FROM canonical_items WHERE flags IS NOT NULL")
def v15_item_severity(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").where("flags is not null").select("item_id", "loaded_at", F.exists("flags", lambda f: f["severity"] == "RED").alias("red"), F.size("flags").alias("n"))
