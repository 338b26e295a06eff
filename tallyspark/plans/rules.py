"""Queries of the predicates, classifiers and votes over whole test tables; the SQL beside each is written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import sheets as S
from ..operators import votes as V
from ..sources.tables import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_WORD = "(model|series|art\\.?|article|артикул|арт\\.?|item|design|code|description|qty|quantity|netto|brutto|weight|origin|brand|серия|модель)"
_PLACES = " OR ".join(f"contains(l, '{p}')" for p in R.PLACES)
_PLAUSIBLE = rf"""t <> '' AND length(t) <= 60 AND len(string_split(t, ' ')) <= 6 AND NOT regexp_full_match(l, '(?i){_WORD}([\s,/]+{_WORD})*\.?') AND NOT regexp_matches(l, 'new order|total roll|^bank|^total|^итого| total|^l\d\d\d\d\d\d|artikel\s*\d+\s*top|^[tf]\.\+?\d') AND NOT contains(t, ':') AND NOT contains(t, '@') AND NOT contains(t, '\') AND len(string_split(t, '*')) <= 2 AND NOT contains(replace(t, ' ', ''), '+90') AND NOT ({_PLACES}) AND (regexp_matches(t, '\pL') OR regexp_full_match(regexp_replace(t, '[\s\-./]', '', 'g'), '\d\d\d\d+'))"""
_ARTICLES = r"(SELECT row_id, loaded_at, t, lower(t) AS l FROM (SELECT row_id, loaded_at, trim(regexp_replace(regexp_replace(article, '[\x00-\x1f\x7f]', '', 'g'), '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS t FROM extracted_rows))"


@query(f"SELECT row_id, loaded_at, coalesce({_PLAUSIBLE}, false) AS plausible FROM {_ARTICLES}")
def p14_plausible_article(spark, sf_dir):
    return table(spark, sf_dir, "extracted_rows").select("row_id", "loaded_at", R.plausible_article(F.col("article")).alias("plausible"))


@query(rf"SELECT row_id, loaded_at, coalesce(regexp_full_match(lower(trim(article)), '([-–—−.…]|n/?a|n\.\s*a\.?|none|null|nil|нет|б/?н|без\s*арт.*|no\s*art.*|w/?o|tbd|xxx+|отсутств.*|absent|missing|not\s+available)'), false) AS blank FROM extracted_rows")
def p13_blank_sku(spark, sf_dir):
    return table(spark, sf_dir, "extracted_rows").select("row_id", "loaded_at", F.coalesce(F.trim("article").rlike(R.BLANKS), F.lit(False)).alias("blank"))


@query("SELECT row_id, loaded_at, coalesce(abs(qty), 0) < 1e9 AND coalesce(abs(rolls), 0) < 1e9 AND coalesce(abs(price), 0) < 1e9 AND coalesce(abs(amount), 0) < 1e8 AS sane, NOT (qty IS NULL AND price IS NULL AND amount IS NULL AND net_weight IS NULL AND gross_weight IS NULL AND rolls IS NULL) AS measured FROM extracted_rows")
def p15_p18_numbers(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "extracted_rows").select("row_id", "loaded_at", R.sane_numbers(c("qty"), c("rolls"), c("price"), c("amount")).alias("sane"), R.any_number(*map(c, ("qty", "price", "amount", "net_weight", "gross_weight", "rolls"))).alias("measured"))


@query(r"SELECT line_id, loaded_at, coalesce(length(model) <= 48 AND (regexp_full_match(model, '\s*(\([^)]*\)|[A-Za-z]|\d{3,6} +[sS]pecial +[oO]rder)\s*') OR regexp_full_match(model, '[A-Za-z0-9]{1,12}([._/-][A-Za-z0-9]{1,12}){1,4}')), false) AS note FROM (SELECT line_id, loaded_at, trim(model) AS model FROM doc_lines WHERE NOT regexp_matches(coalesce(model, ''), '[\x00-\x1f\x7f]'))")
def p17_mill_notes(spark, sf_dir):
    lines = table(spark, sf_dir, "doc_lines").where(~F.coalesce("model", F.lit("")).rlike("[\\x00-\\x1f\\x7f]"))
    return lines.select("line_id", "loaded_at", R.is_note(F.col("model")).alias("note"))


_TITLE = r"(SELECT sheet_id, loaded_at, i - 1 AS col, lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) AS t FROM (SELECT sheet_id, loaded_at, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT sheet_id, loaded_at, string_split(header_text, ' | ') AS l FROM extracted_sheets WHERE header_text IS NOT NULL)))"
_PHRASES = " UNION ALL ".join(f"SELECT {n} AS n, '{name}' AS name, '{p}' AS p" for n, (name, ps) in enumerate(R.COLUMN_PHRASES) for p in ps.split("|"))


@query(f"SELECT sheet_id, loaded_at, CAST(col AS INTEGER) AS col, CASE WHEN t IN ('net', 'n.w', 'nw', 'нетто') THEN 'net' WHEN t IN ('gross', 'g.w', 'gw', 'брутто') THEN 'gross' WHEN replace(t, ' ', '') IN ('measure', 'measurement') OR contains(t, 'cbm') THEN 'volume' ELSE (SELECT arg_min(name, n) FROM ({_PHRASES}) WHERE contains(t, p)) END AS means FROM {_TITLE}")
def p25_simple_columns(spark, sf_dir):
    sheets = table(spark, sf_dir, "extracted_sheets").where("header_text is not null").select("sheet_id", "loaded_at", "header_text").distinct()
    return sheets.select("sheet_id", "loaded_at", F.posexplode(F.split("header_text", r" \| ")).alias("col", "v")).select("sheet_id", "loaded_at", "col", R.column_of(F.col("v")).alias("means"))


@query("SELECT line_id, loaded_at, coalesce(contains(lower(description), 'freight') OR contains(lower(description), 'перевоз'), false) AS freight_text, coalesce(freight, false) AS freight FROM doc_lines")
def p26_freight_lines(spark, sf_dir):
    return table(spark, sf_dir, "doc_lines").select("line_id", "loaded_at", R.is_freight(F.col("description")).alias("freight_text"), F.coalesce("freight", F.lit(False)).alias("freight"))


@query("SELECT doc_id, CASE WHEN contains(h, 'ПРИЛОЖЕНИЕ К ИНВОЙСУ') OR upper(source) = 'ГТД' THEN 'customs_appendix' WHEN contains(h, 'ЧЕРНОВИК') THEN 'draft' WHEN contains(h, 'ФОРМА ДЛЯ ГТД') THEN 'gtd_form' WHEN contains(h, 'PACKING LIST') OR contains(h, 'УПАКОВОЧНЫЙ') THEN 'packing' WHEN contains(h, 'СПЕЦИФИКАЦ') OR contains(h, 'SPECIFICATION') THEN 'specification' WHEN contains(h, 'INVOICE') OR contains(h, 'СЧЕТ-ФАКТУРА') OR contains(h, 'ИНВОЙС') THEN 'invoice' ELSE 'unknown' END AS role FROM (SELECT doc_id, source, upper(concat_ws(chr(10), source, text)) AS h FROM documents)")
def p27_paper_role(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.paper_role(F.col("source"), F.col("text")).alias("role"))


@query("SELECT source, CASE WHEN contains(u, 'INVOICE') OR contains(u, 'ИНВОЙС') OR regexp_matches(s, '[_ -]CI$') THEN 'invoice' WHEN regexp_matches(u, '-PL|_PL\\.|PACKING|ПАКИНГ|УПАКОВ') OR ends_with(u, 'PL.XLSX') OR ends_with(u, 'PL.PDF') OR regexp_matches(s, '[_-]PL$') THEN 'packing' WHEN contains(u, 'SPEC') OR contains(u, 'СПЕЦИФ') THEN 'specification' END AS role, n FROM (SELECT source, upper(source) AS u, regexp_replace(upper(source), '\\.[^.]*$', '') AS s, count(*) AS n FROM extracted_sheets WHERE source IS NOT NULL GROUP BY 1)".replace("\\\\", "\\"))
def p29_file_role(spark, sf_dir):
    names = table(spark, sf_dir, "extracted_sheets").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return names.select("source", R.file_role(F.col("source")).alias("role"), "n")


_KITS = r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(' ' || t || ' ', '([^\pL\pN_]+)', ' \1 ', 'g'), '[\pL\pN_]+ - [\pL\pN_]+'), lambda w: regexp_full_match(w, '\d{2,4} - \d')), lambda w: replace(w, ' ', ''))))"


@query(r"SELECT doc_id, len(k) > 1 AS several, array_to_string(k, ',') AS kits FROM (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '[^\pL\pN_-]', ' ', 'g'), ' +'), lambda w: regexp_full_match(w, '\d{2,4}-\d')))) AS k FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '\d-\d+-|-\d{2,4}-\d|[^\pL\pN_ .,:;()/]-?\d{2,4}-\d|\d{2,4}-\d-'))")
def p31_kit_tokens(spark, sf_dir):
    """Kit tokens of texts in which no token stands in a longer chain of hyphens, and whether there are several."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"\d-\d+-|-\d{2,4}-\d|[^\p{L}\p{N}_ .,:;()/]-?\d{2,4}-\d|\d{2,4}-\d-"))
    k = R.kit_tokens(F.col("text"))
    return docs.select("doc_id", (F.size(k) > 1).alias("several"), F.array_join(k, ",").alias("kits"))


@query("SELECT kit_id, attempt, CASE WHEN coalesce(error, '') <> '' THEN 'skipped' WHEN warning_count > 0 THEN 'review' ELSE 'ok' END AS status FROM kit_results")
def p32_parse_status(spark, sf_dir):
    return table(spark, sf_dir, "kit_results").select("kit_id", "attempt", R.parse_status(F.col("error"), F.col("warning_count")).alias("status"))


@query("WITH d AS (SELECT i.item_id, lower(trim(r.description_ru)) AS a, lower(trim(i.description)) AS d FROM canonical_items i JOIN articles_ref r ON i.article = r.article) SELECT item_id, coalesce(length(a) >= 4 AND a <> d AND NOT regexp_matches(a, '[a-z0-9]') AND contains(d, a) AND length(a) < 0.75 * length(d), false) AS fragment, count(*) AS n FROM d GROUP BY 1, 2")
def p35_fragments(spark, sf_dir):
    ref = table(spark, sf_dir, "articles_ref").select("article", "description_ru")
    items = table(spark, sf_dir, "canonical_items").join(ref, "article")
    return items.groupBy("item_id", R.is_fragment(F.col("description_ru"), F.col("description")).alias("fragment")).agg(F.count("*").alias("n"))


@query(r"SELECT article, a AS peeled, c AS color, 'artificial leather of fine grain' AS rest FROM (SELECT article, regexp_extract(article, '^([A-Za-z][A-Za-z0-9][A-Za-z0-9._/-]+) (\d{2,4})$', 1) AS a, regexp_extract(article, '^([A-Za-z][A-Za-z0-9][A-Za-z0-9._/-]+) (\d{2,4})$', 2) AS c FROM articles_ref) WHERE a <> '' AND length(a) <= 27 AND lower(a) NOT IN ('art', 'item', 'code', 'model')")
def p35_peeled(spark, sf_dir):
    ref = table(spark, sf_dir, "articles_ref").where(F.col("article").rlike("^[A-Za-z][A-Za-z0-9][A-Za-z0-9._/-]+ \\d{2,4}$"))
    got = ref.select("article", R.peeled(F.concat_ws(" ", "article", F.lit("artificial leather of fine grain"))).alias("p")).where("p is not null")
    return got.select("article", F.col("p.article").alias("peeled"), "p.color", "p.rest")


_TIMES = "CAST((length(t) - length(replace(t, '{w}', ''))) / length('{w}') AS INTEGER)"
_SCORES = ", ".join("(" + " + ".join(_TIMES.format(w=w) for w in words) + f") AS {r}" for r, words in R.ROLE_WORDS.items())


@query(f"SELECT doc_id, CASE WHEN best >= 1 AND best > second THEN CASE WHEN invoice = best THEN 'invoice' WHEN packing = best THEN CASE WHEN contains(t, 'invoice') THEN 'mixed' ELSE 'packing' END WHEN specification = best THEN 'specification' ELSE 'catalog' END ELSE 'invoice' END AS role FROM (SELECT *, list_sort([invoice, packing, specification, catalog])[4] AS best, list_sort([invoice, packing, specification, catalog])[3] AS second FROM (SELECT doc_id, t, {_SCORES} FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)))")
def a14_role_votes(spark, sf_dir):
    """Roles of priced papers by how often their words come."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    yes, no = F.lit(True), F.lit(False)
    return docs.select("doc_id", R.role_by_words(F.col("text"), yes, no, no, yes).alias("role"))


def _phrase(w: str) -> str:
    if " " in w or not w.isascii():
        return f"CAST((length(t) - length(replace(t, '{w}', ''))) / length('{w}') AS INTEGER)"
    return f"len(list_filter(words, lambda x: x = '{w}'))"


_KINDS = ", ".join("round(" + " + ".join(f"least({_phrase(w)}, 5) * {x}" for w, x in words) + f", 6) AS {k}" for k, words in R.DOCUMENT_WORDS.items())
_FIVE = "[" + ", ".join(R.DOCUMENT_WORDS) + "]"


@query(rf"SELECT doc_id, CASE WHEN best >= 2.5 AND round(best - second, 6) >= 0.8 THEN CASE " + " ".join(f"WHEN {k} = best THEN '{k}'" for k in R.DOCUMENT_WORDS) + rf" END END AS kind FROM (SELECT *, list_sort({_FIVE})[5] AS best, list_sort({_FIVE})[4] AS second FROM (SELECT doc_id, {_KINDS} FROM (SELECT doc_id, t, regexp_split_to_array(t, '[^\pL\pN_]+') AS words FROM (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(replace(text, 'İ', 'i' || chr(775)), '[\x00-\x1f\x7f]', '', 'g'), '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))) AS t FROM documents WHERE text IS NOT NULL))))")
def p28_document_kind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lower(T.plain(F.col("text"))).alias("low"))
    scored = docs.select("doc_id", *(s.alias(k) for k, s in R.document_scores(F.col("low")).items()))
    return scored.select("doc_id", R.best_kind({k: F.col(k) for k in R.DOCUMENT_WORDS}).alias("kind"))


@query("SELECT DISTINCT vendor, coalesce(regexp_full_match(lower(trim(split_part(vendor, ':', 1))), '(the )?(buyer|seller|recipient|consignee|shipper|exporter|manufacturer|delivery|address|add)'), false) AS role_only FROM doc_lines WHERE vendor IS NOT NULL AND NOT contains(vendor, '：')")
def p42_role_only(spark, sf_dir):
    return table(spark, sf_dir, "doc_lines").where("vendor is not null and not contains(vendor, '：')").select("vendor", R.is_role_only(F.col("vendor")).alias("role_only")).distinct()


@query("SELECT item_id, loaded_at, CASE WHEN qty IS NOT NULL AND qty <> 0 THEN qty WHEN net_weight IS NOT NULL AND net_weight <> 0 THEN net_weight END AS measure, CASE WHEN coalesce(hs_code, '') <> '' THEN hs_code ELSE '' END AS code FROM canonical_items")
def p41_fallbacks(spark, sf_dir):
    from ..functions import money as M

    return table(spark, sf_dir, "canonical_items").select("item_id", "loaded_at", M.basis(F.col("qty"), F.col("net_weight")).alias("measure"), F.coalesce("hs_code", F.lit("")).alias("code"))


@query("SELECT kit_id, bool_or(role = 'invoice') AND bool_or(role = 'packing') AS whole, count(DISTINCT role) AS roles FROM extracted_sheets WHERE kit_id IS NOT NULL GROUP BY 1")
def p43_kit_roles(spark, sf_dir):
    kits = table(spark, sf_dir, "extracted_sheets").where("kit_id is not null").groupBy("kit_id").agg(F.collect_set("role").alias("r"))
    return kits.select("kit_id", (F.array_contains("r", "invoice") & F.array_contains("r", "packing")).alias("whole"), F.size("r").cast("bigint").alias("roles"))


# --- votes ------------------------------------------------------------------------------------------------------------
_NORM = r"""lower(regexp_replace(manufacturer, '[\s\x{00a0}"“”''.,]', '', 'g'))"""
_VOTES = f"(SELECT item_key AS g, manufacturer AS v, {_NORM} AS n FROM canonical_items WHERE manufacturer IS NOT NULL)"


@query(
    f"WITH b AS (SELECT g, n, count(*) AS c, min(v) AS v FROM {_VOTES} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, n) AS rn, count(*) OVER (PARTITION BY g) AS kinds, nth_value(c, 2) OVER (PARTITION BY g ORDER BY c DESC, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next FROM b), a AS (SELECT g, v FROM r WHERE rn = 1 AND (kinds = 1 OR c > next)), "
    f"l AS (SELECT g, arg_max(v, length(v) * 1000000 + 0) AS v, arg_max(n, length(v)) AS n FROM (SELECT DISTINCT ON (g, length(v)) * FROM {_VOTES} ORDER BY g, length(v), v) GROUP BY g), p AS (SELECT l.g, l.v FROM l WHERE NOT EXISTS (SELECT 1 FROM {_VOTES} x WHERE x.g = l.g AND NOT contains(l.n, x.n))) SELECT coalesce(a.g, p.g) AS item_key, coalesce(a.v, p.v) AS manufacturer FROM a FULL JOIN p ON a.g = p.g"
)
def a18_party_vote(spark, sf_dir):
    return V.party(table(spark, sf_dir, "canonical_items"), ["item_key"], "manufacturer")


_TERM = "CASE currency WHEN 'USD' THEN 'FOB ' WHEN 'EUR' THEN 'fca ' ELSE 'DAP ' END || coalesce(color, 'Порт')"


@query(f"WITH v AS (SELECT kit_id, {_TERM} AS x FROM extracted_rows WHERE kit_id IS NOT NULL AND currency IS NOT NULL), c AS (SELECT kit_id, upper(left(x, 3)) AS code, count(*) AS n, max(length(regexp_replace(x, '[^A-Za-z]', '', 'g')) / length(regexp_replace(x, '[^\\pL]', '', 'g'))) AS latin FROM v GROUP BY 1, 2) SELECT kit_id, code, n FROM c QUALIFY row_number() OVER (PARTITION BY kit_id ORDER BY n DESC, latin DESC, code) = 1")
def a19_incoterm_vote(spark, sf_dir):
    """Delivery terms made from currency and colour, voted on for each shipment."""
    rows = table(spark, sf_dir, "extracted_rows").where("kit_id is not null and currency is not null").select("kit_id", F.expr(_TERM).alias("term"))
    return V.incoterm(rows, ["kit_id"], "term").select("kit_id", "code", "n")


@query("SELECT kit_id, CASE WHEN count(DISTINCT upper(replace(hs_code, ' ', ''))) = 1 THEN min(hs_code) END AS code, CASE WHEN count(DISTINCT currency) = 1 THEN min(currency) END AS currency FROM extracted_rows WHERE kit_id IS NOT NULL GROUP BY 1")
def n17_collapsed_fields(spark, sf_dir):
    """Two fields of every shipment by unanimous vote, one pass."""
    return V.collapsed(table(spark, sf_dir, "extracted_rows").where("kit_id is not null"), ["kit_id"], {"hs_code": F.upper(F.replace("hs_code", F.lit(" "), F.lit(""))), "currency": F.col("currency")}).withColumnRenamed("hs_code", "code")


_STREET = "(SELECT DISTINCT kit_id, 'Mill road ' || CASE WHEN role = 'invoice' THEN article ELSE split_part(article, ' ', 1) END AS x FROM extracted_rows WHERE kit_id IS NOT NULL AND article IS NOT NULL)"


@query(rf"WITH a AS (SELECT kit_id, k, min(trim(x)) AS x FROM (SELECT *, lower(regexp_replace(regexp_replace(x, '[\x00-\x1f\x7f]', '', 'g'), '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}},.;:\"''“”«»/\\-]', '', 'g')) AS k FROM {_STREET}) GROUP BY 1, 2), kept AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.kit_id = a.kit_id AND b.k <> a.k AND contains(b.k, a.k))) SELECT kit_id, min(x) AS address FROM kept GROUP BY 1 HAVING count(*) = 1".replace('\"', '"'))
def a17_address_vote(spark, sf_dir):
    """Addresses made from the articles of a shipment, long and short, drawn to one where one contains the others."""
    street = F.concat(F.lit("Mill road "), F.when(F.col("role") == "invoice", F.col("article")).otherwise(F.split_part("article", F.lit(" "), F.lit(1))))
    rows = table(spark, sf_dir, "extracted_rows").where("kit_id is not null and article is not null").select("kit_id", street.alias("address"))
    return V.address(rows, ["kit_id"], "address")


@query()
def sp1_mapped_columns(spark, sf_dir):
    """What the columns of the header rows mean by title fragments alone; tested on grids."""
    sheets = table(spark, sf_dir, "extracted_sheets").where("header_text is not null").groupBy("sheet_id").agg(F.min("header_text").alias("t"))
    cells = sheets.select("sheet_id", F.lit(0).alias("row"), F.posexplode(F.split("t", r" \| ")).alias("col", "v"))
    return S.mapped_columns(cells, ["sheet_id"])


_GRID = ["item_no", "article", "color", "qty", "unit", "price", "amount", "net_weight", "gross_weight"]


def _extracted(spark, sf_dir):
    titles = ["No", "Art No.", "Colour", "Quantity", "Unit", "Unit price", "Amount", "Net weight", "Gross weight"]
    rows = table(spark, sf_dir, "extracted_rows").where("sheet_id is not null and role = 'invoice' and not is_group").dropDuplicates(["row_id"])
    body = rows.select("sheet_id", (F.col("row_no") + 1).alias("row"), "row_id", F.posexplode(F.array(*(F.col(c).cast("string") for c in _GRID))).alias("col", "v"))
    body = body.groupBy("sheet_id", "row", "col").agg(F.min_by("v", "row_id").alias("v"))
    heads = rows.select("sheet_id").distinct().select("sheet_id", F.lit(0).alias("row"), F.posexplode(F.array(*map(F.lit, titles))).alias("col", "v"))
    return S.extract_sheets(body.unionByName(heads), ["sheet_id"])


@query()
def sp10_extracted_goods(spark, sf_dir):
    return _extracted(spark, sf_dir)
