"""Queries of the text, number and money functions over whole test tables; the SQL beside each is written on its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import money as M
from ..functions import text as T
from ..sources.tables import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_WS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), '{_WS}', ' ', 'g')) AS normal FROM documents")
def n4_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.plain(F.col("text")).alias("normal"))


@query()
def n4_nfkc(spark, sf_dir):
    """Compatibility composition first; SQL has none."""
    return table(spark, sf_dir, "documents").select("doc_id", T.plain(T.nfkc("text")).alias("normal"))


@query("SELECT item_id, loaded_at, rtrim(left(d, length(d) - length(article) - 3)) AS category, trim(article) AS sku FROM (SELECT *, description || ' / ' || article AS d FROM canonical_items WHERE description IS NOT NULL AND length(article) >= 2 AND NOT contains(article, '/'))")
def n5_split_design(spark, sf_dir):
    items = table(spark, sf_dir, "canonical_items").where("description is not null and length(article) >= 2 and not contains(article, '/')")
    return items.select("item_id", "loaded_at", T.split_design(F.concat_ws(" / ", "description", "article")).alias("d")).select("item_id", "loaded_at", "d.category", "d.sku")


@query("SELECT article, CASE WHEN starts_with(lower(description_en), 'artificial leather') THEN trim(article) ELSE description_en || ' ' || trim(article) END AS label FROM articles_ref")
def n6_family_label(spark, sf_dir):
    ref = table(spark, sf_dir, "articles_ref")
    return ref.select("article", T.family_label(F.concat_ws(" ", "description_en", F.trim("article"))).alias("label"))


@query("SELECT item_id, loaded_at, CASE WHEN trim(coalesce(color, '')) = '' THEN article WHEN list_contains(string_split(upper(article), ' '), upper(trim(color))) OR contains(' ' || upper(article) || ' ', ' ' || upper(trim(color)) || ' ') THEN article ELSE article || ' ' || trim(color) END AS label FROM canonical_items WHERE article IS NOT NULL")
def n7_article_with_color(spark, sf_dir):
    items = table(spark, sf_dir, "canonical_items").where("article is not null")
    return items.select("item_id", "loaded_at", T.with_color(F.col("article"), F.col("color")).alias("label"))


@query(r"SELECT item_id, loaded_at, CASE WHEN contains(d, ' / ') THEN string_split(d, ' / ')[1] WHEN NOT regexp_matches(d, '[А-Яа-яЁё]') THEN d END AS en, CASE WHEN contains(d, ' / ') THEN string_split(d, ' / ')[2] WHEN regexp_matches(d, '[А-Яа-яЁё]') THEN d END AS ru FROM (SELECT item_id, loaded_at, trim(description) AS d FROM canonical_items)")
def n8_bilingual(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").select("item_id", "loaded_at", T.bilingual(F.col("description")).alias("d")).select("item_id", "loaded_at", "d.en", "d.ru")


@query("SELECT article, description_en || ' / ' || description_ru AS description, description_ru || '//' || description_en AS turned, description_en AS en FROM articles_ref")
def n9_description_join(spark, sf_dir):
    ref = table(spark, sf_dir, "articles_ref").withColumn("turned", F.concat_ws("//", "description_ru", "description_en"))
    return ref.select("article", T.joined(F.col("description_en"), F.col("description_ru")).alias("description"), "turned", T.bilingual(F.col("turned"))["en"].alias("en"))


@query("SELECT line_id, loaded_at, translate(model, 'АВЕКМНОРСТУХавекмнорстух', 'ABEKMHOPCTYXabekmhopctyx') AS folded FROM doc_lines")
def n10_fold_print(spark, sf_dir):
    return table(spark, sf_dir, "doc_lines").select("line_id", "loaded_at", K.fold_print(F.col("model")).alias("folded"))


@query("SELECT article, replace(article, ' ', '') || CASE WHEN length(replace(article, ' ', '')) < 4 THEN '' ELSE ' total' END AS drawn FROM articles_ref WHERE length(replace(article, ' ', '')) >= 4")
def n11_collapse_spacing(spark, sf_dir):
    ref = table(spark, sf_dir, "articles_ref").where("length(replace(article, ' ', '')) >= 4")
    spaced = F.concat(F.regexp_replace(F.replace(F.col("article"), F.lit(" "), F.lit("")), "(.)", "$1 "), F.lit("total"))
    return ref.select("article", T.unspaced(spaced).alias("drawn"))


@query(r"""SELECT vendor, lower(regexp_replace(vendor, '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}"“”''.,]', '', 'g')) AS name_key, lower(regexp_replace(vendor, '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000},.;:"''“”«»/\\-]', '', 'g')) AS address_key, count(*) AS n FROM doc_lines WHERE vendor IS NOT NULL AND NOT regexp_matches(vendor, '[\x00-\x1f\x7f]') GROUP BY vendor""")
def n12_comparison_keys(spark, sf_dir):
    v = table(spark, sf_dir, "doc_lines").where(F.col("vendor").isNotNull() & ~F.col("vendor").rlike("[\\x00-\\x1f\\x7f]")).groupBy("vendor").agg(F.count("*").alias("n"))
    return v.select("vendor", T.loose_key(F.col("vendor")).alias("name_key"), T.address_key(F.col("vendor")).alias("address_key"), "n")


@query(r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[А-Яа-яЁёІіЇїЄєҐґ]') THEN 'cyrillic' END, CASE WHEN regexp_matches(text, '[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}]') THEN 'cjk' END, CASE WHEN regexp_matches(text, '[\x{0600}-\x{06ff}]') THEN 'arabic' END, CASE WHEN regexp_matches(text, '[\x{ac00}-\x{d7af}]') THEN 'hangul' END, CASE WHEN regexp_matches(text, '[A-Za-zİıŞşĞğÇçÖöÜü]') THEN 'latin' END], lambda x: x IS NOT NULL), ',') AS scripts FROM documents WHERE text IS NOT NULL")
def n13_script_list(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(T.scripts(F.col("text")), ",").alias("scripts"))


@query(r"""SELECT sheet_id, loaded_at, CASE WHEN s = '' THEN 'shipment' ELSE s END AS stem FROM (SELECT sheet_id, loaded_at, rtrim(left(trim(regexp_replace(regexp_replace(source || ' : ' || name, '[<>:"/\\|?*]+', '_', 'g'), '\s+', ' ', 'g')), 80), '. ') AS s FROM extracted_sheets WHERE source IS NOT NULL AND name IS NOT NULL)""")
def n20_file_stem(spark, sf_dir):
    sheets = table(spark, sf_dir, "extracted_sheets").where("source is not null and name is not null")
    return sheets.select("sheet_id", "loaded_at", T.file_stem(F.concat_ws(" : ", "source", "name")).alias("stem"))


@query(r"SELECT doc_id, nullif(regexp_replace(regexp_extract(text, '(?:ИНВОЙС|INVOICE|FATTURA|FAKTURA) (?:No\.? |Nr\.? |№ ?|# ?)?([0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё./_-]*[0-9][0-9A-Za-zА-Яа-яЁё./_-]*)', 1), '[./_-]+$', ''), '') AS invoice_no FROM documents")
def n23_invoice_number(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    raw = F.regexp_extract("text", r"(?:ИНВОЙС|INVOICE|FATTURA|FAKTURA) ((?:No\.? |Nr\.? |№ ?|# ?)?[0-9A-Za-zА-Яа-яЁё][0-9A-Za-zА-Яа-яЁё./_-]*[0-9][0-9A-Za-zА-Яа-яЁё./_-]*)", 1)
    return docs.select("doc_id", T.numbered(F.when(F.col("text").isNotNull(), raw)).alias("invoice_no"))


@query(r"SELECT doc_id, nullif(regexp_extract(' ' || text || ' ', '[^0-9-]([0-9][0-9][0-9]?[0-9]?-[0-9])[^0-9-]', 1), '') AS subkit FROM documents")
def n24_subkit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.subkit(F.col("text")).alias("subkit"))


@query("SELECT item_id, loaded_at, CASE WHEN trim(coalesce(description, '')) = '' THEN split_part(article, ' ', 1) ELSE trim(description) || chr(10) || split_part(article, ' ', 1) END AS label FROM canonical_items WHERE article IS NOT NULL AND NOT contains(article, '(')")
def n25_design_label(spark, sf_dir):
    items = table(spark, sf_dir, "canonical_items").where("article is not null and not contains(article, '(')")
    return items.select("item_id", "loaded_at", T.design_label(F.col("description"), F.concat("article", F.lit(" (15+30)"))).alias("label"))


# --- numbers ----------------------------------------------------------------------------------------------------------
_HINT = "(SELECT kit_id, attempt, e.key AS field, e.value AS t FROM (SELECT kit_id, attempt, unnest(map_entries(totals_etalon_hint)) AS e FROM kit_results))"


@query(
    r"WITH a AS (SELECT *, regexp_replace(t, '[\s\x{00a0}\x{202f}]+', '', 'g') AS s FROM " + _HINT + r"), b AS (SELECT *, regexp_extract(s, '^-?[0-9.,]+') AS n, regexp_extract(s, '^-?[0-9.,]+(.*)$', 1) AS unit FROM a), "
    r"c AS (SELECT *, len(string_split(n, ',')) - 1 AS commas, len(string_split(n, '.')) - 1 AS dots FROM b) SELECT kit_id, attempt, field, CASE WHEN unit NOT IN ('', 'kg', 'KG', 'm', 'м', 'pcs', 'шт', 'USD', 'EUR', 'CNY', 'RUB', 'TRY', 'PLN', 'GBP', 'mt', 'm.', '€', '$') THEN NULL "
    r"WHEN unit IN ('м') THEN NULL WHEN regexp_full_match(n, '\d\d(\.\d\d){2,6}') THEN NULL WHEN regexp_full_match(n, '-?\d{1,3}(,\d{3})+(\.\d+)?') THEN TRY_CAST(replace(n, ',', '') AS DOUBLE) WHEN regexp_full_match(n, '-?\d{1,3}(\.\d{3})+,\d+') THEN TRY_CAST(replace(replace(n, '.', ''), ',', '.') AS DOUBLE) "
    r"WHEN regexp_full_match(n, '-?\d{1,3}(\.\d{3}){2,}') THEN TRY_CAST(replace(n, '.', '') AS DOUBLE) WHEN commas = 1 AND dots = 0 THEN TRY_CAST(replace(n, ',', '.') AS DOUBLE) WHEN commas > 1 AND dots = 0 THEN TRY_CAST(replace(n, ',', '') AS DOUBLE) WHEN commas = 0 AND dots <= 1 THEN TRY_CAST(n AS DOUBLE) END AS figure FROM c"
)
def m1_number_cell(spark, sf_dir):
    e = table(spark, sf_dir, "kit_results").select("kit_id", "attempt", F.explode("totals_etalon_hint").alias("field", "t"))
    return e.select("kit_id", "attempt", "field", M.parse_number(F.col("t")).alias("figure"))


@query(
    r"SELECT line_id, loaded_at, TRY_CAST(CASE WHEN regexp_matches(t, ',\d{3}$') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END AS DOUBLE) AS figure FROM (SELECT line_id, loaded_at, regexp_replace(regexp_extract(regexp_replace(qty_text, '[\s\x{00a0}]', ' ', 'g'), '-?\d[\d ]*(?:[.,]\d+)?'), ' ', '', 'g') AS t FROM doc_lines)"
)
def m2_number_inside(spark, sf_dir):
    return table(spark, sf_dir, "doc_lines").select("line_id", "loaded_at", M.number_inside(F.col("qty_text")).alias("figure"))


@query(r"SELECT line_id, loaded_at, coalesce(regexp_full_match(regexp_replace(hs, '\s', '', 'g'), '\d+') OR regexp_full_match(hs, '\d+\.\d+'), false) AS number_like, CASE WHEN regexp_full_match(d, '\d{6,13}') THEN d END AS digits, CASE WHEN regexp_full_match(d, '\d{6,13}') THEN left(d, 10) END AS tnved FROM (SELECT line_id, loaded_at, trim(hs) AS hs, CASE WHEN regexp_full_match(regexp_replace(trim(hs), '\s', '', 'g'), '\d{2}(\.\d{2}){2,6}') THEN regexp_replace(hs, '\D', '', 'g') WHEN regexp_full_match(regexp_replace(trim(hs), '\s', '', 'g'), '\d{6,13}\.0+') THEN split_part(regexp_replace(trim(hs), '\s', '', 'g'), '.', 1) ELSE regexp_replace(trim(hs), '\s', '', 'g') END AS d FROM doc_lines)")
def m3_m4_m5_codes(spark, sf_dir):
    hs = F.col("hs")
    return table(spark, sf_dir, "doc_lines").select("line_id", "loaded_at", M.is_number_like(hs).alias("number_like"), M.code_digits(hs).alias("digits"), F.substring(M.code_digits(hs), 1, 10).alias("tnved"))


@query(r"SELECT line_id, loaded_at, CASE WHEN w >= 20 AND w <= 500 THEN w / 100 WHEN w > 0 THEN w END AS width, CASE WHEN w > 0 THEN CASE WHEN w > 5 THEN w / 100 ELSE w END END AS cm, CASE WHEN w > 0 THEN w / 1000 END AS mm FROM (SELECT line_id, loaded_at, TRY_CAST(nullif(regexp_extract(description, 'w (\d+)', 1), '') AS DOUBLE) AS w FROM doc_lines)")
def m6_width(spark, sf_dir):
    lines = table(spark, sf_dir, "doc_lines").select("line_id", "loaded_at", F.nullif(F.regexp_extract("description", r"w (\d+)", 1), F.lit("")).alias("w"))
    return lines.select("line_id", "loaded_at", M.width_in_metres(F.col("w")).alias("width"), M.width_in_metres(F.concat("w", F.lit(" cm"))).alias("cm"), M.width_in_metres(F.concat("w", F.lit("мм"))).alias("mm"))


_ISO = "|".join(M.ISO)
_FOUND = rf"(SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(text, '([0-9A-Za-z_\x{{00c0}}-\x{{024f}}\x{{0400}}-\x{{04ff}}.]+)', ' \1 ', 'g') || ' ', ' ([0-9A-Za-z_\x{{00c0}}-\x{{024f}}\x{{0400}}-\x{{04ff}}]+\.?)', 1), lambda w: w), lambda w: regexp_full_match(w, '(?i)({_ISO})') OR regexp_full_match(w, '({_ISO})\.')), lambda w: CASE upper(rtrim(w, '.')) WHEN 'RMB' THEN 'CNY' WHEN 'TL' THEN 'TRY' ELSE upper(rtrim(w, '.')) END))) AS codes, text FROM documents)"
_WORDED = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{c}' END" for p, c in M.ALIASES).replace("\\", "\\")


@query(f"SELECT doc_id, CASE WHEN len(codes) = 1 THEN codes[1] WHEN len(codes) = 0 AND len(words) = 1 THEN words[1] END AS currency, array_to_string(codes, ',') AS codes FROM (SELECT *, list_filter([{_WORDED}], lambda x: x IS NOT NULL) AS words FROM {_FOUND}) WHERE text IS NOT NULL")
def m8_currency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", M.currency(F.col("text")).alias("currency"), F.array_join(M.currencies(F.col("text")), ",").alias("codes"))


@query(r"SELECT kit_id, CASE WHEN n = 1 THEN one WHEN hard = 1 AND n = hard + soft THEN strong END AS currency, CASE WHEN near = 'RMB' THEN 'CNY' ELSE near END AS priced FROM (SELECT kit_id, count(DISTINCT currency) AS n, min(currency) AS one, count(DISTINCT currency) FILTER (currency IN ('USD','EUR','GBP','CNY')) AS hard, count(DISTINCT currency) FILTER (currency IN ('TRY','RUB')) AS soft, min(currency) FILTER (currency IN ('USD','EUR','GBP','CNY')) AS strong, arg_min(currency, row_no) FILTER (currency IN ('USD','EUR','GBP','CNY','RUB','TRY','PLN')) AS near FROM (SELECT kit_id, currency, min(row_id) AS row_no FROM extracted_rows WHERE currency IS NOT NULL GROUP BY 1, 2) GROUP BY kit_id)")
def m9_title_currency(spark, sf_dir):
    seen = table(spark, sf_dir, "extracted_rows").where("currency is not null").groupBy("kit_id", "currency").agg(F.min("row_id").alias("at"))
    kits = seen.groupBy("kit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "currency"))), lambda x: x["currency"]), ", ").alias("t"))
    return kits.select("kit_id", M.title_currency(F.concat(F.lit("Terms: "), "t")).alias("currency"), M.title_currency(F.concat(F.lit("Unit price ("), "t", F.lit(")"))).alias("priced"))


@query("SELECT doc_id, CASE WHEN contains(text, '¥') OR contains(upper(text), 'CNY') OR contains(upper(text), 'RMB') THEN 'CNY' WHEN contains(text, '€') OR contains(upper(text), 'EUR') THEN 'EUR' WHEN contains(upper(text), 'USD') OR contains(text, '$') THEN 'USD' END AS currency FROM documents")
def m10_sign_currency(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.sign_currency(F.col("text")).alias("currency"))


@query("SELECT DISTINCT currency, coalesce(name, upper(currency)) AS name FROM canonical_items LEFT JOIN (VALUES ('USD', 'долларов США'), ('EUR', 'евро'), ('CNY', 'юаней'), ('RUB', 'рублей'), ('TRY', 'турецких лир'), ('GBP', 'фунтов стерлингов')) n(code, name) ON upper(currency) = code WHERE currency IS NOT NULL")
def m11_currency_name(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").where("currency is not null").select("currency", M.russian_name(F.col("currency")).alias("name")).distinct()


@query(r"SELECT line_id, loaded_at, CASE WHEN len(c) > 0 THEN list_sum(list_transform(c, lambda x: CAST(replace(x, ',', '.') AS DOUBLE))) END AS packages, coalesce(regexp_matches(lower(qty_text), 'carton|case|package|plywood|roll|pkg'), false) AS package_text FROM (SELECT *, regexp_extract_all(lower(qty_text), '(\d+(?:[.,]\d+)?)\s*(?:plywood\s*)?(?:carton|case|package|roll|pkg)', 1) AS c FROM doc_lines)")
def m12_package_count(spark, sf_dir):
    t = F.col("qty_text")
    return table(spark, sf_dir, "doc_lines").select("line_id", "loaded_at", M.package_count(t).alias("packages"), F.coalesce(F.lower(t).rlike("carton|case|package|plywood|roll|pkg"), F.lit(False)).alias("package_text"))


@query("SELECT unit, coalesce(unit IN ('m', 'mt', 'mtr', 'mtrs', 'metre', 'metres', 'meter', 'meters', 'м'), false) AS metres, coalesce(unit IN ('pcs', 'pc', 'piece', 'pieces', 'set', 'sets', 'шт'), false) AS pieces, count(*) AS n, CAST(sum(CASE WHEN unit IN ('m', 'mt', 'mtr', 'mtrs', 'metre', 'metres', 'meter', 'meters', 'м') THEN CAST(qty AS DECIMAL(18,4)) END) AS DOUBLE) AS run FROM (SELECT lower(trim(unit)) AS unit, qty FROM extracted_rows) GROUP BY unit")
def m13_units(spark, sf_dir):
    rows = table(spark, sf_dir, "extracted_rows").withColumn("unit", F.lower(F.trim("unit")))
    m = M.is_metres(F.col("unit"))
    return rows.groupBy("unit").agg(F.first(m).alias("metres"), F.first(M.is_pieces(F.col("unit"))).alias("pieces"), F.count("*").alias("n"), F.sum(F.when(m, F.col("qty").cast("decimal(18,4)"))).cast("double").alias("run"))


_JSON = "(SELECT recon_id, loaded_at, TRY_CAST(packing_data->>'$.meters' AS DOUBLE) AS metres, TRY_CAST(packing_data->>'$.area' AS DOUBLE) AS area, TRY_CAST(commercial_data->>'$.qty' AS DOUBLE) AS qty, TRY_CAST(commercial_data->>'$.price' AS DOUBLE) AS price, TRY_CAST(commercial_data->>'$.amount' AS DOUBLE) AS amount FROM reconciled_items)"


def _figures(spark, sf_dir):
    get = lambda c, k: F.get_json_object(c, f"$.{k}").try_cast("double").alias("metres" if k == "meters" else k)
    return table(spark, sf_dir, "reconciled_items").select("recon_id", "loaded_at", get("packing_data", "meters"), get("packing_data", "area"), get("commercial_data", "qty"), get("commercial_data", "price"), get("commercial_data", "amount"))


@query(f"SELECT recon_id, loaded_at, CASE WHEN metres <> 0 THEN metres WHEN area <> 0 THEN area WHEN qty <> 0 THEN qty END AS at_extract, CASE WHEN metres <> 0 THEN metres WHEN qty <> 0 THEN qty WHEN area <> 0 THEN area END AS at_merge FROM {_JSON}")
def m14_price_basis(spark, sf_dir):
    m, a, q = F.col("metres"), F.col("area"), F.col("qty")
    return _figures(spark, sf_dir).select("recon_id", "loaded_at", M.basis(m, a, q).alias("at_extract"), M.basis(m, q, a).alias("at_merge"))


@query(f"SELECT recon_id, loaded_at, coalesce(amount, want) AS amount, abs(amount - want) > 0.03 * CASE WHEN abs(amount) > 1 THEN abs(amount) ELSE 1 END AS mismatch FROM (SELECT *, CAST(round(CAST(price * CASE WHEN metres <> 0 THEN metres WHEN qty <> 0 THEN qty WHEN area <> 0 THEN area END AS DECIMAL(24,6)), 2) AS DOUBLE) AS want FROM {_JSON})")
def m15_amount_fill(spark, sf_dir):
    f = _figures(spark, sf_dir).withColumn("want", F.round((F.col("price") * M.basis(F.col("metres"), F.col("qty"), F.col("area"))).cast("decimal(24,6)"), 2).cast("double"))
    return f.select("recon_id", "loaded_at", F.coalesce("amount", "want").alias("amount"), (F.abs(F.col("amount") - F.col("want")) > 0.03 * F.greatest(F.abs("amount"), F.lit(1.0))).alias("mismatch"))


@query(
    f"SELECT recon_id, loaded_at, CASE WHEN want IS NULL THEN amount WHEN amount IS NULL THEN want WHEN abs(amount - want) <= greatest(0.05, 0.02 * abs(want), 0.002 * abs(amount)) THEN amount WHEN abs(amount - area) <= greatest(0.05, 0.002 * abs(amount)) THEN want WHEN abs(amount - q) <= greatest(0.05, 0.002 * abs(amount)) THEN want "
    f"WHEN want <> 0 AND (abs(amount / want - 10) < 0.08 OR abs(amount / want - 100) < 0.08 OR abs(amount / want - 0.1) < 0.02) THEN want ELSE amount END AS amount FROM (SELECT *, coalesce(qty, metres) AS q, CAST(round(CAST(price * coalesce(qty, metres) AS DECIMAL(24,6)), 2) AS DOUBLE) AS want FROM {_JSON})"
)
def m16_amount_repair(spark, sf_dir):
    f = _figures(spark, sf_dir)
    return f.select("recon_id", "loaded_at", M.repaired_amount(F.col("price"), F.col("qty"), F.col("amount"), F.col("area"), F.col("metres")).alias("amount"))


def _close(a, b, tol):
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false ELSE abs({a} - {b}) <= {tol} END"


@query(
    f"SELECT l.item_id, l.loaded_at, {_close('l.net_weight', 'r.net_weight', 1e-6)} AS strict, {_close('l.qty', 'r.qty', 'greatest(0.05, 0.002 * abs(l.qty))')} AS field, {_close('l.gross_weight', 'r.gross_weight', 0.05)} AS flat, {_close('l.qty', 'r.qty', 'greatest(0.05, 0.001 * abs(r.qty))')} AS family, {_close('l.amount', 'r.amount', '0.03 * greatest(abs(l.amount), abs(r.amount), 1)')} AS money "
    "FROM canonical_items l JOIN (SELECT DISTINCT ON (item_id) * FROM canonical_items_copy ORDER BY item_id, loaded_at) r USING (item_id)"
)
def m17_tolerances(spark, sf_dir):
    right = table(spark, sf_dir, "canonical_items_copy").groupBy("item_id").agg(F.min_by(F.struct("qty", "amount", "net_weight", "gross_weight"), "loaded_at").alias("r"))
    both = table(spark, sf_dir, "canonical_items").join(right, "item_id")
    c = lambda x, *a, **k: M.is_close(F.col(x), F.col(f"r.{x}"), *a, **k)
    money = M.is_close(F.col("amount"), F.col("r.amount"), 0.03, 0.03, "larger")
    return both.select("item_id", "loaded_at", c("net_weight", 1e-6).alias("strict"), c("qty", 0.05, 0.002).alias("field"), c("gross_weight", 0.05).alias("flat"), c("qty", 0.05, 0.001, of="right").alias("family"), money.alias("money"))


@query("SELECT row_id, loaded_at, CASE WHEN r = floor(r) THEN CAST(CAST(r AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(r AS VARCHAR), '0') END AS qty, CAST(round(CAST(net_weight AS DECIMAL(24,8)), 3) AS DOUBLE) AS net FROM (SELECT *, round(CAST(qty AS DECIMAL(24,8)), 2) AS r FROM extracted_rows)")
def m18_shown(spark, sf_dir):
    return table(spark, sf_dir, "extracted_rows").select("row_id", "loaded_at", M.shown(F.col("qty")).alias("qty"), F.round(F.col("net_weight").cast("decimal(24,8)"), 3).cast("double").alias("net"))


@query(r"SELECT recon_id, loaded_at, TRY_CAST(commercial_data->>'$.qty' AS DOUBLE) AS plain, coalesce(TRY_CAST(packing_data->>'$.meters' AS DOUBLE), TRY_CAST(packing_data->>'$.area' AS DOUBLE), TRY_CAST(packing_data->>'$.pcs' AS DOUBLE), TRY_CAST(commercial_data->>'$.qty' AS DOUBLE)) AS first_number FROM reconciled_items")
def m19_m20_coercion(spark, sf_dir):
    get = lambda c, k: F.get_json_object(c, f"$.{k}").try_cast("double")
    items = table(spark, sf_dir, "reconciled_items")
    plain = get("commercial_data", "qty")
    return items.select("recon_id", "loaded_at", plain.alias("plain"), F.coalesce(*(get("packing_data", k) for k in ("meters", "area", "pcs")), plain).alias("first_number"))


@query("SELECT row_id, loaded_at, coalesce(ends_with(k, p) AND length(k) > length(p) AND length(p) > 0, false) AS repeats FROM (SELECT row_id, loaded_at, k, lag(k) OVER (PARTITION BY sheet_id ORDER BY row_no, row_id, loaded_at) AS p FROM (SELECT *, regexp_replace(upper(article), '[\\s]+', '', 'g') AS k FROM extracted_rows))".replace("\\\\", "\\"))
def p36_repeat_caption(spark, sf_dir):
    rows = table(spark, sf_dir, "extracted_rows").withColumn("k", F.regexp_replace(F.upper("article"), "[\\s]+", ""))
    before = F.lag("k").over(Window.partitionBy("sheet_id").orderBy("row_no", "row_id", "loaded_at"))
    return rows.withColumn("p", before).select("row_id", "loaded_at", F.coalesce(F.col("k").endswith(F.col("p")) & (F.length("k") > F.length("p")) & (F.length("p") > 0), F.lit(False)).alias("repeats"))
