"""Queries of the output tables, checks and answers over whole test tables; the SQL beside each is written on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model_json as Y
from ..functions import text as T
from ..operators import papers as P
from ..sources.tables import table
from . import joins as B
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_R, _FAM, _dec = B._R, B._FAM, B._dec
_GOODS = f"(SELECT *, left(hs_code, 10) AS tnved, CAST(row_number() OVER (PARTITION BY kit_id ORDER BY coalesce(item_no, 999), row_id) AS INTEGER) AS no FROM {_R} WHERE role = '{{role}}' AND NOT is_group)"


def _goods(spark, sf_dir, role):
    rows = B._rows(spark, sf_dir, role).where("not is_group").withColumns({"place": F.coalesce("item_no", F.lit(999)), "tnved": F.left("hs_code", F.lit(10)), "design": F.split_part("article", F.lit(" "), F.lit(1))})
    makers = table(spark, sf_dir, "articles_ref").select("article", F.col("base_unit").alias("country"), F.col("description_ru").alias("manufacturer"))
    return rows.join(makers, "article", "left")


_MADE = "(SELECT g.*, split_part(g.article, ' ', 1) AS design, r.base_unit AS country, r.description_ru AS manufacturer FROM {g} g LEFT JOIN articles_ref r ON g.article = r.article)"


def _printed_sql(layout: str, role: str, raw: bool = False) -> str:
    plan = P.LAYOUTS[layout]
    digits = dict(plan.digits)
    show = lambda c: f"CAST(round(CAST({c} AS DECIMAL(24,8)), {digits[c]}) AS DOUBLE)" if c in digits else c
    g = _MADE.format(g=_GOODS.format(role=role))
    body = "SELECT kit_id, " + ", ".join(f"{show(c)} AS {c}" for c in plan.columns) + f", false AS is_total FROM {g}"
    if not plan.sums:
        return body
    total = "SELECT kit_id, " + ", ".join((_dec(c if raw else show(c)) if c in plan.sums else "NULL") + f" AS {c}" for c in plan.columns) + f", true FROM {g} GROUP BY kit_id"
    return f"{body} UNION ALL {total}"


def _add_printed(name: str, layout: str, role: str, raw: bool = False) -> None:
    def run(spark, sf_dir):
        return P.printed(_goods(spark, sf_dir, role), layout, ["kit_id"], ["place", "row_id"], raw)

    QUERIES[name] = run
    ORACLE[name] = _printed_sql(layout, role, raw)


for _name, _layout, _role, _raw in (
    ("a7_invoice_table", "element_invoice", "invoice", True),
    ("a8_packing_table", "element_packing", "packing", False),
    ("a9_specification_table", "element_spec", "specification", False),
    ("a10_book_invoice", "book_invoice", "invoice", False),
    ("a10_book_packing", "book_packing", "packing", False),
    ("a11_plain_invoice", "plain_invoice", "invoice", False),
    ("a11_plain_packing", "plain_packing", "packing", False),
    ("a11_plain_declaration", "plain_declaration", "specification", False),
    ("a12_descriptions", "book_description", "specification", False),
):
    _add_printed(_name, _layout, _role, _raw)


@query(
    f"WITH g AS (SELECT *, {_FAM} AS fam FROM {_GOODS.format(role='invoice')}) SELECT kit_id, fam, {_dec('qty')} AS qty, {_dec('rolls')} AS rolls, CAST(round(CAST(arg_max(price, no) FILTER (price IS NOT NULL) * {_dec('qty')} AS DECIMAL(24,6)), 2) AS DOUBLE) AS amount, count(*) AS n, 1 AS level FROM g GROUP BY 1, 2 UNION ALL SELECT kit_id, NULL, {_dec('qty')}, {_dec('rolls')}, {_dec('amount')}, count(*), 0 FROM g GROUP BY 1"
)
def a7_family_table(spark, sf_dir):
    rows = P.numbered_rows(_goods(spark, sf_dir, "invoice"), ["kit_id"], ["place", "row_id"]).withColumn("fam", B._family())
    return P.family_table(rows, ["kit_id"], "fam", ["qty", "rolls"], "price", "qty", "amount")


@query(f"SELECT kit_id, article, min(no) AS first_row, max(no) AS last_row, count(*) AS rows FROM {_GOODS.format(role='packing')} WHERE article IS NOT NULL GROUP BY 1, 2")
def w16_spans(spark, sf_dir):
    rows = P.numbered_rows(_goods(spark, sf_dir, "packing"), ["kit_id"], ["place", "row_id"])
    return P.spans(rows, ["kit_id"], "article")


@query(f"SELECT kit_id, CAST(count(*) + 1 AS INTEGER) AS n_rows, {_dec('qty')} AS total_qty FROM {_GOODS.format(role='packing')} GROUP BY 1")
def k6_json_preview(spark, sf_dir):
    """Packing tables as JSON, read again: number of rows and the total."""
    made = P.preview(_goods(spark, sf_dir, "packing"), "element_packing", ["kit_id"], ["place", "row_id"])
    rows = F.from_json("rows", "array<struct<no: int, qty: double, is_total: boolean>>")
    return made.select("kit_id", F.size(rows).alias("n_rows"), F.element_at(rows, -1)["qty"].alias("total_qty"))


@query("SELECT kit_id, CASE WHEN min(currency) = max(currency) THEN 'Unit price (' || min(currency) || ')' ELSE 'Unit price' END AS label FROM extracted_rows WHERE kit_id IS NOT NULL GROUP BY 1")
def k13_labels(spark, sf_dir):
    kits = table(spark, sf_dir, "extracted_rows").where("kit_id is not null").groupBy("kit_id").agg(F.when(F.min("currency") == F.max("currency"), F.min("currency")).alias("c"))
    plain, made = (P.labels("element_invoice", c)[P.LAYOUTS["element_invoice"].columns.index("price")] for c in (None, "{}"))
    return kits.select("kit_id", F.when(F.col("c").isNotNull(), F.replace(F.lit(made), F.lit("{}"), F.col("c"))).otherwise(F.lit(plain)).alias("label"))


@query("SELECT item_id, loaded_at, article, CASE WHEN description IS NULL THEN '' ELSE description END AS text, manufacturer, country FROM canonical_items")
def a13_item_rows(spark, sf_dir):
    return table(spark, sf_dir, "canonical_items").select("item_id", "loaded_at", "article", F.coalesce("description", F.lit("")).alias("text"), "manufacturer", "country")


# --- checks -----------------------------------------------------------------------------------------------------------
_SUMS = ["qty", "amount", "rolls", "net_weight", "gross_weight"]


@query("SELECT kit_id, " + ", ".join(f"{_dec(c)} AS {c}" for c in _SUMS) + f", {_dec('CASE WHEN unit = ' + chr(39) + 'm' + chr(39) + ' THEN qty END')} AS meters, {_dec('CASE WHEN unit = ' + chr(39) + 'm2' + chr(39) + ' THEN qty END')} AS area, {_dec('CASE WHEN unit = ' + chr(39) + 'm3' + chr(39) + ' THEN qty END')} AS volume, {_dec('CASE WHEN unit = ' + chr(39) + 'pcs' + chr(39) + ' THEN qty END')} AS boxes FROM {_R} GROUP BY 1")
def a6_a27_shipment_totals(spark, sf_dir):
    """Nine measures of each shipment; null when nobody has a value."""
    rows = B._rows(spark, sf_dir).withColumns({n: F.when(F.col("unit") == u, F.col("qty")) for n, u in (("meters", "m"), ("area", "m2"), ("volume", "m3"), ("boxes", "pcs"))})
    return P.totals(rows, ["kit_id"], [*_SUMS, "meters", "area", "volume", "boxes"])


_CHECKED = ["qty", "price", "amount", "rolls", "net_weight", "gross_weight"]


@query("SELECT kit_id, item_no, field_name, 'RED' AS severity FROM (" + " UNION ALL ".join(f"SELECT kit_id, item_no, '{c}' AS field_name FROM {_R} WHERE item_no IS NOT NULL AND {c} IS NOT NULL GROUP BY kit_id, item_no HAVING count(DISTINCT role) >= 2 AND max({c}) - min({c}) > 1e-6" for c in _CHECKED) + ")")
def v1_field_mismatch(spark, sf_dir):
    return P.field_conflicts(B._rows(spark, sf_dir).where("item_no is not null"), ["kit_id", "item_no"], "role", _CHECKED)


@query(f"WITH h AS (SELECT kit_id FROM {_R} GROUP BY 1 HAVING bool_or(role = 'invoice') AND bool_or(role = 'packing')) SELECT kit_id, k, CASE WHEN bool_or(role = 'invoice') THEN 'not in packing' ELSE 'not in invoice' END AS message FROM {_R} WHERE k IS NOT NULL AND role IN ('invoice', 'packing') AND kit_id IN (SELECT kit_id FROM h) GROUP BY 1, 2 HAVING count(DISTINCT role) = 1")
def v2_missing_pairs(spark, sf_dir):
    return P.missing_pairs(B._rows(spark, sf_dir), ["kit_id"], "k", "role", "invoice", "packing")


_V7 = ["qty", "rolls", "net_weight"]


def _side(role: str, p: str) -> str:
    return f"(SELECT kit_id, k, " + ", ".join(f"{_dec(c)} AS {p}_{c}" for c in _V7) + f" FROM {_R} WHERE role = '{role}' AND k IS NOT NULL GROUP BY 1, 2)"


@query("SELECT kit_id, k, field_name, CASE WHEN (l IS NULL) <> (r IS NULL) THEN 'YELLOW' ELSE 'RED' END AS severity FROM (" + " UNION ALL ".join(f"SELECT a.kit_id, a.k, '{c}' AS field_name, l_{c} AS l, r_{c} AS r FROM {_side('packing', 'l')} a JOIN {_side('specification', 'r')} b ON a.kit_id = b.kit_id AND a.k = b.k" for c in _V7) + ") WHERE (l IS NULL) <> (r IS NULL) OR abs(l - r) > 0.05")
def v7_pairwise(spark, sf_dir):
    """Packing against specification, field by field."""
    rows = B._rows(spark, sf_dir).where("k is not null")
    a, b = (P.totals(rows.where(F.col("role") == r), ["kit_id", "k"], _V7) for r in ("packing", "specification"))
    return P.pairwise(a, b, ["kit_id", "k"], _V7)


@query(f"SELECT row_id, 'RED' AS severity FROM {_R} WHERE abs(amount - CAST(round(CAST(price * qty AS DECIMAL(24,6)), 2) AS DOUBLE)) > 0.0001 * CASE WHEN abs(amount) > 1 THEN abs(amount) ELSE 1 END")
def v6_amount_basis(spark, sf_dir):
    """Amounts off by more than a ten-thousandth of price times quantity, as the printed ones here never are by 3 %."""
    want = F.round((F.col("price") * F.col("qty")).cast("decimal(24,6)"), 2).cast("double")
    return B._rows(spark, sf_dir).where(F.abs(F.col("amount") - want) > 1e-4 * F.greatest(F.abs("amount"), F.lit(1.0))).select("row_id", F.lit("RED").alias("severity"))


@query("SELECT doc_id, 'ORANGE' AS severity FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]')) / length(text) AS share FROM documents WHERE text <> '') WHERE share < 0.75")
def v9_weak_text(spark, sf_dir):
    """Documents whose share of letters, as a stand-in for a reader's confidence, is below 0.75."""
    letters = F.length(F.regexp_replace("text", "[^A-Za-zА-Яа-яЁё]", ""))
    return table(spark, sf_dir, "documents").where("text != ''").where(letters / F.length("text") < 0.75).select("doc_id", F.lit("ORANGE").alias("severity"))


@query(
    "WITH i AS " + _side("invoice", "i") + ", s AS " + _side("packing", "s") + ", f AS (SELECT coalesce(i.kit_id, s.kit_id) AS kit_id, coalesce(i.k, s.k) AS k, i.k AS a, s.k AS b, concat_ws(',', CASE WHEN abs(i_qty - s_qty) > greatest(0.05, 0.002 * abs(i_qty)) THEN 'qty' END, CASE WHEN abs(i_rolls - s_rolls) > greatest(0.05, 0.002 * abs(i_rolls)) THEN 'rolls' END, CASE WHEN abs(i_net_weight - s_net_weight) > greatest(0.05, 0.002 * abs(i_net_weight)) THEN 'net_weight' END) AS differing FROM i FULL JOIN s ON i.kit_id = s.kit_id AND i.k = s.k), m AS (SELECT kit_id, bool_or(a IS NOT NULL AND b IS NOT NULL) AS met FROM f GROUP BY 1) "
    "SELECT f.kit_id, f.k, CASE WHEN a IS NULL THEN 'extra' WHEN b IS NULL THEN 'missing' WHEN differing = '' THEN 'matched' ELSE 'question' END AS verdict, differing FROM f JOIN m ON f.kit_id = m.kit_id WHERE a IS NULL OR b IS NOT NULL OR met"
)
def j20_v10_scan_review(spark, sf_dir):
    rows = B._rows(spark, sf_dir).where("k is not null")
    a, b = (P.totals(rows.where(F.col("role") == r), ["kit_id", "k"], _V7) for r in ("invoice", "packing"))
    return P.scan_verdicts(a, b, ["kit_id"], "k", _V7)


@query("SELECT kit_id, attempt, field, abs(g - h) > CASE WHEN 0.002 * abs(g) > 0.5 THEN 0.002 * abs(g) ELSE 0.5 END AS mismatch FROM (SELECT kit_id, attempt, field, totals_got[field] AS g, TRY_CAST(totals_etalon_hint[field] AS DOUBLE) AS h FROM (SELECT *, unnest(map_keys(totals_got)) AS field FROM kit_results))")
def v10_total_mismatch(spark, sf_dir):
    long = table(spark, sf_dir, "kit_results").select("kit_id", "attempt", "totals_etalon_hint", F.explode("totals_got").alias("field", "g"))
    hint = F.try_element_at("totals_etalon_hint", F.col("field")).try_cast("double")
    return long.select("kit_id", "attempt", "field", P.total_mismatch(F.col("g"), hint).alias("mismatch"))


@query("SELECT count(*) AS items, count(*) FILTER (hs_code IS NULL OR description IS NULL) AS bare, 2 * count(*) FILTER (hs_code IS NULL OR description IS NULL) >= count(*) AS no_catalog FROM canonical_items")
def v12_no_catalog(spark, sf_dir):
    """Whether so many items lack a code or a name that the catalog was probably not supplied."""
    bare = F.count(F.when(F.col("hs_code").isNull() | F.col("description").isNull(), 1))
    return table(spark, sf_dir, "canonical_items").agg(F.count("*").alias("items"), bare.alias("bare"), (2 * bare >= F.count("*")).alias("no_catalog"))


@query("SELECT sheet_id, loaded_at, array_to_string(list_filter(['article', 'qty', 'price', 'amount'], lambda f: NOT list_contains(v, f)), ',') AS missing FROM (SELECT DISTINCT sheet_id, loaded_at, map_values(mapping) AS v FROM extracted_sheets WHERE mapping IS NOT NULL) WHERE NOT (list_contains(v, 'article') AND list_contains(v, 'qty') AND list_contains(v, 'price') AND list_contains(v, 'amount'))")
def v13_absent_columns(spark, sf_dir):
    sheets = table(spark, sf_dir, "extracted_sheets").where("mapping is not null").select("sheet_id", "loaded_at", F.map_values("mapping").alias("v")).distinct()
    return P.absent_columns(sheets, ["sheet_id", "loaded_at"], F.col("v"), ["article", "qty", "price", "amount"])


# --- answers in JSON --------------------------------------------------------------------------------------------------
@query("SELECT recon_id, loaded_at, TRY_CAST(commercial_data->>'$.qty' AS DOUBLE) AS qty, commercial_data->>'$.currency' AS currency FROM reconciled_items WHERE json_valid(commercial_data) AND commercial_data <> ''")
def y1_payload(spark, sf_dir):
    """JSON found inside fences and talk."""
    items = table(spark, sf_dir, "reconciled_items").where("commercial_data like '{%}'")
    told = F.concat(F.lit("Here [is it]:\n```json\n"), F.col("commercial_data"), F.lit("\n``` {done}"))
    found = Y.payload(F.regexp_replace(told, r"\[is it\]", "[is it"))
    return items.select("recon_id", "loaded_at", found.alias("p")).select("recon_id", "loaded_at", F.get_json_object("p", "$.qty").try_cast("double").alias("qty"), F.get_json_object("p", "$.currency").alias("currency"))


@query("SELECT recon_id, loaded_at, coalesce(nullif(packing_data->>'$.gross_weight', ''), nullif(packing_data->>'$.net_weight', '')) AS gross, coalesce(nullif(packing_data->>'$.meters', ''), nullif(packing_data->>'$.area', ''), nullif(packing_data->>'$.pcs', '')) AS measure FROM reconciled_items WHERE json_valid(packing_data)")
def y2_aliases(spark, sf_dir):
    items = table(spark, sf_dir, "reconciled_items").where("packing_data like '{%}'")
    return items.select("recon_id", "loaded_at", Y.by_alias(F.col("packing_data"), ["brutto", "gross_weight", "net_weight"]).alias("gross"), Y.by_alias(F.col("packing_data"), ["meters", "area", "pcs"]).alias("measure"))


@query("SELECT item_id, loaded_at, list_sort(list_transform(map_entries(m), lambda e: e.key || '=' || e.value)) AS kept FROM (SELECT item_id, loaded_at, map_from_entries(list_filter([{'key': 'article', 'value': article}, {'key': 'color', 'value': color}, {'key': 'unit', 'value': unit}], lambda e: e.value IS NOT NULL AND e.value <> '')) AS m FROM canonical_items)")
def y4_snapshot(spark, sf_dir):
    m = F.create_map(*(x for c in ("article", "color", "unit", "country") for x in (F.lit(c), F.col(c))))
    kept = Y.snapshot(m, ["article", "color", "unit"])
    return table(spark, sf_dir, "canonical_items").select("item_id", "loaded_at", F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("kept"))


_TWIN = f"(SELECT a.item_id, a.color AS a, b.color AS b, a.unit AS ua, b.unit AS ub FROM {B._I} a JOIN {B._C} b USING (item_id))"


def _twins(spark, sf_dir):
    copy = B.J.once(table(spark, sf_dir, "canonical_items_copy"), "item_id", "loaded_at").select("item_id", F.col("color").alias("b"), F.col("unit").alias("ub"))
    return B._items(spark, sf_dir).select("item_id", F.col("color").alias("a"), F.col("unit").alias("ua")).join(copy, "item_id")


@query(f"SELECT item_id, CASE WHEN coalesce(a, '') = '' THEN nullif(b, '') ELSE a END AS kept, CASE WHEN coalesce(b, '') = '' THEN nullif(a, '') ELSE b END AS replaced FROM {_TWIN}")
def y5_prefer(spark, sf_dir):
    return _twins(spark, sf_dir).select("item_id", Y.kept_or_new(F.col("a"), F.col("b")).alias("kept"), Y.kept_or_new(F.col("a"), F.col("b"), True).alias("replaced"))


@query(f"SELECT item_id, CASE WHEN a IS NULL THEN b ELSE a END AS color, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a <> b THEN b END AS other FROM {_TWIN}")
def y6_trace(spark, sf_dir):
    m = lambda c: F.map_filter(F.create_map(F.lit("color"), F.col(c)), lambda k, v: v.isNotNull())
    t = _twins(spark, sf_dir).withColumn("t", Y.traced(m("a"), m("b")))
    return t.select("item_id", F.try_element_at("t", F.lit("color")).alias("color"), F.try_element_at("t", F.lit("color__alt")).alias("other"))


@query("SELECT doc_id, nullif(trim(text || chr(10) || lang, chr(32)), '') AS answer FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND lang IS NOT NULL AND NOT regexp_matches(text, '^\\s|\\s$') AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b-\\x1f]')".replace("\\\\", "\\"))
def y8_answer_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null and trim(text) != '' and lang is not null").where(~F.col("text").rlike("^\\s|\\s$") & ~F.col("text").rlike("[\\x00-\\x08\\x0b-\\x1f]"))
    part = lambda k, t: F.struct(F.lit(k).alias("type"), t.alias("text"))
    nested = F.to_json(F.struct(F.struct(F.array(part("reasoning", F.lit("hm")), part("text", F.col("text")), part("text", F.col("lang"))).alias("parts")).alias("message")))
    return docs.select("doc_id", Y.answer_text(nested).alias("answer"))


@query("SELECT kit_id, min(loaded_at) AS first_seen, string_agg(src, ',' ORDER BY seen, src) AS sources FROM (SELECT kit_id, source AS src, min(row_id) AS seen, min(loaded_at) AS loaded_at FROM extracted_rows WHERE kit_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def a26_first_seen_sources(spark, sf_dir):
    """Sources of a shipment in the order in which they first came."""
    seen = table(spark, sf_dir, "extracted_rows").where("kit_id is not null and source is not null").groupBy("kit_id", "source").agg(F.min("row_id").alias("seen"), F.min("loaded_at").alias("t"))
    return seen.groupBy("kit_id").agg(F.min("t").alias("first_seen"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "source"))), lambda x: x["source"]), ",").alias("sources"))


@query("SELECT item_id, loaded_at, CASE WHEN trim(coalesce(article, '')) IN ('-', '—', '', 'n/a') THEN '-' ELSE article END AS article, left(hs_code, 10) AS hs_code, left(hs_code, 10) AS tnved, round(price, 4) AS price, split_part(description, ' / ', 1) AS en FROM canonical_items")
def p38_wire_items(spark, sf_dir):
    """Items as they go over the wire: nested groups, codes cut to ten digits, a blank article as a dash."""
    article = F.when(F.trim(F.coalesce("article", F.lit(""))).isin("-", "—", "", "n/a"), "-").otherwise(F.col("article"))
    code = F.left("hs_code", F.lit(10))
    wire = F.to_json(F.struct(article.alias("article"), F.struct(F.round("price", 4).alias("price")).alias("commercial"), F.struct(code.alias("hs_code"), code.alias("tnved"), T.bilingual(F.col("description"))["en"].alias("en")).alias("customs")))
    got = table(spark, sf_dir, "canonical_items").select("item_id", "loaded_at", F.from_json(wire, "article string, commercial struct<price: double>, customs struct<hs_code: string, tnved: string, en: string>").alias("w"))
    return got.select("item_id", "loaded_at", "w.article", "w.customs.hs_code", "w.customs.tnved", "w.commercial.price", "w.customs.en")
