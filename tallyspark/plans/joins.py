"""Queries of the merging operators over whole test tables; the SQL beside each is written on its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import money as M
from ..functions import text as T
from ..operators import lots as L
from ..operators import merging as J
from ..sources.tables import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_KEY = "nullif(regexp_replace(upper(article), '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g'), '')"
_R = f"(SELECT *, {_KEY} AS k FROM (SELECT DISTINCT ON (row_id) * FROM extracted_rows WHERE row_id IS NOT NULL ORDER BY row_id, loaded_at) WHERE kit_id IS NOT NULL)"
_I = f"(SELECT *, {_KEY} AS k FROM (SELECT DISTINCT ON (item_id) * FROM canonical_items WHERE item_id IS NOT NULL ORDER BY item_id, loaded_at))"
_D = "(SELECT DISTINCT ON (line_id) * FROM doc_lines WHERE line_id IS NOT NULL ORDER BY line_id, loaded_at)"


def _dec(c: str, digits: int = 4) -> str:
    return f"CAST(round(sum(CAST({c} AS DECIMAL(24,6))), {digits}) AS DOUBLE)"


def _sum(c, digits: int = 4):
    return F.round(F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(24,6)")), digits).cast("double")


def _rows(spark, sf_dir, role: str | None = None):
    rows = J.once(table(spark, sf_dir, "extracted_rows"), "row_id", "loaded_at").where("kit_id is not null").withColumn("k", K.match_key(F.col("article")))
    return rows.where(F.col("role") == role) if role else rows


def _items(spark, sf_dir):
    return J.once(table(spark, sf_dir, "canonical_items"), "item_id", "loaded_at").withColumn("k", K.match_key(F.col("article")))


def _lines(spark, sf_dir):
    return J.once(table(spark, sf_dir, "doc_lines"), "line_id", "loaded_at")


_LOTS = f"(SELECT *, row_number() OVER (PARTITION BY kit_id, k ORDER BY seen) AS lot_no, count(*) OVER (PARTITION BY kit_id, k) AS n_lots FROM (SELECT kit_id, k, qty, min(row_id) AS seen, max(net_weight) AS net FROM {_R} WHERE role <> 'packing' AND k IS NOT NULL AND qty IS NOT NULL AND NOT is_group GROUP BY 1, 2, 3))"


def _lots(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("role != 'packing' and k is not null and qty is not null and not is_group")
    lots = rows.groupBy("kit_id", "k", "qty").agg(F.min("row_id").alias("seen"), F.max("net_weight").alias("net"))
    w = Window.partitionBy("kit_id", "k")
    return lots.withColumns({"lot_no": F.row_number().over(w.orderBy("seen")), "n_lots": F.count("*").over(w)})


@query(
    f"SELECT row_id, CAST(lot_no AS INTEGER) AS lot_no, class FROM (SELECT p.row_id, l.lot_no, CASE WHEN l.n_lots = 1 THEN 'only' WHEN l.qty = p.qty THEN 'lot' ELSE 'no weight' END AS class, row_number() OVER (PARTITION BY p.row_id ORDER BY CASE WHEN l.n_lots = 1 THEN 1 WHEN l.qty = p.qty THEN 2 ELSE 3 END, l.lot_no) AS rn FROM {_R} p JOIN {_LOTS} l ON p.kit_id = l.kit_id AND p.k = l.k WHERE p.role = 'packing' AND NOT p.is_group AND (l.n_lots = 1 OR l.qty = p.qty OR l.net IS NULL)) WHERE rn = 1"
)
def j3_packing_join(spark, sf_dir):
    packing = _rows(spark, sf_dir, "packing").where("not is_group and k is not null").select("row_id", "kit_id", "k", F.col("qty").alias("p_qty"))
    lot, only = F.col("qty") == F.col("p_qty"), F.col("n_lots") == 1
    rank = F.when(only, 1).when(lot, 2).when(F.col("net").isNull(), 3)
    got = J.ranked_join(packing, _lots(spark, sf_dir), ["kit_id", "k"], rank, ["lot_no"], "row_id")
    return got.select("row_id", "lot_no", F.element_at(F.array(*map(F.lit, ("only", "lot", "no weight"))), F.col("rank")).alias("class"))


# families: the first word of an article; a packing row of a family speaks of all its colours
_FAM = "nullif(regexp_replace(upper(split_part(article, ' ', 1)), '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g'), '')"
_KIDS = f"(SELECT kit_id, k, {_dec('qty')} AS metres, max(net) AS spec FROM (SELECT kit_id, k, qty, CAST(NULL AS DOUBLE) AS net FROM {_R} WHERE role = 'invoice' AND k IS NOT NULL AND NOT is_group UNION ALL SELECT kit_id, k, NULL, net_weight FROM {_R} WHERE role = 'specification' AND k IS NOT NULL AND NOT is_group) GROUP BY 1, 2 HAVING count(qty) > 0)"
_FAMS = f"(SELECT kit_id, {_FAM} AS fam, {_dec('qty')} AS metres, {_dec('net_weight', 2)} AS net, {_dec('gross_weight', 2)} AS gross FROM {_R} WHERE role = 'packing' AND NOT is_group AND {_FAM} IS NOT NULL GROUP BY 1, 2)"


def _family(article="article"):
    return K.match_key(F.split_part(F.col(article), F.lit(" "), F.lit(1)))


def _kids(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("k is not null and not is_group and role in ('invoice', 'specification')")
    qty, net = (F.when(F.col("role") == r, F.col(c)) for r, c in (("invoice", "qty"), ("specification", "net_weight")))
    return rows.groupBy("kit_id", "k").agg(_sum(qty).alias("metres"), F.max(net).alias("spec"), F.count(qty).alias("n")).where("n > 0").drop("n")


def _families(spark, sf_dir):
    rows = _rows(spark, sf_dir, "packing").where("not is_group").withColumn("fam", _family()).where("fam is not null")
    return rows.groupBy("kit_id", "fam").agg(_sum("qty").alias("f_metres"), _sum("net_weight", 2).alias("net"), _sum("gross_weight", 2).alias("gross"))


_PAIRED = rf"(SELECT c.*, f.fam, f.metres AS f_metres, f.net, f.gross FROM {_KIDS} c JOIN {_FAMS} f ON c.kit_id = f.kit_id AND length(f.fam) >= 3 AND starts_with(c.k, f.fam) AND regexp_full_match(substr(c.k, length(f.fam) + 1), '[0-9]{{1,4}}'))"


@query(
    f"WITH p AS {_PAIRED}, s AS (SELECT *, CASE WHEN sum(coalesce(spec, 0)) OVER g > 0 THEN coalesce(spec, 0) / sum(coalesce(spec, 0)) OVER g WHEN sum(coalesce(metres, 0)) OVER g > 0 THEN coalesce(metres, 0) / sum(coalesce(metres, 0)) OVER g ELSE 1.0 / count(*) OVER g END AS sh FROM p WINDOW g AS (PARTITION BY kit_id, fam)), "
    "c AS (SELECT *, CAST(round(CAST(net * sh AS DECIMAL(24,8)), 2) AS DECIMAL(18,2)) AS a, CAST(round(CAST(gross * sh AS DECIMAL(24,8)), 2) AS DECIMAL(18,2)) AS b, row_number() OVER (PARTITION BY kit_id, fam ORDER BY k) AS rn, count(*) OVER (PARTITION BY kit_id, fam) AS n FROM s) "
    "SELECT kit_id, fam, k, CAST(CASE WHEN rn = n THEN CAST(net AS DECIMAL(18,2)) - coalesce(sum(a) OVER b4, 0) ELSE a END AS DOUBLE) AS net, CAST(CASE WHEN rn = n THEN CAST(gross AS DECIMAL(18,2)) - coalesce(sum(b) OVER b4, 0) ELSE b END AS DOUBLE) AS gross, abs(total - f_metres) <= greatest(0.05, 0.001 * abs(f_metres)) AS sums FROM (SELECT *, sum(metres) OVER (PARTITION BY kit_id, fam) AS total FROM c) WINDOW b4 AS (PARTITION BY kit_id, fam ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
)
def j4_family_weights(spark, sf_dir):
    """Weights of each family's packing total over its colours, exact to the cent."""
    pairs = L.prefix_join(_kids(spark, sf_dir), _families(spark, sf_dir).withColumnRenamed("kit_id", "kit_2"), "k", "fam").where("kit_id = kit_2")
    parts = J.distribute(pairs, ["kit_id", "fam"], {"net": ["spec", "metres"], "gross": ["spec", "metres"]}, ["k"])
    total = F.sum("metres").over(Window.partitionBy("kit_id", "fam"))
    return parts.select("kit_id", "fam", "k", F.col("net_part").alias("net"), F.col("gross_part").alias("gross"), M.is_close(total, F.col("f_metres"), 0.05, 0.001, "right").alias("sums"))


@query()
def j4_family_claims(spark, sf_dir):
    """Colours that each single packing row of a family claims, one after the other; tested against cases by hand."""
    kids = _rows(spark, sf_dir, "invoice").where("k is not null and not is_group").select("kit_id", _family().alias("fam"), F.lit("child").alias("side"), F.col("row_id").alias("id"), F.regexp_extract("k", "([0-9]*)$", 1).alias("tail"), "k", F.col("qty").alias("metres"), "rolls")
    kids = kids.select("kit_id", "fam", "side", "id", (F.length("tail").between(1, 4) & (F.concat("fam", "tail") == F.col("k"))).alias("digit"), "metres", "rolls")
    fams = _rows(spark, sf_dir, "packing").where("not is_group").select("kit_id", _family().alias("fam"), F.lit("family").alias("side"), F.col("row_id").alias("id"), F.lit(False).alias("digit"), F.col("qty").alias("metres"), "rolls").where("length(fam) >= 3")
    return J.claim_children(kids.where("length(fam) >= 3").unionByName(fams), ["kit_id", "fam"])


@query(f"SELECT kit_id, fam, k, drift > 0.1 AS differs FROM (SELECT kit_id, fam, k, abs(sum(metres) OVER (PARTITION BY kit_id, fam) - f_metres) AS drift FROM {_PAIRED}) UNION ALL SELECT c.kit_id, NULL, c.k, NULL FROM {_KIDS} c WHERE NOT EXISTS (SELECT 1 FROM {_PAIRED} p WHERE p.kit_id = c.kit_id AND p.k = c.k)")
def a30_v8_family_sums(spark, sf_dir):
    """Every colour whose family's sum differs from the packing row, and colours without a family row (null)."""
    kids = _kids(spark, sf_dir)
    pairs = L.prefix_join(kids, _families(spark, sf_dir).withColumnRenamed("kit_id", "kit_2"), "k", "fam").where("kit_id = kit_2")
    drift = F.abs(F.sum("metres").over(Window.partitionBy("kit_id", "fam")) - F.col("f_metres"))
    out = pairs.select("kit_id", "fam", "k", (drift > 0.1).alias("differs"))
    return out.unionByName(kids.join(pairs.select("kit_id", "k").distinct(), ["kit_id", "k"], "left_anti").select("kit_id", F.lit(None).cast("string").alias("fam"), "k", F.lit(None).cast("boolean").alias("differs")))


@query(
    f"WITH p AS (SELECT kit_id, fam, k, spec, net, row_number() OVER (PARTITION BY kit_id, fam ORDER BY k) AS rn, sum(spec) OVER (PARTITION BY kit_id, fam) AS total FROM {_PAIRED}) SELECT kit_id, fam AS name, k AS flagged, 'family' AS grain FROM p WHERE rn = 1 AND total > 0 AND abs(total - net) > 0.2 "
    f"UNION ALL SELECT a.kit_id, a.k, a.k, 'item' FROM (SELECT kit_id, k, max(net_weight) AS w FROM {_R} WHERE role = 'packing' AND k IS NOT NULL GROUP BY 1, 2) a JOIN (SELECT kit_id, k, max(net_weight) AS w FROM {_R} WHERE role = 'specification' AND k IS NOT NULL GROUP BY 1, 2) b ON a.kit_id = b.kit_id AND a.k = b.k WHERE abs(a.w - b.w) > 0.2 AND NOT EXISTS (SELECT 1 FROM p WHERE p.kit_id = a.kit_id AND p.k = a.k AND rn = 1 AND total > 0 AND abs(total - net) > 0.2)"
)
def v5_weight_drift(spark, sf_dir):
    """One flag on the first colour of a family that drifts, and item flags for those not flagged by it."""
    pairs = L.prefix_join(_kids(spark, sf_dir), _families(spark, sf_dir).withColumnRenamed("kit_id", "kit_2"), "k", "fam").where("kit_id = kit_2")
    fam = pairs.groupBy("kit_id", "fam").agg(F.min("k").alias("flagged"), F.sum("spec").alias("total"), F.first("net").alias("net"))
    fam = fam.where((F.col("total") > 0) & (F.abs(F.col("total") - F.col("net")) > 0.2)).select("kit_id", F.col("fam").alias("name"), "flagged", F.lit("family").alias("grain"))
    w = _rows(spark, sf_dir).where("k is not null").groupBy("kit_id", "k").agg(*(F.max(F.when(F.col("role") == r, F.col("net_weight"))).alias(r) for r in ("packing", "specification")))
    item = w.where(F.abs(F.col("packing") - F.col("specification")) > 0.2).select("kit_id", F.col("k").alias("name"), F.col("k").alias("flagged"), F.lit("item").alias("grain"))
    return fam.unionByName(item.join(fam.select("kit_id", "flagged"), ["kit_id", "flagged"], "left_anti").select(fam.columns))


@query("WITH n AS (SELECT DISTINCT upper(article) AS name FROM articles_ref), w AS (SELECT name, regexp_split_to_array(name, '[-_/]') AS p FROM n), k AS (SELECT DISTINCT p[1] AS known FROM w UNION SELECT DISTINCT p[1] || '-' || p[2] FROM w WHERE len(p) > 2 AND length(name) % 2 = 0) SELECT name, CASE WHEN len(p) > 2 AND EXISTS (SELECT 1 FROM k WHERE known = p[1] || '-' || p[2]) THEN p[1] || '-' || p[2] ELSE p[1] END AS parent FROM w WHERE len(p) > 1")
def j5_component_parent(spark, sf_dir):
    names = table(spark, sf_dir, "articles_ref").select(F.upper("article").alias("name")).distinct()
    p = F.split("name", "[-_/]")
    one = names.select(p[0].alias("known"))
    two = names.where((F.size(p) > 2) & (F.length("name") % 2 == 0)).select(F.concat_ws("-", p[0], p[1]).alias("known"))
    return L.longest_known_prefix(names, one.unionByName(two).distinct(), "name", "known")


_CAT = f"(SELECT *, {_KEY} AS k FROM articles_ref)"


@query(
    f"WITH i AS {_I}, c AS {_CAT}, a AS (SELECT DISTINCT ON (k) * FROM c ORDER BY k, article), m AS (SELECT DISTINCT ON (f) split_part(normalized, '-', 1) AS f, * FROM c ORDER BY f, article), h AS (SELECT hs_code, min(description_en) AS description_en, arg_min(hs_code, article) AS code FROM c GROUP BY 1 HAVING count(DISTINCT description_en) = 1) "
    "SELECT i.item_id, CASE WHEN a.k IS NOT NULL THEN 'key' WHEN b.normalized IS NOT NULL THEN 'normal' WHEN m.f IS NOT NULL THEN 'model' WHEN h.hs_code IS NOT NULL THEN 'code' ELSE 'none' END AS path, coalesce(a.hs_code, b.hs_code, m.hs_code, h.code, i.hs_code) AS hs_code, coalesce(a.description_en, b.description_en, m.description_en, h.description_en, i.description) AS description "
    "FROM i LEFT JOIN a ON i.k = a.k LEFT JOIN c b ON i.article = b.normalized LEFT JOIN m ON split_part(i.item_key, '-', 1) = m.f LEFT JOIN h ON i.hs_code = h.hs_code"
)
def j6_catalog_lookup(spark, sf_dir):
    """Key, normalized article, model (what stands before the first hyphen), then the code unless its descriptions disagree."""
    ref = table(spark, sf_dir, "articles_ref").withColumn("k", K.match_key(F.col("article")))
    values = ["hs_code", "description_en"]
    model = lambda c: F.split_part(F.col(c), F.lit("-"), F.lit(1))
    steps = [
        ("key", F.col("k"), J.catalog_first(ref, F.col("k"), values, ["article"])),
        ("normal", F.col("article"), J.catalog_first(ref, F.col("normalized"), values, ["article"])),
        ("model", model("item_key"), J.catalog_first(ref, model("normalized"), values, ["article"])),
        ("code", F.col("hs_code"), J.catalog_first(ref, F.col("hs_code"), values, ["article"], agree="description_en")),
    ]
    got = J.catalog_lookup(_items(spark, sf_dir), steps, values)
    return J.filled(got, {"hs_code": "cat_hs_code", "description": "cat_description_en"}, ("hs_code", "description")).select("item_id", "path", "hs_code", "description")


@query(f"SELECT i.item_id, coalesce(i.hs_code, c.hs_code) AS hs_code, coalesce(i.description, c.description_en) AS description, coalesce(left(i.hs_code, 6) <> left(c.hs_code, 6), false) AS mismatch, c.article IS NULL AS miss FROM {_I} i LEFT JOIN articles_ref c ON i.article = c.article")
def j11_v3_catalog_fill(spark, sf_dir):
    """Catalog values fill gaps only; another code is a mismatch, an article without a catalog row a miss."""
    ref = table(spark, sf_dir, "articles_ref").select("article", F.col("hs_code").alias("c_hs"), F.col("description_en").alias("c_text"), F.lit(True).alias("hit"))
    got = _items(spark, sf_dir).join(ref, "article", "left").withColumn("mismatch", F.coalesce(F.left("hs_code", F.lit(6)) != F.left("c_hs", F.lit(6)), F.lit(False)))
    return J.filled(got, {"hs_code": "c_hs", "description": "c_text"}).select("item_id", "hs_code", "description", "mismatch", F.col("hit").isNull().alias("miss"))


@query(f"SELECT a.line_id, b.line_id AS packing_id, coalesce(nullif(a.vendor, ''), b.vendor) AS vendor, coalesce(nullif(a.hs, ''), b.hs) AS hs, CASE WHEN b.measure_group_id IS NULL THEN coalesce(a.net, b.net) END AS net, CASE WHEN b.measure_group_id IS NULL THEN coalesce(a.gross, b.gross) END AS gross, CASE WHEN b.measure_group_id IS NULL THEN coalesce(a.packages, b.packages) END AS packages, coalesce(a.volume, b.volume) AS volume FROM {_D} a JOIN (SELECT DISTINCT ON (model) * FROM {_D} WHERE source LIKE 'PL%' AND model IS NOT NULL ORDER BY model, line_id) b ON a.model = b.model WHERE a.source NOT LIKE 'PL%' AND a.measure_group_id IS NULL")
def j8_merge_pair(spark, sf_dir):
    """A line filled from its packing line; a measure shared by several lines gives no weights."""
    lines = _lines(spark, sf_dir).where("model is not null and source is not null")
    kept = ["vendor", "hs", "net", "gross", "packages", "volume", "measure_group_id"]
    packing = lines.where(F.col("source").startswith("PL")).groupBy("model").agg(F.min("line_id").alias("packing_id"), F.min_by(F.struct(*kept), "line_id").alias("b")).select("model", "packing_id", *(F.col(f"b.{c}").alias(f"b_{c}") for c in kept))
    got = lines.where(~F.col("source").startswith("PL") & F.col("measure_group_id").isNull()).join(packing, "model")
    got = J.filled(got.withColumns({c: F.nullif(c, F.lit("")) for c in ("vendor", "hs")}), {c: f"b_{c}" for c in kept[:-1]})
    return got.select("line_id", "packing_id", "vendor", "hs", *(F.when(F.col("b_measure_group_id").isNull(), F.col(c)).alias(c) for c in ("net", "gross", "packages")), "volume")


@query(f"SELECT kit_id, role, source, n_lines FROM (SELECT *, row_number() OVER (PARTITION BY kit_id, role ORDER BY pdf DESC, CASE WHEN pdf THEN 0 ELSE -n_lines END, source) AS rn FROM (SELECT kit_id, role, source, count(*) AS n_lines, role = 'invoice' AND ends_with(source, '.pdf') AS pdf FROM {_R} WHERE source IS NOT NULL GROUP BY 1, 2, 3)) WHERE rn = 1")
def j9_base_document(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("source is not null")
    return J.pick_document(rows, ["kit_id", "role"], "source", (F.col("role") == "invoice") & F.col("source").endswith(".pdf"))


@query(f"SELECT kit_id, count(DISTINCT g) > 1 AS weight_conflict FROM (SELECT kit_id, source, round(coalesce(sum(CAST(gross_weight AS DECIMAL(24,6))), 0), 2) AS g FROM {_R} WHERE role = 'packing' GROUP BY 1, 2) GROUP BY 1")
def v14_weight_conflict(spark, sf_dir):
    by_paper = _rows(spark, sf_dir, "packing").groupBy("kit_id", "source").agg(F.coalesce(_sum("gross_weight", 2), F.lit(0.0)).alias("g"))
    return by_paper.groupBy("kit_id").agg((F.count_distinct("g") > 1).alias("weight_conflict"))


@query(
    f"WITH d AS (SELECT kit_id, normalized AS k, CAST(qty AS VARCHAR) AS t, price, net_weight, row_id FROM {_R} WHERE normalized IS NOT NULL), n AS (SELECT kit_id, k, count(DISTINCT t) AS lots, min(t) AS only FROM d WHERE t IS NOT NULL GROUP BY 1, 2), p AS (SELECT d.*, coalesce(d.t, CASE WHEN n.lots = 1 THEN n.only END, '') AS token FROM d LEFT JOIN n ON d.kit_id = n.kit_id AND d.k = n.k) SELECT kit_id, k, count(*) AS n_rows, arg_min(price, row_id) FILTER (price IS NOT NULL) AS price, arg_min(net_weight, row_id) FILTER (net_weight IS NOT NULL) AS net_weight, min(row_id) AS first_row, token = '' AS loose FROM p GROUP BY kit_id, k, token"
)
def j10_outer_merge(spark, sf_dir):
    """Lots by normalized article and quantity; a row without a quantity joins the only lot, and none of several."""
    rows = _rows(spark, sf_dir).where("normalized is not null").withColumn("token", F.coalesce(F.col("qty").cast("string"), F.lit("")))
    got = L.assemble_lots(rows.withColumn("k", F.col("normalized")), ["kit_id", "k"], "token", ["price", "net_weight"], ["row_id"], only=True)
    return got.select("kit_id", "k", "n_rows", "price", "net_weight", "first_row", (F.col("token") == "").alias("loose"))


@query(
    f"WITH p AS (SELECT kit_id, {_FAM} AS pk, max(net_weight) AS net FROM {_R} WHERE role = 'packing' AND length({_FAM}) >= 3 GROUP BY 1, 2), i AS (SELECT kit_id, k, {_dec('qty')} AS metres FROM {_R} r WHERE role = 'invoice' AND k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.kit_id = r.kit_id AND p.pk = r.k) GROUP BY 1, 2), "
    "c AS (SELECT i.*, p.pk, p.net, count(*) OVER g AS n, sum(coalesce(i.metres, 0)) OVER g AS total FROM i JOIN p ON i.kit_id = p.kit_id AND i.k <> p.pk AND starts_with(i.k, p.pk) WINDOW g AS (PARTITION BY i.kit_id, p.pk)) SELECT kit_id, pk AS parent, k, CASE WHEN total > 0 THEN CAST(round(CAST(net * coalesce(metres, 0) / total AS DECIMAL(24,8)), 2) AS DOUBLE) END AS net, total <= 0 AS impossible FROM c WHERE n >= 2 AND net IS NOT NULL"
)
def j12_v11_prefix_aggregates(spark, sf_dir):
    """A packing key that begins two invoice keys or more without packing of their own: its weight by metres, or a flag that it can't be."""
    packing = _rows(spark, sf_dir, "packing").withColumn("fam", _family()).where("length(fam) >= 3").groupBy("kit_id", F.col("fam").alias("parent")).agg(F.max("net_weight").alias("total_net"))
    goods = _rows(spark, sf_dir, "invoice").where("k is not null").groupBy("kit_id", "k").agg(_sum("qty").alias("metres"))
    goods = goods.join(packing.select("kit_id", F.col("parent").alias("k")), ["kit_id", "k"], "left_anti")
    w = Window.partitionBy("kit_id", "parent")
    got = J.prefix_parents(goods, packing, ["kit_id"], "k", "parent").withColumns({"n": F.count("*").over(w), "total": F.sum(F.coalesce("metres", F.lit(0.0))).over(w)}).where("n >= 2 and total_net is not null")
    part = F.round((F.col("total_net") * F.coalesce("metres", F.lit(0.0)) / F.nullif("total", F.lit(0.0))).cast("decimal(24,8)"), 2).cast("double")
    return got.select("kit_id", "parent", "k", F.when(F.col("total") > 0, part).alias("net"), (F.col("total") <= 0).alias("impossible"))


@query(
    f"WITH i AS (SELECT kit_id, k, min(row_id) AS row_id, arg_min(normalized, row_id) AS normalized, {_dec('qty')} AS qty FROM {_R} WHERE role = 'invoice' AND k IS NOT NULL GROUP BY 1, 2), s AS (SELECT kit_id, k, {_dec('net_weight')} AS net FROM {_R} WHERE role = 'specification' AND k IS NOT NULL GROUP BY 1, 2), p AS (SELECT kit_id, k, {_dec('gross_weight')} AS gross FROM {_R} WHERE role = 'packing' AND k IS NOT NULL GROUP BY 1, 2), "
    f"f AS (SELECT kit_id, {_FAM} AS fam, {_dec('gross_weight')} AS gross FROM {_R} WHERE role = 'packing' AND {_FAM} IS NOT NULL GROUP BY 1, 2) SELECT i.kit_id, i.k, i.qty, s.net AS spec_net, coalesce(p.gross, f.gross) AS gross, CASE WHEN p.k IS NOT NULL THEN 'article' WHEN f.fam IS NOT NULL THEN 'family' ELSE 'none' END AS packing, r.hs_code "
    f"FROM (SELECT i.*, x.fam FROM i JOIN (SELECT kit_id, k, {_FAM} AS fam, row_id FROM {_R}) x ON x.row_id = i.row_id) i LEFT JOIN s ON i.kit_id = s.kit_id AND i.k = s.k LEFT JOIN p ON i.kit_id = p.kit_id AND i.k = p.k LEFT JOIN f ON i.kit_id = f.kit_id AND i.fam = f.fam LEFT JOIN articles_ref r ON r.normalized = i.normalized"
)
def j14_star_join(spark, sf_dir):
    """Invoice articles with specification sums, packing by article or else by family, and the reference's code."""
    rows = _rows(spark, sf_dir).withColumn("fam", _family())
    by = lambda role, key: rows.where((F.col("role") == role) & F.col(key).isNotNull()).groupBy("kit_id", key)
    base = by("invoice", "k").agg(F.min_by(F.struct("normalized", "fam"), "row_id").alias("f"), _sum("qty").alias("qty")).select("kit_id", "k", "qty", "f.*")
    spec = by("specification", "k").agg(_sum("net_weight").alias("spec_net"))
    pack = by("packing", "k").agg(_sum("gross_weight").alias("p_gross"), F.lit(True).alias("p_hit"))
    fams = by("packing", "fam").agg(_sum("gross_weight").alias("f_gross"), F.lit(True).alias("f_hit"))
    ref = table(spark, sf_dir, "articles_ref").select("normalized", F.col("hs_code").alias("r_hs"))
    got = base.join(spec, ["kit_id", "k"], "left").join(pack, ["kit_id", "k"], "left").join(fams, ["kit_id", "fam"], "left").join(ref, "normalized", "left")
    return got.select("kit_id", "k", "qty", "spec_net", F.coalesce("p_gross", "f_gross").alias("gross"), F.when(F.col("p_hit"), "article").when(F.col("f_hit"), "family").otherwise("none").alias("packing"), F.col("r_hs").alias("hs_code"))


@query(f"SELECT DISTINCT p.kit_id, p.k FROM {_R} p WHERE p.role = 'packing' AND p.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_R} i WHERE i.kit_id = p.kit_id AND i.role = 'specification') AND NOT EXISTS (SELECT 1 FROM {_R} s WHERE s.kit_id = p.kit_id AND s.k = p.k AND s.role = 'invoice')")
def j15_orphan_packing(spark, sf_dir):
    """Packing articles of kits without any specification that no invoice knows."""
    rows = _rows(spark, sf_dir)
    packing = rows.where("role = 'packing' and k is not null").select("kit_id", "k").distinct()
    known = rows.where("role = 'invoice'").select("kit_id", "k").distinct()
    return packing.join(rows.where("role = 'specification'").select("kit_id").distinct(), "kit_id", "left_anti").join(known, ["kit_id", "k"], "left_anti")


@query(f"SELECT kit_id, k, 'invoice' AS origin, {_dec('qty')} AS qty FROM {_R} WHERE role = 'invoice' AND k IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT kit_id, k, 'specification', {_dec('qty')} FROM {_R} s WHERE role = 'specification' AND k IS NOT NULL AND (kit_id, k) NOT IN (SELECT kit_id, k FROM {_R} WHERE role = 'invoice' AND k IS NOT NULL) GROUP BY 1, 2")
def j16_u2_union_unseen(spark, sf_dir):
    a, b = (_rows(spark, sf_dir, r).where("k is not null").groupBy("kit_id", "k").agg(_sum("qty").alias("qty")).withColumn("origin", F.lit(r)) for r in ("invoice", "specification"))
    return J.union_unseen(a, b, ["kit_id", "k"])


_RICH = ["price", "amount", "net_weight", "gross_weight", "hs_code", "color"]


@query(f"WITH s AS (SELECT *, {' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _RICH)} AS score FROM {_R} WHERE k IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY kit_id, k, qty ORDER BY score DESC, row_id) AS rn FROM s) SELECT kit_id, k, qty, max(score) AS filled, " + ", ".join(f"first({c} ORDER BY rn) FILTER ({c} IS NOT NULL) AS {c}" for c in _RICH) + " FROM o GROUP BY 1, 2, 3")
def j17_richest_row(spark, sf_dir):
    return J.richest(_rows(spark, sf_dir).where("k is not null"), ["kit_id", "k", "qty"], _RICH, ["row_id"])


@query(f"WITH a AS (SELECT kit_id, k, max(price) AS price FROM {_R} WHERE k IS NOT NULL GROUP BY 1, 2) SELECT kit_id, k FROM a WHERE NOT (price IS NULL AND EXISTS (SELECT 1 FROM a b WHERE b.kit_id = a.kit_id AND b.k <> a.k AND length(b.k) >= 3 AND starts_with(a.k, b.k)))")
def j18_component_drop(spark, sf_dir):
    """Articles but for unpriced ones that begin with another article of their kit."""
    a = _rows(spark, sf_dir).where("k is not null").groupBy("kit_id", "k").agg(F.max("price").alias("price"))
    parts = J.prefix_parents(a.where("price is null").select("kit_id", "k"), a.select("kit_id", F.col("k").alias("parent")), ["kit_id"], "k", "parent")
    return a.select("kit_id", "k").join(parts.select("kit_id", "k").distinct(), ["kit_id", "k"], "left_anti")


_C = f"(SELECT *, {_KEY} AS k FROM (SELECT DISTINCT ON (item_id) * FROM canonical_items_copy WHERE item_id IS NOT NULL ORDER BY item_id, loaded_at))"


@query(f"SELECT scan_id, item_id FROM (SELECT c.item_id AS scan_id, i.item_id, row_number() OVER (PARTITION BY c.item_id ORDER BY i.item_id) AS rn FROM {_C} c JOIN {_I} i ON c.k = i.k AND c.price IS NOT DISTINCT FROM i.price WHERE c.qty IS NULL OR abs(c.qty - i.qty) <= greatest(0.05, 0.002 * abs(i.qty))) WHERE rn = 1")
def j19_scan_match(spark, sf_dir):
    """Each row of the second reading with the first item of its article and price, and of its quantity where it has one.

    The price in the key keeps a common article from meeting itself in full.
    """
    scan = J.once(table(spark, sf_dir, "canonical_items_copy"), "item_id", "loaded_at").select(F.col("item_id").alias("scan_id"), K.match_key(F.col("article")).alias("k"), F.coalesce("price", F.lit(-1.0)).alias("p"), F.col("qty").alias("s_qty"))
    items = _items(spark, sf_dir).select("item_id", "k", F.coalesce("price", F.lit(-1.0)).alias("p"), "qty")
    rank = F.when(F.col("s_qty").isNull() | M.is_close(F.col("qty"), F.col("s_qty"), 0.05, 0.002), 1)
    return J.ranked_join(scan, items, ["k", "p"], rank, ["item_id"], "scan_id").select("scan_id", "item_id")


@query(f"SELECT c.item_id FROM {_C} c WHERE c.k IS NOT NULL AND c.qty IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_I} i WHERE i.k = c.k AND CAST(i.qty AS VARCHAR) = CAST(c.qty AS VARCHAR))")
def j21_unknown_lots(spark, sf_dir):
    """Lots of the second copy that the first doesn't know by article and quantity."""
    copy = J.once(table(spark, sf_dir, "canonical_items_copy"), "item_id", "loaded_at").withColumn("k", K.match_key(F.col("article"))).where("k is not null and qty is not null")
    return copy.join(_items(spark, sf_dir).select("k", "qty").distinct(), ["k", "qty"], "left_anti").select("item_id")


@query(f"SELECT DISTINCT kit_id, {_FAM} AS design, rolls, qty FROM {_R} WHERE role = 'packing' AND rolls IS NOT NULL")
def j23_packing_groups(spark, sf_dir):
    return _rows(spark, sf_dir, "packing").where("rolls is not null").select("kit_id", _family().alias("design"), "rolls", "qty").distinct()


_SIDE = "(SELECT kit_id, k, CAST(qty AS VARCHAR) AS t, row_id, {c} AS {a}, row_number() OVER (PARTITION BY kit_id, k, qty ORDER BY row_id) AS ordinal FROM {r} WHERE role = '{role}' AND k IS NOT NULL AND qty IS NOT NULL)"


@query(
    "SELECT coalesce(a.kit_id, b.kit_id) AS kit_id, coalesce(a.k, b.k) AS k, CAST(coalesce(a.ordinal, b.ordinal) AS INTEGER) AS ordinal, a.row_id AS left_row, b.row_id AS right_row, coalesce(b.net, a.net) AS net FROM " + _SIDE.format(c="net_weight", a="net", r=_R, role="specification") + " a FULL JOIN " + _SIDE.format(c="net_weight", a="net", r=_R, role="packing") + " b ON a.kit_id = b.kit_id AND a.k = b.k AND a.t = b.t AND a.ordinal = b.ordinal"
)
def j24_line_merge(spark, sf_dir):
    """Lines of specification and packing of equal quantity, the n-th with the n-th; packing weights win."""
    side = lambda role, p: _rows(spark, sf_dir, role).where("k is not null and qty is not null").select("kit_id", "k", "qty", F.col("row_id").alias(f"{p}_row"), F.col("net_weight").alias(f"{p}_net"))
    left = side("specification", "left").withColumn("at", F.col("left_row"))
    right = side("packing", "right").withColumn("at", F.col("right_row"))
    n = lambda df: df.withColumn("ordinal", F.row_number().over(Window.partitionBy("kit_id", "k", "qty").orderBy("at"))).drop("at")
    got = n(left).join(n(right), ["kit_id", "k", "qty", "ordinal"], "full")
    return got.select("kit_id", "k", "ordinal", "left_row", "right_row", F.coalesce("right_net", "left_net").alias("net"))


@query(f"SELECT kit_id, k, count(*) AS n, {_dec('rolls')} AS rolls, {_dec('net_weight')} AS net, CASE WHEN coalesce({_dec('rolls')}, 0) = 0 AND coalesce(arg_min(unit, row_id) FILTER (unit IS NOT NULL), '') <> 'pcs' THEN {_dec('qty')} ELSE {_dec('rolls')} END AS metres, arg_max(price, row_id) FILTER (price IS NOT NULL) AS price, arg_min(unit, row_id) FILTER (unit IS NOT NULL) AS unit, arg_min(description, row_id) FILTER (description IS NOT NULL) AS description FROM {_R} WHERE k IS NOT NULL GROUP BY 1, 2")
def a2_roll_aggregate(spark, sf_dir):
    """Rolls of an article: count, sums, last price, first unit and description; metres from the quantity where none are given and it isn't pieces."""
    g = _rows(spark, sf_dir).where("k is not null").groupBy("kit_id", "k")
    first, last = (lambda c, f=f: f(F.col(c), F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(c) for f in (F.min_by, F.max_by))
    got = g.agg(F.count("*").alias("n"), _sum("rolls").alias("rolls"), _sum("net_weight").alias("net"), _sum("qty").alias("q"), last("price"), first("unit"), first("description"))
    metres = F.when((F.coalesce("rolls", F.lit(0.0)) == 0) & (F.coalesce("unit", F.lit("")) != "pcs"), F.col("q")).otherwise(F.col("rolls"))
    return got.select("kit_id", "k", "n", "rolls", "net", metres.alias("metres"), "price", "unit", "description")


@query(f"SELECT kit_id, k, {_dec('qty')} AS qty, {_dec('net_weight')} AS net, count(*) AS n_lines FROM {_R} WHERE k IS NOT NULL GROUP BY 1, 2")
def a5_totals_of_lines(spark, sf_dir):
    """Totals made anew from each item's own array of lines."""
    items = _rows(spark, sf_dir).where("k is not null").groupBy("kit_id", "k").agg(F.collect_list(F.struct("qty", "net_weight")).alias("lines"))
    total = lambda c: F.when(F.exists("lines", lambda x: x[c].isNotNull()), F.round(F.aggregate("lines", F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + F.coalesce(x[c].cast("decimal(24,6)"), F.lit(0).cast("decimal(24,6)"))).cast("decimal(38,6)")), 4).cast("double"))
    return items.select("kit_id", "k", total("qty").alias("qty"), total("net_weight").alias("net"), F.size("lines").cast("bigint").alias("n_lines"))


@query(rf"""WITH v AS (SELECT item_key, manufacturer, lower(regexp_replace(manufacturer, '[\s\x{{00a0}}"“”''.,]', '', 'g')) AS n FROM canonical_items WHERE manufacturer IS NOT NULL), c AS (SELECT item_key, n, count(*) AS votes, min(manufacturer) AS manufacturer, sum(count(*)) OVER (PARTITION BY item_key) AS total FROM v GROUP BY 1, 2) SELECT item_key, manufacturer, votes AS n FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY votes DESC, n) AS rn FROM c) WHERE rn = 1 AND 2 * votes >= total""")
def a20_majority_text(spark, sf_dir):
    return J.majority(table(spark, sf_dir, "canonical_items"), ["item_key"], "manufacturer", T.loose_key(F.col("manufacturer")))


@query(f"SELECT kit_id, source, count(*) AS n FROM {_R} r WHERE source IS NOT NULL AND (NOT contains(source, 'скан') OR NOT EXISTS (SELECT 1 FROM {_R} x WHERE x.kit_id = r.kit_id AND NOT contains(x.source, 'скан'))) GROUP BY 1, 2")
def u6_books_before_scans(spark, sf_dir):
    """Scanned papers count only in kits that have no other."""
    rows = _rows(spark, sf_dir).where("source is not null").withColumn("scan", F.col("source").contains("скан"))
    kits = rows.groupBy("kit_id").agg(F.min(F.col("scan").cast("int")).alias("only"))
    papers = rows.groupBy("kit_id", "source", "scan").agg(F.count("*").alias("n"))
    return papers.join(kits, "kit_id").where("not scan or only = 1").select("kit_id", "source", "n")


@query(f"SELECT kit_id, row_id, CAST(row_number() OVER (PARTITION BY kit_id ORDER BY CASE role WHEN 'invoice' THEN 0 WHEN 'mixed' THEN 1 WHEN 'goods' THEN 2 WHEN 'specification' THEN 3 ELSE 4 END, row_id) AS INTEGER) AS place FROM {_R}")
def o5_o6_role_order(spark, sf_dir):
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("invoice", "mixed", "goods", "specification"))), F.col("role")), F.lit(0).cast("bigint")), F.lit(9).cast("bigint"))
    return _rows(spark, sf_dir).select("kit_id", "row_id", F.row_number().over(Window.partitionBy("kit_id").orderBy(rank, "row_id")).alias("place"))


@query("SELECT kit_id, article, arg_min(row_id, loaded_at) AS row_id FROM (SELECT kit_id, article, row_id, loaded_at + to_microseconds(row_id) AS loaded_at FROM extracted_rows WHERE kit_id IS NOT NULL AND article IS NOT NULL) GROUP BY 1, 2")
def o9_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "extracted_rows").where("kit_id is not null and article is not null")
    return rows.groupBy("kit_id", "article").agg(F.min_by("row_id", F.col("loaded_at") + F.expr("make_dt_interval(0, 0, 0, cast(row_id as decimal(18,6)) / 1000000)")).alias("row_id"))


@query("SELECT item_id, field FROM (SELECT i.item_id, unnest(['qty', 'price', 'net_weight']) AS field, unnest([CAST(i.qty IS DISTINCT FROM c.qty AS INTEGER), CAST(i.price IS DISTINCT FROM c.price AS INTEGER), CAST(i.net_weight IS DISTINCT FROM c.net_weight AS INTEGER)]) AS d FROM " + _I + " i JOIN " + _C + " c USING (item_id)) WHERE d = 1")
def u4_except_fields(spark, sf_dir):
    """Fields of items that the copy doesn't have alike: a set difference of (item, field, value)."""
    long = lambda df: df.select("item_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("qty", "price", "net_weight")))).alias("x")).select("item_id", "x.*")
    copy = J.once(table(spark, sf_dir, "canonical_items_copy"), "item_id", "loaded_at")
    both = _items(spark, sf_dir).join(copy.select("item_id"), "item_id", "left_semi")
    return long(both).exceptAll(long(copy)).select("item_id", "field")
