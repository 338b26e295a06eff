"""Queries of the reconciliation operators over the test tables, with the same question as SQL for comparison.

Names begin with the operator's id in the survey. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.numbers import written_number
from ..operators import lots as L
from ..sources.tables import table
from ..streaming.windows import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


_KEY = "nullif(regexp_replace(upper(article), '[^0-9A-Za-zА-Яа-яЁё]+', '', 'g'), '')"
_KEYED = f"(SELECT *, {_KEY} AS k FROM extracted_rows)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extracted_rows").withColumn("k", K.match_key(F.col("article")))


# --- scalar functions -------------------------------------------------------------------------------------------------
@query(f"SELECT {_KEY} AS match_key, count(*) AS n FROM extracted_rows GROUP BY 1")
def n1_match_key(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy(F.col("k").alias("match_key")).agg(F.count("*").alias("n"))


@query(r"SELECT row_id, regexp_replace(upper(article), '[\s\x{00a0}\x{2000}-\x{200b}\x{202f}\x{3000}\x{feff}]+', '', 'g') AS normalized_article FROM extracted_rows")
def n2_normalize_article(spark, sf_dir):
    return table(spark, sf_dir, "extracted_rows").select("row_id", F.regexp_replace(F.upper("article"), r"[\s  -​ 　﻿]+", "").alias("normalized_article"))


@query("SELECT row_id, coalesce(CAST(round(CAST(qty AS DECIMAL(24,8)), 6) AS VARCHAR), '') AS token FROM extracted_rows")
def n3_lot_token(spark, sf_dir):
    return table(spark, sf_dir, "extracted_rows").select("row_id", K.lot_token(F.col("qty")).alias("token"))


@query(r"SELECT doc_id, regexp_matches(text, '\p{Cyrillic}') AS cyrillic, regexp_matches(text, '\p{Han}') AS han, regexp_matches(text, '[A-Za-z]') AS latin, regexp_matches(text, '\p{Arabic}') AS arabic FROM documents")
def n13_scripts(spark, sf_dir):
    has = lambda p: F.col("text").rlike(p)
    return table(spark, sf_dir, "documents").select("doc_id", has(r"\p{IsCyrillic}").alias("cyrillic"), has(r"\p{IsHan}").alias("han"), has("[A-Za-z]").alias("latin"), has(r"\p{IsArabic}").alias("arabic"))


_SPLIT = "(SELECT kit_id, attempt, e.key AS field, trim(e.value) AS t FROM (SELECT kit_id, attempt, unnest(map_entries(totals_etalon_hint)) AS e FROM kit_results))"


@query(r"SELECT line_id, CASE WHEN w BETWEEN 20 AND 500 THEN w / 100 ELSE w END AS width, CASE WHEN pieces > 0 AND w > 0 THEN CAST(round(CAST(pieces * CASE WHEN w > 20 THEN w / 100 ELSE w END AS DECIMAL(18,6)), 4) AS DOUBLE) END AS area FROM (SELECT line_id, pieces, TRY_CAST(nullif(regexp_extract(description, 'w (\d+)', 1), '') AS DOUBLE) AS w FROM doc_lines)")
def m6_m7_width_area(spark, sf_dir):
    w = table(spark, sf_dir, "doc_lines").select("line_id", "pieces", F.regexp_extract("description", r"w (\d+)", 1).try_cast("double").alias("w"))
    return w.select("line_id", K.width_in_metres(F.col("w")).alias("width"), K.area(F.col("pieces"), F.col("w")).alias("area"))


# --- text to cells ----------------------------------------------------------------------------------------------------
@query(r"SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, CAST(len(regexp_split_to_array(line, '\s{2,}|\t')) AS INTEGER) AS cells FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))")
def s11_grid_from_text(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.size(F.split("line", r"\s{2,}|\t")).alias("cells"))


@query("WITH c AS (SELECT sheet_id, loaded_at, unnest(l) AS name, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT sheet_id, loaded_at, string_split(header_text, ' | ') AS l FROM extracted_sheets)) SELECT sheet_id, loaded_at, CAST(i - 1 AS INTEGER) AS col_no, CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS column_name FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, loaded_at, name ORDER BY i) AS n FROM c)")
def w11_unique_columns(spark, sf_dir):
    cells = table(spark, sf_dir, "extracted_sheets").select("sheet_id", "loaded_at", "header_text").distinct().select("sheet_id", "loaded_at", F.posexplode(F.split("header_text", r" \| ")).alias("col_no", "name"))
    n = F.row_number().over(Window.partitionBy("sheet_id", "loaded_at", "name").orderBy("col_no"))
    return cells.withColumn("n", n).select("sheet_id", "loaded_at", "col_no", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.col("n").cast("string"))).alias("column_name"))


# --- lots and joins ---------------------------------------------------------------------------------------------------
_TOKEN = "coalesce(CAST(round(CAST(qty AS DECIMAL(24,8)), 6) AS VARCHAR), '')"
_ORD = "CASE role WHEN 'invoice' THEN 0 WHEN 'specification' THEN 1 ELSE 2 END, row_no, row_id"
_FIELDS = ("color", "hs_code", "price", "amount", "net_weight", "gross_weight")


@query(
    f"WITH d AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM {_KEYED} WHERE k IS NOT NULL AND kit_id IS NOT NULL), o AS (SELECT *, {_TOKEN} AS token, row_number() OVER (PARTITION BY kit_id, k ORDER BY {_ORD}) AS pos FROM d), "
    "f AS (SELECT kit_id, k, arg_min(token, pos) AS first_token FROM o WHERE token <> '' GROUP BY 1, 2), p AS (SELECT o.* REPLACE (CASE WHEN o.token <> '' THEN o.token ELSE coalesce(f.first_token, '') END AS token) FROM o LEFT JOIN f ON o.kit_id = f.kit_id AND o.k = f.k), "
    "g AS (SELECT kit_id, k, token, " + ", ".join(f"arg_min({c}, pos) FILTER ({c} IS NOT NULL) AS {c}" for c in _FIELDS) + ", count(*) AS n_rows, min(pos) AS pos FROM p GROUP BY 1, 2, 3) "
    "SELECT kit_id, k, token, " + ", ".join(_FIELDS) + ", n_rows, CAST(row_number() OVER (PARTITION BY kit_id, k ORDER BY pos) AS INTEGER) AS lot_no FROM g"
)
def j1_assemble_lots(spark, sf_dir):
    rows = _rows(spark, sf_dir).drop("loaded_at").distinct().withColumn("token", K.lot_token(F.col("qty"))).withColumn("rank", F.when(F.col("role") == "invoice", 0).when(F.col("role") == "specification", 1).otherwise(2))
    return L.assemble_lots(rows, ["kit_id", "k"], "token", list(_FIELDS), ["rank", "row_no", "row_id"])


@query(f"SELECT kit_id, k, CAST(sum(CASE WHEN rolls > 0 THEN CAST(rolls AS DECIMAL(18,4)) ELSE 1 END) AS DOUBLE) AS places, CAST(sum(CAST(net_weight AS DECIMAL(18,4))) AS DOUBLE) AS net, CAST(sum(CAST(gross_weight AS DECIMAL(18,4))) AS DOUBLE) AS gross, count(*) AS n FROM {_KEYED} WHERE role = 'packing' AND k IS NOT NULL GROUP BY 1, 2")
def a1_detail_rollup(spark, sf_dir):
    total = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    rows = _rows(spark, sf_dir).where("role = 'packing' and k is not null")
    return rows.groupBy("kit_id", "k").agg(total(F.when(F.col("rolls") > 0, F.col("rolls")).otherwise(1)).alias("places"), total(F.col("net_weight")).alias("net"), total(F.col("gross_weight")).alias("gross"), F.count("*").alias("n"))


@query(f"WITH a AS (SELECT DISTINCT kit_id, k FROM {_KEYED} WHERE k IS NOT NULL) SELECT l.kit_id, l.k AS long_key, s.k AS short_key FROM a l JOIN a s ON l.kit_id = s.kit_id AND length(s.k) >= 3 AND starts_with(l.k, s.k) AND regexp_matches(substr(l.k, length(s.k) + 1), '^[0-9]{{1,4}}$')")
def j2_digit_suffix(spark, sf_dir):
    a = _rows(spark, sf_dir).where("k is not null").select("kit_id", "k").distinct()
    pairs = L.prefix_join(a.select("kit_id", F.col("k").alias("long_key")), a.select(F.col("kit_id").alias("kit_2"), F.col("k").alias("short_key")), "long_key", "short_key")
    return pairs.where("kit_id = kit_2").select("kit_id", "long_key", "short_key")


ORACLE["j2_digit_suffix"] = ORACLE["j2_digit_suffix"].replace("{{", "{").replace("}}", "}")


@query(f"WITH a AS (SELECT DISTINCT kit_id, k FROM {_KEYED} WHERE k IS NOT NULL AND role = 'invoice') SELECT s.kit_id, s.k FROM a s WHERE NOT EXISTS (SELECT 1 FROM a l WHERE l.kit_id = s.kit_id AND length(s.k) >= 3 AND starts_with(l.k, s.k) AND regexp_matches(substr(l.k, length(s.k) + 1), '^[0-9]{{1,4}}$'))".replace("{{", "{").replace("}}", "}"))
def j13_drop_prefix_parents(spark, sf_dir):
    a = _rows(spark, sf_dir).where("k is not null and role = 'invoice'").select("kit_id", "k").distinct()
    pairs = L.prefix_join(a.select("kit_id", F.col("k").alias("long_key")), a.select(F.col("kit_id").alias("kit_2"), F.col("k").alias("short_key")), "long_key", "short_key")
    return a.join(pairs.where("kit_id = kit_2").select("kit_id", F.col("short_key").alias("k")), ["kit_id", "k"], "left_anti")


@query()
def j7_best_match(spark, sf_dir):
    """Lines of draft papers matched one to one to lines of packing papers by vendor code, model, description and pieces; no SQL for the greedy claim."""
    lines = table(spark, sf_dir, "doc_lines").where("line_id is not null and source is not null and not coalesce(freight, false)").dropDuplicates(["line_id"])
    return L.match_lines(lines.select("line_id", "vendor", "model", "description", "pieces", F.col("source").startswith("PL").alias("pack")))


_SCAN = "(SELECT kit_id, k, {agg}(CAST(qty AS DECIMAL(18,4))) AS q FROM {src} WHERE role = '{role}' AND k IS NOT NULL AND qty IS NOT NULL GROUP BY 1, 2)"


@query("SELECT coalesce(a.kit_id, b.kit_id) AS kit_id, coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN abs(a.q - b.q) <= greatest(0.05, 0.002 * abs(a.q)) THEN 'matched' ELSE 'question' END AS verdict FROM " + _SCAN.format(agg="sum", src=_KEYED, role="invoice") + " a FULL JOIN " + _SCAN.format(agg="sum", src=_KEYED, role="packing") + " b ON a.kit_id = b.kit_id AND a.k = b.k")
def j20_scan_review(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("k is not null and qty is not null")
    a, b = (rows.where(F.col("role") == r).groupBy("kit_id", "k").agg(F.sum(F.col("qty").cast("decimal(18,4)")).alias(n)) for r, n in (("invoice", "a"), ("packing", "b")))
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(0.05), F.abs("a") * 0.002)
    return a.join(b, ["kit_id", "k"], "full").select("kit_id", "k", F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(near, "matched").otherwise("question").alias("verdict"))


# --- allocation, votes, totals ----------------------------------------------------------------------------------------
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax"
_SHARE = "CASE WHEN sum(CAST(l_quantity AS DECIMAL(18,4))) OVER w > 0 THEN CAST(CAST(l_quantity AS DECIMAL(18,4)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) OVER w AS DOUBLE) ELSE 1.0 / count(*) OVER w END"


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")


@query(f"WITH p AS (SELECT l.*, o_totalprice, {_SHARE.replace('OVER w', 'OVER (PARTITION BY l_orderkey)')} AS sh FROM lineitem l JOIN orders ON l_orderkey = o_orderkey), q AS (SELECT *, CAST(round(CAST(o_totalprice * sh AS DECIMAL(24,8)), 2) AS DECIMAL(18,2)) AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p) SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN rn = n THEN CAST(o_totalprice AS DECIMAL(18,2)) - coalesce(sum(part) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE part END AS DOUBLE) AS part FROM q")
def w7_allocation(spark, sf_dir):
    parts = L.allocate(_priced(spark, sf_dir), ["l_orderkey"], "o_totalprice", "l_quantity", _ORDER.split(", "))
    return parts.select("l_orderkey", "l_linenumber", "l_partkey", "part")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(o_totalprice * ({_SHARE.replace('OVER w', 'OVER (PARTITION BY l_orderkey)')}) AS DECIMAL(24,8)), 2) AS DOUBLE) AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def w8_allocation_plain(spark, sf_dir):
    return L.allocate(_priced(spark, sf_dir), ["l_orderkey"], "o_totalprice", "l_quantity", _ORDER.split(", "), exact=False).select("l_orderkey", "l_linenumber", "l_partkey", "part")


@query("WITH c AS (SELECT kit_id, currency, count(*) AS n FROM extracted_rows WHERE currency IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, max(n) OVER (PARTITION BY kit_id) AS most, count(*) OVER (PARTITION BY kit_id) AS vals FROM c), t AS (SELECT *, count(*) FILTER (n = most) OVER (PARTITION BY kit_id) AS tops FROM r) SELECT kit_id, currency, n AS votes FROM t WHERE n = most AND tops = 1 AND (vals = 1 OR most >= 2)")
def a15_agreed_vote(spark, sf_dir):
    return L.agreed_vote(table(spark, sf_dir, "extracted_rows"), ["kit_id"], "currency")


@query("SELECT item_key, min(hs_code) AS hs_code, count(*) AS votes FROM canonical_items WHERE hs_code IS NOT NULL GROUP BY 1 HAVING count(DISTINCT hs_code) = 1")
def a16_unanimous_vote(spark, sf_dir):
    return L.unanimous_vote(table(spark, sf_dir, "canonical_items"), ["item_key"], "hs_code")


@query("SELECT o_custkey, l_orderkey, CAST(CASE WHEN grouping(l_orderkey) = 0 THEN 2 WHEN grouping(o_custkey) = 0 THEN 1 ELSE 0 END AS INTEGER) AS level, CAST(round(sum(CAST(l_quantity AS DECIMAL(18,4))), 2) AS DOUBLE) AS l_quantity, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_custkey, l_orderkey)")
def a7_rollup_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return L.with_totals(rows, ["o_custkey", "l_orderkey"], ["l_quantity", "l_extendedprice"])


# --- streams over a table ---------------------------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def st1_event_windows(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events"))
