"""Queries of the general problems 1 and 2 over the test tables, with SQL for comparison where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import copy_diff, quantity_units
from ..sources.tables import table


#: About how many records the model of missing units is fitted on; the bound of what comes to the driver.
SAMPLE = 20000


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, float]:
    """Lines, items, and the share of both that the model of missing units is fitted on."""
    lines, items = table(spark, sf_dir, "doc_lines"), table(spark, sf_dir, "reconciled_items")
    return lines, items, quantity_units.sample_share(lines.count() + items.count(), SAMPLE)


def _statements(lines: DataFrame, items: DataFrame, every_feature: bool = True) -> DataFrame:
    return quantity_units.line_statements(lines, every_feature).unionByName(quantity_units.item_statements(items, every_feature))


def _model(lines: DataFrame, items: DataFrame, share: float) -> quantity_units.UnitModel:
    """Only the sampled records are parsed; each counts once, however often it was delivered."""
    some = [x.where(quantity_units.in_sample(i, share=share)).dropDuplicates([i]) for x, i in ((lines, "line_id"), (items, "recon_id"))]
    return quantity_units.train(_statements(*some))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that state one quantity twice, in two different units or scales, and agree."""
    lines, items, share = _units(spark, sf_dir)
    return quantity_units.stated_twice(quantity_units.resolve(_statements(lines, items, False), _model(lines, items, share)))


def p1_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of a quantity in metres, square metres, kilograms, cubic metres or pieces."""
    lines, items, share = _units(spark, sf_dir)
    return quantity_units.every_quantity(_statements(lines, items), _model(lines, items, share))


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units predicted for the statements outside the model's sample, as if they were missing, beside those stated."""
    lines, items, share = _units(spark, sf_dir)
    others = [x.where(~quantity_units.in_sample(i, share=share)) for x, i in ((lines, "line_id"), (items, "recon_id"))]
    return quantity_units.masked(_statements(*others), _model(lines, items, share))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the two copies of kit totals and of items."""
    kit = copy_diff.diff_maps(table(spark, sf_dir, "kit_results"), "kit_id", "totals_got", "totals_etalon_hint", "attempt")
    item = copy_diff.diff_copies(table(spark, sf_dir, "canonical_items"), table(spark, sf_dir, "canonical_items_copy"), "item_id", ("loaded_at",))
    return copy_diff.all_differences({"kit": kit, "item": item})


QUERIES = {"p1_found": p1_found, "p1_quantities": p1_quantities, "p1_masked": p1_masked, "p2_found": p2_found}

_TEXTS = ("article", "item_key", "color", "description", "hs_code", "unit", "currency", "manufacturer", "country")
_NUMBERS = ("qty", "price", "amount", "net_weight", "gross_weight")
_SOURCES = "coalesce(array_to_string(list_sort({s}.sources), chr(31)), '')"
_FLAGS = "coalesce(array_to_string(list_sort(list_transform({s}.flags, lambda x: concat_ws(chr(30), coalesce(x.field_name, ''), coalesce(x.error_type, ''), coalesce(x.severity, ''), coalesce(x.message, '')))), chr(31)), '')"


def _item_columns() -> str:
    parts = [f"SELECT item_id, '{c}' AS field_name FROM b WHERE coalesce(l.{c}, '') <> coalesce(r.{c}, '')" for c in _TEXTS]
    parts += [f"SELECT item_id, '{c}' FROM b WHERE (l.{c} IS NULL) <> (r.{c} IS NULL) OR abs(l.{c} - r.{c}) > 0.010001" for c in _NUMBERS]
    parts += [f"SELECT item_id, '{c}' FROM b WHERE {e.format(s='l')} <> {e.format(s='r')}" for c, e in (("sources", _SOURCES), ("flags", _FLAGS))]
    return " UNION ALL ".join(parts)


ORACLE = {
    "p2_found": f"""
WITH l AS (SELECT item_id, any_value(t) AS l FROM (SELECT item_id, t FROM canonical_items t) GROUP BY item_id),
r AS (SELECT item_id, any_value(t) AS r FROM (SELECT item_id, t FROM canonical_items_copy t) GROUP BY item_id),
b AS (SELECT l.item_id, l.l, r.r FROM l JOIN r ON l.item_id = r.item_id),
k AS (SELECT kit_id, arg_max(totals_got, attempt) AS g, arg_max(totals_etalon_hint, attempt) AS h, max(attempt) AS a FROM kit_results GROUP BY kit_id),
kk AS (SELECT DISTINCT k.kit_id, t.totals_got AS g, t.totals_etalon_hint AS h FROM k JOIN kit_results t ON t.kit_id = k.kit_id AND t.attempt = k.a),
g AS (SELECT kit_id, unnest(map_entries(g)) AS e FROM kk WHERE g IS NOT NULL AND h IS NOT NULL),
h AS (SELECT kit_id, unnest(map_entries(h)) AS e FROM kk WHERE g IS NOT NULL AND h IS NOT NULL),
gn AS (SELECT kit_id, e.key AS field_name, e.value AS v FROM g WHERE e.value IS NOT NULL),
ht AS (SELECT kit_id, e.key AS field_name, regexp_replace(regexp_replace(trim(e.value), '[A-Za-zА-Яа-я. ]*$', ''), '[\\s\\x{{00a0}}\\x{{202f}}\\x{{2009}}''’]', '', 'g') AS t FROM h WHERE coalesce(trim(e.value), '') <> ''),
hn AS (SELECT kit_id, field_name, CASE WHEN regexp_matches(t, '[.,]\\d\\d\\d$') OR NOT regexp_matches(t, '[.,]') THEN TRY_CAST(regexp_replace(t, '[.,]', '', 'g') AS DOUBLE)
  ELSE TRY_CAST(regexp_replace(regexp_extract(t, '^(.*)[.,]\\d*$', 1), '[.,]', '', 'g') || '.' || regexp_extract(t, '[.,](\\d*)$', 1) AS DOUBLE) END AS v FROM ht)
SELECT 'item' AS scope, CAST(coalesce(l.item_id, r.item_id) AS VARCHAR) AS record_key, '*' AS field_name, CASE WHEN l.item_id IS NULL THEN 'missing_left' ELSE 'missing_right' END AS diff_kind
FROM l FULL JOIN r ON l.item_id = r.item_id WHERE l.item_id IS NULL OR r.item_id IS NULL
UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), field_name, 'differs' FROM ({_item_columns()})
UNION ALL SELECT 'kit', kit_id, '*', CASE WHEN g IS NULL THEN 'missing_left' ELSE 'missing_right' END FROM kk WHERE (g IS NULL) <> (h IS NULL)
UNION ALL SELECT 'kit', coalesce(gn.kit_id, hn.kit_id), coalesce(gn.field_name, hn.field_name), CASE WHEN gn.kit_id IS NULL THEN 'missing_left' WHEN hn.kit_id IS NULL THEN 'missing_right' ELSE 'differs' END
FROM gn FULL JOIN hn ON gn.kit_id = hn.kit_id AND gn.field_name = hn.field_name WHERE gn.kit_id IS NULL OR hn.kit_id IS NULL OR abs(gn.v - hn.v) > 0.010001
""",
}
