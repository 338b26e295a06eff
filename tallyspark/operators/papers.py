"""Output tables of a shipment (invoice, packing, specification, descriptions) and the checks and totals that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Columns of an output table in order, with the digits they are shown with, and those summed in its total row."""

    columns: tuple[str, ...]
    sums: tuple[str, ...] = ()
    digits: tuple[tuple[str, int], ...] = ()


# Columns of each printed table, what its total row sums, and the digits shown.
LAYOUTS = {
    "fabric_invoice": Layout(("no", "article", "hs_code", "rolls", "width", "area", "meters", "unit", "price", "amount"), ("rolls", "area", "meters", "amount")),
    "element_invoice": Layout(("no", "article", "hs_code", "rolls", "qty", "unit", "price", "amount"), ("rolls", "qty", "amount")),
    "fabric_packing": Layout(("no", "design", "gm", "rolls", "meters", "net_weight", "gross_weight", "area"), ("rolls", "meters", "net_weight", "gross_weight", "area")),
    "element_packing": Layout(("no", "design", "rolls", "qty", "unit", "net_weight", "gross_weight"), ("rolls", "qty", "net_weight", "gross_weight")),
    "element_spec": Layout(("no", "article", "description", "rolls", "hs_code", "tnved", "qty", "unit", "net_weight", "gross_weight", "price", "amount"), ("rolls", "qty", "net_weight", "gross_weight", "amount")),
    "book_invoice": Layout(("no", "tnved", "description", "article", "color", "qty", "unit", "price", "amount"), ("qty", "amount"), (("price", 4), ("amount", 2))),
    "book_packing": Layout(("no", "description", "article", "color", "qty", "unit", "gross_weight", "net_weight", "rolls"), ("qty", "gross_weight", "net_weight", "rolls"), (("gross_weight", 2), ("net_weight", 2))),
    "book_description": Layout(("article", "description", "manufacturer", "country")),
    "plain_invoice": Layout(("no", "tnved", "description", "country", "article", "manufacturer", "net_weight", "qty", "price", "unit", "amount"), ("net_weight", "qty", "amount"), (("net_weight", 3), ("price", 4), ("amount", 2))),
    "plain_packing": Layout(("no", "tnved", "description", "manufacturer", "article", "rolls", "qty", "net_weight", "gross_weight", "country"), ("rolls", "qty", "net_weight", "gross_weight"), (("net_weight", 3), ("gross_weight", 3))),
    "plain_declaration": Layout(("tnved", "description", "manufacturer", "article", "qty", "unit", "price", "rolls"), ("qty", "rolls"), (("price", 4),)),
}
# Printed labels of the columns; price and amount carry the currency.
LABELS = {"no": "No", "article": "Article", "hs_code": "H.S. code", "tnved": "TN VED", "rolls": "Packages", "width": "Width, m", "area": "Area, m2", "meters": "Metres", "qty": "Quantity", "unit": "Unit", "price": "Unit price", "amount": "Amount", "design": "Design", "gm": "g/m", "net_weight": "Net, kg", "gross_weight": "Gross, kg", "description": "Description", "manufacturer": "Manufacturer", "country": "Country", "color": "Colour"}


def labels(layout: str, currency: str | None = None) -> list[str]:
    """Printed titles of a table; the currency stands behind price and amount if one is known."""
    money = f" ({currency})" if currency else ""
    return [LABELS[c] + (money if c in ("price", "amount") else "") for c in LAYOUTS[layout].columns]


def numbered_rows(rows: DataFrame, shipment: list[str], order: list[str], out: str = "no") -> DataFrame:
    """Rows with their running number in a shipment."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*shipment).orderBy(*order)))


def printed(rows: DataFrame, layout: str, shipment: list[str], order: list[str], raw_totals: bool = False) -> DataFrame:
    """The printed table of every shipment: its rows numbered by `order`, and below them one total row (is_total, no is null).

    Totals sum the figures as shown, or with `raw_totals` the figures before rounding; a column without any figure has no
    total. Tables without sums have no total row. One pass: the total is an aggregate of each shipment beside its rows.
    """
    plan = LAYOUTS[layout]
    digits = dict(plan.digits)
    shown = {c: F.round(F.col(c).cast("decimal(24,8)"), digits[c]).cast("double") if c in digits else F.col(c) for c in plan.columns if c != "no"}
    body = numbered_rows(rows, shipment, order).select(*shipment, *([F.col("no")] if "no" in plan.columns else []), *(e.alias(c) for c, e in shown.items()), F.lit(False).alias("is_total"))
    if not plan.sums:
        return body
    source = rows if raw_totals else rows.withColumns(shown)
    sums = [F.round(F.sum(F.col(c).cast("decimal(24,6)")), 4).cast("double").alias(c) for c in plan.sums]
    total = source.groupBy(*shipment).agg(*sums).withColumn("is_total", F.lit(True))
    return body.unionByName(total, allowMissingColumns=True)


def preview(rows: DataFrame, layout: str, shipment: list[str], order: list[str]) -> DataFrame:
    """(shipment, rows): a JSON array of each shipment's printed rows, the total last; bounded by what a paper holds."""
    plan = LAYOUTS[layout]
    table = printed(rows, layout, shipment, order)
    cells = F.struct(*plan.columns, "is_total")
    place = F.struct(F.col("is_total"), *(["no"] if "no" in plan.columns else ["article"]))
    return table.groupBy(*shipment).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), cells.alias("c")))), lambda x: x["c"])).alias("rows"))


def family_table(rows: DataFrame, shipment: list[str], family: str, sums: list[str], price: str, measure: str, amount: str) -> DataFrame:
    """Rows summed at three levels (2 item rows of a family, 1 family, 0 shipment); a family's amount is its last price times its measure."""
    total = [F.round(F.sum(F.col(c).cast("decimal(24,6)")), 4).cast("double").alias(c) for c in sums]
    fam = rows.groupBy(*shipment, family).agg(*total, F.max_by(price, F.when(F.col(price).isNotNull(), F.col("no"))).alias("_p"), F.count("*").alias("n"))
    fam = fam.withColumn(amount, F.round((F.col("_p") * F.col(measure)).cast("decimal(24,6)"), 2).cast("double")).withColumn("level", F.lit(1)).drop("_p")
    every = rows.groupBy(*shipment).agg(*total, F.round(F.sum(F.col(amount).cast("decimal(24,6)")), 4).cast("double").alias(amount), F.count("*").alias("n")).withColumn("level", F.lit(0))
    return fam.unionByName(every, allowMissingColumns=True)


def spans(rows: DataFrame, shipment: list[str], block: str, no: str = "no") -> DataFrame:
    """First and last printed row of each block of equal value in its shipment."""
    return rows.where(F.col(block).isNotNull()).groupBy(*shipment, block).agg(F.min(no).alias("first_row"), F.max(no).alias("last_row"), F.count("*").alias("rows"))


def totals(rows: DataFrame, group: list[str], measures: list[str]) -> DataFrame:
    """Sums to four digits; null where no row has a value."""
    return rows.groupBy(*group).agg(*(F.round(F.sum(F.col(c).cast("decimal(24,6)")), 4).cast("double").alias(c) for c in measures))


def field_conflicts(rows: DataFrame, keys: list[str], source: str, fields: list[str], within: float = 1e-6) -> DataFrame:
    """(keys, field_name, severity): fields whose figures differ by more than `within` across two sources or more; one pass."""
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("double").alias("v")) for f in fields))
    long = rows.select(*keys, source, F.explode(cells).alias("c")).where("c.v is not null")
    got = long.groupBy(*keys, "c.field_name").agg((F.max("c.v") - F.min("c.v")).alias("gap"), F.min(source).alias("a"), F.max(source).alias("b"))
    return got.where((F.col("a") != F.col("b")) & (F.col("gap") > within)).select(*keys, "field_name", F.lit("RED").alias("severity"))


def pairwise(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], within: float = 0.05) -> DataFrame:
    """(keys, field_name, severity): fields of two papers' rows that differ by more than `within` (RED) or lack on one side (YELLOW)."""
    a = left.select(*keys, *(F.col(f).alias(f"l_{f}") for f in fields))
    b = right.select(*keys, *(F.col(f).alias(f"r_{f}") for f in fields))
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"l_{f}").cast("double").alias("l"), F.col(f"r_{f}").cast("double").alias("r")) for f in fields))
    long = a.join(b, keys).select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    severity = F.when(F.col("l").isNull() != F.col("r").isNull(), "YELLOW").when(F.abs(F.col("l") - F.col("r")) > within, "RED")
    return long.withColumn("severity", severity).where("severity is not null").drop("l", "r")


def missing_pairs(rows: DataFrame, shipment: list[str], key: str, role: str, first: str, second: str) -> DataFrame:
    """(shipment, key, message): keys that only one of two papers has, asked only where the shipment has the other at all."""
    has = lambda r: F.max((F.col(role) == r).cast("int"))
    kits = rows.groupBy(*shipment).agg(has(first).alias("_a"), has(second).alias("_b")).where("_a = 1 and _b = 1").select(*shipment)
    keyed = rows.where(F.col(key).isNotNull() & F.col(role).isin(first, second)).groupBy(*shipment, key).agg(has(first).alias("_a"), has(second).alias("_b")).where("_a != _b")
    return keyed.join(kits, shipment).select(*shipment, key, F.when(F.col("_a") == 1, f"not in {second}").otherwise(f"not in {first}").alias("message"))


def scan_verdicts(items: DataFrame, scan: DataFrame, shipment: list[str], key: str, fields: list[str], absolute: float = 0.05, share: float = 0.002) -> DataFrame:
    """(shipment, key, verdict, differing): the table beside its second reading.

    verdict: matched, question (a field differs), extra (only read), missing (only in the table, said only where the
    shipment has a match at all). differing: names of the fields whose figures both sides have and that differ.
    """
    a = items.select(*shipment, key, F.lit(True).alias("_i"), *(F.col(f).alias(f"i_{f}") for f in fields))
    b = scan.select(*shipment, key, F.lit(True).alias("_s"), *(F.col(f).alias(f"s_{f}") for f in fields))
    both = a.join(b, [*shipment, key], "full")
    off = lambda f: F.abs(F.col(f"i_{f}") - F.col(f"s_{f}")) > F.greatest(F.lit(absolute), F.abs(f"i_{f}") * share)
    differing = F.array_compact(F.array(*(F.when(off(f), F.lit(f)) for f in fields)))
    met = both.groupBy(*shipment).agg(F.max((F.col("_i") & F.col("_s")).cast("int")).alias("_met"))
    out = both.withColumn("differing", F.array_join(differing, ",")).join(met, shipment)
    verdict = F.when(F.col("_i").isNull(), "extra").when(F.col("_s").isNotNull(), F.when(F.col("differing") == "", "matched").otherwise("question")).when(F.col("_met") == 1, "missing")
    return out.withColumn("verdict", verdict).where("verdict is not null").select(*shipment, key, "verdict", "differing")


def total_mismatch(left: Column, right: Column, absolute: float = 0.5, share: float = 0.002) -> Column:
    """Whether two totals differ by more than the larger of `absolute` and `share`; null where one lacks."""
    return F.abs(left - right) > F.greatest(F.lit(absolute), F.abs(left) * share)


def absent_columns(sheets: DataFrame, keys: list[str], fields: Column, required: list[str]) -> DataFrame:
    """(keys, missing): the required fields that no column of a sheet means, in the given order; sheets lacking none are left out."""
    lack = F.array_except(F.array(*map(F.lit, required)), F.coalesce(fields, F.array().cast("array<string>")))
    return sheets.select(*keys, F.array_join(lack, ",").alias("missing")).where("missing != ''")
