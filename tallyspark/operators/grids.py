"""Grids of cells and the order-dependent rules of document rows, as joins on keys and windows within one sheet.

A grid is long: one row for each cell with its sheet (any key columns), row, col and v. Windows are partitioned by the sheet,
which is bounded by what a paper holds; nothing is ordered over a whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Wordings that end a table, sections that do, and lines that belong to a letterhead.
TOTAL = "(?iu)^\\s*(total|grand\\s*total|итого|всего|genel\\s*toplam|合计|总计)(?![\\p{L}\\p{N}_])"
DETAIL = "(?iu)detail\\s*packing|подробн"
SECTION = "(?iu)^\\s*(packing\\s*list|invoice|specification|инвойс|упаковочн|спецификац)\\s*$"
SUBTOTAL = "(?iu)(?<![\\p{L}\\p{N}_])(total\\s*rolls?|sub\\s*total|ara\\s*toplam)(?![\\p{L}\\p{N}_])"
LETTERHEAD = "(?iu)terms of (?:delivery|payment)|условия поставки|условия оплаты|bank name|bank address|current account|corr\\.?\\s*account|swift|director|sold to|consignee|recipient|beneficiary|account\\s*no|tel\\s*:|fax\\s*:|e-?mail|инн(?![\\p{L}\\p{N}_])|кпп(?![\\p{L}\\p{N}_])|огрн|б/сч|генеральн|покупатель оплач"
PAGE_MARK = "(?iu)^(?:continued|continue|page\\s*\\d+|p\\.?\\s*\\d+|po\\s*:?\\s*\\d+|see\\s+below|n/?a|null)$"
NEW_HEADER = ("art no", "артикул", "quantity", "unit price", "amount", "description of", "net wt", "gross wt")


def text_grid(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, row, col, v): each line of a text a row, cells parted by a tab or two spaces or more. Null texts have no cells."""
    lines = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("row", "_line"))
    return lines.select(id_col, "row", F.posexplode(F.split("_line", r"\s{2,}|\t")).alias("col", "v"))


def unpivoted(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A table as cells: keys, col (place in `columns`), name and v as text."""
    cells = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)))
    return rows.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.col", "_c.name", "_c.v")


def fill_merges(cells: DataFrame, merges: DataFrame, sheet: list[str], add: bool = False) -> DataFrame:
    """Cells with the value of the origin of a merged range in its empty covered cells, marked `inherited`.

    merges: sheet, r0, c0, r1, c1, inclusive. A range is written out into the cells it covers and joined by equality, so no
    range join is needed; of overlapping ranges the first by (r0, c0) counts. With `add`, covered cells that aren't there
    at all, as workbooks leave them out, come too.
    """
    spread = merges.select(*sheet, "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("row"), "c1").select(*sheet, "r0", "c0", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    spread = spread.where("row != r0 or col != c0").groupBy(*sheet, "row", "col").agg(F.min(F.struct("r0", "c0")).alias("_o"))
    origin = cells.select(*sheet, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias("_v"))
    known = spread.select(*sheet, "row", "col", F.col("_o.r0").alias("_r"), F.col("_o.c0").alias("_c")).join(origin, [*sheet, "_r", "_c"]).select(*sheet, "row", "col", "_v")
    out = cells.join(known, [*sheet, "row", "col"], "full" if add else "left")
    empty = F.coalesce(F.trim("v"), F.lit("")) == ""
    return out.select(*sheet, "row", "col", F.when(empty, F.coalesce("_v", "v")).otherwise(F.col("v")).alias("v"), (empty & F.col("_v").isNotNull()).alias("inherited"))


def carry(rows: DataFrame, partition: list[str], order: list[str], value: str, stop: Column, out: str) -> DataFrame:
    """`out` is the last non-null `value` at or before each row, forgotten after a row where `stop` holds."""
    w = Window.partitionBy(*partition).orderBy(*order)
    ended = F.coalesce(F.sum(F.when(stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.withColumn("_part", ended)
    inside = Window.partitionBy(*partition, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn(out, F.last(value, ignorenulls=True).over(inside)).drop("_part")


def stack_titles(cells: DataFrame, sheet: list[str], most: int = 4) -> DataFrame:
    """(sheet, col, title): the distinct parts of the first `most` title rows of each column, from top to bottom."""
    top = cells.where((F.col("row") < most) & (F.coalesce(F.trim("v"), F.lit("")) != ""))
    parts = top.groupBy(*sheet, "col").agg(F.array_sort(F.collect_list(F.struct("row", F.trim("v").alias("v")))).alias("p"))
    return parts.select(*sheet, "col", F.array_join(F.array_distinct(F.transform("p", lambda x: x["v"])), " ").alias("title"))


def after_total(rows: DataFrame, partition: list[str], order: list[str], total: Column, out: str = "after_total") -> DataFrame:
    """Whether a row stands below the first total row of its sheet."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.max(F.coalesce(total, F.lit(False))).over(w), F.lit(False)))


def continued(rows: DataFrame, partition: list[str], order: list[str], own: Column, first: list[str], sums: list[str]) -> DataFrame:
    """Rows without a key of their own drawn to the row above: first non-null values, sums rounded to six digits, number of lines.

    Rows before the first with a key make segment 0.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    seg = rows.withColumn("segment", F.sum(F.when(own, 1).otherwise(0)).over(w))
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in first]
    totals = [F.round(F.sum(F.col(c).cast("decimal(24,8)")), 6).cast("double").alias(c) for c in sums]
    return seg.groupBy(*partition, "segment").agg(*firsts, *totals, F.count("*").alias("n_lines"))


def shared_measures(lines: DataFrame, partition: list[str], order: list[str], key: str, text: str, measure: str) -> DataFrame:
    """`shared`: key of the first of two rows that share one measure, on both; null elsewhere.

    A row with a measure shares it with the next one that has none if its text joins two with `&` or the next row's text
    has no digit.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    nxt, txt = F.lead(measure).over(w), F.lead(text).over(w)
    follows = F.lead(key).over(w).isNotNull() & nxt.isNull()
    opens = F.coalesce(F.col(measure).isNotNull() & follows & (F.col(text).contains("&") | (txt.isNotNull() & ~txt.rlike("[0-9]"))), F.lit(False))
    df = lines.withColumn("_opens", opens)
    return df.withColumn("shared", F.when(F.col("_opens"), F.col(key)).when(F.lag("_opens").over(w), F.lag(key).over(w))).drop("_opens")


def backfill_from_family(rows: DataFrame, partition: list[str], order: list[str], child: Column, family: Column, values: list[str], border: Column) -> DataFrame:
    """Children take the values they lack from the next family row below them, within the part up to a `border` row."""
    w = Window.partitionBy(*partition).orderBy(*order)
    parts = rows.withColumn("_part", F.coalesce(F.sum(F.when(border, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    below = Window.partitionBy(*partition, "_part").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    source = F.first(F.when(family, F.struct(*values)), ignorenulls=True).over(below)
    parts = parts.withColumn("_f", source)
    return parts.withColumns({v: F.when(child, F.coalesce(F.col(v), F.col(f"_f.{v}"))).otherwise(F.col(v)) for v in values}).drop("_part", "_f")


def lot_ordinal(rows: DataFrame, keys: list[str], token: str, order: list[str], out: str = "lot_no") -> DataFrame:
    """One row for each (keys, token) with the place in which the token was first seen within its keys."""
    seen = rows.groupBy(*keys, token).agg(F.min(F.struct(*order)).alias("_at"))
    return seen.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).drop("_at")


def header_candidate(cells: DataFrame, sheet: list[str], hints: list[str], depth: int = 25, least: int = 3) -> DataFrame:
    """(sheet, row, score): the row of the first `depth` with the most cells that hold a hint, `least` at least; the first of equals."""
    hint = F.lower("v").rlike("|".join(hints))
    scored = cells.where(F.col("row") < depth).groupBy(*sheet, "row").agg(F.count(F.when(hint, 1)).alias("score"))
    best = scored.where(F.col("score") >= least).groupBy(*sheet).agg(F.max(F.struct("score", (-F.col("row")).alias("neg"))).alias("b"))
    return best.select(*sheet, (-F.col("b.neg")).alias("row"), F.col("b.score").alias("score"))


def leftmost_number(cells: DataFrame, row_keys: list[str], number: Column, unmapped: Column, width: int = 3, below: int = 100000, out: str = "item_no") -> DataFrame:
    """The left-most whole number between 0 and `below` in the first `width` columns that mean nothing else; rows without are left out."""
    n = cells.where((F.col("col") < width) & unmapped).withColumn("_n", number)
    n = n.where((F.col("_n") == F.floor("_n")) & (F.col("_n") > 0) & (F.col("_n") < below))
    return n.groupBy(*row_keys).agg(F.min_by("_n", "col").cast("int").alias(out))


def next_value(cells: DataFrame, row_keys: list[str], label: Column, out: str = "value") -> DataFrame:
    """Label cells with the next non-empty cell to their right in the same row; null where there is none."""
    filled = F.when(F.trim("v") != "", F.trim("v"))
    w = Window.partitionBy(*row_keys).orderBy("col").rowsBetween(1, Window.unboundedFollowing)
    return cells.withColumn(out, F.first(filled, ignorenulls=True).over(w)).where(label)


def block_ids(cells: DataFrame, merges: DataFrame, sheet: list[str], out: str = "block") -> DataFrame:
    """Cells inside a vertical merge with the rows it spans, `r0:r1`; other cells get null."""
    tall = merges.where("r1 > r0").select(*sheet, F.explode(F.sequence("r0", "r1")).alias("row"), "r0", "r1", "c0", "c1")
    tall = tall.select(*sheet, "row", F.explode(F.sequence("c0", "c1")).alias("col"), F.concat_ws(":", "r0", "r1").alias(out)).groupBy(*sheet, "row", "col").agg(F.min(out).alias(out))
    return cells.join(tall, [*sheet, "row", "col"], "left")


def positional(rows: DataFrame, partition: list[str], order: list[str], values: Column, out: str) -> DataFrame:
    """The n-th of `values` for the n-th row of its part, the last one beyond their end; null without values."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("_values", values).withColumn("_n", n).withColumn(out, F.when(F.size("_values") > 0, F.element_at("_values", F.least(F.col("_n"), F.size("_values"))))).drop("_values", "_n")


def rows_of_blocks(blocks: DataFrame, page: list[str], gap: float = 0.65, least: float = 10.0) -> DataFrame:
    """(page, row, col, text): text boxes (page, text, x, y, height) of a scan put into rows from top to bottom.

    A box opens a row if it lies further below the running height of the row than the larger of `least` and `gap` of the
    page's median box height; the running height follows the boxes, which makes this sequential within a page.
    """
    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in page)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        far = max(gap * float(pdf.height.median()), least)
        no, line, rows = -1, None, []
        for y in pdf.y:
            if line is None or abs(y - line) > far:
                no, line = no + 1, y
            else:
                line = 0.6 * line + 0.4 * y
            rows.append(no)
        pdf = pdf.assign(row=np.asarray(rows, np.int32)).sort_values(["row", "x"], kind="stable")
        pdf["col"] = pdf.groupby("row").cumcount().astype(np.int32)
        return pdf[[*page, "row", "col", "text"]]

    return blocks.groupBy(*page).applyInPandas(run, f"{kinds}, row int, col int, text string")


def column_statistics(cells: DataFrame, column_keys: list[str], number: Column, code: Column) -> DataFrame:
    """Of each column's filled cells: shares that are numbers, dimensions, codes and text, and the largest magnitude."""
    filled = cells.where(F.coalesce(F.trim("v"), F.lit("")) != "").withColumn("_n", number)
    share = lambda c: F.avg(c.cast("int"))
    dims = F.col("v").rlike("(?iu)^\\s*\\d+(?:[.,]\\d+)?\\s*[*x×х]\\s*\\d+(?:[.,]\\d+)?\\s*[*x×х]\\s*\\d+")
    return filled.groupBy(*column_keys).agg(F.count("*").alias("n"), share(F.col("_n").isNotNull()).alias("numeric"), share(dims).alias("dimension"), share(code).alias("code"), share(F.col("v").rlike("\\p{L}") & F.col("_n").isNull()).alias("text"), F.max(F.abs("_n")).alias("largest"))


def projected(cells: DataFrame, row_keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """One typed row for each row of cells: the first cell of each named field, made by its expression over `v`."""
    picks = [F.min_by(F.struct(e.alias("x")), F.when(F.col("name") == f, F.col("col"))).alias(f) for f, e in fields.items()]
    return cells.groupBy(*row_keys).agg(*picks).select(*row_keys, *(F.col(f"{f}.x").alias(f) for f in fields))


def row_facts(cells: DataFrame, row_keys: list[str], number: Column, code: Column) -> DataFrame:
    """What the row rules ask about: joined text, first filled cell, counts of filled, number, code and word cells, distinct texts."""
    v = F.trim("v")
    some = cells.withColumn("v", v).where("v != ''").withColumns({"_n": number.isNotNull() & ~code, "_code": code, "_w": F.col("v").rlike("\\p{L}") & number.isNull()})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x["v"])
    count = lambda c: F.count(F.when(F.col(c), 1))
    return some.groupBy(*row_keys).agg(F.array_join(ordered, " ").alias("joined"), F.min_by("v", "col").alias("first"), F.count("*").alias("filled"), count("_n").alias("numbers"), count("_code").alias("codes"), count("_w").alias("words"), F.count_distinct(F.regexp_replace("v", "\\s+", "")).alias("texts"))


def is_stop(joined: Column, first: Column) -> Column:
    return first.rlike(TOTAL) | joined.rlike(TOTAL) | joined.rlike(DETAIL) | joined.rlike(SECTION)


def is_noise(facts: dict[str, Column] | None = None) -> Column:
    """Rows that are neither titles nor goods: page marks, letterhead, totals, one repeated short number, sections, prose."""
    joined, first, c = F.col("joined"), F.col("first"), F.col
    lone = (c("texts") == 1) & F.regexp_replace(first, "\\s+", "").rlike("^\\d{1,5}$")
    prose = (c("words") >= 3) & (c("numbers") <= 1) & ~((c("codes") > 0) & (c("words") >= 2))
    return joined.rlike(PAGE_MARK) | joined.rlike(LETTERHEAD) | is_stop(joined, first) | lone | prose


def looks_like_header(joined: Column, hints: tuple[str, ...] = NEW_HEADER, least: int = 3) -> Column:
    low = F.lower(joined)
    return sum((low.contains(h).cast("int") for h in hints), F.lit(0)) >= least
