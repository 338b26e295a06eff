"""Nulls, empty tables, ties, repeated rows and clashing columns for the operators on rows of several papers."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import lines as X
from tallyspark.functions import model_json as Y
from tallyspark.functions import money as M
from tallyspark.functions import rules as R
from tallyspark.functions import text as T
from tallyspark.operators import grids as G
from tallyspark.operators import merging as J
from tallyspark.operators import papers as P
from tallyspark.operators import votes as V


def _one(spark, expression, *values, kind="string"):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {kind}" for i in range(len(values))))
    return df.select(expression(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("77.700", 77.7), ("3,047.000", 3047), ("1.234.567", 1234567), ("2 736.15", 2736.15), ("5,78 USD", 5.78), ("£12.50", 12.5), ("3.85$", 3.85), ("10061.93 TRY", 10061.93), ("¥44.55", 44.55), ("1.38 M", 1.38), ("-3,5", -3.5), ("54.07.73.00", None), ("abc", None), ("", None), (None, None)])
def test_number_cells(spark, text, want):
    assert _one(spark, M.parse_number, text) == want


@pytest.mark.parametrize(("text", "want"), [("54.07.73.00.90.11", "540773009011"), ("HS code: 540773", "540773"), ("5407730000000.0", "5407730000000"), ("20270.25", None), ("1.38", None), (None, None), ("", None)])
def test_codes(spark, text, want):
    assert _one(spark, M.code_digits, text) == want


@pytest.mark.parametrize(("text", "want"), [("price in USD", "USD"), ("USD and TRY", None), ("RMB", "CNY"), ("Cad. No 5", None), ("CAD. 5", "CAD"), ("12 евро", "EUR"), ("usdx", None), ("", None), (None, None)])
def test_currencies(spark, text, want):
    assert _one(spark, M.currency, text) == want


def test_texts(spark):
    assert _one(spark, T.unspaced, "C I 2 4 and A B") == "CI24 and A B"
    assert _one(spark, T.unspaced, None) is None
    assert tuple(_one(spark, T.split_design, "SOFA\nALPHA 1")) == ("SOFA", "ALPHA 1")
    assert tuple(_one(spark, T.split_design, "a / B1")) == ("a", "B1")
    assert tuple(_one(spark, T.bilingual, "ткань//fabric")) == ("fabric", "ткань")
    assert tuple(_one(spark, T.bilingual, "ткань")) == (None, "ткань")
    assert _one(spark, T.with_color, "ALPHA 12", "12") == "ALPHA 12"
    assert _one(spark, T.with_color, "ALPHA", None) == "ALPHA"
    assert _one(spark, T.subkit, "kit 626-1, 1-2-3") == "626-1"
    assert _one(spark, T.file_stem, "a/b: c.") == "a_b_ c"
    assert _one(spark, X.utf8_again, "Ð¦Ð²ÐµÑ\x82") == "Цвет"
    assert _one(spark, X.utf8_again, "naïve") == "naïve"
    assert _one(spark, lambda c: X.clipped(c, 8), "one two three") == "one two"


def test_predicates(spark):
    said = {t: _one(spark, R.plausible_article, t) for t in ("ALPHA 110", "123", "1234", "Art. No: 5", "total", "Model / series", "x" * 61, "", None, "12 Long Street 5")}
    assert [t for t, v in said.items() if v] == ["ALPHA 110", "1234"]
    assert [_one(spark, R.is_note, t) for t in ("(15+30)", "A", "0605 Special Order", "D680-1", "cotton fabric", None)] == [True, True, True, True, False, False]
    got = _one(spark, R.peeled, "MAXIM 997 Artificial leather of good quality")
    assert tuple(got) == ("MAXIM", "997", "Artificial leather of good quality")
    assert _one(spark, R.peeled, "Artificial leather") is None
    assert _one(spark, R.file_role, "2024_PL.xlsx") == "packing" and _one(spark, R.file_role, None) is None


def test_answers(spark):
    assert _one(spark, Y.payload, 'So [x: ```json\n{"a": [1, 2]}\n``` {"b"}') == '{"a":[1,2]}'
    assert _one(spark, Y.payload, "no {json") is None and _one(spark, Y.payload, None) is None
    assert _one(spark, lambda c: Y.by_alias(c, ["net", "netto"]), '{"NETTO": "5", "net": ""}') == "5"


def test_ranked_join_prefers_rank_then_order(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (2, "b", 1.0), (3, None, 1.0), (1, "a", 5.0)], "id bigint, k string, q double")
    cands = spark.createDataFrame([("a", 5.0, 9), ("a", 5.0, 7), ("a", 4.0, 1), ("b", 2.0, 3)], "k string, cq double, lot int")
    got = J.ranked_join(rows, cands, ["k"], F.when(F.col("q") == F.col("cq"), 1).when(F.col("cq") < 5, 2), ["lot"], "id")
    assert {(r.id, r.lot, r["rank"]) for r in got.collect()} == {(1, 7, 1), (2, 3, 2)}
    assert J.ranked_join(rows.limit(0), cands, ["k"], F.lit(1), ["lot"], "id").count() == 0


def test_distribution_is_exact_and_falls_back_to_equal_shares(spark):
    df = spark.createDataFrame([("f", 1, 10.0, None, 611.5), ("f", 2, 10.0, None, 507.0), ("g", 1, 1.0, None, None), ("g", 2, 1.0, None, None), ("g", 3, 1.0, None, None)], "fam string, i int, net double, spec double, m double")
    got = {(r.fam, r.i): r.net_part for r in J.distribute(df, ["fam"], {"net": ["spec", "m"]}, ["i"]).collect()}
    assert got[("f", 1)] == 5.47 and round(got[("f", 1)] + got[("f", 2)], 2) == 10.0
    assert sorted(v for (f, _), v in got.items() if f == "g") == [0.33, 0.33, 0.34]


def test_catalog_paths(spark):
    cat = spark.createDataFrame([("A", "1", "x"), ("B", "2", "y"), ("C", "2", "z"), (None, "3", "w")], "art string, hs string, text string")
    items = spark.createDataFrame([("A", "9"), ("Q", "1"), ("Q", "2"), (None, None)], "art string, hs string")
    steps = [("key", F.col("art"), J.catalog_first(cat, F.col("art"), ["text"], ["art"])), ("code", F.col("hs"), J.catalog_first(cat, F.col("hs"), ["text"], ["art"], agree="text"))]
    assert sorted((r.path, r.cat_text) for r in J.catalog_lookup(items, steps, ["text"]).collect() if r.cat_text) == [("code", "x"), ("key", "x")]
    assert J.catalog_lookup(items, steps, ["text"]).where("path = 'none'").count() == 2


def test_votes(spark):
    names = spark.createDataFrame([("a", "ALPHA Co."), ("a", "Alpha Co"), ("a", "Beta"), ("b", "Gamma"), ("b", "Gamma Mills Ltd"), ("c", "X"), ("c", "Y"), ("d", None)], "g string, v string")
    assert {(r.g, r.v) for r in V.party(names, ["g"], "v").collect()} == {("a", "ALPHA Co."), ("b", "Gamma Mills Ltd")}
    terms = spark.createDataFrame([("a", "FOB Шанхай"), ("a", "fob Shanghai"), ("a", "EXW x"), ("b", "none")], "g string, v string")
    assert [tuple(r) for r in V.incoterm(terms, ["g"], "v").collect()] == [("a", "FOB", "fob Shanghai", 2)]
    places = spark.createDataFrame([("a", "Mill road 5, Bursa"), ("a", "mill road 5"), ("b", "x street 1"), ("b", "y street 2"), ("c", "nothing")], "g string, v string")
    assert [tuple(r) for r in V.address(places, ["g"], "v").collect()] == [("a", "Mill road 5, Bursa")]
    assert V.address(places.limit(0), ["g"], "v").count() == 0
    head = spark.createDataFrame([(1, "", "Mill road 5")], "id int, city string, address string")
    more = spark.createDataFrame([(1, "Bursa", "Mill road 5, floor 2")], "id int, city string, address string")
    assert tuple(V.merged_header(head, more, ["id"], ["city", "address"], ("address",)).first()) == (1, "Bursa", "Mill road 5, floor 2")


def test_printed_tables(spark):
    rows = spark.createDataFrame([("k", "B", "540773", 1.0, 2.0, "m", 1.005, 2.01, 2), ("k", "A", None, None, 3.0, "m", 2.0, 6.0, 1)], "kit string, article string, hs_code string, rolls double, qty double, unit string, price double, amount double, at int")
    got = P.printed(rows, "element_invoice", ["kit"], ["at"]).orderBy("is_total", "no").collect()
    assert [(r.no, r.article, r.qty, r.amount, r.is_total) for r in got] == [(1, "A", 3.0, 6.0, False), (2, "B", 2.0, 2.01, False), (None, None, 5.0, 8.01, True)]
    assert got[-1].rolls == 1.0
    assert P.printed(rows.limit(0), "element_invoice", ["kit"], ["at"]).count() == 0
    assert P.labels("element_invoice", "USD")[-1] == "Amount (USD)"


def test_reviews(spark):
    schema = "kit string, k string, qty double"
    items, scan = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 5.0), ("b", "z", 1.0)], schema), spark.createDataFrame([("a", "x", 41600.0), ("a", "n", 1.0), ("b", "m", 2.0)], schema)
    got = {(r.kit, r.k): (r.verdict, r.differing) for r in P.scan_verdicts(items, scan, ["kit"], "k", ["qty"]).collect()}
    assert got == {("a", "x"): ("question", "qty"), ("a", "y"): ("missing", ""), ("a", "n"): ("extra", ""), ("b", "m"): ("extra", "")}
    rows = spark.createDataFrame([("a", 1, "inv", 5.0), ("a", 1, "pack", 5.5), ("a", 2, "inv", 1.0), ("a", 2, "inv", 9.0), ("a", 3, "inv", None)], "kit string, no int, role string, qty double")
    assert [tuple(r) for r in P.field_conflicts(rows, ["kit", "no"], "role", ["qty"]).collect()] == [("a", 1, "qty", "RED")]


def test_grid_rules(spark):
    cells = spark.createDataFrame([(1, 0, 0, "x"), (1, 1, 0, ""), (1, 2, 0, None), (1, 3, 0, "own")], "s int, row int, col int, v string")
    merges = spark.createDataFrame([(1, 0, 0, 3, 0)], "s int, r0 int, c0 int, r1 int, c1 int")
    assert {(r.row, r.v, r.inherited) for r in G.fill_merges(cells, merges, ["s"]).collect()} == {(0, "x", False), (1, "x", True), (2, "x", True), (3, "own", False)}
    assert G.fill_merges(cells, merges.limit(0), ["s"]).where("inherited").count() == 0
    lines = spark.createDataFrame([(1, 1, "5 & 3 m", 10.0), (1, 2, "7", None), (1, 3, "8", 4.0), (1, 4, "ditto", None), (1, 5, None, None)], "s int, id int, t string, gross double")
    assert [r.shared for r in G.shared_measures(lines, ["s"], ["id"], "id", "t", "gross").orderBy("id").collect()] == [1, 1, 3, 3, None]
