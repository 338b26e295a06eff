import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import field61 as gf
from tallyspark.functions import units
from tallyspark.functions.numbers import written_number
from tallyspark.operators import copy_diff, lots, quantity_units
from tallyspark.operators import set_reconcile as sr


@pytest.mark.parametrize(("text", "value"), [("1 234,50", 1234.5), ("1,234.50", 1234.5), ("1.234", 1234), ("2'447.32", 2447.32), ("12,5", 12.5), ("-3,25", -3.25), ("1.234.567", 1234567), ("7", 7)])
def test_numbers(spark, text, value):
    assert units.number(text) == pytest.approx(value)
    assert spark.range(1).select(written_number(F.lit(text)).alias("x")).first().x == pytest.approx(value)


@pytest.mark.parametrize(
    ("text", "value", "unit"),
    [("12,5 m", 12.5, "m"), ("m2 10", 10, "m2"), ("QTY: 3 km", 3, "km"), ("8 rolls x 85 件", 680, "pcs"), ("3 doz + 6 pcs", 3.5, "dozen"), ("5,11 x100 pcs", 5.11, "hundred"), ("5 pkgs x 100 PCS", 500, "pcs"), ("590,31\nм.п.", 590.31, "m"), ("77", 77, None), ("", None, None), (None, None, None), ("abc", None, None)],
)
def test_quantities(text, value, unit):
    got = units.quantity(text)
    assert got[1] == unit
    assert got[0] == (None if value is None else pytest.approx(value))


def test_headers_name_units():
    assert units.unit_in_header("Кол-во (yard(s))") == "yd"
    assert units.unit_in_header("Quantity / mtr") == "m"
    assert units.unit_in_header("Q-ty, kg") == "kg"
    assert units.unit_in_header(None) is None


def test_field_arithmetic():
    rng = random.Random(1)
    a, b = (np.array([rng.randrange(gf.P) for _ in range(500)], np.uint64) for _ in range(2))
    assert all(int(x) == int(y) * int(z) % gf.P for x, y, z in zip(gf.mul(a, b), a, b))
    starts = np.array([0, 1, 7, 499])
    for k, (i, j) in enumerate(zip(starts, [1, 7, 499, 500])):
        want = 1
        for x in a[i:j]:
            want = want * int(x) % gf.P
        assert int(gf.product_by_group(a, starts)[k]) == want


def test_polynomials_recover_differences():
    rng = random.Random(2)
    for n_left, n_right in ((0, 0), (1, 0), (0, 5), (6, 7), (3, 3), (10, 11)):
        common, left, right = ({rng.randrange(sr._HASH_TOP) for _ in range(n)} for n in (20, n_left, n_right))

        def values(s):
            out = []
            for z in sr._points(24):
                v = 1
                for x in s:
                    v = v * (int(z) - x) % gf.P
                out.append(v)
            return out

        top, bottom = sr.difference_polynomials(20 + n_left, values(common | left), 20 + n_right, values(common | right))
        assert all(sr._value(top, x) == 0 for x in left)
        assert all(sr._value(bottom, x) == 0 for x in right)
        assert not any(sr._value(top, x) == 0 for x in common)


def _copies(spark, n=400, changed=60):
    schema = "id bigint, name string, qty double, tags array<string>, extra string"
    left = [(i, f"n{i}", float(i), ["a", "b"], "x") for i in range(n)]
    right = [(i, f"n{i}" if i >= changed else f"m{i}", float(i) + (0.005 if i % 2 else 0), ["b", "a"], "y") for i in range(5, n + 5)]
    return spark.createDataFrame(left + left[:7], schema), spark.createDataFrame(right, schema).withColumnRenamed("extra", "other")


def test_copies_differ_as_by_brute_force(spark):
    left, right = _copies(spark)
    got = {tuple(r) for r in copy_diff.diff_copies(left, right, "id").collect()}
    want = {(str(i), "*", "missing_right") for i in range(5)} | {(str(i), "*", "missing_left") for i in range(400, 405)} | {(str(i), "name", "differs") for i in range(5, 60)}
    assert got == want


def test_copies_that_share_nothing_and_empty_copies(spark):
    left, right = _copies(spark, 300)
    shifted = right.withColumn("id", F.col("id") + 10000)
    assert copy_diff.diff_copies(left, shifted, "id").count() == 600
    assert copy_diff.diff_copies(left, right.limit(0), "id").count() == 300
    assert copy_diff.diff_copies(left.limit(0), right.limit(0), "id").count() == 0


def test_maps(spark):
    rows = [("a", 1, {"x": 1.0, "y": 2.0}, {"x": "1,00 kg", "z": "3"}), ("a", 0, {"x": 9.0}, None), ("b", 1, None, {"x": "1"}), ("c", 1, None, None), ("d", 1, {"x": 5.0}, {"x": "kg"}), ("e", 1, {"x": 1.005}, {"x": "1,01"})]
    df = spark.createDataFrame(rows, "kit string, attempt int, l map<string,double>, r map<string,string>")
    got = {tuple(r) for r in copy_diff.diff_maps(df, "kit", "l", "r", "attempt").collect()}
    assert got == {("a", "y", "missing_right"), ("a", "z", "missing_left"), ("b", "*", "missing_left"), ("d", "x", "differs")}


def test_units_found_and_predicted(spark):
    rng = random.Random(3)
    lines, items = [], []
    for i in range(400):
        q = round(rng.uniform(50, 500), 2)
        kind = i % 4
        text = (f"{q} m", f"{q * 1000:.0f} mm", f"{q} pcs", f"{q / 12:.4f} doz")[kind]
        extra = {"meters": str(q)} if kind < 2 else None
        lines.append((i, text, extra, q if kind > 1 else None, 2.0, q * 2, 1.0, 1.1, 3.0, "5407000000" if kind < 2 else "9503000000", "PL-1", False))
        items.append((i, f'{{"qty": {q * 1000:.0f}, "unit": "mm"}}', f'{{"meters": {q}}}', "{}"))
    items += [(900, None, None, None), (901, "", "{broken", None), (902, '{"qty": 5.0}', '{"pcs": "5 pcs"}', None)]
    schema = "line_id bigint, qty_text string, extra map<string,string>, pieces double, price double, amount double, net double, gross double, packages double, hs string, source string, freight boolean"
    a = quantity_units.line_statements(spark.createDataFrame(lines, schema))
    b = quantity_units.item_statements(spark.createDataFrame(items, "recon_id bigint, commercial_data string, packing_data string, customs_data string"))
    both = a.unionByName(b)
    model = quantity_units.train(both)
    found = {tuple(r) for r in quantity_units.stated_twice(quantity_units.resolve(both, model)).collect()}
    assert found == {("line", i) for i in range(400) if i % 4 in (1, 3)} | {("item", i) for i in range(400)}
    assert quantity_units.every_quantity(both, model).where("how = 'stated' and common_value is null").count() == 0
    hidden = quantity_units.masked(both, model).collect()
    sure = [r for r in hidden if not r.review]
    assert len(hidden) == 800 and len(sure) > 400
    assert sum(r.unit == r.stated_unit for r in sure) > 0.9 * len(sure)
    assert all((r.common_value is None) == r.review for r in hidden)
    lean = quantity_units.line_statements(spark.createDataFrame(lines, schema), False)
    assert lean.drop(*quantity_units.FEATURES).exceptAll(a.drop(*quantity_units.FEATURES)).count() == 0
    empty = quantity_units.train(both.limit(0))
    assert quantity_units.masked(both.limit(5), empty).where("review").count() == 5
    assert quantity_units.resolve(both.limit(0), empty).count() == 0


def test_allocation_is_exact(spark):
    rows = [(g, i, 100.01, float(s)) for g, shares in (("a", (1, 1, 1)), ("b", (0, 0)), ("c", (5,))) for i, s in enumerate(shares)]
    got = lots.allocate(spark.createDataFrame(rows, "g string, i int, total double, s double"), ["g"], "total", "s", ["i"]).groupBy("g").agg(F.round(F.sum("part"), 2).alias("p")).collect()
    assert {r.g: r.p for r in got} == {"a": 100.01, "b": 100.01, "c": 100.01}


def test_lots_votes_and_prefixes(spark):
    rows = spark.createDataFrame([("k", "A", "1", None, 1), ("k", "A", "1", "red", 2), ("k", "A", "", "blue", 3), ("k", "B", "", "x", 4), (None, "A", "1", "y", 5)], "kit string, k string, token string, color string, ord int")
    got = {(r.k, r.token, r.color, r.lot_no) for r in lots.assemble_lots(rows, ["kit", "k"], "token", ["color"], ["ord"]).collect()}
    assert got == {("A", "1", "red", 1), ("B", "", "x", 1)}
    votes = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("c", None)], "g string, v string")
    assert {(r.g, r.v) for r in lots.agreed_vote(votes, ["g"], "v").collect()} == {("a", "x"), ("c", "z")}
    assert {(r.g, r.v) for r in lots.unanimous_vote(votes, ["g"], "v").collect()} == {("c", "z")}
    names = spark.createDataFrame([("ZIM",), ("ZIM162",), ("ZIMX",)], "k string")
    pairs = lots.prefix_join(names.withColumnRenamed("k", "a"), names.withColumnRenamed("k", "b"), "a", "b").collect()
    assert {(r.a, r.b) for r in pairs} == {("ZIM162", "ZIM")}


def test_best_match_is_one_to_one(spark):
    df = spark.createDataFrame([("c", 1, 5.0), ("c", 2, 5.0), ("c", 3, 7.0)], "code string, id int, n double")
    score = F.lit(60) + F.when(F.col("l_n") == F.col("r_n"), 40).otherwise(-30)
    got = {(r.l_id, r.r_id) for r in lots.best_match(df, df, ["code"], "id", "id", score, 60).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_lines_claim_as_all_pairs_would(spark):
    rng = random.Random(3)
    lines = [(i, rng.choice(["A 17", "Maker", None]), rng.choice(["M-1", "m 2", "na", None]), rng.choice(["lining fabric", "lining fabric navy", "lining", "jacquard fabric of many colours, navy", "jacquard fabric of many colours, sand", None]), rng.choice([None, None, 5.0, 7.0])) for i in range(160)]
    for n in (20, 80, 130):
        want, used = [], set()
        for i, *x in lines[:n]:
            best, at = 0, None
            for j, *y in lines[n:]:
                (lv, lm, ld), (rv, rm, rd) = lots._anchors(*x[:3]), lots._anchors(*y[:3])
                score = 100 * (lv == rv != "") + 80 * (lm == rm != "")
                if ld and rd:
                    score += 70 if ld == rd else 55 * (ld.startswith(rd[:24]) or rd.startswith(ld[:24]))
                if x[3] is not None and y[3] is not None:
                    score += 40 if x[3] == y[3] else -30
                if j not in used and score > best:
                    best, at = score, j
            if best >= 60:
                used.add(at)
                want.append((i, at, best))
        assert lots.claim_lines(lines[:n], lines[n:]) == want
    df = spark.createDataFrame([(1, None, "M 1", "x", None, False), (2, None, "M1", "y", 5.0, True), (3, None, None, "Lining", None, False), (4, None, "Z", "lining", None, True)], "line_id bigint, vendor string, model string, description string, pieces double, pack boolean")
    assert {tuple(r) for r in lots.match_lines(df).collect()} == {(1, 2, 80), (3, 4, 70)}
