import random

import pytest

linkage = pytest.importorskip("tallyspark.llm.linkage")
from pyspark.sql import functions as F  # noqa: E402

ITEM = "item_id bigint, article string, manufacturer string, color string, hs_code string, qty double, price double, amount double, net_weight double, gross_weight double"
ROW = "row_id bigint, article string, color string, hs_code string, qty double, price double, amount double, net_weight double, gross_weight double, is_group boolean, kind string"


def test_links_hot_article_misspelt_and_missing_names(spark):
    rng = random.Random(5)
    items, rows, want = [], [], {}
    for i in range(600):
        article = "Velmora 110" if i % 3 == 0 else f"ARTIC {i % 97 + 100}"
        q, p, n = round(rng.uniform(20, 900), 2), round(rng.uniform(1, 60), 2), round(rng.uniform(300, 5000), 2)
        items.append((i, article, "Maker Ltd.", "navy", "5407478901", q, p, round(p * q, 2), n, round(n * 1.07, 2)))
        name = article if i % 5 else (None if i % 2 else article.replace("R", "RR"))
        if i % 7:
            rows.append((i, name, "navy", "540747", q, p, round(p * q, 2), None, None, False, "x"))
            want[i] = i
        else:
            rows.append((i, name, "navy", None, q + 31.5, p + 3, 1.0, n + 77, None, False, "x"))
    rows.append((5000, "Captions", None, None, None, None, None, None, None, True, "x"))
    df = spark.createDataFrame(rows + rows[:20], ROW)
    links = linkage.link(linkage.row_records(df), linkage.item_records(spark.createDataFrame(items, ITEM))).collect()
    got = {r.rid: r.item_id for r in links}
    assert len(links) == len(got)
    right = sum(got.get(k) == v for k, v in want.items())
    assert right >= 0.97 * len(want)
    assert len(got) - right <= 5
    assert all(0.5 <= r.confidence <= 1 for r in links)


def test_empty_sides(spark):
    items = linkage.item_records(spark.createDataFrame([], ITEM))
    rows = linkage.row_records(spark.createDataFrame([(1, "A 100", None, None, 1.0, None, None, None, None, False, "x")], ROW))
    assert linkage.link(rows, items).count() == 0
    assert linkage.link(rows.where(F.lit(False)), items).count() == 0


def test_each_figure_is_a_key_of_its_own(spark):
    items = [(1, "NORVIK 210", None, None, None, 301.0, 7.5, 2257.5, 88.4, 95.2), (2, "NORVIK 210", None, None, None, 777.0, 9.5, 7381.5, 140.2, 151.9)]
    rows = [
        (1, "NORVIK 210", None, None, 640.0, None, None, 88.0, None, False, "net below 200 alone"),
        (2, "NORVIK 210", None, None, 640.0, None, None, None, 95.0, False, "gross alone"),
        (3, None, None, None, 301.0, None, None, 88.4, 33.0, False, "wrong gross beside right quantity and net"),
        (4, "NORVIK 210", None, None, 301.03, None, None, None, None, False, "quantity a little off, no price"),
        (5, None, None, None, None, None, 2257.5, None, 95.2, False, "amount and gross"),
    ]
    theirs = linkage.item_records(spark.createDataFrame(items, ITEM))
    pairs = linkage._second_pass(linkage.row_records(spark.createDataFrame(rows, ROW)), theirs).collect()
    assert sorted((r.rid, r.item_id) for r in pairs) == [(i, 1) for i in range(1, 6)]


def test_a_common_article_meets_by_one_figure_alone(spark, monkeypatch):
    items = [(i, "VELMORA 110", "Maker Ltd.", "navy", "5407478901", 100.0 + 31 * i, 3.5 + i, (100.0 + 31 * i) * (3.5 + i), 200.0 + 11 * i, 300.0 + 17 * i) for i in range(40)]
    rows = [(i, "VELMORA 110", None if i % 2 else "sand", None, 9000.0 + i, None, None, 200.0 + 11 * i, None, False, "net alone") for i in range(40)]
    rows += [(100 + i, "VELMORA 110", "sand", None, 100.01 + 31 * i, None, None, None, None, False, "quantity nearly, another colour") for i in range(9, 40)]
    records = linkage.row_records(spark.createDataFrame(rows + rows[:5], ROW))
    theirs = linkage.item_records(spark.createDataFrame(items + items[:5], ITEM))
    want = [(i, i) for i in range(40)] + [(100 + i, i) for i in range(9, 40)]
    whole = linkage._second_pass(records, theirs).collect()
    assert sorted((r.rid, r.item_id) for r in whole) == want
    for name, n in (("BLOCK_RECORDS", 25), ("BLOCK_ITEMS", 12)):  # in parts as whole
        monkeypatch.setattr(linkage, name, n)
    assert sorted(linkage._second_pass(records, theirs).collect()) == sorted(whole)


def test_levels_of_a_block_are_those_of_the_pattern(spark):
    rng = random.Random(3)
    fig = lambda top: rng.choice([None, round(rng.uniform(1, top), 2), 50.0, 50.4, 51.0])
    items = [(i, "NORVIK 210", rng.choice([None, "Alfa Tekstil Ltd", "Beta"]), rng.choice([None, "navy", "sand"]), rng.choice([None, "5407", "540747", "5407478901"]), fig(90), fig(9), fig(90), fig(90), fig(90)) for i in range(60)]
    lines = [(i, rng.choice(["NORVIK 210", None]), rng.choice([None, "ALFA TEKSTIL", "Gamma Beta"]), "x", rng.choice([None, "5407.47", "54074789"]), None, fig(90), fig(9), fig(90), fig(90), fig(90), False) for i in range(60)]
    theirs = linkage.item_records(spark.createDataFrame(items, ITEM))
    mine = linkage.line_records(spark.createDataFrame(lines, "line_id bigint, model string, vendor string, description string, hs string, qty_text string, pieces double, price double, amount double, net double, gross double, freight boolean"))
    both = linkage._sided(mine, "r").crossJoin(linkage._sided(theirs, "i"))
    right = {(r.r_rid, r.pattern) for r in both.where("r_name is not null").select("r_rid", linkage._pattern().alias("pattern")).collect()}
    got = {(r.rid, r.pattern) for r in linkage._by_article(mine, theirs).collect()}
    assert got and got <= right


def test_what_is_shuffled_grows_as_the_rows_not_as_their_pairs(spark):
    def moved() -> int:
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sum(x.totalShuffleWrite() for x in (sc.statusStore().executorList(True).apply(k) for k in range(sc.statusStore().executorList(True).size())))

    got = []
    for n in (400, 3200):  # one article, eight quantities, and as many records without it: all pairs share a key
        items = [(i, "VELMORA 110", "Maker Ltd.", "navy", "5407478901", 100.0 + i % 8, 3.5, 350.0 + i % 8, 200.0 + i % 5, None) for i in range(n)]
        rows = [(i, None if i % 2 else "VELMORA 110", "sand" if i % 3 else "navy", None, 100.0 + i % 8, 3.5, None, 200.0 + i % 5, None, False, "x") for i in range(n)]
        before, kept = moved(), spark.sparkContext._jsc.sc().getPersistentRDDs().size()
        links = linkage.link(linkage.row_records(spark.createDataFrame(rows, ROW)), linkage.item_records(spark.createDataFrame(items, ITEM)))
        assert len({r.rid for r in links.collect()}) == links.count()
        got.append(moved() - before)
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept
    assert got[1] < 12 * got[0]


def test_pairs_left_out_neither_count_nor_match(spark):
    rng = random.Random(9)
    fig = lambda top: rng.choice([None, round(rng.uniform(0.1, top), 2), 50.0, 50.4, 50.9, 10.0])
    colour = lambda: rng.choice([None, "navy", "sand", "plum"])
    items = [(i, "NORVIK 210", rng.choice([None, "Alfa Tekstil Ltd", "Beta"]), colour(), rng.choice([None, "5407478901"]), fig(300), fig(9), fig(900), rng.choice([None, 31.0, 32.0, 31.4996]), rng.choice([None, 35.0, 36.0])) for i in range(250)]
    rows = [(i, rng.choice(["NORVIK 210", "NORVIK 21"]), colour(), rng.choice([None, "540747"]), fig(300), fig(9), fig(900), rng.choice([None, 31.0, 32.0]), rng.choice([None, 35.0, 36.0]), False, "x") for i in range(250)]
    mine, theirs = linkage.row_records(spark.createDataFrame(rows, ROW)), linkage.item_records(spark.createDataFrame(items, ITEM))
    blobs = [b for part, b in linkage._gathered(mine, theirs, 1).mapPartitions(lambda x: linkage._onward(x, 1, (10**6, 10**6), False)).collect() if part >= 0]

    def listed(only):
        return {(int(a), int(b)): (int(x), int(y)) for r, i, p, q, pattern, n in linkage._second_pairs(blobs, (10**6, 10**6), only) for a, b, x, y in zip(r.rid[p], i.rid[q], pattern, n)}

    full, counted = listed(None), listed(True)
    assert {k: v for k, v in full.items() if v[1]} == {k: v for k, v in counted.items() if v[1]} and len(counted) < len(full)
    patterns = linkage.np.arange(linkage.PATTERNS)
    for weak in (-9.0, -3.0, 0.0):
        m = [linkage.np.array([0.0, *[2.0 ** (weak if lv < n - 1 else 1) for lv in range(1, n)]]) for n in linkage.FIELDS.values()]
        u = [linkage.np.ones(n) for n in linkage.FIELDS.values()]
        odds = linkage.posteriors(patterns, 0.4, m, u)
        judged = listed(linkage.Model(0.4, m, u, 0.5))
        assert {k: v for k, v in full.items() if odds[v[0]] >= 0} == {k: v for k, v in judged.items() if odds[v[0]] >= 0}
    assert len(listed(linkage.Model(0.4, m, [x * 2.0**40 for x in u], 0.5))) < len(full)


def test_copies_of_rows_are_one_in_a_task(spark):
    items = [(i + 1000 * k, "NORVIK 210", "Beta", "navy", None, 100.0 + i, 7.5, 750.0 + i, 80.0 + i % 3, None) for i in range(20) for k in range(3)]
    rows = [(i + 1000 * k, "NORVIK 210" if i % 2 else "NORWIK 210", "navy", None, 100.0 + i, 7.5, None, 80.0 + i % 3, None, False, "x") for i in range(20) for k in range(4)]
    mine, theirs = linkage.row_records(spark.createDataFrame(rows, ROW)), linkage.item_records(spark.createDataFrame(items, ITEM))
    table = linkage._unpacked([b for _, b in linkage._gathered(mine, theirs, 1).collect()])
    r, i, _, _ = linkage._sides(table)
    assert (r.n, i.n, set(r.ids), set(i.ids), sum(r.times), sum(i.times)) == (20, 20, {4}, {3}, 80, 60)
    got = {x.rid: x.item_id for x in linkage.link(mine, theirs).collect()}
    assert len(got) == 80 and all(got[j + 1000 * k] == got[j] < 20 for j in range(20) for k in range(4))
    assert all(got[j] == j for j in range(1, 20, 2))
