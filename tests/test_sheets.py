"""Grids whose shapes and numbers trigger the rules of the extraction, written as workbooks where merges matter."""

from pyspark.sql import functions as F

from tallyspark.operators import grids as G
from tallyspark.operators import sheets as S
from tallyspark.sources import books


def _goods(grid, inherited=frozenset()):
    grid = [[None if c is None else str(c) for c in row] for row in grid]
    start, _, mapping = S.find_header(grid)
    return mapping, S.goods_rows(grid, set(inherited), mapping, start)


def test_captions_give_the_group():
    _, rows = _goods([
        ["NO", "DESIGN", "H.S. CODE", "PACKAGES", "QUANTITY", "UNIT", "UNIT PRICE", "AMOUNT"],
        [1, "ALPHA 110", "54.07.73.00", 3, 120, "m", 4.5, 540],
        [None, "SOFA FABRIC\nALPHA 110", None, 3, 120, "m", None, None],
        [2, "BETA 220", "54.07.73.00", 2, 80, "m", 5, 400],
        [None, "SOFA FABRICBETA 220", None, 2, 80, None, None, None],
        ["TOTAL", None, None, 5, 200, None, None, 940],
    ])
    assert [(r["article"], r["group"], r["qty"], r["rolls"]) for r in rows] == [("ALPHA 110", "SOFA FABRIC", 120, 3), ("BETA 220", "SOFA FABRIC", 80, 2)]


def test_leather_packing_columns():
    mapping, rows = _goods([["PACKING LIST 12"], ["PALLET", "ARTICLE", "COLOUR", "HIDES", "m2", "kg", "Euro/m2"], [1, "RHO 1", "sand", 20, "100,5", 60, 30], [2, "RHO 1", "navy", 10, "50", 30, 30]])
    assert mapping == {0: "rolls", 1: "article", 2: "color", 3: "qty", 4: "area", 5: "net_weight", 6: "price"}
    assert [(r["color"], r["amount"]) for r in rows] == [("sand", 3015.0), ("navy", 1500.0)]


def test_titles_in_several_languages_and_untitled_dimensions():
    titles = ["№", "Art./Артикул", "H.S. CODE", "ROLLS", "TOTAL M2", "METERS", "UNIT PRICE(RMB)", "AMOUNT(RMB)"]
    got = S.classify_columns(titles, [["1", "2"], ["AA 1", "BB 2"], ["540773", "540773"], ["2", "3"], ["10", "20"], ["100", "200"], ["3.2", "4.1"], ["320", "820"]])
    assert got == {1: "article", 2: "hs_code", 3: "rolls", 4: "area", 5: "meters", 6: "price", 7: "amount"}
    assert S.classify_columns(["Art No.", "", "Amount (CNY)"], [["A1", "B2"], ["32*20*10", "40*20*15"], ["10", "20"]]) == {0: "article", 1: "measurement", 2: "amount"}


def test_twin_design_columns_and_noise_rows():
    mapping, rows = _goods([
        ["NO", "DESIGN", "DESIGN", "ROLL", "WIDTH", "METRS", "UNIT", "UNIT PICE", "AMOUNT", "CUSTOMS CODE"],
        [1, "OMEGA", 11, 5, "1.38 M", 455, "m", "¥44.55", 20270.25, "5407730000000.0"],
        [2604] + [None] * 9,
        ["page 2"] + [None] * 9,
        [2, "SIGMA", 12, 4, "140", 300, "m", "¥40", 12000, "5407730000000.0"],
        [3, "TAU", 14, 4, "1.4", 200, "m", "¥40", 8000, "5407730000000.0"],
        ["TOTAL", None, None, 13, None, 955, None, None, 40270.25, None],
    ])
    assert mapping[1] == "article" and mapping[2] == "color"
    assert [(r["article"], r["color"], r["area"]) for r in rows] == [("OMEGA", "11", 627.9), ("SIGMA", "12", 420.0), ("TAU", "14", 280.0)]


def test_colour_lots_stay_apart_and_second_titles_are_no_goods():
    _, rows = _goods([["Customs Code", "DESIGN", "COLOUR", "ROLL", "WIDTH", "METRS", "PRICE", "AMOUNT"], *[[540773, "NU 5", c, 2, 140, 100 + i, 3, None] for i, c in enumerate(("red", "blue", "sand"))]])
    assert [(r["color"], r["amount"]) for r in rows] == [("red", 300.0), ("blue", 303.0), ("sand", 306.0)]
    _, rows = _goods([["ROLL NR", "DESIGN NAME", "COLOR NR", "METERS", "WIDTH", "m2", "NETT KG", "GROSS KG"], ["TOP NO", "DESEN", "RENK NO", "METRAJ", "EN, CM", "M2", "NETTO KG", "BRUTTO KG"], [1234567890, "PHI", 3, 50.5, 140, 70.7, 20, 21], [None, "Total Roll : 1", None, 50.5, None, None, 20, 21], [1234567891, "CHI", 4, 40, 140, 56, 15, 16]])
    assert [(r["article"], r["width"], r["net_weight"]) for r in rows] == [("PHI", 1.4, 20), ("CHI", 1.4, 15)]
    assert all("hs_code" not in r and "customs_code" not in r for r in rows)


def test_continuation_total_and_second_table():
    _, rows = _goods([["Art No.", "Color", "Quantity", "Unit", "Gross", "Net"], ["X-1", "red", 10, "pcs", 33.5, 30], [None, None, None, None, 19.5, 18], ["X-2", "blue", 5, "pcs", 9, 8], ["TOTAL", None, 15, None, 62, 56], ["Art No.", "Color", "Quantity", "Unit", "Gross", "Net"], ["X-9", "red", 1, "pcs", 1, 1]])
    assert [(r["article"], r["gross_weight"], r["net_weight"], r["n_lines"]) for r in rows] == [("X-1", 53.0, 48.0, 2), ("X-2", 9.0, 8.0, 1)]


def test_family_row_prices_its_children():
    _, rows = _goods([["NO", "ARTICLE", "METERS", "UNIT PRICE", "AMOUNT"], [1, "PSI 01", 100, None, None], [2, "PSI 02", 50, None, None], [None, "PSI", 150, 4, 600], [3, "RHO 7", 10, 2, 20]])
    assert [(r["article"], r["price"], r["amount"]) for r in rows] == [("PSI 01", 4, 400.0), ("PSI 02", 4, 200.0), ("RHO 7", 2, 20.0)]


def test_numbers_and_codes():
    pins = {"77.700": 77.7, "3,047.000": 3047, "1.234.567": 1234567, "2 736.15": 2736.15, "5,78 USD": 5.78, "£12.50": 12.5, "3.85$": 3.85, "10061.93 TRY": 10061.93, "¥44.55": 44.55, "1.38 M": 1.38, "54.07.73.00.90.11": None, "": None, "abc": None}
    assert {k: S.number(k) for k in pins} == pins
    assert S.code("54.07.73.00.90.11") == "540773009011" and S.code("5407730000000.0") == "5407730000000" and S.code("20270.25") is None


def test_workbook_with_merges_end_to_end(spark):
    rows = [["Art No.", "Color", "Quantity", "Price", "Net"], ["Y-1", "red", 18, 2.5, 9.5], [None, "blue", 1080, 2.5, 100], ["Y-2", "sand", 7, 3, 4], ["TOTAL", None, 1105, None, 113.5]]
    data = bytearray(books.make_book([("Invoice", rows, [(1, 0, 2, 0)]), ("Empty", [], [])]))
    files = spark.createDataFrame([("a.xlsx", data), ("b.xls", bytearray(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")), ("c.xlsx", bytearray(b"PK\x03\x04broken")), ("d", None)], "path string, content binary")
    cells = books.cells_of(files, ["path"])
    assert {r.path for r in cells.where("problem is not null").collect()} == {"b.xls", "c.xlsx"}
    merges = books.merges_of(files, ["path"])
    assert [tuple(r) for r in merges.collect()] == [("a.xlsx", "Invoice", 1, 0, 2, 0)]
    full = G.fill_merges(cells.where("problem is null"), merges, ["path", "sheet"], add=True)
    assert full.where("inherited").count() == 1
    got = S.extract_sheets(full, ["path", "sheet"], "inherited").orderBy("row").collect()
    assert [(r.article, r.color, r.qty, r.amount, r.net_weight) for r in got] == [("Y-1", "red", 18, 45.0, 9.5), ("Y-1", "blue", 1080, 2700.0, 100), ("Y-2", "sand", 7, 21.0, 4)]
    assert S.mapped_columns(full, ["path", "sheet"]).count() == 5
    assert S.extract_sheets(full.limit(0), ["path", "sheet"]).count() == 0


def test_pages_bytes_and_pipe_tables(spark):
    page = "<html><table><tr><th>Art &amp; No</th><td rowspan=2>1<br>2</td></tr><tr><td>B<table><tr><td>in</td></tr></table></td></tr></table></html>"
    files = spark.createDataFrame([(1, bytearray(page.encode()))], "id int, content binary")
    assert [(r.row, r.col, r.v) for r in books.cells_of(files, ["id"]).orderBy("row", "col").collect()][:2] == [(0, 0, "Art & No"), (0, 1, "1\n2")]
    assert books.merges_of(files, ["id"]).first()[2:] == (0, 1, 1, 1)
    for text, name in (("Упаковочный лист и вес нетто", "cp1251"), ("商业发票和装箱单", "gb18030"), ("Müşteri kodu ve ağırlığı şöyle", "cp1254")):
        assert books.decode_bytes(text.encode(name))[0] == text
    assert books.decode_bytes("ключ".encode("utf-16"))[0] == "ключ"
    assert books.decode_bytes(b"") == ("", "utf-8")
    text = spark.createDataFrame([(1, "a\n| x | y |\n|---|---|\n| 1 | |\n\n| z |")], "id int, text string")
    assert {(r.row, r.col, r.v) for r in books.pipe_tables(text, ["id"]).collect()} == {(0, 0, "x"), (0, 1, "y"), (1, 0, "1"), (1, 1, ""), (0, 0, "z")}


def test_scan_rows_and_claims(spark):
    blocks = spark.createDataFrame([(1, "b", 50.0, 10.0, 12.0), (1, "a", 0.0, 12.0, 12.0), (1, "c", 0.0, 40.0, 12.0)], "page int, text string, x double, y double, height double")
    assert [(r.row, r.col, r.text) for r in G.rows_of_blocks(blocks, ["page"]).orderBy("row", "col").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    from tallyspark.operators import merging as J

    rows = [("k", "F", "child", 1, True, 427.1, 8.0), ("k", "F", "child", 2, True, 301.5, 6.0), ("k", "F", "family", 10, False, 427.1, 8.0), ("k", "F", "family", 11, False, 301.5, 6.0), ("k", "G", "child", 3, False, 708.4, None), ("k", "G", "family", 12, False, 708.4, None), ("k", "H", "child", 4, True, 10.0, None), ("k", "H", "child", 5, True, 20.0, None), ("k", "H", "child", 6, True, 5.0, None), ("k", "H", "family", 13, False, 30.0, None), ("k", "H", "family", 14, False, 5.0, None), ("k", "I", "family", 15, False, 1.0, None)]
    df = spark.createDataFrame(rows, "kit string, fam string, side string, id bigint, digit boolean, metres double, rolls double")
    assert {(r.row_id, r.child_id) for r in J.claim_children(df, ["kit", "fam"]).collect()} == {(10, 1), (11, 2), (12, 3), (13, 4), (13, 5), (14, 6)}
    assert J.claim_children(df.where(F.lit(False)), ["kit", "fam"]).count() == 0
