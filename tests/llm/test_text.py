import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

bpe = pytest.importorskip("tallyspark.llm.bpe")
from tallyspark.llm import canonlist, encode, lookalike, mojibake, packing  # noqa: E402


@pytest.fixture(scope="session")
def coder():
    return bpe.load(bpe.default_path())


@pytest.fixture(scope="session")
def peer(coder):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ids, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab é中🏽<|>_-= \n", max_size=300))
def test_ids_equal_the_public_encoder_and_round_trip(text):
    import public_tokenizers
    import tiktoken

    c = bpe.load(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ids, special_tokens={})
    ids = c.encode(text)
    assert ids == enc.encode_ordinary(text)
    machine = c.decoder()
    assert "".join(map(machine.feed, ids)) + machine.close() == text


@pytest.mark.parametrize("text", ["a" * 5000, "=" * 3001, "ab" * 2000, "_-" * 1500, "<|endoftext|>", "é" * 900])
def test_long_pieces_stream(coder, peer, text):
    assert coder.encode(text) == peer.encode_ordinary(text)


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello hello", "y")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    assert got[1] == [] == got[2]
    assert len(got[3]) == 2


def test_curve_visits_neighbours():
    import numpy as np

    g = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_key(g, 3)
    assert sorted(key) == list(range(512))
    assert np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(1).max() == 1


def test_packing_keeps_every_token(spark, coder):
    texts = [(i, "word " * (i * 7 % 900)) for i in range(300)] + [(900, "long text " * 3000), (901, None), (902, "")] + [(1000 + i, "same text") for i in range(500)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = packing.pack_corpus(df, run_items=400).toPandas()
    sizes = {i: len(coder.encode(t)) for i, t in texts}
    assert got.groupby("doc_id").n_tokens.sum().to_dict() == sizes
    filled = got.dropna().groupby("container_id").n_tokens.sum()
    assert filled.max() <= 2048
    assert len(filled) <= -(-filled.sum() // 2048) + 4
    assert set(got[got.part_no > 0].doc_id) == {900} | {i for i, n in sizes.items() if n > 2048}
    assert packing.pack_corpus(df.limit(0)).count() == 0


def test_look_alikes():
    values = ["Ｖｅlmorа Ѕаblе 110-Α", None, "GÜLVEN 520​", "", "​", "K\xad60‑x", "a\xa0"]
    assert lookalike.fold_array(pa.array(values)).to_pylist() == ["Velmora Sable 110-A", None, "GÜLVEN 520", "", "", "K60-x", "a"]
    assert lookalike.fold_array(pa.array([], pa.string())).to_pylist() == []
    assert lookalike.fold_array(pa.array(["x", "Ａb", "c"]).slice(1, 2)).to_pylist() == ["Ab", "c"]


def test_what_looks_different_stays(spark):
    ref = spark.createDataFrame([("NOLLEN 1",), ("ХАТАС 37",)], "article string")
    rows = spark.createDataFrame([(1, "NÖLLEN 1"), (2, "NOLLEN1"), (3, "N0LLEN 1"), (4, "nollen 1"), (5, "NОLLEN 1"), (6, "NOLLEN 1"), (7, None), (8, "XATAC 37")], "row_id bigint, article string")
    got = lookalike.canonical_values(rows, ref, "row_id", [("article", "article")]).where("value != canonical").collect()
    assert {(r.row_id, r.canonical) for r in got} == {(5, "NOLLEN 1"), (8, "ХАТАС 37")}


def test_automaton_finds_what_brute_force_finds():
    words = ["gross weight", "net weight", "weight", "width", "rolls", "colour", "color"]
    trie = canonlist.Trie((w, w, 1) for w in words)

    def distance(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i in range(len(a)):
            for j in range(len(b)):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    for text in ("wieght", "colur", "netweight", "rols", "gross wegiht", "xx", "witdh", "colours"):
        for most in (0, 1, 2):
            assert {(d, t) for d, t, _ in trie.search(text, most)} == {(distance(text, w), w) for w in words if distance(text, w) <= most}


def test_headers():
    titles = [("Article", "article"), ("Gross weight", "gross_weight"), ("Цвет изделия", "color"), ("Quantity of units", "qty")]
    r = canonlist.Resolver(titles, [("TRUCK", "none", 50), (canonlist.normal_form("Farbe"), "color", 40)])
    say = lambda t: r.resolve(canonlist.normal_form(t))[0]
    assert say("3. Atricle *") == "article"
    assert say("ЦВEТ ИЗДЕЛИЯ") == "color"
    assert say("F a r b e") == "color"
    assert say("Farbe / Цвет изделия") == "color"
    assert say("Gross wieght:") == "gross_weight"
    assert say("Trcuk") == "none"
    assert say("№") == "none"


def test_mojibake():
    lines = ["Каждый рулон снабжён этикеткой с указанием цвета и длины.", "Ткань предназначена для пошива портьер, ширина большая.", "Die Ware ist spätestens im März nach Köln zu liefern.", "Für die zweite Farbe fehlt das Gewicht.", "Ürün açıklaması ve ağırlığı yazılıdır."]
    from collections import Counter

    pairs, singles = Counter(), Counter()
    for line in lines * 50:
        s = f" {line} "
        pairs.update(zip(s, s[1:]))
        singles.update(s[1:])
    d = mojibake.Detector(mojibake.CharModel(dict(pairs), dict(singles)), 6.0)
    for line in lines:
        assert d.repair(line) == (False, line, pytest.approx(d.repair(line)[2]))
    for true, wrong in (("utf-8", "latin-1"), ("utf-8", "cp1251")):
        bad = lines[0].encode(true).decode(wrong, "replace")
        if "�" not in bad:
            assert d.repair(f"ok\n{bad}")[:2] == (True, f"ok\n{lines[0]}")
    assert d.repair(lines[1].encode("cp1251").decode("koi8-r"))[:2] == (True, lines[1])
    assert d.repair("lost � here")[0]
    assert d.repair("")[0] is False


def test_every_garbled_run_of_a_line_is_restored():
    from collections import Counter

    words, rare = ["снабжён", "этикеткой", "указанием", "предназначена", "портьер"], "Öl"
    pairs, singles = Counter(), Counter()
    for word in words + [rare]:
        s = f" {word} "
        pairs.update({p: 200 for p in zip(s, s[1:])})
        singles.update({c: 200 for c in s[1:]})
    d = mojibake.Detector(mojibake.CharModel(dict(pairs), dict(singles)), 6.0)
    parts = [words[i % 5] for i in range(12)]
    bad = f" {rare} ".join(w.encode().decode("latin-1") for w in parts)
    assert d.repair(bad)[:2] == (True, f" {rare} ".join(parts))


def test_a_rare_alias_lends_its_misspellings_a_path(spark):
    titles = [("Article", "article"), ("Gross weight", "gross_weight")]
    rows = [(i, "Article", {0: "article"}) for i in range(30000)] + [(30000, "Bruttogewicht", {0: "gross_weight"}), (30001, "Bruttogewicht", {0: "gross_weight"}), (30002, "Brutogewihct", None), (30003, "Bruttogewicht", None)]
    many = [(40000 + i, f"Article {i}", {0: "article"}) for i in range(3000)]
    sheets = spark.createDataFrame(rows + many, "sheet_id bigint, header_text string, mapping map<int,string>")
    aliases = canonlist.learn_aliases(sheets, titles)
    got = canonlist.map_values(sheets.where("sheet_id in (30002, 30003)"), titles, aliases).collect()
    assert {r.sheet_id: (r.field_key, r.how) for r in got} == {30002: ("gross_weight", "near"), 30003: ("gross_weight", "exact")}


def test_margin_comes_from_every_held_out_line(spark):
    words = ["снабжён", "этикеткой", "указанием", "предназначена", "портьер", "ширина", "большая", "цвета", "длины", "рулон"]
    texts = [(i, " ".join(words[(i // 10**k) % 10] for k in range(5)) + f" № {i}") for i in range(30000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    held = docs.where(mojibake._held_out("text")).select("text").distinct()
    detector, told = mojibake.fit_measured(docs)
    assert held.count() > 2500
    assert told["lines"] == held.count()
    assert 0 < told["garbled"] <= told["lines"]
    assert told["restored"] <= told["garbled"]
    assert 1 <= detector.margin <= 20
