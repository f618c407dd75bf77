"""Lookups, order statistics, pivots, documents, grids and sources on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import documents as docs
from gridloom.operators import grid, lookup, orderstats, pivot
from gridloom.sources import csv, texts, workbook


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_lookup_takes_the_first_of_equal_keys(spark):
    t = spark.createDataFrame([(1, "X", 100.0), (2, "y", 200.0), (3, "Y", 250.0)], "pos int, key string, value double")
    df = spark.createDataFrame([("Y",), ("z",), (None,), ("x",)], "k string")
    assert rows(lookup.vlookup(df, "k", t, "key", "pos", {"v": "value"})) == rows(spark.createDataFrame([("Y", 200.0), ("z", None), (None, None), ("x", 100.0)], "k string, v double"))
    n = spark.createDataFrame([(5,)], "k int")
    s = spark.createDataFrame([(1, "5", "five")], "pos int, key string, value string")
    assert rows(lookup.vlookup(n, "k", s, "key", "pos", {"v": "value"})) == [(5, "five")]
    d = spark.createDataFrame([(3.0,), (3.0000000000000004,), (-0.0,), (None,)], "k double")  # numbers are equal by value, not by their texts
    i = spark.createDataFrame([(1, 3, "three"), (2, 0, "none"), (3, None, "blank")], "pos int, key int, value string")
    assert rows(lookup.vlookup(d, "k", i, "key", "pos", {"v": "value"})) == sorted([(3.0, "three"), (3.0000000000000004, None), (-0.0, "none"), (None, None)], key=str)


def test_ordered_lookups_against_brute_force(spark):
    random.seed(3)
    table = [(p, random.choice([None, *range(20)])) for p in range(1, 40)]
    keys = [(i, random.choice([None, -5.0, 3.5, 7.0, 25.0, float(i % 21)])) for i in range(200)] + [(500, 7.0)] * 3
    t, k = spark.createDataFrame(table, "pos int, v int"), spark.createDataFrame(keys, "id int, k double")
    for up in (True, False):
        got = rows(lookup.match_ordered(k, "k", t, "v", "pos", {"p": "pos"}, ascending=up))
        want = [(i, x, None if x is None else max((p for p, v in table if v is not None and (v <= x if up else v >= x)), default=None)) for i, x in keys]
        assert got == sorted(want, key=str)
    got = {i: p for i, _, p in rows(lookup.vlookup_approx(k, "k", t.filter("v is not null"), "v", "pos", {"p": "pos"}, in_order=False))}
    clean = [(p, v) for p, v in table if v is not None]
    for i, x in keys:
        best = None
        for p, v in clean:
            if x is None or v > x:
                break
            best = p
        assert got[i] == best


def test_order_statistics(spark):
    random.seed(5)
    values = [float(random.randint(0, 30)) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    s = sorted(values)
    got = dict(rows(orderstats.quantiles(df.select("x"), [0.0, 0.33, 0.5, 1.0])))
    for p, v in got.items():
        r = p * (len(s) - 1)
        assert abs(v - (s[int(r)] + (r - int(r)) * (s[min(int(r) + 1, len(s) - 1)] - s[int(r)]))) < 1e-9
    ranks = {i: r for i, _, r in rows(orderstats.rank_rows(df, "x"))}
    assert all(ranks[i] == 1 + sum(w > v for w in values) for i, v in enumerate(values))
    total, run = 0.0, {i: t for i, _, t in rows(pivot.running_total(df, "id", "x"))}
    for i, v in enumerate(values):
        total += v
        assert run[i] == total
    five = spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double")
    assert dict(rows(orderstats.percent_rank_rows(five, "x")))[3.0] == 0.625


def test_pivot(spark):
    df = spark.createDataFrame([("East", "Widget", 100.0), ("East", "Gadget", 200.0), ("West", "Widget", 150.0), ("West", "Gadget", 250.0)], "Region string, Product string, Amount double")
    assert rows(pivot.pivot_grid(df, ["Region"], "Product", [("Amount", "sum")])) == [("East", 200.0, 100.0), ("West", 250.0, 150.0)]
    assert rows(pivot.with_totals(df, {"Amount": "sum"}, "Region").filter("is_total")) == [("Total", None, 700.0, True)]


def test_reordered_keeps_pages_past_the_order(spark):
    pages = spark.createDataFrame([(d, p) for d in "ab" for p in range(1, 6)], "doc string, page int")
    assert rows(docs.reordered(pages, "page", [2, 1, 3])) == [(d, p, {1: 2, 2: 1}.get(p, p)) for d in "ab" for p in range(1, 6)]


def test_documents(spark):
    df = spark.createDataFrame([(1, "aaa bb"), (2, None), (3, "")], "id int, t string")
    assert rows(docs.find_replace(df, "t", "a", "aa")) == [(1, "aaaaaa bb", 3), (2, None, 0), (3, "", 0)]
    lines = docs.paginated(spark.createDataFrame([(1, "one two three\n\nsupercalifragilistic x")], "id int, t string"), "id", "t", 8, 2)
    assert rows(lines) == [(1, 1, 1, "one two"), (1, 1, 2, "three"), (1, 2, 1, ""), (1, 2, 2, "supercalifragilistic"), (1, 3, 1, "x")]
    assert docs.page_numbers("1-3,5,2", 9) == [1, 2, 3, 5] and docs.rows_per_page(100, 10, 10, 15) == 5
    edges = spark.createDataFrame([("0", "a", 2), ("0", "b", 1), ("a", "c", 1)], "parent string, id string, ord int")
    assert [(r["id"], r["depth"]) for r in docs.tree_paths(edges).orderBy("path").collect()] == [("b", 1), ("a", 1), ("c", 2)]
    form = spark.createDataFrame([("a.b", "1"), ("c", None)], "name string, value string")
    assert rows(docs.filled(form, {"c": "2", "q": "9"})) == [("a.b", "1"), ("c", "2")]
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    assert rows(docs.inserted(pages, "page", 2, spark.createDataFrame([(1,)], "page int"))) == [(1,), (2,), (3,)]
    facts = spark.createDataFrame([(1, True, None)], "id int, marked boolean, title string")
    assert [r[1] for r in rows(docs.conformance(facts, "id", [r for r in docs.ACCESS_RULES if r[0] in ("7.2", "7.3")]))] == ["7.3"]


def test_grid(spark):
    assert grid.cell_position("$XFD$1048576") == (1048576, 16384) and grid.column_letters(28) == "AB"
    assert grid.filled_down("SUM($A$1:A5)&\"A1\"", 1) == "SUM($A$1:A6)&\"A1\"" and grid.filled_down("A1", -1) == "#REF!"
    assert grid.formula_after_shift("A5+B2", "row", 3, -2) == "A3+B2" and grid.formula_after_shift("A3", "row", 3, -1) == "#REF!"
    assert grid.unique_names(["a", "", "A", "a"]) == ["a", "Column2", "A2", "a3"]
    t = spark.createDataFrame([(1, "x", 2.0), (2, None, 3.0)], "pos int, s string, n double")
    cells = grid.cells_of(t, "S", "pos")
    assert rows(grid.as_table(cells, "A1:B3").select("s", "n")) == rows(spark.createDataFrame([("x", "2.0"), (None, "3.0")], "s string, n string"))
    assert grid.read_range(cells, "A1:C3", blanks=True).count() == 9
    assert rows(grid.shift(cells, "row", 2, 1).filter("kind = 'number'").select("row"))[0] == (3,)


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b'\xef\xbb\xbfName,Age,Active\r\n"Smith, ""J""",30,TRUE\r\n"two\nlines",007,\r\n')
    df = csv.read_csv(spark, str(p))
    got = csv.typed(df).collect()
    assert [r["c1"]["txt"] for r in got] == ["Name", 'Smith, "J"', "two\nlines"]
    assert [r["c2"]["kind"] for r in got] == ["text", "number", "text"] and [r["c3"]["kind"] for r in got] == ["text", "boolean", "blank"]
    assert rows(csv.csv_lines(spark.createDataFrame([('a"b', 1.5, True, None)], "a string, b double, c boolean, d string"))) == [('"a""b",1.5,TRUE,',)]


def test_workbook(spark, tmp_path):
    p = tmp_path / "w.xlsx"
    p.write_bytes(workbook.workbook_bytes("My & Sheet", [["x<y", 1.5, True], [None, 2, False]], ["a", "b", "c"]))
    cells = workbook.read_workbooks(spark, str(p))
    got = {(r["row"], r["col"]): (r["kind"], r["num"], r["txt"], r["bool"]) for r in cells.collect()}
    assert got[(2, 1)] == ("text", None, "x<y", None) and got[(2, 2)] == ("number", 1.5, None, None) and got[(3, 3)] == ("boolean", None, None, False) and (3, 1) not in got
    assert cells.select("sheet").first()[0] == "My & Sheet"


def test_texts(spark):
    md = spark.createDataFrame([(1, "# T\n\none\ntwo\n- a\n- b\n```\nx = 1\n\ny\n```\n> q\n***")], "id int, t string")
    got = [(r["kind"], r["level"], r["text"]) for r in texts.markdown_blocks(md, "id", "t").orderBy("seq").collect()]
    assert got == [("heading", 1, "T"), ("paragraph", 0, "one two"), ("list", 0, "a"), ("list", 0, "b"), ("code", 0, "x = 1\n\ny"), ("quote", 0, "q"), ("rule", 0, "")]
    pts = texts.chart_points(spark.createDataFrame([("c", float("nan"), 2.0)], "k string, a double, b double"), "k", ["a", "b"])
    assert '"y":2.0' in texts.chart_json(pts, F.col("category"), "T").first()[0]
    xml = texts.document_xml(spark.createDataFrame([(1, 1, 1, "a<b")], "id int, page int, line int, text string"), "id")
    assert rows(texts.xml_paragraphs(xml, "id", "xml")) == [(1, 0, "a<b")]


def test_pages_moved_and_cloned(spark):
    decks = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), (None, 1, "x"), (None, 2, "w"), ("b", 1, "q")]
    df, is_x = spark.createDataFrame(decks, "deck string, place long, name string"), F.col("name") == "x"
    order = lambda out: {d: "".join(r.name for r in sorted(out.collect(), key=lambda r: r.place) if r.deck == d) for d in ("a", None, "b")}
    assert order(docs.moved(df, "place", is_x, F.col("pages"), ["deck"])) == {"a": "yzx", None: "wx", "b": "q"}
    assert order(docs.moved(df, "place", F.col("name") == "z", 1, ["deck"])) == {"a": "zxy", None: "xw", "b": "q"}
    assert order(docs.cloned(df, "place", is_x, ["deck"])) == {"a": "xyzx", None: "xwx", "b": "q"}
    twice = docs.cloned(df, "place", is_x, ["deck"], 1)
    assert order(twice) == {"a": "xxyz", None: "xxw", "b": "q"} and twice.schema["place"].dataType == df.schema["place"].dataType
    for bad in (lambda: docs.moved(df, "place", is_x, 4, ["deck"]), lambda: docs.moved(df, "place", F.col("place") < 3, 1, ["deck"]), lambda: docs.cloned(df, "place", is_x, ["deck"], 0)):
        with pytest.raises(ValueError):
            bad()
    assert docs.moved(df.limit(0), "place", is_x, 1, ["deck"]).count() == 0


def test_inherited_values_come_from_the_nearest_level(spark):
    shapes = spark.createDataFrame([(1, "l1", None, None), (2, "l1", False, 9.0), (3, "l2", None, None), (4, None, None, None), (5, "lost", True, None)], "id int, layout string, bold boolean, size double")
    layouts = spark.createDataFrame([("l1", "m", None, 12.0), ("l2", None, True, None), (None, "m", True, 1.0)], "name string, master string, bold boolean, size double")
    masters = spark.createDataFrame([("m", True)], "master string, bold boolean")
    got = docs.inherited(shapes, [(layouts, "name", "layout"), (masters, "master", "master")], ["bold", "size"])
    assert got.columns == shapes.columns
    assert rows(got) == sorted([(1, "l1", True, 12.0), (2, "l1", False, 9.0), (3, "l2", True, None), (4, None, None, None), (5, "lost", True, None)], key=str)
