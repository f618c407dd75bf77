"""Files of documents, sheets and slides on small fixtures, and document operators that work on several documents."""

import base64
import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.operators import documents as docs
from gridloom.operators import grid, lookup, pivot
from gridloom.sources import charts, csv, pdf, slides, workbook


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pdf_file(objects, root=1, extra=b"", version=b"1.4"):
    """A file of the given bodies, numbered from 1."""
    out, places = b"%PDF-" + version + b"\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    at = len(out)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer\n<</Size %d/Root %d 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, root, extra, at)


def stream(data, more=b""):
    return b"<<%s/Length %d>>\nstream\n" % (more, len(data)) + data + b"\nendstream"


CONTENT = b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 5 Td (a\\(b\\051\\n) Tj 0 -12 TD [(x) -500 (y)] TJ T* <414243> Tj ET Q /Fx Do BI /W 1 ID abc EI BT /F2 8 Tf 1 0 0 1 3 4 Tm 2 TL (p) ' (ignored) ET"
DOC = [
    b"<</Type/Catalog/Pages 2 0 R/Lang(en)/Outlines 9 0 R/AcroForm<</Fields[11 0 R]>>/Names<</Dests<</Names[(one)[3 0 R/Fit](none)[99 0 R]]>>/EmbeddedFiles<</Names[(f)<</F(a.txt)/EF<</F 13 0 R>>>>]>>>>/PageLabels<</Nums[0<</S/r>>1<</S/D/P(A-)/St 3>>]>>>>",
    b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/MediaBox[0 0 200 300]/Rotate 90/Resources<</Font<</F1 6 0 R/F2 7 0 R>>/XObject<</Fx 8 0 R>>>>>>",
    b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/Annots[<</Subtype/Square/Rect[1 2 11 22]/Contents(hi)/C[1 0 0]/F 4>> <</Subtype/Widget/Rect[0 0 1 1]>>]>>",
    b"<</Type/Page/Parent 2 0 R/CropBox[10 10 50 50]/Rotate 0>>",
    stream(zlib.compress(CONTENT), b"/Filter/FlateDecode"),
    b"<</Type/Font/Subtype/Type1/BaseFont/Courier>>",
    b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/ToUnicode 14 0 R>>",
    stream(b"BT /F1 6 Tf 7 7 Td (form) Tj ET", b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 100 0]"),
    b"<</First 10 0 R>>",
    b"<</Title(Top)/Dest[4 0 R/Fit]/First<</Title(In)>>/Next<</Title(Last)>>>>",
    b"<</T(group)/Kids[12 0 R]>>",
    b"<</T(field)/FT/Tx/V(value)>>",
    stream(b"inside", b"/Subtype/text#2Fplain"),
    stream(b"1 beginbfchar <70> <00e9> endbfchar 1 beginbfrange <71> <73> <0041> endbfrange"),
]


def of(spark, table, *files):
    return pdf.records(spark.createDataFrame([(k, f) for k, f in enumerate(files)], "doc long, content binary"), table, "doc")


def test_pdf_records(spark):
    whole = pdf_file(DOC)
    broken = whole.replace(b"startxref", b"startxxxx").replace(b"xref\n0", b"xxxx\n0")
    for file in (whole, broken):
        spans = [(r["page"], r["text"], round(r["x"], 3), round(r["y"], 3), r["font_size"], r["font"]) for r in of(spark, "spans", file).orderBy("page", "seq").collect()]
        assert spans == [(1, "a(b)\n", 20.0, 30.0, 20.0, "Courier"), (1, "x", 20.0, 6.0, 20.0, "Courier"), (1, "y", 42.0, 6.0, 20.0, "Courier"), (1, "ABC", 20.0, -18.0, 20.0, "Courier"), (1, "form", 107.0, 7.0, 6.0, "Courier"), (1, "é", 3.0, 2.0, 8.0, "Helvetica"), (1, "ignored", pytest.approx(3 + 8 * 0.5, abs=1), 2.0, 8.0, "Helvetica")][: len(spans)]
        assert rows(of(spark, "pages", file).select("page", "width", "height", "crop", "rotate")) == [(1, 200.0, 300.0, [0.0, 0.0, 200.0, 300.0], 90), (2, 200.0, 300.0, [10.0, 10.0, 50.0, 50.0], 0)]
        assert rows(of(spark, "annotations", file).select("page", "subtype", "x", "y", "width", "height", "contents", "color"))[0] == (1, "Square", 1.0, 2.0, 10.0, 20.0, "hi", [1.0, 0.0, 0.0])
        assert rows(of(spark, "fields", file).drop("doc")) == [("group.field", "Tx", "value")]
        assert rows(of(spark, "bookmarks", file).drop("doc")) == [(1, 0, 1, "Top", 2), (2, 1, 2, "In", 0), (3, 0, 1, "Last", 0)]
        assert rows(of(spark, "destinations", file).drop("doc")) == [("one", 1)] and rows(of(spark, "labels", file).drop("doc")) == [(0, "r", None, 1), (1, "D", "A-", 3)]
        assert rows(of(spark, "attachments", file).drop("doc")) == [("a.txt", "text/plain", None, b"inside")]
    names = [r["name"] for r in of(spark, "operators", whole).filter("page = 1").orderBy("seq").collect()]
    assert names[:6] == ["q", "cm", "BT", "Tf", "Td", "Tj"] and "BI" in names and names.count("BT") == 3
    assert of(spark, "spans", b"", None, b"no pdf").count() == 0 and [r["parsed"] for r in of(spark, "facts", b"junk").collect()] == [False]
    assert of(spark, "metadata", whole).first()["pages"] == 2 and of(spark, "objects", whole).filter("type = 'Page'").first()["refs"] == [2, 5]


def test_pdf_rules(spark):
    def found(file, rules, profile="A1B"):
        return {(r["rule_id"], r["severity"]) for r in docs.conformance(of(spark, "facts", file), "doc", rules, profile).collect()}

    plain = found(pdf_file(DOC), docs.ARCHIVE_RULES)
    assert plain == {("6.1.3", "error"), ("6.2.2", "warning"), ("6.3.3", "error"), ("6.5.4", "error"), ("6.7.2", "error"), ("6.8", "error")} and ("6.8", "error") not in found(pdf_file(DOC), docs.ARCHIVE_RULES, "A3B")
    xmp = stream(b'<x xmlns:p="http://www.aiim.org/pdfa/ns/id/"><p:part>1</p:part><p:conformance>B</p:conformance><!--pdfuaid >1<--><dc:title xmlns:dc="d"/></x>')
    tagged = [
        b"<</Type/Catalog/Pages 2 0 R/Lang(en)/MarkInfo<</Marked true>>/ViewerPreferences<</DisplayDocTitle true>>/Metadata 4 0 R/OutputIntents[]/OpenAction<</S/JavaScript>>/StructTreeRoot 5 0 R>>",
        b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R>>", xmp,
        b"<</ParentTree<<>>/RoleMap<</a/P/b/Odd>>/K[<</S/H1>><</S/H3>><</S/Figure>><</S/Table/K[<</S/TD>>]>><</S/L/K[<</S/LI/K[<</S/Lbl>>]>>]>><</S/Form/Alt(x)>>]>>",
        b"<</Type/ExtGState/ca 0.5/BM/Multiply>>",
    ]
    file = pdf_file(tagged, extra=b"/ID[(a)(b)]/Encrypt<<>>", version=b"1.6")
    assert found(file, docs.ARCHIVE_RULES) == {("6.1.2", "error"), ("6.1.3", "error"), ("6.4", "error"), ("6.6.2", "error")} and found(file, docs.ARCHIVE_RULES, "A2B") == {("6.1.3", "error"), ("6.6.2", "error"), ("6.7.2", "error")}
    assert found(file, docs.ACCESS_RULES) == {("7.6", "warning"), ("7.7", "error"), ("7.8", "warning"), ("7.9", "warning"), ("7.10", "warning"), ("7.14", "error")}
    assert found(b"junk", docs.ARCHIVE_RULES) == {("6.1", "error")}
    order = [r["severity"] for r in docs.ordered_violations(docs.conformance(of(spark, "facts", file), "doc", docs.ACCESS_RULES)).collect()]
    assert order == sorted(order)


def test_pdf_filters():
    data = bytes(random.Random(3).choices(b"abcab", k=3000))
    assert pdf.ascii_85(base64.a85encode(data) + b"~>", {}) == data and pdf.ascii_hex(data.hex().encode() + b">", {}) == data
    assert pdf.run_length(b"\x02abc\xfed\x80", {}) == b"abcddd"
    codes, table, word = [256], {bytes([i]): i for i in range(256)}, b""
    bits, width, out, held = 0, 9, bytearray(), 0

    def put(code, width):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)

    size = 258
    put(256, width)
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        put(table[word], width)
        if size < 4096:
            table[word + bytes([c])] = size
            size += 1
        width = min(12, max(9, size.bit_length()))
        word = bytes([c])
    put(table[word], width)
    put(257, width)
    out.append(bits << (8 - held) & 255 if held else 0)
    assert pdf.lzw(bytes(out), {}) == data and codes
    lines = [bytes(random.Random(k).choices(range(256), k=12)) for k in range(5)]
    coded, before = b"", bytes(12)
    for k, line in enumerate(lines):
        guess = [0, *line[:-1]] if k % 5 == 1 else before if k % 5 == 2 else [((0 if i < 1 else line[i - 1]) + before[i]) // 2 for i in range(12)] if k % 5 == 3 else bytes(12)
        coded += bytes([k if k < 4 else 0]) + bytes((x - g) & 255 for x, g in zip(line, guess))
        before = line
    assert pdf.unpredicted(coded, {"Predictor": 15, "Columns": 12}) == b"".join(lines)


def test_compressed_streams(spark):
    file = pdf_file([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]/Count 0>>", stream(b"a" * 2000), stream(b"short"), stream(zlib.compress(b"b" * 3000), b"/Filter/FlateDecode")])
    saved = {r["number"]: r["saved"] for r in pdf.compressed(of(spark, "objects", file)).collect()}
    assert saved[3] > 1900 and saved[4] == 0 and saved[5] == 0


def test_workbooks_of_several_sheets(spark, tmp_path):
    cells = spark.createDataFrame(
        [("b1", "Zwei", 1, 1, "number", 1.5, None, None, None, None, 1), ("b1", "Zwei", 1, 3, "text", None, "<&>", None, None, None, None), ("b1", "A & \"B\"", 2, 1, "boolean", None, None, True, None, "1=1", None), ("b1", "Zwei", 3, 1, "error", None, None, None, "#N/A", "NA()", None), ("b2", "S", 1, 1, "text", None, "x", None, None, "\"x\"", None)],
        grid.CELLS,
    )
    files = workbook.workbook_files(cells, {1: '0.00"€"'})
    assert rows(workbook.workbook_cells(files, "workbook", "content").fillna({"style": 0})) == rows(cells.fillna({"style": 0}))
    assert [bytes(r["content"]) for r in files.orderBy("workbook").collect()] == [bytes(r["content"]) for r in workbook.workbook_files(cells.repartition(3), {1: '0.00"€"'}).orderBy("workbook").collect()]
    assert workbook.workbook_cells(files, "workbook", "content", "zwei").count() == 3
    assert rows(workbook.saved(files, f"file://{tmp_path}/out").select("file")) == [("b1.xlsx",), ("b2.xlsx",)]
    assert workbook.read_workbooks(spark, f"{tmp_path}/out/*.xlsx").count() == 5


SHOW = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def deck():
    """A presentation with a group, a table, a link, notes, comments, a section, a diagram, a transition and an animation."""
    text = lambda *lines: "<p:txBody>" + "".join(f"<a:p>{line}</a:p>" for line in lines) + "</p:txBody>"
    run = lambda t, f="r": f"<a:{f}><a:rPr b=\"1\"/><a:t>{t}</a:t></a:{f}>"
    own = lambda k, n, more="": f'<p:nvSpPr><p:cNvPr id="{k}" name="{n}">{more}</p:cNvPr><p:nvPr/></p:nvSpPr>'
    table = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="5" name="T"/></p:nvGraphicFramePr><a:graphic><a:tbl><a:tr><a:tc gridSpan="2"><a:txBody><a:p>{run("c1")}</a:p></a:txBody></a:tc><a:tc hMerge="1"/></a:tr></a:tbl></a:graphic></p:graphicFrame>'
    first = (
        f'<p:sld {SHOW}><p:cSld name="One"><p:spTree>'
        f'<p:sp>{own(2, "Title", "<a:hlinkClick r:id=%srId9%s/>" % (chr(34), chr(34)))}{text(run("Hel") + run("lo world"), run("x") + run("1", "fld") + run("y"))}</p:sp>'
        f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="3" name="G"/></p:nvGrpSpPr><p:sp>{own(4, "In")}{text(run("in group"))}</p:sp></p:grpSp>{table}</p:spTree></p:cSld>'
        '<p:transition spd="fast" advClick="0" advTm="2000"><p:push dir="r"/></p:transition><p:timing><p:tnLst><p:par><p:cTn><p:childTnLst><p:seq><p:cTn><p:childTnLst><p:par><p:cTn presetID="10" presetClass="entr" nodeType="clickEffect"><p:tgtEl><p:spTgt spid="2"/></p:tgtEl></p:cTn></p:par></p:childTnLst></p:cTn></p:seq></p:childTnLst></p:cTn></p:par></p:tnLst></p:timing></p:sld>'
    )
    rel = lambda *items: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="http://x/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"
    section = '<p:extLst><p:ext uri="{521415D9-36F7-43E2-AB2F-B90AF26B5E84}"><s:sectionLst xmlns:s="http://schemas.microsoft.com/office/powerpoint/2010/main"><s:section name="Intro"><s:sldIdLst><s:sldId id="256"/><s:sldId id="999"/></s:sldIdLst></s:section></s:sectionLst></p:ext></p:extLst>'
    diagram = '<d:dataModel xmlns:d="http://schemas.openxmlformats.org/drawingml/2006/diagram" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><d:ptLst><d:pt modelId="r" type="doc"/><d:pt modelId="n1"><d:t><a:p><a:r><a:t>node</a:t></a:r></a:p></d:t></d:pt><d:pt modelId="n2"/></d:ptLst><d:cxnLst><d:cxn srcId="r" destId="n1" srcOrd="0"/><d:cxn srcId="n1" destId="n2" srcOrd="1"/><d:cxn type="presOf" srcId="r" destId="n2"/></d:cxnLst></d:dataModel>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {SHOW}><p:sldIdLst><p:sldId id="256" r:id="rId1"/><p:sldId id="257" r:id="rId2"/></p:sldIdLst>{section}</p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(("rId1", "slide", "slides/slide1.xml"), ("rId2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": first, "ppt/slides/slide2.xml": f'<p:sld {SHOW} show="0"><p:cSld><p:spTree/></p:cSld></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": rel(("rId1", "notesSlide", "../notes/n1.xml"), ("rId2", "comments", "../comments/c1.xml"), ("rId3", "diagramData", "../diagrams/d1.xml"), ("rId9", "hyperlink", "http://example.com/")),
        "ppt/notes/n1.xml": f'<p:notes {SHOW}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="1" name="n"/><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr>{text(run("say this"))}</p:sp></p:spTree></p:cSld></p:notes>',
        "ppt/commentAuthors.xml": f'<p:cmAuthorLst {SHOW}><p:cmAuthor id="1" name="Ann" initials="A"/></p:cmAuthorLst>',
        "ppt/comments/c1.xml": f'<p:cmLst {SHOW}><p:cm authorId="1" idx="3" dt="2020-01-01T00:00:00"><p:pos x="5" y="6"/><p:text>good</p:text></p:cm><p:cm authorId="8" idx="4"><p:text>lost</p:text></p:cm></p:cmLst>',
        "ppt/diagrams/d1.xml": diagram,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def test_presentations(spark):
    odp = io.BytesIO()
    with zipfile.ZipFile(odp, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.presentation")
        z.writestr("content.xml", '<o:document xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:d="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:t="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:p="urn:oasis:names:tc:opendocument:xmlns:presentation:1.0"><d:page d:name="P"><d:frame><t:p>one</t:p><t:p>two</t:p></d:frame><p:notes><d:frame><t:p>note</t:p></d:frame></p:notes></d:page></o:document>')
    files = spark.createDataFrame([(1, deck()), (2, None), (3, b"no zip"), (4, odp.getvalue())], "doc long, content binary")
    of_ = lambda t: rows(slides.records(files, t, "doc"))
    assert of_("slides") == [(1, 1, 256, "One", False, True, "Hello world\nx1y"), (1, 2, 257, "", True, False, ""), (4, 1, None, "P", False, True, "one\ntwo")]
    assert [r[2:] for r in of_("paragraphs") if r[0] == 1] == [("0001", 1, "Hello world"), ("0001", 2, "x1y"), ("0002.0001", 1, "in group"), ("0003.0001.0001", 1, "c1")]
    assert of_("tables") == [(1, 1, "0003", 1, 1, 1, 2, False, "c1"), (1, 1, "0003", 1, 2, 1, 1, True, "")] and of_("notes") == [(1, 1, "say this"), (4, 1, "note")]
    assert of_("links") == [(1, 1, "0001", "Title", "http://example.com/", None)] and of_("transitions") == [(1, 1, "push", "r", 0.5, False, 2.0)] and of_("animations") == [(1, 1, 0, 1, 10, "entr", "clickEffect", 2)]
    assert of_("statistics") == [(1, 2, 1, 1), (4, 1, 0, 1)] and [r[2] for r in of_("shapes")] == ["0001", "0002", "0002.0001", "0003"]
    known = docs.with_authors(slides.records(files, "comments", "doc"), slides.records(files, "authors", "doc").select("author_id", "name"))
    assert rows(known.select("text", "author", "x")) == [("good", "Ann", 5)]
    assert rows(slides.section_slides(slides.records(files, "sections", "doc"), slides.records(files, "slides", "doc"), "doc")) == [(1, 1, "Intro", 1)]
    tree = docs.tree_paths(slides.records(files, "diagrams", "doc"), by=["doc"])
    assert rows(tree.select("id", "depth")) == [("n1", 1), ("n2", 2)]
    runs = slides.records(files, "runs", "doc")
    by = ["doc", "slide", "place", "paragraph"]
    changed = slides.replaced_runs(runs, "Hello", "Hello Hello", by)
    assert [(r["text"], r["replacements"]) for r in changed.filter("place = '0001' and paragraph = 1").orderBy("seq").collect()] == [("Hello Hello", 1), (" world", 0)]
    assert {r["text"] for r in slides.replaced_runs(runs, "x1y", "no", by).filter("place = '0001' and paragraph = 2").collect()} == {"x", "1", "y"}


def test_replacing_in_runs_equals_replacing_in_the_text():
    rnd = random.Random(5)
    for _ in range(500):
        parts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4))) for _ in range(rnd.randint(1, 5))]
        got = slides.replace_in([{"seq": i, "field": False, "text": t} for i, t in enumerate(parts)], "ab", "<ab>", True)
        assert "".join(r["text"] for r in got) == "".join(parts).replace("ab", "<ab>") and sum(r["n"] for r in got) == "".join(parts).count("ab")


def test_documents_by_key(spark):
    ops = spark.createDataFrame([("a", 1, 5.0, 5.0), ("b", 1, 5.0, 5.0)], "doc string, page int, x double, y double")
    regions = spark.createDataFrame([("a", 1, 0.0, 0.0, 9.0, 9.0)], "doc string, page int, x double, y double, width double, height double")
    assert rows(docs.in_regions(ops, regions, by=["doc"]).select("doc")) == [("b",)] and rows(docs.in_regions(ops, regions, True, ["doc"]).select("doc")) == [("a",)]
    pages = spark.createDataFrame([(d, p) for d, n in (("a", 3), ("b", 5)) for p in range(1, n + 1)], "doc string, page int")
    assert rows(docs.reordered(pages, "page", F.col("pages") + 1 - F.col("page"), ["doc"])) == [(d, p, n + 1 - p) for d, n in (("a", 3), ("b", 5)) for p in range(1, n + 1)]
    for bad in (lambda: docs.reordered(pages, "page", F.lit(1), ["doc"]), lambda: docs.reordered(pages, "page", [2, 1, 3], ["doc"], strict=True), lambda: docs.deleted(pages, "page", [1, 2, 3], ["doc"])):
        with pytest.raises(ValueError):
            bad()
    assert rows(docs.split_by_ranges(pages.filter("doc = 'b'"), "page", [(4, None)]).select("page", "part")) == [(4, 1), (5, 1)]
    new = spark.createDataFrame([("a", 1), ("a", 2)], "doc string, page int")
    assert rows(docs.inserted(pages, "page", 2, new, ["doc"]).select("doc", "page")) == [("a", k) for k in range(1, 6)] + [("b", k) for k in range(1, 6)]
    edges = spark.createDataFrame([("0", "n0", 0)] + [(f"n{i}", f"n{i + 1}", 0) for i in range(70)] + [("n70", "n3", 0), ("x", "y", 0), ("y", "x", 0)], "parent string, id string, ord int")
    found = docs.tree_paths(edges).collect()
    assert len(found) == 71 and max(r["depth"] for r in found) == 71
    stamp = docs.stamped(spark.createDataFrame([("a", 1, 0, 1.0, 1.0, "t")], "doc string, page int, seq int, x double, y double, text string"), "DRAFT", 3, 4, pages, ["doc"])
    assert stamp.filter("text = 'DRAFT'").count() == 8
    same = spark.createDataFrame([(1, "a" * 200), (2, "a" * 100 + "b" + "a" * 99), (3, "a" * 200), (4, None)], "id int, t string")
    assert rows(docs.likely_duplicates(same, "id", F.col("t")).select("id", "canonical")) == [(1, 1), (2, 1), (3, 1), (4, 4)] and rows(docs.duplicates(same, "id", F.col("t")).select("id", "canonical")) == [(1, 1), (2, 2), (3, 1), (4, 4)]
    assert docs.found_by_key(pages, "doc", "A").count() == 3


def test_large_lookups_equal_small_ones(spark, monkeypatch):
    """The as-of join of two large sides, also with equal keys and on texts, gives what the search of a small table gives."""
    rnd = random.Random(6)
    table = spark.createDataFrame([(p, float(rnd.randint(0, 30)), rnd.choice("abcdeXYZ_") + rnd.choice("abc")) for p in range(1, 80)], "pos int, v double, t string")
    keys = spark.createDataFrame([(i, rnd.choice([None, 3.5, 7.0, -1.0, 40.0]), rnd.choice([None, "B", "xb", "_", "zz"])) for i in range(300)], "id int, k double, s string")
    cases = [("k", "v", True), ("k", "v", False), ("s", "t", True), ("s", "t", False), ("k", "t", True)]
    small = [rows(lookup.match_ordered(keys, k, table, v, "pos", {"p": "pos"}, up)) for k, v, up in cases] + [rows(lookup.vlookup_approx(keys, k, table, v, "pos", {"p": "pos"}, False)) for k, v, _ in cases]
    monkeypatch.setattr(lookup, "SEARCHED_ROWS", 5)
    large = [rows(lookup.match_ordered(keys, k, table, v, "pos", {"p": "pos"}, up)) for k, v, up in cases] + [rows(lookup.vlookup_approx(keys, k, table, v, "pos", {"p": "pos"}, False)) for k, v, _ in cases]
    assert small == large


def test_exact_lookups_with_hot_and_null_keys(spark, monkeypatch):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end k", "id")
    table = spark.range(2500).selectExpr("id pos", "id key", "id * 2 v")
    want = rows(lookup.vlookup(df, "k", table, "key", "pos", {"v": "v"}))
    monkeypatch.setattr(lookup, "SMALL_ROWS", 10)
    assert rows(lookup.vlookup(df, "k", table, "key", "pos", {"v": "v"})) == want and len(want) == 3000


def test_pivot_blanks_checks_and_windows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), ("b", "x", 4.0)], "r string, c string, v double")
    assert rows(pivot.pivot_grid(df, ["r"], "c", [("v", "sum")])) == [("a", 1.0, 2.0), ("b", 4.0, None)]
    assert pivot.totals_row(df, {"v": "=SUM(v)*2"}, "r").first()["v"] == 14
    for bad in (lambda: pivot.pivot_checked(["a", ""], (1, 1, 5, 2), (9, 9), True), lambda: pivot.pivot_checked(["a"], (1, 1, 5, 2), (2, 2), True), lambda: pivot.pivot_checked(["a"], (5, 1, 1, 2), (9, 9), True)):
        with pytest.raises(ValueError):
            bad()
    m = pivot.moving(spark.range(10).selectExpr("id", "cast(id as double) v"), [], "id", "v", 2, "sum")
    assert rows(m.select("id", "moving")) == [(i, float(sum(range(max(0, i - 2), i + 1)))) for i in range(10)]


def test_csv_in_parts_and_with_marks(spark, tmp_path):
    df = spark.createDataFrame([("é,x", 1.0), ("b", None)], "a string, b double").coalesce(1)
    csv.write_csv(df, f"{tmp_path}/o", encoding="UTF-16LE", mark=True)
    assert csv.sniffed_encoding(spark, f"{tmp_path}/o") == "UTF-16LE"
    assert rows(csv.read_csv(spark, f"{tmp_path}/o", columns=2)) == [("b", ""), ("é,x", "1")] or rows(csv.read_csv(spark, f"{tmp_path}/o", columns=2)) == [("b", None), ("é,x", "1")]
    (tmp_path / "big.csv").write_bytes(b"a,1\nb,2\n" * 1000)
    assert csv.read_csv(spark, f"{tmp_path}/big.csv", split=True).count() == 2000 and csv.sniffed_encoding(spark, f"{tmp_path}/big.csv") == "UTF-8"


def test_charts_of_workbooks_and_slides(spark):
    pts = lambda kind, *vs: f"<c:{kind}Ref><c:{kind}Cache>" + "".join(f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>' for i, v in enumerate(vs)) + f"</c:{kind}Cache></c:{kind}Ref>"
    space = lambda body, title="": f'<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><c:chart>{title}<c:plotArea>{body}</c:plotArea></c:chart></c:chartSpace>'
    ser = lambda name, body: f"<c:ser><c:tx>{name}</c:tx>{body}</c:ser>"
    bars = space(f'<c:layout/><c:barChart><c:barDir val="bar"/><c:grouping val="stacked"/>{ser(pts("str", "one"), "<c:cat>" + pts("str", "a", "b") + "</c:cat><c:val>" + pts("num", "1", "NaN", "x", "3") + "</c:val>")}{ser("<c:v>two</c:v>", "")}</c:barChart>', "<c:title><c:tx><c:rich><a:p><a:r><a:t>My </a:t></a:r><a:r><a:t>chart</a:t></a:r></a:p></c:rich></c:tx></c:title>")
    dots = space(f'<c:scatterChart>{ser("", "<c:xVal>" + pts("num", "1", "2") + "</c:xVal><c:yVal><c:numLit><c:pt><c:v>5</c:v></c:pt></c:numLit></c:yVal>")}</c:scatterChart>')
    rel = lambda *items: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="http://x/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"
    names = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
    main = f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" {names}'

    def packed(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, xml in parts.items():
                z.writestr(name, xml)
        return out.getvalue()

    book = packed({
        "xl/workbook.xml": f'<workbook {main}><sheets><sheet name="S" r:id="rId1"/><sheet name="Bare" r:id="rId2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel(("rId1", "worksheet", "worksheets/s1.xml"), ("rId2", "worksheet", "worksheets/s2.xml")),
        "xl/worksheets/s1.xml": f'<worksheet {main}><sheetData/><drawing r:id="rId1"/></worksheet>', "xl/worksheets/s2.xml": f"<worksheet {main}><sheetData/></worksheet>", "xl/worksheets/_rels/s1.xml.rels": rel(("rId1", "drawing", "../drawings/d1.xml")),
        "xl/drawings/d1.xml": f'<wsDr {names}><c:chart r:id="rId2"/><c:chart r:id="rId1"/><c:chart r:id="lost"/></wsDr>', "xl/drawings/_rels/d1.xml.rels": rel(("rId1", "chart", "../charts/c1.xml"), ("rId2", "chart", "../charts/c2.xml")),
        "xl/charts/c1.xml": bars, "xl/charts/c2.xml": dots,
    })
    files = spark.createDataFrame([("b", book), ("none", None)], "name string, content binary")
    bar_rows = [("My chart", "bar", "stacked", 1, "one", 1, "a", None, 1.0), ("My chart", "bar", "stacked", 1, "one", 2, "b", None, None), ("My chart", "bar", "stacked", 1, "one", 3, None, None, 3.0), ("My chart", "bar", "stacked", 2, "two", None, None, None, None)]
    dot_rows = [(None, "scatter", "marker", 1, "", 1, None, 1.0, 5.0), (None, "scatter", "marker", 1, "", 2, None, 2.0, None)]
    assert rows(charts.workbook_charts(files, "name", "content")) == sorted([("b", "S", 1, *r) for r in dot_rows] + [("b", "S", 2, *r) for r in bar_rows], key=str)
    show = f"{SHOW} {names.split(' ', 1)[1]}"
    shown = packed({
        "ppt/presentation.xml": f'<p:presentation {SHOW}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rel(("rId1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": f'<p:sld {show}><p:cSld><p:spTree><p:graphicFrame><a:graphic><c:chart r:id="rId1"/></a:graphic></p:graphicFrame></p:spTree></p:cSld></p:sld>', "ppt/slides/_rels/slide1.xml.rels": rel(("rId1", "chart", "../charts/c1.xml")), "ppt/charts/c1.xml": bars,
    })
    decks = spark.createDataFrame([(1, shown), (2, None)], "doc long, content binary")
    assert rows(slides.records(decks, "charts", "doc")) == sorted([(1, 1, 1, *r) for r in bar_rows], key=str)
