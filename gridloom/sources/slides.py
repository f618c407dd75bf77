"""Presentations: slides, their shapes, texts and records, from PPTX and ODP packages.

A presentation is read in one task from its bytes, by way of a table of ids and bytes or Spark's binaryFile source. What it
holds becomes rows: slides, shapes, paragraphs, runs, table cells, notes, comments with their authors, sections, links,
diagram nodes, charts, transitions, animations and counts. A null or unreadable file gives no rows.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charts import POINTS, charts_in
from .workbook import LINK, relationships

DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHOW = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
SECTION = "{http://schemas.microsoft.com/office/powerpoint/2010/main}"
DIAGRAM = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
ODF = {k: "{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % k for k in ("drawing", "text", "presentation", "office", "table")}
#: The mark of the extension that lists sections.
SECTIONS = "{521415D9-36F7-43E2-AB2F-B90AF26B5E84}"
SPEEDS = {"slow": 3.0, "fast": 0.5}
ROWS = 4096


def whole(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def paragraph_text(p: Element) -> str:
    """Runs, fields and line breaks of a paragraph."""
    return "".join((e.findtext(f"{DRAW}t") or "") if e.tag in (f"{DRAW}r", f"{DRAW}fld") else "\n" if e.tag == f"{DRAW}br" else "" for e in p)


class Deck:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        mime = self.zip.read("mimetype").decode().strip() if "mimetype" in self.names else ""
        self.odp = mime.startswith("application/vnd.oasis.opendocument.presentation")

    def xml(self, part: str | None) -> Element | None:
        return ElementTree.fromstring(self.zip.read(part)) if part in self.names else None

    def linked(self, part: str, ending: str) -> list[str]:
        """Parts that a part is related to, by the last word of the relation's type."""
        folder, name = posixpath.split(part)
        path = posixpath.join(folder, "_rels", name + ".rels")
        if path not in self.names:
            return []
        return [posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/") for r in ElementTree.fromstring(self.zip.read(path)) if (r.get("Type") or "").rsplit("/", 1)[-1] == ending and r.get("TargetMode") != "External"]

    def targets(self, part: str) -> dict[str, str]:
        """Targets of links by id, outer ones as they are."""
        folder, name = posixpath.split(part)
        path = posixpath.join(folder, "_rels", name + ".rels")
        if path not in self.names:
            return {}
        return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read(path))}

    def slides(self) -> Iterator[tuple[int, int | None, str, Element]]:
        """Place, id, part and tree of each slide, in order."""
        show = self.xml("ppt/presentation.xml")
        links = relationships(self.zip, "ppt/presentation.xml")
        for k, s in enumerate((s for s in (show.iter(f"{SHOW}sldId") if show is not None else ()) if s.get(LINK) in links and links[s.get(LINK)] in self.names), 1):
            part = links[s.get(LINK)]
            yield k, whole(s.get("id")), part, self.xml(part)


def shapes_of(tree: Element, inside: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], str, Element]]:
    """Place, kind and element of each shape below a tree of shapes; those of groups have their group's place before theirs."""
    kinds = {f"{SHOW}sp": "shape", f"{SHOW}pic": "picture", f"{SHOW}graphicFrame": "frame", f"{SHOW}grpSp": "group", f"{SHOW}cxnSp": "connector"}
    n = 0
    for e in tree:
        if e.tag in kinds:
            n += 1
            yield (*inside, n), kinds[e.tag], e
            if kinds[e.tag] == "group":
                yield from shapes_of(e, (*inside, n))


def tree_of(slide: Element) -> Element:
    found = slide.find(f"{SHOW}cSld/{SHOW}spTree")
    return found if found is not None else Element("none")


def named(e: Element) -> tuple[int | None, str, Element | None]:
    """Id, name and the element of a shape's properties."""
    own = next((x for x in e.iter(f"{SHOW}cNvPr")), None)
    return (whole(own.get("id")), own.get("name") or "", own) if own is not None else (None, "", None)


def dotted(place: tuple[int, ...]) -> str:
    return ".".join(f"{p:04d}" for p in place)


def slide_rows(deck: Deck) -> Iterator[tuple]:
    if deck.odp:
        for k, page in enumerate(odp_pages(deck), 1):
            yield k, None, page.get(f"{ODF['drawing']}name") or "", False, bool(list(page.iter(f"{ODF['presentation']}notes"))), odp_text(page)
        return
    for k, number, part, slide in deck.slides():
        texts = ["\n".join(paragraph_text(p) for p in body) for place, kind, e in shapes_of(tree_of(slide)) if kind == "shape" and len(place) == 1 for body in [e.iterfind(f"{SHOW}txBody/{DRAW}p")]]
        yield k, number, (slide.find(f"{SHOW}cSld").get("name") or "") if slide.find(f"{SHOW}cSld") is not None else "", slide.get("show") in ("0", "false"), bool(deck.linked(part, "notesSlide")), "\n".join(t for t in texts if t)


def odp_pages(deck: Deck) -> list[Element]:
    tree = deck.xml("content.xml")
    return list(tree.iter(f"{ODF['drawing']}page")) if tree is not None else []


def of_tags(e: Element, *names: tuple[str, str]) -> Iterator[Element]:
    """Elements below one with any of some names, in order."""
    tags = {ODF[space] + name for space, name in names}
    return (x for x in e.iter() if x.tag in tags)


FRAMES, LINES = (("drawing", "frame"), ("drawing", "custom-shape")), (("text", "p"), ("text", "h"))


def odp_frames(page: Element) -> Iterator[list[str]]:
    for frame in of_tags(page, *FRAMES):
        yield ["".join(p.itertext()) for p in of_tags(frame, *LINES)]


def odp_text(page: Element) -> str:
    notes = {id(f) for n in page.iter(f"{ODF['presentation']}notes") for f in n.iter()}
    found = ["\n".join("".join(p.itertext()) for p in of_tags(f, *LINES)) for f in of_tags(page, *FRAMES) if id(f) not in notes]
    return "\n".join(t for t in found if t)


def shape_rows(deck: Deck) -> Iterator[tuple]:
    for k, _, _, slide in () if deck.odp else deck.slides():
        for place, kind, e in shapes_of(tree_of(slide)):
            number, name, _ = named(e)
            off, ext = next(iter(e.iter(f"{DRAW}off")), None), next(iter(e.iter(f"{DRAW}ext")), None)
            at = lambda x, key: whole(x.get(key)) if x is not None else None
            yield k, dotted(place), kind, number, name, at(off, "x"), at(off, "y"), at(ext, "cx"), at(ext, "cy")


def frames_of(slide: Element) -> Iterator[tuple[tuple[int, ...], list[Element]]]:
    """Paragraphs of every text frame: of shapes, captions, groups and table cells, in order."""
    for place, kind, e in shapes_of(tree_of(slide)):
        if kind in ("shape", "picture"):
            body = e.find(f"{SHOW}txBody")
            if body is not None:
                yield place, body.findall(f"{DRAW}p")
        elif kind == "frame":
            for r, row in enumerate(e.iter(f"{DRAW}tr"), 1):
                for c, cell in enumerate(row.iterfind(f"{DRAW}tc"), 1):
                    body = cell.find(f"{DRAW}txBody")
                    yield (*place, r, c), body.findall(f"{DRAW}p") if body is not None else []


def paragraph_rows(deck: Deck) -> Iterator[tuple]:
    if deck.odp:
        for k, page in enumerate(odp_pages(deck), 1):
            for f, lines in enumerate(odp_frames(page), 1):
                for n, line in enumerate(lines, 1):
                    yield k, dotted((f,)), n, line
        return
    for k, _, _, slide in deck.slides():
        for place, paragraphs in frames_of(slide):
            for n, p in enumerate(paragraphs, 1):
                yield k, dotted(place), n, paragraph_text(p)


def run_rows(deck: Deck) -> Iterator[tuple]:
    """Runs, which carry formats; a field is a barrier that a replacement never crosses."""
    for k, _, _, slide in () if deck.odp else deck.slides():
        for place, paragraphs in frames_of(slide):
            for n, p in enumerate(paragraphs, 1):
                for r, e in enumerate((e for e in p if e.tag in (f"{DRAW}r", f"{DRAW}fld")), 1):
                    own = e.find(f"{DRAW}rPr")
                    yield k, dotted(place), n, r, e.tag == f"{DRAW}fld", e.findtext(f"{DRAW}t") or "", dict(own.attrib) if own is not None else {}


def table_rows(deck: Deck) -> Iterator[tuple]:
    for k, _, _, slide in () if deck.odp else deck.slides():
        for place, kind, e in shapes_of(tree_of(slide)):
            for r, row in enumerate(e.iter(f"{DRAW}tr"), 1) if kind == "frame" else ():
                for c, cell in enumerate(row.iterfind(f"{DRAW}tc"), 1):
                    text = "\n".join(paragraph_text(p) for p in cell.iterfind(f"{DRAW}txBody/{DRAW}p"))
                    yield k, dotted(place), r, c, whole(cell.get("rowSpan")) or 1, whole(cell.get("gridSpan")) or 1, cell.get("hMerge") in ("1", "true") or cell.get("vMerge") in ("1", "true"), text


def note_rows(deck: Deck) -> Iterator[tuple]:
    if deck.odp:
        for k, page in enumerate(odp_pages(deck), 1):
            for n in page.iter(f"{ODF['presentation']}notes"):
                yield k, "\n".join("".join(p.itertext()) for p in n.iter(f"{ODF['text']}p"))
        return
    for k, _, part, _ in deck.slides():
        for notes in deck.linked(part, "notesSlide"):
            tree = deck.xml(notes)
            for sp in tree.iterfind(f"{SHOW}cSld/{SHOW}spTree/{SHOW}sp") if tree is not None else ():
                holder = sp.find(f"{SHOW}nvSpPr/{SHOW}nvPr/{SHOW}ph")
                if holder is not None and (holder.get("type") == "body" or holder.get("idx") == "1"):
                    yield k, "\n".join(paragraph_text(p) for p in sp.iterfind(f"{SHOW}txBody/{DRAW}p"))


def author_rows(deck: Deck) -> Iterator[tuple]:
    tree = deck.xml("ppt/commentAuthors.xml")
    for a in tree.iter(f"{SHOW}cmAuthor") if tree is not None else ():
        if whole(a.get("id")) is not None:
            yield whole(a.get("id")), a.get("name") or "", a.get("initials") or ""


def comment_rows(deck: Deck) -> Iterator[tuple]:
    for k, _, part, _ in () if deck.odp else deck.slides():
        for listed in deck.linked(part, "comments"):
            tree = deck.xml(listed)
            for c in tree.iter(f"{SHOW}cm") if tree is not None else ():
                author, number = whole(c.get("authorId")), whole(c.get("idx"))
                if author is not None and number is not None:
                    at = c.find(f"{SHOW}pos")
                    yield k, author, number, whole(at.get("x")) if at is not None else 0, whole(at.get("y")) if at is not None else 0, c.get("dt"), c.findtext(f"{SHOW}text") or ""


def section_rows(deck: Deck) -> Iterator[tuple]:
    show = deck.xml("ppt/presentation.xml")
    for ext in show.iterfind(f"{SHOW}extLst/{SHOW}ext") if show is not None else ():
        if (ext.get("uri") or "").upper() == SECTIONS:
            for n, s in enumerate(ext.iter(f"{SECTION}section"), 1):
                yield n, s.get("name") or "", [whole(i.get("id")) for i in s.iter(f"{SECTION}sldId") if whole(i.get("id")) is not None]
            return


def link_rows(deck: Deck) -> Iterator[tuple]:
    """What a click on a shape, also in a group, leads to."""
    for k, _, part, slide in () if deck.odp else deck.slides():
        targets = deck.targets(part)
        for place, _, e in shapes_of(tree_of(slide)):
            for holder in ("nvSpPr", "nvPicPr", "nvGraphicFramePr", "nvGrpSpPr", "nvCxnSpPr"):
                own = e.find(f"{SHOW}{holder}/{SHOW}cNvPr")
                click = own.find(f"{DRAW}hlinkClick") if own is not None else None
                if click is not None:
                    yield k, dotted(place), own.get("name") or "", targets.get(click.get(LINK)), click.get("action")


def diagram_rows(deck: Deck) -> Iterator[tuple]:
    """Edges of the nodes' trees: parent, node, order and text; the root is the point of type doc."""
    for k, _, part, _ in () if deck.odp else deck.slides():
        for n, listed in enumerate(deck.linked(part, "diagramData"), 1):
            tree = deck.xml(listed)
            points = {p.get("modelId"): p for p in tree.iter(f"{DIAGRAM}pt")} if tree is not None else {}
            for c in tree.iter(f"{DIAGRAM}cxn") if tree is not None else ():
                if c.get("type") is None and c.get("srcId") in points and c.get("destId") in points:
                    src, dest = points[c.get("srcId")], points[c.get("destId")]
                    text = "\n".join(paragraph_text(p) for p in dest.iterfind(f"{DIAGRAM}t/{DRAW}p"))
                    yield k, n, "0" if src.get("type") == "doc" else c.get("srcId"), c.get("destId"), whole(c.get("srcOrd")) or 0, text


def chart_points(deck: Deck) -> Iterator[tuple]:
    """Points of the charts on each slide."""
    for k, _, part, slide in () if deck.odp else deck.slides():
        for row in charts_in(deck.zip, part, slide):
            yield (k, *row)


def transition_rows(deck: Deck) -> Iterator[tuple]:
    for k, _, _, slide in () if deck.odp else deck.slides():
        t = next(iter(slide.iter(f"{SHOW}transition")), None)
        if t is not None:
            ms = next((whole(v) for key, v in t.attrib.items() if key.rsplit("}", 1)[-1] == "dur"), None)
            seconds = ms / 1000 if ms is not None else SPEEDS.get(t.get("spd", "med"), 0.75)
            after = whole(t.get("advTm"))
            effect = t[0].tag.rsplit("}", 1)[-1] if len(t) else None
            yield k, effect, t[0].get("dir") if len(t) else None, seconds, t.get("advClick", "1") not in ("0", "false"), after / 1000 if after is not None else None


def animation_rows(deck: Deck) -> Iterator[tuple]:
    """Effects of each sequence in order: the first is the main one, others wait for a shape."""
    for k, _, _, slide in () if deck.odp else deck.slides():
        timing = slide.find(f"{SHOW}timing")
        for s, seq in enumerate(timing.iter(f"{SHOW}seq") if timing is not None else ()):
            n = 0
            for node in seq.iter(f"{SHOW}cTn"):
                if node.get("presetID") is not None:
                    n += 1
                    target = next(iter(node.iter(f"{SHOW}spTgt")), None)
                    yield k, s, n, whole(node.get("presetID")), node.get("presetClass"), node.get("nodeType"), whole(target.get("spid")) if target is not None else None


def statistic_rows(deck: Deck) -> Iterator[tuple]:
    rows = list(slide_rows(deck))
    yield len(rows), sum(r[3] for r in rows), sum(r[4] for r in rows)


# The columns of each table.
TABLES = {
    "slides": ("slide long, id long, name string, hidden boolean, has_notes boolean, text string", slide_rows),
    "shapes": ("slide long, place string, kind string, id long, name string, x long, y long, width long, height long", shape_rows),
    "paragraphs": ("slide long, place string, seq long, text string", paragraph_rows),
    "runs": ("slide long, place string, paragraph long, seq long, field boolean, text string, format map<string,string>", run_rows),
    "tables": ("slide long, place string, row long, col long, row_span long, col_span long, hidden boolean, text string", table_rows),
    "notes": ("slide long, text string", note_rows),
    "authors": ("author_id long, name string, initials string", author_rows),
    "comments": ("slide long, author_id long, seq long, x long, y long, created string, text string", comment_rows),
    "sections": ("section long, name string, slide_ids array<long>", section_rows),
    "links": ("slide long, place string, shape string, target string, action string", link_rows),
    "diagrams": ("slide long, diagram long, parent string, id string, ord long, text string", diagram_rows),
    "charts": (f"slide long, chart long, {POINTS}", chart_points),
    "transitions": ("slide long, effect string, direction string, seconds double, on_click boolean, after double", transition_rows),
    "animations": ("slide long, sequence long, seq long, preset long, class string, trigger string, shape long", animation_rows),
    "statistics": ("slides long, hidden long, notes long", statistic_rows),
}


def read_presentations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def records(decks: DataFrame, table: str, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """One of TABLES, with the id of the presentation that each row comes from."""
    schema, rows_of = TABLES[table]
    base = decks.select(F.col(f"`{id_col}`"), F.col(f"`{content_col}`").alias("__content"))
    ddl = f"`{id_col}` {base.schema[0].dataType.simpleString()}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(decks.sparkSession.createDataFrame([], ddl).schema)

    def run(batches):
        for batch in batches:
            out = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    deck = Deck(content or b"")
                except zipfile.BadZipFile:
                    continue
                out += [(key, *row) for row in rows_of(deck)]
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return base.mapInArrow(run, ddl)


def section_slides(sections: DataFrame, slides: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, section, name, slide): the slides that each section lists, by their ids; ids of no slide go."""
    listed = sections.select(id_col, "section", "name", F.explode("slide_ids").alias("id"))
    return listed.join(slides.select(id_col, "id", "slide"), [id_col, "id"]).select(id_col, "section", "name", "slide")


def replaced_runs(runs: DataFrame, old: str, new: str, by: list[str], same_case: bool = True) -> DataFrame:
    """Runs with a text replaced, also where it goes over several runs: what takes its place has the format of its first run.

    by: the columns that name a paragraph; seq orders its runs, and no match crosses a run that is a field. Adds
    `replacements`, at the run where each match begins. One pass, so a new text may hold the old one.
    """
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    if not old:
        return runs.withColumn("replacements", F.lit(0).cast("long"))
    result = ArrayType(StructType([StructField("seq", LongType()), StructField("text", StringType()), StructField("n", LongType())]))

    @F.arrow_udf(result)
    def replace(paragraphs: pa.Array) -> pa.Array:
        return pa.array([replace_in(p, old, new, same_case) for p in paragraphs.to_pylist()], pa.list_(pa.struct([("seq", pa.int64()), ("text", pa.string()), ("n", pa.int64())])))

    each = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "field", F.coalesce("text", F.lit("")).alias("text"))))  # a paragraph's runs
    done = runs.groupBy(*by).agg(each.alias("p")).select(*[F.col(b).alias(f"__{b}") for b in by], F.explode(replace("p")).alias("r"))
    cond = F.col("seq") == F.col("r.seq")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return runs.join(done, cond).select(*[F.col("r.text").alias("text") if c == "text" else F.col(c) for c in runs.columns], F.col("r.n").alias("replacements"))


def replace_in(runs: list[dict], old: str, new: str, same_case: bool) -> list[dict]:
    out, part = [], []
    for r in [*runs, None]:
        if r is not None and not r["field"]:
            part.append(r)
            continue
        whole_text = "".join(x["text"] for x in part)
        hay, needle = (whole_text, old) if same_case else (whole_text.lower(), old.lower())
        hits, i = [], hay.find(needle)
        while i >= 0:
            hits.append(i)
            i = hay.find(needle, i + len(needle))
        at = 0
        for x in part:
            a, z, text, pos = at, at + len(x["text"]), [], at
            for h in hits:
                if h >= z or h + len(old) <= a:
                    continue
                text.append(whole_text[pos : max(pos, h)])
                text.append(new if a <= h < z else "")
                pos = min(z, h + len(old))
            text.append(whole_text[pos:z])
            out.append({"seq": x["seq"], "text": "".join(text), "n": sum(a <= h < z for h in hits)})
            at = z
        part = []
        if r is not None:
            out.append({"seq": r["seq"], "text": r["text"], "n": 0})
    return out


# Writing.
def deck_bytes(slides: list[list[str]]) -> bytes:
    """A package with a slide for each list of texts, a shape for each text, a paragraph for each of its lines."""
    from .workbook import HEAD, OFFICE, STAMP, clean

    links, package, kinds = f"{OFFICE}/officeDocument/2006/relationships", f"{OFFICE}/package/2006", "application/vnd.openxmlformats-officedocument.presentationml"
    spaces = f'xmlns:a="{DRAW[1:-1]}" xmlns:r="{links}" xmlns:p="{SHOW[1:-1]}"'
    n = range(1, len(slides) + 1)
    parts = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/ppt/presentation.xml" ContentType="{kinds}.presentation.main+xml"/>' + "".join(f'<Override PartName="/ppt/slides/slide{k}.xml" ContentType="{kinds}.slide+xml"/>' for k in n) + "</Types>",
        "_rels/.rels": f'{HEAD}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{links}/officeDocument" Target="ppt/presentation.xml"/></Relationships>',
        "ppt/presentation.xml": f"{HEAD}<p:presentation {spaces}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in n) + '</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'{HEAD}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{links}/slide" Target="slides/slide{k}.xml"/>' for k in n) + "</Relationships>",
    }
    for k, texts in zip(n, slides):
        shapes = "".join(
            f'<p:sp><p:nvSpPr><p:cNvPr id="{i + 1}" name="Text {i}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>' + "".join(f"<a:p><a:r><a:t>{clean(line)}</a:t></a:r></a:p>" for line in t.split("\n")) + "</p:txBody></p:sp>" for i, t in enumerate(texts, 1)
        )
        parts[f"ppt/slides/slide{k}.xml"] = f'{HEAD}<p:sld {spaces}><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{shapes}</p:spTree></p:cSld></p:sld>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, STAMP), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def written_decks(texts: DataFrame, by: str) -> DataFrame:
    """(by, content): a presentation each from (by, slide, seq, text), slides from 1."""
    each = texts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("slide", "seq", "text"))).alias("texts"))  # a presentation's texts

    def run(batches):
        for batch in batches:
            files = []
            for rows in batch.column(1).to_pylist():
                slides: dict[int, list[str]] = {}
                for r in rows:
                    slides.setdefault(r["slide"], []).append(r["text"] or "")
                files.append(deck_bytes([slides.get(k, []) for k in range(1, max(slides) + 1)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=[by, "content"])

    return each.mapInArrow(run, f"`{by}` {each.schema[0].dataType.simpleString()}, content binary")
