"""Workbooks: a reader of cells and a writer of files.

The package is a zip of XML parts; the standard library reads and writes it. Bytes come through Spark's binaryFile
source, so any store that Spark reads will do, or from any table of ids and bytes. A file is unpacked in one task, its
sheets are dealt out and parsed one by one; Arrow batches are bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import CELLS, cell_position, column_letters, filled_down

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32()]


def relationships(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id."""
    folder, name = posixpath.split(part)
    path = posixpath.join(folder, "_rels", name + ".rels")
    if path not in z.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/") for r in ElementTree.fromstring(z.read(path))}


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of the sheets, in order."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = relationships(z, "xl/workbook.xml")
    return [(s.get("name"), links[s.get(LINK)]) for s in book.iter(f"{MAIN}sheet") if s.get(LINK) in links]


def shared_strings(xml: bytes | None) -> list[str]:
    if not xml:
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(xml).iter(f"{MAIN}si")]


def cell_rows(xml: bytes, strings: list[str]) -> Iterator[tuple]:
    """(row, col, kind, num, txt, bool, err, formula, style) of each cell; a missing reference follows the one before."""
    masters: dict[str, tuple[int, int, str]] = {}
    row = col = 0
    with io.BytesIO(xml) as f:
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                if e.tag == f"{MAIN}row":
                    row, col = int(e.get("r") or row + 1), 0
                continue
            if e.tag == f"{MAIN}row":
                e.clear()
            if e.tag != f"{MAIN}c":
                continue
            row, col = cell_position(e.get("r")) if e.get("r") else (row, col + 1)
            v, kind, f_ = e.findtext(f"{MAIN}v"), e.get("t", "n"), e.find(f"{MAIN}f")
            formula = f_.text if f_ is not None else None
            if f_ is not None and f_.get("t") == "shared":
                if formula:
                    masters[f_.get("si")] = (row, col, formula)
                elif f_.get("si") in masters:
                    r, c, text = masters[f_.get("si")]
                    formula = filled_down(text, row - r, col - c)
            num = txt = flag = err = None
            if kind == "inlineStr":
                txt = "".join(t.text or "" for t in e.iter(f"{MAIN}t"))
            elif kind == "s" and v is not None:
                txt = strings[int(v)] if int(v) < len(strings) else ""
            elif kind == "str":
                txt = v or ""
            elif kind == "b":
                flag = v == "1"
            elif kind == "e":
                err = v
            elif v is not None:
                num = float(v)
            name = "text" if txt is not None else "boolean" if flag is not None else "error" if err is not None else "number" if num is not None else "blank"
            if name != "blank" or formula:
                yield row, col, name, num, txt, flag, err, formula, int(e.get("s") or 0)
            e.clear()


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Cells of all sheets (or one) of the workbooks at a path, with the file as workbook. A file that is no workbook fails."""
    return workbook_cells(spark.read.format("binaryFile").load(path), "path", "content", sheet)


def workbook_cells(files: DataFrame, id_col: str, content_col: str, sheet: str | None = None) -> DataFrame:
    """Cells of the workbooks in a table of ids and bytes: a null content has none. Sheets are parsed apart from each other."""

    def unpacked(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    strings = z.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else None
                    for own, part in sheets(z):
                        if sheet is None or own.lower() == sheet.lower():
                            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([own], pa.string()), pa.array([z.read(part)], pa.binary()), pa.array([strings], pa.binary())], names=["workbook", "sheet", "part", "strings"])

    names = [c.split()[0] for c in CELLS.split(", ")]

    def parsed(batches):
        for batch in batches:
            for book, own, part, strings in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                texts, rows = shared_strings(strings), []
                for r in cell_rows(part, texts):
                    rows.append((book, own, *r))
                    if len(rows) >= 8192:
                        yield batch_of(rows, names)
                        rows = []
                if rows:
                    yield batch_of(rows, names)

    base = files.select(F.col(f"`{id_col}`").cast("string").alias("workbook"), F.col(f"`{content_col}`").alias("content"))
    parts = base.mapInArrow(unpacked, "workbook string, sheet string, part binary, strings binary")
    return parts.repartition("workbook", "sheet").mapInArrow(parsed, CELLS)


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
OFFICE = "http://schemas.openxmlformats.org"
KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
STAMP = (1980, 1, 1, 0, 0, 0)


def clean(text: str) -> str:
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text))


def cell_xml(row: int, col: int, kind: str, num, txt, flag, err, formula, style) -> str:
    """A cell's element; a formula keeps its value beside it."""
    own = f'<c r="{column_letters(col)}{row}"' + (f' s="{style}"' if style else "")
    f = f"<f>{clean(formula)}</f>" if formula else ""
    if kind == "boolean" and flag is not None:
        return f'{own} t="b">{f}<v>{int(flag)}</v></c>'
    if kind == "number" and num is not None:
        return f"{own}>{f}<v>{num!r}</v></c>"
    if kind == "error" and err is not None:
        return f'{own} t="e">{f}<v>{clean(err)}</v></c>'
    if kind == "text" and txt is not None:
        return f'{own} t="str">{f}<v>{clean(txt)}</v></c>' if f else f'{own} t="inlineStr"><is><t xml:space="preserve">{clean(txt)}</t></is></c>'
    return f"{own}>{f}</c>" if f or style else ""


class BookWriter:
    """A package written sheet by sheet, row by row; only what is compressed is held."""

    def __init__(self, formats: dict[int, str] | None = None):
        self.out = io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.formats, self.part, self.row = formats or {}, None, None

    def put(self, name: str, text: str) -> None:
        self.zip.writestr(zipfile.ZipInfo(name, STAMP), text, zipfile.ZIP_DEFLATED)

    def sheet(self, name: str, merges: list[str] = ()) -> None:
        self.end_sheet()
        self.names.append(name)
        info = zipfile.ZipInfo(f"xl/worksheets/sheet{len(self.names)}.xml", STAMP)
        info.compress_type = zipfile.ZIP_DEFLATED
        self.part = self.zip.open(info, "w", force_zip64=True)
        self.part.write(f'{HEAD}<worksheet xmlns="{OFFICE}/spreadsheetml/2006/main"><sheetData>'.encode())

    def cell(self, row: int, xml: str) -> None:
        if row != self.row:
            self.part.write((("</row>" if self.row is not None else "") + f'<row r="{row}">').encode())
            self.row = row
        self.part.write(xml.encode())

    def end_sheet(self) -> None:
        if self.part is not None:
            self.part.write((("</row>" if self.row is not None else "") + "</sheetData></worksheet>").encode())
            self.part.close()
        self.part = self.row = None

    def finished(self) -> bytes:
        if not self.names:
            self.sheet("Sheet1")
        self.end_sheet()
        n = range(1, len(self.names) + 1)
        package = "application/vnd.openxmlformats-package"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{KINDS}.worksheet+xml"/>' for k in n)
        self.put("[Content_Types].xml", f'{HEAD}<Types xmlns="{OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="{package}.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KINDS}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KINDS}.styles+xml"/>{parts}</Types>')
        links = f"{OFFICE}/officeDocument/2006/relationships"
        self.put("_rels/.rels", f'{HEAD}<Relationships xmlns="{OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{clean(x).replace(chr(34), "&quot;")}" sheetId="{k}" r:id="rId{k}"/>' for k, x in enumerate(self.names, 1))
        self.put("xl/workbook.xml", f'{HEAD}<workbook xmlns="{OFFICE}/spreadsheetml/2006/main" xmlns:r="{links}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{k}" Type="{links}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + f'<Relationship Id="rId{len(self.names) + 1}" Type="{links}/styles" Target="styles.xml"/>'
        self.put("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{OFFICE}/package/2006/relationships">{targets}</Relationships>')
        most = max(self.formats, default=0)
        codes = "".join(f'<numFmt numFmtId="{163 + k}" formatCode="{clean(c).replace(chr(34), "&quot;")}"/>' for k, c in sorted(self.formats.items()))
        styles = "".join(f'<xf numFmtId="{163 + k if k in self.formats else 0}" fontId="0" fillId="0" borderId="0" applyNumberFormat="1"/>' for k in range(most + 1))
        self.put("xl/styles.xml", f'{HEAD}<styleSheet xmlns="{OFFICE}/spreadsheetml/2006/main"><numFmts count="{len(self.formats)}">{codes}</numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{most + 1}">{styles}</cellXfs></styleSheet>')
        self.zip.close()
        return self.out.getvalue()


def workbook_bytes(sheet: str, rows: list[list], header: list[str] | None = None) -> bytes:
    """A package with one sheet of texts, numbers and booleans."""
    book = BookWriter()
    book.sheet(sheet)
    for r, line in enumerate(([header] if header else []) + rows, 1):
        for c, v in enumerate(line, 1):
            if v is None:
                continue
            kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"
            book.cell(r, cell_xml(r, c, kind, v, v if kind == "text" else None, v, None, None, None))
    return book.finished()


def workbook_files(cells: DataFrame, formats: dict[int, str] | None = None) -> DataFrame:
    """(workbook, content): a file for each workbook, its sheets in order of their names, with formulas, values and styles.

    formats: number formats by style. A file's cells meet in one task, sorted, and go through it as a stream; the same cells
    give the same bytes.
    """
    names = [c.split()[0] for c in CELLS.split(", ")]

    def run(batches):
        book = key = sheet = None
        for batch in batches:
            for own, name, *place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if book is None or own != key:
                    if book is not None:
                        yield file_batch(key, book)
                    book, key, sheet = BookWriter(formats), own, None
                if name != sheet:
                    book.sheet(name)
                    sheet = name
                xml = cell_xml(*place)
                if xml:
                    book.cell(place[0], xml)
        if book is not None:
            yield file_batch(key, book)

    def file_batch(key, book):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([book.finished()], pa.binary())], names=["workbook", "content"])

    dealt = cells.select(*names).repartition("workbook").sortWithinPartitions("workbook", "sheet", "row", "col")
    return dealt.mapInArrow(run, "workbook string, content binary")


def saved(files: DataFrame, folder: str, name_col: str = "workbook", content_col: str = "content", suffix: str = ".xlsx") -> DataFrame:
    """Writes each row's bytes to a file of its name in a folder (file, hdfs, s3 or gs); gives (name, bytes). Files get their names when they are whole."""

    def run(batches):
        import uuid

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = re.sub(r"[^\w.-]", "_", str(name)) + suffix
                temp = posixpath.join(path, f".{file}.{uuid.uuid4().hex}.tmp")
                with store.open_output_stream(temp) as out:
                    out.write(content or b"")
                store.move(temp, posixpath.join(path, file))
                names.append(file)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return files.select(F.col(name_col).cast("string"), content_col).mapInArrow(run, "file string, bytes long")
