"""Charts as they are stored in workbooks and presentations: a row for each point of each series."""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark.sql import DataFrame

from .workbook import LINK, relationships, sheets

DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
SHEET_DRAWING = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}drawing"

# The kinds of charts, with the element that tells the style and the style where it is missing.
KINDS = {
    "barChart": ("grouping", "clustered"), "lineChart": ("grouping", "standard"), "areaChart": ("grouping", "standard"), "pieChart": (None, None), "doughnutChart": (None, None),
    "scatterChart": ("scatterStyle", "marker"), "radarChart": ("radarStyle", "standard"), "bubbleChart": (None, None),
}

#: The columns of a chart's points.
POINTS = "title string, kind string, style string, series long, name string, seq long, category string, x double, value double"
TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64()]


def option(e: Element, name: str, default: str | None) -> str | None:
    found = e.find(f"{CHART}{name}")
    return default if found is None else found.get("val", default)


def stored(holder: Element | None, *kinds: str) -> list[str]:
    """Texts of the points that a reference has cached, or of literal ones, in the order in which they stand."""
    for kind in kinds if holder is not None else ():
        for path in (f"{CHART}{kind}Lit", f"{CHART}{kind}Ref/{CHART}{kind}Cache"):
            points = holder.find(path)
            if points is not None:
                return [p.findtext(f"{CHART}v") or "" for p in points.iterfind(f"{CHART}pt")]
    return []


def numbers(holder: Element | None) -> list[float]:
    """The points that are numbers; others leave no gap."""
    found = []
    for text in stored(holder, "num"):
        try:
            found.append(float(text.strip()))
        except ValueError:
            continue
    return found


def text_of(holder: Element | None) -> str:
    """A name: direct, literal or cached; of rich text all runs."""
    if holder is None:
        return ""
    rich = holder.find(f"{CHART}rich")
    if rich is not None:
        return "".join(t.text or "" for t in rich.iter(f"{DRAW}t"))
    return holder.findtext(f"{CHART}v") or next(iter(stored(holder, "str")), "")


def chart_rows(space: Element) -> Iterator[tuple]:
    """POINTS of the first kind of chart in a chart part: categories are those of its first series.

    A chart without a title has a null one. A value that isn't finite is null; a series without points is one row without a place.
    """
    chart = space.find(f"{CHART}chart")
    plots = [] if chart is None else [p for p in chart.iterfind(f"{CHART}plotArea/*") if p.tag.removeprefix(CHART) in KINDS]
    if not plots:
        return
    title, plot = chart.find(f"{CHART}title"), plots[0]
    name = None if title is None else text_of(title.find(f"{CHART}tx"))
    tag = plot.tag.removeprefix(CHART)
    told, usual = KINDS[tag]
    kind = "column" if tag == "barChart" and option(plot, "barDir", "col") != "bar" else tag.removesuffix("Chart")
    style = option(plot, told, usual) if told else None
    categories: list[str] = []
    for k, series in enumerate(plot.iterfind(f"{CHART}ser")):
        if k == 0:
            categories = stored(series.find(f"{CHART}cat"), "str", "num")
        values = series.find(f"{CHART}val")
        ys, xs = numbers(series.find(f"{CHART}yVal") if values is None else values), numbers(series.find(f"{CHART}xVal"))
        at = lambda held, n: held[n] if n < len(held) else None
        finite = lambda v: v if v is not None and math.isfinite(v) else None
        head = (name, kind, style, k + 1, text_of(series.find(f"{CHART}tx")))
        for n in range(max(len(ys), len(xs))):
            yield (*head, n + 1, at(categories, n), finite(at(xs, n)), finite(at(ys, n)))
        if not ys and not xs:
            yield (*head, None, None, None, None)


def charts_in(z: zipfile.ZipFile, part: str, tree: Element) -> Iterator[tuple]:
    """Points of the charts that a drawing or a slide shows, numbered from 1 as they stand there."""
    links, names = relationships(z, part), set(z.namelist())
    shown = [links.get(e.get(LINK)) for e in tree.iter(f"{CHART}chart")]
    for n, target in enumerate((t for t in shown if t in names), 1):
        for row in chart_rows(ElementTree.fromstring(z.read(target))):
            yield (n, *row)


def sheet_charts(z: zipfile.ZipFile) -> Iterator[tuple]:
    """Sheet, chart and points of each chart of a workbook."""
    for sheet, part in sheets(z):
        links = relationships(z, part)
        for e in ElementTree.fromstring(z.read(part)).iter(SHEET_DRAWING):
            drawing = links.get(e.get(LINK))
            if drawing in z.namelist():
                for row in charts_in(z, drawing, ElementTree.fromstring(z.read(drawing))):
                    yield (sheet, *row)


def workbook_charts(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Points of the charts of the workbooks in a table of ids and bytes, which must be workbooks; a null content has none."""
    types = [pa.string(), pa.string(), pa.int64(), *TYPES]
    names = ["workbook", "sheet", "chart", *(c.split()[0] for c in POINTS.split(", "))]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if content is None:
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(name, *r) for r in sheet_charts(z)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    one = files.selectExpr(f"cast(`{id_col}` as string) as workbook", f"`{content_col}` as content")
    return one.mapInArrow(run, f"workbook string, sheet string, chart long, {POINTS}")
