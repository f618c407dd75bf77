"""Document transforms on tables of texts, pages and records."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..shared import join_hot, left_join_hot, running, written
from .orderstats import join_groups, without_groups

LINE_GAP, WORD_GAP = 2.0, 1.0


def find_replace(df: DataFrame, column: str, old: str, new: str, count: str = "replacements") -> DataFrame:
    """Replaces a literal in one pass and counts it; null stays null with count 0."""
    c = F.col(f"`{column}`")
    n = F.coalesce(((F.length(c) - F.length(F.replace(c, F.lit(old)))) / len(old)).cast("long"), F.lit(0).cast("long")) if old else F.lit(0).cast("long")
    changed = F.replace(c, F.lit(old), F.lit(new)) if old else c
    return df.select(*[changed.alias(x) if x == column else F.col(f"`{x}`") for x in df.columns], n.alias(count))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, filled greedily; a longer word has a line of its own. An array.

    One pass gives each word the length of its line so far; where that begins anew a line begins, so no array is copied.
    """

    def lines(line: Column) -> Column:
        words = F.array_remove(F.split(line, " +"), "")
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("begins"), F.lit(0).alias("i"))

        def add(acc: Column, word: Column) -> Column:
            n = F.length(word)
            fits = (acc["i"] > 0) & (acc["used"] + 1 + n <= width)
            grown = F.struct((acc["used"] + 1 + n).alias("used"), acc["begins"].alias("begins"), (acc["i"] + 1).alias("i"))
            fresh = F.struct(n.alias("used"), F.concat(acc["begins"], F.array(acc["i"])).alias("begins"), (acc["i"] + 1).alias("i"))
            return F.when(fits, grown).otherwise(fresh)

        cut = lambda acc: F.transform(acc["begins"], lambda b, k: F.array_join(F.slice(words, b + 1, F.coalesce(F.get(acc["begins"], k + 1), acc["i"]) - b), " "))
        return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(F.aggregate(words, start, add, cut))

    return F.flatten(F.transform(F.split(text, "\r?\n"), lines))


def paginated(df: DataFrame, id_col: str, text_col: str, width: int, lines_per_page: int) -> DataFrame:
    """(id, page, line, text): wrapped lines in pages of a fixed number of lines, both from 1."""
    lines = df.select(F.col(id_col), F.posexplode(wrapped(F.coalesce(F.col(text_col), F.lit("")), width)).alias("i", "text"))
    return lines.select(id_col, (F.floor(F.col("i") / lines_per_page) + 1).cast("long").alias("page"), (F.col("i") % lines_per_page + 1).cast("long").alias("line"), "text")


def rows_per_page(usable: float, title: float, header: float, row: float) -> int:
    return max(1, int((usable - title - header) // row))


def paged_rows(df: DataFrame, by: list[str], order: list[Column], per_page: int) -> DataFrame:
    """Adds the page of each row of a report within its group."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("page", F.floor((n - 1) / per_page).cast("long") + 1)


def column_widths(df: DataFrame, usable: float, unit: float = 1.0) -> DataFrame:
    """One row: each column's widest text, scaled so that all fill the usable width."""
    widest = df.agg(*[(F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))) * unit).alias(c) for c in df.columns])
    whole = sum((F.col(f"`{c}`") for c in df.columns), F.lit(0.0))
    return widest.select(*[(F.col(f"`{c}`") * F.lit(usable) / whole).alias(c) for c in df.columns])


def duplicates(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """(id, digest, canonical): the smallest id with the same SHA-256; null data have none. A digest that many rows share is no hot key."""
    marked = df.select(F.col(id_col).alias("id"), F.sha2(data.cast("binary"), 256).alias("digest"))
    first = written(marked.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("canonical"), F.count("*").alias("n")), "digests")
    found = join_hot(marked, first.select("digest", "canonical"), "digest", first.select("digest", "n")).select("id", "digest", "canonical")
    return found.unionByName(marked.filter("digest is null").select("id", "digest", F.col("id").alias("canonical")))


def deduplicated(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """One row for each distinct content: that with the smallest id."""
    d = duplicates(df, id_col, data).filter("id = canonical").select(F.col("id").alias("__keep"))
    return df.join(d, F.col(id_col) == F.col("__keep"), "left_semi")


def likely_duplicates(df: DataFrame, id_col: str, data: Column) -> DataFrame:
    """(id, key, canonical): the smallest id with the same length and the same first and last 64 bytes. Contents that differ only between those fall together; duplicates() doesn't take that chance."""
    b = data.cast("binary")
    tail = F.when(F.length(b) > 128, F.substring(b, -64, 64)).otherwise(F.lit(b""))
    key = F.concat(F.length(b).cast("string"), F.lit(":"), F.base64(F.substring(b, 1, 64)), F.base64(tail))
    marked = df.select(F.col(id_col).alias("id"), key.alias("key"))
    first = written(marked.filter("key is not null").groupBy("key").agg(F.min("id").alias("canonical"), F.count("*").alias("n")), "likely")
    found = join_hot(marked, first.select("key", "canonical"), "key", first.select("key", "n")).select("id", "key", "canonical")
    return found.unionByName(marked.filter("key is null").select("id", "key", F.col("id").alias("canonical")))


def interned(df: DataFrame, columns: list[str], pos: str, name: str = "style") -> tuple[DataFrame, DataFrame]:
    """The rows with a number for each combination of columns, and the combinations by number: from 0, in the order first seen."""
    key = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    seen = df.groupBy(*columns).agg(F.min(pos).alias("__first"), F.count("*").alias("__n"))
    numbered = written(running(seen, [F.col("__first")], {name: F.lit(1).cast("long")}, "styles").withColumn("__style", key), "styles")
    rows = join_hot(df.withColumn("__style", key), numbered.select("__style", name), "__style", numbered.select("__style", F.col("__n").alias("n")))
    return rows.drop("__style"), numbered.select(name, *columns)


def found_by_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """The rows whose name is a key, without regard to case."""
    return df.filter(F.lower(F.col(f"`{column}`")) == key.lower())


# Annotations as exchanged forms data: (by, page, subtype, x, y, width, height, contents, color).
XFDF = "http://ns.adobe.com/xfdf/"
ANNOTATION = "page long, subtype string, x double, y double, width double, height double, contents string, color array<double>"


def xfdf(annotations: DataFrame, by: str) -> DataFrame:
    """(by, xml): one document of annotations each; pages count from 0 there, a rectangle is its corners, a color in hex."""
    from ..functions.values import general

    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    rect = F.concat_ws(",", general(F.col("x")), general(F.col("y")), general(F.col("x") + F.col("width")), general(F.col("y") + F.col("height")))
    byte = lambda c: F.lpad(F.hex(F.floor(c * 255).cast("long")), 2, "0")
    color = F.when(F.size("color") == 3, F.concat(F.lit(' color="#'), F.array_join(F.transform("color", byte), ""), F.lit('"'))).otherwise("")
    tag = F.lower("subtype")
    inner = F.when(F.coalesce("contents", F.lit("")) != "", F.concat(F.lit("<contents>"), safe(F.col("contents")), F.lit("</contents>"))).otherwise("")
    one = F.concat(F.lit("<"), tag, F.lit(' page="'), (F.col("page") - 1).cast("string"), F.lit('" rect="'), rect, F.lit('"'), F.coalesce(color, F.lit("")), F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))
    each = F.array_sort(F.collect_list(F.struct("page", F.coalesce(F.col("seq") if "seq" in annotations.columns else F.lit(0), F.lit(0)).alias("seq"), one.alias("x"))))  # a document's annotations
    body = F.array_join(F.transform(each, lambda a: a["x"]), "")
    return annotations.groupBy(by).agg(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="{XFDF}" xml:space="preserve"><annots>'), body, F.lit("</annots></xfdf>")).alias("xml"))


def from_xfdf(files: DataFrame, by: str, xml_col: str = "xml") -> DataFrame:
    """(by, page, subtype, ...): the annotations of such documents; one without a page or a rectangle goes, an unknown kind is a note."""
    names = {"text": "Text", "highlight": "Highlight", "link": "Link", "freetext": "FreeText", "square": "Square", "circle": "Circle"}
    base = files.select(F.col(f"`{by}`"), F.col(f"`{xml_col}`").alias("__xml"))
    ddl = f"`{by}` {base.schema[0].dataType.simpleString()}, {ANNOTATION}"
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(files.sparkSession.createDataFrame([], ddl).schema)

    def run(batches):
        from xml.etree import ElementTree

        for batch in batches:
            out = []
            for key, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                annots = ElementTree.fromstring(xml.encode()).find(f"{{{XFDF}}}annots") if xml else None
                for e in annots if annots is not None else ():
                    page, rect, color = e.get("page") or "", (e.get("rect") or "").split(","), e.get("color") or ""
                    try:
                        x, y, x2, y2 = map(float, rect)
                        number = int(page) + 1
                    except ValueError:
                        continue
                    rgb = [int(color[i : i + 2], 16) / 255 for i in (1, 3, 5)] if re.fullmatch("#[0-9A-Fa-f]{6}", color) else None
                    out.append((key, number, names.get(e.tag.rsplit("}", 1)[-1], "Text"), x, y, x2 - x, y2 - y, e.findtext(f"{{{XFDF}}}contents"), rgb))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema=types)

    return base.mapInArrow(run, ddl)


def merged(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Tables one after another, each one's ids shifted past those before it; source_part names the table, from 0."""
    out = None
    for k, p in enumerate(parts):
        tagged = p.withColumn("source_part", F.lit(k))
        out = tagged if out is None else out.unionByName(tagged)
    tops = out.groupBy("source_part").agg(F.max(id_col).alias("__top"))
    shift = tops.select("source_part", F.coalesce(F.sum("__top").over(W.orderBy("source_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__shift"))
    return out.join(F.broadcast(shift), "source_part").select(*[(F.col(c) + F.col("__shift")).alias(c) if c == id_col else F.col(c) for c in parts[0].columns], "source_part")


def split_by_ranges(pages: DataFrame, page: str, ranges: list[tuple[int, int | None]]) -> DataFrame:
    """Each range of pages as a part, numbered from 1; ranges may overlap, so a page can be in several. None is the last page."""
    inside = lambda a, b: F.col(page) >= a if b is None else F.col(page).between(a, b)
    parts = F.array(*[F.when(inside(a, b), F.lit(k)) for k, (a, b) in enumerate(ranges, 1)])
    return pages.withColumn("part", F.explode(F.filter(parts, lambda p: p.isNotNull())))


def counted_pages(pages: DataFrame, by: list[str], name: str) -> DataFrame:
    """The pages with the number of their document's, found by partial counts; a document's key may be null."""
    n = written(pages.groupBy(*by).agg(F.count("*").alias(name)), "page-counts")
    return join_groups(pages, n, by) if by else pages.withColumn(name, F.lit(n.first()[0] if n.count() else 0).cast("long"))


def reordered(pages: DataFrame, page: str, order: list[int] | Column, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Pages in a new order; new_page is each one's place in its document, whose pages are numbered from 1.

    order: the page that comes first, second and so on, a permutation of 1 to n; pages past n keep their places, or with
    strict are an error, as is a document of fewer pages. Or a Column that gives each page's place, over the table's
    columns and `pages`, the number of the document's; it must give each document a permutation of its pages.
    """
    if isinstance(order, Column) or strict:
        pages = counted_pages(pages, by or [], "pages")
    if isinstance(order, Column):
        placed = pages.withColumn("new_page", order.cast("long"))
        outside = placed.filter(~F.coalesce(F.col("new_page").between(1, F.col("pages")), F.lit(False)))
        again = placed.groupBy(*(by or []), "new_page").agg(F.count("*").alias("n")).filter("n > 1")
        if not outside.isEmpty() or not again.isEmpty():
            raise ValueError("the order isn't a permutation of all pages of each document")
        return placed.drop("pages")
    if sorted(order) != list(range(1, len(order) + 1)):
        raise ValueError("the order must name each page once")
    if strict:
        if not pages.filter(F.col("pages") != len(order)).isEmpty():
            raise ValueError("the order doesn't name each page of each document")
        pages = pages.drop("pages")
    place = F.create_map(*[F.lit(x) for k, p in enumerate(order, 1) for x in (p, k)])
    return pages.withColumn("new_page", F.coalesce(F.try_element_at(place, F.col(page).cast("int")), F.col(page)).cast("long"))


def deleted(pages: DataFrame, page: str, gone: list[int], by: list[str]) -> DataFrame:
    """Without the pages named; the others are numbered anew in each document. A document can't lose all of its pages."""
    left = pages.groupBy(*by).agg(F.count_if(~F.col(page).isin(*gone)).alias("n"))
    if not left.filter("n = 0").isEmpty():
        raise ValueError("a document would lose all of its pages")
    kept = pages.filter(~F.col(page).isin(*gone))
    return kept.withColumn(page, F.row_number().over(W.partitionBy(*by).orderBy(page)).cast("long"))


def inserted(pages: DataFrame, page: str, at: int, new: DataFrame, by: list[str] | None = None) -> DataFrame:
    """New pages before page `at`, of each document or of the only one; later ones move on."""
    n = written(new.groupBy(*(by or [])).agg(F.count("*").alias("__n")), "new-pages")
    if by:
        some = join_groups(pages, n, by)
        none = without_groups(pages, n, by).withColumn("__n", F.lit(0).cast("long"))
        counted = some.unionByName(none)
    else:
        counted = pages.join(F.broadcast(n), F.lit(True), "left")
    moved = counted.withColumn(page, F.when(F.col(page) >= at, F.col(page) + F.coalesce("__n", F.lit(0))).otherwise(F.col(page))).drop("__n")
    return moved.unionByName(new.withColumn(page, F.col(page) + (at - 1)))


def places(pages: DataFrame, page: str, which: Column, to: int | Column, by: list[str]) -> DataFrame:
    """The pages with __was, where in its document the page meant lies (null: there is none), and __to, where it goes."""
    meant = F.when(which, F.col(page))
    counts = written(pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count(meant).alias("__meant"), F.min(meant).alias("__was")), "page-places")
    counts = counts.withColumn("__to", F.when(F.col("__was").isNotNull(), (to if isinstance(to, Column) else F.lit(to)).cast("long")))
    if not counts.filter("__meant > 1").isEmpty():
        raise ValueError("at most one page of a document can be meant")
    return join_groups(pages.drop("pages"), counts.drop("__meant"), by)


def moved(pages: DataFrame, page: str, which: Column, to: int | Column, by: list[str]) -> DataFrame:
    """The page of each document for which `which` holds goes to place `to`, and those between move by one.

    Pages are numbered from 1; `to` may be a Column over `pages`, the number of the document's, so that F.col("pages") is
    the last place (the front of a drawing order) and 1 the first (its back). A document of which no page is meant stays as
    it is; one with two, or a place outside a document, is an error.
    """
    at = places(pages, page, which, to, by)
    if not at.filter(~F.coalesce(F.col("__to").between(1, F.col("pages")), F.col("__was").isNull())).isEmpty():
        raise ValueError("the place lies outside a document")
    p, was, goal = F.col(page), F.col("__was"), F.col("__to")
    place = F.when(p == was, goal).when((p > was) & (p <= goal), p - 1).when((p < was) & (p >= goal), p + 1).otherwise(p)
    return at.select(*[place.cast(pages.schema[c].dataType).alias(c) if c == page else F.col(f"`{c}`") for c in pages.columns])


def cloned(pages: DataFrame, page: str, which: Column, by: list[str], to: int | Column | None = None) -> DataFrame:
    """A copy of the page of each document for which `which` holds, at place `to` (null: after the last); later ones move on.

    `to` is as for moved(), and may be one past the last page.
    """
    at = places(pages, page, which, F.col("pages") + 1 if to is None else to, by)
    if not at.filter(~F.coalesce(F.col("__to").between(1, F.col("pages") + 1), F.col("__was").isNull())).isEmpty():
        raise ValueError("the place lies outside a document")
    p, goal = F.col(page), F.col("__to")
    kept = F.array(F.when(p >= goal, p + 1).otherwise(p))
    every = at.withColumn("__place", F.explode(F.when(p == F.col("__was"), F.concat(kept, F.array(goal))).otherwise(kept)))
    return every.select(*[F.col("__place").cast(pages.schema[c].dataType).alias(c) if c == page else F.col(f"`{c}`") for c in pages.columns])


def inherited(df: DataFrame, levels: list[tuple[DataFrame, str, str]], columns: list[str]) -> DataFrame:
    """Columns that are null take the value of the nearest level above that has one: own, layout, master.

    A level: its table, the key's name in it, unique, and the column that names it: the table's own or one of the level
    before. A row whose level is null or missing inherits nothing from there on.
    """
    found, step = df, dict(zip(df.columns, df.columns))
    for k, (table, key, link) in enumerate(levels):
        names = {c: f"__level{k}_{c}" for c in table.columns if c != key}
        level = table.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("__level_key"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        found = left_join_hot(found, F.col(f"`{step[link]}`"), level, "__level_key")
        step = names
    given = lambda c: [F.col(f"`__level{k}_{c}`") for k, (t, key, _) in enumerate(levels) if c in t.columns and c != key]
    return found.select(*[F.coalesce(F.col(f"`{c}`"), *given(c)).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def rotated(rotation: Column, degrees: int, relative: bool = True) -> Column:
    """A page's rotation after turning it; only by quarter turns."""
    if degrees % 90:
        raise ValueError("pages turn by multiples of 90 degrees")
    return F.pmod(F.coalesce(rotation, F.lit(0)) + degrees, F.lit(360)) if relative else F.lit(degrees % 360)


def page_numbers(spec: str, last: int) -> list[int]:
    """'1-3,5' as sorted distinct pages inside the document."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        first, final = int(a), int(b or a)
        if not 1 <= first <= final <= last:
            raise ValueError(f"{part} isn't inside 1 to {last}")
        out.update(range(first, final + 1))
    return sorted(out)


def in_regions(ops: DataFrame, regions: DataFrame, keep: bool = False, by: list[str] | None = None) -> DataFrame:
    """Operators whose origin is in none (or, to report them, in one) of the rectangles of its document's page.

    by: the columns that name the document in both tables; a rectangle of one document touches no other. An equi-join by
    document and page.
    """
    keys = [*(by or []), "page"]
    r = regions.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in [*keys, "x", "y", "width", "height"]])
    inside = F.col("x").between(F.col("__x"), F.col("__x") + F.col("__width")) & F.col("y").between(F.col("__y"), F.col("__y") + F.col("__height"))
    for c in keys:
        inside = inside & (F.col(f"`{c}`") == F.col(f"__{c}"))
    return ops.join(r, inside, "left_semi" if keep else "left_anti")


def stamped(ops: DataFrame, text: str, x: float, y: float, pages: DataFrame, by: list[str], below: bool = False) -> DataFrame:
    """Operators with a text stamp on each of the pages given: after all others of its page, or below them. ops: by, page, seq, x, y, text."""
    stamp = pages.select(*by, "page").distinct().select(*by, "page", F.lit(-1 if below else (1 << 31) - 1).cast(ops.schema["seq"].dataType).alias("seq"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(text).alias("text"))
    return ops.select(*by, "page", "seq", "x", "y", "text").unionByName(stamp)


def roman(n: Column) -> Column:
    from ..functions.maths import roman_text

    return roman_text(n)


def alphabetic(n: Column) -> Column:
    """A to Z, then AA, BB and so on."""
    return F.repeat(F.char(F.lit(65) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def labelled(pages: DataFrame, ranges: DataFrame, index: str = "page_index", by: list[str] | None = None) -> DataFrame:
    """Adds each page's label from the range of its document that starts last before it; without one, the page number.

    ranges: start_page_index, style (D, R, r, A, a or null), prefix, first_label_number, and the document's columns `by`.
    For one document an as-of join without pairs; for several, each page searches its document's ranges.
    """
    from .lookup import match_ordered

    cols = {"__start": "start_page_index", "__style": "style", "__prefix": "prefix", "__first": "first_label_number"}
    if by:
        each = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in cols.items()])))  # a document's ranges
        starts = written(ranges.groupBy(*by).agg(each.alias("__ranges")), "label-ranges")
        with_ranges = join_groups(pages, starts, by).unionByName(without_groups(pages, starts, by).withColumn("__ranges", F.lit(None).cast(starts.schema["__ranges"].dataType)))
        own = F.filter("__ranges", lambda r: r["__start"] <= F.col(index))
        found = with_ranges.withColumn("__own", F.try_element_at(own, F.lit(-1))).select(*[F.col(f"`{c}`") for c in pages.columns], "__own.*")
    else:
        found = match_ordered(pages, index, ranges, "start_page_index", "start_page_index", cols)
    n = (F.col(index) - F.col("__start") + F.col("__first")).cast("int")
    s = F.col("__style")
    body = F.when(s == "D", n.cast("string")).when(s == "R", roman(n)).when(s == "r", F.lower(roman(n))).when(s == "A", alphabetic(n)).when(s == "a", F.lower(alphabetic(n))).otherwise("")
    label = F.when(F.col("__start").isNull(), (F.col(index) + 1).cast("string")).otherwise(F.concat(F.coalesce(F.col("__prefix"), F.lit("")), body))
    return found.select(*[F.col(f"`{c}`") for c in pages.columns], label.alias("label"))


def page_text(spans: DataFrame, by: list[str]) -> DataFrame:
    """Text of each page from its spans: reading order is y down, then x; a new line if y moves by more than 2, a blank
    if the gap to the span before is above 1."""
    order = W.partitionBy(*by).orderBy(F.desc("y"), F.asc("x"), F.asc("seq"))
    before_y, end = F.lag("y").over(order), F.lag(F.col("x") + F.col("width")).over(order)
    joint = F.when(before_y.isNull(), "").when(F.abs(F.col("y") - before_y) > LINE_GAP, "\n").when(F.col("x") - end > WORD_GAP, " ").otherwise("")
    pieces = spans.select(*by, F.row_number().over(order).alias("n"), F.concat(joint, F.col("text")).alias("piece"))
    return pieces.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda s: s["piece"]), "").alias("text"))


def filled(fields: DataFrame, values: dict[str, str], name: str = "name", value: str = "value") -> DataFrame:
    """Form fields with new values by full name; unknown names are left out."""
    if not values:
        return fields
    new = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return fields.withColumn(value, F.coalesce(F.try_element_at(new, F.col(name)), F.col(value)))


def with_authors(comments: DataFrame, authors: DataFrame) -> DataFrame:
    """Comments whose author is known, with the name."""
    return comments.join(authors.select("author_id", F.col("name").alias("author")), "author_id")


def tree_paths(edges: DataFrame, root: str = "0", by: list[str] | None = None) -> DataFrame:
    """(by, id, parent, depth, path) of an adjacency list (by, parent, id, ord) from a root, however deep.

    One join for each level, and a table. A node that is met again, by a cycle or from a second parent, keeps its first
    place: that of the least depth, then of the first path.
    """
    by = by or []
    e = written(edges.select(*by, F.col("parent").cast("string"), F.col("id").cast("string"), F.format_string("%06d", F.col("ord").cast("long")).alias("ord")), "tree-edges")
    first = lambda df: df.groupBy(*by, "id").agg(F.min(F.struct("path", "parent")).alias("m")).select(*by, "id", "m.parent", "m.path")
    level = written(first(e.filter(F.col("parent") == root).withColumn("path", F.col("ord"))).withColumn("depth", F.lit(1)), "tree-level")
    out, depth = level, 1
    while not level.isEmpty():
        depth += 1
        up = level.select(*[F.col(f"`{b}`").alias(f"__{i}") for i, b in enumerate(by)], F.col("id").alias("__id"), F.col("path").alias("__path"))
        same = F.col("parent") == F.col("__id")
        for i, b in enumerate(by):
            same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"__{i}"))
        down = first(e.join(up, same).withColumn("path", F.concat(F.col("__path"), F.lit("/"), F.col("ord"))))
        seen = out.select(*[F.col(f"`{b}`").alias(f"__{i}") for i, b in enumerate(by)], F.col("id").alias("__id"))
        met = F.col("id") == F.col("__id")
        for i, b in enumerate(by):
            met = met & F.col(f"`{b}`").eqNullSafe(F.col(f"__{i}"))
        level = written(down.filter(F.col("id") != root).join(seen, met, "left_anti").withColumn("depth", F.lit(depth)), "tree-level")
        out = out.unionByName(level)
    return out.select(*by, "id", "parent", "depth", "path")


# Rules: each one is a predicate over a table of document facts.
def violations(facts: DataFrame, id_col: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(id, rule_id, severity, description) of each rule whose predicate holds: one scan for all rules."""
    found = F.array(*[F.when(broken, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(d).alias("description"))) for r, s, d, broken in rules])
    return facts.select(F.col(id_col), F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select(id_col, "v.*")


def skipped_headings(headings: DataFrame, by: list[str], order: str, level: str = "level") -> DataFrame:
    """Headings that go down by more than one level from the one before, in document order."""
    before = F.lag(level).over(W.partitionBy(*by).orderBy(order))
    return headings.withColumn("previous", F.coalesce(before, F.lit(0))).filter(F.col(level) > F.col("previous") + 1)


# Annotations and actions that archives refuse, and the standard types of structure elements.
REFUSED_ANNOTATIONS = ("Sound", "Movie", "Screen", "FileAttachment", "3D")
REFUSED_ACTIONS = ("Launch", "Sound", "Movie", "ResetForm", "ImportData", "JavaScript", "SetOCGState", "Trans", "GoTo3DView")
STRUCTURE_TYPES = (
    "Document", "Part", "Art", "Sect", "Div", "BlockQuote", "Caption", "TOC", "TOCI", "Index", "NonStruct", "Private", "H", "H1", "H2", "H3", "H4", "H5", "H6", "P", "L", "LI", "LBody",
    "Table", "TR", "TH", "TD", "THead", "TBody", "TFoot", "Span", "Quote", "Note", "Reference", "BibEntry", "Code", "Link", "Annot", "Ruby", "Warichu", "Figure", "Formula", "Form",
)


def any_of(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# Rules by id and severity over facts, a row for each document, object, page, annotation, action or
# structure element (`scope`). A predicate holds where the rule is broken; {version} and the like are the profile's.
ARCHIVE_RULES = [
    ("6.1", "error", "The file can't be read.", "scope = 'document' and not parsed"),
    ("6.1.2", "error", "The file doesn't begin with a version.", "scope = 'document' and parsed and version is null"),
    ("6.1.2", "error", "The version is above the profile's.", "scope = 'document' and version > {version}"),
    ("6.1.3", "error", "The document is encrypted.", "scope = 'document' and encrypted"),
    ("6.1.3", "error", "The file has no identifier.", "scope = 'document' and parsed and not has_id"),
    ("6.1.10", "error", "A stream uses LZW.", "scope = 'object' and uses_lzw"),
    ("6.2.2", "warning", "There is no output intent.", "scope = 'document' and parsed and not has_output_intent"),
    ("6.3.3", "error", "A font isn't embedded.", "scope = 'object' and unembedded_font"),
    ("6.4", "error", "There is a soft mask.", "{transparency} and scope = 'object' and soft_mask"),
    ("6.4", "error", "The blend mode isn't normal.", "{transparency} and scope = 'object' and blend_mode not in ('Normal', 'Compatible')"),
    ("6.4", "error", "Strokes let light through.", "{transparency} and scope = 'object' and stroke_alpha < 1"),
    ("6.4", "error", "Fills let light through.", "{transparency} and scope = 'object' and fill_alpha < 1"),
    ("6.5.3", "error", "The annotation's type isn't allowed.", f"scope = 'annotation' and subtype in ({any_of(REFUSED_ANNOTATIONS)})"),
    ("6.5.3", "error", "The annotation isn't printed.", "scope = 'annotation' and subtype <> 'Widget' and not printed"),
    ("6.5.4", "error", "A field has no appearance.", "scope = 'annotation' and subtype = 'Widget' and not has_appearance"),
    ("6.6.1", "error", "The document has additional actions.", "scope = 'document' and has_additional_actions"),
    ("6.6.2", "error", "The action isn't allowed.", f"scope = 'action' and subtype in ({any_of(REFUSED_ACTIONS)})"),
    ("6.7.2", "error", "There is no XMP metadata.", "scope = 'document' and parsed and not has_xmp"),
    ("6.7.2", "error", "The metadata isn't well-formed.", "scope = 'document' and has_xmp and not xmp_parsed"),
    ("6.7.2", "error", "The metadata doesn't name the profile's part.", "scope = 'document' and xmp_parsed and coalesce(xmp_part, '') <> '{part}'"),
    ("6.7.2", "error", "The metadata doesn't name the profile's level.", "scope = 'document' and xmp_parsed and upper(coalesce(xmp_conformance, '')) <> '{level}'"),
    ("6.8", "error", "There are attachments.", "{attachments} and scope = 'document' and has_attachments"),
    ("6.8", "error", "The document is a collection.", "scope = 'document' and is_collection"),
]
ACCESS_RULES = [
    ("7.1", "error", "The file can't be read.", "scope = 'document' and not parsed"),
    ("7.1", "error", "The file names no version from 1.4 on.", "scope = 'document' and parsed and coalesce(version, 0) < 1.4"),
    ("7.2", "error", "The document says nothing of marks.", "scope = 'document' and parsed and not has_mark_info"),
    ("7.2", "error", "The document isn't marked.", "scope = 'document' and has_mark_info and not marked"),
    ("7.3", "error", "The title isn't shown.", "scope = 'document' and parsed and not shows_title"),
    ("7.3", "warning", "There is no title.", "scope = 'document' and parsed and not has_title"),
    ("7.4", "error", "There is no language.", "scope = 'document' and parsed and trim(coalesce(lang, '')) = ''"),
    ("7.5", "error", "There is no structure tree.", "scope = 'document' and parsed and not has_structure"),
    ("7.5", "error", "The structure has no parent tree.", "scope = 'document' and has_structure and not has_parent_tree"),
    ("7.5", "error", "The structure is empty.", "scope = 'document' and has_structure and not has_elements"),
    ("7.6", "error", "A role maps to no name.", "scope = 'role' and subtype is null"),
    ("7.6", "warning", "A role maps to a type that isn't standard.", f"scope = 'role' and subtype not in ({any_of(STRUCTURE_TYPES)})"),
    ("7.7", "error", "A figure has no alternate text.", "scope = 'element' and subtype in ('Figure', 'Formula', 'Form') and not has_alternate"),
    ("7.7", "warning", "A field has no name for readers.", "scope = 'annotation' and subtype = 'Widget' and not has_tooltip"),
    ("7.8", "warning", "A heading's level is skipped.", "scope = 'element' and level > previous_level + 1"),
    ("7.9", "warning", "A table has no row.", "scope = 'element' and subtype = 'Table' and not array_contains(kids, 'TR')"),
    ("7.10", "warning", "A list's item has no body.", "scope = 'element' and subtype = 'LI' and in_list and not array_contains(kids, 'LBody')"),
    ("7.11", "error", "A page's content isn't marked.", "scope = 'page' and draws and not has_marks"),
    ("7.13", "warning", "An annotation can't be described.", "scope = 'annotation' and subtype not in ('Popup', 'Link') and not has_contents and not has_tooltip"),
    ("7.13", "warning", "The page of an annotation has no tab order.", "scope = 'annotation' and not page_has_tabs"),
    ("7.14", "warning", "The document has additional actions.", "scope = 'document' and has_additional_actions"),
    ("7.14", "error", "The document opens with a script.", "scope = 'document' and open_action = 'JavaScript'"),
    ("7.17", "error", "There is no XMP metadata.", "scope = 'document' and parsed and not has_xmp"),
    ("7.17", "error", "The metadata doesn't name the standard.", "scope = 'document' and has_xmp and not xmp_names_access"),
    ("7.17", "error", "The metadata's part isn't 1.", "scope = 'document' and xmp_names_access and not xmp_access_part"),
]
# What the profiles ask for.
PROFILES = {
    "A1B": {"version": "1.4", "part": "1", "level": "B", "transparency": "true", "attachments": "true"},
    "A1A": {"version": "1.4", "part": "1", "level": "A", "transparency": "true", "attachments": "true"},
    "A2B": {"version": "1.7", "part": "2", "level": "B", "transparency": "false", "attachments": "true"},
    "A2U": {"version": "1.7", "part": "2", "level": "A", "transparency": "false", "attachments": "true"},
    "A3B": {"version": "1.7", "part": "3", "level": "B", "transparency": "false", "attachments": "false"},
}


#: Types of the facts that are no truth.
FACT_TYPES = {"scope": "string", "subtype": "string", "version": "double", "lang": "string", "blend_mode": "string", "stroke_alpha": "double", "fill_alpha": "double", "xmp_part": "string", "xmp_conformance": "string", "open_action": "string", "level": "int", "previous_level": "int", "kids": "array<string>"}
# What a fact is taken from where a table doesn't have it.
DERIVED = {"scope": "'document'", "parsed": "true", "has_title": "title is not null and title <> ''", "has_mark_info": "marked is not null", "printed": "(flags & 4) <> 0"}
FACT = re.compile(r"'[^']*'|\b(?:and|or|not|is|null|in|coalesce|trim|upper|array_contains|true|false)\b|([a-z_]+)")


def conformance(facts: DataFrame, id_col: str, rules: list[tuple[str, str, str, str]], profile: str = "A1B") -> DataFrame:
    """Violations of the rules that are given, in one scan. A fact that is null, or that the table doesn't have, breaks no rule."""
    asked = PROFILES[profile]
    filled = [(r, s, d, re.sub(r"\{(\w+)\}", lambda m: asked[m[1]], p)) for r, s, d, p in rules]
    have = set(facts.columns)
    for name in sorted({m[1] for *_, p in filled for m in FACT.finditer(p) if m[1]} - have):
        source = DERIVED.get(name, "null")
        known = all(m[1] in have for m in FACT.finditer(source) if m[1])
        facts = facts.withColumn(name, F.expr(source if known else "null").cast(FACT_TYPES.get(name, "boolean")))
    return violations(facts, id_col, [(r, s, d, F.coalesce(F.expr(p), F.lit(False))) for r, s, d, p in filled])


def ordered_violations(found: DataFrame) -> DataFrame:
    """Errors before warnings, then by rule."""
    return found.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "rule_id")
