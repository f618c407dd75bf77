"""Markdown blocks, XML documents and chart JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def markdown_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq, kind, level, text) of each block that a line begins: heading, rule, list, quote, code or paragraph.

    Lines inside a fence are code; a fence's own lines give no block. Lines of a paragraph are joined.
    """
    lines = df.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\r?\n")).alias("n", "line"))
    order = W.partitionBy(id_col).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s{0,3}(```|~~~)")
    marked = lines.withColumn("fence", fence).withColumn("in_code", (F.sum(fence.cast("int")).over(order) % 2 == 1) & ~fence)
    line = F.col("line")
    kind = (
        F.when(F.col("fence"), "fence").when(F.col("in_code"), "code").when(line.rlike(r"^\s*$"), "empty").when(line.rlike(r"^#{1,6}\s"), "heading")
        .when(line.rlike(r"^\s{0,3}([-*_])(\s*\1){2,}\s*$"), "rule").when(line.rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list").when(line.rlike(r"^\s{0,3}>"), "quote").otherwise("paragraph")
    )
    typed = marked.withColumn("kind", kind)
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", "^(#+)", 1))).otherwise(0)
    body = F.when(F.col("kind") == "heading", F.regexp_replace("line", r"^#+\s+|\s+#*\s*$", "")).when(F.col("kind") == "list", F.regexp_replace("line", r"^\s*([-*+]|\d+[.)])\s+", "")).when(F.col("kind") == "quote", F.regexp_replace("line", r"^\s{0,3}>\s?", "")).when(F.col("kind") == "rule", "").otherwise(line)
    typed = typed.withColumn("level", level).withColumn("body", body)
    before = F.lag("kind").over(W.partitionBy(id_col).orderBy("n"))
    joins = F.col("kind").isin("paragraph", "code", "quote") & (before == F.col("kind"))
    typed = typed.withColumn("starts", F.coalesce(~joins, F.lit(True)).cast("int"))
    typed = typed.withColumn("seq", F.sum("starts").over(order)).filter(~F.col("kind").isin("fence", "empty"))
    text = F.array_sort(F.collect_list(F.struct("n", "body")))
    glue = F.when(F.col("kind") == "code", "\n").otherwise(" ")
    blocks = typed.groupBy(id_col, "seq", "kind", "level").agg(text.alias("parts"))
    return blocks.select(id_col, F.col("seq").cast("long"), "kind", F.col("level").cast("long"), F.aggregate(F.transform("parts", lambda p: p["body"]), F.lit(None).cast("string"), lambda a, b: F.when(a.isNull(), b).otherwise(F.concat(a, glue, b))).alias("text"))


def chart_points(df: DataFrame, category: str, series: list[str]) -> DataFrame:
    """(series, category, value): a wide range melted; values that are no finite numbers are null."""
    tall = df.select(F.col(category).alias("category"), *[F.col(s).cast("double").alias(s) for s in series]).unpivot(["category"], series, "series", "value")
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return tall.select(F.when(F.col("series") == "", "Series").otherwise(F.col("series")).alias("series"), "category", F.when(~bad, F.col("value")).alias("value"))


def chart_json(points: DataFrame, order: Column, title: str, kind: str = "line") -> DataFrame:
    """One row (json): the chart's options. A chart's points fit in one row, as they do in the document."""
    each = points.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "category", "value"))), lambda p: F.struct(p["category"].alias("name"), p["value"].alias("y"))).alias("data"))
    all_series = F.array_sort(F.collect_list(F.struct(F.col("series").alias("name"), F.lit(kind).alias("type"), "data")))
    return each.agg(F.to_json(F.struct(F.struct(F.lit(kind).alias("type")).alias("chart"), F.struct(F.lit(title).alias("text")).alias("title"), all_series.alias("series"))).alias("json"))


def document_xml(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, xml): a document of pages and paragraphs from (id, page, line, text)."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    p = F.concat(F.lit("<Paragraph>"), safe, F.lit("</Paragraph>"))
    pages = lines.groupBy(id_col, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", p.alias("p")))), lambda s: s["p"]), "").alias("body"))
    page = F.concat(F.lit("<Page>"), F.col("body"), F.lit("</Page>"))
    return pages.groupBy(id_col).agg(F.concat(F.lit("<Document>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", page.alias("x")))), lambda s: s["x"]), ""), F.lit("</Document>")).alias("xml"))


def xml_paragraphs(df: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, n, text) of the paragraphs of XML documents."""
    return df.select(id_col, F.posexplode(F.xpath(F.col(xml_col), F.lit("/Document/Page/Paragraph/text()"))).alias("n", "text"))
