"""CSV with a type for each value, in and out."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import general, parse_number, to_serial

BOMS = [(codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")]


def sniffed_encoding(spark: SparkSession, path: str) -> str:
    """The encoding that a file's first bytes tell, of a folder its first file's; UTF-8 without a mark. Three bytes are read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in store.globStatus(at) or []]
    files = [f for x in files for f in ([x] if x.isFile() else store.listStatus(x.getPath())) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    if not files:
        return "UTF-8"
    stream = store.open(min(files, key=lambda f: f.getPath().toString()).getPath())
    try:
        head = bytes(b for b in (stream.read() for _ in range(3)) if b >= 0)
    finally:
        stream.close()
    return next((name for mark, name in BOMS if head.startswith(mark)), "UTF-8")


def inferred(field: Column, date_format: str | None = None) -> Column:
    """A field's cell: empty is blank; then boolean, a date of the exact format, a number unless it has a leading zero; else text."""
    s = F.trim(field)
    n = F.when(~s.rlike(r"^[+-]?0\d"), parse_number(s))
    is_bool = F.lower(s).isin("true", "false")
    date = F.try_to_timestamp(s, F.lit(date_format)).cast("timestamp_ntz") if date_format else F.lit(None).cast("timestamp_ntz")
    kind = F.when(field.isNull() | (field == ""), "blank").when(is_bool, "boolean").when(date.isNotNull(), "date").when(n.isNotNull(), "number").otherwise("text")
    num = F.when(kind == "number", n).when(kind == "date", to_serial(date))
    return F.struct(kind.alias("kind"), num.alias("num"), F.when(kind == "text", field).alias("txt"), F.when(kind == "boolean", F.lower(s) == "true").alias("bool"))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str | None = None, columns: int | None = None, split: bool = False) -> DataFrame:
    """All fields as texts c1, c2, ...; a header row stays a row. Quotes are doubled inside quotes and may hold line ends.

    Such a file is one task. With split, which promises that no quote holds a line end, a large one is read in parts.
    """
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": not split, "header": False, "inferSchema": False, "encoding": encoding or sniffed_encoding(spark, path), "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "nullValue": None}
    reader = spark.read.options(**{k: v for k, v in options.items() if v is not None})
    df = reader.schema(", ".join(f"c{i} string" for i in range(1, columns + 1))).csv(path) if columns else reader.csv(path)
    return df.toDF(*[f"c{i}" for i in range(1, len(df.columns) + 1)])


def typed(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Each field as its inferred cell."""
    return df.select(*[inferred(F.col(c), date_format).alias(c) for c in df.columns])


def promoted(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns by name with a chosen type; what doesn't fit is null."""
    as_type = {"double": lambda c: parse_number(F.col(c)), "boolean": lambda c: F.when(F.lower(F.trim(F.col(c))).isin("true", "false"), F.lower(F.trim(F.col(c))) == "true"), "string": F.col}
    return df.select(*[as_type[t](c).alias(n) for c, (n, t) in zip(df.columns, types.items(), strict=True)])


def csv_field(name: str, kind: str, date_format: str | None, quote_all: bool, delimiter: str) -> Column:
    """A cell as a field: numbers with up to 15 digits, TRUE and FALSE, quoted only where it must be."""
    c = F.col(f"`{name}`")
    if kind == "boolean":
        s = F.when(c, "TRUE").when(~c, "FALSE")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        s = F.date_format(c, date_format or "yyyy-MM-dd")
    else:
        s = c if kind == "string" else general(c.cast("double"))
    s = F.coalesce(s, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    needs = F.lit(True) if quote_all else F.contains(s, F.lit(delimiter)) | s.rlike('["\r\n]')
    return F.when(needs, quoted).otherwise(s)


def csv_lines(df: DataFrame, delimiter: str = ",", date_format: str | None = None, quote_all: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(line) of each row, beside any columns to keep."""
    fields = [csv_field(c, t, date_format, quote_all, delimiter) for c, t in df.dtypes if c not in (keep or [])]
    return df.select(*(keep or []), F.concat_ws(delimiter, *fields).alias("line"))


def write_csv(df: DataFrame, path: str, line_end: str = "\r\n", encoding: str = "UTF-8", mark: bool = False, **how) -> None:
    """Part files of lines; each task writes its rows. With mark, each file begins with the mark of its encoding."""
    lines = csv_lines(df, **how)
    if mark:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        lines = lines.select(F.when(first, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line")).alias("line"))
    if encoding.upper() in ("UTF-8", "UTF8"):
        lines.write.option("lineSep", line_end).text(path)
        return
    # The text writer knows UTF-8 only; here a line is the one field of a row, and no character quotes it.
    raw = {"sep": "\x01", "quote": "\0", "escapeQuotes": False, "header": False, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.options(**raw).option("lineSep", line_end).option("encoding", encoding).csv(path)


def pasted(lines: DataFrame, delimiter: str = "\t") -> DataFrame:
    """Pasted text without quoting: (row, col, value) of each field."""
    return lines.select("row", F.posexplode(F.split("line", "\\Q" + delimiter + "\\E", -1)).alias("c", "value")).select("row", (F.col("c") + 1).alias("col"), "value")
