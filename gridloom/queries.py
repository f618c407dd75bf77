"""The engine's queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions.numberformat import format_value
from .functions.registry import catalogue
from .operators import documents as docs
from .operators import grid, lookup, orderstats, pivot
from .plans.compiler import calculated, evaluate, summary
from .plans.lookups import Table
from .plans.recalc import recalculated
from .shared import dealt, fresh_path
from .sources import csv, pdf, slides, texts, workbook
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def put(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return put


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to a number of digits, since sums depend on their order in the last bits."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# Conditional aggregates: all formulas of a call share one scan.
@query("""SELECT round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25), 2) AS s1,
  round(coalesce(sum(l_quantity) FILTER (WHERE lower(l_linestatus) = 'o'), 0), 2) AS s2,
  round(sum(l_tax) FILTER (WHERE l_discount <> 0.05), 4) AS s3 FROM lineitem""")
def sumifs(spark, d):
    got = summary(table(spark, d, "lineitem"), {"s1": '=SUMIFS(l_extendedprice, l_returnflag, "R", l_quantity, ">25")', "s2": '=SUMIF(l_linestatus, "o", l_quantity)', "s3": '=SUMIF(l_discount, "<>0.05", l_tax)'})
    return got.select(F.round("s1", 2).alias("s1"), F.round("s2", 2).alias("s2"), F.round("s3", 4).alias("s3"))


@query("""SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity >= 10 AND l_linestatus = 'F') AS DOUBLE) AS c1,
  CAST(count(*) FILTER (WHERE l_discount = 0.1) AS DOUBLE) AS c2 FROM lineitem GROUP BY l_returnflag""")
def countifs(spark, d):
    return summary(table(spark, d, "lineitem"), {"c1": '=COUNTIFS(l_quantity, ">=10", l_linestatus, "f")', "c2": "=COUNTIF(l_discount, 0.1)"}, by=["l_returnflag"])


@query("""SELECT round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A' AND l_quantity < 5), 4) AS a1,
  CAST(NULL AS DOUBLE) AS a2, '#DIV/0!' AS a2_error, CAST(NULL AS VARCHAR) AS a1_error FROM lineitem""")
def averageifs(spark, d):
    return rounded(summary(table(spark, d, "lineitem"), {"a1": '=AVERAGEIFS(l_extendedprice, l_returnflag, "A", l_quantity, "<5")', "a2": '=AVERAGEIF(l_returnflag, "none", l_tax)'}, errors=True))


@query("""SELECT max(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS hi, min(l_extendedprice) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 40) AS lo FROM lineitem""")
def minmaxifs(spark, d):
    return summary(table(spark, d, "lineitem"), {"hi": '=MAXIFS(l_extendedprice, l_returnflag, "N")', "lo": '=MINIFS(l_extendedprice, l_returnflag, "N", l_quantity, ">40")'})


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) / count(*), 4) AS mean FROM lineitem")
def sumproduct(spark, d):
    got = summary(table(spark, d, "lineitem"), {"revenue": "=SUMPRODUCT(l_extendedprice, l_discount)", "mean": "=SUM(l_extendedprice*(1-l_discount)*(1+l_tax))/COUNT(l_tax)"})
    return got.select(F.round("revenue", 2).alias("revenue"), F.round("mean", 4).alias("mean"))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp,
  round(avg(l_quantity), 6) AS mean, CAST(count(l_quantity) AS DOUBLE) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag""")
def stats_basic(spark, d):
    f = {"sd": "STDEV", "sdp": "STDEV.P", "v": "VAR.S", "vp": "VARP", "mean": "AVERAGE", "n": "COUNT", "lo": "MIN", "hi": "MAX"}
    return rounded(summary(table(spark, d, "lineitem"), {k: f"={v}(l_quantity)" for k, v in f.items()}, by=["l_returnflag"]), 6)


@query("""SELECT round(exp(avg(ln(l_quantity))), 6) AS geo, round(count(*) / sum(1 / l_quantity), 6) AS har, round(avg(abs(l_quantity - m)), 6) AS dev, round(sum((l_quantity - m) * (l_quantity - m)), 2) AS sq,
  round(sum(l_quantity * l_quantity), 2) AS sumsq, CAST(count(*) AS DOUBLE) AS counta, 0.0::DOUBLE AS blanks FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)""")
def stats_extra(spark, d):
    got = summary(table(spark, d, "lineitem"), {"geo": "=GEOMEAN(l_quantity)", "har": "=HARMEAN(l_quantity)", "dev": "=AVEDEV(l_quantity)", "sq": "=DEVSQ(l_quantity)", "sumsq": "=SUMSQ(l_quantity)", "counta": "=COUNTA(l_returnflag)", "blanks": "=COUNTBLANK(l_tax)"})
    return got.select(*[F.round(c, 2 if c in ("sq", "sumsq") else 6).alias(c) for c in got.columns])


@query("""SELECT s AS share, round(v, 6) AS value FROM (SELECT unnest([0.1, 0.25, 0.5, 0.9]::DOUBLE[]) AS s, unnest(quantile_cont(o_totalprice, [0.1, 0.25, 0.5, 0.9])) AS v FROM orders)""")
def quantiles(spark, d):
    return rounded(orderstats.quantiles(table(spark, d, "orders").select(F.col("o_totalprice").alias("x")), [0.1, 0.25, 0.5, 0.9]), 6)


@query("""SELECT round(median(o_totalprice), 6) AS m, round(quantile_cont(o_totalprice, 0.9), 6) AS p, round(quantile_cont(o_totalprice, 0.75), 6) AS q FROM orders""")
def median_formulas(spark, d):
    return rounded(summary(table(spark, d, "orders"), {"m": "=MEDIAN(o_totalprice)", "p": "=PERCENTILE(o_totalprice, 0.9)", "q": "=QUARTILE(o_totalprice, 3)"}), 6)


@query("""SELECT round(avg(x), 4) AS value FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders)
  WHERE k > round_even(n * 0.1, 0) AND k <= n - round_even(n * 0.1, 0)""")
def trimmean(spark, d):
    return rounded(summary(table(spark, d, "orders"), {"value": "=TRIMMEAN(o_totalprice, 0.1)"}))


@query("""SELECT x AS value FROM (SELECT l_quantity AS x, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY l_quantity) WHERE n > 1 ORDER BY n DESC, p LIMIT 1""")
def mode_first_seen(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return orderstats.modal_value(x, pos="pos")


@query("SELECT o_orderkey, c_name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def vlookup_exact(spark, d):
    c = table(spark, d, "customer")
    return lookup.vlookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", c, "c_custkey", "c_custkey", {"c_name": "c_name", "segment": "c_mktsegment"}).drop("o_custkey")


@query("""SELECT c_custkey, p AS position, n_name FROM customer LEFT JOIN (SELECT n_nationkey AS k, n_nationkey + 1 AS p, n_name FROM nation) ON c_nationkey = k""")
def index_match(spark, d):
    n = table(spark, d, "nation").withColumn("pos", F.col("n_nationkey") + 1)
    at = lookup.match_position(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", n, "n_nationkey", "pos")
    return lookup.index_rows(at, "position", n, "pos", {"n_name": "n_name"}).drop("c_nationkey")


BANDS = [(1, 0.0, "low"), (2, 950.0, "mid"), (3, 1400.0, "high"), (4, 1800.0, "top")]


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BANDS, "pos int, lower double, label string")


BANDS_SQL = "(VALUES " + ", ".join(f"({p}, {x}::DOUBLE, '{s}')" for p, x, s in BANDS) + ") AS b(pos, lower, label)"


@query(f"SELECT p_partkey, label FROM part ASOF LEFT JOIN {BANDS_SQL} ON p_retailprice >= lower")
def vlookup_approx(spark, d):
    return lookup.vlookup_approx(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bands(spark), "lower", "pos", {"label": "label"}).drop("p_retailprice")


@query(f"SELECT p_partkey, (SELECT max(pos) FROM {BANDS_SQL} WHERE lower >= p_retailprice) AS position FROM part")
def match_descending(spark, d):
    return lookup.match_ordered(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", bands(spark), "lower", "pos", {"position": "pos"}, ascending=False).drop("p_retailprice")


@query(f"""SELECT p_partkey, coalesce(label, 'none') AS band, CASE WHEN label IS NULL THEN '#N/A' END AS raw_error FROM part ASOF LEFT JOIN {BANDS_SQL} ON p_retailprice - 100 >= lower""")
def formula_vlookup(spark, d):
    f = {"band": '=IFERROR(VLOOKUP(p_retailprice-100,bands,2),"none")', "raw": "=VLOOKUP(p_retailprice-100,bands,2,TRUE)"}
    return calculated(table(spark, d, "part").select("p_partkey", "p_retailprice"), f, errors=True, tables={"bands": Table(bands(spark), "pos", in_order=True)}).select("p_partkey", "band", "raw_error")


@query("""SELECT c_custkey, lower(n_name) AS nation, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def formula_index_match(spark, d):
    n = table(spark, d, "nation").withColumn("pos", F.col("n_nationkey") + 1)
    r = table(spark, d, "region").withColumn("pos", F.col("r_regionkey") + 1)
    f = {"nation": "=LOWER(INDEX(nation!n_name,MATCH(c_nationkey,nation!n_nationkey,0)))", "region": "=VLOOKUP(INDEX(nation!n_regionkey,MATCH(c_nationkey,nation!n_nationkey,0)),region!r_regionkey:r_name,2,FALSE)"}
    return calculated(table(spark, d, "customer").select("c_custkey", "c_nationkey"), f, tables={"nation": Table(n, "pos"), "region": Table(r, "pos")}).drop("c_nationkey")


@query("SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) AS rank FROM customer")
def rank_eq(spark, d):
    return orderstats.rank_rows(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal")


@query("""SELECT (SELECT c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 1 OFFSET 4) AS large5, (SELECT c_acctbal FROM customer ORDER BY c_acctbal LIMIT 1 OFFSET 2) AS small3""")
def large_small(spark, d):
    return summary(table(spark, d, "customer"), {"large5": "=LARGE(c_acctbal, 5)", "small3": "=SMALL(c_acctbal, 3)"})


@query("""SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal) - 1 + 0.5 * count(*) OVER (PARTITION BY c_acctbal)) / greatest(count(*) OVER () - 1, 1), 9) AS percent_rank FROM customer""")
def percentrank(spark, d):
    return rounded(orderstats.percent_rank_rows(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").drop("c_acctbal"), 9)


STATUSES = ["F", "O", "P"]


@query("SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS {s}" for s in STATUSES) + " FROM orders GROUP BY o_orderpriority")
def pivot_sum(spark, d):
    return rounded(pivot.pivot_grid(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", [("o_totalprice", "sum")], items=STATUSES), 2)


@query("SELECT o_orderpriority, o_orderstatus, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS level, round(sum(o_totalprice), 2) AS sum_o_totalprice, count(o_totalprice) AS count_o_totalprice FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def pivot_subtotals(spark, d):
    return rounded(pivot.with_subtotals(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], [("o_totalprice", "sum"), ("o_totalprice", "count")]), 2)


@query("SELECT 'Total' AS n_name, round(sum(c_acctbal), 2) AS c_acctbal, count(c_custkey) AS c_custkey FROM customer")
def totals_row(spark, d):
    df = table(spark, d, "customer").select(F.col("c_name").alias("n_name"), "c_acctbal", "c_custkey")
    return rounded(pivot.totals_row(df, {"c_acctbal": "sum", "c_custkey": "count"}, "n_name"), 2)


@query("SELECT o_orderpriority AS item, min(o_orderkey) AS first_pos FROM orders GROUP BY 1")
def distinct_items(spark, d):
    return pivot.distinct_items(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM orders")
def running_total(spark, d):
    return rounded(pivot.running_total(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice").drop("o_totalprice"), 2)


# Scalars as calculated columns.
@query("""SELECT c_custkey, upper(c_name) AS up, left(c_name, 3) AS l3, right(c_name, 4) AS r4, substr(c_name, 2, 5) AS mid, CAST(length(c_name) AS DOUBLE) AS n, replace(c_name, 'Customer', 'C') AS sub,
  CAST(nullif(strpos(c_name, '#'), 0) AS DOUBLE) AS hash, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS cat, repeat('ab', 3) AS rep, split_part(c_name, '#', 1) AS before, c_mktsegment = 'BUILDING' AS same FROM customer""")
def text_functions(spark, d):
    f = {"up": "=UPPER(c_name)", "l3": "=LEFT(c_name,3)", "r4": "=RIGHT(c_name,4)", "mid": "=MID(c_name,2,5)", "n": "=LEN(c_name)", "sub": '=SUBSTITUTE(c_name,"Customer","C")', "hash": '=FIND("#",c_name)', "cat": '=c_mktsegment&"-"&c_nationkey', "rep": '=REPT("ab",3)', "before": '=TEXTBEFORE(c_name,"#")', "same": '=EXACT(c_mktsegment,"BUILDING")'}
    return calculated(table(spark, d, "customer"), f).select("c_custkey", *f)


@query("""SELECT o_orderkey, floor(o_totalprice) AS i, sign(x) * floor(abs(x) * 10 + 0.5) / 10 AS r1, ceil(o_totalprice / 100) * 100 AS c100, o_totalprice - 7 * floor(o_totalprice / 7) AS m, round(sqrt(o_totalprice), 9) AS sq, round(ln(o_totalprice), 9) AS l,
  CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, trunc(o_totalprice / 1000) AS q FROM (SELECT *, o_totalprice AS x FROM orders)""")
def math_functions(spark, d):
    f = {"i": "=INT(o_totalprice)", "r1": "=ROUND(o_totalprice,1)", "c100": "=CEILING(o_totalprice,100)", "m": "=MOD(o_totalprice,7)", "sq": "=SQRT(o_totalprice)", "l": "=LN(o_totalprice)", "size": '=IF(o_totalprice>100000,"big","small")', "q": "=QUOTIENT(o_totalprice,1000)"}
    got = calculated(table(spark, d, "orders"), f).select("o_orderkey", *f)
    return got.withColumn("sq", F.round("sq", 9)).withColumn("l", F.round("l", 9))


@query("""SELECT o_orderkey, CAST(year(t) AS DOUBLE) AS y, CAST(month(t) AS DOUBLE) AS m, CAST(day(t) AS DOUBLE) AS d, CAST(dayofweek(t) + 1 AS DOUBLE) AS w, CAST(isodow(t) AS DOUBLE) AS w2, CAST(weekofyear(t) AS DOUBLE) AS iso,
  CAST(date_diff('day', DATE '1899-12-30', last_day(t)) AS DOUBLE) AS eom, CAST(date_diff('day', DATE '1899-12-30', CAST(t + INTERVAL 1 MONTH AS DATE)) AS DOUBLE) AS next, CAST(date_diff('day', t, DATE '2000-01-01') AS DOUBLE) AS days
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders)""")
def date_functions(spark, d):
    f = {"y": "=YEAR(o_orderdate)", "m": "=MONTH(o_orderdate)", "d": "=DAY(o_orderdate)", "w": "=WEEKDAY(o_orderdate)", "w2": "=WEEKDAY(o_orderdate,2)", "iso": "=ISOWEEKNUM(o_orderdate)", "eom": "=EOMONTH(o_orderdate,0)", "next": "=EDATE(o_orderdate,1)", "days": "=DAYS(DATE(2000,1,1),o_orderdate)"}
    return calculated(table(spark, d, "orders"), f).select("o_orderkey", *f)


@query("""SELECT o_orderkey, round(o_totalprice * pow(1 + r, 24) * r / (1 - pow(1 + r, 24)), 6) AS pay, round(-o_totalprice * pow(1 + r, 12), 6) AS later, round((o_totalprice - 100) / 5, 6) AS sln, round(pow(1 + 0.1 / 4, 4) - 1, 9) AS eff FROM orders, (SELECT 0.01::DOUBLE AS r)""")
def financial_functions(spark, d):
    f = {"pay": "=PMT(0.01,24,o_totalprice)", "later": "=FV(0.01,12,0,o_totalprice)", "sln": "=SLN(o_totalprice,100,5)", "eff": "=EFFECT(0.1,4)"}
    got = calculated(table(spark, d, "orders"), f).select("o_orderkey", *f)
    return got.select("o_orderkey", *[F.round(c, 9 if c == "eff" else 6).alias(c) for c in f])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 0 OR l_discount = 0 THEN -1 ELSE round(l_quantity / l_discount, 6) END AS safe, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'other' END AS flag,
  (l_quantity > 10 AND l_discount > 0.05) AS both, (l_quantity > 45 OR l_tax = 0) AS either, CASE WHEN l_discount = 0 THEN '#DIV/0!' END AS ratio_error FROM lineitem""")
def logical_functions(spark, d):
    f = {"safe": "=IFERROR(l_quantity/l_discount,-1)", "flag": '=SWITCH(l_returnflag,"a","accepted","r","returned","other")', "both": "=AND(l_quantity>10,l_discount>0.05)", "either": "=OR(l_quantity>45,l_tax=0)", "ratio": "=l_quantity/l_discount"}
    got = calculated(table(spark, d, "lineitem"), f, errors=True)
    return got.select("l_orderkey", "l_linenumber", F.round("safe", 6).alias("safe"), "flag", "both", "either", "ratio_error")


@query("""SELECT CAST(count(*) FILTER (WHERE lower(c_mktsegment) = 'building') AS DOUBLE) AS eq, CAST(count(*) FILTER (WHERE lower(c_mktsegment) <> 'building') AS DOUBLE) AS ne, CAST(count(*) FILTER (WHERE lower(c_mktsegment) > 'furniture') AS DOUBLE) AS gt FROM customer""")
def criteria_text(spark, d):
    return summary(table(spark, d, "customer"), {"eq": '=COUNTIF(c_mktsegment,"Building")', "ne": '=COUNTIF(c_mktsegment,"<>building")', "gt": '=COUNTIF(c_mktsegment,">FURNITURE")'})


@query("""SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS grouped, printf('%.2f', o_totalprice) AS fixed, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def number_formats(spark, d):
    o = table(spark, d, "orders")
    f = calculated(o, {"grouped": '=TEXT(o_totalprice,"#,##0.00")', "day": '=TEXT(o_orderdate,"yyyy-mm-dd")'})
    return f.select("o_orderkey", "grouped", format_value(F.col("o_totalprice"), "0.00").alias("fixed"), "day")


# Documents.
@query("""SELECT doc_id, replace(text, 'the', 'THE') AS text, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS replacements FROM documents""")
def doc_find_replace(spark, d):
    return docs.find_replace(table(spark, d, "documents").select("doc_id", "text"), "text", "the", "THE")


@query("""WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(l, 1) AS ln, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents)),
  words AS (SELECT doc_id, ln, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines),
  fill(doc_id, ln, i, used, sub, w) AS (SELECT doc_id, ln, 1, length(w[1]), 0, w FROM words WHERE len(w) > 0
    UNION ALL SELECT doc_id, ln, i + 1, CASE WHEN used + 1 + length(w[i + 1]) <= 80 THEN used + 1 + length(w[i + 1]) ELSE length(w[i + 1]) END, CASE WHEN used + 1 + length(w[i + 1]) <= 80 THEN sub ELSE sub + 1 END, w FROM fill WHERE i < len(w)),
  wrapped AS (SELECT doc_id, ln, sub, string_agg(w[i], ' ' ORDER BY i) AS text FROM fill GROUP BY doc_id, ln, sub UNION ALL SELECT doc_id, ln, 0, '' FROM words WHERE len(w) = 0)
  SELECT doc_id, (k // 40) + 1 AS page, k % 40 + 1 AS line, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY ln, sub) - 1 AS k FROM wrapped)""")
def doc_paginate(spark, d):
    return docs.paginated(dealt(table(spark, d, "documents"), f"{d}/documents.parquet"), "doc_id", "text", 80, 40)


@query("SELECT doc_id AS id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def doc_dedup(spark, d):
    return docs.duplicates(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("""SELECT n_nationkey AS id, n_name AS name, 0 AS source_part FROM nation UNION ALL SELECT r_regionkey + (SELECT max(n_nationkey) FROM nation), r_name, 1 FROM region""")
def doc_merge(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    got = docs.merged([a, b], "id")
    return got.select(F.col("id").cast("int").alias("id"), "name", "source_part")


@query("""SELECT page_id, part FROM pages, (VALUES (1, 0, 99), (2, 50, 149), (3, 150, 9223372036854775807)) AS r(part, a, b) WHERE page_id BETWEEN a AND b""")
def doc_split(spark, d):
    return docs.split_by_ranges(table(spark, d, "pages").select("page_id"), "page_id", [(0, 99), (50, 149), (150, None)])


@query("SELECT conv_id, turn + 1 AS page, count(*) OVER (PARTITION BY conv_id) - turn AS new_page FROM conversations")
def doc_reorder(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"))
    return docs.reordered(pages, "page", F.col("pages") + 1 - F.col("page"), ["conv_id"])


@query("SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations WHERE turn <> 0")
def doc_delete(spark, d):
    return docs.deleted(table(spark, d, "conversations").select("conv_id", "role", "turn"), "turn", [0], ["conv_id"])


REGIONS = [(1, 0.0, 0.0, 20.0, 50000.0), (3, 10.0, 30000.0, 15.0, 20000.0)]
REGIONS_SQL = "(VALUES " + ", ".join(f"({p}, {x}, {y}, {w}, {h})" for p, x, y, w, h in REGIONS) + ") AS r(page, x, y, width, height)"


@query(f"""SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM {REGIONS_SQL} WHERE r.page = l_linenumber AND l_quantity BETWEEN r.x AND r.x + r.width AND l_extendedprice BETWEEN r.y AND r.y + r.height)""")
def doc_redact(spark, d):
    ops = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    left = docs.in_regions(ops, spark.createDataFrame(REGIONS, "page int, x double, y double, width double, height double"))
    return left.select("l_orderkey", F.col("page").alias("l_linenumber"))


LABELS = [(0, "r", None, 1), (4, "D", "A-", 1), (60, "A", None, 3)]


@query("""SELECT page_id, CASE WHEN page_id < 4 THEN ['i', 'ii', 'iii', 'iv'][page_id + 1] WHEN page_id < 60 THEN 'A-' || (page_id - 3) ELSE repeat(chr(CAST(65 + (page_id - 58) % 26 AS INTEGER)), (page_id - 58) // 26 + 1) END AS label FROM pages""")
def doc_labels(spark, d):
    ranges = spark.createDataFrame(LABELS, "start_page_index int, style string, prefix string, first_label_number int")
    return docs.labelled(table(spark, d, "pages").select("page_id"), ranges, "page_id")


@query("""SELECT doc_id, rule_id, severity FROM (SELECT doc_id, unnest([CASE WHEN text = '' OR text IS NULL THEN '7.3:error' END, CASE WHEN lang <> 'en' THEN '7.4:error' END, CASE WHEN n_chars > 5000 THEN '7.11:warning' END]) AS v,
  split_part(v, ':', 1) AS rule_id, split_part(v, ':', 2) AS severity FROM documents) WHERE v IS NOT NULL""")
def doc_rules(spark, d):
    rules = [("7.3", "error", "There is no text.", F.col("text").isNull() | (F.col("text") == "")), ("7.4", "error", "The language isn't English.", F.col("lang") != "en"), ("7.11", "warning", "The text is long.", F.col("n_chars") > 5000)]
    return docs.violations(table(spark, d, "documents"), "doc_id", rules).drop("description")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, length(text) % 5 + 1 AS level, coalesce(lag(length(text) % 5 + 1) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS p FROM conversations) WHERE level > p + 1""")
def doc_headings(spark, d):
    h = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 5 + 1).alias("level"))
    return docs.skipped_headings(h, ["conv_id"], "turn").select("conv_id", "turn")


@query("""SELECT conv_id, string_agg(j || text, '' ORDER BY n) AS text FROM (SELECT conv_id, text, row_number() OVER w AS n, CASE WHEN lag(y) OVER w IS NULL THEN '' WHEN abs(lag(y) OVER w - y) > 2 THEN chr(10) WHEN x - lag(x + 5.0) OVER w > 1 THEN ' ' ELSE '' END AS j
  FROM (SELECT conv_id, turn, text, CAST(100 - (turn // 2) * 10 AS DOUBLE) AS y, CAST((turn % 2) * 7 AS DOUBLE) AS x FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY y DESC, x, turn)) GROUP BY conv_id""")
def doc_page_text(spark, d):
    c = table(spark, d, "conversations")
    spans = c.select("conv_id", F.col("turn").alias("seq"), "text", (100 - F.floor(F.col("turn") / 2) * 10).cast("double").alias("y"), (F.col("turn") % 2 * 7).cast("double").alias("x"), F.lit(5.0).alias("width"))
    return docs.page_text(spans, ["conv_id"])


@query("SELECT 'customer' AS sheet, 1 AS first_row, 1 AS first_col, CAST((SELECT max(c_custkey) FROM customer) + 1 AS INTEGER) AS last_row, 3 AS last_col")
def grid_used_range(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return grid.used_range(grid.cells_of(c, "customer", "c_custkey")).drop("workbook")


@query("SELECT n_nationkey + 1 AS row, n_name || chr(9) || n_regionkey || '.0' AS line FROM nation")
def grid_plain_text(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("pos"), "n_name", "n_regionkey")
    return grid.plain_text(grid.cells_of(n, "nation", "pos", header=False)).select("row", "line")


@query("""SELECT c_custkey, rule FROM (SELECT c_custkey, unnest([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END]) AS rule FROM customer) WHERE rule IS NOT NULL""")
def data_validation(spark, d):
    rules = {"balance": grid.validation("c_acctbal", "decimal", "greaterThanOrEqual", 0.0), "segment": grid.validation("c_mktsegment", "list", "", ["BUILDING", "MACHINERY"])}
    return grid.invalid_cells(table(spark, d, "customer"), "c_custkey", rules)


@query("""SELECT n_nationkey, '"' || n_name || ', x",' || n_regionkey || ',TRUE' AS line FROM nation""")
def csv_lines(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(", x")).alias("a"), "n_regionkey", F.lit(True).alias("b"))
    return csv.csv_lines(n, keep=["n_nationkey"])


@query("""SELECT event_id, CASE WHEN v IS NULL OR v = '' THEN 'blank' WHEN lower(v) IN ('true', 'false') THEN 'boolean' WHEN v SIMILAR TO '[+-]?0[0-9].*' THEN 'text' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'text' END AS kind
  FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '00' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'TRUE' WHEN 3 THEN event_type ELSE '' END AS v FROM events)""")
def csv_inference(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 5
    v = F.when(k == 0, F.concat(F.lit("00"), "event_id")).when(k == 1, F.col("event_id").cast("string")).when(k == 2, "TRUE").when(k == 3, F.col("event_type")).otherwise("")
    return e.select("event_id", csv.inferred(v)["kind"].alias("kind"))


@query("SELECT series, r_name AS category, CAST(v AS DOUBLE) AS value FROM (SELECT r_name, unnest(['a', 'b']) AS series, unnest([r_regionkey * 2, r_regionkey + 5]) AS v FROM region)")
def chart_points(spark, d):
    r = table(spark, d, "region").select("r_name", (F.col("r_regionkey") * 2).alias("a"), (F.col("r_regionkey") + 5).alias("b"))
    return texts.chart_points(r, "r_name", ["a", "b"])


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_totals(spark, d):
    got = windows.windowed_totals(table(spark, d, "events"), "ts", "event_type", "value", "1 hour")
    return got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, g""")
def sessions(spark, d):
    got = windows.sessions(table(spark, d, "events"), "ts", "user_id", "1 hour")
    return got.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("SELECT 14.0::DOUBLE AS a, 512.0::DOUBLE AS b, 0.1::DOUBLE AS c, 4.0::DOUBLE AS d, 'a b' AS e, 26.0::DOUBLE AS f")
def formula_goldens(spark, d):
    return evaluate(spark, {"a": "=2+3*4", "b": "=2^3^2", "c": "=10%", "d": "=-2^2", "e": '=TRIM("  a   b  ")', "f": '=DATEDIF(DATE(2020,1,15),DATE(2020,2,10),"MD")'})


@query()
def function_catalogue(spark, d):
    return catalogue(spark)


# Functions, a family to a query.
def nines(df: DataFrame, key: str, names) -> DataFrame:
    return df.select(key, *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.select(*names).dtypes])


@query("""SELECT o_orderkey, round(acos(x), 9) AS acos, round(asin(x), 9) AS asin, round(atan(x), 9) AS atan, round(cos(x), 9) AS cos, round(sin(x), 9) AS sin, round(tan(x), 9) AS tan, round(sinh(x), 9) AS sinh, round(cosh(x), 9) AS cosh, round(tanh(x), 9) AS tanh,
  round(asinh(x), 9) AS asinh, round(atanh(x), 9) AS atanh, round(acosh(1 + x), 9) AS acosh, round(1 / cos(x), 9) AS sec, round(1 / sin(1 + x), 9) AS csc, round(cot(1 + x), 9) AS cot, round(degrees(x), 9) AS deg, round(radians(x), 9) AS rad, round(atan2(2, x), 9) AS atan2,
  round(pi() * x, 9) AS pi FROM (SELECT o_orderkey, o_totalprice / 1000000 AS x FROM orders)""")
def trigonometric_functions(spark, d):
    x = "o_totalprice/1000000"
    f = {n.lower(): f"={n}({x})" for n in ("ACOS", "ASIN", "ATAN", "COS", "SIN", "TAN", "SINH", "COSH", "TANH", "ASINH", "ATANH", "SEC")}
    f |= {"acosh": f"=ACOSH(1+{x})", "csc": f"=CSC(1+{x})", "cot": f"=COT(1+{x})", "deg": f"=DEGREES({x})", "rad": f"=RADIANS({x})", "atan2": f"=ATAN2({x},2)", "pi": f"=PI()*{x}"}
    return nines(calculated(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), f), "o_orderkey", f)


@query("""SELECT o_orderkey, round(exp(x), 9) AS exp, round(log10(x), 9) AS log10, round(log2(x), 9) AS log2, round(cbrt(x), 9) AS cbrt, CAST(sign(x - 0.2) AS DOUBLE) AS sign, round(abs(x - 0.2), 9) AS abs, round(pow(x, 1.5), 9) AS power, round(sqrt(x * pi()), 9) AS sqrtpi, round(ln(x), 9) AS ln,
  x BETWEEN 0 AND 1 AND true AS rand FROM (SELECT o_orderkey, o_totalprice / 1000000 AS x FROM orders)""")
def exponential_functions(spark, d):
    x = "o_totalprice/1000000"
    f = {"exp": f"=EXP({x})", "log10": f"=LOG10({x})", "log2": f"=LOG({x},2)", "cbrt": f"=CBRT({x})", "sign": f"=SIGN({x}-0.2)", "abs": f"=ABS({x}-0.2)", "power": f"=POWER({x},1.5)", "sqrtpi": f"=SQRTPI({x})", "ln": f"=LN({x})", "rand": "=AND(RAND()<1,RANDBETWEEN(3,5)>=3,RANDBETWEEN(5,3)<=5)"}
    return nines(calculated(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), f), "o_orderkey", f)


@query("""SELECT p_partkey, round(ceil(p_retailprice * 10) / 10, 9) AS up, round(floor(p_retailprice * 10) / 10, 9) AS down, trunc(p_retailprice) AS cut, round(floor(p_retailprice / 7 + 0.5) * 7, 9) AS mround, floor(p_retailprice / 5) * 5 AS floor5, ceil(p_retailprice / 3) * 3 AS ceiling3,
  floor(p_retailprice) AS floor_math, ceil(p_size / 2) * 2.0 AS even, CASE WHEN p_size % 2 = 1 THEN p_size ELSE p_size + 1 END::DOUBLE AS odd, CAST(factorial(p_size % 15) AS DOUBLE) AS fact, CAST(gcd(p_size, 36) AS DOUBLE) AS gcd, CAST(lcm(p_size, 36) AS DOUBLE) AS lcm,
  to_base(p_partkey, 16) AS hex, CAST(p_partkey AS DOUBLE) AS back, CAST(p_size AS DOUBLE) AS roman, CAST(p_size + 3 AS DOUBLE) * (p_size + 2) * (p_size + 1) / 6 AS combin, CAST(p_size + 3 AS DOUBLE) * (p_size + 2) AS permut,
  CASE WHEN p_size % 2 = 0 THEN 48.0 ELSE 105.0 END::DOUBLE AS fact2 FROM part""")
def rounding_functions(spark, d):
    f = {
        "up": "=ROUNDUP(p_retailprice,1)", "down": "=ROUNDDOWN(p_retailprice,1)", "cut": "=TRUNC(p_retailprice)", "mround": "=MROUND(p_retailprice,7)", "floor5": "=FLOOR(p_retailprice,5)", "ceiling3": "=CEILING.MATH(p_retailprice,3)", "floor_math": "=FLOOR.MATH(p_retailprice)",
        "even": "=EVEN(p_size)", "odd": "=ODD(p_size)", "fact": "=FACT(MOD(p_size,15))", "gcd": "=GCD(p_size,36)", "lcm": "=LCM(p_size,36)", "hex": "=BASE(p_partkey,16)", "back": "=DECIMAL(BASE(p_partkey,16),16)", "roman": "=ARABIC(ROMAN(p_size))",
        "combin": "=COMBIN(p_size+3,3)", "permut": "=PERMUT(p_size+3,2)", "fact2": "=IF(ISEVEN(p_size),FACTDOUBLE(6),FACTDOUBLE(7))",
    }
    return nines(calculated(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), f), "p_partkey", f)


@query("""SELECT c_custkey, c_mktsegment || c_nationkey || '!' AS cat, 'x' || c_nationkey || c_name AS cat2, c_mktsegment || ', ' || c_name AS joined, CAST(ascii(c_mktsegment) AS DOUBLE) AS code, CAST(unicode(c_mktsegment) AS DOUBLE) AS uni, chr(CAST(65 + c_nationkey % 26 AS INTEGER)) AS chr,
  chr(CAST(913 + c_nationkey % 10 AS INTEGER)) AS unichr, lower(c_name) AS low, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS proper, substr(c_name, 1, 2) || 'XY' || substr(c_name, 6) AS repl, CAST(nullif(strpos(lower(c_mktsegment), 'i'), 0) AS DOUBLE) AS search,
  split_part(c_name, '#', 2) AS after, CAST(split_part(c_name, '#', 2) AS DOUBLE) AS num, CAST(split_part(c_name, '#', 2) AS DOUBLE) AS num2, c_mktsegment AS t, CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS n,
  CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) AS dollar, format('{:,.1f}', round(c_acctbal * 10) / 10) = format('{:,.1f}', round(c_acctbal * 10) / 10) AS fixed, 'a b' AS trimmed, 'ab' AS cleaned, replace(c_name, 'r#', 'r-') AS subst FROM customer""")
def text_functions_more(spark, d):
    f = {
        "cat": '=CONCAT(c_mktsegment,c_nationkey,"!")', "cat2": '=CONCATENATE("x",c_nationkey,c_name)', "joined": '=TEXTJOIN(", ",TRUE,c_mktsegment,c_name)', "code": "=CODE(c_mktsegment)", "uni": "=UNICODE(c_mktsegment)", "chr": "=CHAR(65+MOD(c_nationkey,26))",
        "unichr": "=UNICHAR(913+MOD(c_nationkey,10))", "low": "=LOWER(c_name)", "proper": "=PROPER(c_mktsegment)", "repl": '=REPLACE(c_name,3,3,"XY")', "search": '=SEARCH("I",c_mktsegment)', "after": '=TEXTAFTER(c_name,"#")', "num": '=VALUE(TEXTAFTER(c_name,"#"))',
        "num2": '=NUMBERVALUE(TEXTAFTER(c_name,"#"))', "t": "=T(c_mktsegment)", "n": "=N(c_acctbal>0)", "dollar": "=DOLLAR(c_acctbal)", "fixed": "=LEN(FIXED(c_acctbal,1))>2", "trimmed": '=TRIM("  a   b ")', "cleaned": '=CLEAN("a"&CHAR(9)&"b")', "subst": '=SUBSTITUTE(c_name,"r#","r-")',
    }
    return calculated(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), f).select("c_custkey", *f)


@query("""SELECT event_id, CAST(hour(ts) AS DOUBLE) AS h, CAST(minute(ts) AS DOUBLE) AS m, CAST(second(ts) AS DOUBLE) AS s, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0, 9) AS t, 0.5::DOUBLE AS tv,
  CAST(date_diff('day', DATE '1899-12-30', CAST(ts AS DATE)) AS DOUBLE) AS dv, true AS today FROM events""")
def time_functions(spark, d):
    f = {"h": "=HOUR(ts)", "m": "=MINUTE(ts)", "s": "=SECOND(ts)", "t": "=TIME(HOUR(ts),MINUTE(ts),SECOND(ts))", "tv": '=TIMEVALUE("12:00")', "dv": '=DATEVALUE(TEXT(ts,"yyyy-mm-dd"))', "today": "=AND(TODAY()=NOW(),TODAY()>45000)"}
    return nines(calculated(table(spark, d, "events").select("event_id", "ts"), f), "event_id", f)


@query("""SELECT o_orderkey, CAST(date_diff('day', t, DATE '2005-06-15') AS DOUBLE) AS dd, CAST((2005 - year(t)) * 12 + 6 - month(t) AS DOUBLE) AS dm, CAST(2005 - year(t) AS DOUBLE) AS dy, round(date_diff('day', t, DATE '2005-06-15') / 365.0, 9) AS yf, round(date_diff('day', t, DATE '2005-06-15') / 365.0, 9) AS yf3,
  CAST((2005 - year(t)) * 360 + (6 - month(t)) * 30 + 15 - least(day(t), 30) AS DOUBLE) AS d360, CAST((dayofyear(t) + dayofweek(make_date(year(t), 1, 1)) - 1) // 7 + 1 AS DOUBLE) AS wn FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t FROM orders)""")
def date_functions_more(spark, d):
    end = "DATE(2005,6,15)"
    f = {"dd": f'=DATEDIF(o_orderdate,{end},"D")', "dm": f'=DATEDIF(o_orderdate,{end},"M")', "dy": f'=DATEDIF(o_orderdate,{end},"Y")', "yf": f"=YEARFRAC(o_orderdate,{end})", "yf3": f"=YEARFRAC(o_orderdate,{end},3)", "d360": f"=DAYS360(o_orderdate,{end})", "wn": "=WEEKNUM(o_orderdate)"}
    return nines(calculated(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), f), "o_orderkey", f)


@query("""SELECT c_custkey, true AS num, true AS txt, true AS nontxt, true AS logical, false AS blank, c_nationkey = 0 AS err, c_nationkey = 0 AS err2, false AS na, c_nationkey % 2 = 0 AS even, c_nationkey % 2 = 1 AS odd, 4.0::DOUBLE AS ty, CASE WHEN c_nationkey = 0 THEN 2.0 END::DOUBLE AS et, false AS ref, false AS form,
  CASE WHEN c_nationkey < 5 THEN 'low' WHEN c_nationkey < 15 THEN 'mid' ELSE 'high' END AS ifs, ['a', 'b', 'c'][c_nationkey % 3 + 1] AS pick, 7.0::DOUBLE AS ifna, c_nationkey <> 0 AS negated, (c_nationkey > 5) <> (c_acctbal > 0) AS xored, true AS yes, false AS no, CASE WHEN c_nationkey = 0 THEN 2.0 ELSE 16.0 END::DOUBLE AS ty2 FROM customer""")
def information_functions(spark, d):
    f = {
        "num": "=ISNUMBER(c_acctbal)", "txt": "=ISTEXT(c_name)", "nontxt": "=ISNONTEXT(c_acctbal)", "logical": "=ISLOGICAL(c_acctbal>0)", "blank": "=ISBLANK(c_name)", "err": "=ISERROR(1/c_nationkey)", "err2": "=ISERR(1/c_nationkey)", "na": "=ISNA(1/c_nationkey)", "even": "=ISEVEN(c_nationkey)", "odd": "=ISODD(c_nationkey)",
        "ty": "=TYPE(c_name)", "et": "=ERROR.TYPE(1/c_nationkey)", "ref": "=ISREF(c_name)", "form": "=ISFORMULA(c_name)", "ifs": '=IFS(c_nationkey<5,"low",c_nationkey<15,"mid",TRUE,"high")', "pick": '=CHOOSE(MOD(c_nationkey,3)+1,"a","b","c")', "ifna": "=IFNA(NA(),7)", "negated": "=NOT(c_nationkey=0)",
        "xored": "=XOR(c_nationkey>5,c_acctbal>0)", "yes": "=TRUE", "no": "=FALSE", "ty2": "=IF(c_nationkey=0,TYPE(1),TYPE(TRUE))",
    }
    return calculated(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), f).select("c_custkey", *f)


@query("""SELECT o_orderkey, round(-(1000 + 50 * (pow(1 + r, 24) - 1) / (r * pow(1 + r, 24))), 6) AS pv, round(ln((-p * (1 + r)) / (o_totalprice * r - p)) / ln(1 + r), 6) AS nper, round(o_totalprice / 1.1 + 5 / pow(1.1, 2), 6) AS npv, o_totalprice <> round(o_totalprice / 24 * 24, 6) AS zero
  FROM (SELECT o_orderkey, o_totalprice, 0.01::DOUBLE AS r, o_totalprice / 20 AS p FROM orders)""")
def financial_functions_more(spark, d):
    f = {"pv": "=PV(0.01,24,50,1000)", "nper": "=NPER(0.01,-o_totalprice/20,o_totalprice)", "npv": "=NPV(0.1,o_totalprice,5)", "zero": "=PMT(0,24,o_totalprice)*-24<>o_totalprice"}
    got = calculated(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), f).select("o_orderkey", *f)
    return got.select("o_orderkey", F.round("pv", 6).alias("pv"), F.round("nper", 6).alias("nper"), F.round("npv", 6).alias("npv"), (F.col("zero") & F.lit(False)).alias("zero"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS avga, min(l_quantity) AS mina, max(l_quantity) AS maxa, 0.0::DOUBLE AS avgt, round(stddev_samp(l_tax), 9) AS sds, round(stddev_pop(l_tax), 9) AS sdp, round(var_pop(l_tax), 9) AS vp, round(var_samp(l_tax), 9) AS v, CAST(count(*) AS DOUBLE) AS skew,
  greatest(max(l_tax), max(l_discount)) AS maxtwo, least(min(l_quantity), min(l_extendedprice)) AS mintwo, round((sum(l_tax) + sum(l_discount)) / (2 * count(*)), 9) AS avgtwo, CAST(2 * count(*) AS DOUBLE) AS counttwo, round(stddev_samp_two, 9) AS sdtwo
  FROM lineitem JOIN (SELECT l_returnflag AS f, stddev_samp(x) AS stddev_samp_two FROM (SELECT l_returnflag, l_tax AS x FROM lineitem UNION ALL SELECT l_returnflag, l_discount FROM lineitem) GROUP BY 1) ON f = l_returnflag GROUP BY l_returnflag, stddev_samp_two""")
def aggregates_more(spark, d):
    f = {
        "avga": "=AVERAGEA(l_quantity)", "mina": "=MINA(l_quantity)", "maxa": "=MAXA(l_quantity)", "avgt": "=AVERAGEA(l_linestatus)", "sds": "=STDEV.S(l_tax)", "sdp": "=STDEVP(l_tax)", "vp": "=VAR.P(l_tax)", "v": "=VAR(l_tax)", "skew": "=SKEW(l_extendedprice)",
        "maxtwo": "=MAX(l_tax,l_discount)", "mintwo": "=MIN(l_quantity,l_extendedprice)", "avgtwo": "=AVERAGE(l_tax,l_discount)", "counttwo": "=COUNT(l_tax,l_discount)", "sdtwo": "=STDEV(l_tax,l_discount)",
    }
    return rounded(summary(table(spark, d, "lineitem"), f, by=["l_returnflag"]), 9).select("l_returnflag", F.round("avga", 6).alias("avga"), *[c for c in f if c != "avga"])


@query("""SELECT g.o_orderpriority, large, small, round(med, 6) AS med, round(p9, 6) AS p9, round(q1, 6) AS q1, round(dev, 6) AS dev, round(trim, 6) AS trim, CAST(mode AS DOUBLE) AS mode FROM
  (SELECT o_orderpriority, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.9) AS p9, quantile_cont(o_totalprice, 0.25) AS q1, list_sort(list(o_totalprice))[2] AS small, list_reverse_sort(list(o_totalprice))[3] AS large FROM orders GROUP BY 1) g
  JOIN (SELECT o_orderpriority, avg(abs(o_totalprice - m)) AS dev FROM (SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1) a ON a.o_orderpriority = g.o_orderpriority
  JOIN (SELECT o_orderpriority, avg(x) FILTER (WHERE k > round_even(n * 0.1, 0) AND k <= n - round_even(n * 0.1, 0)) AS trim FROM (SELECT o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1) t ON t.o_orderpriority = g.o_orderpriority
  JOIN (SELECT o_orderpriority, arg_max(o_custkey, n * 1000000000000 - p) AS mode FROM (SELECT o_orderpriority, o_custkey, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY 1, 2) GROUP BY 1) m ON m.o_orderpriority = g.o_orderpriority""")
def group_order_statistics(spark, d):
    f = {"large": "=LARGE(o_totalprice,3)", "small": "=SMALL(o_totalprice,2)", "med": "=MEDIAN(o_totalprice)", "p9": "=PERCENTILE.INC(o_totalprice,0.9)", "q1": "=QUARTILE.INC(o_totalprice,1)", "dev": "=AVEDEV(o_totalprice)", "trim": "=TRIMMEAN(o_totalprice,0.1)", "mode": "=MODE.SNGL(o_custkey)"}
    return rounded(summary(table(spark, d, "orders"), f, by=["o_orderpriority"], pos="o_orderkey"), 6)


@query("""SELECT (SELECT arg_max(x, n * 1000000000000 - p) FROM (SELECT l_quantity AS x, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY 1)) AS mode, CAST(count(*) FILTER (WHERE l_quantity > 25) + 1 AS DOUBLE) AS rk, CAST(count(*) FILTER (WHERE l_quantity > 25) + 1 AS DOUBLE) AS rkeq,
  CAST(count(*) FILTER (WHERE l_quantity < 25) + 1 AS DOUBLE) AS rkup, round((count(*) FILTER (WHERE l_quantity < 25) + 0.5 * count(*) FILTER (WHERE l_quantity = 25)) / (count(*) - 1), 9) AS pr, round((count(*) FILTER (WHERE l_quantity < 25) + 0.5 * count(*) FILTER (WHERE l_quantity = 25)) / (count(*) - 1), 9) AS princ,
  1.0::DOUBLE AS gcd, CAST(count(*) FILTER (WHERE l_quantity > (SELECT max(l_quantity) FROM lineitem)) + 1 AS DOUBLE) AS top FROM lineitem""")
def ranks_of_values(spark, d):
    df = table(spark, d, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    f = {"mode": "=MODE.MULT(l_quantity)", "rk": "=RANK(25,l_quantity)", "rkeq": "=RANK.EQ(25,l_quantity)", "rkup": "=RANK.AVG(25,l_quantity,1)", "pr": "=PERCENTRANK(l_quantity,25)", "princ": "=PERCENTRANK.INC(l_quantity,25)", "gcd": "=GCD(l_quantity)", "top": "=RANK(MAX(l_quantity),l_quantity)"}
    return rounded(summary(df, f, pos="pos"), 9)


@query("""SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS every, bool_or(c_acctbal > 9990) AS some, count(*) FILTER (WHERE c_nationkey % 2 = 1) % 2 = 1 AS odd, bool_and(c_acctbal > 0) AND false AS none, CAST(lcm_all AS DOUBLE) AS multiple, CAST(gcd_all AS DOUBLE) AS divisor
  FROM customer, (SELECT list_reduce(list(DISTINCT k), lambda a, b: lcm(a, b)) AS lcm_all, list_reduce(list(DISTINCT k), lambda a, b: gcd(a, b)) AS gcd_all FROM (SELECT 6 * (c_nationkey % 5 + 1) AS k FROM customer)) GROUP BY c_mktsegment, lcm_all, gcd_all""")
def logical_aggregates(spark, d):
    df = table(spark, d, "customer").select("c_mktsegment", "c_acctbal", "c_nationkey", (F.col("c_acctbal") > -1000).alias("a"), (F.col("c_acctbal") > 9990).alias("b"), (F.col("c_nationkey") % 2 == 1).alias("c"), (F.col("c_acctbal") > 0).alias("e"), (6 * (F.col("c_nationkey") % 5 + 1)).alias("k"))
    own = summary(df, {"every": "=AND(a)", "some": "=OR(b)", "odd": "=XOR(c)", "none": "=AND(e,FALSE)"}, by=["c_mktsegment"])
    return own.join(F.broadcast(summary(df, {"multiple": "=LCM(k)", "divisor": "=GCD(k)"})), F.lit(True))  # one row


@query("""SELECT (SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) FROM nation) AS names, (SELECT string_agg(left(n_name, 1), '' ORDER BY n_nationkey) FROM nation) AS letters, (SELECT round(n_regionkey / 1.1 + 3 / pow(1.1, 2), 9) FROM nation WHERE n_nationkey = 0) AS npv, (SELECT 'all: ' || string_agg(CAST(n_regionkey AS VARCHAR), '-' ORDER BY n_nationkey) || '-end' FROM nation) AS mixed""")
def text_aggregates(spark, d):
    f = {"names": '=TEXTJOIN(", ",TRUE,n_name)', "letters": "=CONCAT(LEFT(n_name,1))", "npv": "=NPV(0.1,n_regionkey,3)", "mixed": '="all: "&TEXTJOIN("-",FALSE,n_regionkey,"end")'}
    return summary(table(spark, d, "nation"), f, pos="n_nationkey").select("names", "letters", F.round("npv", 9).alias("npv"), "mixed")


@query("""SELECT round(sum(l_extendedprice) FILTER (WHERE l_quantity > 20), 2) AS a, CAST(count(*) FILTER (WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)) AS DOUBLE) AS b, round(avg(l_tax) FILTER (WHERE l_quantity <= 10 AND lower(l_returnflag) = 'r'), 9) AS c, max(l_discount) FILTER (WHERE l_quantity = 7) AS d, CAST(count(*) FILTER (WHERE l_returnflag <> 'A') AS DOUBLE) AS e,
  min(l_tax) FILTER (WHERE l_quantity >= 49) AS f FROM lineitem""")
def criteria_expressions(spark, d):
    f = {"a": '=SUMIF(l_quantity,">"&2*10,l_extendedprice)', "b": '=COUNTIF(l_quantity,">"&AVERAGE(l_quantity))', "c": '=AVERAGEIFS(l_tax,l_quantity,"<="&20/2,l_returnflag,"R"&"")', "d": "=MAXIFS(l_discount,l_quantity,3+4)", "e": '=COUNTIFS(l_returnflag,"<>"&UPPER("a"))', "f": '=MINIFS(l_tax,l_quantity,CONCAT(">=",49))'}
    got = summary(table(spark, d, "lineitem"), f)
    return got.select(F.round("a", 2).alias("a"), "b", F.round("c", 9).alias("c"), "d", "e", "f")


TEXT_BANDS = [(1, "AUTO", "cars"), (2, "C", "other"), (3, "HOUSE", "homes"), (4, "MACH", "tools")]
TEXT_BANDS_SQL = "(VALUES " + ", ".join(f"({p}, '{k}', '{s}')" for p, k, s in TEXT_BANDS) + ") AS b(pos, lower, label)"


@query(f"""SELECT c_custkey, label, (SELECT max(pos) FROM {TEXT_BANDS_SQL} WHERE lower <= c_mktsegment) AS at, (SELECT max(pos) FROM {TEXT_BANDS_SQL} WHERE lower >= c_mktsegment) AS down FROM customer ASOF LEFT JOIN {TEXT_BANDS_SQL} ON c_mktsegment >= lower""")
def text_lookups(spark, d):
    b = spark.createDataFrame(TEXT_BANDS, "pos int, lower string, label string")
    f = {"label": "=VLOOKUP(LOWER(c_mktsegment),bands,2)", "at": "=MATCH(c_mktsegment,bands!lower,1)", "down": "=MATCH(c_mktsegment,bands!lower,-1)"}
    got = calculated(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), f, tables={"bands": Table(b, "pos", in_order=True)})
    return got.select("c_custkey", "label", F.col("at").cast("int").alias("at"), F.col("down").cast("int").alias("down"))


@query("SELECT c_custkey, CASE c_nationkey % 2 WHEN 0 THEN 'zero' ELSE 'one' END AS word FROM customer")
def hlookup_formula(spark, d):
    wide = spark.createDataFrame([(1, "zero", "one")], "pos int, even string, odd string")
    f = {"word": '=HLOOKUP(IF(ISEVEN(c_nationkey),"EVEN","ODD"),t,2,FALSE)'}
    return calculated(table(spark, d, "customer").select("c_custkey", "c_nationkey"), f, tables={"t": Table(wide, "pos")}).select("c_custkey", "word")


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def moving_average(spark, d):
    return rounded(pivot.moving(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [], "o_orderkey", "o_totalprice", 4).drop("o_totalprice"))


# Grids.
def nation_books(spark, d, formulas: bool = True) -> DataFrame:
    """A workbook for each region, a sheet for each nation, its customers' balances down column A and formulas beside them."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("sheet"), F.format_string("book%d", F.col("n_regionkey")).alias("workbook"))
    c = table(spark, d, "customer").join(F.broadcast(n), "c_nationkey")  # 25 nations
    row = F.row_number().over(Window.partitionBy("sheet").orderBy("c_custkey"))
    c = c.select("workbook", "sheet", row.cast("int").alias("row"), "c_acctbal")
    cell = lambda col, num, formula: F.struct(F.lit(col).alias("col"), F.lit("blank" if formula is not None else "number").alias("kind"), (num if num is not None else F.lit(None)).cast("double").alias("num"), (formula if formula is not None else F.lit(None)).cast("string").alias("formula"))
    own = [cell(1, F.col("c_acctbal"), None)] + ([cell(2, None, F.format_string("IF(A%d>0,A%d*1.1,0)", "row", "row"))] if formulas else [])
    cells = c.select("workbook", "sheet", "row", F.explode(F.array(*own)).alias("c")).select("workbook", "sheet", "row", "c.*")
    if formulas:
        last = c.groupBy("workbook", "sheet").agg(F.max("row").alias("n"))
        totals = F.array(F.format_string("SUM(B1:B%d)", "n"), F.format_string('COUNTIF(A1:A%d,">"&0)', "n"), F.lit('IFERROR(D1/D2,"none")'), F.format_string("MAX(A1:A%d)-MIN(A$1:A%d)", "n", "n"))
        more = last.select("workbook", "sheet", F.posexplode(totals).alias("i", "formula")).select("workbook", "sheet", (F.col("i") + 1).alias("row"), F.lit(4).alias("col"), F.lit("blank").alias("kind"), F.lit(None).cast("double").alias("num"), "formula")
        cells = cells.unionByName(more)
    return cells.withColumns({"txt": F.lit(None).cast("string"), "bool": F.lit(None).cast("boolean"), "err": F.lit(None).cast("string"), "style": F.lit(None).cast("int")}).select(*[f.split()[0] for f in grid.CELLS.split(", ")])


NATION_TOTALS = """SELECT 'book' || n_regionkey AS workbook, n_name AS sheet, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal * 1.1 ELSE 0 END), 6) AS total, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS DOUBLE) AS positive, round(max(c_acctbal) - min(c_acctbal), 6) AS spread
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2"""


@query(f"SELECT *, CASE WHEN positive > 0 THEN round(total / positive, 6) END AS mean FROM ({NATION_TOTALS})")
def grid_recalculated(spark, d):
    done = recalculated(nation_books(spark, d)).filter("col = 4")
    of = lambda r: F.round(F.max(F.when(F.col("row") == r, F.col("num"))), 6)
    return done.groupBy("workbook", "sheet").agg(of(1).alias("total"), of(2).alias("positive"), of(3).alias("mean"), of(4).alias("spread"))


@query("""SELECT 'book' || n_regionkey AS workbook, n_name AS sheet, 1 AS first_row, 1 AS first_col, CAST(count(*) + 2 AS INTEGER) AS last_row, 2 AS last_col, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def grid_rows_inserted(spark, d):
    """Two rows are put in before the second row of every sheet, and the formulas beside the balances move along."""
    cells = grid.shift(nation_books(spark, d).filter("col < 3"), "row", 2, 2)
    used = grid.used_range(cells)
    sums = recalculated(cells).filter("col = 1").groupBy("workbook", "sheet").agg(F.round(F.sum("num"), 4).alias("total"))
    return used.join(sums, ["workbook", "sheet"])


@query("""SELECT 'book' || n_regionkey AS workbook, n_name AS sheet, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS INTEGER) AS row, c_acctbal AS num FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def xlsx_round_trip(spark, d):
    files = workbook.workbook_files(nation_books(spark, d, formulas=False))
    return workbook.workbook_cells(files, "workbook", "content").select("workbook", "sheet", "row", "num")


@query("""SELECT n_name AS sheet, CAST(count(*) FILTER (WHERE r = 1 OR c_acctbal > 5000) AS BIGINT) AS left_rows FROM (SELECT n_name, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1""")
def grid_auto_filter(spark, d):
    return grid.auto_filtered(nation_books(spark, d, formulas=False), "A1:A1048576", {1: ">5000"}).groupBy("sheet").agg(F.count("*").alias("left_rows"))


@query("""SELECT c_custkey, c_acctbal > 9000 AS rich, rank() OVER (ORDER BY c_acctbal DESC) <= 10 AS top, count(*) OVER (PARTITION BY c_nationkey) > 1 AS again, starts_with(lower(c_mktsegment), 'b') AS b, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS scale FROM customer""")
def conditional_flags(spark, d):
    c = table(spark, d, "customer")
    c = grid.flagged(c, "c_acctbal", "cellIs", ">9000", "rich")
    c = grid.flagged(grid.flagged(c, "c_acctbal", "top10", 10, "top"), "c_nationkey", "duplicateValues", name="again")
    c = grid.flagged(grid.flagged(c, "c_mktsegment", "beginsWith", "B", "b"), "c_acctbal", "dataBar", name="scale")
    return c.select("c_custkey", "rich", "top", "again", "b", F.round("scale", 9).alias("scale"))


@query("SELECT 'n_regionkey' AS series, n_name AS category, CAST(n_regionkey AS DOUBLE) AS value FROM nation WHERE n_nationkey < 10")
def chart_from_range(spark, d):
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("pos"), "n_name", "n_regionkey")
    return grid.chart_series(grid.cells_of(n, "nation", "pos"), "A1:B11").select("series", "category", "value")


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey, n_regionkey > 2 AS high FROM nation")
def csv_round_trip(spark, d):
    path = fresh_path(spark, "csv")
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", (F.col("n_regionkey") > 2).alias("high"))
    csv.write_csv(n, path, mark=True)
    cells = csv.typed(csv.read_csv(spark, path, columns=4))
    return cells.select(F.col("c1.num").cast("int").alias("n_nationkey"), F.col("c2.txt").alias("n_name"), F.col("c3.num").alias("n_regionkey"), F.col("c4.bool").alias("high"))


# Files of documents.
def conversation_files(spark, d) -> DataFrame:
    """A PDF for each conversation, a page for each turn."""
    c = table(spark, d, "conversations")
    text = F.regexp_replace("text", r"[^\x20-\x7e\xa1-\xff]", " ")
    return pdf.written_pdfs(c.select("conv_id", (F.col("turn") + 1).alias("page"), F.lit(1).alias("line"), text.alias("text")), "conv_id")


@query("""SELECT conv_id, turn + 1 AS page, regexp_replace(text, '[^\\x20-\\x7e\\xa1-\\xff]', ' ', 'g') AS text, 72.0::DOUBLE AS x, 720.0::DOUBLE AS y FROM conversations WHERE text <> ''""")
def pdf_round_trip(spark, d):
    return pdf.records(conversation_files(spark, d), "spans", "conv_id").select("conv_id", "page", "text", "x", "y")


@query("""SELECT conv_id, rule_id, severity, CASE WHEN rule_id = '7.11' THEN count(*) ELSE 1 END AS n FROM conversations, (VALUES ('6.1.3', 'error'), ('6.2.2', 'warning'), ('6.3.3', 'error'), ('6.7.2', 'error'), ('7.2', 'error'), ('7.3', 'error'), ('7.3', 'warning'), ('7.4', 'error'), ('7.5', 'error'), ('7.11', 'error'), ('7.17', 'error')) AS r(rule_id, severity)
  GROUP BY conv_id, rule_id, severity""")
def pdf_conformance(spark, d):
    facts = pdf.records(conversation_files(spark, d), "facts", "conv_id")
    return docs.conformance(facts, "conv_id", docs.ARCHIVE_RULES + docs.ACCESS_RULES).groupBy("conv_id", "rule_id", "severity").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS pages, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM conversations GROUP BY conv_id""")
def pdf_pages(spark, d):
    return pdf.records(conversation_files(spark, d), "pages", "conv_id").groupBy("conv_id").agg(F.count("*").alias("pages"), F.max("width").alias("width"), F.min("height").alias("height"))


@query("""SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS slide, n_name || chr(10) || 'No. ' || n_nationkey AS text FROM nation""")
def pptx_round_trip(spark, d):
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    placed = table(spark, d, "nation").withColumn("slide", place)
    texts_ = placed.select("n_regionkey", "slide", F.posexplode(F.array(F.col("n_name"), F.format_string("No. %d", "n_nationkey"))).alias("seq", "text"))
    return slides.records(slides.written_decks(texts_, "n_regionkey"), "slides", "n_regionkey").select("n_regionkey", "slide", "text")


@query("""SELECT n_nationkey, 1 AS seq, 'heading' AS kind, 2 AS level, n_name AS text FROM nation UNION ALL SELECT n_nationkey, 3, 'paragraph', 0, 'of region ' || n_regionkey FROM nation UNION ALL SELECT n_nationkey, 5, 'list', 0, 'a' FROM nation UNION ALL SELECT n_nationkey, 6, 'list', 0, 'b' FROM nation""")
def markdown_read(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.format_string("## %s\n\nof region\n%d\n\n- a\n- b", "n_name", "n_regionkey").alias("text"))
    got = texts.markdown_blocks(n, "n_nationkey", "text")
    return got.select("n_nationkey", F.col("seq").cast("int").alias("seq"), "kind", F.col("level").cast("int").alias("level"), "text")


@query("""SELECT conv_id, CAST(turn AS INTEGER) AS n, text FROM conversations""")
def xml_round_trip(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.lit(1).alias("page"), (F.col("turn") + 1).alias("line"), "text")
    return texts.xml_paragraphs(texts.document_xml(c, "conv_id"), "conv_id", "xml").select("conv_id", F.col("n").cast("int").alias("n"), "text")


@query("""SELECT conv_id, turn + 1 AS page, CASE turn % 3 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Square' ELSE 'Text' END AS subtype, CAST(turn * 10.5 AS DOUBLE) AS x, CAST(length(text) % 97 AS DOUBLE) AS width, left(text, 20) AS contents FROM conversations""")
def xfdf_round_trip(spark, d):
    kind = F.element_at(F.array(F.lit("Highlight"), F.lit("Square"), F.lit("Text")), (F.col("turn") % 3 + 1).cast("int"))
    a = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), kind.alias("subtype"), (F.col("turn") * 10.5).cast("double").alias("x"), F.lit(1.0).alias("y"), (F.length("text") % 97).cast("double").alias("width"), F.lit(5.0).alias("height"), F.left("text", F.lit(20)).alias("contents"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.2)).alias("color"))
    return docs.from_xfdf(docs.xfdf(a, "conv_id"), "conv_id").select("conv_id", "page", "subtype", "x", "width", "contents")


@query("""SELECT conv_id, turn + 1 + CASE WHEN turn >= 1 THEN 1 ELSE 0 END AS page, role FROM conversations UNION ALL SELECT DISTINCT conv_id, 2, 'inserted' FROM conversations""")
def doc_insert(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).cast("long").alias("page"), "role")
    new = c.select("conv_id").distinct().select("conv_id", F.lit(1).cast("long").alias("page"), F.lit("inserted").alias("role"))
    return docs.inserted(c, "page", 2, new, ["conv_id"])


@query("SELECT conv_id, role, CASE WHEN turn = 0 THEN count(*) OVER (PARTITION BY conv_id) ELSE turn END AS page FROM conversations")
def doc_move(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).cast("long").alias("page"), "role")
    return docs.moved(c, "page", F.col("page") == 1, F.col("pages"), ["conv_id"])


@query("""SELECT conv_id, role, CASE WHEN turn >= 1 THEN turn + 2 ELSE turn + 1 END AS page FROM conversations UNION ALL SELECT conv_id, role, 2 FROM conversations WHERE turn = 0""")
def doc_clone(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).cast("long").alias("page"), "role")
    return docs.cloned(c, "page", F.col("page") == 1, ["conv_id"], 2)


@query("""SELECT c_custkey, coalesce(CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END, CASE WHEN n_nationkey % 2 = 0 THEN true END, r_regionkey % 2 = 1) AS bold, coalesce(CASE WHEN c_acctbal < 0 THEN c_mktsegment END, CASE WHEN n_nationkey % 5 = 0 THEN n_name END, r_name) AS font
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def doc_inherited(spark, d):
    yes = lambda c: F.when(c, True)
    own = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, True).when(F.col("c_custkey") % 3 == 1, False).alias("bold"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("font"))
    layouts = table(spark, d, "nation").select("n_nationkey", "n_regionkey", yes(F.col("n_nationkey") % 2 == 0).alias("bold"), F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).alias("font"))
    masters = table(spark, d, "region").select("r_regionkey", (F.col("r_regionkey") % 2 == 1).alias("bold"), F.col("r_name").alias("font"))
    return docs.inherited(own, [(layouts, "n_nationkey", "c_nationkey"), (masters, "r_regionkey", "n_regionkey")], ["bold", "font"]).drop("c_nationkey")


@query("SELECT page_id, CAST((page_id % 4 * 90 + 270) % 360 AS INTEGER) AS turned FROM pages")
def doc_rotate(spark, d):
    return table(spark, d, "pages").select("page_id", docs.rotated((F.col("page_id") % 4 * 90).cast("int"), -90).cast("int").alias("turned"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN turn < 2 THEN CAST(turn + 1 AS VARCHAR) ELSE 'B-' || ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii'][turn - 1] END ELSE CAST(turn + 1 AS VARCHAR) END AS label FROM conversations""")
def doc_labels_by_document(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    own = c.select("conv_id").distinct().filter("conv_id % 2 = 0")
    ranges = own.select("conv_id", F.explode(F.array(F.struct(F.lit(0).alias("start_page_index"), F.lit("D").alias("style"), F.lit(None).cast("string").alias("prefix"), F.lit(1).alias("first_label_number")), F.struct(F.lit(2).alias("start_page_index"), F.lit("r").alias("style"), F.lit("B-").alias("prefix"), F.lit(1).alias("first_label_number")))).alias("r")).select("conv_id", "r.*")
    return docs.labelled(c, ranges, "turn", by=["conv_id"])


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber = 1 AND l_quantity <= 20)""")
def doc_redact_by_document(spark, d):
    ops = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), F.lit(1.0).alias("y"))
    regions = ops.filter("l_orderkey % 3 = 0").select("l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("width"), F.lit(5.0).alias("height"))
    return docs.in_regions(ops, regions, by=["l_orderkey"]).select("l_orderkey", F.col("page").alias("l_linenumber"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS id, 0::BIGINT AS parent, 1 AS depth FROM part WHERE p_partkey BETWEEN 1 AND 9 UNION ALL SELECT p.p_partkey, p.p_partkey // 10, t.depth + 1 FROM part p JOIN t ON p.p_partkey // 10 = t.id) SELECT CAST(id AS VARCHAR) AS id, CAST(parent AS VARCHAR) AS parent, depth FROM t""")
def doc_tree(spark, d):
    edges = table(spark, d, "part").filter("p_partkey > 0").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("parent"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("ord"))
    return docs.tree_paths(edges, "0").select("id", "parent", "depth")


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_mktsegment = 'MACHINERY' THEN 'M' END, c_name) AS value FROM customer""")
def form_fill(spark, d):
    fields = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("value"))
    return docs.filled(fields, {"BUILDING": "B", "MACHINERY": "M", "unknown": "U"}).select("id", "value")


@query("""SELECT event_id, n_name AS author FROM events JOIN nation ON user_id = n_nationkey""")
def comments_with_authors(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("author_id"))
    return docs.with_authors(e, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("author_id"), F.col("n_name").alias("name"))).select("event_id", "author")


@query("""SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY octet_length(encode(text)), left_part, right_part) AS canonical FROM (SELECT doc_id, text, array_slice(encode(text), 1, 64) AS left_part, CASE WHEN octet_length(encode(text)) > 128 THEN array_slice(encode(text), octet_length(encode(text)) - 63, octet_length(encode(text))) END AS right_part FROM documents)""")
def doc_dedup_cheap(spark, d):
    return docs.likely_duplicates(table(spark, d, "documents"), "doc_id", F.col("text")).drop("key")


@query("""SELECT c_custkey, dense_rank() OVER (ORDER BY first) - 1 AS style FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_mktsegment, c_nationkey % 3) AS first FROM customer)""")
def style_interning(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 3).alias("third"))
    return docs.interned(c, ["c_mktsegment", "third"], "c_custkey")[0].select("c_custkey", "style")
