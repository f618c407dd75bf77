"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import dealt
from . import bpe, langid, licenses, media, mixing, quality, secrets, simhash, tokencount, warc

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
TOKEN_LIMIT = 4096


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return dealt(spark.read.parquet(path), path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": lambda spark, d: licenses.scan_licenses(documents(spark, d)),
    "op2_secret_scan": lambda spark, d: secrets.scan_secrets(documents(spark, d)),
    "op3_media_columns": lambda spark, d: media.media_features(documents(spark, d)),
    "op4_warc": lambda spark, d: warc.archived(table(spark, d, "pages")),
    "op5_token_counts": lambda spark, d: tokencount.token_counts(documents(spark, d), vocabulary(PIECES), TOKEN_LIMIT),
    "op6_language_id": lambda spark, d: langid.identify(documents(spark, d)),
    "op7_quality_rules": lambda spark, d: quality.quality(documents(spark, d)),
    "op8_simhash": lambda spark, d: simhash.simhash_classes(documents(spark, d)),
    "op9_mixing": lambda spark, d: mixing.mix(documents(spark, d)).select("doc_id", "size", "source_size", "target", "taken"),
    "op10_bpe": lambda spark, d: bpe.encode_digests(documents(spark, d), vocabulary(WORDS)),
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def license_sql() -> str:
    """Words as lists, base phrases by place, templates as regular expressions over the joined words."""
    texts = f"SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents"

    def places(phrase: str) -> str:
        match = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
        return f"list_filter(range(len(w)), lambda i: {match})"

    each = ", ".join(f"{places(p)} AS p{k}" for k, p in enumerate(licenses.BASE_PHRASES))
    labels = list(licenses.BASE_PHRASES.values())
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(labels))
    joined = "' ' || array_to_string(w, ' ') || ' '"
    more = ", ".join(f"CASE WHEN regexp_matches({joined}, '{licenses.as_regex(t)}') THEN '{label}' END" for label, t in licenses.TEMPLATES.items())
    every = "list_concat(" * (len(labels) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(labels)))
    tidy = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    return f"""
    WITH words AS ({texts}), found AS (SELECT doc_id, w, {each} FROM words),
    named AS (SELECT doc_id, len(w) AS n, {every} AS p, [{base}] AS b, [{more}] AS m FROM found)
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
      CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
      {tidy.format("b")} AS base_labels, {tidy.format("list_concat(b, m)")} AS labels,
      CASE WHEN len(list_filter(m, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
    FROM named"""


def quality_sql() -> str:
    """The same rules over unnested words, with the sketches as counts of bins."""
    q = quality
    measures = list(q.LEAST_REACH)
    percents = (q.LOW, q.MIDDLE, q.HIGH)

    def binned(m: str) -> str:
        shift = f"greatest(length(bin({m})) - 5, 0)"
        return f"(({m} >> {shift}) << {shift})"

    pairs = " UNION ALL ".join(f"SELECT lang_key, source_key, '{m}' AS measure, {binned(m)} AS bin FROM measured WHERE NOT base_failed" for m in measures)

    def level(name: str, keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        group = f"GROUP BY {keys}" if keys else ""
        lead = f"{keys}, " if keys else ""
        quantiles = ", ".join(f"min(bin) FILTER (WHERE upto * 100 >= total * {k}) AS q{k}" for k in percents)
        wide = ", ".join(f"max(q{k}) FILTER (WHERE measure = '{m}') AS {m}_q{k}" for m in measures for k in percents)
        return f"""{name}_bins AS (SELECT {by}, bin, count(*) AS n FROM pairs GROUP BY {by}, bin),
        {name}_run AS (SELECT {by}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {name}_bins),
        {name}_q AS (SELECT {by}, max(total) AS total, {quantiles} FROM {name}_run GROUP BY {by}),
        {name} AS (SELECT {lead}max(total) AS group_n, {wide} FROM {name}_q {group})"""

    def best(col: str) -> str:
        return f"CASE WHEN g.group_n >= {q.LEAST_GROUP} THEN g.{col} WHEN l.group_n >= {q.LEAST_GROUP} THEN l.{col} ELSE a.{col} END"

    limits = ", ".join(f"{best(f'{m}_q{k}')} AS {m}_q{k}" for m in measures for k in percents)
    inside = " AND ".join(f"m.{m} <= f.{m}_q{q.HIGH} + greatest(f.{m}_q{q.HIGH} - f.{m}_q{q.MIDDLE}, {r})" for m, r in q.LEAST_REACH.items())
    least = f"m.word_len >= f.word_len_q{q.LOW} - greatest(f.word_len_q{q.MIDDLE} - f.word_len_q{q.LOW}, {q.LEAST_REACH['word_len']})"
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, unnest(regexp_extract_all(t, '{word}')) AS word, generate_subscripts(regexp_extract_all(t, '{word}'), 1) AS i FROM d),
    g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
    t AS (SELECT rid, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS twice FROM g),
    c AS (SELECT rid, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM t),
    r AS (SELECT rid, sum(hit) AS n_repeat_words FROM c GROUP BY rid),
    f AS (SELECT d.rid, doc_id, lang, source, len(regexp_extract_all(t, '{word}')) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM d LEFT JOIN r ON d.rid = r.rid),
    measured AS (SELECT *, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed,
        CASE WHEN lang IS NULL THEN 'n' ELSE 's' || lang END AS lang_key, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        CAST(CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS BIGINT) AS word_len,
        CAST(CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS BIGINT) AS symbols,
        CAST(CASE WHEN len(lines) > 0 THEN 1000 * (len(lines) - len(list_distinct(lines))) // len(lines) ELSE 0 END AS BIGINT) AS dup_lines,
        CAST(CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS BIGINT) AS repeats FROM f),
    pairs AS ({pairs}),
    {level("g0", "lang_key, source_key")}, {level("l0", "lang_key")}, {level("a0", "")},
    fences AS (SELECT g.lang_key, g.source_key, {limits} FROM g0 g LEFT JOIN l0 l ON g.lang_key = l.lang_key LEFT JOIN a0 a ON true)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
      CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce({least} AND {inside}, true) AS kept
    FROM measured m LEFT JOIN fences f ON m.lang_key = f.lang_key AND m.source_key = f.source_key"""


#: The others hash, compress, learn, merge by a vocabulary or draw by chance; their tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_license_scan": license_sql(), "op7_quality_rules": quality_sql(), "op4_warc": """
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM (SELECT page_id, html, d AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM (
      SELECT page_id, html, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0b' || substr(bits, CAST(i * 5 + 1 AS BIGINT), 5)) AS INTEGER), 1)), 'string_agg', '') AS d FROM (
        SELECT page_id, html, list_aggregate(list_transform(range(20), lambda i: right('00000000' || bin(CAST('0x' || substr(sha1(coalesce(html, '')), CAST(i * 2 + 1 AS BIGINT), 2) AS INTEGER)), 8)), 'string_agg', '') AS bits FROM pages)))"""}
