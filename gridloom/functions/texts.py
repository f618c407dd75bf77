"""Text functions. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import num, whole
from .numberformat import custom_text, fixed_text, format_value
from .registry import function
from .values import ANY, BLANK, RANGE, TEXT, VALUE, Val, boolean, cell_text, errors_of, fails, first_cell, is_blank, merged, number, parse_number, text, to_bool, to_num, to_text


def txt(args: list[Val], i: int) -> Column:
    return to_text(args[i]) if i < len(args) else F.lit("")


def count_of(args: list[Val], i: int, default: float) -> Column:
    return F.greatest(whole(num(args, i, default)), F.lit(0.0)).cast("int")


def simple(names: str, fn, signature: str = "(text)") -> None:
    @function(names, "text", signature=signature)
    def build(args: list[Val]) -> Val:
        return text(fn(txt(args, 0)), errors_of(args))


simple("UPPER", F.upper)
simple("LOWER", F.lower)
simple("TRIM", lambda s: F.trim(F.regexp_replace(s, " +", " ")))
simple("CLEAN", lambda s: F.regexp_replace(s, r"\p{Cc}", ""))


def title(s: Column) -> Column:
    """Each run of letters, with apostrophes inside it, begins with a capital."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}[\p{L}\p{M}'\p{Nd}]*|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


simple("PROPER", title)


@function("LEN", "text", signature="(text)")
def length(args: list[Val]) -> Val:
    return number(F.length(txt(args, 0)), errors_of(args))


@function("LEFT", "text", signature="(text, [num_chars])")
def left(args: list[Val]) -> Val:
    return text(F.left(txt(args, 0), count_of(args, 1, 1)), errors_of(args))


@function("RIGHT", "text", signature="(text, [num_chars])")
def right(args: list[Val]) -> Val:
    return text(F.right(txt(args, 0), count_of(args, 1, 1)), errors_of(args))


@function("MID", "text", signature="(text, start_num, num_chars)")
def mid(args: list[Val]) -> Val:
    s, start, n = txt(args, 0), whole(num(args, 1)).cast("int"), whole(num(args, 2)).cast("int")
    return text(F.when((start >= 1) & (start <= F.length(s)) & (n >= 0), F.substr(s, start, F.greatest(n, F.lit(0)))).otherwise(""), errors_of(args))


@function("CONCATENATE CONCAT", "text", signature="(text1, [text2], ...)")
def concat(args: list[Val]) -> Val:
    each = [F.array_join(F.transform(a.col, cell_text), "") if a.kind == RANGE else to_text(a) for a in args]
    return text(F.concat(*each) if args else F.lit(""), errors_of(args))


@function("TEXTJOIN", "text", signature="(delimiter, ignore_empty, text1, ...)")
def text_join(args: list[Val]) -> Val:
    """Only blanks are left out, not empty texts."""
    skip = to_bool(args[1]) if len(args) > 1 else F.lit(False)
    if any(a.kind == RANGE for a in args[2:]):
        part = lambda s: F.when(~(skip & (s["kind"] == BLANK)), cell_text(s))
        lists = [F.transform(a.col, part) if a.kind == RANGE else F.array(F.when(~(skip & is_blank(a)), to_text(a))) for a in args[2:]]
        return text(F.call_function("array_join", F.filter(F.concat(*lists), lambda x: x.isNotNull()), txt(args, 0)), errors_of(args))
    parts = [F.when(skip & is_blank(a), F.lit(None)).otherwise(F.coalesce(to_text(a), F.lit(""))) for a in args[2:]]
    return text(joined(txt(args, 0), parts), errors_of(args))


def joined(delimiter: Column, parts: list[Column]) -> Column:
    """Parts that aren't null with the delimiter, itself a column, between them."""
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.aggregate(kept, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull(), b).otherwise(F.concat(a, delimiter, b)), lambda a: F.coalesce(a, F.lit("")))


@function("REPT", "text", signature="(text, number_times)")
def rept(args: list[Val]) -> Val:
    return text(F.repeat(txt(args, 0), count_of(args, 1, 0)), errors_of(args))


def found(args: list[Val], same_case: bool) -> Val:
    a, b = txt(args, 0), txt(args, 1)
    needle, hay = (a, b) if same_case else (F.lower(a), F.lower(b))
    start = F.greatest(whole(num(args, 2, 1)), F.lit(1.0)).cast("int")
    at = F.when(start > F.length(hay) + 1, 0).when(F.length(needle) == 0, start).otherwise(F.position(needle, hay, start))
    return number(F.when(at > 0, at), merged(errors_of(args), fails(at == 0, VALUE)))


@function("FIND", "text", signature="(find_text, within_text, [start])")
def find(args: list[Val]) -> Val:
    return found(args, True)


@function("SEARCH", "text", signature="(find_text, within_text, [start])")
def search(args: list[Val]) -> Val:
    return found(args, False)


def pieces(s: Column, old: Column) -> Column:
    """The text cut at each occurrence of a literal."""
    return F.split(s, F.concat(F.lit(r"\Q"), F.replace(old, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(-1))


def glued(parts: Column, by: Column) -> Column:
    return F.aggregate(parts, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull(), b).otherwise(F.concat(a, by, b)), lambda a: F.coalesce(a, F.lit("")))


@function("SUBSTITUTE", "text", signature="(text, old_text, new_text, [n])")
def substitute(args: list[Val]) -> Val:
    s, old, new = txt(args, 0), txt(args, 1), txt(args, 2)
    if len(args) < 4:
        return text(F.when(F.length(old) == 0, s).otherwise(F.replace(s, old, new)), errors_of(args))
    n, cut = whole(num(args, 3)).cast("int"), pieces(s, old)
    nth = F.concat(glued(F.slice(cut, F.lit(1), n), old), new, glued(F.slice(cut, n + 1, F.size(cut)), old))
    return text(F.when((F.length(old) == 0) | (n < 1) | (n >= F.size(cut)), s).otherwise(nth), errors_of(args))


@function("REPLACE", "text", signature="(old_text, start, num_chars, new_text)")
def replace(args: list[Val]) -> Val:
    s, start, n, new = txt(args, 0), whole(num(args, 1)).cast("int"), whole(num(args, 2)).cast("int"), txt(args, 3)
    begin = F.least(start - 1, F.length(s))
    out = F.concat(F.left(s, F.greatest(begin, F.lit(0))), new, F.substr(s, F.greatest(begin, F.lit(0)) + F.greatest(n, F.lit(0)) + 1))
    return text(F.when(start < 1, s).otherwise(out), errors_of(args))


@function("EXACT", "text", signature="(text1, text2)")
def exact(args: list[Val]) -> Val:
    return boolean(txt(args, 0) == txt(args, 1), errors_of(args))


def character(n: Column) -> Column:
    """The character of a code point, from its UTF-16 bytes."""
    p = n.cast("int")
    high, low = (p - 0x10000) / 1024, (p - 0x10000) % 1024
    four = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    return F.decode(F.unhex(F.when(p < 0x10000, four(p)).otherwise(F.concat(four(F.floor(high) + 0xD800), four(low + 0xDC00)))), "UTF-16BE")


@function("CHAR UNICHAR", "text", signature="(number)")
def char(args: list[Val]) -> Val:
    return text(character(whole(num(args, 0))), errors_of(args))


@function("CODE UNICODE", "text", signature="(text)")
def code(args: list[Val]) -> Val:
    return number(F.ascii(txt(args, 0)), errors_of(args))


@function("VALUE NUMBERVALUE", "text", signature="(text)")
def value(args: list[Val]) -> Val:
    """A text that is no number gives 0."""
    return number(F.coalesce(parse_number(txt(args, 0)), F.lit(0.0)), errors_of(args))


@function("TEXT", "text", signature="(value, format_text)")
def text_format(args: list[Val], literal: str | None = None) -> Val:
    """The format must be a literal: it is compiled once."""
    if literal is None:
        raise ValueError("the format of TEXT must be a literal")
    return text(format_value(num(args, 0), literal), errors_of(args))


@function("T", "text", signature="(value)")
def t(args: list[Val]) -> Val:
    if args and args[0].kind in (ANY, RANGE):
        s = args[0].col if args[0].kind == ANY else first_cell(args[0].col)
        return text(F.when(s["kind"] == TEXT, s["txt"]).otherwise(F.lit("")), errors_of(args))
    return text(F.coalesce(args[0].col, F.lit("")) if args and args[0].kind == TEXT else F.lit(""), errors_of(args))


@function("N", "text", signature="(value)")
def n(args: list[Val]) -> Val:
    return number(to_num(args[0]) if args else F.lit(0.0), errors_of(args))


def occurrence(args: list[Val], before: bool) -> Val:
    """Before the n-th delimiter stands only what follows the one before it; without an n-th, the whole text."""
    s, delimiter, k = txt(args, 0), txt(args, 1), whole(num(args, 2, 1)).cast("int")
    cut = pieces(s, delimiter)
    part = F.get(cut, k - 1) if before else glued(F.slice(cut, k + 1, F.size(cut)), delimiter)
    return text(F.when((k < 1) | (F.length(delimiter) == 0) | (k >= F.size(cut)), s).otherwise(part), errors_of(args))


@function("TEXTBEFORE", "text", signature="(text, delimiter, [instance])")
def text_before(args: list[Val]) -> Val:
    return occurrence(args, True)


@function("TEXTAFTER", "text", signature="(text, delimiter, [instance])")
def text_after(args: list[Val]) -> Val:
    return occurrence(args, False)


@function("DOLLAR", "text", signature="(number, [decimals])")
def dollar(args: list[Val], literal: float = 2) -> Val:
    x = num(args, 0)
    return text(F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), custom_text(F.abs(x), min(max(int(literal), 0), 10))), errors_of(args))


@function("FIXED", "text", signature="(number, [decimals], [no_commas])")
def fixed(args: list[Val], literal: float = 2) -> Val:
    x, d = num(args, 0), min(max(int(literal), 0), 30)
    plain = to_bool(args[2]) if len(args) > 2 else F.lit(False)
    return text(F.when(plain, fixed_text(x, d, False)).otherwise(custom_text(x, d)), errors_of(args))
