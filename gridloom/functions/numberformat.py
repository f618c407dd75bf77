"""Number formats. A literal format code is compiled once, on the driver, into one Column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import from_serial, general

# The built-in format codes by id.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    44: '_("$"* #,##0.00_);_("$"* (#,##0.00);_("$"* "-"??_);_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}

UNQUOTED = re.compile(r'"[^"]*"|\[[^\]]*\]|\\.')


#: Whole numbers up to here are exact doubles; beyond it a number's fraction has no more digits to round.
EXACT = float(1 << 53)


def split(x):
    """A double as the sum of two halves of its bits; for a Column or a number."""
    c = x * 134217729.0
    high = c - (c - x)
    return high, x - high


def scaled(a: Column, decimals: int) -> Column:
    """a * 10 ** decimals as a whole number, a >= 0, rounded by a's exact binary value, an exact tie to even.

    The product and its rounding error together are exact, so a number just below a tie isn't raised.
    """
    power = float(10**decimals)
    y = a * power
    (ah, al), (ph, pl) = split(a), split(power)
    rest = ((ah * ph - y) + ah * pl + al * ph) + al * pl
    whole = F.floor(y)
    over = (y - whole - 0.5) + rest
    return whole + F.when((over > 0) | (over == 0) & (whole % 2 == 1), 1).otherwise(0)


def fixed_text(x: Column, decimals: int, grouped: bool, shift: int = 0) -> Column:
    """x * 10 ** shift with a fixed number of decimals; a negative number that rounds to zero keeps its sign."""
    a = F.abs(x)
    plain = F.format_string(f"%{',' if grouped else ''}.{decimals}f", x * float(10**shift))
    if decimals + shift > 15:
        return plain
    digits = F.lpad(scaled(a, decimals + shift).cast("string"), F.greatest(F.length(scaled(a, decimals + shift).cast("string")), F.lit(decimals + 1)), F.lit("0"))
    whole = F.left(digits, F.length(digits) - decimals)
    whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ",") if grouped else whole
    body = F.concat(whole, F.lit("."), F.right(digits, F.lit(decimals))) if decimals else whole
    small = a * float(10 ** (decimals + shift)) < EXACT
    return F.when(small, F.concat(F.when(x < 0, "-").otherwise(""), body)).otherwise(plain)


def custom_text(x: Column, decimals: int) -> Column:
    """Grouped, by a pattern of placeholders: of the number's first 15 digits, a tie away from zero."""
    return F.format_string(f"%,.{decimals}f", F.format_string("%.14e", x).cast("double"))


def is_date_code(section: str) -> bool:
    return re.search("[ydhsm]", UNQUOTED.sub("", section), re.I) is not None


def sections_of(code: str) -> list[str]:
    return re.findall(r'((?:"[^"]*"|[^;"])*)(?:;|$)', code)[: code.count(";") + 1]


def decimals_of(section: str) -> int:
    m = re.search(r"\.([0#]*)", section)
    return len(m[1]) if m else 0


class Section:
    """A numeric section taken apart: what stands before and behind its placeholders, and what they ask for."""

    def __init__(self, code: str):
        self.percent = "%" in code
        self.mantissa = re.split("E\\+", code, maxsplit=1, flags=re.I)[0]
        self.scientific = self.mantissa != code
        body = re.search("[0#?](?:.*[0#?])?", code, re.S)
        self.lead, self.tail = (self.literal(code[: body.start()]), self.literal(code[body.end() :])) if body else (self.literal(code), "")
        self.grouped = re.search("#,#|,0", code) is not None
        self.decimals = decimals_of(code)

    @staticmethod
    def literal(part: str) -> str:
        return re.sub(r'["\\]', "", part)


def numeric(x: Column, code: str) -> Column:
    """One section: percent (its sign is lost), scientific, or fixed with literals around it."""
    s = Section(code)
    if s.percent:
        return F.concat(fixed_text(F.abs(x), s.decimals, True, shift=2), F.lit("%"))
    if s.scientific:
        sci = F.format_string(f"%.{decimals_of(s.mantissa)}E", x)
        return F.regexp_replace(sci, r"E([+-])(\d\d)$", r"E$10$2")
    return F.concat(F.lit(s.lead), fixed_text(x, s.decimals, s.grouped), F.lit(s.tail))


def date_pattern(section: str) -> str:
    """The date code as a datetime pattern; m means minutes beside hours or seconds."""
    half = re.search("AM/PM|A/P", section, re.I) is not None
    tokens = re.findall(r'"[^"]*"|\[[^\]]*\]|\\.|AM/PM|A/P|y+|m+|d+|h+|s+|.', section, re.I)
    letters = [t[0].lower() if t[0].lower() in "ymdhs" else "" for t in tokens]
    out = []
    for i, (t, c) in enumerate(zip(tokens, letters, strict=True)):
        near = [x for x in letters[:i] if x][-1:] + [x for x in letters[i + 1 :] if x][:1]
        if c == "y":
            out.append("yyyy" if len(t) > 2 else "yy")
        elif c == "m" and ("h" in near[:1] and letters[:i].count("h") or "s" in near[-1:] and any(letters[i + 1 :])):
            out.append("mm" if len(t) > 1 else "m")
        elif c == "m":
            out.append({1: "M", 2: "MM", 3: "MMM"}.get(len(t), "MMMM"))
        elif c == "d":
            out.append({1: "d", 2: "dd", 3: "EEE"}.get(len(t), "EEEE"))
        elif c == "h":
            out.append(("h" if half else "H") * min(len(t), 2))
        elif c == "s":
            out.append("s" * min(len(t), 2))
        elif t.upper() in ("AM/PM", "A/P"):
            out.append("a")
        elif t[0] not in "[":
            word = t.strip('"') if t[0] == '"' else t[1:] if t[0] == "\\" else t
            out.append("'" + word.replace("'", "''") + "'" if word.isalpha() else word)
    return "".join(out)


def dated(x: Column, section: str) -> Column:
    return F.date_format(from_serial(x).cast("timestamp_ntz"), date_pattern(section))


def format_value(x: Column, code: str) -> Column:
    """A number by a format code of up to three sections: positive, negative (of the magnitude) and zero."""
    if not code or code.lower() == "general" or code == "@":
        return general(x)
    parts = sections_of(code)
    render = lambda c, s: dated(c, s) if is_date_code(s) else numeric(c, s)
    out = render(x, parts[0])
    if len(parts) > 2:
        out = F.when(x == 0, render(x, parts[2])).otherwise(out)
    if len(parts) > 1:
        out = F.when(x < 0, render(F.abs(x), parts[1])).otherwise(out)
    return out
