"""Criteria such as ">15" or "<>x": compiled once from a literal into a predicate over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import ANY, BOOLEAN, NUMBER, TEXT, Val, countable_cell, lit, to_num, to_text

SIGNS = ("<>", ">=", "<=", ">", "<", "=")


def as_number(s: str) -> float | None:
    try:
        return float(s.replace(",", "")) if s.strip() and s.strip().lower() not in ("nan", "inf", "-inf", "infinity", "-infinity") else None
    except ValueError:
        return None


def compared(a: Column, sign: str, b) -> Column:
    return {"<>": a != b, ">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "=": a == b}[sign]


def criterion(cell: Val, wanted: object) -> Column:
    """Whether a cell meets a criterion.

    A text may begin with a sign. Behind a sign, a number is compared with number and boolean cells as such; otherwise
    texts are compared without regard to case (so a text cell meets ">15" by its letters, and a blank meets "<>5").
    There are no wildcards. Any other criterion is compared with the cell as a number, blanks and texts that are none
    being 0.
    """
    if not isinstance(wanted, str):
        return to_num(cell) == to_num(lit(wanted))
    sign = next((s for s in SIGNS if wanted.startswith(s)), "")
    operand = wanted[len(sign) :]
    as_text = compared(F.upper(to_text(cell)), sign or "=", F.lit(operand.upper()))
    n = as_number(operand) if sign else None
    if n is None or cell.kind not in (NUMBER, BOOLEAN, ANY):
        return as_text
    if cell.kind == ANY:
        return F.when(countable_cell(cell.col), compared(to_num(cell), sign, F.lit(n))).otherwise(as_text)
    as_numbers = compared(to_num(cell), sign, F.lit(n))
    return as_numbers & cell.col.isNotNull() if sign != "<>" else as_numbers | cell.col.isNull()


def criterion_of(cell: Val, wanted: Val) -> Column:
    """The same for a criterion that is an expression: its sign and its operand are read where it is evaluated."""
    if wanted.kind != TEXT:
        return to_num(cell) == to_num(wanted)
    text = to_text(wanted)
    sign = F.regexp_extract(text, "^(<>|>=|<=|>|<|=)", 1)
    operand = F.substr(text, F.length(sign) + 1)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    chain = lambda a, b: F.when(sign == "", a == b).when(sign == "<>", a != b).when(sign == ">=", a >= b).when(sign == "<=", a <= b).when(sign == ">", a > b).when(sign == "<", a < b).otherwise(a == b)
    by_sign = lambda a, b: let(a, lambda x: let(b, lambda y: chain(x, y)))
    as_text = by_sign(F.upper(to_text(cell)), F.upper(operand))
    if cell.kind not in (NUMBER, BOOLEAN, ANY):
        return as_text
    n = F.when(operand.rlike(r"^\s*[-+]?[\d.,]"), F.replace(operand, F.lit(","), F.lit("")).try_cast("double"))
    as_number = by_sign(to_num(cell), n)
    if cell.kind == ANY:
        return F.when((sign == "") | n.isNull() | ~countable_cell(cell.col), as_text).otherwise(as_number)
    as_number = F.when(sign == "<>", as_number | cell.col.isNull()).otherwise(as_number & cell.col.isNotNull())
    return F.when((sign == "") | n.isNull(), as_text).otherwise(as_number)
