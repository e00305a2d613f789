"""Number, unit and period functions as Column expressions."""

from __future__ import annotations

import ast
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.folding import nfkc

#: Scale words of unit captions, and their factors.
SCALES = {"thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000, "billion": 1_000_000_000}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
HAN_DIGITS, ARABIC = "〇零一二三四五六七八九", "00123456789"


def parse_number(c: Column, thousands: str = ",", decimal: str = ".", paren: bool = True) -> Column:
    """A printed figure as decimal(28,4), null if it is none: brackets and a minus on either side negate."""
    s = F.trim(F.translate(c, "−–", "--"))
    bracketed = s.rlike(r"^\(.*\)$") if paren else F.lit(False)
    s = F.when(bracketed, F.trim(F.regexp_replace(s, r"^\((.*)\)$", "$1"))).otherwise(s)
    negative = bracketed | s.startswith("-") | s.endswith("-")
    s = F.regexp_replace(F.regexp_replace(s, r"^-|-$", ""), r"[^0-9.,'\s]", "")
    s = F.trim(s)
    whole = F.when(s.endswith(thousands), None).otherwise(F.translate(s, thousands, ""))
    plain = whole if decimal == "." else F.translate(whole, decimal, ".")
    magnitude = F.when(plain.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain).try_cast("decimal(28,4)")
    return F.when(negative, -magnitude).otherwise(magnitude).cast("decimal(28,4)")


def scale_of(c: Column) -> Column:
    """The factor of the scale word that comes first, or 1."""
    low, best = F.lower(c), None
    found = F.array(*[F.struct(F.when(F.instr(low, w) > 0, F.instr(low, w)).alias("at"), F.lit(k).alias("factor")) for w, k in SCALES.items()])
    best = F.array_min(F.filter(found, lambda x: x["at"].isNotNull()))
    return F.coalesce(best["factor"], F.lit(1)).cast("long")


def han_number(c: Column) -> Column:
    """A number in Han numerals: 二零二三 is 2023, 十二 is 12, 三十一 is 31."""
    digits = lambda x: F.translate(x, HAN_DIGITS, ARABIC).try_cast("int")
    tens, ones = F.substring_index(c, "十", 1), F.substring_index(c, "十", -1)
    composed = F.when(tens == "", 1).otherwise(F.coalesce(digits(tens), F.lit(1))) * 10 + F.when(ones == "", 0).otherwise(F.coalesce(digits(ones), F.lit(0)))
    return F.when(c == "", None).when(c.contains("十"), composed).otherwise(digits(c))


def period_date(c: Column) -> Column:
    """struct(y, m, d) of a heading in words, in Han numerals or in figures; parts that aren't named are 0, null without a year."""
    t = nfkc(c)
    low, han = F.lower(t), "[〇零一二三四五六七八九十]"
    got = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    year = F.coalesce(got(r"((?:19|20)[0-9]{2})").cast("int"), han_number(got(f"({han}{{2,4}})年")), F.lit(0))
    month = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MONTHS, 1))):
        month = F.when(low.contains(name), i).otherwise(month)
    month = F.coalesce(han_number(got(f"({han}{{1,3}})月")), month, got(r"([0-9]{1,2})\s*月").cast("int"), F.lit(0))
    day = F.coalesce(han_number(got(f"({han}{{1,3}})日")), got(r"([0-9]{1,2})\s*日").cast("int"), got(r"(?i)\b([0-9]{1,2})(?:st|nd|rd|th)?\s+(?=[a-z])").cast("int"), F.lit(0))
    part = lambda k: F.nullif(F.regexp_extract(t, r"\b([0-9]{1,4})[./-]([0-9]{1,2})[./-]([0-9]{1,4})\b", k), F.lit("")).cast("int")
    figures = (month == 0) & part(1).isNotNull()
    day = F.when(figures, F.when(part(1) > 31, part(3)).otherwise(part(1))).otherwise(day)
    month = F.when(figures, part(2)).otherwise(month)
    return F.when(year > 0, F.struct(year.alias("y"), month.alias("m"), day.alias("d")))


def column_letters(c: Column) -> Column:
    """A spreadsheet column's letters from its number (from 0)."""
    n, out = c + 1, F.lit("")
    for _ in range(3):
        out = F.when(n > 0, F.concat(F.chr(((n - 1) % 26 + 65).cast("long")), out)).otherwise(out)
        n = F.floor((n - 1) / 26)
    return out


def column_number(c: Column) -> Column:
    """The inverse of column_letters(); null for anything but letters."""
    return F.when(c.rlike("^[A-Z]{1,3}$"), F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1)


def confidence(ocr: Column, structure: Column, mapping: Column, validation: Column) -> Column:
    """The product, rounded to 4 places; a missing validation doesn't count."""
    return F.round(ocr * structure * mapping * F.coalesce(validation, F.lit(1.0)), 4)


FUNCTIONS = {
    "SUM": lambda *x: sum(x[1:], x[0]),
    "AVG": lambda *x: sum(x[1:], x[0]) / F.lit(float(len(x))),
    "MIN": lambda *x: F.least(*x) if len(x) > 1 else x[0],
    "MAX": lambda *x: F.greatest(*x) if len(x) > 1 else x[0],
    "ABS": lambda x: F.abs(x),
    "ROUND": lambda x, n=None: F.round(x, int(n) if n is not None else 0),
}


def formula(text: str) -> Column:
    """A spreadsheet formula over columns: + - * /, signs, SUM AVG MIN MAX ABS ROUND. Anything else is a ValueError; x / 0 is null."""

    def walk(e):
        if isinstance(e, ast.BinOp):
            a, b = walk(e.left), walk(e.right)
            if isinstance(e.op, ast.Add):
                return a + b
            if isinstance(e.op, ast.Sub):
                return a - b
            if isinstance(e.op, ast.Mult):
                return a * b
            if isinstance(e.op, ast.Div):
                return F.try_divide(a, b)
        elif isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub | ast.UAdd):
            return -walk(e.operand) if isinstance(e.op, ast.USub) else walk(e.operand)
        elif isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id.upper() in FUNCTIONS and not e.keywords:
            name = e.func.id.upper()
            if name == "ROUND":
                return FUNCTIONS[name](walk(e.args[0]), *(ast.literal_eval(x) for x in e.args[1:]))
            return FUNCTIONS[name](*map(walk, e.args))
        elif isinstance(e, ast.Name):
            return F.col(e.id)
        elif isinstance(e, ast.Constant) and isinstance(e.value, int | float) and not isinstance(e.value, bool):
            return F.lit(float(Decimal(str(e.value))))
        raise ValueError(f"not allowed in a formula: {ast.dump(e)[:60]}")

    try:
        tree = ast.parse(text.lstrip("= "), mode="eval")
    except SyntaxError as e:
        raise ValueError(str(e)) from e
    return walk(tree.body)


def printed_sign(caption: Column, value: Column, flip: Column, done: Column) -> Column:
    """Less: minus the amount, Add: plus the amount; then a concept's flip; a figure whose sign was set before stays."""
    low = F.lower(F.trim(caption))
    signed = F.when(low.startswith("less"), -F.abs(value)).when(low.startswith("add"), F.abs(value)).otherwise(value)
    return F.when(done, value).when(flip, -signed).otherwise(signed)


def parse_rate(c: Column) -> Column:
    """A positive, finite rate, or null."""
    rate = F.trim(c).try_cast("decimal(38,18)")
    return F.when(rate > 0, rate)


def note_sort(c: Column) -> Column:
    """A key that sorts note numbers by number, then letter."""
    return F.struct(F.coalesce(F.regexp_extract(c, "^([0-9]+)", 1).try_cast("int"), F.lit(10**9)).alias("n"), F.regexp_extract(c, "([a-z]*)[)]?$", 1).alias("s"))
