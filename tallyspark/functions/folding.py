"""Letters to the plain forms that captions are compared in, as translation tables made by rule."""

from __future__ import annotations

import functools
import unicodedata

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[㐀-䶿一-鿿豈-﫿]"


@functools.lru_cache(1)
def simplified() -> dict[str, str]:
    """Traditional characters and the Simplified ones, by the transliteration rule of the ICU library that comes with Spark."""
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("the table of characters needs a Spark session")
    rule = context._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    chars = [chr(c) for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)) for c in range(a, b)]
    folded = rule.transliterate("\n".join(chars)).split("\n")
    return {a: b for a, b in zip(chars, folded, strict=True) if a != b and len(b) == 1}


@functools.lru_cache(1)
def unmarked() -> dict[str, str]:
    """Characters whose compatibility decomposition without its marks is one other character."""
    out = {}
    for code in range(0x80, 0xFFFE):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            out[chr(code)] = plain
    return out


#: Ligatures, which are several letters in plain form.
LIGATURES = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xFB00, 0xFB07)}
ASCII = r"^[\x00-\x7F]*$"


def _translated(c: Column, table: dict[str, str]) -> Column:
    return F.translate(c, "".join(table), "".join(table.values()))


def to_simplified(c: Column) -> Column:
    return _translated(c, simplified())


def folded(c: Column) -> Column:
    """Simplified characters, compatibility forms and accents folded to plain characters. Texts of ASCII alone are left as they are by callers."""
    for sign, letters in LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(letters))
    plain = unmarked()
    table = plain | {a: plain.get(b, b) for a, b in simplified().items()}
    return F.regexp_replace(_translated(c, table), r"\p{Mn}+", "")


def nfkc(c: Column) -> Column:
    """Compatibility forms of width and of digits to plain ones; accents stay."""
    return _translated(c, {a: b for a, b in unmarked().items() if unicodedata.normalize("NFKC", a) == b})
