"""The tokenizer and number codecs as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{IsAlphabetic}][\p{IsAlphabetic}']*"


def lowered(word: Column) -> Column:
    """Each character lowered by itself: capital sigma never becomes the final form."""
    return F.when(word.contains("Σ"), F.array_join(F.transform(F.split(word, ""), F.lower), "")).otherwise(F.lower(word))


def terms(text: Column | str) -> Column:
    """Array of the lower-cased terms of a text, in order; null for null.

    Lowering a whole text is much cheaper than each of its words, and differs
    only where a capital sigma takes a final form or a dotted capital i becomes
    two characters.
    """
    text = F.col(text) if isinstance(text, str) else text
    found = lambda t: F.regexp_extract_all(t, F.lit(TERM), F.lit(0))
    return F.when(text.rlike("[Σİ]"), F.transform(found(text), lowered)).otherwise(found(F.lower(text)))


def raw_terms(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def characters_ignored(text: Column) -> Column:
    used = F.aggregate(raw_terms(text), F.lit(0), lambda n, t: n + F.length(t))
    return F.length(text) - used


def line_count(text: Column) -> Column:
    return 1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def vb_size(n: Column) -> Column:
    return sum(((n >= F.lit(1 << (7 * k))).cast("int") for k in range(1, 9)), F.lit(1))


def vb_hex(n: Column) -> Column:
    """Variable-byte code in hexadecimal: seven bits a byte, high groups first, the last byte marked by its top bit."""
    group = lambda i: F.call_function("shiftrightunsigned", n, F.lit(7 * i)).bitwiseAND(F.lit(127))
    low = F.lit(128).cast("bigint")
    for i in range(8):
        low = low.bitwiseOR(F.shiftleft(group(i), 8 * i))
    code = F.concat(F.lpad(F.hex(group(8)), 2, "0"), F.lpad(F.hex(low), 16, "0"))
    size = 2 * vb_size(n)
    return F.lower(F.substring(code, 19 - size, size))


def vb_number(code: Column) -> Column:
    """The number of one variable-byte code in hexadecimal."""
    padded = F.lpad(code, 18, "0")

    def number(start: int, octets: int) -> Column:
        """Seven bytes at most at a time: eight may have a sign."""
        held = F.conv(F.substring(padded, start, 2 * octets), 16, 10).cast("bigint")
        out = held.bitwiseAND(F.lit(127))
        for i in range(1, octets):
            out = out.bitwiseOR(F.shiftright(held, i).bitwiseAND(F.lit(127 << (7 * i))))
        return out

    return F.shiftleft(number(1, 2), 49).bitwiseOR(number(5, 7))
