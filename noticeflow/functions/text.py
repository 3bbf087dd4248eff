"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What case folding changes in lower-case text, from Python's own rule: final sigma, long s, ligatures and the like.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.lower() == c != c.casefold() and not 0xD800 <= ord(c) < 0xE000}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
#: One character and what it becomes, comma by comma: one literal, whatever its length.
_MORE = ",".join(c + f for c, f in _FOLDS.items() if len(f) > 1)
_LONGER = "[" + "".join(c for c, f in _FOLDS.items() if len(f) > 1) + "]"


def casefold(c: Column) -> Column:
    """Full case folding: lower case, and for texts beyond ASCII what lower case leaves apart."""
    low = F.lower(c)
    plain = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
    each = F.reduce(F.split(F.lit(_MORE), ","), plain, lambda t, p: F.replace(t, F.left(p, F.lit(1)), F.substring(p, 2, 3)))
    full = F.when(plain.rlike(_LONGER), each).otherwise(plain)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(full)


def norm(c: Column) -> Column:
    """case-folded text with white space collapsed and trimmed. Null stays null."""
    return F.trim(F.regexp_replace(casefold(c), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """distinct word tokens of normalised text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(norm(c), F.lit(r"(?U)\w+"), F.lit(0)))


def clean_list(c: Column) -> Column:
    """trimmed, non-blank, distinct and sorted items; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")))


def decimal_text(c: Column) -> Column:
    """plain decimal text without trailing zeros."""
    s = c.cast("string")
    return F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def zoned_instant(c: Column) -> Column:
    """F8: timestamp of ISO text that names its zone; naive or malformed text is null."""
    return F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


def utc_text(instant: Column) -> Column:
    """An instant as yyyy-MM-ddTHH:mm:ss in UTC, whatever the session's zone."""
    seconds = F.unix_seconds(instant)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    left = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), two(left / 3600), F.lit(":"), two(left % 3600 / 60), F.lit(":"), two(left % 60))


def has_keyword(text: Column, keyword: str) -> Column:
    """whether normalised text holds the keyword between word borders."""
    needle = re.sub(r"\s+", " ", keyword.casefold()).strip()
    return norm(text).rlike(rf"(?U)(?<!\w)\Q{needle}\E(?!\w)")


def digit_bounded(text: Column, anchor: str) -> Column:
    """whether the anchor occurs and no digit touches it where it begins or ends with one."""
    left = r"(?<!\d)" if anchor[:1].isdigit() else ""
    right = r"(?!\d)" if anchor[-1:].isdigit() else ""
    return text.rlike(rf"{left}\Q{anchor}\E{right}")


def bounded(c: Column, digits: int = 5) -> Column:
    """clamped to [0, 1] and rounded half to even."""
    one, zero = F.lit(1).cast("decimal(1,0)"), F.lit(0).cast("decimal(1,0)")
    return F.bround(F.least(one, F.greatest(zero, c)).cast("decimal(20,12)"), digits).cast(f"decimal(8,{digits})")


def page_signals(text: Column, *, white: str = r"(?U)\s+", least_printable: float = 0.9) -> dict[str, Column]:
    """character counts, ratios, reasons and status of a page's text. Ratios are rounded as binary numbers, like a database's: 41 of 640 is 0.064062."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    dark = F.length(F.regexp_replace(t, white, ""))
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
    printable = chars - F.length(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", ""), r"[^\p{C}]+", ""))
    rounded = lambda x: F.round(x * 1e6) / 1e6
    p_ratio = F.when(chars > 0, printable / chars).otherwise(F.lit(0.0))
    a_ratio = F.when(dark > 0, alnum / dark).otherwise(F.lit(0.0))
    reasons = F.array_compact(
        F.array(
            F.when(dark == 0, "empty_text").when(dark < 20, "too_little_text"),
            F.when((chars > 0) & (p_ratio < least_printable), "low_printable_ratio"),
            F.when((dark > 0) & (a_ratio < 0.5), "low_alphanumeric_ratio"),
        )
    )
    return {
        "char_count": chars.cast("long"),
        "non_whitespace_chars": dark.cast("long"),
        "printable_ratio": rounded(p_ratio),
        "alphanumeric_ratio": rounded(a_ratio),
        "status": F.when(F.size(reasons) > 0, "needs_ocr").otherwise("trusted"),
        "reasons": reasons,
    }
