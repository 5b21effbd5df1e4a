"""Untrusted text as columns: escapes for terminals, spreadsheets, Markdown and HTML; Unicode case folding."""

from __future__ import annotations

import string
import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_TEXT = 200
CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def clean_text(text: Column) -> Column:
    """Control characters as \\xNN. Only rows that have one are taken apart."""
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")
    escape = lambda c: F.when(c.rlike(CONTROL), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(point(c)), 2, "0")))).otherwise(c)
    return F.when(text.rlike(CONTROL), F.array_join(F.transform(F.split(text, ""), escape), "")).otherwise(text)


def safe_csv_cell(text: Column) -> Column:
    """A ' before text that a spreadsheet would run as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def single_line(text: Column) -> Column:
    """Line breaks and tabs as blanks, other control characters as \\xNN, runs of blanks as one, none at the ends."""
    flat = clean_text(F.translate(text, "\r\n\t", "   "))
    return F.btrim(F.regexp_replace(flat, r"[\s   -     　]+", " "))


def md_escape(text: Column) -> Column:
    """Text for a Markdown table cell."""
    html = F.replace(F.replace(F.replace(single_line(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(html, r"([\\`*_\[\]|!#~])", r"\\$1")


def html_escape(text: Column) -> Column:
    """Text for an HTML element or attribute."""
    out = single_line(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def shortened(text: Column, most: int = SHORT_TEXT) -> Column:
    """At most `most` characters, and `...` if some are missing. Line ends at the end don't count."""
    t = F.rtrim(text, F.lit("\r\n"))
    return F.when(F.char_length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)


@cache
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters beyond ASCII that fold to one other character, what they fold to, and those that fold to several."""
    folded = [(c, c.casefold()) for c in map(chr, range(128, sys.maxunicode + 1)) if c.casefold() != c]
    single = [(c, f) for c, f in folded if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), [(c, f) for c, f in folded if len(f) > 1]


def casefold(text: Column) -> Column:
    """Unicode case folding, as Python's str.casefold; lower() for texts of ASCII, which is the same there."""
    single, to, several = _folds()
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in several])
    some = text.rlike("[" + "".join(c for c, _ in several) + "]")
    spread = F.when(some, F.aggregate(pairs, text, lambda t, x: F.replace(t, x["c"], x["f"]))).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(spread, string.ascii_uppercase + single, string.ascii_lowercase + to)).otherwise(F.lower(text))
