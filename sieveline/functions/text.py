"""Text normalisation, token counters and analyzers as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``str.strip`` removes, for one line.
_STRIP = r"[\s\x1c-\x1f\x85   -     　]+"
#: The plain letters stand first, for speed; nothing is given back, as nothing follows.
TERM = r"[a-zA-Z0-9_\p{L}\p{N}]++"
WORD_OR_SIGN = r"[a-zA-Z0-9_\p{L}\p{N}]++|[^\p{L}\p{N}_\s]"


def normalize_whitespace(text: Column) -> Column:
    """One kind of line end, single spaces, stripped lines, at most one blank line in a row."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[ \t\r\f\x0b]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, f"^{_STRIP}|{_STRIP}$", "")), "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, f"^{_STRIP}|{_STRIP}$", "")


def approx_tokens(text: Column) -> Column:
    """Estimated model tokens: words of six letters or more weigh a quarter of their length, half to even; all else 1."""
    n = lambda w: F.length(w)
    quarter = lambda w: F.shiftright(n(w) + F.lit(1) + F.shiftright(n(w), 2).bitwiseAND(1), 2)
    weight = lambda acc, w: acc + F.when(n(w) >= 6, quarter(w)).otherwise(F.lit(1))
    return F.aggregate(F.regexp_extract_all(text, F.lit(WORD_OR_SIGN), F.lit(0)), F.lit(0), weight)


def whitespace_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


TOKEN_COUNTERS: dict[str, Callable[[Column], Column]] = {"approx": approx_tokens, "whitespace": whitespace_tokens}


def simple_terms(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def preview(text: Column, chars: int = 160) -> Column:
    """One line for listings."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.rtrim(F.substring(flat, 1, chars - 1)), F.lit("…"))).otherwise(flat)


def file_type(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\.+", ""))
