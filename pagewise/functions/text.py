"""Text feature expressions as native Spark ``Column``s.

All helpers build JVM-side expressions (regex, translate, trim), so they stay
inside whole-stage code generation; no Python runs per row.

Unicode semantics follow Python's ``str`` methods, which the layout features
are defined by: ``\\d`` is any decimal digit (``\\p{Nd}``), ``\\w`` is a letter,
number or underscore, and whitespace is the set ``str.isspace`` accepts.
Java regex classes are ASCII-only by default, so the classes are spelled out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace set (str.isspace / str.split / str.strip), built by rule.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def _char_class(chars: str) -> str:
    """Regex class body (no brackets) for a set of code points, using
    ``\\x{..}`` escapes and ranges; valid in Java regex and RE2 alike."""
    cps = sorted(ord(c) for c in chars)
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return "".join(parts)


WS = _char_class(PY_WHITESPACE)          # class body for whitespace
WS_CLASS = f"[{WS}]"
NON_WS_CLASS = f"[^{WS}]"
DIGIT = r"\p{Nd}"
WORD_CLASS = r"[\p{L}\p{N}_]"

# The 32 ASCII punctuation characters counted by percent_punct
# (Python's string.punctuation).
PUNCTUATION = string.punctuation

# Font-name fragments that mark weight 2 and weight 1.
HEAVY_FONT_MARKS = ("black", "heavy")
BOLD_FONT_MARKS = ("bold",)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: trim every whitespace code point at both ends."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def num_words(col) -> Column:
    """``len(text.split())``: number of maximal non-whitespace runs.

    Counted by plain replacements, as a regex that matches every word takes
    ten times as long: each blank becomes two marks, and the pairs that meet
    inside a run of blanks go, so one mark a run is left."""
    t = F.translate(_c(col), PY_WHITESPACE + "\x01\x02", " " * len(PY_WHITESPACE) + "xx")
    t = F.btrim(t, F.lit(" "))
    runs = F.replace(F.replace(t, F.lit(" "), F.lit("\x01\x02")), F.lit("\x02\x01"), F.lit(""))
    between = F.octet_length(runs) - F.octet_length(F.replace(runs, F.lit("\x01"), F.lit("")))
    return F.coalesce(between + (F.octet_length(t) > 0).cast("int"), F.lit(0))  # no branch: each step runs once


def text_length(col) -> Column:
    """Number of code points (Python ``len``)."""
    return F.length(_c(col)).cast("int")


def is_upper(col) -> Column:
    """Python ``str.isupper()``: at least one uppercase character and no
    lowercase or titlecase character."""
    c = _c(col)
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]")


def is_all_caps(col, length_of=None) -> Column:
    """1 when the text is upper case and ``length_of`` (default: the text
    itself) is longer than one code point."""
    c = _c(col)
    ln = F.length(_c(length_of) if length_of is not None else c)
    return F.when(F.coalesce(is_upper(c), F.lit(False)) & (ln > 1), 1).otherwise(0).cast("int")


def numbering_depth(col) -> Column:
    """Parts of a leading ``\\d+(\\.\\d+)*`` (``'2.1 x'`` -> 2), else 0.
    The caller passes stripped text where the definition strips."""
    m = F.regexp_extract(_c(col), rf"^{DIGIT}+(?:\.{DIGIT}+)*", 0)
    return F.when(F.length(m) == 0, 0).otherwise(F.regexp_count(m, F.lit(r"\.")) + 1).cast("int")


def percent_punct(col) -> Column:
    """Share of ASCII punctuation code points; 0 for the empty string."""
    c = _c(col)
    n = F.length(c)
    kept = F.length(F.translate(c, PUNCTUATION, ""))
    return F.when(n > 0, (n - kept).cast("double") / n.cast("double")).otherwise(F.lit(0.0))


def font_weight(col) -> Column:
    """0 normal, 1 bold, 2 black/heavy (case-insensitive); null/'' -> 0."""
    n = F.lower(F.coalesce(_c(col), F.lit("")))
    heavy = None
    for mark in HEAVY_FONT_MARKS:
        cond = n.contains(mark)
        heavy = cond if heavy is None else (heavy | cond)
    bold = None
    for mark in BOLD_FONT_MARKS:
        cond = n.contains(mark)
        bold = cond if bold is None else (bold | cond)
    return F.when(heavy, 2).when(bold, 1).otherwise(0).cast("int")


def file_stem(col) -> Column:
    """Basename without its last extension (``os.path.splitext`` rules: a
    leading dot does not start an extension)."""
    base = F.regexp_extract(_c(col), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"^(.*[^.].*)\.[^.]*$", "$1")


def is_blank(col) -> Column:
    return F.length(py_strip(col)) == 0


def to_number(t: Column) -> Column:
    """A numeric string as a double, else null.  Spark's cast also takes Java's
    type suffixes (``1d``, ``2f``), which are no numbers here.  Only strings
    that begin as a number does are cast: a failed cast costs an exception."""
    t = F.trim(t)
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    suffix = last.isin(*"dDfF") & F.substring(t, -2, 1).isin(*"0123456789.") & (F.length(t) > 1)
    begins = (first <= " ") | first.isin(*"0123456789+-.") | F.lower(F.substring(t, 1, 3)).isin("inf", "nan")
    return F.when(begins & ~suffix, t.try_cast("double"))
