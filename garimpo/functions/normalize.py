"""Normalisation of names and identifiers, as Column to Column functions.

Everything stays in the JVM. Character classes are written out (``WORD``,
``SPACE``) because Java, RE2 and Python disagree on the short forms. Null is the
empty string throughout: equality rules further on rely on '' = ''.
"""

from __future__ import annotations

import unicodedata as U
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

# Company suffixes, removed wherever they stand and in this order. Fixed values.
SUFFIXES = ("LTDA", "L T D A", "LTDA ME", "EIRELI", "E I R E L I", "ME", "M E", "EPP", "E P P", "SA", "S A", "SOCIEDADE LTDA", "EMPRESA INDIVIDUAL", "MICROEMPRESA")
# Words for a missing value in scored tables. Fixed values.
SCORE_NULLS = ("não informado", "nao informado", "n/a", "na", "-", "--", "")
# Words for a missing name in parsed text. Fixed values.
PARSE_NAME_NULLS = ("null", "none", "n/a", "não disponível", "não informado", "-", "na", "nd")
# Words for a missing document of a partner: by the schema, and by the check after it. Fixed values.
SCHEMA_DOC_NULLS = ("", "n/a", "não disponível", "não informado", "-", "na", "nd")
POST_DOC_NULLS = ("n/a", "não disponível", "não informado", "-", "")
# File extensions dropped from document names. Fixed values.
EXTENSIONS = ("pdf", "jpg", "png", "docx", "doc", "txt")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def strip(x: Column | str) -> Column:
    """All white space off both ends, not only U+0020."""
    return F.regexp_replace(text_or_empty(x), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(x), rf"[{SPACE}]+", " "))


@lru_cache(1)
def accent_map() -> tuple[str, str]:
    """Letters of the basic plane that are one base letter and marks, and their base letters."""
    a, b = [], []
    for n in range(0xC0, 0x10000):
        if 0xD800 <= n <= 0xF8FF or 0xAC00 <= n <= 0xD7A3:
            continue
        base = "".join(c for c in U.normalize("NFD", chr(n)) if U.category(c) != "Mn")
        if len(base) == 1 and base != chr(n):
            a.append(chr(n))
            b.append(base)
    return "".join(a), "".join(b)


def strip_accents(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(x), *accent_map()), r"\p{Mn}", "")


def normalize_text(x: Column | str) -> Column:
    """Upper case without accents and punctuation, single spaces."""
    return collapse(F.upper(F.regexp_replace(strip_accents(text_or_empty(x)), rf"[^{WORD}{SPACE}]", " ")))


def digits(x: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(x), "[^0-9]", "")


def is_null_word(x: Column | str, words: tuple[str, ...] = SCORE_NULLS) -> Column:
    return F.lower(strip(x)).isin(*words)


def normalize_identifier(x: Column | str) -> Column:
    """Digits of a CNPJ or CPF; empty for null words and for anything with an e, as in scientific notation."""
    v = text_or_empty(x)
    return F.when(is_null_word(v) | F.contains(F.lower(v), F.lit("e")), "").otherwise(digits(v))


def normalize_rg(x: Column | str, null_words: bool = True) -> Column:
    v = text_or_empty(x)
    out = F.upper(F.regexp_replace(v, rf"[^{WORD}]", ""))
    return F.when(is_null_word(v), "").otherwise(out) if null_words else out


def normalize_doc_id(x: Column | str) -> Column:
    """Digits of a file name without its extension. Different names can collide; kept so."""
    return digits(F.regexp_replace(strip(x), rf"(?i)\.({'|'.join(EXTENSIONS)})$", ""))


def strip_suffixes(x: Column | str) -> Column:
    """Company suffixes removed as substrings, in order; spaces collapsed at the end."""
    return collapse(reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SUFFIXES, F.upper(_c(x))))


def company_name(x: Column | str) -> Column:
    return strip_suffixes(normalize_text(x))


def sanitize(x: Column | str) -> Column:
    """Commas as ' -', so that a name fits into delimited text."""
    return F.replace(text_or_empty(x), F.lit(","), F.lit(" -"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
