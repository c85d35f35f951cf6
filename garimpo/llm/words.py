"""Fast word splitting for whole corpora: a word is a run of letters and digits, without case and accents.

Text that Latin-1 can hold is encoded, mapped by a 256-entry table and split, all
in C. Other characters are resolved one by one in an encoding error handler, so
the result is the same for every script.
"""

from __future__ import annotations

import codecs
import re
import unicodedata as U
from functools import lru_cache

# Control characters that stand for the sixteen digits of an escaped letter; in the text itself they separate words.
_DIGITS = bytes([*range(0x01, 0x09), *range(0x0E, 0x16)])
_CONTROL = re.compile("[\x01-\x08\x0e-\x15]")


@lru_cache(1 << 16)
def plain(c: str) -> str:
    """One character without case and accents; '' for a combining mark, ' ' for a separator."""
    low = U.normalize("NFD", U.normalize("NFD", c).lower())
    kept = "".join(x for x in low if not U.combining(x))
    if not kept:
        return ""
    return kept if kept.isalnum() else " "


@lru_cache(1 << 16)
def _escaped(c: str) -> bytes:
    out = b""
    for x in plain(c):
        if x == " ":
            out += b" "
        elif ord(x) < 256:
            out += x.encode("latin-1")
        else:
            out += bytes(_DIGITS[int(h, 16)] for h in f"{ord(x):06x}")
    return out


def _handler(e: UnicodeEncodeError) -> tuple[bytes, int]:
    return b"".join(map(_escaped, e.object[e.start : e.end])), e.end


codecs.register_error("garimpo.words", _handler)


def _table(escapes: bool) -> bytes:
    out = bytearray(b" " * 256)
    for n in range(256):
        p = plain(chr(n))
        if len(p) == 1 and ord(p) < 256:
            out[n] = ord(p)
    if escapes:
        for n in _DIGITS:
            out[n] = n
    return bytes(out)


_PLAIN, _WITH_ESCAPES = _table(False), _table(True)


def normalised(text: str) -> bytes:
    """The words of the text in one-byte codes, separated by spaces."""
    try:
        return text.encode("latin-1").translate(_PLAIN)
    except UnicodeEncodeError:
        return _CONTROL.sub(" ", text).encode("latin-1", "garimpo.words").translate(_WITH_ESCAPES)


def words(text: str) -> list[bytes]:
    return normalised(text).split()


def spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the words in the text, in the order of ``words``; slower, for texts with something to report."""
    out, begin = [], -1
    for i, c in enumerate(text):
        p = plain(c)
        if p == "":
            continue
        if p == " ":
            if begin >= 0:
                out.append((begin, i))
            begin = -1
        elif begin < 0:
            begin = i
    if begin >= 0:
        out.append((begin, len(text)))
    return out
