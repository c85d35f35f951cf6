"""Problem 2: text that was decoded with the wrong character encoding.

Description lengths decide. For every language there is a zstandard dictionary;
the one that compresses the text best is used, and the length of a passage is the
number of bytes that it compresses to, as a mean over several levels. A chain
is a list of steps "these bytes are in encoding A but were read as B"; undoing it
gives another candidate text. Of all chains that the characters admit, the one
with the least total length of passages, plus a cost for stating the chain and
one for each passage it is applied to, is chosen; the passages stay as they are
if that is not shorter. After a chain is applied the rest is tried again, so a
text may hold places with different faults.

Only words with characters beyond ASCII can be affected. Distinct words are
looked up in a bounded memo of their candidate readings, so a clean text costs no
compression at all. Readings of UTF-8 must be valid UTF-8; readings of one-byte
encodings must consist of letters that the languages use, and are tried only for
words whose characters are odd as they stand (a sign or a capital inside a word,
or a character that the languages do not use), until some passage of the text
has given the chain away.

Lost bytes, U+FFFD or a question mark in place of a continuation byte, are read
like other bytes: the text with the letters that may have been there is chosen
if it is shorter to describe, their cost included. Of the readings that make a
known word the shortest is taken; where there is none, each place takes the
letter that compresses best among those around it, and U+FFFD stays. Such loads are
found but not counted as restored.

The dictionaries are trained on a bounded sample of labelled clean documents (at
most ``TRAIN_DOCS`` for each language, of at most ``TRAIN_BYTES`` each, least
hash of the id first) and a short seed text for each language, which alone
serves where there are no labelled documents.

Defined results: null, empty, blank and pure ASCII text is unchanged; a text of
any length is read whole; equal texts get equal results; an empty table gives
none; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bounds of the training sample: documents for each language, and bytes of a document.
TRAIN_DOCS = 600
TRAIN_BYTES = 1 << 16
#: Size of a dictionary, or a quarter of its sample where that is less.
DICT_BYTES = 1 << 16
LEVELS = (3, 9, 15)
#: Bytes that it costs to state a chain in a text: each UTF-8 step, a step between one-byte encodings, a filled-in letter.
UTF8_STEP, BYTE_STEP, FILL = 0.5, 1.0, 2.0
#: Bytes that it costs to apply a chain to one more passage.
PLACE = 0.25
#: Bytes that it costs to say of a passage that a chain applies to it.
STATED = 1.5
#: Bytes that an odd word costs as it stands, on top of its length, where the reading is valid UTF-8 or a known word.
ODD = 4.0
#: Bytes more that it costs where nothing but signs are read as letters, for they may be signs.
SIGN = 1.75
#: Marks a reading that counts only once its chain has been seen in the text.
HELD = -1.0
MEMO = 200_000

# Encodings that bytes were taken for, and the encodings of bytes taken for others. Fixed values.
READ_AS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-15", "cp1254")
ONE_BYTE = tuple(
    (a, b)
    for a, others in (("cp1252", ("mac_roman", "cp850", "cp437", "cp1251", "cp1250")), ("mac_roman", ("cp1252",)), ("cp850", ("cp1252",)))
    for b in others
)
#: Letters and signs beyond ASCII that one-byte readings may give.
LETTERS = frozenset("áàâãäéêíóôõúüçñÁÀÂÃÉÊÍÓÔÕÚÜÇÑªº«»°§¿¡")
SIGNS = frozenset("ªº«»°§¿¡")
#: Marks and signs that one-byte readings may give besides.
OTHERS = frozenset("–—‘’“”…€£¢¥½±")
SEEDS = {
    "pt": "A empresa não apresentou certidão, razão pela qual se impõe a notificação. Ação, decisão, conclusão, seção, sócio, sócia, sócios, cônjuge, "
    "também, já, só, é, há, às, à, até, você, após, três, mês, público, responsável, possível, específica, princípio, prejuízo, município, cláusula, "
    "âmbito, crédito, débito, número, único, última, técnica, jurídica, econômica, obrigações, condições, alegações, informações, João, José, Antônio, São, irmã, mãe, avô, avó.",
    "es": "La compañía no presentó la certificación, razón por la cual se impone la notificación. Acción, decisión, sesión, también, ya, sólo, está, más, "
    "después, según, público, artículo, cláusula, número, único, última, técnica, jurídica, económica, año, señor, niño, ¿quién?, José, María, título, crédito.",
    "en": "The company did not present the certificate, which is why notice is due. The parties agree that the café, the naïve façade and the résumé remain as they were.",
}


def _sloppy(name: str) -> str:
    """The 256 characters of an encoding; undefined bytes are read as control characters."""
    out = []
    for n in range(256):
        try:
            out.append(bytes([n]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(n))
    return "".join(out)


class Charset:
    """One-byte encoding with exact inverse; Latin-1 control characters are accepted for what cp1252 has in their place."""

    def __init__(self, name: str) -> None:
        self.name, self.table = name, _sloppy(name)
        self.bytes = {c: n for n, c in reversed(list(enumerate(self.table)))}
        if name in ("cp1252", "iso8859-15", "cp1254"):
            for n in range(0x80, 0xA0):
                self.bytes.setdefault(chr(n), n)

    def encode(self, text: str) -> bytes | None:
        try:
            return bytes([self.bytes[c] for c in text])
        except KeyError:
            return None

    def of(self, a: int, b: int) -> str:
        return "".join(re.escape(c) for c, n in self.bytes.items() if a <= n <= b)


@lru_cache(None)
def charset(name: str) -> Charset:
    return Charset(name)


class Utf8Step:
    """UTF-8 bytes read as ``name``: every well-formed sequence in a word is undone."""

    def __init__(self, name: str) -> None:
        c = self.set = charset(name)
        self.label = f"utf-8>{name}"
        self.cost = UTF8_STEP
        tail = f"[{c.of(0x80, 0xBF)}]"
        self.pattern = re.compile(f"[{c.of(0xC2, 0xDF)}]{tail}|[{c.of(0xE0, 0xEF)}]{tail}{{2}}|[{c.of(0xF0, 0xF4)}]{tail}{{3}}")

    def undo(self, word: str) -> str | None:
        def one(m: re.Match) -> str:
            try:
                got = self.set.encode(m[0]).decode("utf-8")
            except (UnicodeDecodeError, AttributeError):
                return m[0]
            return got if got.isprintable() or got in "\xa0\xad" or 0x80 <= ord(got) < 0xA0 else m[0]

        got = self.pattern.sub(one, word)
        return None if got == word else got


class ByteStep:
    """Bytes in ``a`` read as ``b``, both one-byte encodings."""

    def __init__(self, a: str, b: str) -> None:
        self.label, self.right, self.wrong = f"{a}>{b}", a, b
        self.cost = BYTE_STEP
        to, of = charset(a).table, charset(b).bytes
        self.map = {c: to[n] for c, n in of.items() if n >= 0x80 and (to[n] in LETTERS or to[n] in OTHERS)}

    def undo(self, word: str) -> str | None:
        out = []
        for c in word:
            if c >= "\x80":
                c = self.map.get(c)
                if c is None:
                    return None
            out.append(c)
        got = "".join(out)
        return None if got == word else got


@lru_cache(1)
def steps() -> tuple[list[Utf8Step], list[ByteStep]]:
    return [Utf8Step(b) for b in READ_AS], [ByteStep(a, b) for a, b in ONE_BYTE]


def _by_chance(word: str, reading: str) -> bool:
    """Whether a quotation mark and a letter, or pieces of a frame, may be the bytes of a letter of another script by chance."""
    return (any(c in "‘’“”" for c in word) or all("\u2500" <= c <= "\u259f" for c in word)) and any(c > "\u036f" and not "\u2000" <= c < "\u2c00" for c in reading)


def readings(word: str) -> list[tuple[tuple[str, ...], float, str]]:
    """(chain, cost, text) of every reading of a word other than itself.

    Of several chains to one text the first counts, and each that repeats one step.
    """
    utf8, byte = steps()
    out: list[tuple[tuple[str, ...], float, str]] = []
    seen = {word}
    level = [((), 0.0, word)]
    while level:  # every step shortens the word
        after = []
        for chain, cost, text in level:
            for s in utf8:
                got = s.undo(text)
                if got is not None and got != word and (got not in seen or {*chain, s.label} == {s.label}):
                    seen.add(got)
                    after.append((chain + (s.label,), cost + s.cost, got))
        out += [(c, HELD if _by_chance(word, got) else k, got) for c, k, got in after]
        level = after
    # a mark at the end of a word is a mark of the text until its chain has been seen
    strange = word[0] not in TYPOGRAPHIC and word[-1] not in TYPOGRAPHIC and (odd(word) or _INNER.search(word))
    sign = not any(c.isalnum() or c in LETTERS or c in OTHERS for c in word)
    for s in byte:
        got = s.undo(word)
        if got is not None and got not in seen and not odd(got) and not _RUNS.search(got):
            seen.add(got)
            out.append(((s.label,), s.cost if strange or sign and got.isalpha() else HELD, got))
    return out


# Marks and signs that are usual in any text. Fixed values.
TYPOGRAPHIC = "–—‘’“”…€£"
_INNER = re.compile(f"[^\\W\\d_][{TYPOGRAPHIC}][^\\W\\d_]")


def odd(word: str) -> bool:
    """Whether a word has characters that a well-decoded one would not have where they stand."""
    for i, c in enumerate(word):
        if c < "\x80" or c in TYPOGRAPHIC:
            continue
        if c not in LETTERS:
            if c.isalpha() or word[i - 1 : i].isalpha() or word[i + 1 : i + 2].isalpha():
                return True
            if "\u2500" <= c <= "\u259f" and (word[i - 1 : i].isdigit() or word[i + 1 : i + 2].isdigit()):
                return True  # a piece of a frame at a number
            continue  # a sign by itself
        if c.islower() and c not in SIGNS and word[i + 1 : i + 2].isupper():
            return True
        inside = i > 0 and word[i - 1].isalpha() and word[i - 1] not in SIGNS
        if inside and (c in SIGNS and word[i + 1 : i + 2].isalpha() or c.isupper() and (word[i - 1].islower() or word[i + 1 : i + 2].islower())):
            return True
    return False


_RUNS = re.compile("[^\x00-\x7f]{3}")
_LOST = re.compile("[ÂÃ]\\?|â\\?[?\x80-\xbf€œž™š]|â€\\?|\ufffd")
# What lost bytes may have been. Fixed values.
_LETTERS, _MARKS = tuple("ãçéáíõóêúàâôüñ"), ("“", "”", "–", "’", "€", "—")
_TOKEN = re.compile(r"[^\x00-\x20]+[\x00-\x20]*|[\x00-\x20]+")
_END = re.compile(r"[.;!?\n\r\f][ \t\n\r\f]*\Z")
CHUNK_WORDS = 30
_RUN = re.compile(r"[^\x00-\x20]+")
#: What is read as one word: a stretch of letters, digits and characters beyond ASCII.
_WORD = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")


def passages(text: str) -> list[str]:
    """The text in sentences or lines of at most CHUNK_WORDS words."""
    out: list[str] = []
    now: list[str] = []
    for t in _TOKEN.findall(text):
        now.append(t)
        if len(now) >= CHUNK_WORDS or _END.search(t[-4:]):
            out.append("".join(now))
            now = []
    if now:
        out.append("".join(now))
    return out


class Repairer:
    """Finds and undoes wrong decodings, with the dictionaries of several languages."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        how = {"format": z.FORMAT_ZSTD1_MAGICLESS, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
        # several levels parse differently; their mean is less rough than one length in whole bytes
        self.compressors = [
            [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), compression_params=z.ZstdCompressionParameters.from_level(k, **how)) for k in LEVELS]
            for d in dictionaries.values()
        ]
        self.content = b"\n".join(dictionaries.values())
        self.plain = self.content.decode("utf-8", "ignore").lower()
        #: Known words that hold characters beyond ASCII, one in each line.
        known = sorted({w for t in self.plain.split() if not t.isascii() for w in [t.strip(".,;:!?\"'()[]“”‘«»")]})
        self.accented, self.longest = "\n".join(known), max(map(len, known), default=0)
        self.words: dict[str, bool] = {}
        self.memo: dict[bytes, list] = {}

    def known(self, word: str) -> bool:
        """Whether a dictionary has the word as such."""
        got = self.words.get(word)
        if got is None:
            bare = word.strip(".,;:!?()\"'“”«»").lower()
            ends = ("",) if len(bare) >= 3 else (" ", ".", ",")
            got = not bare.isascii() and any(f"{a}{bare}{b}".encode() in self.content for a in " (\n" for b in ends)
            if len(self.words) > MEMO:
                self.words.clear()
            self.words[word] = got
        return got

    def likely(self, word: str, reading: str, chunk: str) -> bool:
        """Whether a reading puts three characters that a dictionary has for three that none has, wherever it differs."""
        if len(word) != len(reading):
            return False
        p = chunk.find(word)
        before, after = chunk[p - 1 : p] or " ", chunk[p + len(word) : p + len(word) + 1] or " "
        a, b = f"{before}{word}{after}".lower(), f"{before}{reading}{after}".lower()
        return len(a) == len(b) and all(b[i - 1 : i + 2] in self.plain and a[i - 1 : i + 2] not in self.plain for i in range(1, len(a) - 1) if a[i] != b[i])

    def language(self, texts: list[str]) -> int:
        """The dictionary that describes these passages best."""
        b = [t.encode("utf-8", "replace") for t in texts]
        return min(range(len(self.compressors)), key=lambda k: sum([len(self.compressors[k][0].compress(x)) for x in b]))

    def length(self, text: str, language: int | None = None) -> float:
        b = text.encode("utf-8", "replace")
        if language is not None:
            return sum([len(c.compress(b)) for c in self.compressors[language]]) / len(LEVELS)
        return min(sum([len(c.compress(b)) for c in own]) for own in self.compressors) / len(LEVELS)

    def _readings(self, word: bytes) -> list:
        got = self.memo.get(word)
        if got is None:
            text = word.decode("utf-8", "replace")
            got = [(w, [(c, self._cost(w, k, g), g) for c, k, g in r]) for w in dict.fromkeys(_WORD.findall(text)) if not w.isascii() and (r := readings(w))]
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[word] = got
        return got

    def _cost(self, word: str, cost: float, reading: str) -> float:
        """A reading that is a known word, as the word itself is not, need not wait until its chain has been seen."""
        free = cost == HELD and word[0] not in TYPOGRAPHIC and word[-1] not in TYPOGRAPHIC and self.known(reading) and not self.known(word)
        return BYTE_STEP if free else cost

    def repair(self, text: str | None) -> tuple[str, list[str], int, bool] | None:
        """(restored text, chains, places, whether all of it is restored), or None for a text to be left as it is."""
        if not text or text.isascii():
            return None
        found: dict[str, list] = {}
        for w in set(text.encode("utf-8", "replace").split()):
            if not w.isascii():
                for word, r in self._readings(w):
                    found[word] = r
        chains: list[str] = []
        places, guessed, left = 0, False, False
        if any(k != HELD for r in found.values() for _, k, _ in r):
            chunks = passages(text)
            got = self._choose(chunks, found)
            if got:
                chunks, chains, places = got
                text, chains = self._whole(text, chunks, chains)
                left = self._garbled(text)
        if ("?" in text or "\ufffd" in text) and _LOST.search(text):
            filled, n = self._fill(text, bool(chains))
            if n:
                text, places = filled, places + n
                chains.append("?")
                guessed = True
        return (text, chains, places, not guessed and not left) if chains else None

    def _garbled(self, text: str) -> bool:
        """Whether an odd word is left that has a reading which is valid UTF-8 or a known word."""
        return any(
            k != HELD and odd(w) and not odd(g) and (c[0].startswith("utf-8") or self.known(g) or self.likely(w, g, text))
            for m in set(text.encode("utf-8", "replace").split())
            if not m.isascii()
            for w, got in self._readings(m)
            for c, k, g in got
        )

    def _whole(self, text: str, chunks: list[str], chains: list[str]) -> tuple[str, list[str]]:
        """The repaired passages, or the whole text undone at once by its first chain.

        For one step between one-byte encodings only. A chain that holds for the
        whole text need not be stated for each passage, which is taken off its
        length.
        """
        done = "".join(chunks)
        step = next((s for s in steps()[1] if s.label == chains[0]), None)
        raw = charset(step.wrong).encode(text) if step else None
        if raw is None:
            return done, chains
        whole = "".join([charset(step.right).table[n] for n in raw])
        k = self.language(chunks)
        before = set(passages(text))
        stated = STATED * sum(1 for c in chunks if c not in before)
        longer = sum(self.length(p, k) for p in passages(whole)) - sum(self.length(p, k) for p in chunks)
        return (whole, chains[:1]) if longer <= stated else (done, chains)

    def _apply(self, chunk: str, to: dict[str, str]) -> str:
        return _WORD.sub(lambda m: to.get(m[0], m[0]), chunk)

    def _choose(self, chunks: list[str], found: dict[str, list]) -> tuple[list[str], list[str], int] | None:
        chains: list[str] = []
        places, language = 0, None
        words = {w: {c: (k, g) for c, k, g in r} for w, r in found.items()}
        seen: set[str] = set()
        size = cache(lambda t: self.length(t, language))
        while (now := "".join(chunks)) not in seen:  # a reading may be longer than the odd word it undoes, so lengths alone don't exclude a circle
            seen.add(now)
            by: dict[tuple, dict[str, str]] = {}
            held: dict[tuple, dict[str, str]] = {}
            costs: dict[tuple, float] = {}
            for w, r in words.items():
                for c, (k, g) in r.items():
                    # what stands as a known word, or ends in a mark of the text, gives way to a known word only
                    if k == HELD and not c[0].startswith("utf-8") and (self.known(w) or w[0] in TYPOGRAPHIC or w[-1] in TYPOGRAPHIC) and not self.known(g):
                        continue
                    (held if k == HELD else by).setdefault(c, {})[w] = g
                    if k != HELD:
                        costs[c] = k
            if not by:
                break
            own = [{w for w in _WORD.findall(x) if w in words} for x in chunks]
            if language is None:
                language = self.language([chunks[i] for i, o in enumerate(own) if o])
            best, gain = None, 0.0
            for c, to in by.items():
                changed, total = {}, -costs[c]
                for i, o in enumerate(own):
                    if any(w in to for w in o):
                        got = self._apply(chunks[i], to)
                        less = size(chunks[i]) - size(got) - PLACE
                        if not any(x.isalnum() for w in o if w in to for x in w):
                            less -= SIGN
                        valid = c[0].startswith("utf-8")
                        less += ODD * sum(1 for w in o if w in to and odd(w) and not odd(to[w]) and (valid or self.known(to[w]) or self.likely(w, to[w], chunks[i])))
                        if less > 0:
                            changed[i] = got
                            total += less
                if total > gain:
                    best, gain = (c, changed), total
            if best is None:
                break
            c, changed = best
            every = by[c] | held.get(c, {})
            with_letters = {w: g for w, g in every.items() if any(x.isalpha() for x in w)}
            for i, o in enumerate(own) if c in held else ():
                if any(w in held[c] for w in o):
                    got = self._apply(chunks[i], with_letters if i in changed else every)
                    less = size(changed.get(i, chunks[i])) - size(got)
                    if less > 0 or less == 0 and i in changed:  # in an affected passage a tie goes to the chain
                        changed[i] = got
            by[c] = every
            for i, got in changed.items():
                places += sum(1 for w in own[i] if w in by[c])
                chunks[i] = got
            chains.append(" ".join(c))
            words = {}
            for i in [i for i, o in enumerate(own) if o]:
                for m in _RUN.findall(chunks[i]):
                    if not m.isascii():
                        for w, r in self._readings(m.encode("utf-8", "replace")):
                            words[w] = {x: (k, g) for x, k, g in r}
            for w in list(words):
                words[w].pop(c, None)
        return (chunks, chains, places) if chains else None

    def _fill(self, text: str, known: bool) -> tuple[str, int]:
        """Lost bytes, word by word: filled in where that is shorter; and how many places are affected."""
        out, at, n = [], 0, 0
        for m in _RUN.finditer(text):
            word = m[0]
            marks = list(_LOST.finditer(word)) if not word.isascii() else []
            if not marks:
                continue
            before, rest = text[max(0, m.start() - 30) : m.start()], text[m.end() : m.end() + 30]
            as_is = self.length(f"{before}{word}{rest}".lower())
            # odd as it stands: U+FFFD anywhere, a question mark inside a word or where a chain has been seen
            as_is += ODD * sum(1 for k in marks if k[0][0] == "\ufffd" or known or word[k.end() : k.end() + 1].isalpha())
            got, size, sure = self._lost(word, marks, before, rest)
            if as_is - size > FILL * len(marks):
                n += len(marks)
                if sure or "\ufffd" not in word:
                    out += [text[at : m.start()], got]
                    at = m.end()
        return "".join(out) + text[at:], n

    def _lost(self, word: str, marks: list[re.Match], before: str, rest: str) -> tuple[str, float, bool]:
        """The shortest reading of a word's lost bytes, its length with what is around it, and whether it is a known word."""
        begins = [0, *[k.end() for k in marks]]
        fixed = [word[a : k.start()] for a, k in zip(begins, marks)] + [word[begins[-1] :]]
        letters = "".join(fixed)
        options = []
        for i, k in enumerate(marks):
            some = _MARKS if k[0][0] in "â" else _LETTERS if k[0][0] in "ÂÃ" else ("", *_LETTERS, *_MARKS)
            upper = letters.isupper() or i == 0 and not fixed[0] and letters[1:2].isupper()
            options.append([x.upper() for x in some] if upper else list(some))

        def joined(filled: list[str]) -> str:
            return "".join(x for pair in zip(fixed, [*filled, ""]) for x in pair)

        def size(reading: str) -> float:
            return self.length(f"{before}{reading}{rest}".lower())

        # all known words that fit, however many marks there are; none is longer than the longest
        fits = set()
        if len(letters) <= self.longest and any(map(str.isalpha, letters)):
            bare = [f.lower() for f in fixed]
            bare[0], bare[-1] = bare[0].lstrip("\"'([“‘«"), bare[-1].rstrip(".,;:!?\"'()“”«»")
            pattern = "".join(f"{re.escape(f)}({'|'.join(re.escape(x.lower()) for x in o)})" for f, o in zip(bare, options)) + re.escape(bare[-1])
            fits = {m.groups() for m in re.finditer(rf"(?m)^{pattern}$", self.accented)}
        if fits:
            cased = [joined([next(x for x in o if x.lower() == y) for o, y in zip(options, f)]) for f in sorted(fits)]
            best = min(cased, key=lambda r: (size(r), r))
            return best, size(best), True
        filled: list[str] = []
        done = before
        for i, o in enumerate(options):  # from left to right, by what is near
            after = fixed[i + 1] + "".join(x[0] + f for x, f in zip(options[i + 1 : i + 9], fixed[i + 2 : i + 10])) + rest
            near = (done + fixed[i])[-30:]
            filled.append(o[0] if o[0] == "" else min(o, key=lambda x: self.length(f"{near}{x}{after[:30]}".lower())))  # noqa: B023
            done = near + filled[-1]
        return joined(filled), size(joined(filled)), False


def train(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """A zstandard dictionary for each language, from its documents and seed text."""
    import zstandard as z

    out = {}
    for lang, seed in SEEDS.items():
        parts = [p.encode() for t in samples.get(lang, []) for p in re.split(r"(?<=[.;!?])\s+|\n+", t) if len(p) > 20]
        parts += [p.encode() for p in seed.split(", ")]
        try:
            out[lang] = z.train_dictionary(min(DICT_BYTES, sum(map(len, parts)) // 4), parts, level=9).as_bytes()
        except z.ZstdError:  # too little to train on
            out[lang] = b"\n".join(parts)
    return out


def samples(docs: DataFrame, doc: str, text: str, lang: str) -> dict[str, list[str]]:
    """A bounded sample of labelled documents by language; reads the table when called."""
    code = F.substring(F.lower(F.trim(F.col(lang))), 1, 2)
    code = F.when(code == "po", "pt").otherwise(code)
    labelled = docs.filter(F.octet_length(F.col(text).cast("string")).between(1, TRAIN_BYTES)).select(F.col(doc).cast("long").alias("_id"), code.alias("_lang")).filter(F.col("_lang").isin(*SEEDS))
    least = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = labelled.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= TRAIN_DOCS).drop("_n").toArrow()
    out: dict[str, list[str]] = {k: [] for k in SEEDS}
    if chosen.num_rows:
        # at most TRAIN_DOCS ids for each language
        wanted = docs.sparkSession.createDataFrame(chosen)
        texts = docs.select(F.col(doc).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(wanted), "_id")
        for r in sorted(texts.select("_lang", "_id", "_text").collect(), key=lambda r: (r[0], r[1], r[2] or "")):
            if r[2] and len(r[2].encode("utf-8", "replace")) <= TRAIN_BYTES:  # an id may have several texts
                out[r[0]].append(r[2])
    return out


SCHEMA = "_id long, texto string, cadeia string, palavras int, restaurado boolean"


def wrongly_decoded(df: DataFrame, key: str, text: str, dictionaries: dict[str, bytes]) -> DataFrame:
    """One row for each affected text: restored text, chains, words changed, and whether nothing is lost."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer(held.value)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = r.repair(t)
                if got:
                    rows.append((k, got[0], "; ".join(got[1]) or None, got[2], got[3]))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["_id", "texto", "cadeia", "palavras", "restaurado"])

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA).withColumnRenamed("_id", key)
