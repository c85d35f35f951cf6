"""Problem 3: rows that fail to parse, kept apart with the reason.

A table-driven finite-state machine reads a raw answer as delimited text. Only
delimiters and quotes move it, so it jumps from one to the next. A text longer
than one chunk is read in chunks: each chunk first gives its transition function
(end state for every start state), the functions are composed from left to right,
and every chunk is then tokenised from its own start state. The result is the
same for any chunk size.

Answers in JSON go through a second machine of the same kind (outside, inside a
string, after a backslash); its tokens drive a pushdown automaton with the
grammar of RFC 8259, which types the values and knows where each one begins.

Reasons: ``colunas`` (wrong number of columns, records or keys), ``aspas``
(broken quoting or JSON syntax), ``valor`` (a value that is not allowed, and null
or blank answers). ``detalhe`` says which, ``posicao`` is the offset in the raw
text, in code points.

Defined results: null, empty and blank raw is rejected with ``valor``/``vazio`` at
offset 0; a null or unknown format with ``valor``/``formato``; texts of any length
are read whole; repeated answers are judged one by one; other columns of the
input play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHUNK = 4096
# Values that count as empty, in any case. Fixed values.
EMPTY = frozenset({"", "null", "none", "n/a", "na", "nd", "-", "--", "não informado", "nao informado", "não disponível"})

START, BARE, QUOTED, CLOSED, BROKEN = range(5)
STATES = 5
THINK = re.compile(r"<think>.*?</think>", re.I | re.S)
# a tag ends at white space, at an opening bracket or with the text
FENCE = re.compile(r"```(?:[A-Za-z]+(?=[\s{\[]|\Z))?")
CNPJ = re.compile(r"[0-9]{14}")
CPF = re.compile(r"[0-9]{11}")
RG = re.compile(r"[0-9]{4,9}[0-9Xx]")

ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("arquivo", "tipo", "nome", "identificador", "rg")])
READ = T.StructType(
    [
        T.StructField("registros", T.ArrayType(ROW)),
        T.StructField("motivo", T.StringType()),
        T.StructField("detalhe", T.StringType()),
        T.StructField("posicao", T.IntegerType()),
    ]
)


class Rejected(Exception):
    def __init__(self, motivo: str, detalhe: str, at: int) -> None:
        super().__init__(motivo, detalhe, at)
        self.motivo, self.detalhe, self.at = motivo, detalhe, at


def _filled(text: str, at: int) -> int:
    """The next offset that is not white space."""
    while text[at].isspace():
        at += 1
    return at


class Machine:
    """A finite-state machine that reads a text in chunks, whose transition functions compose."""

    STATES, START = 1, 0

    def transition(self, text: str, a: int, b: int) -> tuple[int, ...]:
        """The chunk's transition function: end state by start state."""
        raise NotImplementedError

    def starts(self, text: str, chunk: int) -> list[tuple[int, int, int]]:
        """(begin, end, start state) of each chunk, by composition of the chunks' functions."""
        cuts = [(a, min(a + chunk, len(text))) for a in range(0, max(len(text), 1), chunk)]
        if len(cuts) == 1:
            return [(*cuts[0], self.START)]
        out, composed = [], tuple(range(self.STATES))
        for a, b in cuts:
            out.append((a, b, composed[self.START]))
            f = self.transition(text, a, b)
            composed = tuple(f[s] for s in composed)
        return out


class Delimited(Machine):
    """The machine for one dialect: field separators, record separators, and whether ``"`` quotes."""

    STATES, START = STATES, START

    def __init__(self, field: str, record: str, quoting: bool) -> None:
        self.field, self.record, self.quoting = field, record, quoting
        stops = re.escape(field + record + ('"' if quoting else ""))
        self.stop = re.compile(f"[{stops}]")

    def step(self, state: int, c: str) -> int:
        """The state after a delimiter or quote."""
        if state == BROKEN:
            return BROKEN
        if self.quoting and c == '"':
            return (QUOTED, BROKEN, CLOSED, QUOTED, BROKEN)[state]
        return QUOTED if state == QUOTED else START

    def plain(self, state: int, blank: bool) -> int:
        """The state after a run without delimiters and quotes; blanks around a quoted field are trimmed."""
        if state == START:
            return START if blank else BARE
        return BROKEN if state == CLOSED and not blank else state

    def transition(self, text: str, a: int, b: int) -> tuple[int, ...]:
        now = list(range(STATES))
        at = a
        for m in self.stop.finditer(text, a, b):
            if m.start() > at:
                blank = text[at : m.start()].isspace()
                now = [self.plain(s, blank) for s in now]
            now = [self.step(s, m[0]) for s in now]
            at = m.end()
        if b > at:
            blank = text[at:b].isspace()
            now = [self.plain(s, blank) for s in now]
        return tuple(now)

    def events(self, text: str, a: int, b: int, state: int) -> tuple[list[tuple[int, str]], int, int]:
        """Separators that count in this chunk, the end state, and where it broke (-1: nowhere)."""
        out: list[tuple[int, str]] = []
        at = a
        for m in self.stop.finditer(text, a, b):
            if m.start() > at:
                state = self.plain(state, text[at : m.start()].isspace())
                if state == BROKEN:
                    return out, state, _filled(text, at)
            c, before = m[0], state
            state = self.step(state, c)
            if state == BROKEN:
                return out, state, m.start()
            if before != QUOTED and c != '"':
                out.append((m.start(), c))
            at = m.end()
        if b > at:
            state = self.plain(state, text[at:b].isspace())
            if state == BROKEN:
                return out, state, _filled(text, at)
        return out, state, -1

    def records(self, text: str, chunk: int = CHUNK) -> list[list[tuple[int, str]]]:
        """Records of (offset, trimmed value) fields; raises Rejected for broken quoting."""
        cuts: list[tuple[int, str]] = []
        state = START
        for a, b, s in self.starts(text, chunk):
            found, state, broke = self.events(text, a, b, s)
            if broke >= 0:
                raise Rejected("aspas", "aspas fora do lugar", broke)
            cuts += found
        if state == QUOTED:
            raise Rejected("aspas", "aspas sem fim", len(text))
        out: list[list[tuple[int, str]]] = [[]]
        begin = 0
        for end, c in [*cuts, (len(text), "")]:
            raw = text[begin:end]
            value = raw.strip()
            if self.quoting and value[:1] == '"':
                value = value[1:-1].replace('""', '"').strip()
            out[-1].append((begin + len(raw) - len(raw.lstrip()), value))
            if c and c in self.record:
                out.append([])
            begin = end + 1
        return out


CSV = Delimited(",", "\n\r", True)
LIST = Delimited(",", ";", False)


class Node(NamedTuple):
    """A JSON value: what it is, where it begins, and its text, members by key or elements."""

    kind: str
    at: int
    value: str | dict[str, Node] | list[Node] | None = None


class Json(Machine):
    """The machine of JSON: outside strings, inside one, after a backslash. Its tokens go to a pushdown automaton."""

    STATES, START = 3, 0
    OUTSIDE, INSIDE, ESCAPED = range(3)
    STOP = re.compile(r'["\\{}\[\],:]')
    SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|true|false|null")
    STRING = re.compile(r'(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*')
    ESCAPE = re.compile(r"\\(?:u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)")
    PLAIN = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
    BLANK = " \t\n\r"

    def events(self, text: str, a: int, b: int, state: int) -> tuple[list[tuple[int, str]], int, int]:
        """Quotes that open or close a string and marks outside strings in this chunk, and the end state."""
        out: list[tuple[int, str]] = []
        at = a
        for m in self.STOP.finditer(text, a, b):
            p, c = m.start(), m[0]
            if state == self.ESCAPED:
                state = self.INSIDE
                if p == at:  # the character after the backslash
                    at = p + 1
                    continue
            if c == '"':
                state = self.OUTSIDE if state == self.INSIDE else self.INSIDE
                out.append((p, c))
            elif state == self.OUTSIDE:
                out.append((p, c))
            elif c == "\\":
                state = self.ESCAPED
            at = p + 1
        if state == self.ESCAPED and at < b:
            state = self.INSIDE
        return out, state, -1

    def transition(self, text: str, a: int, b: int) -> tuple[int, ...]:
        return tuple(self.events(text, a, b, s)[1] for s in range(self.STATES))

    def unescaped(self, s: str) -> str:
        """A string's value; half of a surrogate pair by itself becomes U+FFFD."""

        def one(m: re.Match) -> str:
            e = m[0][1:]
            if e[0] != "u":
                return self.PLAIN.get(e, e)
            if len(e) > 5:
                return chr(0x10000 + ((int(e[1:5], 16) & 0x3FF) << 10 | int(e[7:], 16) & 0x3FF))
            n = int(e[1:], 16)
            return "\ufffd" if 0xD800 <= n <= 0xDFFF else chr(n)

        return self.ESCAPE.sub(one, s)

    def read(self, text: str, chunk: int = CHUNK) -> Node:
        """The one value of the text, by RFC 8259; raises Rejected. Of equal keys the last counts."""
        tokens: list[tuple[int, str]] = []
        state = self.START
        for a, b, s in self.starts(text, chunk):
            found, state, _ = self.events(text, a, b, s)
            tokens += found
        if state != self.OUTSIDE:
            raise Rejected("aspas", "cadeia sem fim", len(text))
        tokens.append((len(text), ""))
        root: list[Node] = []
        stack: list[tuple[Node, str]] = []  # an open object or array, and the key its next member goes to
        key, want = "", "value"

        def put(node: Node) -> str:
            if not stack:
                root.append(node)
                return "end"
            top, _ = stack[-1]
            if top.kind == "array":
                top.value.append(node)
            else:
                top.value[key] = node
            return "more"

        at, n = 0, 0
        while n < len(tokens):
            p, c = tokens[n]
            n += 1
            if p > at and (gap := text[at:p].strip(self.BLANK)):
                begin = at + len(text[at:p]) - len(text[at:p].lstrip(self.BLANK))
                m = self.SCALAR.fullmatch(gap)
                if not m or want not in ("value", "first"):
                    raise Rejected("aspas", "json: texto após o objeto" if want == "end" else "json: valor", begin)
                want = put(Node("number" if m[1] else gap, begin, gap))
            at = p + 1
            if c == "":
                break
            if want == "end":
                raise Rejected("aspas", "json: texto após o objeto", p)
            if c == '"':
                end, _ = tokens[n]
                n, at = n + 1, end + 1
                content = text[p + 1 : end]
                good = self.STRING.match(content).end()
                if good < len(content):
                    raise Rejected("aspas", "json: cadeia", p + 1 + good)
                content = self.unescaped(content) if "\\" in content else content
                if want in ("key", "first key"):
                    key, want = content, ":"
                elif want in ("value", "first"):
                    want = put(Node("string", p, content))
                else:
                    raise Rejected("aspas", "json: cadeia", p)
            elif c in "{[" and want in ("value", "first"):
                stack.append((Node("object", p, {}) if c == "{" else Node("array", p, []), key))
                want = "first key" if c == "{" else "first"
            elif c in "}]" and stack and (stack[-1][0].kind == "object") == (c == "}") and want in ("more", "first key" if c == "}" else "first"):
                node, key = stack.pop()
                want = put(node)
            elif c == ":" and want == ":":
                want = "value"
            elif c == "," and want == "more":
                want = "key" if stack[-1][0].kind == "object" else "value"
            else:
                raise Rejected("aspas", f"json: {c}", p)
        if stack or not root:
            raise Rejected("aspas", "objeto sem fim", len(text))
        return root[0]


JSON = Json()


def is_empty(v: str | None) -> bool:
    return v is None or v.strip().lower() in EMPTY


def _name(v: str | None, at: int) -> str:
    if is_empty(v):
        raise Rejected("valor", "nome vazio", at)
    return v.strip()


def _identifier(v: str | None, kind: re.Pattern, what: str, at: int) -> str | None:
    if is_empty(v):
        return None
    drop = " .-" if kind is RG else " .-/"
    if not kind.fullmatch(v.strip().translate({ord(c): None for c in drop})):
        raise Rejected("valor", what, at)
    return v.strip()


def _csv(text: str, pergunta: str | None) -> list[tuple]:
    records = CSV.records(text)
    if len(records) > 1 and not (len(records) == 2 and records[1] == [(len(text), "")]):
        raise Rejected("colunas", "mais de um registro", records[1][0][0])
    fields = records[0]
    if len(fields) != 5:
        raise Rejected("colunas", f"{len(fields)} campos", fields[min(len(fields) - 1, 5)][0])
    (p0, arquivo), (p1, tipo), (p2, nome), (p3, ident), (p4, aux) = fields
    if not arquivo:
        raise Rejected("valor", "arquivo vazio", p0)
    kind = tipo.lower()
    if kind not in ("empresa", "pessoa"):
        raise Rejected("valor", "tipo_entidade", p1)
    nome = _name(nome, p2)
    if kind == "empresa":
        ident = _identifier(ident, CNPJ, "cnpj", p3)
        if not is_empty(aux):
            raise Rejected("valor", "aux de empresa", p4)
        return [(arquivo, "Empresa", nome, ident, None)]
    return [(arquivo, "Pessoa", nome, _identifier(ident, CPF, "cpf", p3), _identifier(aux, RG, "rg", p4))]


def _list(text: str, pergunta: str | None) -> list[tuple]:
    out = []
    firms = _firms(pergunta)
    for fields in LIST.records(text):
        if len(fields) == 1 and not fields[0][1]:
            continue
        if len(fields) != (2 if firms else 3):
            raise Rejected("colunas", f"{len(fields)} campos", fields[0][0])
        out.append(_entity(firms, [v for _, v in fields], [p for p, _ in fields]))
    if not out:
        raise Rejected("colunas", "nenhum registro", 0)
    return out


def _firms(pergunta: str | None) -> bool:
    if pergunta not in ("empresas", "pessoas"):
        raise Rejected("valor", "pergunta", 0)
    return pergunta == "empresas"


def _entity(firms: bool, v: list, at: list[int]) -> tuple:
    nome = _name(v[0], at[0])
    if firms:
        return (None, "Empresa", nome, _identifier(v[1], CNPJ, "cnpj", at[1]), None)
    return (None, "Pessoa", nome, _identifier(v[1], CPF, "cpf", at[1]), _identifier(v[2], RG, "rg", at[2]))


def _json(text: str, pergunta: str | None) -> list[tuple]:
    root = JSON.read(text)
    if root.kind != "object":
        raise Rejected("colunas", "não é objeto", root.at)
    firms = _firms(pergunta)
    key = "empresas" if firms else "socios"
    items = root.value.get(key)
    if items is None or items.kind != "array" or not items.value:
        raise Rejected("colunas", f"sem lista {key}", items.at if items else root.at)
    out = []
    want = ("nome", "cnpj") if firms else ("nome", "cpf", "rg")
    for item in items.value:
        if item.kind != "object" or any(k not in item.value for k in want):
            raise Rejected("colunas", "chaves do elemento", item.at)
        values = [item.value[k] for k in want]
        for v in values:
            if v.kind not in ("string", "null"):
                raise Rejected("valor", "tipo do valor", v.at)
        out.append(_entity(firms, [v.value if v.kind == "string" else None for v in values], [v.at for v in values]))
    return out


READERS = {"csv": _csv, "lista": _list, "json": _json}


def clean(raw: str) -> tuple[str, list[int], list[int]]:
    """The answer without thinking blocks, fence marks and outer white space, and how its offsets map to the raw text."""
    kept, at = [], 0
    for m in THINK.finditer(raw):
        kept.append((at, m.start()))
        at = m.end()
    kept.append((at, len(raw)))
    text = "".join(raw[a:b] for a, b in kept)
    if "```" in text:
        kept, outer = [], kept
        for a, b in outer:
            at = a
            for m in FENCE.finditer(raw, a, b):
                kept.append((at, m.start()))
                at = m.end()
            kept.append((at, b))
        text = "".join(raw[a:b] for a, b in kept)
    lead = len(text) - len(text.lstrip())
    starts, origins, n = [], [], -lead
    for a, b in kept:
        if b > a:
            starts.append(n)
            origins.append(a)
            n += b - a
    return text.strip(), starts, origins


def read_answer(raw: str | None, formato: str | None, pergunta: str | None) -> tuple[list[tuple] | None, str | None, str | None, int | None]:
    """(records, None, None, None) or (None, reason, detail, offset)."""
    if raw is None:
        return None, "valor", "vazio", 0
    text, starts, origins = clean(raw)
    if not text:
        return None, "valor", "vazio", 0
    reader = READERS.get(formato or "")
    if reader is None:
        return None, "valor", "formato", 0
    try:
        return reader(text, pergunta), None, None, None
    except Rejected as e:
        k = max(0, bisect_right(starts, e.at) - 1)
        at = min(len(raw), origins[k] + e.at - starts[k]) if starts else 0
        return None, e.motivo, e.detalhe, at


@F.arrow_udf(READ)
def _read(raw: pa.Array, formato: pa.Array, pergunta: pa.Array) -> pa.Array:
    rows = [read_answer(*x) for x in zip(raw.to_pylist(), formato.to_pylist(), pergunta.to_pylist())]
    kind = to_arrow_type(READ)
    cols = list(zip(*rows)) if rows else [()] * 4
    records = [None if r is None else [dict(zip(ROW.names, x)) for x in r] for r in cols[0]]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((records, *cols[1:]), kind)], fields=list(kind))


# else the planner would run it a second time, in a filter that it infers below an explode
_read = _read.asNondeterministic()


def read_answers(df: DataFrame, key: str, raw: str = "raw", formato: str = "formato", pergunta: str = "pergunta") -> DataFrame:
    """``key`` and the struct ``lido``: records, or reason, detail and offset."""
    return df.select(F.col(key), _read(F.col(raw), F.col(formato), F.col(pergunta)).alias("lido"))


def loaded(read: DataFrame, key: str) -> DataFrame:
    """The valid answers' records, typed and numbered."""
    rows: Column = F.posexplode("lido.registros")
    return read.filter("lido.motivo is null").select(key, rows.alias("ord", "r")).select(key, "ord", "r.*")


def rejected(read: DataFrame, key: str) -> DataFrame:
    """The other answers with reason, detail and offset."""
    return read.filter("lido.motivo is not null").select(key, "lido.motivo", "lido.detalhe", "lido.posicao")
