"""Semi-structured answers to rows: lenient (text or JSON) and strict (JSON checked against a schema).

Text cleaning and the delimited paths are Column expressions. Finding the first
balanced object needs a scan with state, so the lenient reader is one Arrow UDF
for each answer; the strict reader is built on variants and stays in the JVM.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import normalize as N

# Keys by which an answer gives itself away as a JSON Schema. Fixed values.
SCHEMA_KEYS = ("$defs", "$schema", "properties", "required", "title", "description", "$ref", "allOf", "anyOf")

#: Error of a blank answer, which is what is asked for where there is nothing to list.
EMPTY = "empty_answer"

THINK = r"(?i)<think>[\s\S]*?</think>"
THINK_STRICT = r"<think>[\s\S]*?</think>"
FENCE = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"
TAG = r"<[^>]+>"


def clean_response(raw: Column | str) -> Column:
    """Without thinking blocks; every fence replaced by its body; trimmed."""
    text = N.strip(F.regexp_replace(N.strip(raw), THINK, ""))
    return N.strip(F.regexp_replace(text, FENCE, "$1"))


def plain_text(raw: Column | str) -> Column:
    """A cleaned answer without tags, white space collapsed."""
    return N.collapse(F.regexp_replace(clean_response(raw), TAG, ""))


def strict_json(raw: Column | str) -> Column:
    """The object of an answer: the first fence's body if there is one, from the first to the last brace."""
    text = N.strip(F.regexp_replace(N.text_or_empty(raw), THINK_STRICT, ""))
    fence = r"```(?:json)?\s*([\s\S]*?)\s*```"
    body = F.when(F.regexp_like(text, F.lit(fence)), N.strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    blob = F.regexp_extract(body, r"(\{[\s\S]*\})", 1)
    return F.when(blob == "", body).otherwise(blob)


def is_schema_echo(blob: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(blob), F.array(*map(F.lit, SCHEMA_KEYS))), F.lit(False))


def _records(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ";"), lambda r: F.trim(r)), lambda r: r != "")


def text_companies(raw: Column | str) -> Column:
    """Array of (nome, cnpj) from ``nome, cnpj; …``: the first comma divides; null words are no names.

    A record with a comma may have an empty name; one without a comma may not.
    """

    def one(r: Column) -> Column:
        comma = F.locate(",", r)
        return F.struct(
            F.when(comma > 0, F.trim(F.substring_index(r, ",", 1))).otherwise(r).alias("nome"),
            F.when(comma > 0, F.trim(F.substr(r, comma + 1))).otherwise("").alias("cnpj"),
        )

    return F.filter(F.transform(_records(plain_text(raw)), one), lambda x: ~F.lower(x.nome).isin(*N.PARSE_NAME_NULLS))


def text_persons(raw: Column | str) -> Column:
    """Array of (nome, cpf, rg) from ``nome, cpf, rg; …``: at most two commas divide; a name is needed."""

    def one(r: Column) -> Column:
        p = F.split(r, ",", 3)
        return F.struct(*[F.trim(F.coalesce(F.get(p, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(("nome", "cpf", "rg"))])

    return F.filter(F.transform(_records(plain_text(raw)), one), lambda x: (x.nome != "") & ~F.lower(x.nome).isin(*N.PARSE_NAME_NULLS))


def balanced(text: str) -> str | None:
    """The first balanced object, braces in strings not counted; None if there is none."""
    begin = text.find("{")
    if begin < 0:
        return None
    depth, inside, at = 0, False, begin
    for m in re.finditer(r'\\.|["{}]', text[begin:], re.S):
        c = m[0]
        if c == '"':
            inside = not inside
        elif c[0] == "\\":
            if not inside and c[1] in '"{}':  # outside a string a backslash escapes nothing
                inside = c[1] == '"'
                depth += (c[1] == "{") - (c[1] == "}")
        elif not inside:
            depth += 1 if c == "{" else -1
        if depth == 0 and not inside:
            at = begin + m.end()
            return text[begin:at]
    return None


@F.pandas_udf(T.StringType())
def balanced_object(text: pd.Series) -> pd.Series:
    return pd.Series([balanced(x) if isinstance(x, str) else None for x in text], dtype=object)


@dataclass(frozen=True)
class Shape:
    """What a list of entities looks like in JSON."""

    key: str
    aliases: tuple[str, ...]
    fields: tuple[tuple[str, ...], ...]
    columns: tuple[str, ...]


# Keys of answers and of their fields, with the aliases that are accepted. Fixed values.
COMPANIES = Shape("empresas", ("empresas", "Empresa", "empresa", "companies"), (("nome", "name", "empresa"), ("cnpj", "CNPJ")), ("nome", "cnpj"))
PERSONS = Shape("socios", ("socios", "sócios", "socio", "pessoas", "partners"), (("nome", "name"), ("cpf", "CPF"), ("rg", "RG")), ("nome", "cpf", "rg"))


def _as_text(v) -> str:
    return "" if v is None else (v if isinstance(v, str) else str(v)).strip()


def _listed(data: dict, shape: Shape) -> list | None:
    for key in (shape.key, *shape.aliases):
        if key not in data:
            continue
        v = data[key]
        if isinstance(v, list):
            return v
        if key == shape.key:
            return [v]
        if isinstance(v, dict) and shape.key in v:
            inner = v[shape.key]
            return inner if isinstance(inner, list) else [inner]
    return None


def json_items(cleaned: str, shape: Shape) -> tuple[list[tuple], int, str | None]:
    """(named entities, number of objects listed, error)."""
    blob = balanced(cleaned)
    if not blob:
        return [], 0, "no_json"
    try:
        data = json.loads(blob)
    except (ValueError, RecursionError) as e:
        return [], 0, f"json_decode:{e}"
    if any(k in data for k in SCHEMA_KEYS):
        return [], 0, "schema_echo"
    items = _listed(data, shape)
    if items is None:
        return [], 0, "no_list_key"
    items = [i for i in items if isinstance(i, dict)]
    rows = [tuple(next((t for a in names if (t := _as_text(i.get(a)))), "") for names in shape.fields) for i in items]
    return [r for r in rows if r[0]], len(items), None


def read_lenient(cleaned: str, text_rows: list[tuple], shape: Shape) -> tuple[list[tuple], str | None]:
    """JSON entities, else those of the text path. A schema echo and listed objects without names end the reading."""
    rows, listed, error = json_items(cleaned, shape)
    if error == "schema_echo":
        return [], error
    if rows:
        return rows, None
    if listed:
        return [], "empty_json"
    return (text_rows, None) if text_rows else ([], error or "empty_text")


def _lenient(shape: Shape):
    row = T.StructType([T.StructField(c, T.StringType()) for c in shape.columns])
    out = T.StructType([T.StructField("itens", T.ArrayType(row)), T.StructField("erro", T.StringType())])

    @F.pandas_udf(out)
    def run(cleaned: pd.Series, rows: pd.Series) -> pd.DataFrame:
        got = [read_lenient(c, [tuple(r[k] for k in shape.columns) for r in t], shape) for c, t in zip(cleaned, rows)]
        return pd.DataFrame({"itens": pd.Series([[dict(zip(shape.columns, r)) for r in g[0]] for g in got], dtype=object), "erro": pd.Series([g[1] for g in got], dtype=object)})

    return run.asNondeterministic()  # else it would be run again in filters inferred from what is done with its rows


def lenient_companies(raw: Column | str) -> Column:
    """(itens, erro) of an answer about companies."""
    return _lenient(COMPANIES)(clean_response(raw), text_companies(raw))


def lenient_persons(raw: Column | str) -> Column:
    return _lenient(PERSONS)(clean_response(raw), text_persons(raw))


def _clean(raw: str | None) -> str:
    """clean_response of one answer."""
    text = re.sub(THINK, "", (raw or "").strip(), flags=re.ASCII).strip()
    return re.sub(FENCE, r"\1", text, flags=re.ASCII).strip()


def _text_rows(cleaned: str, shape: Shape) -> list[tuple]:
    """text_companies and text_persons of one cleaned answer."""
    plain = re.sub(r"\s+", " ", re.sub(TAG, "", cleaned))
    n = len(shape.columns)
    rows = [tuple(p.strip(" ") for p in [*r.split(",", n - 1), *[""] * n][:n]) for r in (p.strip(" ") for p in plain.split(";")) if r]
    return [r for r in rows if r[0].lower() not in N.PARSE_NAME_NULLS and (r[0] or shape == COMPANIES)]


def lenient_problem(raw: str | None, shape: Shape) -> str | None:
    """The error of lenient_companies or lenient_persons, for a try inside a partition; EMPTY for a blank answer."""
    cleaned = _clean(raw)
    return read_lenient(cleaned, _text_rows(cleaned, shape), shape)[1] if cleaned else EMPTY


def strict_problem(raw: str | None, shape: Shape) -> str | None:
    """Why strict_companies or strict_partners would refuse an answer, for a try inside a partition."""
    text = re.sub(THINK_STRICT, "", raw or "").strip()
    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)\s*```", text, re.ASCII)
    body = fenced[1].strip() if fenced else text
    found = re.search(r"\{[\s\S]*\}", body)
    try:
        data = json.loads(found[0] if found else body)
    except (ValueError, RecursionError) as e:
        return f"json_decode:{e}"
    items = data.get(shape.key) if isinstance(data, dict) else None
    if not isinstance(items, list):
        return "no_list_key"

    def good(x) -> bool:
        if not isinstance(x, dict) or not isinstance(x.get("nome"), str) or not x["nome"].strip():
            return False
        if shape == COMPANIES:
            return isinstance(x.get("cnpj"), str) and bool(x["cnpj"].strip())
        numbers = [x[k] for k in ("cpf", "rg") if k in x]
        return all(isinstance(v, str) for v in numbers) and any(v.strip().lower() not in N.SCHEMA_DOC_NULLS for v in numbers)

    return None if all(map(good, items)) else "bad_item"


def _typed(blob: Column, key: str, fields: tuple[str, ...]) -> Column:
    items = F.try_variant_get(F.try_parse_json(blob), f"$.{key}", "array<variant>")

    def one(v: Column) -> Column:
        parts = []
        for f in fields:
            x = F.try_variant_get(v, f"$.{f}", "variant")
            parts += [F.try_variant_get(v, f"$.{f}", "string").alias(f), F.schema_of_variant(x).alias(f"{f}_type")]
        return F.struct(*parts)

    return F.transform(items, one)


def strict_companies(raw: Column | str) -> Column:
    """Array of (nome, cnpj), or null: one bad item fails the whole list."""
    items = _typed(strict_json(raw), "empresas", ("nome", "cnpj"))

    def good(x: Column) -> Column:
        return F.coalesce((x.nome_type == "STRING") & (x.cnpj_type == "STRING") & (N.strip(x.nome) != "") & (N.strip(x.cnpj) != ""), F.lit(False))

    return F.when(F.forall(items, good), F.transform(items, lambda x: F.struct(N.strip(x.nome).alias("nome"), N.strip(x.cnpj).alias("cnpj"))))


def strict_partners(raw: Column | str) -> Column:
    """Array of (nome, cpf, rg), or null: every partner needs a name and a CPF or RG that is no null word."""
    items = _typed(strict_json(raw), "socios", ("nome", "cpf", "rg"))

    def text_or_absent(kind: Column) -> Column:
        return kind.isNull() | (kind == "STRING")

    def good(x: Column) -> Column:
        some = ~N.is_null_word(x.cpf, N.SCHEMA_DOC_NULLS) | ~N.is_null_word(x.rg, N.SCHEMA_DOC_NULLS)
        return F.coalesce((x.nome_type == "STRING") & (N.strip(x.nome) != "") & text_or_absent(x.cpf_type) & text_or_absent(x.rg_type) & some, F.lit(False))

    return F.when(
        F.forall(items, good),
        F.transform(items, lambda x: F.struct(N.strip(x.nome).alias("nome"), N.text_or_empty(x.cpf).alias("cpf"), N.text_or_empty(x.rg).alias("rg"))),
    )


def correction(error: Column, shape: str) -> Column:
    """The hint for another try after an error; ``shape`` is the wanted line, such as ``NOME, CNPJ;``."""
    only = f"Escreva apenas linhas da forma {shape}"
    return (
        F.when(F.coalesce(error, F.lit("")) == "", None)
        .when(error == "schema_echo", F.lit(f"Veio um esquema em vez de dados. {only}"))
        .when(error.startswith("json_decode") | (error == "no_json"), F.lit(f"{only} Nada de JSON nem de markdown."))
        .when(F.contains(F.lower(error), F.lit("null")), F.lit("Deixe vazio o que faltar, sem escrever null."))
        .otherwise(F.lit(only))
    )


def correction_hint(error: str | None, shape: str) -> str | None:
    """``correction`` of one error."""
    only = f"Escreva apenas linhas da forma {shape}"
    if not error:
        return None
    if error == "schema_echo":
        return f"Veio um esquema em vez de dados. {only}"
    if error.startswith("json_decode") or error == "no_json":
        return f"{only} Nada de JSON nem de markdown."
    return "Deixe vazio o que faltar, sem escrever null." if "null" in error.lower() else only
