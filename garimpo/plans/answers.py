"""Queries over raw model answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import normalize as N
from garimpo.operators import quarantine
from garimpo.session import shared_dir, ship, table
from garimpo.sources import delimited


def _read(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return quarantine.read_answers(table(spark, d, "parse_resposta_v1"), "resposta_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.rejected(_read(spark, d), "resposta_id").select("resposta_id")


def p3_rejected(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.rejected(_read(spark, d), "resposta_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.loaded(_read(spark, d), "resposta_id")


def p3_file(spark: SparkSession, d: str) -> DataFrame:
    """The valid answers in CSV, written as one raw file after another and read again in splits."""
    answers = table(spark, d, "parse_resposta_v1").filter(F.col("formato") == "csv")
    good = _read(spark, d).filter("lido.motivo is null").select("resposta_id")
    text = F.regexp_replace(F.regexp_replace("raw", "(?is)<think>.*?</think>", ""), r"```(?:[A-Za-z]+(?=[\s{\[]|\z))?", "")
    place = f"{shared_dir(spark).rstrip('/')}/garimpo-raw-{uuid.uuid4().hex}"
    answers.join(good, "resposta_id").select(N.strip(text)).write.text(place)
    return delimited.strict_rows(spark, place, ("arquivo", "tipo_entidade", "nome", "identificador", "aux"), header=False)[0].drop("origem", "posicao")


QUERIES = {"p3_found": p3_found, "p3_rejected": p3_rejected, "p3_records": p3_records, "p3_file": p3_file}


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{N.SPACE}]+|[{N.SPACE}]+$', '', 'g')"


_EMPTY = ", ".join(f"'{v}'" for v in sorted(quarantine.EMPTY))


def _empty(x: str) -> str:
    return f"(lower({_strip(x)}) IN ({_EMPTY}))"


def _ident(x: str, n: int) -> str:
    return f"({_empty(x)} OR regexp_full_match(regexp_replace({_strip(x)}, '[ ./-]', '', 'g'), '[0-9]{{{n}}}'))"


def _rg(x: str) -> str:
    return f"({_empty(x)} OR regexp_full_match(regexp_replace({_strip(x)}, '[ .-]', '', 'g'), '[0-9]{{4,9}}[0-9Xx]'))"


_CLEAN = _strip("regexp_replace(regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g'), '```(?:[A-Za-z]+(\\s|[{\\[]|$))?', '\\1', 'g')")
_FIELD = r'((?:[^",\r\n]*|\s*"(?:[^"]|"")*"\s*))'
_CSV = f"^{','.join([_FIELD] * 5)}$"


def _bare(k: str) -> str:
    x = _strip(f"c.{k}")
    return f"CASE WHEN starts_with({x}, '\"') THEN {_strip(f'''replace({x}[2:-2], '""', '"')''')} ELSE {x} END"


def _items(e: str) -> str:
    """Whether a list element of JSON is good, for either question."""
    def text(k: str) -> str:
        return f"coalesce(json_type({e}, '$.{k}') IN ('VARCHAR', 'NULL'), false)"

    def value(k: str) -> str:
        return f"json_extract_string({e}, '$.{k}')"

    firm = f"{text('cnpj')} AND {_ident(value('cnpj'), 14)}"
    person = f"{text('cpf')} AND {text('rg')} AND {_ident(value('cpf'), 11)} AND {_rg(value('rg'))}"
    return f"coalesce(json_type({e}) = 'OBJECT', false) AND {text('nome')} AND NOT {_empty(value('nome'))} AND CASE WHEN pergunta = 'empresas' THEN {firm} ELSE {person} END"


_F = "string_split(r, ',')"
_RECORD = f"""len({_F}) = CASE WHEN pergunta = 'empresas' THEN 2 ELSE 3 END AND NOT {_empty(f"{_F}[1]")}
    AND CASE WHEN pergunta = 'empresas' THEN {_ident(f"{_F}[2]", 14)} ELSE {_ident(f"{_F}[2]", 11)} AND {_rg(f"{_F}[3]")} END"""
_RECORDS = f"list_filter(string_split(t, ';'), lambda r: {_strip('r')} <> '')"
_LIST = f"len({_RECORDS}) > 0 AND len(list_filter({_RECORDS}, lambda r: NOT ({_RECORD}))) = 0"
_ARRAY = "CASE WHEN pergunta = 'empresas' THEN json_extract(j, '$.empresas') ELSE json_extract(j, '$.socios') END"
_JSON = f"coalesce(json_type(j) = 'OBJECT' AND json_type({_ARRAY}) = 'ARRAY' AND json_array_length({_ARRAY}) > 0, false) AND coalesce(len(list_filter(json_extract({_ARRAY}, '$[*]'), lambda e: NOT ({_items('e')}))) = 0, false)"
_ROW = f"""a <> '' AND lower(k) IN ('empresa', 'pessoa') AND NOT {_empty("n")} AND CASE WHEN lower(k) = 'empresa' THEN {_ident("i", 14)} AND {_empty("x")} ELSE {_ident("i", 11)} AND {_rg("x")} END"""

# DuckDB's reader also takes trailing commas and NaN, which RFC 8259 does not
_LOOSE = r"""regexp_matches(regexp_replace(t, '"(?:[^"\\]|\\.)*"', '""', 'g'), '(?i),\s*[}\]]|nan|inf')"""

_READ = f"""t AS (SELECT resposta_id, formato, pergunta, {_CLEAN} AS t FROM parse_resposta_v1),
        j AS (SELECT *, CASE WHEN formato = 'json' AND json_valid(t) AND NOT {_LOOSE} THEN t::JSON END AS j, CASE WHEN formato = 'csv' AND regexp_matches(t, '{_CSV}') THEN regexp_extract(t, '{_CSV}', ['a', 'k', 'n', 'i', 'x']) END AS c FROM t),
        f AS (SELECT *, {_bare("a")} AS a, {_bare("k")} AS k, {_bare("n")} AS n, {_bare("i")} AS i, {_bare("x")} AS x FROM j),
        v AS (SELECT *, coalesce(t <> '' AND CASE formato WHEN 'csv' THEN c IS NOT NULL AND {_ROW} WHEN 'lista' THEN {_LIST} WHEN 'json' THEN {_JSON} ELSE false END, false) AS bom FROM f)"""


def _value(x: str) -> str:
    return f"CASE WHEN NOT {_empty(x)} THEN {_strip(x)} END"


_KIND = "CASE WHEN pergunta = 'empresas' THEN 'Empresa' ELSE 'Pessoa' END AS tipo"
_ID = "json_extract_string(e, CASE WHEN pergunta = 'empresas' THEN '$.cnpj' ELSE '$.cpf' END)"

SQL: dict[str, str] = {
    "p3_found": f"WITH {_READ} SELECT resposta_id FROM v WHERE NOT bom",
    "p3_file": f"WITH {_READ} SELECT a AS arquivo, k AS tipo_entidade, n AS nome, i AS identificador, x AS aux FROM v WHERE bom AND formato = 'csv'",
    "p3_records": f"""WITH {_READ}
        SELECT resposta_id, 0 AS ord, a AS arquivo, CASE WHEN lower(k) = 'empresa' THEN 'Empresa' ELSE 'Pessoa' END AS tipo, n AS nome, {_value("i")} AS identificador,
            CASE WHEN lower(k) = 'pessoa' THEN {_value("x")} END AS rg FROM v WHERE bom AND formato = 'csv'
        UNION ALL SELECT resposta_id, p - 1, NULL, {_KIND}, {_strip(f"{_F}[1]")}, {_value(f"{_F}[2]")}, CASE WHEN pergunta = 'pessoas' THEN {_value(f"{_F}[3]")} END
            FROM (SELECT *, unnest({_RECORDS}) AS r, generate_subscripts({_RECORDS}, 1) AS p FROM v WHERE bom AND formato = 'lista')
        UNION ALL SELECT resposta_id, p - 1, NULL, {_KIND}, {_strip("json_extract_string(e, '$.nome')")}, {_value(_ID)}, CASE WHEN pergunta = 'pessoas' THEN {_value("json_extract_string(e, '$.rg')")} END
            FROM (SELECT *, unnest(json_extract({_ARRAY}, '$[*]')) AS e, generate_subscripts(json_extract({_ARRAY}, '$[*]'), 1) AS p FROM v WHERE bom AND formato = 'json')""",
}
