"""Predicates on extracted entities, and the rejected rows with their reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import normalize as N

# Words in the names of public bodies, compared in lower case with accents. Fixed values.
PUBLIC_BODIES = (
    "prefeitura",
    "municipio de",
    "município de",
    "camara municipal",
    "câmara municipal",
    "governo do estado",
    "governo do municipio",
    "governo federal",
    "estado de ",
    "estado do ",
    "fundacao municipal",
    "fundação municipal",
    "secretaria municipal",
    "secretaria de ",
    "tribunal de contas",
    "ministerio",
    "ministério",
    "camara dos deputados",
    "câmara dos deputados",
    "senado federal",
    "autarquia",
    "universidade federal",
    "universidade estadual",
)


def is_public_body(nome: Column | str, terms: tuple[str, ...] = PUBLIC_BODIES) -> Column:
    low = F.lower(N.text_or_empty(nome))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])


def has_cnpj(cnpj: Column | str) -> Column:
    return N.strip(cnpj) != ""


def blank_null_words(x: Column | str) -> Column:
    """A document number, or '' for a null word."""
    return F.when(N.is_null_word(x, N.POST_DOC_NULLS), "").otherwise(N.strip(x))


def has_document(cpf: Column | str, rg: Column | str) -> Column:
    """By the schema and by the check after it: the two know different null words."""
    schema = ~N.is_null_word(cpf, N.SCHEMA_DOC_NULLS) | ~N.is_null_word(rg, N.SCHEMA_DOC_NULLS)
    return schema & ((blank_null_words(cpf) != "") | (blank_null_words(rg) != ""))


def flag(value: str | None) -> bool:
    return (value or "").strip().lower() == "sim"


def gate_companies(df: DataFrame, nome: str = "nome", cnpj: str = "cnpj") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with ``motivo``): a company needs a CNPJ and is no public body."""
    reason = F.when(~has_cnpj(cnpj), "sem_cnpj").when(is_public_body(nome), "orgao_publico")
    marked = df.withColumn("motivo", reason)
    return marked.filter("motivo is null").drop("motivo"), marked.filter("motivo is not null")
