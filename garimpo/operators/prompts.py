"""Questions to a model, as Columns: a base text, optional parts behind flags, and a hint after a failed try."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPANY_LINE, PERSON_LINE = "NOME, CNPJ;", "NOME, CPF, RG;"


@dataclass(frozen=True)
class Flags:
    aux_terms: bool = False
    negative: bool = False
    enhanced: bool = False


COMPANY_TERMS = "Costumam indicar empresas: sociedade limitada, LTDA, sociedade anônima, S.A., EIRELI, microempresa, ME, EPP, fundação."
PARTNER_TERMS = "Costumam indicar sócios: sócio-administrador, representada por, de propriedade de, gerente, diretor, presidente, representante legal."
NO_INVENTION = "Use só o que está escrito no texto; não invente dados."
NO_PUBLIC = "Órgãos públicos não são empresas."


COMPANIES_SCHEMA = '{"type": "object", "required": ["empresas"], "properties": {"empresas": {"type": "array", "items": {"type": "object", "required": ["nome", "cnpj"], "properties": {"nome": {"type": "string"}, "cnpj": {"type": "string"}}}}}}'
PARTNERS_SCHEMA = '{"type": "object", "required": ["socios"], "properties": {"socios": {"type": "array", "items": {"type": "object", "required": ["nome"], "properties": {"nome": {"type": "string"}, "cpf": {"type": "string"}, "rg": {"type": "string"}}}}}}'


def _join(*parts: Column | str | None) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts if p is not None])


def companies_question(flags: Flags = Flags(), hint: Column | None = None) -> Column:
    """Independent question about companies, answered in lines."""
    return _join(
        f"Liste as empresas do texto com o CNPJ de cada uma, só em linhas da forma {COMPANY_LINE} Deixe vazio o CNPJ que não souber.",
        COMPANY_TERMS if flags.aux_terms else None,
        f"{NO_INVENTION} {NO_PUBLIC}" if flags.negative else None,
        hint,
    )


def persons_question(flags: Flags = Flags(), hint: Column | None = None) -> Column:
    return _join(
        f"Liste os sócios e proprietários das empresas do texto com CPF e RG, só em linhas da forma {PERSON_LINE} Deixe vazio o que não souber.",
        PARTNER_TERMS if flags.aux_terms else None,
        NO_INVENTION if flags.negative else None,
        hint,
    )


def companies_json_question(flags: Flags = Flags()) -> Column:
    """First question of the chained pipeline, answered as an object with ``empresas``."""
    return _join(
        "Liste as empresas do texto que tenham CNPJ, com nome e CNPJ (14 algarismos, com ou sem pontuação).",
        COMPANY_TERMS if flags.aux_terms else None,
        f"{NO_INVENTION} {NO_PUBLIC}" if flags.negative else None,
    )


def partners_question(empresa: Column, cnpj: Column, flags: Flags = Flags()) -> Column:
    """Second question, about the partners of one company, answered as an object with ``socios``."""
    named = F.concat(empresa, F.lit(" (CNPJ "), cnpj, F.lit(")"))
    extra = F.concat(F.lit("Procure também: sócio da "), empresa, F.lit("; proprietários da "), empresa, F.lit("; gerente ou diretor da "), empresa)
    return _join(
        F.concat(F.lit("Liste os sócios, proprietários e administradores da empresa "), named, F.lit(" com CPF (11 algarismos) ou RG.")),
        PARTNER_TERMS if flags.aux_terms else None,
        extra if flags.aux_terms and flags.enhanced else None,
        f"{NO_INVENTION} Quem não tiver CPF nem RG fica de fora." if flags.negative else None,
    )


QA_PARTS = ("Responda com base no contexto; se ele não bastar, deixe a resposta vazia.\n\nContexto:\n", "\n\nPergunta:\n", "\n\nResposta:")


def qa_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(QA_PARTS[0]), context, F.lit(QA_PARTS[1]), question, F.lit(QA_PARTS[2]))


def qa_text(context: str, question: str) -> str:
    """``qa_prompt`` of one question."""
    return QA_PARTS[0] + context + QA_PARTS[1] + question + QA_PARTS[2]


def with_schema(question: Column, schema: str) -> Column:
    return F.concat(question, F.lit(f"\n\nResponda com um objeto JSON que siga este esquema:\n{schema}"))
