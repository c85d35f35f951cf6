"""Counters of matched documents, and the measures derived from them.

Counters are additive: a document's row, a corpus total and any rollup come from
the same columns. Measures are plain arithmetic on counters and give 0 where a
denominator is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(pairs: str, test: str = "true") -> Column:
    return F.expr(f"size(filter({pairs}, p -> {test}))")


# Names of the counters. Fixed values.
FLAT = (
    "total_empresas_gabarito",
    "total_empresas_resposta",
    "empresas_corretas",
    "empresas_nomes_corretos",
    "empresas_cnpjs_corretos",
    "empresas_extras",
    "empresas_faltantes",
    "total_pessoas_gabarito",
    "total_pessoas_resposta",
    "pessoas_nome_cpf_corretas",
    "pessoas_nome_rg_corretas",
    "pessoas_cpf_rg_corretas",
    "pessoas_completas",
    "pessoas_nome_correto",
    "pessoas_cpf_correto",
    "pessoas_rg_correto",
    "pessoas_extras",
    "pessoas_faltantes",
    "empresa_socio_nome_cpf",
    "empresa_socio_nome_rg",
    "empresa_socio_nome_cpf_rg",
    "socios_corretos",
    "documentos_completos",
    "documentos_parciais",
    "empresas_com_socios_completos",
    "empresas_com_socios_parciais",
)
NESTED = (
    "total_empresas_gabarito",
    "total_empresas_resposta",
    "empresas_corretas",
    "nomes_corretos",
    "cnpjs_corretos",
    "empresas_extras",
    "empresas_faltantes",
    "total_socios_gabarito",
    "total_socios_resposta",
    "socios_nome_cpf_corretos",
    "socios_nome_rg_corretos",
    "socios_cpf_rg_corretos",
    "socios_completos",
    "socios_nome_correto",
    "socios_cpf_correto",
    "socios_rg_correto",
    "socios_extras",
    "socios_faltantes",
    "empresa_socio_nome_cpf",
    "empresa_socio_nome_rg",
    "empresa_socio_nome_cpf_rg",
    "empresas_com_socios_completos",
    "empresas_com_socios_parciais",
    "documento_num_empresas_validadas",
)
PASS = "documento_todas_empresas_socios"


def flat_counters(matched: DataFrame) -> DataFrame:
    """26 counters and the pass flag for each document of ``match_flat``."""
    size = F.size
    c = {
        "total_empresas_gabarito": size("firms_g"),
        "total_empresas_resposta": size("firms_r"),
        "empresas_corretas": _n("firm_pairs", "p.n and p.c"),
        "empresas_nomes_corretos": _n("firm_pairs", "p.n"),
        "empresas_cnpjs_corretos": _n("firm_pairs", "p.c"),
        "empresas_extras": size("firms_r") - size("firm_pairs"),
        "empresas_faltantes": size("firms_g") - size("firm_pairs"),
        "total_pessoas_gabarito": size("persons_g"),
        "total_pessoas_resposta": size("persons_r"),
        "pessoas_nome_cpf_corretas": _n("person_pairs", "p.n and p.c"),
        "pessoas_nome_rg_corretas": _n("person_pairs", "p.n and p.d"),
        "pessoas_cpf_rg_corretas": _n("person_pairs", "p.c and p.d"),
        "pessoas_completas": _n("person_pairs", "p.n and p.c and p.d"),
        "pessoas_nome_correto": _n("person_pairs", "p.n"),
        "pessoas_cpf_correto": _n("person_pairs", "p.c"),
        "pessoas_rg_correto": _n("person_pairs", "p.d"),
        "pessoas_extras": size("persons_r") - size("person_pairs"),
        "pessoas_faltantes": size("persons_g") - size("person_pairs"),
    }
    df = matched.select("id", *[v.cast("int").alias(k) for k, v in c.items()])
    some = F.col("empresas_corretas") > 0
    exact = (F.col("pessoas_completas") == F.col("total_pessoas_gabarito")) & (F.col("pessoas_faltantes") == 0) & (F.col("pessoas_extras") == 0)
    whole, part = some & exact, some & ~exact & (F.col("pessoas_completas") > 0)

    def when(test: Column, value: Column | int) -> Column:
        return F.when(test, value).otherwise(0).cast("int")

    passed = (
        exact
        & (F.col("total_empresas_gabarito") > 0)
        & (F.col("total_pessoas_gabarito") > 0)
        & (F.col("total_empresas_gabarito") == F.col("empresas_corretas"))
        & (F.col("empresas_extras") == 0)
        & (F.col("empresas_faltantes") == 0)
    )
    return df.select(
        "*",
        when(some, F.col("pessoas_nome_cpf_corretas")).alias("empresa_socio_nome_cpf"),
        when(some, F.col("pessoas_nome_rg_corretas")).alias("empresa_socio_nome_rg"),
        when(some, F.col("pessoas_completas")).alias("empresa_socio_nome_cpf_rg"),
        F.col("pessoas_nome_rg_corretas").alias("socios_corretos"),
        when(whole, 1).alias("documentos_completos"),
        when(part, 1).alias("documentos_parciais"),
        when(whole, F.col("empresas_corretas")).alias("empresas_com_socios_completos"),
        when(part, 1).alias("empresas_com_socios_parciais"),
        passed.alias(PASS),
    )


def nested_counters(matched: DataFrame) -> DataFrame:
    """24 counters and the pass flag for each document of ``match_nested``."""

    def total(value: str, of: str = "pairs") -> Column:
        return F.expr(f"aggregate({of}, 0, (a, p) -> a + {value})")

    def inner(test: str) -> str:
        return f"size(filter(p.p, k -> {test}))"

    gold = F.expr("aggregate(firms_g, 0, (a, e) -> a + size(e.s))")
    answered = F.expr("aggregate(firms_r, 0, (a, e) -> a + size(e.s))")
    complete = "(p.n and p.c and p.ng = p.nr and size(p.p) = p.ng and size(filter(p.p, k -> k.n and k.c and k.d)) = p.ng)"
    right = "int(p.n and p.c)"
    c = {
        "total_empresas_gabarito": F.size("firms_g"),
        "total_empresas_resposta": F.size("firms_r"),
        "empresas_corretas": _n("pairs", "p.n and p.c"),
        "nomes_corretos": _n("pairs", "p.n"),
        "cnpjs_corretos": _n("pairs", "p.c"),
        "empresas_extras": F.size("firms_r") - F.size("pairs"),
        "empresas_faltantes": F.size("firms_g") - F.size("pairs"),
        "total_socios_gabarito": gold,
        "total_socios_resposta": answered,
        "socios_nome_cpf_corretos": total(inner("k.n and k.c")),
        "socios_nome_rg_corretos": total(inner("k.n and k.d")),
        "socios_cpf_rg_corretos": total(inner("k.c and k.d")),
        "socios_completos": total(inner("k.n and k.c and k.d")),
        "socios_nome_correto": total(inner("k.n")),
        "socios_cpf_correto": total(inner("k.c")),
        "socios_rg_correto": total(inner("k.d")),
        "socios_extras": answered - total("size(p.p)"),
        "socios_faltantes": gold - total("size(p.p)"),
        "empresa_socio_nome_cpf": total(f"{right} * {inner('k.n and k.c')}"),
        "empresa_socio_nome_rg": total(f"{right} * {inner('k.n and k.d')}"),
        "empresa_socio_nome_cpf_rg": total(f"{right} * {inner('k.n and k.c and k.d')}"),
        "empresas_com_socios_completos": _n("pairs", complete),
        "empresas_com_socios_parciais": _n("pairs", f"p.n and p.c and not {complete} and exists(p.p, k -> k.n and k.c and k.d)"),
        "documento_num_empresas_validadas": _n("pairs", complete),
    }
    df = matched.select("id", *[v.cast("int").alias(k) for k, v in c.items()])
    e, s = F.col("total_empresas_gabarito"), F.col("total_socios_gabarito")
    passed = (
        (e > 0)
        & (s > 0)
        & (e == F.col("empresas_corretas"))
        & (F.col("empresas_extras") == 0)
        & (F.col("empresas_faltantes") == 0)
        & (s == F.col("socios_completos"))
        & (F.col("socios_extras") == 0)
        & (F.col("socios_faltantes") == 0)
        & (F.col("documento_num_empresas_validadas") == e)
    )
    return df.withColumn(PASS, passed)


def totals(counters: DataFrame, names: Sequence[str]) -> DataFrame:
    return counters.agg(*[F.expr(f"cast(coalesce(sum({n}), 0) as bigint) as {n}") for n in names])


def rollup(counters: DataFrame, names: Sequence[str]) -> DataFrame:
    """Documents and the corpus in one table; ``nivel`` 1 marks the corpus row."""
    return counters.rollup("id").agg(F.expr("cast(grouping_id() as int) as nivel"), *[F.expr(f"cast(sum({n}) as bigint) as {n}") for n in names])


def _ratio(a: str, b: str) -> str:
    """SQL of a quotient that is 0 where there is none."""
    return f"coalesce(try_divide(cast({a} as double), cast({b} as double)), 0D)"


def _f1(p: str, r: str) -> str:
    return _ratio(f"2 * {p} * {r}", f"{p} + {r}")


class _Measures:
    """Measures as SQL over counters, which takes one parse where columns take hundreds of calls."""

    def __init__(self) -> None:
        self.columns: dict[str, str] = {}

    def of(self, counters: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """The measures, F1 from columns that are there already."""
        plain = [f"{v} as {k}" for k, v in self.columns.items() if not k.startswith("f1_")]
        return counters.selectExpr(*keep, *plain).selectExpr(*keep, *[f"{v} as {k}" if k.startswith("f1_") else k for k, v in self.columns.items()])

    def precision_recall(self, name: str, right: str, answered: str, gold: str) -> None:
        self.columns[f"precisao_{name}"] = _ratio(right, answered)
        self.columns[f"recall_{name}"] = _ratio(right, gold)

    def family(self, name: str, right: str, answered: str, gold: str, gold_guards: bool = False) -> None:
        """Precision, recall, F1 and accuracy; with ``gold_guards`` precision is 0 too where there is no gold."""
        self.precision_recall(name, right, answered, gold)
        if gold_guards:
            self.columns[f"precisao_{name}"] = f"case when {gold} > 0 then cast({right} as double) / greatest({answered}, 1) else 0D end"
        self.columns[f"f1_{name}"] = _f1(f"precisao_{name}", f"recall_{name}")
        self.columns[f"acuracia_{name}"] = _ratio(right, f"greatest({gold}, {answered})")


def flat_measures(counters: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    m = _Measures()
    eg, er, pg, pr = "total_empresas_gabarito", "total_empresas_resposta", "total_pessoas_gabarito", "total_pessoas_resposta"
    m.family("empresas", "empresas_corretas", er, eg)
    m.precision_recall("empresas_nomes", "empresas_nomes_corretos", er, eg)
    m.precision_recall("empresas_cnpjs", "empresas_cnpjs_corretos", er, eg)
    for name, n in (("nome_cpf", "pessoas_nome_cpf_corretas"), ("nome_rg", "pessoas_nome_rg_corretas"), ("completa", "pessoas_completas")):
        m.family(f"pessoas_{name}", n, pr, pg)
    for name in ("nome", "cpf", "rg"):
        m.precision_recall(f"pessoas_{name}", f"pessoas_{name}_correto", pr, pg)
    for name, n in (("nome_cpf", "nome_cpf"), ("nome_rg", "nome_rg"), ("completo", "nome_cpf_rg")):
        m.family(f"empresa_socio_{name}", f"empresa_socio_{n}", pr, pg)
    m.family("global", "(empresas_corretas + pessoas_completas)", f"({er} + {pr})", f"({eg} + {pg})")
    whole = "empresas_com_socios_completos"
    m.family("global_completa", whole, er, eg, gold_guards=True)
    m.columns["taxa_documentos_completos"] = f"{_ratio(whole, eg)} * 100"
    m.columns["taxa_documentos_parciais"] = f"{_ratio('empresas_com_socios_parciais', eg)} * 100"
    return m.of(counters, keep)


def nested_measures(counters: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    m = _Measures()
    eg, er, sg, sr = "total_empresas_gabarito", "total_empresas_resposta", "total_socios_gabarito", "total_socios_resposta"
    m.family("empresas", "empresas_corretas", er, eg)
    m.precision_recall("nomes", "nomes_corretos", er, eg)
    m.precision_recall("cnpjs", "cnpjs_corretos", er, eg)
    for name, n in (("nome_cpf", "socios_nome_cpf_corretos"), ("nome_rg", "socios_nome_rg_corretos"), ("completo", "socios_completos")):
        m.family(f"socios_{name}", n, sr, sg)
    m.precision_recall("socios_cpf_rg", "socios_cpf_rg_corretos", sr, sg)
    for name in ("nome", "cpf", "rg"):
        m.precision_recall(f"socios_{name}", f"socios_{name}_correto", sr, sg)
    for name, n in (("nome_cpf", "nome_cpf"), ("nome_rg", "nome_rg"), ("completo", "nome_cpf_rg")):
        m.family(f"empresa_socio_{name}", f"empresa_socio_{n}", sr, sg, gold_guards=True)
    whole = "empresas_com_socios_completos"
    m.family("global_completa", whole, er, eg, gold_guards=True)
    m.columns["taxa_empresas_completas"] = _ratio(whole, eg)
    m.columns["taxa_empresas_parciais"] = _ratio("empresas_com_socios_parciais", eg)
    return m.of(counters, keep)


def macro(counters: DataFrame) -> DataFrame:
    """Means over documents of passing: precision over those with answered companies, recall over those with gold ones."""
    passed = F.col(PASS).cast("double")
    zero = F.lit(0.0)
    got = counters.agg(
        F.count(F.lit(1)).alias("documentos_processados"),
        F.count_if(F.col(PASS)).alias("documentos_passaram"),
        F.coalesce(F.avg(F.when(F.col("total_empresas_resposta") > 0, passed)), zero).alias("precisao_media"),
        F.coalesce(F.avg(F.when(F.col("total_empresas_gabarito") > 0, passed)), zero).alias("recall_media"),
        F.coalesce(F.avg(passed), zero).alias("acuracia_media"),
    )
    rate = _ratio("documentos_passaram", "documentos_processados")
    return got.selectExpr("*", f"{rate} as taxa_documentos_completos", f"{_f1('precisao_media', 'recall_media')} as f1_media")


def passed_documents(counters: DataFrame) -> DataFrame:
    """Ids of the documents that passed; a table, for the list may be long."""
    return counters.filter(F.col(PASS)).select("id")
