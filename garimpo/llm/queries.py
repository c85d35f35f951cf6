"""Queries of the text-preparation operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import leakage, lookalikes, mixing, mojibake, reading, refinement, splitting
from garimpo.session import ship, table, text_table

Query = Callable[[SparkSession, str], DataFrame]

NAMED = (("empresa", "empresa_id"), ("socio", "socio_id"))
RECORDS = (("empresa", "empresa_id", ("nome", "cnpj")), ("socio", "socio_id", ("nome", "cpf", "rg")))


def _names(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    a, b = (table(spark, d, t).select(F.lit(t).alias("tabela"), F.col(k).alias("registro_id"), "nome") for t, k in NAMED)
    return lookalikes.with_consistent(a.unionByName(b), "nome", "nome_consistente")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).filter("nome_consistente_changed").select("tabela", "registro_id")


def p1_names(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("tabela", "registro_id", "nome_consistente")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    dictionaries = mojibake.train(mojibake.samples(text_table(spark, d, "documents"), "doc_id", "text", "lang"))
    return mojibake.wrongly_decoded(text_table(spark, d, "loader"), "load_id", "text", dictionaries)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("load_id")


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return splitting.split_oversized(text_table(spark, d, "loader", "load_id", "text"), "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _oversized(spark, d).filter(F.size("pecas") > 1).select("load_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_oversized(spark, d), "load_id", "text")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Both tables at once, their values in three columns."""
    parts = [
        table(spark, d, t).select(F.lit(t).alias("tabela"), "arquivo", F.col(k).alias("registro_id"), *[(F.col(f[i]) if i < len(f) else F.lit(None).cast("string")).alias(f"valor{i}") for i in range(3)])
        for t, k, f in RECORDS
    ]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return refinement.duplicate_pairs(_records(spark, d), ("tabela", "arquivo"), "registro_id", ("valor0", "valor1", "valor2")).select("tabela", "id_menor", "id_maior")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return refinement.collapse(_records(spark, d), ("tabela", "arquivo"), "registro_id", ("valor0", "valor1", "valor2")).select("tabela", "arquivo", "registro_id", "copias")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_passages(spark, d).select("doc_id", "item_id")


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return leakage.leaks(text_table(spark, d, "documents"), "doc_id", "text", table(spark, d, "itens_avaliacao"), "item_id", "text")


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    ship(spark)
    wanted = mixing.targets(table(spark, d, "metas_mistura"), "source", "peso_alvo", "max_repeticoes")
    return mixing.mix(text_table(spark, d, "documents"), "doc_id", "source", "text", wanted)


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


def _levels(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    ship(spark)
    return reading.levels(text_table(spark, d, "documents"), "doc_id", "text", table(spark, d, "rotulos_leitura"), "doc_id", "nivel", keep)


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p8_held_out(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return reading.held_out(text_table(spark, d, "documents"), "doc_id", "text", table(spark, d, "rotulos_leitura"), "doc_id", "nivel")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    by_level = [F.count_if(F.col("nivel") == k).alias(f"nivel_{k}") for k in range(1, reading.LEVELS + 1)]
    return _levels(spark, d, "source").groupBy("source").agg(F.count(F.lit(1)).alias("documentos"), F.avg("nivel_estimado").alias("nivel_medio"), *by_level)


# the lower case of the upper case folds in full but for ligatures, which the second replacement writes out
_STRIP = r"translate(lower(upper(replace(replace(regexp_replace(nfc_normalize(coalesce({0}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g'), 'ﬁ', 'fi'), 'ß', 'ss'))), 'ς', 'σ')"


def _keys(t: str, k: str, fields: tuple[str, ...]) -> str:
    values = ", ".join(_STRIP.format(f) for f in fields)
    return f"SELECT '{t}' AS tabela, arquivo, {k} AS id, list_sort(list_filter([{values}], lambda v: v <> '')) AS chave FROM {t}"


_BOTH = " UNION ALL ".join(_keys(*r) for r in RECORDS)
_WINDOWS = """SELECT DISTINCT {id}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 11)) AS i
    FROM (SELECT {id}, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}))"""
_SCRIPTS = " + ".join(f"regexp_matches(w, '\\p{{{x}}}')::INT" for x in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee"))
SQL = {
    # stated by kinds of characters, where the operator goes by its mapping
    "p1_found": f"""SELECT tabela, registro_id FROM (SELECT 'empresa' AS tabela, empresa_id AS registro_id, nome FROM empresa UNION ALL SELECT 'socio', socio_id, nome FROM socio)
        WHERE regexp_matches(nome, '[\\p{{Cf}}\\x00-\\x08\\x0e-\\x1b\\x7f-\\x84\\x86-\\x9f]') OR nfc_normalize(nome) <> nome
        OR regexp_matches(nome, '[\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{ff01}}-\\x{{ff5e}}\\x{{fb00}}-\\x{{fb06}}]')
        OR len(list_filter(regexp_extract_all(nome, '[\\p{{L}}\\p{{M}}]+'), lambda w: {_SCRIPTS} > 1)) > 0""",
    "p6_found": f"""SELECT DISTINCT doc_id, item_id FROM ({_WINDOWS.format(id="doc_id", t="documents")}) JOIN ({_WINDOWS.format(id="item_id", t="itens_avaliacao")}) USING (g)""",
    # passages are islands of windows; offsets are sums over the stretches with and without letters or digits
    "p6_passages": f"""WITH hits AS (SELECT DISTINCT doc_id, item_id, d.i FROM ({_WINDOWS.format(id="doc_id", t="documents").replace("DISTINCT doc_id", "doc_id, i")}) d
            JOIN ({_WINDOWS.format(id="item_id", t="itens_avaliacao")}) USING (g)),
        runs AS (SELECT doc_id, item_id, min(i) AS a, max(i) + 11 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS run
            FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 THEN 0 ELSE 1 END AS new FROM hits)) GROUP BY doc_id, item_id, run),
        parts AS (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}]+|[^\\p{{L}}\\p{{N}}\\p{{M}}]+') AS s
            FROM documents WHERE doc_id IN (SELECT doc_id FROM hits))),
        places AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS w, begin, begin + length(p) AS fin FROM (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) - length(p) AS begin FROM parts)
            WHERE regexp_matches(p, '[\\p{{L}}\\p{{N}}]')),
        totals AS (SELECT doc_id, item_id, sum(b - a + 1)::INT AS n_palavras, count(*)::INT AS n_trechos, min(a) AS a, arg_min(b, a) AS b FROM runs GROUP BY doc_id, item_id)
        SELECT t.doc_id, item_id, n_palavras, n_trechos, x.begin::INT AS inicio, y.fin::INT AS fim FROM totals t JOIN places x ON t.doc_id = x.doc_id AND t.a = x.w JOIN places y ON t.doc_id = y.doc_id AND t.b = y.w""",
    "p4_found": "SELECT load_id FROM loader WHERE length(text) > 4000",
    "p5_found": f"""WITH k AS ({_BOTH})
        SELECT a.tabela, a.id AS id_menor, b.id AS id_maior FROM k a JOIN k b
        ON a.tabela = b.tabela AND a.arquivo = b.arquivo AND a.chave = b.chave AND a.id < b.id""",
    "p5_records": f"""WITH k AS ({_BOTH})
        SELECT tabela, arquivo, min(id) AS registro_id, count(*) AS copias FROM k WHERE arquivo IS NOT NULL GROUP BY tabela, arquivo, chave
        UNION ALL SELECT tabela, arquivo, id, 1 FROM k WHERE arquivo IS NULL""",
}

QUERIES: dict[str, Query] = {"p1_found": p1_found, "p1_names": p1_names, "p2_found": p2_found, "p2_restored": p2_restored, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p6_passages": p6_passages, "p7_documents": p7_documents, "p7_shares": p7_shares, "p8_levels": p8_levels, "p8_held_out": p8_held_out, "p8_profile": p8_profile}
