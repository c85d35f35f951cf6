"""Queries over texts, answers, identifiers, vectors and files, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import normalize as N
from garimpo.functions.similarity import similarity
from garimpo.operators import chunking, embedding, extraction, filters, parsing, prompts, retrieval
from garimpo.plans.scoring import GOLD, NESTED_GOLD, nested_docs, sql_digits, sql_doc, sql_firm, sql_ident, sql_norm, sql_rg, sql_strip
from garimpo.session import shared_dir, ship, table, text_table
from garimpo.sources import files, sinks

MAX_CHARS, K, EVERY = 50_000, 5, 20


def load_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", files.truncate("text", MAX_CHARS).alias("texto"))


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    answered = table(spark, d, "parse_resposta_v1").select("arquivo")
    return sinks.pending(table(spark, d, "documents").select("doc_id", "arquivo"), answered, "arquivo")


def chunk_split(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return chunking.chunk_table(text_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 1000, 100, ("\n\n", "\n", ". ", " "))


def chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loader").select("load_id", F.posexplode(chunking.pieces("text", ";")).alias("ord", "peca"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.filter(F.col("vec_id") % EVERY == 0), v


def topk_retrieval(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return retrieval.top_k(q, v, "vec_id", "vec_id", "embedding", K).withColumn("dist", F.round("dist", 6))


def topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return retrieval.top_k(q, v, "vec_id", "vec_id", "embedding", K, "label").withColumn("dist", F.round("dist", 6))


def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    ranked = retrieval.top_k(q, v, "vec_id", "vec_id", "embedding", K, "label")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.contexts(ranked.join(texts, "chunk_id"), "query_id", "text")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    u = retrieval.unit("v")
    return v.select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norma"), F.round(F.get(u, F.lit(0)), 6).alias("primeiro"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "empresa").select(F.lit("empresa").alias("tabela"), F.col("empresa_id").alias("id"), "nome")
    return a.unionByName(table(spark, d, "socio").select(F.lit("socio").alias("tabela"), F.col("socio_id").alias("id"), "nome"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("tabela", "id", N.normalize_text("nome").alias("nome"))


def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    return text_table(spark, d, "documents", "doc_id", "text").select("doc_id", N.normalize_text("text").alias("texto"))


def normalize_ids(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "empresa").select(F.lit("empresa").alias("tabela"), F.col("empresa_id").alias("id"), "arquivo", F.col("cnpj").alias("i"), F.lit(None).cast("string").alias("rg"))
    b = table(spark, d, "socio").select(F.lit("socio").alias("tabela"), F.col("socio_id").alias("id"), "arquivo", F.col("cpf").alias("i"), "rg")
    return a.unionByName(b).select(
        "tabela",
        "id",
        N.normalize_doc_id("arquivo").alias("documento"),
        N.normalize_identifier("i").alias("identificador"),
        N.digits("i").alias("algarismos"),
        N.normalize_rg("rg").alias("rg"),
        N.normalize_rg("rg", False).alias("rg_simples"),
        N.is_null_word("i").alias("vazio"),
    )


def strip_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "empresa").select("empresa_id", N.company_name("nome").alias("nome"), N.sanitize("nome").alias("seguro"))


def _answers(spark: SparkSession, d: str, asked: str | None = None) -> DataFrame:
    df = table(spark, d, "parse_resposta_v1")
    return df.filter(F.col("pergunta") == asked) if asked else df


def clean_response(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("resposta_id", parsing.clean_response("raw").alias("limpa"), parsing.plain_text("raw").alias("corrida"))


def strict_object(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("resposta_id", parsing.strict_json("raw").alias("objeto"))


def balanced_object(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _answers(spark, d).select("resposta_id", parsing.balanced_object(parsing.clean_response("raw")).alias("objeto"))


def schema_echo(spark: SparkSession, d: str) -> DataFrame:
    """Of each answer's object, and of the same with the partners' list under a key of JSON Schema."""
    blob = parsing.strict_json("raw")
    return _answers(spark, d).select("resposta_id", parsing.is_schema_echo(blob).alias("esquema"), parsing.is_schema_echo(F.replace(blob, F.lit('"socios"'), F.lit('"properties"'))).alias("esquema_posto"))


def _exploded(df: DataFrame, rows) -> DataFrame:
    return df.select("resposta_id", F.posexplode(rows).alias("ord", "r")).select("resposta_id", "ord", "r.*")


def parse_company_text(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_answers(spark, d, "empresas"), parsing.text_companies("raw"))


def parse_person_text(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_answers(spark, d, "pessoas"), parsing.text_persons("raw"))


def lenient_companies(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _answers(spark, d, "empresas").select("resposta_id", parsing.lenient_companies("raw").alias("r")).select("resposta_id", "r.itens", "r.erro")


def lenient_persons(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return _answers(spark, d, "pessoas").select("resposta_id", parsing.lenient_persons("raw").alias("r")).select("resposta_id", "r.itens", "r.erro")


def strict_companies(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_answers(spark, d, "empresas"), parsing.strict_companies("raw"))


def strict_partners(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_answers(spark, d, "pessoas"), parsing.strict_partners("raw"))


def correction_text(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        q(spark, d).select("resposta_id", parsing.correction(F.col("erro"), line).alias("dica"))
        for q, line in ((lenient_companies, prompts.COMPANY_LINE), (lenient_persons, prompts.PERSON_LINE))
    ]
    return parts[0].unionByName(parts[1]).filter("dica is not null")


def public_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "empresa").filter(filters.is_public_body("nome")).select("empresa_id", "nome")


def rejected_companies(spark: SparkSession, d: str) -> DataFrame:
    return filters.gate_companies(table(spark, d, "empresa"))[1].select("empresa_id", "motivo")


def doc_gate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "socio").select("socio_id", filters.has_document("cpf", "rg").alias("aceito"), filters.blank_null_words("cpf").alias("cpf"), filters.blank_null_words("rg").alias("rg"))


def similarity_names(spark: SparkSession, d: str) -> DataFrame:
    """Each company's name against the one before it in the same file."""
    ship(spark)
    by = Window.partitionBy("arquivo").orderBy("empresa_id")
    df = table(spark, d, "empresa").select("empresa_id", "arquivo", N.company_name("nome").alias("n"))
    df = df.withColumn("antes", F.lag("n").over(by)).filter("antes is not null")
    return df.select("empresa_id", F.round(similarity(F.col("antes"), F.col("n")), 6).alias("semelhanca"))


def extract_identifiers(spark: SparkSession, d: str) -> DataFrame:
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (_CNPJ, _CPF)]
    return table(spark, d, "documents").select("doc_id", F.array_join(found[0], " ").alias("cnpjs"), F.array_join(found[1], " ").alias("cpfs"))


_CNPJ, _CPF = r"[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}", r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}"


def extract_chained(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    docs = text_table(spark, d, "documents", "arquivo", "text")
    got = extraction.chained(docs, "arquivo", "text", extraction.Patterns)
    return got.select("arquivo", "ord", "empresa", "cnpj", F.to_json("socios").alias("socios"))


def question_contexts(spark: SparkSession, d: str) -> DataFrame:
    """For each company the context of the question about its partners, from the chunks of its own document."""
    ship(spark)
    docs = text_table(spark, d, "documents", "arquivo", "text")
    asked = table(spark, d, "empresa").select("arquivo", "empresa_id", prompts.partners_question(N.text_or_empty("nome"), N.text_or_empty("cnpj")).alias("pergunta"))
    return embedding.question_contexts(docs, "arquivo", "text", asked, "empresa_id", "pergunta", embedding.Hashing, 5, 600, 100, ("\n\n", "\n", ". ", " "))


def extract_independent(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return extraction.independent(_answers(spark, d), "arquivo", "raw", "pergunta")


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    e, s = table(spark, d, "empresa"), table(spark, d, "socio")
    one = F.lit("total").alias("escopo")
    a = e.groupBy(one).agg(F.countDistinct("arquivo").alias("documentos"), F.count(F.lit(1)).alias("empresas"))
    b = s.groupBy(one).agg(F.count(F.lit(1)).alias("socios"), F.count_if(filters.has_document("cpf", "rg")).alias("socios_com_documento"))
    return a.join(b, "escopo")


def csv_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities written as CSV and read again through the loose reader."""
    views = {t: table(spark, d, t) for t in ("empresa", "socio")}
    df = spark.sql(GOLD.replace("FROM empresa", "FROM {empresa}").replace("FROM socio", "FROM {socio}"), **views).withColumnRenamed("tipo", "tipo_entidade")
    place = f"{shared_dir(spark).rstrip('/')}/garimpo-csv-{uuid.uuid4().hex}"
    sinks.write_entities_csv(df, place)
    return files.entities_csv(spark, place).select("id", "tipo", "nome", "identificador", "aux")


def nested_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested results written as JSON and read again."""
    place = f"{shared_dir(spark).rstrip('/')}/garimpo-json-{uuid.uuid4().hex}"
    sinks.write_nested_json(nested_docs(spark, d, NESTED_GOLD), "id", place)
    return files.nested_json_lines(spark, place).select("id", F.size("empresas").alias("empresas"), F.aggregate("empresas", F.lit(0), lambda n, e: n + F.size(e.socios)).alias("socios"))


def _sql_plain(clean: str) -> str:
    return f"trim(regexp_replace(regexp_replace({clean}, '<[^>]+>', '', 'g'), '[{N.SPACE}]+', ' ', 'g'))"


_THOUGHT = f"regexp_replace({sql_strip('raw')}, '{parsing.THINK}', '', 'g')"
_CLEAN = sql_strip(f"regexp_replace({sql_strip(_THOUGHT)}, '{parsing.FENCE}', '\\1', 'g')")
_PLAIN = _sql_plain(_CLEAN)
_STRICT = sql_strip(f"regexp_replace(coalesce(raw, ''), '{parsing.THINK_STRICT}', '', 'g')")
_BODY = r"```(?:json)?\s*([\s\S]*?)\s*```"
_NAME_NULLS = ", ".join(f"'{w}'" for w in N.PARSE_NAME_NULLS)
_PUBLIC = " OR ".join(f"contains(lower(coalesce(nome, '')), '{t}')" for t in filters.PUBLIC_BODIES)


def _in(x: str, words: tuple[str, ...]) -> str:
    return f"lower({sql_strip(x)}) IN ({', '.join(repr(w) for w in words)})"


def _blank(x: str) -> str:
    return f"CASE WHEN {_in(x, N.POST_DOC_NULLS)} THEN '' ELSE {sql_strip(x)} END"


_HAS = f"((NOT {_in('cpf', N.SCHEMA_DOC_NULLS)} OR NOT {_in('rg', N.SCHEMA_DOC_NULLS)}) AND ({_blank('cpf')} <> '' OR {_blank('rg')} <> ''))"
_RECORDS = "list_filter(list_transform(string_split(t, ';'), lambda r: trim(r)), lambda r: r <> '')"
_DIST = "power(list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 2)"


def _ranked(on: str) -> str:
    return f"""SELECT * FROM (SELECT q.label, q.vec_id AS query_id, r.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, r.vec_id)::INT AS rank, {_DIST} AS dist
        FROM embeddings q JOIN embeddings r ON {on} WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {K}"""


def _unnested(items: str, cols: dict[str, str], asked: str) -> str:
    picked = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return f"""SELECT resposta_id, (i - 1)::INT AS ord, {picked} FROM (SELECT resposta_id, items, unnest(generate_series(1, len(items))) AS i
        FROM (SELECT resposta_id, {items} AS items FROM (SELECT resposta_id, {_PLAIN} AS t FROM parse_resposta_v1 WHERE pergunta = '{asked}')))"""


_FIRM_ITEMS = f"""list_filter(list_transform({_RECORDS}, lambda r: CASE WHEN contains(r, ',') THEN {{'nome': trim(r[:instr(r, ',') - 1]), 'cnpj': trim(r[instr(r, ',') + 1:])}} ELSE {{'nome': r, 'cnpj': ''}} END),
    lambda x: lower(x.nome) NOT IN ({_NAME_NULLS}))"""
_PERSON_ITEMS = f"""list_filter(list_transform({_RECORDS}, lambda r: {{'nome': trim(string_split(r, ',')[1]), 'cpf': trim(coalesce(string_split(r, ',')[2], '')),
    'rg': trim(coalesce(array_to_string(string_split(r, ',')[3:], ','), ''))}}), lambda x: x.nome <> '' AND lower(x.nome) NOT IN ({_NAME_NULLS}))"""

_BOTH_IDS = "SELECT 'empresa' AS tabela, empresa_id AS id, arquivo, cnpj AS i, NULL::VARCHAR AS rg FROM empresa UNION ALL SELECT 'socio', socio_id, arquivo, cpf, rg FROM socio"

_OBJECT = f"""SELECT resposta_id, CASE WHEN regexp_extract(b, '(\\{{[\\s\\S]*\\}})', 1) = '' THEN b ELSE regexp_extract(b, '(\\{{[\\s\\S]*\\}})', 1) END AS objeto FROM (SELECT resposta_id,
    CASE WHEN regexp_matches(t, '{_BODY}') THEN {sql_strip(f"regexp_extract(t, '{_BODY}', 1)")} ELSE t END AS b FROM (SELECT resposta_id, {_STRICT} AS t FROM parse_resposta_v1 WHERE @))"""


# DuckDB's reader also takes trailing commas and NaN
_LOOSE = r"""regexp_matches(regexp_replace(objeto, '"(?:[^"\\]|\\.)*"', '""', 'g'), '(?i),\s*[}\]]|nan|inf')"""


def _echo(x: str) -> str:
    """Whether a valid object has a key of JSON Schema."""
    return f"coalesce(list_has_any(json_keys(CASE WHEN json_valid({x}) AND NOT {_LOOSE} THEN {x} END), ['" + "', '".join(parsing.SCHEMA_KEYS) + "']), false)"


def _strict_rows(asked: str, key: str, good: str, cols: dict[str, str]) -> str:
    """Rows of the lists all of whose items are good."""
    lists = f"SELECT resposta_id, json_extract(CASE WHEN json_valid(objeto) AND NOT {_LOOSE} THEN objeto::JSON END, '$.{key}[*]') AS l FROM ({_OBJECT.replace('@', f"pergunta = '{asked}'")})"
    kept = f"SELECT resposta_id, l, unnest(generate_series(1, len(l))) AS i FROM ({lists}) WHERE len(list_filter(l, lambda e: NOT coalesce({good}, false))) = 0"
    return f"SELECT resposta_id, (i - 1)::INT AS ord, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM (SELECT resposta_id, i, l[i] AS e FROM ({kept}))"


def _js(k: str) -> str:
    return f"json_extract_string(e, '$.{k}')"


_STRICT_FIRM = f"json_type(e, '$.nome') = 'VARCHAR' AND json_type(e, '$.cnpj') = 'VARCHAR' AND {sql_strip(_js('nome'))} <> '' AND {sql_strip(_js('cnpj'))} <> ''"
_STRICT_PARTNER = f"""json_type(e, '$.nome') = 'VARCHAR' AND {sql_strip(_js("nome"))} <> '' AND coalesce(json_type(e, '$.cpf'), 'VARCHAR') = 'VARCHAR' AND coalesce(json_type(e, '$.rg'), 'VARCHAR') = 'VARCHAR'
    AND (NOT {_in(_js("cpf"), N.SCHEMA_DOC_NULLS)} OR NOT {_in(_js("rg"), N.SCHEMA_DOC_NULLS)})"""

QUERIES = {
    f.__name__: f
    for f in (
        load_truncate,
        resume_antijoin,
        chunk_split,
        chunk_pieces,
        topk_retrieval,
        topk_scoped,
        context_assembly,
        unit_vectors,
        normalize_text,
        normalize_documents,
        normalize_ids,
        strip_suffixes,
        clean_response,
        strict_object,
        balanced_object,
        schema_echo,
        parse_company_text,
        parse_person_text,
        lenient_companies,
        lenient_persons,
        strict_companies,
        strict_partners,
        correction_text,
        public_filter,
        rejected_companies,
        doc_gate,
        similarity_names,
        extract_identifiers,
        extract_chained,
        extract_independent,
        question_contexts,
        run_statistics,
        csv_entities,
        nested_json,
    )
}
SQL = {
    "load_truncate": f"SELECT doc_id, substring(text, 1, {MAX_CHARS}) AS texto FROM documents WHERE length(text) > 0",
    "resume_antijoin": "SELECT doc_id, arquivo FROM documents d WHERE NOT EXISTS (SELECT 1 FROM parse_resposta_v1 p WHERE p.arquivo = d.arquivo)",
    "chunk_pieces": """SELECT load_id, (i - 1)::INT AS ord, p[i] AS peca FROM (SELECT load_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT load_id,
        list_filter(list_transform(string_split(text, ';'), lambda x, i: CASE WHEN i = 1 THEN x ELSE ';' || x END), lambda x: x <> '') AS p FROM loader WHERE text IS NOT NULL))""",
    "topk_retrieval": f"SELECT query_id, chunk_id, rank, round(dist, 6) AS dist FROM ({_ranked('true')})",
    "topk_scoped": f"SELECT query_id, chunk_id, rank, round(dist, 6) AS dist FROM ({_ranked('q.label = r.label')})",
    "context_assembly": f"SELECT query_id, substring(string_agg(text, chr(10) || chr(10) ORDER BY rank), 1, 30000) AS contexto FROM ({_ranked('q.label = r.label')}) JOIN documents ON doc_id = chunk_id GROUP BY query_id",
    "unit_vectors": """SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norma, round(u[1], 6) AS primeiro FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u
        FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings))""",
    "normalize_text": f"SELECT 'empresa' AS tabela, empresa_id AS id, {sql_norm('nome')} AS nome FROM empresa UNION ALL SELECT 'socio', socio_id, {sql_norm('nome')} FROM socio",
    "normalize_documents": f"SELECT doc_id, {sql_norm('text')} AS texto FROM documents",
    "normalize_ids": f"""SELECT tabela, id, {sql_doc("arquivo")} AS documento, {sql_ident("i")} AS identificador, {sql_digits("i")} AS algarismos, {sql_rg("rg")} AS rg,
        {sql_rg("rg", False)} AS rg_simples, {_in("i", N.SCORE_NULLS)} AS vazio FROM ({_BOTH_IDS})""",
    "strip_suffixes": f"SELECT empresa_id, {sql_firm('nome')} AS nome, replace(coalesce(nome, ''), ',', ' -') AS seguro FROM empresa",
    "clean_response": f"SELECT resposta_id, {_CLEAN} AS limpa, {_PLAIN} AS corrida FROM parse_resposta_v1",
    "strict_object": _OBJECT.replace("@", "true"),
    "strict_companies": _strict_rows("empresas", "empresas", _STRICT_FIRM, {"nome": sql_strip(_js("nome")), "cnpj": sql_strip(_js("cnpj"))}),
    "strict_partners": _strict_rows("pessoas", "socios", _STRICT_PARTNER, {"nome": sql_strip(_js("nome")), "cpf": f"coalesce({_js('cpf')}, '')", "rg": f"coalesce({_js('rg')}, '')"}),
    "parse_company_text": _unnested(_FIRM_ITEMS, {"nome": "items[i].nome", "cnpj": "items[i].cnpj"}, "empresas"),
    "parse_person_text": _unnested(_PERSON_ITEMS, {"nome": "items[i].nome", "cpf": "items[i].cpf", "rg": "items[i].rg"}, "pessoas"),
    "public_filter": f"SELECT empresa_id, nome FROM empresa WHERE {_PUBLIC}",
    "rejected_companies": f"SELECT empresa_id, CASE WHEN {sql_strip('cnpj')} = '' THEN 'sem_cnpj' ELSE 'orgao_publico' END AS motivo FROM empresa WHERE {sql_strip('cnpj')} = '' OR {_PUBLIC}",
    "doc_gate": f"SELECT socio_id, {_HAS} AS aceito, {_blank('cpf')} AS cpf, {_blank('rg')} AS rg FROM socio",
    "extract_identifiers": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_CNPJ}'), ' ') AS cnpjs, array_to_string(regexp_extract_all(text, '{_CPF}'), ' ') AS cpfs FROM documents",
    "run_statistics": f"""SELECT 'total' AS escopo, (SELECT count(DISTINCT arquivo) FROM empresa) AS documentos, (SELECT count(*) FROM empresa) AS empresas, (SELECT count(*) FROM socio) AS socios,
        (SELECT count(*) FROM socio WHERE {_HAS}) AS socios_com_documento""",
    "csv_entities": f"""SELECT id, tipo, nome, identificador, aux FROM (SELECT {sql_doc("arquivo")} AS id, tipo, {sql_strip("replace(nome, ',', ' -')")} AS nome, {sql_strip("identificador")} AS identificador, {sql_strip("aux")} AS aux
        FROM ({GOLD}) WHERE NOT (tipo = 'Empresa' AND ({_PUBLIC.replace("nome", "replace(nome, ',', ' -')")}))) WHERE nome <> '' AND id <> ''""",
    "nested_json": f"""SELECT f.id, count(DISTINCT f.key)::INT AS empresas, count(s.key)::INT AS socios FROM ({NESTED_GOLD[0]}) f LEFT JOIN ({NESTED_GOLD[1]}) s ON s.key = f.key WHERE f.id IS NOT NULL GROUP BY f.id""",
    # tokens of the text from the first brace on: quotes so far tell strings, braces outside strings the depth
    "balanced_object": f"""WITH t AS (SELECT resposta_id, {_CLEAN} AS t FROM parse_resposta_v1),
        k AS (SELECT resposta_id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM (SELECT resposta_id, regexp_extract_all(t[instr(t, '{{'):], '(?s)\\\\.|["{{}}]|[^\\\\"{{}}]+') AS x FROM t WHERE contains(t, '{{'))),
        q AS (SELECT *, sum((c = '"')::INT) OVER (PARTITION BY resposta_id ORDER BY i) % 2 AS inside FROM k),
        d AS (SELECT *, sum(CASE WHEN inside = 1 THEN 0 WHEN c = '{{' THEN 1 WHEN c = '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY resposta_id ORDER BY i) AS depth FROM q),
        e AS (SELECT resposta_id, min(i) AS e FROM d WHERE depth = 0 AND inside = 0 GROUP BY resposta_id),
        o AS (SELECT resposta_id, string_agg(c, '' ORDER BY i) AS objeto FROM k JOIN e USING (resposta_id) WHERE i <= e GROUP BY resposta_id)
        SELECT resposta_id, objeto FROM t LEFT JOIN o USING (resposta_id)""",
    "schema_echo": f"""SELECT resposta_id, {_echo("objeto")} AS esquema, {_echo("replace(objeto, '\"socios\"', '\"properties\"')")} AS esquema_posto FROM ({_OBJECT.replace('@', 'true')})""",
}
