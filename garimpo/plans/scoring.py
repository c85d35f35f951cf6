"""Scoring queries: the stored companies and partners as gold, a deterministic rewriting of them as the answer.

The answer drops, blanks and changes values by what they contain, and lists its
entities in reverse, so that every counter has cases. Both sides are whole
tables. The inputs are written in SQL that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import normalize as N
from garimpo.operators import matching, metrics
from garimpo.session import table

GOLD = """SELECT arquivo, empresa_id AS o, 'Empresa' AS tipo, nome, cnpj AS identificador, '' AS aux FROM empresa
    UNION ALL SELECT arquivo, socio_id, 'Pessoa', nome, cpf, rg FROM socio"""
ANSWER = """SELECT arquivo, -empresa_id AS o, 'Empresa' AS tipo, replace(nome, 'LTDA', 'EIRELI') AS nome,
        CASE WHEN right(cnpj, 1) = '1' THEN '' WHEN right(cnpj, 1) = '2' THEN replace(cnpj, '0', '9') ELSE cnpj END AS identificador, '' AS aux
        FROM empresa WHERE nome NOT LIKE '%EPP'
    UNION ALL SELECT arquivo, -socio_id, 'Pessoa', replace(nome, ' de ', ' '), CASE WHEN right(cpf, 1) = '3' THEN '' ELSE cpf END,
        CASE WHEN right(rg, 1) = 'X' THEN '' ELSE rg END FROM socio WHERE nome NOT LIKE '%Neto'"""


def _flat(spark: SparkSession, d: str, sql: str) -> DataFrame:
    views = {t: table(spark, d, t) for t in ("empresa", "socio")}
    df = spark.sql(sql.replace("FROM empresa", "FROM {empresa}").replace("FROM socio", "FROM {socio}"), **views)
    df = df.select(N.normalize_doc_id("arquivo").alias("id"), F.col("o").alias("ord"), "tipo", "nome", "identificador", "aux")
    blank = (N.strip("nome") == "") & (N.strip("identificador") == "")
    return df.filter((F.col("id") != "") & ~blank)


def flat_match_docs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.flat_counters(matching.match_flat(_flat(spark, d, GOLD), _flat(spark, d, ANSWER)))


def flat_match_similar(spark: SparkSession, d: str) -> DataFrame:
    """At the tolerance 0.95, by string similarity."""
    return metrics.flat_counters(matching.match_flat(_flat(spark, d, GOLD), _flat(spark, d, ANSWER), 0.95))


def _rounded(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"round({c}, 6) as {c}" if t == "double" else c for c, t in df.dtypes])


def flat_metrics_global(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.flat_measures(metrics.totals(flat_match_docs(spark, d), metrics.FLAT)))


def flat_metrics_docs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.flat_measures(flat_match_docs(spark, d), ("id",)))


def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rollup(flat_match_docs(spark, d), metrics.FLAT)


def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.macro(flat_match_docs(spark, d)))


def passed_docs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.passed_documents(flat_match_docs(spark, d))


NESTED_GOLD = (
    "SELECT arquivo AS id, empresa_id AS ord, empresa_id AS key, nome AS empresa, cnpj FROM empresa",
    "SELECT empresa_id AS key, socio_id AS ord, nome, cpf, rg FROM socio",
)
NESTED_ANSWER = (
    "SELECT arquivo AS id, -empresa_id AS ord, empresa_id AS key, replace(nome, 'LTDA', 'EIRELI') AS empresa, "
    "CASE WHEN right(cnpj, 1) = '1' THEN '' WHEN right(cnpj, 1) = '2' THEN replace(cnpj, '0', '9') ELSE cnpj END AS cnpj FROM empresa WHERE nome NOT LIKE '%EPP'",
    "SELECT empresa_id AS key, -socio_id AS ord, replace(nome, ' de ', ' ') AS nome, CASE WHEN right(cpf, 1) = '3' THEN '' ELSE cpf END AS cpf, "
    "CASE WHEN right(rg, 1) = 'X' THEN '' ELSE rg END AS rg FROM socio WHERE nome NOT LIKE '%Neto'",
)


def nested_docs(spark: SparkSession, d: str, sql: tuple[str, str]) -> DataFrame:
    views = {t: table(spark, d, t) for t in ("empresa", "socio")}
    firms, partners = (spark.sql(q.replace("FROM empresa", "FROM {empresa}").replace("FROM socio", "FROM {socio}"), **views) for q in sql)
    return matching.nested(firms.filter("id is not null"), partners)


def nested_match_docs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nested_counters(matching.match_nested(nested_docs(spark, d, NESTED_GOLD), nested_docs(spark, d, NESTED_ANSWER)))


def nested_metrics_global(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.nested_measures(metrics.totals(nested_match_docs(spark, d), metrics.NESTED)))


# The same in SQL. Text classes as in functions.normalize; U+FB01 is the one ligature that upper() treats differently.

_W, _S = N.WORD, N.SPACE


def sql_norm(x: str) -> str:
    upper = f"replace(upper(regexp_replace(strip_accents(coalesce({x}, '')), '[^{_W}{_S}]', ' ', 'g')), 'ﬁ', 'FI')"
    return f"trim(regexp_replace({upper}, '[{_S}]+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{_S}]+|[{_S}]+$', '', 'g')"


def sql_firm(x: str) -> str:
    out = sql_norm(x)
    for s in N.SUFFIXES:
        out = f"replace({out}, '{s}', '')"
    return f"trim(regexp_replace({out}, '[{_S}]+', ' ', 'g'))"


_NULLS = ", ".join(f"'{w}'" for w in N.SCORE_NULLS)


def sql_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def sql_ident(x: str) -> str:
    return f"CASE WHEN lower({sql_strip(x)}) IN ({_NULLS}) OR contains(lower({x}), 'e') THEN '' ELSE {sql_digits(x)} END"


def sql_rg(x: str, words: bool = True) -> str:
    plain = f"upper(regexp_replace(coalesce({x}, ''), '[^{_W}]', '', 'g'))"
    return f"CASE WHEN lower({sql_strip(x)}) IN ({_NULLS}) THEN '' ELSE {plain} END" if words else plain


def sql_doc(x: str) -> str:
    return sql_digits(f"regexp_replace({sql_strip(x)}, '\\.({'|'.join(N.EXTENSIONS)})$', '', 'i')")


def _side(sql: str, s: str) -> str:
    """CTEs firms_<s> and persons_<s>: id, dense order o, keys."""
    return f"""raw_{s} AS (SELECT {sql_doc("arquivo")} AS id, * EXCLUDE (arquivo) FROM ({sql}) WHERE NOT ({sql_strip("nome")} = '' AND {sql_strip("identificador")} = '')),
    firms_{s} AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS o, {sql_firm("nome")} AS n, {sql_ident("identificador")} AS c FROM raw_{s} WHERE tipo = 'Empresa' AND id <> ''),
    persons_{s} AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS o, {sql_norm("nome")} AS n, {sql_ident("identificador")} AS c, {sql_rg("aux")} AS d FROM raw_{s} WHERE tipo = 'Pessoa' AND id <> '')"""


def _person_fold(name: str, keys: str, gold: str, answer: str) -> str:
    """Recursive CTE over persons of the documents in ``keys``."""
    return f"""{name}(id, k, used, n, c, d, nc, nd, cd, ncd) AS (
        SELECT id, -1::BIGINT, []::BIGINT[], 0, 0, 0, 0, 0, 0, 0 FROM {keys}
        UNION ALL
        SELECT st.id, g.o, CASE WHEN b.i IS NOT NULL THEN list_append(st.used, b.i) ELSE st.used END,
            st.n + coalesce(b.n, 0), st.c + coalesce(b.c, 0), st.d + coalesce(b.d, 0), st.nc + coalesce(b.n * b.c, 0),
            st.nd + coalesce(b.n * b.d, 0), st.cd + coalesce(b.c * b.d, 0), st.ncd + coalesce(b.n * b.c * b.d, 0)
        FROM {name} st JOIN {gold} g ON g.id = st.id AND g.o = st.k + 1
        LEFT JOIN LATERAL (SELECT r.o AS i, (g.n <> '' AND g.n = r.n)::INT AS n, (g.c = r.c)::INT AS c, (g.d = r.d)::INT AS d FROM {answer} r
            WHERE r.id = g.id AND NOT list_contains(st.used, r.o) AND ((g.n <> '' AND g.n = r.n) OR g.c = r.c OR g.d = r.d)
            ORDER BY 3 * (g.n <> '' AND g.n = r.n)::INT + 2 * (g.c = r.c)::INT + (g.d = r.d)::INT DESC, r.o LIMIT 1) b ON true)"""


def _last(name: str, cols: str) -> str:
    return f"(SELECT id, {', '.join(f'arg_max({c}, k) AS {c}' for c in cols.split())}, arg_max(len(used), k) AS m FROM {name} GROUP BY id)"


_FLAT_SQL = f"""WITH RECURSIVE {_side(GOLD, "g")}, {_side(ANSWER, "r")},
    docs AS (SELECT id FROM raw_g WHERE id <> '' UNION SELECT id FROM raw_r WHERE id <> ''),
    fc(id, k, used, n, c, nc) AS (
        SELECT id, -1::BIGINT, []::BIGINT[], 0, 0, 0 FROM docs
        UNION ALL
        SELECT st.id, g.o, CASE WHEN b.i IS NOT NULL THEN list_append(st.used, b.i) ELSE st.used END,
            st.n + coalesce(b.n, 0), st.c + coalesce(b.c, 0), st.nc + coalesce(b.n * b.c, 0)
        FROM fc st JOIN firms_g g ON g.id = st.id AND g.o = st.k + 1
        LEFT JOIN LATERAL (SELECT r.o AS i, (g.n <> '' AND g.n = r.n)::INT AS n, (g.c = r.c)::INT AS c FROM firms_r r
            WHERE r.id = g.id AND NOT list_contains(st.used, r.o) AND ((g.n <> '' AND g.n = r.n) OR g.c = r.c) ORDER BY r.o LIMIT 1) b ON true),
    {_person_fold("fp", "docs", "persons_g", "persons_r")},
    base AS (SELECT docs.id,
        (SELECT count(*) FROM firms_g x WHERE x.id = docs.id)::INT AS eg, (SELECT count(*) FROM firms_r x WHERE x.id = docs.id)::INT AS er,
        (SELECT count(*) FROM persons_g x WHERE x.id = docs.id)::INT AS pg, (SELECT count(*) FROM persons_r x WHERE x.id = docs.id)::INT AS pr,
        e.nc::INT AS enc, e.n::INT AS en, e.c::INT AS ec, e.m::INT AS em, p.n::INT AS pn, p.c::INT AS pc, p.d::INT AS pd, p.nc::INT AS pnc, p.nd::INT AS pnd,
        p.cd::INT AS pcd, p.ncd::INT AS pncd, p.m::INT AS pm
        FROM docs JOIN {_last("fc", "n c nc")} e USING (id) JOIN {_last("fp", "n c d nc nd cd ncd")} p USING (id)),
    exact AS (SELECT *, pncd = pg AND pm = pg AND pm = pr AS ok FROM base),
    counters AS (SELECT id, eg AS total_empresas_gabarito, er AS total_empresas_resposta, enc AS empresas_corretas, en AS empresas_nomes_corretos, ec AS empresas_cnpjs_corretos,
        er - em AS empresas_extras, eg - em AS empresas_faltantes, pg AS total_pessoas_gabarito, pr AS total_pessoas_resposta, pnc AS pessoas_nome_cpf_corretas,
        pnd AS pessoas_nome_rg_corretas, pcd AS pessoas_cpf_rg_corretas, pncd AS pessoas_completas, pn AS pessoas_nome_correto, pc AS pessoas_cpf_correto, pd AS pessoas_rg_correto,
        pr - pm AS pessoas_extras, pg - pm AS pessoas_faltantes, CASE WHEN enc > 0 THEN pnc ELSE 0 END AS empresa_socio_nome_cpf, CASE WHEN enc > 0 THEN pnd ELSE 0 END AS empresa_socio_nome_rg,
        CASE WHEN enc > 0 THEN pncd ELSE 0 END AS empresa_socio_nome_cpf_rg, pnd AS socios_corretos, (enc > 0 AND ok)::INT AS documentos_completos,
        (enc > 0 AND NOT ok AND pncd > 0)::INT AS documentos_parciais, CASE WHEN enc > 0 AND ok THEN enc ELSE 0 END AS empresas_com_socios_completos,
        (enc > 0 AND NOT ok AND pncd > 0)::INT AS empresas_com_socios_parciais,
        ok AND eg > 0 AND pg > 0 AND eg = enc AND er = em AND eg = em AS documento_todas_empresas_socios FROM exact)"""


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


def _family(name: str, right: str, answered: str, gold: str, full: bool = True, guard: bool = False) -> dict[str, str]:
    p, r = _ratio(right, answered), _ratio(right, gold)
    if guard:
        p = f"CASE WHEN {gold} > 0 THEN ({right})::DOUBLE / greatest({answered}, 1) ELSE 0 END"
    out = {f"precisao_{name}": p, f"recall_{name}": r}
    if full:
        out |= {f"f1_{name}": _ratio(f"2 * ({p}) * ({r})", f"({p}) + ({r})"), f"acuracia_{name}": _ratio(right, f"greatest({answered}, {gold})")}
    return out


_E, _P, _PS = ("total_empresas_resposta", "total_empresas_gabarito"), ("total_pessoas_resposta", "total_pessoas_gabarito"), ("total_socios_resposta", "total_socios_gabarito")


def _flat_measures() -> dict[str, str]:
    out = _family("empresas", "empresas_corretas", *_E)
    for x in ("nomes", "cnpjs"):
        out |= _family(f"empresas_{x}", f"empresas_{x}_corretos", *_E, full=False)
    for x, n in (("nome_cpf", "pessoas_nome_cpf_corretas"), ("nome_rg", "pessoas_nome_rg_corretas"), ("completa", "pessoas_completas")):
        out |= _family(f"pessoas_{x}", n, *_P)
    for x in ("nome", "cpf", "rg"):
        out |= _family(f"pessoas_{x}", f"pessoas_{x}_correto", *_P, full=False)
    for x, n in (("nome_cpf", "nome_cpf"), ("nome_rg", "nome_rg"), ("completo", "nome_cpf_rg")):
        out |= _family(f"empresa_socio_{x}", f"empresa_socio_{n}", *_P)
    out |= _family("global", "empresas_corretas + pessoas_completas", f"({_E[0]} + {_P[0]})", f"({_E[1]} + {_P[1]})")
    out |= _family("global_completa", "empresas_com_socios_completos", *_E, guard=True)
    out["taxa_documentos_completos"] = _ratio("empresas_com_socios_completos", _E[1]) + " * 100"
    out["taxa_documentos_parciais"] = _ratio("empresas_com_socios_parciais", _E[1]) + " * 100"
    return out


def _nested_measures() -> dict[str, str]:
    out = _family("empresas", "empresas_corretas", *_E)
    for x in ("nomes", "cnpjs"):
        out |= _family(x, f"{x}_corretos", *_E, full=False)
    for x, n in (("nome_cpf", "nome_cpf_corretos"), ("nome_rg", "nome_rg_corretos"), ("completo", "completos")):
        out |= _family(f"socios_{x}", f"socios_{n}", *_PS)
    out |= _family("socios_cpf_rg", "socios_cpf_rg_corretos", *_PS, full=False)
    for x in ("nome", "cpf", "rg"):
        out |= _family(f"socios_{x}", f"socios_{x}_correto", *_PS, full=False)
    for x, n in (("nome_cpf", "nome_cpf"), ("nome_rg", "nome_rg"), ("completo", "nome_cpf_rg")):
        out |= _family(f"empresa_socio_{x}", f"empresa_socio_{n}", *_PS, guard=True)
    out |= _family("global_completa", "empresas_com_socios_completos", *_E, guard=True)
    out["taxa_empresas_completas"] = _ratio("empresas_com_socios_completos", _E[1])
    out["taxa_empresas_parciais"] = _ratio("empresas_com_socios_parciais", _E[1])
    return out


def _select(measures: dict[str, str]) -> str:
    return ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in measures.items())


_SUMS = ", ".join(f"sum({n})::BIGINT AS {n}" for n in metrics.FLAT)
_NSUMS = ", ".join(f"sum({n})::BIGINT AS {n}" for n in metrics.NESTED)

_NG, _NR = NESTED_GOLD, NESTED_ANSWER


def _nested_side_sql(sql: tuple[str, str], s: str) -> str:
    return f"""nf_{s} AS MATERIALIZED (SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS o, {sql_firm("empresa")} AS n, {sql_digits("cnpj")} AS c FROM ({sql[0]}) WHERE id IS NOT NULL),
    np_{s} AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ord) - 1 AS o, {sql_norm("nome")} AS n, {sql_digits("cpf")} AS c, {sql_rg("rg", False)} AS d FROM ({sql[1]}) WHERE key IS NOT NULL)"""


_NESTED_SQL = f"""WITH RECURSIVE {_nested_side_sql(_NG, "g")}, {_nested_side_sql(_NR, "r")},
    docs AS (SELECT id FROM nf_g UNION SELECT id FROM nf_r),
    fc(id, k, used, pairs) AS (
        SELECT id, -1::BIGINT, []::BIGINT[], []::STRUCT(g BIGINT, r BIGINT, n INT, c INT)[] FROM docs
        UNION ALL
        SELECT st.id, g.o, CASE WHEN b.i IS NOT NULL THEN list_append(st.used, b.i) ELSE st.used END,
            CASE WHEN b.i IS NOT NULL THEN list_append(st.pairs, struct_pack(g := g.key::BIGINT, r := b.key::BIGINT, n := b.n, c := b.c)) ELSE st.pairs END
        FROM fc st JOIN nf_g g ON g.id = st.id AND g.o = st.k + 1
        LEFT JOIN LATERAL (SELECT r.o AS i, r.key, (g.n = r.n)::INT AS n, (g.c = r.c)::INT AS c FROM nf_r r
            WHERE r.id = g.id AND NOT list_contains(st.used, r.o) AND (g.n = r.n OR g.c = r.c) ORDER BY r.o LIMIT 1) b ON true),
    pairs AS (SELECT doc, p.g AS id, p.r AS r, p.n AS n, p.c AS c FROM (SELECT id AS doc, unnest(arg_max(pairs, k)) AS p FROM fc GROUP BY id)),
    pg AS (SELECT pairs.id, o, x.n, x.c, x.d FROM pairs JOIN np_g x ON x.key = pairs.id),
    pr AS (SELECT pairs.id, o, x.n, x.c, x.d FROM pairs JOIN np_r x ON x.key = pairs.r),
    {_person_fold("fp", "pairs", "pg", "pr")},
    scored AS (SELECT pairs.doc, pairs.n AS fn, pairs.c AS fc, q.*, (SELECT count(*) FROM pg WHERE pg.id = pairs.id) AS ng, (SELECT count(*) FROM pr WHERE pr.id = pairs.id) AS nr
        FROM pairs JOIN {_last("fp", "n c d nc nd cd ncd")} q ON q.id = pairs.id),
    per AS (SELECT doc AS id, count(*) AS m, sum(fn * fc) AS ok, sum(fn) AS fn, sum(fc) AS fc, sum(nc) AS nc, sum(nd) AS nd, sum(cd) AS cd, sum(ncd) AS ncd, sum(n) AS n, sum(c) AS c, sum(d) AS d,
        sum(scored.m) AS pm, sum(fn * fc * nc) AS enc, sum(fn * fc * nd) AS en_d, sum(fn * fc * ncd) AS encd,
        count(*) FILTER (fn * fc = 1 AND ng = nr AND scored.m = ng AND ncd = ng) AS whole,
        count(*) FILTER (fn * fc = 1 AND NOT (ng = nr AND scored.m = ng AND ncd = ng) AND ncd > 0) AS part FROM scored GROUP BY doc),
    base AS (SELECT docs.id, (SELECT count(*) FROM nf_g x WHERE x.id = docs.id) AS eg, (SELECT count(*) FROM nf_r x WHERE x.id = docs.id) AS er,
        (SELECT count(*) FROM nf_g x JOIN np_g y ON y.key = x.key WHERE x.id = docs.id) AS sg, (SELECT count(*) FROM nf_r x JOIN np_r y ON y.key = x.key WHERE x.id = docs.id) AS sr,
        per.* EXCLUDE (id) FROM docs LEFT JOIN per USING (id)),
    counters AS (SELECT id, eg::INT AS total_empresas_gabarito, er::INT AS total_empresas_resposta, coalesce(ok, 0)::INT AS empresas_corretas, coalesce(fn, 0)::INT AS nomes_corretos,
        coalesce(fc, 0)::INT AS cnpjs_corretos, (er - coalesce(m, 0))::INT AS empresas_extras, (eg - coalesce(m, 0))::INT AS empresas_faltantes, sg::INT AS total_socios_gabarito,
        sr::INT AS total_socios_resposta, coalesce(nc, 0)::INT AS socios_nome_cpf_corretos, coalesce(nd, 0)::INT AS socios_nome_rg_corretos, coalesce(cd, 0)::INT AS socios_cpf_rg_corretos,
        coalesce(ncd, 0)::INT AS socios_completos, coalesce(n, 0)::INT AS socios_nome_correto, coalesce(c, 0)::INT AS socios_cpf_correto, coalesce(d, 0)::INT AS socios_rg_correto,
        (sr - coalesce(pm, 0))::INT AS socios_extras, (sg - coalesce(pm, 0))::INT AS socios_faltantes, coalesce(enc, 0)::INT AS empresa_socio_nome_cpf, coalesce(en_d, 0)::INT AS empresa_socio_nome_rg,
        coalesce(encd, 0)::INT AS empresa_socio_nome_cpf_rg, coalesce(whole, 0)::INT AS empresas_com_socios_completos, coalesce(part, 0)::INT AS empresas_com_socios_parciais,
        coalesce(whole, 0)::INT AS documento_num_empresas_validadas,
        (eg > 0 AND sg > 0 AND eg = coalesce(ok, 0) AND er = coalesce(m, 0) AND eg = coalesce(m, 0) AND sg = coalesce(ncd, 0) AND sr = coalesce(pm, 0) AND sg = coalesce(pm, 0) AND coalesce(whole, 0) = eg)
            AS documento_todas_empresas_socios FROM base)"""

QUERIES = {
    "flat_match_docs": flat_match_docs,
    "flat_match_similar": flat_match_similar,
    "flat_metrics_global": flat_metrics_global,
    "flat_metrics_docs": flat_metrics_docs,
    "metrics_rollup": metrics_rollup,
    "macro_metrics": macro_metrics,
    "passed_docs": passed_docs,
    "nested_match_docs": nested_match_docs,
    "nested_metrics_global": nested_metrics_global,
}
SQL = {
    "flat_match_docs": f"{_FLAT_SQL} SELECT * FROM counters",
    "flat_metrics_global": f"{_FLAT_SQL}, totals AS (SELECT {_SUMS} FROM counters) SELECT {_select(_flat_measures())} FROM totals",
    "flat_metrics_docs": f"{_FLAT_SQL} SELECT id, {_select(_flat_measures())} FROM counters",
    "metrics_rollup": f"{_FLAT_SQL} SELECT id, grouping(id)::INT AS nivel, {_SUMS} FROM counters GROUP BY ROLLUP (id)",
    "macro_metrics": f"""{_FLAT_SQL}, m AS (SELECT count(*) AS n, count(*) FILTER (documento_todas_empresas_socios) AS ok,
        coalesce(avg(documento_todas_empresas_socios::INT) FILTER (total_empresas_resposta > 0), 0) AS p, coalesce(avg(documento_todas_empresas_socios::INT) FILTER (total_empresas_gabarito > 0), 0) AS r,
        coalesce(avg(documento_todas_empresas_socios::INT), 0) AS a FROM counters)
        SELECT n AS documentos_processados, ok AS documentos_passaram, round(p, 6) AS precisao_media, round(r, 6) AS recall_media, round(a, 6) AS acuracia_media,
        round({_ratio("ok", "n")}, 6) AS taxa_documentos_completos, round({_ratio("2 * p * r", "p + r")}, 6) AS f1_media FROM m""",
    "passed_docs": f"{_FLAT_SQL} SELECT id FROM counters WHERE documento_todas_empresas_socios",
    "nested_match_docs": f"{_NESTED_SQL} SELECT * FROM counters",
    "nested_metrics_global": f"{_NESTED_SQL}, totals AS (SELECT {_NSUMS} FROM counters) SELECT {_select(_nested_measures())} FROM totals",
}
