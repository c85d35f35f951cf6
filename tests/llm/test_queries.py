import duckdb

import __spark_entry__ as entry
from garimpo.llm import queries as Q


def test_queries_run_and_agree_with_their_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "loader", "empresa", "socio", "parse_resposta_v1", "rotulos_leitura", "itens_avaliacao", "metas_mistura"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    assert set(Q.QUERIES) <= set(entry.queries())
    for name, q in Q.QUERIES.items():
        got = q(spark, small).toPandas()
        if name in Q.SQL:
            want = con.execute(Q.SQL[name]).df()

            def rows(x):
                return sorted(map(tuple, x[sorted(x.columns)].astype(str).values.tolist()))

            assert rows(got) == rows(want), name


def test_found_columns(spark, small):
    want = {"p1_found": ["tabela", "registro_id"], "p2_found": ["load_id"], "p3_found": ["resposta_id"], "p4_found": ["load_id"], "p5_found": ["tabela", "id_menor", "id_maior"], "p6_found": ["doc_id", "item_id"]}
    for name, cols in want.items():
        assert entry.queries()[name](spark, small).columns == cols
