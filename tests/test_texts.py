import json
import math
import random

import pytest

from garimpo.operators import chunking, extraction, retrieval
from garimpo.plans import registry
from garimpo.sources import files, sinks
from garimpo.streaming import incremental


def test_splitter():
    assert chunking.split_text("abc", 150, 50, (";",)) == ["abc"]
    assert chunking.split_text("a" * 400, 150, 50, (";",)) == ["a" * 400]
    got = chunking.split_text("; ".join(f"item {i}" for i in range(40)), 60, 20, (";",))
    assert all(len(c) <= 60 for c in got) and got[0].startswith("item 0")
    assert got[1].split(";")[1].strip() in got[0]
    assert chunking.split_text("aaaa bbbb\n\ncccc dddd", 7, 0, ("\n\n", " ")) == ["aaaa", "bbbb", "cccc", "dddd"]
    assert chunking.split_text("", 5, 0, (" ",)) == []


def test_chunks_keep_the_words(spark):
    random.seed(2)
    texts = [" ".join(random.choice(["um", "dois", "três."]) for _ in range(random.randint(0, 80))) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = chunking.chunk_table(df, "id", "text", 40, 0, (". ", " ")).orderBy("id", "chunk_idx").collect()
    for i, t in enumerate(texts):
        assert "".join(r.chunk for r in rows if r.id == i).replace(" ", "") == (t or "").replace(" ", "")


def test_top_k(spark):
    random.seed(5)
    rows = [(i, i % 3, [random.random() for _ in range(4)]) for i in range(60)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "id long, scope int, v array<float>").repartition(5)
    q = df.filter("id % 20 = 0")

    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    vec = {r.id: r.v for r in df.collect() if r.v}
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.top_k(q, df, "id", "id", "v", 4).collect()}
    for a in (0, 20, 40):
        want = sorted(vec, key=lambda b: (dist(vec[a], vec[b]), b))[:4]
        assert [got[a, k] for k in range(1, 5)] == want
    scoped = retrieval.top_k_in_scope(q, df.filter("v is not null"), "scope", "id", "id", "v", 100)
    assert scoped.count() == 60
    one = retrieval.top_k(q, df, "id", "id", "v", 4, "scope").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in one] == [(r.query_id, r.chunk_id) for r in scoped.filter("rank <= 4").orderBy("query_id", "rank").collect()]
    assert retrieval.top_k(q.limit(0), df, "id", "id", "v", 4).count() == 0


def test_top_k_of_many_copies(spark):
    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    ids = rng.sample(range(10_000), 12 * 300)
    rows = [(n, n % 3, [x + 0.01 for x in vectors[j % 12]]) for j, n in enumerate(ids)]
    q = spark.createDataFrame([(100_000 + j, 0, v) for j, v in enumerate(vectors)], "id long, scope int, v array<double>")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            df = spark.createDataFrame(rows, "id long, scope int, v array<double>").repartition(3)
            for scope in (None, "scope"):
                got = {}
                for r in retrieval.top_k(q, df, "id", "id", "v", 5, scope).orderBy("query_id", "rank").collect():
                    got.setdefault(r.query_id - 100_000, []).append(r.chunk_id)
                for j in range(12):
                    assert got[j] == sorted(n for m, n in enumerate(ids) if m % 12 == j and (scope is None or n % 3 == 0))[:5]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_unit_and_context(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(retrieval.unit("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    ranked = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, rank int, chunk string")
    assert retrieval.contexts(ranked, "q", "chunk", 3).first().contexto == "a\n\n"


def test_document_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("São\r\nJosé".encode())
    (tmp_path / "b.txt").write_bytes("São".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b" ")
    (tmp_path / "e.doc").write_bytes(b"x")
    (tmp_path / "f.txt").write_bytes("😀abc".encode())
    got = {r.doc_id: r.text for r in files.documents(spark, str(tmp_path), 4).collect()}
    assert got == {"a.txt": "São\n", "b.txt": "São", "d.txt": " ", "f.txt": "😀abc"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.documents(spark, str(tmp_path / "none")).count()


def test_entity_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("﻿Document_ID;Type;Name;CPF;RG\ndoc_1.txt;Empresa;Alfa;1;\ndoc_2.txt;Pessoa;;;9\ncurta;Pessoa\n;Pessoa;Rui;1;\ndoc_3.txt;Pessoa;\"A;B\";2;\"\"\n", encoding="utf-8")
    rows = files.entities_csv(spark, str(p)).orderBy("ord").collect()
    assert [(r.id, r.tipo, r.nome, r.identificador, r.aux) for r in rows] == [("1", "Empresa", "Alfa", "1", ""), ("3", "Pessoa", "A;B", "2", "")]
    (tmp_path / "empty.csv").write_text("")
    assert files.entities_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    assert files.delimiter("a\tb,c\td") == "\t"


def test_nested_and_config(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"a": [{"empresa": "X", "cnpj": "1", "socios": [{"nome": "N", "cpf": "", "rg": "2"}]}], "b": []}))
    got = {r.id: r.empresas for r in files.nested_json(spark, str(p)).collect()}
    assert len(got["a"][0].socios) == 1 and got["b"] == []
    assert files.embedded_config('{"parametros_extracao":{"a":1,"b":1},"configuracao":{"parametros_extracao":{"b":2}}}') == {"a": 1, "b": 2}
    assert files.embedded_config("[") == {} and files.embedded_config("[1]") == {}
    c = files.Config.load({"CONFIG_JSON": '{"CHUNK_SIZE": 9, "SEPARATORS": ["a"], "other": 1}', "PARSE_MAX_RETRIES": "5"})
    assert (c.chunk_size, c.separators, c.parse_max_retries, c.k_chained) == (9, ("a",), 5, 5)


def test_resume(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    place = str(tmp_path / "done")
    assert sinks.pending(docs, sinks.done(spark, place, "doc_id"), "doc_id").count() == 2
    sinks.mark_done(docs.filter("doc_id = 'a'"), "doc_id", place, 1)
    assert [r.doc_id for r in sinks.pending(docs, sinks.done(spark, place, "doc_id"), "doc_id").collect()] == ["b"]


def test_stream_resumes(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    (src / "a.txt").write_text("um")

    def go():
        incremental.process_available(incremental.document_stream(spark, str(src)), lambda df: df, str(out), str(ck)).awaitTermination()
        return sorted(r.doc_id for r in spark.read.parquet(str(out)).collect())

    assert go() == ["a.txt"]
    (src / "b.txt").write_text("dois")
    assert go() == ["a.txt", "b.txt"]
    assert go() == ["a.txt", "b.txt"]


def test_reports(spark, tmp_path):
    head = sinks.report_head("T", {"limiar": 0.9}, {"total_empresas_gabarito": 3000}, {"f1_empresas": 0.5, "taxa_documentos_completos": 50.0}, {"documentos_passaram": 1, "f1_media": 0.25})
    text = "\n".join(head)
    assert "50.00%" in text and "50.0%" in text and "3,000" in text and "25.00%" in text and "limiar: 0.9" in text
    scored = spark.createDataFrame([("2", 1, 0.5, True), ("1", 3, 1.0, False)], "id string, n int, f1 double, documento_todas_empresas_socios boolean")
    place = str(tmp_path / "r.txt")
    sinks.write_report_text(place, head, scored.filter("documento_todas_empresas_socios"), sinks.document_blocks(scored, ["n"], ["f1"]))
    lines = open(place, encoding="utf-8").read().split("\n")
    assert lines.index("DOCUMENTO 1") < lines.index("DOCUMENTO 2  [validação completa]") and "  2" in lines and any(x.endswith("100.00%") for x in lines)
    place = str(tmp_path / "r.json")
    sinks.write_report_json(place, *sinks.report_json({"a": [1]}, {"n": 4}, {"f1": 0.5}, {"m": 0.1}, scored, ["n"], ["f1"]))
    got = json.load(open(place, encoding="utf-8"))
    assert got["configuracao"] == {"a": [1]} and list(got["metricas_por_documento"]) == ["1", "2"] and got["metricas_por_documento"]["2"]["contagens"] == {"n": 1}
    sinks.write_report_json(place, *sinks.report_json({}, {}, {}, {}, scored.limit(0), ["n"], ["f1"]))
    assert json.load(open(place, encoding="utf-8"))["metricas_por_documento"] == {}


def test_retries():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("HTTP 503")
        return "ok"

    assert extraction.retried(call, extraction.LINES_BACKOFF, waits.append) == "ok"
    assert waits == [20, 40] and extraction.LINES_BACKOFF.waits() == [20, 40, 80, 160, 300, 300, 300]
    with pytest.raises(KeyError):
        extraction.retried(lambda: {}["x"], extraction.JSON_BACKOFF, waits.append)


def test_chained_pipeline(spark):
    text = "Pelo ato, a Alfa & Beta LTDA (CNPJ 11.222.333/0001-44), por Ana Um, portador(a) do RG nº 1.234.567-8 e Rui Dois, portador(a) do CPF nº 111.222.333-44. Prefeitura de Z (CNPJ 11.222.333/0001-45)."
    df = spark.createDataFrame([("a", text), ("b", "nada"), ("c", None)], "doc string, text string")
    rows = extraction.chained(df, "doc", "text", extraction.Patterns).collect()
    assert len(rows) == 1 and rows[0].empresa.endswith("Alfa & Beta LTDA")
    assert [(s.nome, s.cpf, s.rg) for s in rows[0].socios] == [("Ana Um", "", "1.234.567-8"), ("Rui Dois", "111.222.333-44", "")]


def test_long_documents_are_read_whole(spark, tmp_path):
    line = "A Alfa LTDA (CNPJ 11.222.333/0001-44), por Ana Um, portador(a) do CPF nº 111.222.333-44."
    long = "palavra comum. " * 4000 + line
    spark.createDataFrame([("a.txt", long)], "arquivo string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("a.txt", 1, "Alfa LTDA", "11.222.333/0001-44")], "arquivo string, empresa_id long, nome string, cnpj string").write.parquet(str(tmp_path / "empresa.parquet"))
    assert [r.cnpj for r in registry.queries()["extract_chained"](spark, str(tmp_path)).collect()] == ["11.222.333/0001-44"]
    assert "Alfa LTDA" in registry.queries()["question_contexts"](spark, str(tmp_path)).first().contexto
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(long)
    assert files.documents(spark, str(tmp_path / "in")).first().text == long
    incremental.process_available(incremental.document_stream(spark, str(tmp_path / "in")), lambda df: df, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().text == long


def test_errors_become_data(spark):
    class Broken:
        def answer(self, c, q):
            raise ValueError("x")

    df = spark.createDataFrame([(1, "c", "q")], "k int, contexto string, pergunta string")
    r = extraction.ask(df, Broken, ["k"]).first()
    assert r.resposta == "" and "ValueError" in r.erro


def test_queries_agree_with_their_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in "customer documents embeddings empresa events itens_avaliacao lineitem loader metas_mistura nation orders parse_resposta_v1 part region rotulos_leitura socio supplier".split():
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")

    def rows(pdf):
        def one(v):
            return f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v)

        return sorted(tuple(map(one, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))

    sql = registry.oracle_sql()
    for name, q in registry.queries().items():
        got = q(spark, small).toPandas()
        if name in sql:
            assert rows(got) == rows(con.execute(sql[name]).df()), name
