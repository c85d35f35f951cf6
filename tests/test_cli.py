import argparse
import json
import shutil

import pytest
from pyspark.sql import functions as F

from garimpo import cli
from garimpo.operators import embedding, extraction, parsing, prompts
from garimpo.sources import files


def stumbling(log):
    """Makes a model that gets right only the second try of a question, and never one about a broken document; it notes what it was given."""

    class Model:
        def __init__(self):
            self.asked = set()

        def answer(self, contexts, questions):
            with open(log, "a", encoding="utf-8") as f:
                f.write(json.dumps([contexts[0], questions[0]]) + "\n")
            stem = (contexts[0], questions[0].split("\n")[0])
            if "QUEBRADO" in contexts[0] or stem not in self.asked:
                self.asked.add(stem)
                return ['{"$defs": {}}']
            return extraction.Patterns().answer(contexts, questions)

    return Model


LINE = "A Alfa LTDA (CNPJ 11.222.333/0001-44), por Ana Um, portador(a) do CPF nº 111.222.333-44."


def _folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("; ".join(["palavra comum sem nada que interesse"] * 200 + [LINE.replace("A Alfa", "Das empresas do texto com nome e CNPJ dos sócios com CPF: Alfa")]))
    (src / "b.txt").write_text("QUEBRADO " + LINE)
    return str(src), str(tmp_path / "out"), str(tmp_path / "log")


def _calls(log):
    with open(log, encoding="utf-8") as f:
        return [json.loads(x) for x in f]


def test_run_chained_retrieves_and_tries_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extraction, "PAUSE", 0)
    src, out, log = _folder(tmp_path)
    config = files.Config(k_chained=3)
    cli.run_chained(spark, src, out, stumbling(log), config, embedding.Hashing)
    (row,) = spark.read.parquet(out + "/empresas").collect()
    assert (row.doc_id, row.cnpj) == ("a.txt", "11.222.333/0001-44") and [s.nome for s in row.socios] == ["Ana Um"]
    assert [r.doc_id for r in spark.read.parquet(out + "/done").collect()] == ["a.txt"]
    assert [(r.doc_id, r.etapa, bool(r.erro)) for r in spark.read.parquet(out + "/erros").collect()] == [("b.txt", "empresas", True)]
    assert json.loads(spark.read.text(out + "/json").first()[0])["a.txt"][0]["socios"][0]["nome"] == "Ana Um"
    calls = _calls(log)
    assert len(calls) == 2 + 2 + extraction.STRICT_TRIES and max(len(c) for c, _ in calls) < 1000
    assert all("socios" in q or "empresas" in q for _, q in calls)
    cli.run_chained(spark, src, out, stumbling(log), config, embedding.Hashing)
    assert len(_calls(log)) == 7 + extraction.STRICT_TRIES and spark.read.parquet(out + "/empresas").count() == 1


def test_run_independent_corrects(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extraction, "PAUSE", 0)
    src, out, log = _folder(tmp_path)
    (tmp_path / "in" / "c.txt").write_text("nada")
    cli.run_independent(spark, src, out, extraction.Patterns)
    assert spark.read.parquet(out + "/done").count() == 3
    rows = spark.read.option("header", True).csv(out + "/entidades").orderBy("arquivo", "tipo_entidade").collect()
    assert [(r.arquivo, r.tipo_entidade, r.identificador) for r in rows] == [(d, t, i) for d in ("a.txt", "b.txt") for t, i in (("Empresa", "11.222.333/0001-44"), ("Pessoa", "111.222.333-44"))]
    out += "2"
    cli.run_independent(spark, src, out, stumbling(log), files.Config(parse_max_retries=2), embedding.Hashing)
    assert {r.arquivo for r in spark.read.option("header", True).csv(out + "/entidades").collect()} == {"a.txt"}
    assert {r.doc_id for r in spark.read.parquet(out + "/done").collect()} == {"a.txt", "c.txt"}
    again = [q for _, q in _calls(log) if "Escreva apenas linhas" in q]
    assert len(again) == 6 and all(prompts.COMPANY_LINE in q or prompts.PERSON_LINE in q for q in again)


def test_problems_agree_with_the_readers(spark, small):
    raw = [r.raw for r in spark.read.parquet(small + "/parse_resposta_v1.parquet").select("raw").collect()]
    raw += [None, "", " \u00a0", "Ana, 1", ";;", "null, 1;", ", 5;", "<think>x</think> {}", "```json\n{\"empresas\": []}\n```", '{"empresas": [{"nome": "A", "cnpj": 1}]}', '{"empresas": [{"nome": "A", "cnpj": "1"}]} fim']
    raw += ['{"socios": [{"nome": "A", "cpf": "-", "rg": "1"}]}', '{"socios": [{"nome": "A", "cpf": null, "rg": "1"}]}', '{"socios": [{"nome": "A", "cpf": "nd"}]}', '{"socios": [1]}', "[1]", '{"socios": {}}']
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = df.select("raw", parsing.lenient_companies("raw").erro.alias("a"), parsing.lenient_persons("raw").erro.alias("b"), parsing.strict_companies("raw").isNull().alias("c"), parsing.strict_partners("raw").isNull().alias("d"), (parsing.clean_response("raw") == "").alias("blank"))
    for r in got.collect():
        if not r.blank:
            assert (parsing.lenient_problem(r.raw, parsing.COMPANIES), parsing.lenient_problem(r.raw, parsing.PERSONS)) == (r.a, r.b), r.raw
        else:
            assert parsing.lenient_problem(r.raw, parsing.COMPANIES) == parsing.EMPTY
        assert (parsing.strict_problem(r.raw, parsing.COMPANIES) is not None, parsing.strict_problem(r.raw, parsing.PERSONS) is not None) == (r.c, r.d), r.raw
    errors = [None, "", "schema_echo", "no_json", "json_decode:x", "has NULL", "empty_text"]
    hints = spark.createDataFrame(list(enumerate(errors)), "i int, e string").orderBy("i").select(parsing.correction(F.col("e"), "L;").alias("h")).collect()
    assert [h.h for h in hints] == [parsing.correction_hint(e, "L;") for e in errors]


def test_scorers(spark, tmp_path, capsys):
    head = "arquivo,tipo_entidade,nome,identificador,aux\n"
    (tmp_path / "g.csv").write_text(head + "d1.txt,Empresa,Alfa LTDA,1,\nd1.txt,Pessoa,Ana Maria,2,\n")
    (tmp_path / "r.csv").write_text(head + "d1.txt,Empresa,Alfa,1,\nd1.txt,Pessoa,Ana Marla,2,\n")
    txt, out = str(tmp_path / "o.txt"), str(tmp_path / "o.json")
    assert cli.main(["score-csv", str(tmp_path / "g.csv"), str(tmp_path / "r.csv"), "--limiar", "0.85", "--exportar-txt", txt, "--exportar-json", out]) == 0
    assert "f1_empresas" in capsys.readouterr().out and "100.00%" in open(txt, encoding="utf-8").read()
    whole = json.load(open(out, encoding="utf-8"))
    assert whole["configuracao"]["limiar"] == 0.85 and whole["metricas_globais"]["contagens"]["total_empresas_gabarito"] == 1
    assert whole["metricas_por_documento"]["1"]["passou_validacao_completa"] is True and whole["metricas_por_documento"]["1"]["metricas"]["f1_empresas"] == 1.0
    assert "DOCUMENTO 1" in open(txt, encoding="utf-8").read()
    _, totals, _ = cli.score_csv(spark, str(tmp_path / "g.csv"), str(tmp_path / "r.csv"), 0.95)
    assert totals.first().pessoas_nome_correto == 0
    doc = {"d1.txt": [{"empresa": "Alfa", "cnpj": "1", "socios": [{"nome": "Ana", "cpf": "2", "rg": ""}]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    _, _, m = cli.score_json(spark, str(tmp_path / "g.json"), str(tmp_path / "g.json"))
    assert m.first().f1_global_completa == 1.0
    (tmp_path / "r.json").write_text(json.dumps({"parametros_extracao": {"k": 5}}))
    assert cli._config(argparse.Namespace(resposta=str(tmp_path / "r.json")))["parametros_extracao"] == {"k": 5}
    assert cli._config(argparse.Namespace(resposta=str(tmp_path))) == {"resposta": str(tmp_path)}


def test_run_chained_resumes(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    line = "A Alfa LTDA (CNPJ 11.222.333/0001-44), por Ana Um, portador(a) do CPF nº 111.222.333-44."
    (src / "a.txt").write_text(line)
    for n in range(3):
        cli.main(["run-chained", str(src), out])
        if n == 0:  # as if the run had been lost before its last step
            shutil.rmtree(out + "/done")
    assert spark.read.parquet(out + "/empresas").count() == 1
    (src / "b.txt").write_text(line)
    cli.main(["run-chained", str(src), out])
    assert spark.read.parquet(out + "/empresas").count() == 2


def test_contexts_stay_in_their_document(spark):
    docs = spark.createDataFrame([("a", "um dois três. quatro cinco seis. sete oito nove"), ("b", "um dois três. outro texto aqui"), ("c", None)], "doc string, text string")
    asked = spark.createDataFrame([("a", 1, "quatro cinco"), ("b", 2, "outro texto"), ("c", 3, "x")], "doc string, q int, pergunta string")
    got = {r.query_id: r.contexto for r in embedding.question_contexts(docs, "doc", "text", asked, "q", "pergunta", embedding.Hashing, 1, 20, 0, (". ",)).collect()}
    assert got[1].strip(". ").startswith("quatro cinco") and "outro" in got[2] and 3 not in got
    assert embedding.device("x") == "x" and callable(embedding.backend("org/model"))


def test_clients():
    hosted = extraction.client("openrouter", "gemma3:27b", True)
    assert hosted.body("x")["model"] == "google/gemma-3-27b-it" and hosted.body("x")["max_tokens"] == 4096 and "plugins" not in hosted.body("x")
    assert extraction.client("openrouter", "own", False, url="http://h").body("x")["plugins"] and extraction.client("openrouter", "own", False).max_tokens == 2048
    local = extraction.client("ollama", "m", False, 0.2)
    assert local.body("x")["options"] == {"temperature": 0.2, "num_predict": 1024} and local.backoff == extraction.JSON_BACKOFF
    with pytest.raises(ValueError):
        extraction.client("x", "m", True)


def test_batched_models_are_asked_at_once():
    sizes = []

    class Model:
        batched = True

        def answer(self, contexts, questions):
            sizes.append(len(questions))
            return [q if "2" not in q or "dica" in q else "ruim" for q in questions]

    got = extraction._answered(Model(), ["c"] * 4, [f"q{i}" for i in range(4)], lambda a: "mau" if a == "ruim" else None, 3, lambda e: f"dica {e}", 0)
    assert got == [("q0", None), ("q1", None), ("q2\ndica mau", None), ("q3", None)] and sizes == [4, 1]

    class Broken:
        def answer(self, contexts, questions):
            if questions == ["b"]:
                raise OSError("503")
            return questions

    assert extraction._answered(Broken(), ["c"] * 2, ["a", "b"], None, 1, None, 0) == [("a", None), ("", "OSError: 503")]
