import random

from garimpo.operators import matching as M
from garimpo.operators import metrics

FLAT = "id string, ord long, tipo string, nome string, identificador string, aux string"


def flat(spark, rows):
    return spark.createDataFrame([(d, i, t, n, c, x) for i, (d, t, n, c, x) in enumerate(rows)], FLAT)


def counters(spark, gold, answer, tolerance=1.0):
    return {r.id: r.asDict() for r in metrics.flat_counters(M.match_flat(flat(spark, gold), flat(spark, answer), tolerance)).collect()}


E, P = "Empresa", "Pessoa"


def test_small_cases(spark):
    gold = [
        ("exact", E, "ALFA LTDA", "1", ""),
        ("id", E, "ALFA", "1", ""),
        ("blank", E, "ALFA", "", ""),
        ("tie", P, "ANA", "1", ""),
        ("weak", P, "ANA", "1", ""),
        ("zero", P, "ANA", "1", "x"),
        ("gold", P, "ANA", "1", ""),
        ("hall", P, "ANA", "1", ""),
        ("pass", E, "ALFA", "1", ""),
        ("pass", P, "ANA", "1", ""),
        ("both", "Pessoa/Empresa", "ALFA", "1", ""),
    ]
    answer = [
        ("exact", E, "Alfa", "1", ""),
        ("id", E, "OMEGA", "1", ""),
        ("blank", E, "OMEGA", "", ""),
        ("blank", E, "ALFA", "", ""),
        ("tie", P, "ANA", "1", ""),
        ("tie", P, "ANA", "1", ""),
        ("weak", P, "RUI", "2", ""),
        ("zero", P, "RUI", "2", "y"),
        ("hall", P, "ANA", "1", "x"),
        ("pass", E, "ALFA", "1", ""),
        ("pass", P, "ANA", "1", ""),
        ("answer", E, "B", "2", ""),
    ]
    c = counters(spark, gold, answer)
    assert c["exact"]["empresas_corretas"] == 1
    assert (c["id"]["empresas_cnpjs_corretos"], c["id"]["empresas_nomes_corretos"]) == (1, 0)
    assert (c["blank"]["empresas_extras"], c["blank"]["empresas_nomes_corretos"], c["blank"]["empresas_cnpjs_corretos"]) == (1, 0, 1)
    assert (c["tie"]["pessoas_completas"], c["tie"]["pessoas_extras"]) == (1, 1)
    assert (c["weak"]["pessoas_faltantes"], c["weak"]["pessoas_extras"], c["weak"]["pessoas_rg_correto"]) == (0, 0, 1)
    assert (c["zero"]["pessoas_faltantes"], c["zero"]["pessoas_extras"]) == (1, 1)
    assert c["gold"]["pessoas_faltantes"] == 1 and c["answer"]["empresas_extras"] == 1
    assert (c["hall"]["pessoas_nome_cpf_corretas"], c["hall"]["pessoas_completas"]) == (1, 0)
    assert c["pass"][metrics.PASS] and not c["exact"][metrics.PASS]
    assert (c["both"]["total_empresas_gabarito"], c["both"]["total_pessoas_gabarito"]) == (1, 1)


def test_jvm_fold_equals_the_python_fold(spark):
    random.seed(1)

    def some(n):
        return [(f"d{random.randint(0, 9)}", random.choice([E, P]), random.choice(["ANA", "RUI", "EVA", "", None]), random.choice(["1", "2", "", None]), random.choice(["x", "y", ""])) for _ in range(n)]

    gold, answer = some(120), some(120)
    exact = counters(spark, gold, answer)
    # names differ as a whole or are equal, so that this tolerance means equality too
    assert exact == counters(spark, gold, answer, 0.999)
    for c in exact.values():
        assert c["pessoas_faltantes"] >= 0 and c["pessoas_extras"] >= 0


def test_similarity_below_one(spark):
    gold, answer = [("a", E, "COMERCIO DE ALIMENTOS", "1", "")], [("a", E, "COMERCIO DE ALIMENTO", "2", "")]
    assert counters(spark, gold, answer)["a"]["empresas_nomes_corretos"] == 0
    assert counters(spark, gold, answer, 0.9)["a"]["empresas_nomes_corretos"] == 1


def test_gold_against_itself(spark):
    gold = [(f"d{i}", t, f"{n} {i}", str(i), "") for i in range(5) for t, n in ((E, "FIRMA"), (P, "ANA"), (P, "RUI"))]
    got = metrics.flat_counters(M.match_flat(flat(spark, gold), flat(spark, gold)))
    m = metrics.flat_measures(metrics.totals(got, metrics.FLAT)).first().asDict()
    assert all(v == 1.0 for k, v in m.items() if k.startswith(("precisao", "recall", "f1", "acuracia")))
    assert m["taxa_documentos_completos"] == 100.0
    macro = metrics.macro(got).first()
    assert (macro.documentos_passaram, macro.f1_media) == (5, 1.0)
    assert metrics.passed_documents(got).count() == 5
    roll = metrics.rollup(got, metrics.FLAT).collect()
    assert len(roll) == 6 and sum(r.total_pessoas_gabarito for r in roll if r.nivel == 0) == next(r.total_pessoas_gabarito for r in roll if r.nivel == 1)


def test_nothing_to_score(spark):
    got = metrics.flat_counters(M.match_flat(flat(spark, []), flat(spark, [])))
    assert got.count() == 0
    m = metrics.flat_measures(metrics.totals(got, metrics.FLAT)).first().asDict()
    assert set(m.values()) == {0.0}
    assert metrics.macro(got).first().f1_media == 0.0


NEST = "id string, empresas array<struct<empresa:string,cnpj:string,socios:array<struct<nome:string,cpf:string,rg:string>>>>"


def test_nested_scope(spark):
    gold = [("a", [("ALFA", "1", [("ANA", "1", ""), ("RUI", "", "9")]), ("BETA", "2", [("EVA", "3", "")])]), ("b", [("GAMA", "", [])])]
    answer = [("a", [("BETA", "2", [("ANA", "1", ""), ("RUI", "", "9"), ("EVA", "3", "")]), ("ALFA", "1", [])]), ("c", [("X", "5", [("Y", "1", "")])])]
    for t in (1.0, 0.99):
        got = {r.id: r for r in metrics.nested_counters(M.match_nested(spark.createDataFrame(gold, NEST), spark.createDataFrame(answer, NEST), t)).collect()}
        a = got["a"]
        # partners listed under the wrong company do not count
        assert (a.empresas_corretas, a.socios_completos, a.socios_faltantes, a.socios_extras) == (2, 1, 2, 2)
        assert (a.empresas_com_socios_completos, a.empresas_com_socios_parciais) == (0, 1)
        assert (got["b"].empresas_faltantes, got["c"].socios_extras, got["c"].total_socios_resposta) == (1, 1, 1)
        same = metrics.nested_counters(M.match_nested(spark.createDataFrame(gold, NEST), spark.createDataFrame(gold, NEST), t)).filter("id = 'a'").first()
        assert same[metrics.PASS] and same.documento_num_empresas_validadas == 2
