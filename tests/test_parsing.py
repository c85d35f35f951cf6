import pytest
from pyspark.sql import functions as F

from garimpo.operators import filters, parsing

COMPANY = [
    ("ALFA, 11; BETA, 22;", [("ALFA", "11"), ("BETA", "22")], None),
    ("ALFA; BETA, 22", [("ALFA", ""), ("BETA", "22")], None),
    ("null, 1; ALFA, 2", [("ALFA", "2")], None),
    ('<THINK>x</THINK>```json\n{"empresas":[{"nome":"ALFA","cnpj":null}]}\n```', [("ALFA", "")], None),
    ('{"companies":[{"name":"ALFA","CNPJ":"1"}]}', [("ALFA", "1")], None),
    ('{"empresa":{"empresas":[{"nome":"A","cnpj":7}]}}', [("A", "7")], None),
    ('{"empresas":{"nome":"A"}}', [("A", "")], None),
    ('{"properties":{"a":1}}', [], "schema_echo"),
    ('{"empresas":[{"cnpj":"1"}]}', [], "empty_json"),
    ('{"empresas": []}', [('{"empresas": []}', "")], None),
    ("", [], "no_json"),
    (None, [], "no_json"),
    (", 5; X", [("", "5"), ("X", "")], None),
]
PERSON = [("ANA, 111, ; RUI", [("ANA", "111", ""), ("RUI", "", "")], None), (", 1, 2", [], "no_json"), ("A, 1, 2, 3", [("A", "1", "2, 3")], None), ('{"sócios":[{"name":"B","CPF":"1"}]}', [("B", "1", "")], None)]


def _run(spark, cases, f):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    return [r.r for r in df.select("i", f("raw").alias("r")).orderBy("i").collect()]


def test_lenient_companies(spark):
    for got, case in zip(_run(spark, COMPANY, parsing.lenient_companies), COMPANY):
        assert ([tuple(x) for x in got.itens], got.erro) == (case[1], case[2]), case[0]


def test_lenient_persons(spark):
    for got, case in zip(_run(spark, PERSON, parsing.lenient_persons), PERSON):
        assert ([tuple(x) for x in got.itens], got.erro) == (case[1], case[2]), case[0]


def test_balanced():
    assert parsing.balanced('a {"x": "}"} b {') == '{"x": "}"}'
    assert parsing.balanced('{"a": {"b": 1}} {') == '{"a": {"b": 1}}'
    assert parsing.balanced('{"a": "\\"}"} x') == '{"a": "\\"}"}'
    assert parsing.balanced("{{}") is None and parsing.balanced("no") is None


STRICT = [
    ('{"empresas":[{"nome":" A ","cnpj":"1","x":2}]}', [("A", "1")]),
    ('text ```json\n{"empresas":[{"nome":"A","cnpj":"1"}]}\n``` more', [("A", "1")]),
    ('{"empresas":[]}', []),
    ('{"empresas":[{"nome":"A","cnpj":"1"},{"nome":"B","cnpj":""}]}', None),
    ('{"empresas":[{"nome":"A","cnpj":null}]}', None),
    ('{"empresas":[{"nome":"A","cnpj":5}]}', None),
    ("nothing", None),
    (None, None),
]


def test_strict_fails_as_a_whole(spark):
    for got, case in zip(_run(spark, STRICT, parsing.strict_companies), STRICT):
        assert (None if got is None else [tuple(x) for x in got]) == case[1], case[0]


def test_strict_partners(spark):
    cases = [('{"socios":[{"nome":"A","cpf":"1"}]}', 1), ('{"socios":[{"nome":"A","cpf":"nd","rg":"n/a"}]}', None), ('{"socios":[{"nome":"A","cpf":"1","rg":"nd"}]}', 1), ('{"socios":[{"nome":"A","cpf":null,"rg":"1"}]}', None)]
    got = _run(spark, cases, parsing.strict_partners)
    assert [None if g is None else len(g) for g in got] == [1, None, 1, None]


def test_hints(spark):
    df = spark.createDataFrame([("schema_echo",), ("json_decode:x",), ("x null",), ("other",), (None,)], "e string")
    got = [r[0] for r in df.select(parsing.correction(F.col("e"), "NOME;")).collect()]
    assert got[4] is None and len(set(got[:4])) == 4


def test_filters(spark):
    df = spark.createDataFrame([("Prefeitura de X", "1"), ("Alfa", " "), ("Alfa", "1"), ("Estado de Obra", "1"), (None, None)], "nome string, cnpj string")
    kept, out = filters.gate_companies(df)
    assert [tuple(r) for r in kept.collect()] == [("Alfa", "1")]
    assert [r.motivo for r in out.collect()] == ["orgao_publico", "sem_cnpj", "orgao_publico", "sem_cnpj"]
    docs = spark.createDataFrame([("1", "nd"), ("nd", "na"), (None, ""), ("n/a", "2")], "cpf string, rg string")
    assert [r[0] for r in docs.select(filters.has_document("cpf", "rg")).collect()] == [True, False, False, True]
    assert filters.flag(" Sim ") and not filters.flag(None)


@pytest.mark.parametrize("text", ["Autarquia X", "MINISTÉRIO da Y", "a câmara municipal"])
def test_public(spark, text):
    assert spark.range(1).select(filters.is_public_body(F.lit(text))).first()[0]
