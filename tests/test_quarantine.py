import random

import pytest

from garimpo.operators import quarantine as Q

CNPJ, CPF = "11.222.333/0001-44", "111.222.333-44"
GOOD = [
    (f"d.txt,Empresa,Alfa,{CNPJ},", "csv", "empresas"),
    (f'"d.txt","empresa","Alfa, ""B"" e C",{CNPJ},""', "csv", "empresas"),
    (f'd.txt,PESSOA,"Ana\nMaria",{CPF},1.234.567-x', "csv", "pessoas"),
    (f"<THINK>a;b</THINK>```csv\n  d.txt,Pessoa,Ana,n/a,ND \n```", "csv", "pessoas"),
    (f"Alfa, {CNPJ}; Beta, ;;", "lista", "empresas"),
    (f"Ana, {CPF}, ; Rui, , 12345", "lista", "pessoas"),
    ('{"x":1,"empresas":[{"nome":"A","cnpj":null,"y":[1]}]}', "json", "empresas"),
    ('```json{"empresas":[{"nome":"A","cnpj":null}]}```', "json", "empresas"),
    ("```" + '[1]'.join(('{"a":', ',"empresas":[{"nome":"\\ud83d\\ude00 \\ud800","cnpj":""}]}')), "json", "empresas"),
    ('{"a":' + "[" * 3000 + "]" * 3000 + ',"empresas":[{"nome":"A","cnpj":null}]}', "json", "empresas"),
    ('```json\n{"socios":[{"nome":"A\\u00e7","cpf":"","rg":"123456X"}]}\n```', "json", "pessoas"),
]
BAD = [
    (None, "csv", "empresas", "valor"),
    ("  \n", "lista", "empresas", "valor"),
    ("<think>só isto</think>", "json", "pessoas", "valor"),
    ("x", None, None, "valor"),
    ("x", "xml", "empresas", "valor"),
    (f"d.txt,Empresa,Alfa,{CNPJ}", "csv", "empresas", "colunas"),
    (f"d.txt,Empresa,Alfa,{CNPJ},\nd.txt,Empresa,Beta,{CNPJ},", "csv", "empresas", "colunas"),
    (f'd.txt,Empresa,Alfa "B",{CNPJ},', "csv", "empresas", "aspas"),
    (f'd.txt,Empresa,"Alfa" B,{CNPJ},', "csv", "empresas", "aspas"),
    ('d.txt,Empresa,"Alfa,1,', "csv", "empresas", "aspas"),
    (f",Empresa,Alfa,{CNPJ},", "csv", "empresas", "valor"),
    (f"d.txt,Pessoa Jurídica,Alfa,{CNPJ},", "csv", "empresas", "valor"),
    (f"d.txt,Empresa,NULL,{CNPJ},", "csv", "empresas", "valor"),
    (f"d.txt,Empresa,Alfa,{CPF},", "csv", "empresas", "valor"),
    (f"d.txt,Empresa,Alfa,{CNPJ},123456", "csv", "empresas", "valor"),
    ("; ;", "lista", "empresas", "colunas"),
    ("Alfa", "lista", "empresas", "colunas"),
    ("Ana, 1", "lista", "pessoas", "colunas"),
    ("Ana, , 1234", "lista", "pessoas", "valor"),
    ("Ana, , 1234X678", "lista", "pessoas", "valor"),
    ('{"empresas":[{"nome":"A","cnpj":"', "json", "empresas", "aspas"),
    ('{"empresas":[{"nome":"A","cnpj":null},]}', "json", "empresas", "aspas"),
    ("{'empresas':[]}", "json", "empresas", "aspas"),
    ('{"empresas":[{"nome":"A","cnpj":null}]} x', "json", "empresas", "aspas"),
    ('{"empresas":[{"nome":"A","cnpj":NaN}]}', "json", "empresas", "aspas"),
    ('{"empresas":[{"nome":"A\tB","cnpj":null}]}', "json", "empresas", "aspas"),
    ('[{"nome":"A","cnpj":null}]', "json", "empresas", "colunas"),
    ('{"empresas":[]}', "json", "empresas", "colunas"),
    ('{"socios":[{"nome":"A","cpf":null,"rg":null}]}', "json", "empresas", "colunas"),
    ('{"empresas":[{"nome":"A"}]}', "json", "empresas", "colunas"),
    ('{"empresas":[{"nome":"A","cnpj":11222333000144}]}', "json", "empresas", "valor"),
    ('{"empresas":[{"nome":" nd ","cnpj":null}]}', "json", "empresas", "valor"),
]


@pytest.mark.parametrize("case", GOOD)
def test_valid(case):
    rows, reason, detail, at = Q.read_answer(*case)
    assert rows and reason is None, (reason, detail, at)


@pytest.mark.parametrize("case", BAD)
def test_rejected(case):
    rows, reason, detail, at = Q.read_answer(*case[:3])
    assert rows is None and reason == case[3] and detail
    assert 0 <= at <= len(case[0] or "")


def test_offset_is_in_the_raw_text():
    raw = f'<think>x</think>\n```\nd.txt,Empresa,Alfa "B",{CNPJ},\n```'
    assert Q.read_answer(raw, "csv", "empresas")[3] == raw.index('"')
    raw = f"  Ana, {CPF}, ; Rui, 12, "
    assert Q.read_answer(raw, "lista", "pessoas")[3] == raw.index("12,")


def test_fields_are_typed_and_unquoted():
    assert Q.read_answer(*GOOD[1])[0] == [("d.txt", "Empresa", 'Alfa, "B" e C', CNPJ, None)]
    assert Q.read_answer(*GOOD[5])[0] == [(None, "Pessoa", "Ana", CPF, None), (None, "Pessoa", "Rui", None, "12345")]


def test_chunks_compose():
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice('ab,;"\n \\{}[]:1') for _ in range(random.randint(0, 60)))
        for machine in (Q.CSV, Q.LIST):
            got = set()
            for chunk in (1, 2, 7, 4096):
                try:
                    got.add(repr(machine.records(text, chunk)))
                except Q.Rejected as e:
                    got.add(repr((e.motivo, e.at)))
            assert len(got) == 1, text
        got = set()
        for chunk in (1, 3, 4096):
            try:
                got.add(repr(Q.JSON.read(text, chunk)))
            except Q.Rejected as e:
                got.add(repr((e.motivo, e.detalhe, e.at)))
        assert len(got) == 1, text


def test_csv_machine_equals_the_csv_module():
    import csv
    import io

    random.seed(4)
    n = 0
    for _ in range(500):
        rows = [["".join(random.choice('ab,"\n') for _ in range(random.randint(0, 6))) for _ in range(3)]]
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerows(rows)
        assert [v for _, v in Q.CSV.records(out.getvalue(), 5)[0]] == [x.strip() for x in rows[0]]
        n += 1
    assert n == 500


def test_table(spark):
    rows = [(i, *c[:3], "extra") for i, c in enumerate(GOOD + BAD)]
    df = spark.createDataFrame(rows, "resposta_id long, raw string, formato string, pergunta string, lido string")
    read = Q.read_answers(df, "resposta_id").cache()
    bad = {r.resposta_id for r in Q.rejected(read, "resposta_id").collect()}
    assert bad == set(range(len(GOOD), len(rows)))
    loaded = Q.loaded(read, "resposta_id")
    assert {r.resposta_id for r in loaded.collect()} == set(range(len(GOOD)))
    assert Q.rejected(Q.read_answers(df.limit(0), "resposta_id"), "resposta_id").count() == 0


def test_long_text_is_read_whole():
    raw = "; ".join(f"Nome {i}, " for i in range(20_000)) + "; X"
    assert Q.read_answer(raw, "lista", "empresas")[1:] == ("colunas", "1 campos", raw.rindex("X"))


def test_offsets_in_json_point_at_the_value():
    raw = '{"x":{"empresas":[{"nome":1}]},"empresas":[{"nome":"A","cnpj":null},{"nome":"B","cnpj":"12"}]}'
    assert Q.read_answer(raw, "json", "empresas")[1:] == ("valor", "cnpj", raw.index('"12"'))
    raw = '{"empresas":[{"nome":"A","cnpj":null},{"cnpj":"12"}]}'
    assert Q.read_answer(raw, "json", "empresas")[1:] == ("colunas", "chaves do elemento", raw.index('{"cnpj":"12"}'))
    raw = '{"empresas":[{"nome":"A\\q","cnpj":null}]}'
    assert Q.read_answer(raw, "json", "empresas")[1:] == ("aspas", "json: cadeia", raw.index("\\"))


def _plain(node):
    if node.kind == "object":
        return {k: _plain(v) for k, v in node.value.items()}
    if node.kind == "array":
        return [_plain(v) for v in node.value]
    return {"true": True, "false": False, "null": None}.get(node.kind, node.value) if node.kind != "string" else "s" + node.value


def test_json_machine_equals_the_json_module():
    import json

    def strict(text):
        def no(name):
            raise ValueError(name)

        def strings(x):
            if isinstance(x, str):
                return "s" + x
            if isinstance(x, list):
                return [strings(v) for v in x]
            return {k: strings(v) for k, v in x.items()} if isinstance(x, dict) else x[0] if isinstance(x, tuple) else x

        try:
            return strings(json.loads(text, parse_constant=no, parse_int=lambda v: (v,), parse_float=lambda v: (v,)))
        except ValueError:
            return "bad"

    def ours(text):
        try:
            return _plain(Q.JSON.read(text, 7))
        except Q.Rejected:
            return "bad"

    random.seed(8)
    pieces = ['{', '}', '[', ']', ',', ':', '"a"', '"b\\n"', '"\\u00e7"', '1', '-0.5e3', '01', 'true', 'null', 'NaN', ' ', '"\\x"', '"', "\t", '"k":', '{"k":1}', '[1,2]', "\x0b"]
    good = 0
    for _ in range(30_000):
        text = "".join(random.choices(pieces, k=random.randint(1, 7)))
        want = strict(text)
        assert ours(text) == want, text
        good += want != "bad"
    assert good > 300
