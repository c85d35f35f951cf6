import pytest

from garimpo.functions import normalize as N
from garimpo.functions.similarity import may_reach, possible, ratio, similarity

CASES = [
    (N.normalize_text, [(None, ""), ("", ""), ("  Ação & Cia. ", "ACAO CIA"), ("São-José", "SAO JOSE"), ("ão", "AO"), ("nº 1ª", "Nº 1ª"), ("A_b", "A_B"), ("x y", "X Y"), ("ß", "SS")]),
    (N.digits, [(None, ""), ("12.345-6/x", "123456"), ("²", "")]),
    (N.normalize_identifier, [(None, ""), (" N/A ", ""), ("não informado", ""), ("1.2E+13", ""), ("pendente 12", ""), ("11.222", "11222"), ("-", ""), ("--", "")]),
    (N.normalize_rg, [(None, ""), ("1.234.567-x", "1234567X"), ("na", ""), ("a_b", "A_B")]),
    (lambda c: N.normalize_rg(c, False), [("na", "NA"), ("n/a", "NA")]),
    (N.normalize_doc_id, [("doc_grupo1_007.txt", "1007"), ("a.pdf", ""), (" 12.TXT ", "12"), ("1.txt.2", "12"), (None, "")]),
    (N.strip_suffixes, [("ALFA LTDA", "ALFA"), ("MELO", "LO"), ("SANTOS", "NTOS"), ("GOMES AGRO", "GOGRO"), ("MICROEMPRESA", "MICROEMPRE"), ("OMEGA", "OGA"), ("", "")]),
    (N.sanitize, [("A, B", "A - B"), (None, "")]),
    (N.strip, [("  x \n", "x"), (None, "")]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scalars(spark, k):
    f, pairs = CASES[k]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string")
    got = [r[0] for r in df.select("i", f("a").alias("b")).orderBy("i").select("b").collect()]
    assert got == [b for _, b in pairs]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(N.safe_ratio(df.a, df.b)).collect()] == [0.5, 0.0, 0.0]


def test_similarity_and_its_bound(spark):
    assert ratio("", "") == 1.0 and ratio("abc", "abd") == pytest.approx(2 / 3)
    df = spark.createDataFrame([("ALFA", "ALFAS"), ("A", "ABCDEFGH"), (None, "x")], "a string, b string")
    rows = df.select(similarity(df.a, df.b), may_reach(df.a, df.b, 0.95)).collect()
    assert rows[0][0] == pytest.approx(8 / 9) and rows[2][0] is None
    assert not rows[1][1] and not possible("A", "ABCDEFGH", 0.95)
