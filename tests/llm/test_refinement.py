import random
from collections import defaultdict
from itertools import combinations

from garimpo.llm import refinement as R


def brute(rows):
    import re

    def key(v):
        return re.sub(r"[\s.,;:/&\"'()-]", "", (v or "").lower())

    groups = defaultdict(list)
    for i, scope, *fields in rows:
        if scope is not None:
            groups[scope, tuple(sorted(k for k in map(key, fields) if k))].append(i)
    return groups


def data():
    random.seed(5)
    names = ["Ana Maria", "ana  maria", "ANA-MARIA", "Aná Maria", "Rui", "rui.", None, "", " - "]
    ids = ["123.456", "123456", None, "", "--", "999"]
    return [(i, random.choice(["a", "b", None]), random.choice(names), random.choice(ids), random.choice(ids)) for i in range(150)]


SCHEMA = "id long, arquivo string, nome string, cpf string, rg string"


def test_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("rg", "_key")
    groups = brute(rows)
    got = {(r.id_menor, r.id_maior) for r in R.duplicate_pairs(df, "arquivo", "id", ("nome", "cpf", "_key")).collect()}
    assert got == {p for g in groups.values() for p in combinations(sorted(g), 2)}
    one = R.collapse(df, "arquivo", "id", ("nome", "cpf", "_key")).collect()
    assert sum(r.copias for r in one) == len(rows)
    assert {(r.id, r.copias) for r in one if r.arquivo is not None} == {(min(g), len(g)) for g in groups.values()}
    assert sum(1 for r in one if r.arquivo is None) == sum(1 for r in rows if r[1] is None)


def test_field_order_and_accents(spark):
    rows = [(1, "f", "Ana", "12", None), (2, "f", "12", "ana", ""), (3, "f", "Aná", "12", None), (4, "f", "Ana", "12", "12"), (5, "g", "Ana", "12", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in R.duplicate_pairs(df, "arquivo", "id", ("nome", "cpf", "rg")).collect()] == [("f", 1, 2)]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.duplicate_pairs(empty, "arquivo", "id", ("nome",)).count() == 0
    assert R.collapse(empty, "arquivo", "id", ("nome",)).count() == 0
    long = "Xy " * 50_000
    df = spark.createDataFrame([(1, "f", long, None, None), (2, "f", long.upper(), "", "-")], SCHEMA)
    assert R.collapse(df, "arquivo", "id", ("nome", "cpf", "rg")).first().copias == 2


def test_a_hot_group(spark):
    rows = [(i, "f", "Ana" if i % 3 else f"Rui {i}", "1", None) for i in range(3000)]
    got = R.collapse(spark.createDataFrame(rows, SCHEMA), "arquivo", "id", ("nome", "cpf", "rg"))
    assert got.agg({"copias": "max"}).first()[0] == 2000 and got.count() == 1001


# Written without the operator's functions: the values of one line are the same, those of different lines are not.
WRITINGS = (
    ["Conceição", "Conceição", "CONCEIÇÃO", "con​ceição", "con­cei⁠ção."],
    ["Groß", "GROSS", "gross"],
    ["ﬁlha", "FILHA"],
    ["ΟΔΟΣ", "οδος", "οδοσ"],
    ["Conceicao"],
    ["Ｃonceição"],
    ["ế", "ế", "Ế"],
    ["rcud §+$`", "R C\tU D", "“rcud”"],
    [None, "", " ", "–", "​"],
)


def test_writings_of_one_value(spark):
    rows = [(10 * i + j, "f", v, "7", None) for i, line in enumerate(WRITINGS) for j, v in enumerate(line)]
    got = {tuple(r) for r in R.duplicate_pairs(spark.createDataFrame(rows, SCHEMA), "arquivo", "id", ("nome", "cpf", "rg")).select("id_menor", "id_maior").collect()}
    assert got == {(10 * i + a, 10 * i + b) for i, line in enumerate(WRITINGS) for a, b in combinations(range(len(line)), 2)}


def test_equal_values_have_equal_histograms(spark):
    random.seed(9)
    letters = "eéêẽëệoõrřcçuüdđaßﬁK0Ⅻ9ŉǆ ΐς.-̣́​"
    import unicodedata as U

    def other(v):
        v = random.choice((str.upper, str.lower, str, str.title))(v)
        return " ".join(U.normalize(random.choice(("NFC", "NFD")), v))

    firsts = ["".join(random.choices(letters, k=8)) for _ in range(400)]
    df = spark.createDataFrame([(v, other(v)) for v in firsts], "a string, b string")
    a, b = df["a"], df["b"]
    same = df.select("a", "b", (R.stripped(a) == R.stripped(b)).alias("same"), R.histogram(a).alias("x"), R.histogram(b).alias("y")).collect()
    assert sum(r.same for r in same) > 200
    assert all(r.x == r.y for r in same if r.same)


def test_blocks_of_a_class_meet_once(spark):
    rows = [(i, "f", "Ana", None, None) for i in range(120)] + [(i, None, "Ana", None, None) for i in range(200, 210)]
    got = R.duplicate_pairs(spark.createDataFrame(rows, SCHEMA), ["arquivo"], "id", ("nome", "cpf", "rg"), block=16).collect()
    assert len(got) == 120 * 119 // 2 == len(set(got))
