import math
import random
from collections import Counter

import numpy as np
import pytest

from garimpo.llm import reading as R

EASY = ["A moça abre a porta.", "O filho lê a nota.", "A loja fecha hoje.", "O sócio paga a conta."]
HARD = [
    "Conquanto se admita o contrário, a inoponibilidade das exceções pessoais subordina-se à aferição casuística da proporcionalidade, porquanto inexistente fundamentação contemporânea, cuja inobservância acarretaria desnaturação.",
    "Destarte, a controvérsia atinente à imputabilidade objetiva transcende a subscrição do capital, ainda que se vislumbre verossimilhança, máxime quando evidenciada a desproporcionalidade do sacrifício.",
]


def text(level):
    """More hard sentences with each level."""
    n = random.randint(6, 20)
    return " ".join(random.choice(HARD) if random.random() < (level - 1) / 4 else random.choice(EASY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    random.seed(4)
    return [(i, text(1 + i % 5), 1 + i % 5) for i in range(400)]


def test_held_out_accuracy(corpus):
    counts = Counter(w for _, t, _ in corpus for w in R.normalised(t).split())
    of = R.Measure(R.Rarity(list(counts), -np.log2(np.array(list(counts.values())) / counts.total()), 20.0)).features
    x, y = np.array([of(t) for _, t, _ in corpus]), np.array([k for *_, k in corpus])
    m = R.fit(x[::2], y[::2])
    guess = m.probabilities(x[1::2]).argmax(1) + 1
    assert (abs(guess - y[1::2]) <= 1).mean() > 0.9
    assert abs(m.expected(x[1::2]) - y[1::2]).mean() < 0.7
    assert (np.diff(m.cuts) > 0).all()
    assert np.allclose(m.probabilities(x).sum(1), 1)


def test_features_are_exact():
    t = "porque que contratualmente casa, " * 5000
    for known in (R.Rarity([], np.zeros(0), 3.0), R.Rarity([b"casa", b"contratualmente"], np.array([3.0, 3.0]), 3.0)):
        f = dict(zip(R.FEATURES, R.Measure(known).features(t)))
        assert f["conectivos"] == 0.25 and f["palavras_longas"] == 0.25 and f["letras_por_palavra"] == (6 + 3 + 15 + 4) / 4 and f["raridade"] == 3.0


def test_counts_cover_everything(spark):
    texts = ["um dois dois", None, "", "três Três TRES"]
    df = spark.createDataFrame([(t,) for t in texts * 10], "text string").repartition(3)
    counts = R.word_counts(df, "text")
    assert {bytes(r.word): r.n for r in counts.collect()} == {b"um": 10, b"dois": 20, b"tres": 30}
    known = R.rarity(counts)
    assert known.words == [b"dois", b"tres", b"um"] and np.allclose(known.bits, [math.log2(63 / 21), math.log2(63 / 31), math.log2(63 / 11)])


def test_rare_words_stay_rare_beyond_the_vocabulary(spark):
    texts = ["comum " * 50 + "medio " * 9] + [f"raro{i} unico{i} unico{i}" for i in range(300)]
    counts = R.word_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    known = R.rarity(counts, 10)
    assert known.words == [b"comum", b"medio"]
    total, types = 59 + 900, 602
    assert abs(known.other - math.log2((total + types) / (900 / 600 + 1))) < 1e-9 and known.other > known.bits.max()
    assert R.rarity(counts.limit(0)).words == []


def test_held_out_query(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in corpus], "doc_id long, nivel int")
    got = R.held_out(docs, "doc_id", "text", labels, "doc_id", "nivel").collect()
    assert sum(r.rotulos for r in got) == 400 and sum(r.ate_um for r in got) > 360
    assert R.held_out(docs, "doc_id", "text", labels.limit(0), "doc_id", "nivel").count() == 0


def test_table(spark, corpus):
    docs = spark.createDataFrame([(i, t, "p", 0) for i, t, _ in corpus] + [(900, None, "q", 0), (901, "", None, 0), (902, "123 456", "p", 0), (903, "?!", "p", 0), (904, HARD[0] * 500, "p", 0)], "doc_id long, text string, source string, nivel int")
    labels = spark.createDataFrame([(i, k) for i, _, k in corpus if i % 3 == 0] + [(0, 2), (1, None), (None, 3), (5000, 4), (2, 9)], "doc_id long, nivel int")
    rows = {r.doc_id: r for r in R.levels(docs, "doc_id", "text", labels, "doc_id", "nivel", ("source",)).collect()}
    assert len(rows) == 405
    for k in (900, 901, 903):
        assert rows[k].nivel is None and rows[k].nivel_estimado is None and rows[k].palavras == 0
    assert rows[902].nivel is not None and rows[904].nivel >= 4
    assert rows[900].source == "q"
    near = [abs(rows[i].nivel_estimado - k) for i, _, k in corpus]
    assert sum(near) / len(near) < 0.8


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "um dois")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, nivel int")
    r = R.levels(docs, "doc_id", "text", labels, "doc_id", "nivel").first()
    assert r.nivel is None and r.palavras == 2
    assert R.levels(docs.limit(0), "doc_id", "text", labels, "doc_id", "nivel").count() == 0
