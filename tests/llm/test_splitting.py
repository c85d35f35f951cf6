import random

import pytest

from garimpo.llm import splitting as S


def check(text, limit=S.LIMIT, overlap=S.OVERLAP):
    got = S.cuts(text, limit, overlap)
    assert "".join(text[a + o : b] for a, b, o, _ in got) == text
    end = 0
    for n, (a, b, o, _) in enumerate(got):
        assert 0 < b - a <= limit or not text
        assert a + o == end
        assert (o == 0) == (n == 0) and o <= overlap
        end = b
    return got


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000, "ab " * 4000, "é" * 5000, "\r\n" * 5000, "x" * 4001, "Um. Dois! Três?\n\n" * 900, "\n\n" + "z" * 3999 + "\n\n"])
def test_shapes(text):
    assert len(check(text)) > 1


def test_random_texts():
    random.seed(11)
    for _ in range(60):
        text = "".join(random.choice(["palavra ", "fim. ", "Outra, ", "\n", "\n\n", "x" * 40, "é"]) for _ in range(random.randint(1, 150)))
        check(text, 120, 20)


def test_short_is_whole():
    assert S.cuts("a" * 4000) == [(0, 4000, 0, 9)]
    assert S.cuts("") == [(0, 0, 0, 9)]


def test_natural_boundaries_first():
    text = "\n\n".join(f"Parágrafo {i} " + "com palavras. " * 40 for i in range(20))
    assert all(f == 5 for *_, f in check(text)[:-1])
    assert all(f >= 3 for *_, f in check("Frase com palavras. " * 900)[:-1])


def test_overlap_is_natural():
    text = "palavra " * 2000
    for a, _, o, _ in check(text)[1:]:
        assert 190 <= o <= 200 and text[a - 1] == " " and text[a] != " "


def test_brute_force_merging():
    """Repeatedly joining the weakest admissible boundary gives the same pieces as the heap."""
    random.seed(12)
    for _ in range(40):
        text = "".join(random.choice(["palavra ", "fim. ", "Outra, ", "\n", "\n\n"]) for _ in range(60))
        limit, overlap = 90, 15
        if len(text) <= limit:
            continue
        ends, strength = S.atoms(text, limit - overlap)
        begin = [0, *ends[:-1]]
        seg = list(zip(begin, ends, strength))
        while True:
            can = [(seg[i][2], seg[i + 1][1] - seg[i][0], seg[i][0], i) for i in range(len(seg) - 1) if seg[i + 1][1] - seg[i][0] <= (limit if seg[i][0] == 0 else limit - overlap)]
            if not can:
                break
            i = min(can)[3]
            seg[i : i + 2] = [(seg[i][0], seg[i + 1][1], seg[i + 1][2])]
        assert [s[1] for s in seg] == [c[1] for c in S.cuts(text, limit, overlap)]


def test_table(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x" * 4000, "a"), (4, "Frase. " * 3000, "a"), (4, "Frase. " * 3000, "a"), (5, "é" * 4001, "a")]
    df = spark.createDataFrame(rows, "load_id long, text string, peca string")
    cut = S.split_oversized(df, "text")
    assert sorted(r.load_id for r in cut.collect()) == [4, 4, 5]
    got = S.pieces(cut, "load_id", "text").filter("load_id = 5").orderBy("peca").collect()
    assert [len(r.texto) for r in got] == [3800, 401]
    assert S.split_oversized(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(df, "text", 100, 50)
