import random

import pytest

from garimpo.llm import mojibake as M

CLEAN = [
    "A empresa não apresentou certidão, razão pela qual se impõe a notificação do sócio.",
    "IRMÃ, MÃE E AVÔ; «SEÇÃO ÚNICA»; 25 °C ± 2 °C; ½ quota; ¿QUIÉN FIRMA? € 3.000 ou £ 90",
    "A sócia Анна Щукина assinou em russo. A marca Οδύσσεια foi cedida. Łukasz Dvořák e Þórsmörk.",
    "La compañía no presentó la certificación, razón por la cual se impone la notificación.",
    "plain ascii only?",
]


@pytest.fixture(scope="module")
def repairer():
    return M.Repairer(M.train({}))


def test_clean_text_is_left_alone(repairer):
    for t in [*CLEAN, None, "", "   ", "\n"]:
        assert repairer.repair(t) is None


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman", "cp850", "cp1251"])
def test_utf8_read_as_another(repairer, wrong):
    text = " ".join([CLEAN[0], "Decisão e obrigações também são públicas."])
    bad = "".join(M.charset(wrong).table[b] for b in text.encode())
    got = repairer.repair(bad)
    assert got[0] == text and got[3]


def test_twice_and_in_places(repairer):
    once = "".join(M.charset("cp1252").table[b] for b in "notificação".encode())
    twice = "".join(M.charset("cp1252").table[b] for b in once.encode())
    got = repairer.repair(CLEAN[0].replace("notificação", twice))
    assert got[0] == CLEAN[0] and got[1] == ["utf-8>cp1252 utf-8>cp1252"]
    got = repairer.repair(CLEAN[0].replace("notificação", once))
    assert got[0] == CLEAN[0] and got[2] == 1


@pytest.mark.parametrize("wrong", ["mac_roman", "cp850", "cp1251"])
def test_one_byte_encodings(repairer, wrong):
    text = "As obrigações e notificações são públicas; a decisão não é possível após a conclusão da seção."
    bad = "".join(M.charset(wrong).table[b] for b in text.encode("cp1252"))
    got = repairer.repair(bad)
    assert got and got[0] == text


def test_more_than_four_chains(repairer):
    wrong = ["mac_roman", "cp850", "cp437", "cp1251", "cp1250"]
    bad = " ".join("".join(M.charset(w).table[b] for b in CLEAN[0].encode()) for w in wrong)
    got = repairer.repair(bad)
    assert got[0] == " ".join([CLEAN[0]] * len(wrong)) and len(got[1]) > 4 and got[3]
    assert repairer._garbled(bad) and not any(map(repairer._garbled, CLEAN))


def test_lost_bytes_are_found(repairer):
    got = repairer.repair("a associa��o vendeu")
    assert got is not None and got[3] is False


def test_random_round_trips(repairer):
    random.seed(7)
    words = M.SEEDS["pt"].replace(",", "").split()
    hit = 0
    for _ in range(60):
        text = " ".join(random.choice(words) for _ in range(40)) + " situação"
        chain = random.choice(["cp1252", "mac_roman", "cp850"])
        got = repairer.repair("".join(M.charset(chain).table[b] for b in text.encode()))
        hit += bool(got) and got[0] == text
    assert hit >= 57


def test_table(spark):
    bad = "notificaÃ§Ã£o "
    rows = [(1, None, 0), (2, "", 0), (3, bad, 0), (4, bad, 0), (5, (bad + "palavra ") * 8000, 0), (6, "ok", 0), (None, bad, 0)]
    df = spark.createDataFrame(rows, "load_id long, text string, texto int")
    got = M.wrongly_decoded(df, "load_id", "text", M.train({})).collect()
    assert sorted(str(r.load_id) for r in got) == ["3", "4", "5", "None"]
    assert all("Ã" not in r.texto and r.restaurado for r in got)
    assert M.wrongly_decoded(df.limit(0), "load_id", "text", M.train({})).count() == 0
    docs = spark.createDataFrame([(1, "x" * 300, "pt"), (2, None, "es"), (3, "y", None)], "doc_id long, text string, lang string")
    assert [len(v) for v in M.samples(docs, "doc_id", "text", "lang").values()] == [1, 0, 0]


def _as_read(text, right, wrong):
    table = M.charset(wrong).table
    if right == "utf-8":
        return "".join(table[b] for b in text.encode())
    of = M.charset(right).bytes
    return None if any(c not in of for c in text) else "".join(c if c.isascii() else table[of[c]] for c in text)


LABELLED = [("utf-8", b, times) for b in M.READ_AS for times in (1, 2)] + [(a, b, 1) for a, b in M.ONE_BYTE if (a, b) != ("cp850", "cp1252")]


def test_labelled_recall_by_chain(small):
    """Clean documents garbled on purpose, wholly or in one word: what is found and what comes back."""
    import re

    import pyarrow.parquet as pq

    t = pq.read_table(f"{small}/documents.parquet", columns=["text", "lang"]).to_pylist()
    texts = [r["text"] for r in t if r["text"] and (r["lang"] or "").lower().startswith("p") and not r["text"].isascii()]
    r = M.Repairer(M.train({"pt": texts[::2]}))
    clean = texts[1::2][:40]
    assert not any(map(r.repair, clean))
    random.seed(11)
    for right, wrong, times in LABELLED:
        counts = {"whole": [0, 0, 0], "word": [0, 0, 0]}
        for text in clean:
            word = random.choice(list(re.finditer(r"\S*[ãçéáíóõêúâô]\S*", text)) or [None])
            for kind, a, b in (("whole", 0, len(text)), *([("word", *word.span())] if word else [])):
                bad = text[a:b]
                for _ in range(times):
                    bad = bad and _as_read(bad, right, wrong)
                if not bad or bad == text[a:b]:
                    continue
                got = r.repair(text[:a] + bad + text[b:])
                counts[kind][0] += 1
                counts[kind][1] += bool(got)
                counts[kind][2] += bool(got) and got[0] == text
        for kind, (n, found, same) in counts.items():
            assert n == 0 or found >= 0.9 * n, (right, wrong, times, kind, n, found)
            assert n == 0 or same >= (0.85 if times == 1 else 0.7) * n, (right, wrong, times, kind, n, same)


def test_any_number_of_lost_bytes(repairer):
    assert repairer.repair("a notificaÃ?Ã?o e as condiÃ?Ã?es") == ("a notificação e as condições", ["?"], 4, False)
    text, chains, places, whole = repairer.repair("uma organizaÃ?Ã?Ã? assim")
    assert chains == ["?"] and places == 3 and not whole and "?" not in text and "Ã" not in text
    assert repairer.repair("a notifica��o do s�cio")[0] == "a notificação do sócio"
    assert repairer.repair("AMANHÃ? Sim.") is None


def test_long_words_are_read_like_others(repairer):
    glued = "/".join(["notificaÃ§Ã£o", "sócio", "obrigaÃ§Ãµes"] * 20)
    assert repairer.repair(glued)[0] == "/".join(["notificação", "sócio", "obrigações"] * 20)
    assert repairer.repair("x" * 200_000 + " notificaÃ§Ã£o" + "é" * 3000)[0].endswith("notificação" + "é" * 3000)


def test_dictionaries_use_the_whole_sample():
    few, many = ["Sentença número %d da câmara." % i for i in range(30)], ["Sentença número %d da câmara." % i for i in range(30_000)]
    assert b"29 da c" in M.train({"pt": few})["pt"] or len(M.train({"pt": few})["pt"]) > 200
    assert 0 < len(M.train({"pt": many})["pt"]) <= M.DICT_BYTES


def test_many_lost_bytes_in_one_word(repairer):
    for mark in ("�", "Ã?"):
        got = repairer.repair("ação " + mark * 20_000 + " fim")
        assert got is not None and not got[3]


def test_quotation_marks_and_lists_are_no_fault(repairer):
    for t in ("Disse “à vontade” e “é certo”, d’água, ’ávido.", "1ª via; 2º termo; nº 5; N.º 7", "• um\n• dois\n• três\n‡ nota ‡ nota", "║ Nome ║ João ║\n╔═══╗ ação"):
        assert repairer.repair(t) is None, t
