import unicodedata

import pytest

from garimpo.llm import lookalikes as L

CHANGED = [
    ("Ｐáｄｕａ", "Pádua"),
    ("Conceição", "Conceição"),
    ("ｕ́til", "útil"),
    ("Bran​dão﻿", "Brandão"),
    ("e​́", "é"),
    ("A B　C", "A B C"),
    ("Прisma", "Пpisma"),
    ("LТDΑ", "LTDA"),
    ("Drսmοոd", "Drumond"),
    ("ﬁrma", "firma"),
    ("Kátia", "Kátia"),
    ("Reｇiа̃o", "Regiãо".replace("о", "o")),
    ("a­b", "ab"),
    ("Заря LTDА", "Заря LTDA"),
    ("Заpя", "Заря"),
]
SAME = ["", "Ana & Cia. Ltda", "São João d’Ávila – “X” 1ª 2º", "Анна Щукина", "Οδύσσεια", "tab\tline\n", "ÇÃÕ Łukasz Dvořák Þ ß", "漢字 かな", "N.º 5"]


@pytest.mark.parametrize(("a", "b"), CHANGED)
def test_changed(a, b):
    t = L.transducer()
    got = t.consistent(a)
    assert got == b, (ascii(got), ascii(b))
    assert t.consistent(got) == got


@pytest.mark.parametrize("a", SAME)
def test_ordinary_is_unchanged(a):
    assert L.transducer().consistent(a) == a


def test_brute_force_on_widths_and_accents():
    t = L.transducer()
    for n in range(0xFF01, 0xFF5F):
        assert t.consistent(chr(n)) == unicodedata.normalize("NFKC", chr(n))
    for n in range(0xC0, 0x180):
        c = chr(n)
        assert t.consistent(c) == c
        assert t.consistent(unicodedata.normalize("NFD", c)) == c


def test_conflicts_are_found(monkeypatch):
    L.mapping.cache_clear()
    monkeypatch.setattr(L, "TWINS", (*L.TWINS, ("Greek", "Α", "X")))
    with pytest.raises(L.Conflict):
        L.mapping()
    monkeypatch.undo()
    L.mapping.cache_clear()
    general, twins, _ = L.mapping()
    assert len(general) > 1000 and twins["а"] == "a"


def test_table(spark):
    long = "Ｐ" * 100_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, "x"), (4, "LТDA", "x"), (5, "LТDA", "x"), (6, "LTDA", "x")], "id int, nome string, other string")
    got = {r.id: (r.out, r.out_changed) for r in L.with_consistent(df, "nome", "out").collect()}
    assert got == {1: (None, False), 2: ("", False), 3: ("P" * 100_000, True), 4: ("LTDA", True), 5: ("LTDA", True), 6: ("LTDA", False)}
    assert L.with_consistent(df.limit(0), "nome", "out").count() == 0


def test_marks_in_any_order_and_number():
    import random

    random.seed(3)
    t = L.transducer()
    marks = [*map(chr, range(0x300, 0x34F)), *"̛̣́̂̄̀"]
    for _ in range(20_000):
        text = random.choice("aeiouAEcnxyzéươ1=") + "".join(random.choices(marks, k=random.randint(1, 5)))
        assert t.consistent(text) == unicodedata.normalize("NFC", text), ascii(text)


def test_word_state_decides_the_output():
    t = L.transducer()
    for script, theirs, latin in L.TWINS:
        for a, b in zip(theirs, latin):
            if b.isalpha():
                assert t.consistent(f"Q{a}q") == f"Q{b}q", (script, ascii(a))
            assert t.consistent(a) == a
            assert t.consistent(f"Qq {a}") == f"Qq {a}"
    assert t.consistent("аb") == "ab" and t.consistent("а́b") == "áb" and t.consistent("а​b") == "ab"
