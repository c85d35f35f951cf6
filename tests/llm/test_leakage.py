import random
import re
import unicodedata

from garimpo.llm import leakage as L
from garimpo.llm.words import normalised, spans, words


def plain_words(s):
    s = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFD", s).lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", s)


def test_words_like_a_plain_reading():
    random.seed(3)
    pool = list("aáÇ1_-. \n“”–ŁřЩцα½ªº\x0c​́ßÞ漢") + ["\x01", "\x0f", "ﬁ"]
    for _ in range(2000):
        t = "".join(random.choice(pool) for _ in range(random.randint(0, 25)))
        assert len(words(t)) == len(plain_words(t)) == len(spans(t)), ascii(t)
    assert normalised("ÇÃO") == normalised("ção") == b"cao"
    assert words("Щ") != words("ц") and words("Щука") == words("щука")


def item(k, n=30):
    return " ".join(f"palavra{k}x{i}" for i in range(n))


def test_found_in_other_writing():
    p = L.Passages([(1, item(1)), (2, item(2)), (3, "curto demais")])
    part = item(1).split()
    text = "Início. " + " ".join(part[5:17]).upper().replace(" ", ",\n ") + " fim"
    ((i, [(first, last, a, b)]),) = p.find(text)
    assert (i, first, last) == (1, 1, 12) and text[a:b].lower().startswith("palavra1x5")
    assert p.find(" ".join(part[5:16])) == []
    assert p.find(" ".join([*part[:8], "outra", *part[8:16]])) == []


def test_shared_passages_and_several_runs():
    shared = item(9, 12)
    p = L.Passages([(1, "a b " + shared), (2, shared + " c")])
    assert {h[0] for h in p.find("x " + shared + " y")} == {1, 2}
    two = item(1) + " meio " + item(1)
    assert L.Passages([(1, item(1))]).find(two)[0][1][1][:2] == (31, 60)


def test_against_brute_force(spark):
    random.seed(8)
    vocabulary = ["o", "sócio", "pagou", "a", "multa", "e", "Foi"]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(5, 40)))) for i in range(12)]
    docs = [(d, " ".join(random.choice(vocabulary) for _ in range(60)) + " " + random.choice(items)[1].upper()) for d in range(40)] + [(90, None), (91, "")]

    def windows(t, n):
        w = plain_words(t or "")
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {(d, i) for d, t in docs for i, s in items if windows(t, 5) & windows(s, 5)}
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    assert {(r[0], r[1]) for r in L.leaks(df, "doc_id", "text", it, "item_id", "text", 5).select("doc_id", "item_id").collect()} == want
    assert L.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert L.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_any_block_size_gives_the_same_rows(spark):
    random.seed(2)
    marks = [" ", " - ", ", ", " … ", ".\n"]

    def written(ws):
        return "".join(w + random.choice(marks) for w in ws)

    rows = [(k, written([f"p{random.randint(0, 6)}" for _ in range(random.choice((5, 14, 60, 90)))])) for k in range(12)] + [(20, "a-b-c." * 20)]
    def own(text):
        return re.findall(r"\w+", text.upper())

    def other():
        return [f"p{random.randint(0, 6)}" for _ in range(20)]

    texts = [(d, written(other() + own(a[1]) + other() + own(b[1]) + other() + own(a[1]))) for d in range(20) for a, b in [random.choices(rows, k=2)]]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")

    def found(size):
        return sorted(map(tuple, L.leaks(docs, "doc_id", "text", items, "item_id", "text", 8, size).collect()))

    one = found(10_000)
    assert len(one) > 10 and any(r[3] > 1 for r in one)
    for size in (50, 150):
        assert found(size) == one


def test_cuts_count_the_words_of_windows(spark):
    spaced, joined = " - ".join(f"p{i}é" for i in range(120)), ".".join(f"q{i}" for i in range(200))
    blocks = list(L._blocks(spark.createDataFrame([(1, spaced), (2, joined)], "item_id long, text string"), "item_id", "text", 12, 50))
    assert all(sum(len(words(t)) for _, t in b) <= 50 for b in blocks)
    found = [L.Passages(b) for b in blocks]
    for name, count, item_id in (("p%dé", 120, 1), ("q%d", 200, 2)):
        for i in range(count - 11):
            part = " ".join(name % k for k in range(i, i + 12))
            assert {h[0] for p in found for h in p.find(part)} == {item_id}, part


def test_codes_are_as_wide_as_the_vocabulary():
    many = L.Passages([(1, " ".join(f"w{i}" for i in range(18_000)))])
    assert many.width == 4 and len(set(many.codes.values())) == 18_000
