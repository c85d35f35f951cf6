import os
import random

import pytest

from garimpo.llm import mixing as M


def test_pfair_keeps_every_share():
    random.seed(1)
    for _ in range(60):
        n = {str(i): random.randint(1, 200) for i in range(random.randint(1, 9))}
        total = sum(n.values())
        done = dict.fromkeys(n, 0)
        for s, j, slot in M.pfair(n):
            assert j * total // n[s] <= slot < -(-(j + 1) * total // n[s]) and done[s] == j
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * n[x] / total) < 1 for x in n)
        assert done == n
    assert list(M.pfair({})) == []


def test_allot():
    wanted = [M.Target("a", 0.5, 1), M.Target("b", 0.3, 2), M.Target("c", 0.2, 3), M.Target("none", 0.1, 1)]
    got = {s.source: s.taken for s in M.allot(wanted, {"a": 1000, "b": 1000, "c": 10}, 1000)}
    assert got["c"] == 30 and got["none"] == 0
    assert got["a"] == int(970 * 0.5 / 0.8) and got["b"] == int(970 * 0.3 / 0.8)
    assert sum(s.taken for s in M.allot(wanted, {"a": 10, "b": 10, "c": 10}, 10**6)) == 10 + 20 + 30
    assert sum(s.taken for s in M.allot(wanted, {}, 100)) == 0


pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no vocabulary file here")


def test_tokens():
    with open(M.TOKENIZER, "rb") as f:
        e = M.encoding(f.read())
    text = "A empresa não apresentou certidão.\n\n" * 6000
    assert M.count_tokens(e.encode_ordinary, text) == len(e.encode_ordinary(text))
    assert M.count_tokens(e.encode_ordinary, None) == M.count_tokens(e.encode_ordinary, "") == 0
    assert e.decode(e.encode_ordinary(text)) == text
    random.seed(6)
    kinds = [" ", "\n", "  ", "palavra", "1", ".", "é", "\u3000", "\t"]
    for text in ("x" * 250_000, "é, " * 90_000, "x" * 150_000 + " " * 90_000 + "y", "".join(random.choices(kinds, k=150_000)), " " * 99_000 + "x" * 120_000 + "\n fim"):
        assert M.count_tokens(e.encode_ordinary, text) == len(e.encode_ordinary(text)), text[:10]
    assert M.count_tokens(e.encode_ordinary, " " * 450_000 + "x") > 0


def test_schedule_is_that_of_pfair(spark):
    n = {"a": 70_000, "b": 3, "c": 900}
    assert [tuple(r) for r in M.schedule(spark, n).orderBy("slot").collect()] == list(M.pfair(n))
    assert M.schedule(spark, {}).count() == 0


def test_a_long_schedule_is_joined(spark, monkeypatch):
    rows = [(i, "ab"[i % 3 == 0], "palavra " * 5) for i in range(200)]
    wanted = [M.Target("a", 0.5, 1), M.Target("b", 0.5, 1)]
    one = sorted(map(tuple, mixture(spark, rows, wanted).documents.collect()))
    monkeypatch.setattr(M, "MOST_BROADCAST", 3)
    assert sorted(map(tuple, mixture(spark, rows, wanted).documents.collect())) == one


def test_the_block_bounds_the_deviation_at_any_size(spark):
    for size in (100, 2000):
        rows = [(i, "ab"[i % 3 == 0], "palavra " * 5) for i in range(size)]
        docs = mixture(spark, rows, [M.Target("a", 0.5, 1), M.Target("b", 0.5, 1)], block_tokens=30).documents.collect()
        seen = {"a": 0, "b": 0}
        whole = {s: sum(r.tokens for r in docs if r.source == s) for s in seen}
        for r in sorted(docs, key=lambda r: (r.slot, r.posicao)):
            seen[r.source] += r.tokens
            assert all(abs(seen[s] - sum(seen.values()) * whole[s] / sum(whole.values())) < 2 * 30 for s in seen)


def mixture(spark, rows, wanted, total=None, block_tokens=60):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, tokens int")
    return M.mix(df, "doc_id", "source", "text", wanted, total, block_tokens=block_tokens)


def test_shares_and_caps(spark):
    random.seed(2)
    rows = [(i, s, "palavra " * random.randint(1, 30)) for i, s in enumerate(["a"] * 200 + ["b"] * 200 + ["c"] * 5 + ["x"] * 9 + [None] * 3)] + [(900, "a", None), (901, "a", "")]
    wanted = [M.Target("a", 0.5, 1), M.Target("b", 0.3, 1), M.Target("c", 0.2, 4), M.Target("gone", 0.1, 2)]
    m = mixture(spark, rows, wanted, 3000)
    docs = m.documents.collect()
    assert {r.source for r in docs} == {"a", "b", "c"}
    assert len({(r.doc_id, r.repeticao) for r in docs}) == len(docs)
    assert max(r.repeticao for r in docs if r.source != "c") == 1 and {r.repeticao for r in docs if r.source == "c"} == {1, 2, 3, 4}
    total = sum(r.tokens for r in docs)
    assert abs(total - 3000) < 200
    shares = {r.source: r for r in m.shares.collect()}
    assert shares["gone"].tokens == 0 and abs(sum(r.peso_real for r in shares.values()) - 1) < 1e-9
    left = total - shares["c"].tokens
    assert abs(shares["a"].tokens - left * 5 / 8) < 100
    # every prefix is near its share: a block and the documents that straddle its ends
    order = sorted(docs, key=lambda r: (r.slot, r.posicao))
    seen = dict.fromkeys("abc", 0)
    for n, r in enumerate(order):
        seen[r.source] += r.tokens
        for s in "abc":
            assert abs(seen[s] - sum(seen.values()) * shares[s].tokens / total) < 3 * (3000 / 50) + 120, (n, s)


def test_edges(spark):
    assert mixture(spark, [], [M.Target("a", 1.0, 1)]).documents.count() == 0
    assert mixture(spark, [(1, "a", "x")], []).documents.count() == 0
    assert mixture(spark, [], [M.Target("a", 1.0, 1)]).shares.first().peso_real == 0
    same = mixture(spark, [(i, "a", "um dois") for i in range(20)], [M.Target("a", 1.0, 3)], 10**9)
    assert same.documents.count() == 60
    t = spark.createDataFrame([("a", 0.5, 1), ("a", 0.1, 3), (None, 0.2, 1), ("b", 0.0, 1), ("c", 0.1, 0), ("d", None, 1)], "source string, w double, r int")
    assert M.targets(t, "source", "w", "r") == [M.Target("a", 0.6, 3)]
