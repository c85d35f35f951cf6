import csv
import io
import random

import pytest

from garimpo.operators import quarantine as Q
from garimpo.sources import delimited as D


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, so that records run over several of them."""
    keys = {"spark.sql.files.maxPartitionBytes": "37b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def test_records_run_over_splits(spark, tmp_path, tiny_splits):
    random.seed(3)
    files = {}
    for n in range(3):
        rows = [["".join(random.choices('abç,"\n ', k=random.choice((0, 3, 9, 80)))) + "x" for _ in range(3)] for _ in range(25)]
        files[f"f{n}.csv"] = rows
        (tmp_path / f"f{n}.csv").write_text(written(rows), encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    good, bad = D.strict_rows(spark, str(tmp_path), ["a", "b", "c"], header=False)
    got = {}
    for r in good.orderBy("origem", "posicao").collect():
        got.setdefault(r.origem.rsplit("/", 1)[1], []).append([r.a, r.b, r.c])
    assert got == {f: [[v.strip() for v in row] for row in rows] for f, rows in files.items()} and bad.count() == 0
    at = D.records(spark, str(tmp_path / "f0.csv")).orderBy("posicao").collect()
    data = (tmp_path / "f0.csv").read_bytes()
    assert len(at) == 25 and all(data[r.posicao :].decode().startswith(r.registro) for r in at)


def test_broken_records_are_kept_apart(spark, tmp_path, tiny_splits):
    lines = ["a,b", '"1\n\n2",x', 'bad "q",y', "one", '1,2,3', '"z"z,1', "ok,ok\r", "", '"open,', "to the end", "x,y"]
    text = "\n".join(lines) + "\n"
    (tmp_path / "f.csv").write_bytes(text.encode())
    good, bad = D.strict_rows(spark, str(tmp_path), ["a", "b"])
    assert [(r.a, r.b) for r in good.orderBy("posicao").collect()] == [("1\n\n2", "x"), ("ok", "ok")]
    want = [("aspas", 'bad "q"', 4), ("colunas", "one", 0), ("colunas", "1,2,3", 4), ("aspas", '"z"z', 3), ("aspas", '"open', 21)]
    rows = bad.orderBy("posicao").collect()
    assert [(r.motivo, r.posicao) for r in rows] == [(m, text.index("\n" + s) + 1) for m, s, _ in want] and [r.em for r in rows] == [e for *_, e in want]
    good, bad = D.strict_rows(spark, str(tmp_path / "f.csv"), ["a", "b"])
    assert good.count() == 2


def test_loose_quoting_is_that_of_the_csv_module(spark, tmp_path, tiny_splits):
    random.seed(5)
    text = "\n".join("".join(random.choices('ab,"  ', k=random.randint(1, 12))) + "e" for _ in range(40)) + "\n"
    (tmp_path / "f.csv").write_text(text)
    want = [r for r in csv.reader(io.StringIO(text)) if r]
    want[-1][-1] = want[-1][-1].rstrip("\n")  # of a quote that is never closed
    got = [r.campos for r in D.loose_rows(spark, str(tmp_path / "f.csv"), ",").orderBy("posicao").collect()]
    assert got == want


def test_lines_agree_with_the_machine(spark):
    random.seed(7)
    m = D.Lines(",", True)
    for _ in range(2000):
        line = "".join(random.choices('ab," ', k=random.randint(0, 12)))
        for inside, state in ((D.OPEN, Q.START), (D.INSIDE, Q.QUOTED)):
            assert (m.after(line, inside) == D.INSIDE) == (Q.CSV.transition(line, 0, len(line))[state] == Q.QUOTED)
