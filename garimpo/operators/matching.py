"""Greedy one-to-one matching of gold and answered entities inside each document.

Gold entities choose in their own order. A company takes the first free answer
with an equal name or identifier; a person takes the free answer with the highest
score (3 name, 2 CPF, 1 RG, above 0), the earliest among equals. What earlier
entities took is gone for later ones, so this is a fold and not a join.

At tolerance 1 the fold runs in the JVM: both sides are collected into sorted
arrays with one shuffle on the document, joined in full, and folded with
``aggregate``. Below 1 an Arrow UDF folds the same arrays with string similarity.
A group is one document's entities, bounded by the document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimpo.functions import normalize as N
from garimpo.functions.similarity import possible, ratio

COMPANY = "struct<o:bigint,n:string,c:string>"
PERSON = "struct<o:bigint,n:string,c:string,d:string>"
PARTNERED = "struct<o:bigint,n:string,c:string,s:array<struct<n:string,c:string,d:string>>>"
COMPANY_PAIR = "struct<g:int,r:int,n:boolean,c:boolean>"
PERSON_PAIR = "struct<s:int,ni:int,g:int,n:boolean,c:boolean,d:boolean>"


def company_fold(gold: str, answer: str, empty_names_match: bool) -> str:
    """SQL for the pairs of two arrays of companies; ``g`` and ``r`` are positions."""
    same = "g.n = x.n" if empty_names_match else "(g.n <> '' and g.n = x.n)"
    return f"""aggregate(transform({gold}, (y, j) -> struct(y.n as n, y.c as c, j as j)), cast(array() as array<{COMPANY_PAIR}>),
        (st, g) -> concat(st, slice(filter(
            transform({answer}, (x, i) -> named_struct('g', g.j, 'r', i, 'n', {same}, 'c', g.c = x.c)),
            k -> (k.n or k.c) and not exists(st, u -> u.r = k.r)), 1, 1)))"""


def person_fold(gold: str, answer: str) -> str:
    """SQL for the pairs of two arrays of persons; ``ni`` is minus the answer's position, so that the maximum breaks ties."""
    same = "(g.n <> '' and g.n = x.n)"
    return f"""aggregate(transform({gold}, (y, j) -> struct(y.n as n, y.c as c, y.d as d, j as j)), cast(array() as array<{PERSON_PAIR}>),
        (st, g) -> concat(st, filter(array(array_max(filter(
            transform({answer}, (x, i) -> named_struct('s', int({same}) * 3 + int(g.c = x.c) * 2 + int(g.d = x.d), 'ni', -i, 'g', g.j, 'n', {same}, 'c', g.c = x.c, 'd', g.d = x.d)),
            k -> k.s > 0 and not exists(st, u -> u.ni = k.ni)))), z -> z is not null)))"""


def fold_companies(gold: list, answer: list, tolerance: float, empty_names_match: bool) -> list[dict]:
    """The company fold over lists of (name, identifier)."""
    used: set[int] = set()
    out = []
    for g, (gn, gc) in enumerate(gold):
        for r, (rn, rc) in enumerate(answer):
            if r in used:
                continue
            name = bool(empty_names_match or gn and rn) and possible(gn, rn, tolerance) and ratio(gn, rn) >= tolerance
            if name or gc == rc:
                used.add(r)
                out.append({"g": g, "r": r, "n": name, "c": gc == rc})
                break
    return out


def fold_persons(gold: list, answer: list, tolerance: float) -> list[dict]:
    """The person fold over lists of (name, CPF, RG)."""
    used: set[int] = set()
    out = []
    for g, (gn, gc, gd) in enumerate(gold):
        best = None
        for r, (rn, rc, rd) in enumerate(answer):
            if r in used:
                continue
            name = bool(gn and rn) and possible(gn, rn, tolerance) and ratio(gn, rn) >= tolerance
            score = 3 * name + 2 * (gc == rc) + (gd == rd)
            if score and (best is None or score > best["s"]):
                best = {"s": score, "ni": -r, "g": g, "n": name, "c": gc == rc, "d": gd == rd}
        if best:
            used.add(-best["ni"])
            out.append(best)
    return out


def _similar_companies(tolerance: float, empty_names_match: bool):
    @F.pandas_udf(T.ArrayType(T._parse_datatype_string(COMPANY_PAIR)))
    def run(gold: pd.Series, answer: pd.Series) -> pd.Series:
        return pd.Series([fold_companies([(x["n"], x["c"]) for x in a], [(x["n"], x["c"]) for x in b], tolerance, empty_names_match) for a, b in zip(gold, answer)], dtype=object)

    return run


def _similar_persons(tolerance: float):
    @F.pandas_udf(T.ArrayType(T._parse_datatype_string(PERSON_PAIR)))
    def run(gold: pd.Series, answer: pd.Series) -> pd.Series:
        def rows(v):
            return [(x["n"], x["c"], x["d"]) for x in v]

        return pd.Series([fold_persons(rows(a), rows(b), tolerance) for a, b in zip(gold, answer)], dtype=object)

    return run


def normalised(entities: DataFrame) -> DataFrame:
    """Flat entities (id, ord, tipo, nome, identificador, aux) with the keys that matching compares."""
    kinds = entities.select(
        "id",
        F.col("ord").cast("long").alias("o"),
        F.lower(N.normalize_text("tipo")).alias("_kind"),
        N.normalize_text("nome").alias("n"),
        N.normalize_identifier("identificador").alias("c"),
        "aux",
    )
    firm, person = (F.contains("_kind", F.lit(k)) for k in ("empresa", "pessoa"))
    # suffixes play a part for companies only, the RG for persons only
    return kinds.select(
        "id", "o", firm.alias("firm"), person.alias("person"), "n", F.when(firm, N.strip_suffixes("n")).alias("firm_n"), "c", F.when(person, N.normalize_rg("aux")).alias("d")
    )


def _sides(entities: DataFrame, suffix: str) -> DataFrame:
    """One row for each document: its companies and persons in order. A kind that holds both words counts as both."""
    firm = F.struct("o", F.col("firm_n").alias("n"), "c")
    person = F.struct("o", "n", "c", "d")
    return (
        normalised(entities)
        .groupBy("id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("firm"), firm))).alias(f"firms_{suffix}"),
            F.array_sort(F.collect_list(F.when(F.col("person"), person))).alias(f"persons_{suffix}"),
        )
    )


def match_flat(gold: DataFrame, answer: DataFrame, tolerance: float = 1.0, person_tolerance: float | None = None) -> DataFrame:
    """Documents with their entities on both sides and ``firm_pairs`` and ``person_pairs``.

    Documents of only one side have an empty other side. Persons are matched
    across the whole document.
    """
    person_tolerance = tolerance if person_tolerance is None else person_tolerance
    both = _sides(gold, "g").join(_sides(answer, "r"), "id", "full_outer")
    for c, t in (("firms", COMPANY), ("persons", PERSON)):
        for s in "gr":
            both = both.withColumn(f"{c}_{s}", F.coalesce(f"{c}_{s}", F.expr(f"cast(array() as array<{t}>)")))
    firms = F.expr(company_fold("firms_g", "firms_r", False)) if tolerance >= 1 else _similar_companies(tolerance, False)("firms_g", "firms_r")
    persons = F.expr(person_fold("persons_g", "persons_r")) if person_tolerance >= 1 else _similar_persons(person_tolerance)("persons_g", "persons_r")
    return both.withColumn("firm_pairs", firms).withColumn("person_pairs", persons)


def nested(companies: DataFrame, partners: DataFrame) -> DataFrame:
    """Nested documents from companies (id, ord, key, empresa, cnpj) and partners (key, ord, nome, cpf, rg), in order."""
    p = (
        partners.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("o"), "nome", "cpf", "rg"))).alias("s"))
        .select("key", F.transform("s", lambda x: F.struct(x.nome.alias("nome"), x.cpf.alias("cpf"), x.rg.alias("rg"))).alias("socios"))
    )
    empty = F.expr("cast(array() as array<struct<nome:string,cpf:string,rg:string>>)")
    return (
        companies.join(p, "key", "left")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("o"), "empresa", "cnpj", F.coalesce("socios", empty).alias("socios")))).alias("e"))
        .select("id", F.transform("e", lambda x: F.struct(x.empresa.alias("empresa"), x.cnpj.alias("cnpj"), x.socios.alias("socios"))).alias("empresas"))
    )


def _nested_side(docs: DataFrame, name: str) -> DataFrame:
    partner = lambda s: F.struct(N.normalize_text(s.nome).alias("n"), N.digits(s.cpf).alias("c"), N.normalize_rg(s.rg, False).alias("d"))
    firm = lambda e, i: F.struct(i.cast("long").alias("o"), N.company_name(e.empresa).alias("n"), N.digits(e.cnpj).alias("c"), F.transform(e.socios, partner).alias("s"))
    return docs.select("id", F.transform("empresas", firm).alias(name))


def match_nested(gold: DataFrame, answer: DataFrame, tolerance: float = 1.0, person_tolerance: float | None = None) -> DataFrame:
    """Nested documents (id, empresas) matched; partners only inside a matched pair of companies.

    ``pairs`` holds for each matched pair its flags, both partner lists' sizes
    and the partner pairs.
    """
    person_tolerance = tolerance if person_tolerance is None else person_tolerance
    both = _nested_side(gold, "firms_g").join(_nested_side(answer, "firms_r"), "id", "full_outer")
    for s in "gr":
        both = both.withColumn(f"firms_{s}", F.coalesce(f"firms_{s}", F.expr(f"cast(array() as array<{PARTNERED}>)")))
    if tolerance >= 1 and person_tolerance >= 1:
        both = both.withColumn("firm_pairs", F.expr(company_fold("firms_g", "firms_r", True)))
        inner = person_fold("firms_g[p.g].s", "firms_r[p.r].s")
        pairs = F.expr(f"transform(firm_pairs, p -> named_struct('g', p.g, 'r', p.r, 'n', p.n, 'c', p.c, 'ng', size(firms_g[p.g].s), 'nr', size(firms_r[p.r].s), 'p', {inner}))")
        return both.withColumn("pairs", pairs)
    both = both.withColumn("firm_pairs", _similar_companies(tolerance, True)("firms_g", "firms_r"))

    @F.pandas_udf(T.ArrayType(T._parse_datatype_string(f"struct<g:int,r:int,n:boolean,c:boolean,ng:int,nr:int,p:array<{PERSON_PAIR}>>")))
    def partners(gold_: pd.Series, answer_: pd.Series, pairs_: pd.Series) -> pd.Series:
        def rows(v):
            return [(x["n"], x["c"], x["d"]) for x in v]

        out = []
        for a, b, ps in zip(gold_, answer_, pairs_):
            own = []
            for p in ps:
                x, y = rows(a[p["g"]]["s"]), rows(b[p["r"]]["s"])
                own.append(dict(p) | {"ng": len(x), "nr": len(y), "p": fold_persons(x, y, person_tolerance)})
            out.append(own)
        return pd.Series(out, dtype=object)

    return both.withColumn("pairs", partners("firms_g", "firms_r", "firm_pairs"))
