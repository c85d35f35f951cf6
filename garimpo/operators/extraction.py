"""Model calls behind one interface, and the two pipelines built on them.

An extractor answers a batch of (context, question) pairs. The offline one finds
names and identifiers by pattern; a replay reads stored answers; an HTTP one
talks to a chat endpoint. Calls run inside ``mapInPandas`` with one client for a
partition, retry what can be retried, and return errors as data. An answer that
does not parse is asked for again, in the independent pipeline with a correction.
What a model answered should be written once and read back, for a plan that is
run again would call it again; the runs of the two pipelines do so by ``keep``.

A ``Retrieval`` gives a question the nearest chunks of its document; without one
the context is the whole text.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import normalize as N
from garimpo.operators import embedding, filters, parsing, prompts
from garimpo.session import ship

# Signs of a fault that may pass. Fixed values.
PASSING = ("404", "connection", "timeout", "503", "busy", "server error", "502", "504", "429", "rate", "expecting value", "json")


@dataclass(frozen=True)
class Backoff:
    """Waits of base * 2^k seconds, at most ``most`` each, for ``tries`` tries."""

    tries: int
    base: float
    most: float = float("inf")

    def waits(self) -> list[float]:
        return [min(self.base * 2**k, self.most) for k in range(self.tries - 1)]


#: Tries of a structured call, and seconds between tries of any question.
STRICT_TRIES, PAUSE = 3, 5.0
LINES_BACKOFF, JSON_BACKOFF = Backoff(8, 20, 300), Backoff(5, 15)


def may_pass(error: BaseException | str) -> bool:
    return any(s in str(error).lower() for s in PASSING)


def retried(call: Callable[[], str], backoff: Backoff, sleep: Callable[[float], None] = time.sleep) -> str:
    for wait in [*backoff.waits(), None]:
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if wait is None or not may_pass(e):
                raise
            sleep(wait)
    raise AssertionError


class Extractor(Protocol):
    """With an attribute ``batched`` that is true it is asked a whole batch at once, else one question after the other."""

    def answer(self, contexts: Sequence[str], questions: Sequence[str]) -> list[str]: ...


_CNPJ = re.compile(r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}")
_NAMED_FIRM = re.compile(r"((?:[A-ZÀ-Ý][\wÀ-ÿ’'.&/-]*|&|e|d[aeo]s?|[12]ª)(?: (?:[A-ZÀ-Ý0-9][\wÀ-ÿ’'.&/-]*|&|e|d[aeo]s?))*) \(CNPJ (\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})\)")
_PERSON = re.compile(r"((?:[A-ZÀ-Ý][\wÀ-ÿ’'-]*|d[aeo]s?|d’[A-ZÀ-Ý]\w*)(?: (?:[A-ZÀ-Ý][\wÀ-ÿ’'-]*|d[aeo]s?|d’[A-ZÀ-Ý]\w*))*), portador\(a\) do (CPF|RG) nº ([\d.]+-[\dXx]{1,2})")


class Patterns:
    """The offline extractor: companies as ``Name (CNPJ n)``, partners as ``Name, portador(a) do CPF|RG nº n``.

    Answers questions of the chained pipeline in JSON; a partners' question names
    its company's CNPJ, and only the text from there to the next company counts.
    Questions that ask for lines get lines. Asked again it would answer the same.
    """

    deterministic = batched = True

    def answer(self, contexts: Sequence[str], questions: Sequence[str]) -> list[str]:
        return [self._one(c or "", q or "") for c, q in zip(contexts, questions)]

    def _one(self, context: str, question: str) -> str:
        if prompts.PERSON_LINE in question:
            return " ".join(f"{n}, {v if k == 'CPF' else ''}, {v if k == 'RG' else ''};" for n, k, v in _PERSON.findall(context))
        if prompts.COMPANY_LINE in question:
            return " ".join(f"{n}, {c};" for n, c in _NAMED_FIRM.findall(context))
        asked = _CNPJ.search(question)
        if not asked:
            return json.dumps({"empresas": [{"nome": n, "cnpj": c} for n, c in _NAMED_FIRM.findall(context)]}, ensure_ascii=False)
        begin = context.find(asked[0])
        if begin < 0:
            return '{"socios": []}'
        after = _CNPJ.search(context, begin + len(asked[0]))
        part = context[begin : after.start() if after else len(context)]
        rows = [{"nome": n, "cpf": v if k == "CPF" else "", "rg": v if k == "RG" else ""} for n, k, v in _PERSON.findall(part)]
        return json.dumps({"socios": rows}, ensure_ascii=False)


class Replay:
    """Stored answers by question."""

    batched = True

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = answers

    def answer(self, contexts: Sequence[str], questions: Sequence[str]) -> list[str]:
        return [self.answers.get(q, "") for q in questions]


# What short names of models stand for at the hosted provider, and the addresses of the providers. Fixed values.
HOSTED = {
    "llama3.3:70b": "meta-llama/llama-3.3-70b-instruct",
    "deepseek-r1:70b": "deepseek/deepseek-r1-distill-llama-70b",
    "gemma3:27b": "google/gemma-3-27b-it",
    "qwen3:32b": "qwen/qwen3-32b",
}
ADDRESSES = {"openrouter": "https://openrouter.ai/api/v1/chat/completions", "ollama": "http://localhost:11434/api/chat"}


@dataclass(frozen=True)
class Http:
    """A chat endpoint; the key comes from the environment of the executors.

    ``local`` endpoints take the budget as ``num_predict`` among options and
    answer with one message.
    """

    url: str
    model: str
    temperature: float = 0.1
    max_tokens: int = 2048
    timeout: float = 300
    key_variable: str = "LLM_API_KEY"
    backoff: Backoff = JSON_BACKOFF
    local: bool = False
    compress: bool = False

    def answer(self, contexts: Sequence[str], questions: Sequence[str]) -> list[str]:
        return [retried(lambda c=c, q=q: self._call(prompts.qa_text(c, q)), self.backoff) for c, q in zip(contexts, questions)]

    def _call(self, content: str) -> str:
        body = self.body(content)
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:  # noqa: S310
            got = json.load(r)
        return (got if self.local else got["choices"][0])["message"]["content"]

    def body(self, content: str) -> dict:
        """What is sent for one question."""
        body = {"model": self.model, "messages": [{"role": "user", "content": content}]}
        if self.local:
            return {**body, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        body |= {"temperature": self.temperature, "max_tokens": self.max_tokens}
        return {**body, "plugins": [{"id": "context-compression"}]} if self.compress else body


def client(provider: str, model: str, lines: bool, temperature: float = 0.1, url: str | None = None) -> Http:
    """The model of a provider, with the budget of the pipeline: answers in lines (independent) or in JSON (chained)."""
    if provider not in ADDRESSES:
        raise ValueError(f"unknown provider {provider}")
    backoff = LINES_BACKOFF if lines else JSON_BACKOFF
    if provider == "ollama":
        return Http(url or ADDRESSES[provider], model, temperature, 300 if lines else 1024, backoff=backoff, local=True)
    return Http(url or ADDRESSES[provider], HOSTED.get(model, model), temperature, 4096 if lines else 2048, backoff=backoff, compress=not (lines and model == "gemma3:27b"))


def _answers(model: Extractor, contexts: list[str], questions: list[str]) -> list[tuple[str, str | None]]:
    """Answers and errors; a model that is ``batched`` gets all questions at once, another one by one, so that a fault is that of one question."""
    size = max(len(questions), 1) if getattr(model, "batched", False) else 1
    out: list[tuple[str, str | None]] = []
    for i in range(0, len(questions), size):
        c, q = contexts[i : i + size], questions[i : i + size]
        try:
            got = model.answer(c, q)
            out += [(a, None) for _, a in zip(q, got, strict=True)]
        except Exception as e:  # noqa: BLE001
            out += [("", f"{type(e).__name__}: {e}")] * len(q)
    return out


def _answered(model: Extractor, contexts: list[str], questions: list[str], problem, tries: int, hint, pause: float) -> list[tuple[str, str | None]]:
    """For each question the first answer without a problem, else the last one and its error."""
    asked = list(questions)
    found: list[tuple[str, str | None]] = [("", None)] * len(asked)
    left = list(range(len(asked)))
    for n in range(1 if getattr(model, "deterministic", False) else tries):
        if n and left:
            time.sleep(pause)
        again = []
        for i, (answer, error) in zip(left, _answers(model, [contexts[i] for i in left], [asked[i] for i in left])):
            if error is None and problem and (error := problem(answer)) is not None and hint:
                asked[i] = f"{questions[i]}\n{hint(error)}"
            found[i] = (answer, error)
            if error is not None:
                again.append(i)
        left = again
    return found


def ask(
    df: DataFrame,
    make: Callable[[], Extractor],
    keys: Sequence[str],
    context: str = "contexto",
    question: str = "pergunta",
    problem: Callable[[str], str | None] | None = None,
    tries: int = 1,
    hint: Callable[[str], str | None] | None = None,
) -> DataFrame:
    """``keys``, ``resposta`` and ``erro``: a failed row keeps the message and an empty answer.

    With ``problem`` an answer of which it gives an error is asked for again, up to
    ``tries`` times in all, with the ``hint`` for its error; the last answer is kept
    with its error.
    """
    if tries < 1:
        raise ValueError("tries must be at least 1")
    pause = PAUSE
    ship(df.sparkSession)
    cols = df.select(*keys, F.col(context).alias("_c"), F.col(question).alias("_q"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-2])
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            got = _answered(model, b["_c"].tolist(), b["_q"].tolist(), problem, tries, hint, pause)
            yield b[names].assign(resposta=[a for a, _ in got], erro=[e for _, e in got])

    return cols.mapInPandas(run, f"{kinds}, resposta string, erro string")


@dataclass(frozen=True)
class Retrieval:
    """Contexts by the ``k`` nearest chunks of a question's own document."""

    make: Callable[[], embedding.Embedder]
    k: int
    size: int
    overlap: int
    separators: tuple[str, ...]
    max_chars: int | None = None

    def contexts(self, docs: DataFrame, key: str, text: str, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``asked`` with ``contexto``; questions about a document without chunks are left out."""
        q = asked.withColumn("_id", F.to_json(F.struct(*keys)))
        got = embedding.question_contexts(docs, key, text, q, "_id", "pergunta", self.make, self.k, self.size, self.overlap, self.separators, self.max_chars)
        return q.join(got.withColumnRenamed("query_id", "_id"), [key, "_id"]).drop("_id")


Keep = Callable[[DataFrame, str], DataFrame]


def _first(docs: DataFrame, key: str, text: str, question: Column, retrieval: Retrieval | None) -> DataFrame:
    """A question about each document with its context."""
    if retrieval is None:
        return docs.select(key, F.col(text).alias("contexto"), question.alias("pergunta"))
    return retrieval.contexts(docs, key, text, docs.select(key, question.alias("pergunta")), [key])


def _chained(docs: DataFrame, key: str, text: str, make: Callable[[], Extractor], flags: prompts.Flags, retrieval: Retrieval | None, keep: Keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies with partners, answers about companies, answers about partners)."""
    asked = _first(docs, key, text, prompts.companies_json_question(flags), retrieval)
    asked = asked.withColumn("pergunta", prompts.with_schema(F.col("pergunta"), prompts.COMPANIES_SCHEMA))
    first = keep(ask(asked, make, [key], problem=partial(parsing.strict_problem, shape=parsing.COMPANIES), tries=STRICT_TRIES), "empresas")
    firms = (
        first.select(key, F.posexplode(parsing.strict_companies("resposta")).alias("ord", "e"))
        .select(key, "ord", F.col("e.nome").alias("empresa"), F.col("e.cnpj").alias("cnpj"))
        .filter(filters.has_cnpj("cnpj") & ~filters.is_public_body("empresa"))
    )
    keys = [key, "ord", "empresa", "cnpj"]
    question = prompts.partners_question(F.col("empresa"), F.col("cnpj"), flags)
    if retrieval is None:
        second = firms.join(docs.select(key, F.col(text).alias("contexto")), key).withColumn("pergunta", question)
    else:
        second = retrieval.contexts(docs, key, text, firms.withColumn("pergunta", question), [key, "ord"])
    second = second.withColumn("pergunta", prompts.with_schema(F.col("pergunta"), prompts.PARTNERS_SCHEMA))
    answered = keep(ask(second, make, keys, problem=partial(parsing.strict_problem, shape=parsing.PERSONS), tries=STRICT_TRIES), "socios")
    partner = F.transform(
        F.filter(parsing.strict_partners("resposta"), lambda p: filters.has_document(p.cpf, p.rg)),
        lambda p: F.struct(p.nome.alias("nome"), filters.blank_null_words(p.cpf).alias("cpf"), filters.blank_null_words(p.rg).alias("rg")),
    )
    none = F.expr("cast(array() as array<struct<nome:string,cpf:string,rg:string>>)")
    return answered.select(*keys, F.coalesce(partner, none).alias("socios")), first, answered


def chained(docs: DataFrame, key: str, context: str, make: Callable[[], Extractor], flags: prompts.Flags = prompts.Flags()) -> DataFrame:
    """Companies first, then the partners of each, from whole contexts: (key, ord, empresa, cnpj, socios).

    A failed or invalid list gives no rows at that step; public bodies and
    companies without a CNPJ are dropped, partners need a document.
    """
    return _chained(docs, key, context, make, flags, None, lambda df, _: df)[0]


def chained_run(
    docs: DataFrame, key: str, text: str, make: Callable[[], Extractor], keep: Keep, retrieval: Retrieval | None = None, flags: prompts.Flags = prompts.Flags()
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``chained``, and the answers that failed to the last try: (key, etapa, resposta, erro).

    ``keep`` stores the answers of a step under its name and gives them back.
    """
    rows, first, second = _chained(docs, key, text, make, flags, retrieval, keep)
    steps = (("empresas", first, parsing.strict_companies), ("socios", second, parsing.strict_partners))
    a, b = (
        answers.filter(F.col("erro").isNotNull() | read("resposta").isNull()).select(key, F.lit(step).alias("etapa"), "resposta", F.coalesce("erro", F.lit("invalid")).alias("erro"))
        for step, answers, read in steps
    )
    return rows, a.unionByName(b)


def independent_run(
    docs: DataFrame, key: str, text: str, make: Callable[[], Extractor], keep: Keep, retrieval: Retrieval | None = None, flags: prompts.Flags = prompts.Flags(), tries: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Both questions about each document: the rows of ``independent``, and the answers that failed to the last try: (key, etapa, resposta, erro).

    An answer that is still blank at the last try says that there is nothing.
    """
    parts = []
    for kind, question, shape, line in (
        ("empresas", prompts.companies_question(flags), parsing.COMPANIES, prompts.COMPANY_LINE),
        ("pessoas", prompts.persons_question(flags), parsing.PERSONS, prompts.PERSON_LINE),
    ):
        asked = _first(docs, key, text, question, retrieval)
        got = ask(asked, make, [key], problem=partial(parsing.lenient_problem, shape=shape), tries=tries, hint=partial(parsing.correction_hint, shape=line))
        parts.append(got.select(key, F.lit(kind).alias("pergunta"), F.col("resposta").alias("raw"), "erro"))
    answers = keep(parts[0].unionByName(parts[1]), "respostas")
    failed = answers.filter(F.col("erro").isNotNull() & (F.col("erro") != parsing.EMPTY)).select(key, F.col("pergunta").alias("etapa"), F.col("raw").alias("resposta"), "erro")
    return independent(answers, key, "raw", "pergunta"), failed


def independent(answers: DataFrame, key: str, raw: str, kind: str) -> DataFrame:
    """Flat entities (arquivo, tipo_entidade, nome, identificador, aux) from answers of both kinds of question."""
    firms = (
        answers.filter(F.col(kind) == "empresas")
        .select(key, parsing.lenient_companies(raw).alias("_r"))
        .select(key, F.posexplode("_r.itens").alias("ord", "e"))
        .select(F.col(key).alias("arquivo"), "ord", F.lit("Empresa").alias("tipo_entidade"), N.sanitize("e.nome").alias("nome"), F.col("e.cnpj").alias("identificador"), F.lit("").alias("aux"))
        .filter((N.strip("nome") != "") & ~filters.is_public_body("nome"))
    )
    persons = (
        answers.filter(F.col(kind) == "pessoas")
        .select(key, parsing.lenient_persons(raw).alias("_r"))
        .select(key, F.posexplode("_r.itens").alias("ord", "e"))
        .select(F.col(key).alias("arquivo"), "ord", F.lit("Pessoa").alias("tipo_entidade"), N.sanitize("e.nome").alias("nome"), F.col("e.cpf").alias("identificador"), F.col("e.rg").alias("aux"))
        .filter(N.strip("nome") != "")
    )
    return firms.unionByName(persons)
