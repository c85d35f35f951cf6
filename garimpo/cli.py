"""Command line: scorers for flat CSV and nested JSON, and both pipelines over a folder of documents.

    python -m garimpo.cli score-csv GOLD ANSWER [--limiar 0.95] [--tolerancia-nome T] [--tolerancia-nome-socio T] [--exportar-txt F] [--exportar-json F]
    python -m garimpo.cli score-json GOLD ANSWER [--tolerancia-nome 1.0] [--tolerancia-nome-socio 1.0] [--exportar-txt F] [--exportar-json F]
    python -m garimpo.cli run-chained FOLDER OUT [--provider P] [--url U] [--model M] [--embedding E [--embedding-url U]]
    python -m garimpo.cli run-independent FOLDER OUT [--provider P] [--url U] [--model M] [--embedding E [--embedding-url U]]
    python -m garimpo.cli parse-answers TABLE OUT

A model of the provider, or at ``--url``, is asked about the nearest chunks by the embedding, hashed words where none is named. Without one,
patterns read the whole texts.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from garimpo.operators import embedding, extraction, matching, metrics, prompts
from garimpo.sources import files, sinks

CSV_TOLERANCE, JSON_TOLERANCE = 0.85, 1.0


def score_csv(spark: SparkSession, gold: str, answer: str, limit: float = CSV_TOLERANCE, name: float | None = None, partner: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, totals, measures); tolerances that are not given fall back to the limit."""
    matched = matching.match_flat(files.entities_csv(spark, gold), files.entities_csv(spark, answer), limit if name is None else name, limit if partner is None else partner)
    docs = metrics.flat_counters(matched)
    totals = metrics.totals(docs, metrics.FLAT)
    return docs, totals, metrics.flat_measures(totals)


def score_json(spark: SparkSession, gold: str, answer: str, name: float = JSON_TOLERANCE, partner: float = JSON_TOLERANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = metrics.nested_counters(matching.match_nested(files.nested_json(spark, gold), files.nested_json(spark, answer), name, partner))
    totals = metrics.totals(docs, metrics.NESTED)
    return docs, totals, metrics.nested_measures(totals)


def report(scored: tuple[DataFrame, DataFrame, DataFrame], of, title: str, text: str | None, data: str | None, config: dict) -> str:
    """The report's global part; with ``text`` and ``data`` whole reports, documents included, are written to those files.

    ``of`` makes the measures of counters.
    """
    docs, totals, measures = scored
    docs = docs.persist()
    try:
        names = (totals.columns, measures.columns)
        total, rates, means = totals.first().asDict(), measures.first().asDict(), metrics.macro(docs).first().asDict()
        head = sinks.report_head(title, config, total, rates, means)
        each = of(docs, ("id", metrics.PASS, *names[0])) if text or data else None
        if text:
            sinks.write_report_text(text, head, metrics.passed_documents(docs), sinks.document_blocks(each, *names))
        if data:
            sinks.write_report_json(data, *sinks.report_json(config, total, rates, means, each, *names))
    finally:
        docs.unpersist()
    return "\n".join(head)


def _config(arguments: argparse.Namespace) -> dict:
    """The command's arguments, and the parameters of extraction if the answer is one file that holds them."""
    found = {}
    if os.path.isfile(arguments.resposta):
        with open(arguments.resposta, encoding="utf-8", errors="replace") as f:
            found = files.embedded_config(f.read())
    return {**vars(arguments), **({"parametros_extracao": found} if found else {})}


def _flags(config: files.Config) -> prompts.Flags:
    return prompts.Flags(*[str(v).strip().lower() == "sim" for v in (config.aux_terms, config.negative_prompt, config.prompt_enhancement)])


def _retrieval(config: files.Config, embed, k: int, max_chars: int | None = None) -> extraction.Retrieval | None:
    return embed and extraction.Retrieval(embed, k, config.chunk_size, config.chunk_overlap, config.separators, max_chars)


def _run(spark: SparkSession, folder: str, out: str, config: files.Config, extract, write) -> None:
    """Extracts from the documents that are not finished; those without a last error get their rows written and are marked done.

    Everything of a batch goes under its number, so that a batch that was not
    finished is written again and no row is there twice. Failed answers are kept
    in ``erros``; their documents are taken again by the next run.
    """
    docs = files.documents(spark, folder, config.max_txt_chars).select("doc_id", "text")
    finished = sinks.done(spark, f"{out}/done", "doc_id")
    batch = sinks.next_batch(finished)
    todo = sinks.pending(docs, finished, "doc_id")
    rows, errors = extract(todo, lambda df, name: sinks.stored(df, f"{out}/respostas/batch_id={batch}/{name}"))
    sinks.write_batch(errors, f"{out}/erros", batch)
    failed = errors.select("doc_id").distinct()
    write(rows, failed, batch)
    sinks.mark_done(sinks.pending(todo, failed, "doc_id"), "doc_id", f"{out}/done", batch)


def run_chained(spark: SparkSession, folder: str, out: str, make, config: files.Config = files.Config(), embed=None) -> None:
    """Companies, then the partners of each, as a table and as nested JSON; ``embed`` makes the embedder of the retrieval, without it contexts are whole texts."""

    def write(rows: DataFrame, failed: DataFrame, batch: int) -> None:
        good = sinks.pending(rows, failed, "doc_id")
        sinks.write_batch(good, f"{out}/empresas", batch)
        sinks.write_nested_json(sinks.nested_results(good, "doc_id"), "doc_id", f"{out}/json/batch_id={batch}")

    _run(
        spark, folder, out, config, lambda docs, keep: extraction.chained_run(docs, "doc_id", "text", make, keep, _retrieval(config, embed, config.k_chained, config.max_context_chars), _flags(config)), write
    )


def run_independent(spark: SparkSession, folder: str, out: str, make, config: files.Config = files.Config(), embed=None) -> None:
    """Companies and persons by two independent questions, as flat CSV."""

    def write(rows: DataFrame, failed: DataFrame, batch: int) -> None:
        sinks.write_entities_csv(sinks.pending(rows, failed.withColumnRenamed("doc_id", "arquivo"), "arquivo"), f"{out}/entidades/batch_id={batch}", "overwrite")

    _run(
        spark,
        folder,
        out,
        config,
        lambda docs, keep: extraction.independent_run(docs, "doc_id", "text", make, keep, _retrieval(config, embed, config.k_independent), _flags(config), config.parse_max_retries),
        write,
    )


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="garimpo")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("score-csv", "score-json"):
        s = sub.add_parser(name)
        s.add_argument("gabarito")
        s.add_argument("resposta")
        s.add_argument("--exportar-txt")
        s.add_argument("--exportar-json")
        s.add_argument("--tolerancia-nome", type=float, default=None if name == "score-csv" else JSON_TOLERANCE)
        s.add_argument("--tolerancia-nome-socio", type=float, default=None if name == "score-csv" else JSON_TOLERANCE)
        if name == "score-csv":
            s.add_argument("--limiar", type=float, default=0.95)
    for name in ("run-chained", "run-independent"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        s.add_argument("out")
        s.add_argument("--provider", choices=sorted(extraction.ADDRESSES))
        s.add_argument("--url")
        s.add_argument("--model", default="")
        s.add_argument("--embedding")
        s.add_argument("--embedding-url", default="http://localhost:11434/api/embed")
    s = sub.add_parser("parse-answers")
    s.add_argument("table")
    s.add_argument("out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("garimpo").getOrCreate()
    if a.command == "score-csv":
        print(report(score_csv(spark, a.gabarito, a.resposta, a.limiar, a.tolerancia_nome, a.tolerancia_nome_socio), metrics.flat_measures, "CSV", a.exportar_txt, a.exportar_json, _config(a)))
    elif a.command == "score-json":
        print(report(score_json(spark, a.gabarito, a.resposta, a.tolerancia_nome, a.tolerancia_nome_socio), metrics.nested_measures, "JSON", a.exportar_txt, a.exportar_json, _config(a)))
    elif a.command in ("run-chained", "run-independent"):
        config = files.Config.load(model=a.model)
        lines = a.command == "run-independent"
        asked = a.url or a.provider
        client = extraction.client(a.provider or "openrouter", a.model, lines, config.temperature, a.url) if asked else None
        embed = embedding.backend(a.embedding, a.embedding_url) if a.embedding else embedding.Hashing if asked else None
        (run_independent if lines else run_chained)(spark, a.folder, a.out, (lambda: client) if asked else extraction.Patterns, config, embed)
    else:
        sinks.write_entities_csv(extraction.independent(spark.read.parquet(a.table), "arquivo", "raw", "pergunta"), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
