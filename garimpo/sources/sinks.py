"""Sinks: entity tables, nested results, finished documents, and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import normalize as N
from garimpo.operators import filters, metrics

COLUMNS = ("arquivo", "tipo_entidade", "nome", "identificador", "aux")


def entity_rows(entities: DataFrame) -> DataFrame:
    """Rows as they are written: commas out of names, nameless rows and public bodies (companies only) left out, no nulls."""
    df = entities.withColumn("nome", N.sanitize("nome"))
    public = (F.col("tipo_entidade") == "Empresa") & filters.is_public_body("nome")
    return df.filter((N.strip("nome") != "") & ~public).select("arquivo", "tipo_entidade", "nome", N.text_or_empty("identificador").alias("identificador"), N.text_or_empty("aux").alias("aux"))


def write_entities_csv(entities: DataFrame, path: str, mode: str = "append") -> None:
    entity_rows(entities).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def nested_results(companies: DataFrame, key: str) -> DataFrame:
    """(key, empresas) with partners that have a document; companies in order."""
    kept = F.filter("socios", lambda s: (N.strip(s.cpf) != "") | (N.strip(s.rg) != ""))
    one = F.struct("ord", "empresa", "cnpj", kept.alias("socios"))
    return companies.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(e.empresa.alias("empresa"), e.cnpj.alias("cnpj"), e.socios.alias("socios"))).alias("empresas"))


def write_nested_json(nested: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    """One object for each line, with the document as its key."""
    nested.select(F.to_json(F.create_map(key, "empresas"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written once and read back, so that what made them is not run again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pending(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Documents that are not finished yet."""
    return docs.join(done.select(key), key, "left_anti")


def mark_done(finished: DataFrame, key: str, path: str, batch: int | str) -> None:
    """Marks of one batch; written again they take the place of the first ones."""
    finished.select(key, F.current_timestamp().alias("finished_at")).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def write_batch(rows: DataFrame, path: str, batch: int | str) -> None:
    """Rows of one batch in a folder of its own, so that a batch that is written again leaves no row twice."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def done(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Finished documents so far, with their batch; none if nothing was written yet."""
    try:
        return spark.read.schema(f"{key} string, finished_at timestamp, batch_id long").parquet(path).select(key, "batch_id")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{key} string, batch_id long")
        raise


def next_batch(finished: DataFrame) -> int:
    """The number after the last batch that was marked; a batch that was not finished is written again under its number."""
    last = finished.agg(F.max("batch_id")).first()[0]
    return 0 if last is None else last + 1


def _family(name: str) -> str:
    """The part of a report that a counter or measure belongs to."""
    if "empresa_socio" in name:
        return "EMPRESA E SÓCIO"
    if any(k in name for k in ("global", "complet", "parcia", "validadas", "documentos")) and "pessoas_complet" not in name and "socios_completo" not in name.replace("com_socios", ""):
        return "VALIDAÇÃO COMPLETA"
    return "EMPRESAS" if any(k in name for k in ("empresas", "cnpj", "nomes")) and "pessoas" not in name and "socios" not in name else "PESSOAS"


def _families(values: dict) -> dict[str, dict]:
    found: dict[str, dict] = {k: {} for k in ("EMPRESAS", "PESSOAS", "EMPRESA E SÓCIO", "VALIDAÇÃO COMPLETA")}
    for k, v in values.items():
        found[_family(k)][k] = v
    return {k: v for k, v in found.items() if v}


def _rate(name: str, value: float) -> str:
    """Rates with two places; the shares of documents are percentages already and get one."""
    return f"{value / 100:.1%}" if name.startswith("taxa_documentos") else f"{value:.2%}"


def document_blocks(scored: DataFrame, counters: Sequence[str], measures: Sequence[str], width: int = 100) -> DataFrame:
    """(id, texto): the lines of each document, made where its row is."""
    line = [F.format_string("  %-58s%12d", F.lit(k), F.col(k)) for k in counters]
    line += [F.format_string("  %-58s%11.2f%%", F.lit(k), F.col(k) * (1 if k.startswith("taxa_documentos") else 100)) for k in measures]
    head = F.concat(F.lit("DOCUMENTO "), F.col("id"), F.when(F.col(metrics.PASS), F.lit("  [validação completa]")).otherwise(F.lit("")))
    return scored.select("id", F.concat_ws("\n", F.lit("-" * width), head, *line).alias("texto"))


def report_head(title: str, config: dict, totals: dict, measures: dict, means: dict, width: int = 100) -> list[str]:
    """The fixed-width lines before the documents: configuration, means over documents, counters and measures by family."""

    def titled(text: str) -> list[str]:
        return ["", "=" * width, text.center(width), "=" * width]

    lines = ["=" * width, title.center(width), "=" * width, "", "CONFIGURAÇÃO", "-" * 50, *[f"  {k}: {v}" for k, v in config.items()]]
    lines += [*titled("TODAS AS EMPRESAS E TODOS OS SÓCIOS, MÉDIA POR DOCUMENTO"), *[f"  {k:<58}{v:>12,}" if isinstance(v, int) else f"  {k:<58}{v:>12.2%}" for k, v in means.items()]]
    for heading, values, text in (("CONTAGENS", totals, lambda k, v: f"{v:,}"), ("MÉTRICAS", measures, _rate)):
        lines += titled(heading)
        for family, own in _families(values).items():
            lines += ["", family, "-" * 50, *[f"  {k:<58}{text(k, v):>12}" for k, v in own.items()]]
    return lines


def write_report_text(path: str, head: list[str], passed: DataFrame, blocks: DataFrame, width: int = 100) -> None:
    """One text file; passed documents and blocks are fetched partition by partition, in order of the id."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([*head, "", "DOCUMENTOS COM VALIDAÇÃO COMPLETA", "-" * 50]))
        for r in passed.select("id").orderBy("id").toLocalIterator():
            f.write(f"\n  {r.id}")
        f.write("\n\n" + "=" * width + "\n" + "POR DOCUMENTO".center(width) + "\n" + "=" * width)
        for r in blocks.orderBy("id").toLocalIterator():
            f.write("\n" + r.texto)
        f.write("\n" + "=" * width + "\n")


def report_json(config: dict, totals: dict, measures: dict, means: dict, scored: DataFrame, counters: Sequence[str], rates: Sequence[str]) -> tuple[dict, DataFrame]:
    """The global part of a JSON report, and (id, corpo) with one object for each document."""
    head = {"configuracao": config, "metricas_globais": {"contagens": totals, "validacao_completa": means, "metricas": measures}}
    body = F.to_json(F.struct(F.col(metrics.PASS).alias("passou_validacao_completa"), F.struct(*counters).alias("contagens"), F.struct(*rates).alias("metricas")))
    return head, scored.select("id", body.alias("corpo"))


def write_report_json(path: str, head: dict, documents: DataFrame) -> None:
    """One JSON object in one file; documents are fetched partition by partition, in order of the id."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head, ensure_ascii=False, indent=2, default=str)[:-2] + ',\n  "metricas_por_documento": {')
        for n, r in enumerate(documents.orderBy("id").toLocalIterator()):
            f.write(("," if n else "") + f"\n    {json.dumps(r.id, ensure_ascii=False)}: {r.corpo}")
        f.write("\n  }\n}\n")
