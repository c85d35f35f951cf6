"""Sources: document folders, delimited entity tables with loose headers, nested JSON, and configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import normalize as N
from garimpo.sources import delimited

NESTED = "map<string,array<struct<empresa:string,cnpj:string,socios:array<struct<nome:string,cpf:string,rg:string>>>>>"

# Header names of entity tables, in order of preference. Fixed values.
HEADERS = {
    "id": ("arquivo", "id", "document_id"),
    "tipo": ("tipo_entidade", "tipo", "type"),
    "nome": ("nome", "name", "entity_name"),
    "identificador": ("identificador", "cpf", "cnpj"),
    "aux": ("aux", "rg", "auxiliary"),
}


def decode(content: Column) -> Column:
    """UTF-8, or Latin-1 for the whole file where it is not valid; line ends as a single line feed."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def truncate(text: Column | str, most: int | None) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(text, 1, most) if most else text


def _pdf_pages(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF needs the package pypdf on the executors") from e
        import io

        for b in batches:
            texts = []
            for content in b["content"]:
                pages = (p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages[:most])
                texts.append(" ".join(t for t in map(str.strip, pages) if t))
            yield pd.DataFrame({"path": b["path"], "doc_id": b["doc_id"], "text": texts})

    return run


def documents(spark: SparkSession, folder: str, max_chars: int | None = None, max_pages: int | None = None) -> DataFrame:
    """(path, doc_id, text) of the ``.txt`` files of a folder, and of ``.pdf`` files if ``max_pages`` is given.

    The file name is the id. Empty texts are left out; blank ones are kept. Other
    extensions are not read. A missing folder is an error.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,pdf}").load(folder).withColumn("doc_id", F.substring_index("path", "/", -1))
    text = found.filter(F.col("path").endswith(".txt")).select("path", "doc_id", truncate(decode(F.col("content")), max_chars).alias("text"))
    if max_pages:
        pdf = found.filter(F.col("path").endswith(".pdf")).select("path", "doc_id", "content")
        text = text.unionByName(pdf.mapInPandas(_pdf_pages(max_pages), "path string, doc_id string, text string"))
    return text.filter(F.length("text") > 0)


def delimiter(header: str) -> str:
    """The separator of a header line: the most frequent of comma, semicolon and tab."""
    return max(",;\t", key=header.count)


def entities_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat entities (id, ord, tipo, nome, identificador, aux) of a delimited file or folder of files.

    The separator is seen from the header, whose names may vary. Rows that are
    too short are dropped, as are rows without id, or without both name and
    identifier. ``ord`` is where the row begins in its file. A file is read in
    splits, whatever its quoted fields hold.
    """
    head = spark.read.text(path).filter(F.length("value") > 0).limit(1).collect()
    if not head:
        return spark.createDataFrame([], "id string, ord bigint, tipo string, nome string, identificador string, aux string")
    line = head[0][0].lstrip("\ufeff")
    sep = delimiter(line)
    names = [n.strip().strip('"').lower() for n in line.split(sep)]
    df = delimited.loose_rows(spark, path, sep)
    # every file begins with the header
    df = df.filter(F.lower(F.regexp_replace(F.array_join("campos", "\0"), r'^\x{feff}|["\s]', "")) != F.lit("\0".join("".join(n.split()) for n in names)))
    at = {k: next((names.index(n) for n in options if n in names), None) for k, options in HEADERS.items()}
    df = df.filter(F.size("campos") > max((n for n in at.values() if n is not None), default=-1))
    got = df.select(F.col("posicao").alias("ord"), *[(F.lit("") if n is None else N.strip(F.col("campos")[n])).alias(k) for k, n in at.items()])
    got = got.withColumn("id", N.normalize_doc_id("id"))
    return got.filter((F.col("id") != "") & ((F.col("nome") != "") | (F.col("identificador") != ""))).select("id", "ord", "tipo", "nome", "identificador", "aux")


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, empresas) of nested result or gold files: each file one object of lists by document."""
    return _nested(spark.read.text(path, wholetext=True))


def nested_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same with one object for each line, as the distributed sink writes it."""
    return _nested(spark.read.text(path))


def _nested(objects: DataFrame) -> DataFrame:
    return objects.select(F.explode(F.from_json("value", NESTED)).alias("id", "empresas")).withColumn(
        "empresas",
        F.transform(
            "empresas",
            lambda e: F.struct(
                e.empresa.alias("empresa"),
                e.cnpj.alias("cnpj"),
                F.coalesce(e.socios, F.expr("cast(array() as array<struct<nome:string,cpf:string,rg:string>>)")).alias("socios"),
            ),
        ),
    )


def embedded_config(text: str) -> dict:
    """Extraction parameters stored with a result, the inner ones over the outer ones; {} for anything else."""
    try:
        data = json.loads(text)
        outer, inner = data.get("parametros_extracao") or {}, (data.get("configuracao") or {}).get("parametros_extracao") or {}
        return {**outer, **inner}
    except (ValueError, AttributeError, TypeError):
        return {}


@dataclass(frozen=True)
class Config:
    """Parameters of the pipelines; a JSON object in ``CONFIG_JSON`` goes over the defaults."""

    chunk_size: int = 150
    chunk_overlap: int = 50
    separators: tuple[str, ...] = (";",)
    k_independent: int = 30
    k_chained: int = 5
    max_txt_chars: int | None = None
    max_context_chars: int = 30_000
    parse_max_retries: int = 3
    temperature: float = 0.1
    aux_terms: str = "não"
    negative_prompt: str = "não"
    prompt_enhancement: str = "não"

    @classmethod
    def load(cls, env: dict[str, str] | None = None, model: str = "") -> Config:
        env = dict(os.environ) if env is None else env
        given = {k.lower(): v for k, v in json.loads(env.get("CONFIG_JSON") or "{}").items()}
        if "PARSE_MAX_RETRIES" in env:
            given["parse_max_retries"] = int(env["PARSE_MAX_RETRIES"])
        known = {f.name for f in fields(cls)}
        base = cls(parse_max_retries=5) if "gemma" in model.lower() else cls()
        return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
