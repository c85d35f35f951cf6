"""What every operator needs from a session: table access and shared storage. Arrow batches have Spark's own bound in bytes."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Session setting: parts that a table of texts is given if it has fewer files. Not set on a cluster.
LEAST_PARTS = "garimpo.leastParts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with whole texts, as it is stored.

    Only where ``garimpo.leastParts`` is set, as for a benchmark over one small
    file that cannot be split, is it dealt into so many parts.
    """
    df = table(spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    least = int(spark.conf.get(LEAST_PARTS, "0"))
    return df.repartition(least) if least and least > len(df.inputFiles()) else df


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; a local one only where none is set."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if conf:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf)
        return conf
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="garimpo-"))
    return sc.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Sends this package to executors that can't import it; a no-op in local modes."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or getattr(sc, "_garimpo_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(at, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(), "garimpo.zip")
    with open(path, "wb") as f:
        f.write(out.getvalue())
    sc.addPyFile(path)
    sc._garimpo_shipped = True
