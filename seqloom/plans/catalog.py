"""Tables, sequences and panels by name, for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.operators.canonical import canonical
from seqloom.plans import analytics


def panels() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every panel by name: a function of a canonical sequence."""
    return {name: panel for name, (panel, _, _) in analytics.PANELS.items()}


def register_tables(spark: SparkSession, folder: str) -> list[str]:
    """A temporary view of each Parquet table in ``folder``, which any file system of Spark's may hold."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    tables = [n.removesuffix(".parquet") for n in names if n.endswith(".parquet")]
    for name in tables:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return tables


def register_sequence(spark: SparkSession, folder: str, name: str = "sequence", *extra: str) -> DataFrame:
    """The canonical sequence of the stored events as a view, written once for all that reads it."""
    ev = canonical(spark, folder, *extra)
    ev.createOrReplaceTempView(name)
    return ev


def register_panels(ev: DataFrame, *names: str) -> None:
    """A temporary view of each named panel of a sequence."""
    known = panels()
    for name in names:
        known[name](ev).createOrReplaceTempView(name)
