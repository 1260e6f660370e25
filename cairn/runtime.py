"""Session helpers: table access, lineage cuts in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's.  Only where the master is this machine
    alone may both be unset; a new temporary folder is taken then."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        at = sc.getCheckpointDir()
        if not at:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
            at = sc.getCheckpointDir()
    return at.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The file system of a path, and the path, in the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


#: Open scopes of intermediate folders, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate folders made inside are deleted at its end; results must have been written by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for at in made:
            fs, p = _path(spark, at)
            fs.delete(p, True)


def forget_on_exit(spark: SparkSession, path: str) -> None:
    """Have an existing intermediate folder deleted at the end of the scope (see ``scratch``), or of the driver's JVM."""
    if _SCOPES:
        _SCOPES[-1].append(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later stages never recompute what came before
    and survive the loss of executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cairn-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    forget_on_exit(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def distinct_names(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the columns an operator reads, so extra or clashing columns of the input never reach its joins."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
