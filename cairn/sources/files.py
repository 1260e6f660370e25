"""Source trees: scan, tolerant decode, README, repository catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.chunking import PRUNED_V1, walked


def decode(content: Column, errors: str = "ignore") -> Column:
    """UTF-8 text of bytes; bad bytes are dropped (ignore) or become U+FFFD (replace).  Null stays null."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, "\ufffd", "") if errors == "ignore" else text


def scan(spark: SparkSession, root: str, glob: str | None = None, pruned: tuple[str, ...] = PRUNED_V1, errors: str = "ignore", longest: int = 1 << 28) -> DataFrame:
    """path (relative to root), length, text of all files below root outside hidden and pruned directories; unreadable
    files are skipped; files over ``longest`` bytes come out with null text, their bytes unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = "/" + root.removeprefix("file:").strip("/")
    whole = F.regexp_replace("path", r"^file:/+", "/")
    rows = reader.load(root)
    read = rows.where(F.col("length") <= longest).select("path", "length", decode(F.col("content"), errors).alias("text"))
    over = rows.where(F.col("length") > longest).select("path", "length", F.lit(None).cast("string").alias("text"))
    named = read.unionByName(over).withColumn("path", F.substring(whole, F.lit(len(base) + 2), F.lit(1 << 20)))
    return named.where(walked(F.col("path"), pruned))


def readme(files: DataFrame, chars: int = 2000) -> DataFrame:
    """One row: the first of README.md, README.rst, README at the root, cut to ``chars``; null if there is none."""
    names = F.array(*[F.lit(n) for n in ("README.md", "README.rst", "README")])
    return files.where(F.array_contains(names, F.col("path"))).agg(F.min_by(F.left("text", F.lit(chars)), F.array_position(names, F.col("path"))).alias("readme"))


def catalogue(repos: DataFrame, directories: DataFrame) -> DataFrame:
    """repo, directory: a repository (owner/name) is cached as owner__name, else as its bare name; null if neither."""
    full = directories.select(F.col("directory").alias("full"))
    bare = directories.select(F.col("directory").alias("bare"))
    keyed = repos.withColumn("f", F.replace("repo", F.lit("/"), F.lit("__"))).withColumn("b", F.element_at(F.split("repo", "/"), -1))
    return keyed.join(full, F.col("f") == F.col("full"), "left").join(bare, F.col("b") == F.col("bare"), "left").select("repo", F.coalesce("full", "bare").alias("directory"))
