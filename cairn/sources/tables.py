"""Collections, records, results: readers and writers with explicit schemas.  Writers never collect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema
from cairn.operators.catalog import collection, expansion, unseen
from cairn.runtime import cut


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# collections ------------------------------------------------------------------------------------------------------


def write_collections(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks routed by level into one table partitioned by collection."""
    chunks.withColumn("collection", collection(F.col("level"))).write.mode(mode).partitionBy("collection").parquet(path)


def open_collections(spark: SparkSession, path: str, columns: str = schema.CHUNK) -> DataFrame:
    """The table, or an empty one of the same columns; what can't be read raises and is never deleted."""
    if not exists(spark, path):
        return spark.createDataFrame([], columns + ", collection string")
    return spark.read.parquet(path)


def read_collection(spark: SparkSession, path: str, name: str, language: str | None = None, repo: str | None = None) -> DataFrame:
    """One collection (partition pruning), filtered by language and repo (pushed down to the scan)."""
    df = open_collections(spark, path).where(F.col("collection") == name)
    df = df.where(F.col("language") == language) if language else df
    return df.where(F.col("repo") == repo) if repo else df


def append_expansion(spark: SparkSession, path: str, new: DataFrame, order: str) -> DataFrame:
    """An incremental run: what ``new`` has beyond the stored hashes is added to the store at ``path`` (its hashes beside
    it), and the collections' counts come back."""
    known = path.rstrip("/") + "_hashes"
    stored = spark.read.parquet(known) if exists(spark, known) else spark.createDataFrame([], "hash string")
    added = cut(expansion(new, stored, order), "expansion")
    added.write.mode("append").partitionBy("collection").parquet(path)
    unseen(new, stored).select(F.col("content_hash").alias("hash")).where("hash is not null").distinct().write.mode("append").parquet(known)
    return validate(spark, path)


def fallback_documents(documents: DataFrame, entries: DataFrame, collections: DataFrame, names: tuple[str, ...] = ("chunks", "details")) -> DataFrame:
    """Texts of the named collections, one after the other, read without the index: documents (id, text) whose entry
    (id, collection_id) lies in a collection (id, name) of that name.  Adds collection and place; empty texts are left out."""
    out = None
    for place, name in enumerate(names):
        of_name = entries.join(collections.where(F.col("name") == name).select(F.col("id").alias("collection_id")), "collection_id", "left_semi").select("id")
        part = documents.where("text <> ''").join(of_name, "id", "left_semi").select("id", "text", F.lit(name).alias("collection"), F.lit(place).alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def validate(spark: SparkSession, path: str) -> DataFrame:
    """collection, n of the three collections, 0 for a missing one."""
    names = spark.createDataFrame([(c,) for c in schema.COLLECTIONS], "collection string")
    return names.join(open_collections(spark, path).groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").na.fill(0)


# access records ---------------------------------------------------------------------------------------------------


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and record fields of JSON objects that map ids to records; missing fields take their defaults."""
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))
    whole = objects.select(F.explode(F.from_json("value", schema.ACCESS_MAP)).alias("doc_id", "r"))
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c)
    return whole.select("doc_id", "r.last_access_time", zero("access_count"), zero("correct_count"), zero("total_use_count"), F.coalesce("r.created_time", F.lit(0.0)).alias("created_time"))


def write_records(records: DataFrame, path: str, shards: int = 16) -> None:
    """JSON objects that map ids to records, one object a shard of ids, so none grows with the whole table."""
    fields = F.struct("last_access_time", "access_count", "correct_count", "total_use_count", "created_time")
    g = records.where("doc_id is not null").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("doc_id", fields.alias("r")))).alias("m"))
    g.select(F.to_json("m", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


# lines, tables, snapshots -------------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """JSON lines of a stated schema; lines that aren't JSON give nulls."""
    return spark.read.schema(columns).json(path)


def write_lines(df: DataFrame, path: str, resume: bool = False) -> None:
    df.write.mode("append" if resume else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(columns).csv(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """A columnar dataset saved as parquet."""
    return spark.read.parquet(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("task_id string, prompt string, entry_point string").json(path).orderBy("task_id")


def write_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """One snapshot, as a partition of its run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the greatest run id."""
    df = spark.read.option("recursiveFileLookup", False).parquet(path)
    last = df.select(F.max("run_id")).first()[0]
    return df.where(F.col("run_id") == last)


def completed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def capped(df: DataFrame, n: int) -> DataFrame:
    """A stated cap on a scan, where a sample of rows is what is asked for."""
    return df.limit(n)
