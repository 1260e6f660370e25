"""Chunk tables: routing, statistics, first-wins de-duplication, roll-ups, plans, ids.

Defined results: null contents count 0 characters and never collide with each other's dedup key ('' is a key);
repeated rows are kept unless the operator drops copies; ties go to the smaller ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collection(level: Column) -> Column:
    return F.when(level <= 2, "summary").when(level == 3, "chunks").otherwise("details")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """kind (total, level, language), key, chunks, chars, est_tokens; rows without language are in no language."""
    t = chunks.select("level", F.nullif("language", F.lit("")).alias("language"), F.coalesce(F.length("content"), F.lit(0)).alias("n"))
    sums = t.groupingSets([[], ["level"], ["language"]], "level", "language").agg(F.grouping_id().alias("g"), F.count("*").alias("chunks"), F.sum("n").alias("chars"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "level").otherwise("language")
    out = sums.select(kind.alias("kind"), F.coalesce(F.col("level").cast("string"), "language").alias("key"), "chunks", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    return out.where("kind = 'total' or key is not null").withColumn("est_tokens", F.expr("chars div 4"))


def first_by_prefix(chunks: DataFrame, content: str, order: str, chars: int = 200) -> DataFrame:
    """The first row, by ``order``, of every content prefix.  The winner is found by a partial aggregate over hashed
    prefixes, so copies are combined before the shuffle."""
    key = F.md5(F.left(F.coalesce(F.col(content), F.lit("")), F.lit(chars)))
    winners = chunks.groupBy(key.alias("k")).agg(F.min(order).alias(order))
    return chunks.withColumn("k", key).join(winners, ["k", order], "left_semi").drop("k")


def short_hash(content: Column) -> Column:
    return F.left(F.md5(content), F.lit(12))


def unseen(new: DataFrame, stored: DataFrame, hash_col: str = "hash") -> DataFrame:
    """Rows whose content hash isn't stored; stored hashes compare in lower case.  Copies within ``new`` stay."""
    known = stored.select(F.lower(hash_col).alias("h")).where("h is not null").distinct()
    return new.withColumn("h", short_hash(F.col("content"))).join(known, "h", "left_anti").withColumnRenamed("h", "content_hash")


def file_rollup(details: DataFrame, order: str, names: int = 20) -> DataFrame:
    """One row a file: repo, file_path, language (of its first row), summary (path and the first declarations).

    Each file keeps only its first rows before they are gathered, so a file of any size is a bounded group."""
    w = Window.partitionBy("repo", "file_path").orderBy(order)
    head = details.where("repo is not null and file_path is not null").select("repo", "file_path", "language", "type", "name", order).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= names)
    line = F.concat(F.lit("  "), F.coalesce("type", F.lit("")), F.lit(": "), F.coalesce("name", F.lit("")))
    g = head.groupBy("repo", "file_path").agg(F.min_by("language", "rn").alias("language"), F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("rows"))
    return g.select("repo", "file_path", "language", F.concat(F.lit("# "), "file_path", F.lit("\n"), F.array_join("rows.line", "\n")).alias("summary"))


def repo_rollup(details: DataFrame) -> DataFrame:
    """One row a repository: repo, languages (sorted, joined), files, chunks, summary."""
    g = details.where("repo is not null").groupBy("repo").agg(F.array_sort(F.collect_set("language")).alias("l"), F.count_distinct("file_path").alias("files"), F.count("*").alias("chunks"))
    languages = F.array_join("l", ", ")
    return g.select("repo", languages.alias("languages"), "files", "chunks", F.concat(F.lit("Repository: "), "repo", F.lit("\nLanguages: "), languages, F.lit("\nFiles: "), F.col("files").cast("string"), F.lit("\nChunks: "), F.col("chunks").cast("string")).alias("summary"))


def languages(chunks: DataFrame) -> DataFrame:
    return chunks.where("language is not null and language <> ''").select("language").distinct().orderBy("language")


def repo_counts(chunks: DataFrame) -> DataFrame:
    """repo, files (file chunks), chunks, most first; rows without repository count as unknown."""
    return chunks.groupBy(F.coalesce(F.nullif("repo", F.lit("")), F.lit("unknown")).alias("repo")).agg(F.count_if(F.col("level") == 3).alias("files"), F.count("*").alias("chunks")).orderBy(F.desc("files"), "repo")


def expansion_plan(wanted: DataFrame, indexed: DataFrame) -> DataFrame:
    """language, new_repos, existing_repos of the wanted (repo, language) rows."""
    have = indexed.select("repo").where("repo is not null").distinct().withColumn("have", F.lit(True))
    return wanted.join(have, "repo", "left").groupBy("language").agg(F.count_if(F.col("have").isNull()).alias("new_repos"), F.count_if(F.col("have").isNotNull()).alias("existing_repos"))


def chunk_uid(ordinal: Column, repo: Column, path: Column, name: Column, content: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    raw = F.concat(F.lit("v2_"), ordinal.cast("string"), F.lit("_"), blank(repo), F.lit("|"), blank(path), F.lit("|"), blank(name), F.lit("|"), F.left(F.md5(blank(content)), F.lit(6)))
    return F.left(F.translate(raw, ":|", "__"), F.lit(200))


def file_uid(repo: Column, path: Column) -> Column:
    key = F.concat(repo, F.lit("|"), path)
    return F.left(F.translate(F.concat(F.lit("file_"), repo, F.lit("_"), F.translate(path, "/", "_"), F.lit("_"), F.left(F.md5(key), F.lit(8))), ":|", "__"), F.lit(150))


def repo_uid(repo: Column) -> Column:
    return F.concat(F.lit("repo_v2_"), F.left(F.md5(repo), F.lit(12)))


def expansion(new: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """What an incremental run adds to the store: collection, level, type, uid, repo, language, file_path, name, text.

    Rows whose content hash is stored are left out; of the rest, every chunk is a row of the details, every file one of
    the chunks (its first declarations), every repository one of the summary."""
    fresh = unseen(new, stored).where("repo is not null and file_path is not null")
    cols = lambda level, kind, uid, path, name, text: [F.lit(level).alias("level"), kind.alias("type"), uid.alias("uid"), F.col("repo"), (F.col("language") if level > 1 else F.lit(None).cast("string")).alias("language"), path.alias("file_path"), name.alias("name"), text.alias("text")]
    null = F.lit(None).cast("string")
    chunks = ordinals(fresh, order).select(*cols(4, F.col("type"), chunk_uid(F.col("ordinal"), F.col("repo"), F.col("file_path"), F.col("name"), F.col("content")), F.col("file_path"), F.col("name"), F.col("content")))
    files = file_rollup(fresh, order).select(*cols(3, F.lit("file"), file_uid(F.col("repo"), F.col("file_path")), F.col("file_path"), null, F.col("summary")))
    repos = repo_rollup(fresh).select(*cols(1, F.lit("repo"), repo_uid(F.col("repo")), null, F.col("repo"), F.col("summary")))
    return chunks.unionByName(files).unionByName(repos).withColumn("collection", collection(F.col("level")))


def ordinals(df: DataFrame, *order: str) -> DataFrame:
    """Add ``ordinal`` from 0 in total order, without gathering the table: range partitions, their counts, offsets."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    from cairn.runtime import cut

    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("_l", local).join(counts.select("_p", "_off"), "_p").withColumn("ordinal", F.col("_l") + F.col("_off")).drop("_p", "_l", "_off")
