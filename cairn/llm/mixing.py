"""Mixing sources to target weights.

Sizes are counted in tokens of a public tokenizer.  Capped water-filling gives each source its share of the total: a
source that would need more than ``max_repeats`` epochs is clamped there and its excess weight goes to the others in
proportion, until all fit.  A source's epochs are then drawn as whole repetitions of every text and a seeded fraction.

The fraction is exact without sorting a source: texts fall by a seeded hash into ``BUCKETS`` buckets, the buckets'
token sums (a small table) tell up to which bucket texts are taken whole, and the one bucket at the border is cut into
buckets again (``LEVELS``); only the last border bucket, one text in 16 million of its source, is ordered.  So a source
of a third of all texts is never in one task.  Texts stay where they are; ids, hashes and
sizes are shuffled.

Defined results: equal texts are one text, which belongs to the source of its least doc_id among the copies whose source
takes part, else among all (so no text is used more than its cap); null and empty texts, sources without target, with a null, zero or negative share, or with a cap under
1 take no part; shares are scaled to add up to 1 over the sources that take part; the total is ``total_tokens``, by
default the tokens of all taking part; if all sources are clamped the mix is smaller.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import cut, distinct_names

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before byte-pair encoding (the public pattern of this vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BITS, LEVELS = 12, 2
BUCKETS = 1 << BITS
SEED = 11


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("counting", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64())], ["doc_id", "source", "text_hash", "tokens"])

    return run


def _wanted(targets: DataFrame) -> DataFrame:
    """One row per source of the targets: source, target_share, max_repeats."""
    return distinct_names(targets, ["source", "target_share", "max_repeats"]).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def texts(docs: DataFrame, tokenizer: str = TOKENIZER, targets: DataFrame | None = None) -> DataFrame:
    """One row per distinct text: doc_id, source, tokens; of copies, those of sources that take part come first."""
    rows = distinct_names(docs, ["doc_id", "source", "text"]).where("doc_id is not null and text is not null and text <> ''").select("doc_id", "source", F.xxhash64("text", F.length("text")).alias("text_hash"), "text")
    sized = rows.mapInArrow(_count(tokenizer), "doc_id long, source string, text_hash long, tokens long")
    out = F.lit(False)
    if targets is not None:
        part = _wanted(targets).where("target_share > 0 and not isnan(target_share) and max_repeats >= 1").select("source", F.lit(True).alias("part"))
        sized, out = sized.join(part, "source", "left"), F.col("part").isNull()
    least = F.min(F.struct(out.alias("out"), "doc_id", "source")).alias("least")
    return sized.groupBy("text_hash", "tokens").agg(least).select("least.doc_id", "least.source", "tokens")


def water_fill(rows: list[tuple[str, float, int, int]], total: float | None = None) -> dict[str, float]:
    """Tokens for each (source, share, cap in repeats, tokens)."""
    total = float(sum(r[3] for r in rows) if total is None else total)
    open_, given = {r[0]: r for r in rows}, {}
    left = total
    while open_:
        weight = sum(r[1] for r in open_.values())
        over = [s for s, r in open_.items() if left * r[1] / weight > r[2] * r[3]]
        if not over:
            return given | {s: left * r[1] / weight for s, r in open_.items()}
        for s in over:
            given[s] = float(open_[s][2] * open_[s][3])
        left = total - sum(given.values())
        for s in over:
            del open_[s]
    return given


def plan(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per source of either side: source, target_share (scaled; null if it takes no part), tokens,
    max_repeats, epochs (null if it takes no part)."""
    spark = sized.sparkSession
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
    want = _wanted(targets)
    both = have.join(want, "source", "full").toPandas()  # one row per source
    use = [(s, float(w), int(m), int(n)) for s, w, m, n in zip(both["source"], both["target_share"], both["max_repeats"], both["tokens"]) if s is not None and w == w and w is not None and w > 0 and m == m and m is not None and m >= 1 and n == n and n and n > 0]
    given = water_fill(use, total_tokens)
    weight = sum(u[1] for u in use)
    out = [(None if s != s else s, use_w / weight if (use_w := {u[0]: u[1] for u in use}.get(s)) else None, int(n) if n == n else 0, int(m) if m == m else None, given[s] / n if s in given else None) for s, n, m in zip(both["source"], both["tokens"], both["max_repeats"])]
    return spark.createDataFrame(out, "source string, target_share double, tokens long, max_repeats int, epochs double")


def _bucketed(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(settled, edge) of rows with ``rest`` tokens to draw a source: those of buckets that are taken whole or not at all,
    with ``extra``; and those of the one bucket a source at the border, with what is left for them."""
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("mark", level * BITS), F.lit(BUCKETS)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sums.withColumn("before", before), ["source", "bucket"])
    whole = F.col("before") + F.col("size") <= F.col("rest")
    edge = ~whole & (F.col("before") < F.col("rest"))
    left = placed.where(edge).select("doc_id", "source", "tokens", "whole", "mark", (F.col("rest") - F.col("before")).alias("rest"))
    return placed.where(~edge).select("doc_id", "source", "tokens", "whole", F.when(whole, 1).otherwise(0).alias("extra")), left


def draw(sized: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, copies (1 or more) of the texts drawn."""
    p = planned.where("epochs is not null").select("source", F.floor("epochs").alias("whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("rest"))
    rows = sized.join(p, "source").select("doc_id", "source", "tokens", "whole", F.xxhash64(F.lit(seed), "doc_id").alias("mark"), "rest")
    settled = None
    for level in range(LEVELS):
        done, rows = _bucketed(rows, level)
        settled = done if settled is None else settled.unionByName(done)
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("mark", "doc_id"))
    last = rows.withColumn("extra", F.when(upto - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)).select(*settled.columns)
    return settled.unionByName(last).select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).where("copies > 0")


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, copies."""
    sized = cut(texts(docs, tokenizer, targets), "sized")
    return draw(sized, plan(sized, targets, total_tokens), seed)


def report(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per source of either side: source, target_share, tokens, max_repeats, epochs, drawn_tokens,
    actual_share, most_copies."""
    sized = cut(texts(docs, tokenizer, targets), "sized")
    planned = plan(sized, targets, total_tokens)
    drawn = draw(sized, planned, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    total = F.sum("drawn_tokens").over(Window.partitionBy())
    return planned.join(drawn, "source", "left").select(
        "source", "target_share", "tokens", "max_repeats", "epochs", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce(F.col("drawn_tokens") / total, F.lit(0.0)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
