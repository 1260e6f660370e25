"""Evaluation passages inside a training corpus.

Every run of ``window`` words of an item gets a SimHash; so does every such window of a text, rolled over the text by
running bit sums.  A multi-index cuts fingerprints into ``radius + 1`` blocks: two fingerprints within the Hamming
radius agree in at least one block, so looking up every block finds them all.  Candidates are then verified exactly:
the weighted share of equal words at equal places must reach ``similarity`` (1: the same ten words in a row).

For a similarity under 1 windows are cut into parts, one more than words may differ; at least one part of two similar
windows is then the same, so its fingerprint finds the pair whatever the radius: none is missed.  A similarity that
would leave parts of fewer than ``LEAST_PART`` words is refused.

The items are a stated query set.  Their index is broadcast in blocks of at most ``ITEM_WINDOWS`` windows, one pass over
the corpus for each block; the corpus itself is neither shuffled nor collected, only hits leave the pass.  Runs that
``common`` or more items share belong to none of them; they are counted over all items before.

Defined results: null texts and prompts, and those of fewer than ``window`` words, match nothing; repeated rows each
come out; a pair comes out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.runtime import cut, distinct_names

WINDOW, COMMON, RADIUS = 10, 3, 3
ITEM_WINDOWS = 250_000
LEAST_PART = 3
_WORD = re.compile(r"[^\W_]+")
_MEMO = 1 << 18


class _Hash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str, memo: dict) -> list[int]:
    return [memo[w] for w in _WORD.findall(text.casefold())]


def fingerprints(words: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of a row of 64-bit word hashes."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    votes = sums[window:] - sums[:-window]
    return np.packbits(votes * 2 > window, axis=1).reshape(-1).view(np.uint64)


class MultiIndex:
    """Fingerprints by blocks: any two within ``radius`` share a block."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:])]
        self.tables = []
        for k in range(len(self.blocks)):
            key = self._key(prints, k)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.tables.append((order, np.searchsorted(key[order], np.arange((1 << min(16, self.blocks[k][1])) + 1)).astype(np.int64)))

    def _key(self, prints: np.ndarray, k: int) -> np.ndarray:
        shift, width = self.blocks[k]
        key = (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        return (key & np.uint64(0xFFFF)).astype(np.int64) if width > 16 else key.astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, entry) of all pairs within the radius, each once per shared block."""
        probes, entries = [], []
        for k, (order, at) in enumerate(self.tables):
            key = self._key(prints, k)
            start, n = at[key], at[key + 1] - at[key]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            probe = np.repeat(hit, n)
            entry = order[np.repeat(start[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            near = np.bitwise_count(prints[probe] ^ self.prints[entry]) <= self.radius
            probes.append(probe[near])
            entries.append(entry[near])
        if not probes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(probes), np.concatenate(entries)


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hash()
        for b in batches:
            ids, runs, words = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = np.array(word_hashes(text, memo), np.uint64)
                for k in range(len(w) - window + 1):
                    piece = w[k : k + window].tobytes()
                    ids.append(i)
                    words.append(piece)
                    runs.append(xxhash.xxh64_intdigest(piece) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.int64()), pa.array(words, pa.binary())], ["item_id", "run", "words"])

    return run


def parts_of(weights: np.ndarray, similarity: float) -> int:
    """One more than words of a window may differ at most: its lightest ones, while the rest keeps the similarity."""
    if not len(weights) or similarity >= 1:
        return 1
    light = np.cumsum(np.sort(weights, axis=1), axis=1)
    return int((light <= (1 - similarity) * light[:, -1:] + 1e-9).sum(1).max()) + 1


def _search(shared, window: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, items, weights = shared.value["index"], shared.value["items"], shared.value["weights"]
        words, parts = shared.value["words"], shared.value["parts"]
        size = window // parts
        total = weights.sum(1)
        memo = _Hash()
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = b.column(1).to_pylist()
            for lo in range(0, len(ids), 256):
                lists = [word_hashes(t, memo) for t in texts[lo : lo + 256]]
                sizes = [len(x) for x in lists]
                flat = np.array([h for x in lists for h in x], np.uint64)
                if len(flat) < window:
                    continue
                owner = np.repeat(np.arange(len(lists)), sizes)
                docs, hits = [], []
                for base in range(0, len(flat) - size + 1, 1 << 16):  # bounded memory, also for one very long text
                    probe, entry = index.within(fingerprints(flat[base : base + (1 << 16) + size - 1], size))
                    at, entry = probe + base - entry % parts * size, entry // parts  # where the whole window starts
                    keep = (at >= 0) & (at + window <= len(flat))
                    at, entry = at[keep], entry[keep]
                    keep = owner[at] == owner[at + window - 1]
                    at, entry = at[keep], entry[keep]
                    if len(at):
                        same = flat[at[:, None] + np.arange(window)] == words[entry]
                        good = (same * weights[entry]).sum(1) >= similarity * total[entry] - 1e-9
                        docs.append(owner[at[good]])
                        hits.append(entry[good])
                if docs:
                    pairs = {(ids[lo + d], i) for d, e in zip(np.concatenate(docs).tolist(), np.concatenate(hits).tolist()) for i in items[e]}
                    if pairs:
                        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["doc_id", "item_id"])

    return run


def own_runs(items: DataFrame, window: int = WINDOW, common: int = COMMON) -> DataFrame:
    """run, words, items (fewer than ``common``) of the runs that belong to items.  A run of very many items is counted
    by partial sums and left out before items are gathered."""
    q = distinct_names(items, ["item_id", "prompt"]).where("item_id is not null and prompt is not null").select(F.col("item_id").cast("long").alias("item_id"), "prompt")
    each = cut(q.mapInArrow(_item_windows(window), "item_id long, run long, words binary").distinct(), "item-runs")
    few = each.groupBy("run", "words").agg(F.count("*").alias("n")).where(F.col("n") < common).select("run", "words")
    return each.join(few, ["run", "words"]).groupBy("run", "words").agg(F.collect_set("item_id").alias("items"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, common: int = COMMON, radius: int = RADIUS, similarity: float = 1.0) -> DataFrame:
    """doc_id, item_id of texts that hold a run of an item's prompt, or one as similar as asked."""
    spark = docs.sparkSession
    kept = cut(own_runs(items, window, common), "runs")
    n = kept.count()
    blocks = max(1, -(-n // ITEM_WINDOWS))
    corpus = distinct_names(docs, [doc_id, text]).where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(blocks):
        part: pd.DataFrame = kept.where(F.pmod("run", F.lit(blocks)) == k).select("words", "items").toPandas()  # at most about ITEM_WINDOWS rows
        words = np.frombuffer(b"".join(part["words"]), np.uint64).reshape(-1, window) if len(part) else np.zeros((0, window), np.uint64)
        known, counts = np.unique(words, return_counts=True)
        weights = 1.0 / np.log1p(counts[np.searchsorted(known, words)]) if len(part) else np.zeros((0, window))
        parts = parts_of(weights, similarity)
        size = window // parts
        if size < LEAST_PART:
            raise ValueError(f"similarity {similarity} of {window} words leaves parts of {size}; take longer windows or a higher similarity")
        prints = np.array([fingerprints(w[p * size : (p + 1) * size], size)[0] for w in words for p in range(parts)], np.uint64)
        shared = spark.sparkContext.broadcast({"index": MultiIndex(prints, radius), "items": [sorted(map(int, x)) for x in part["items"]], "words": words, "weights": weights, "parts": parts})
        found_here = corpus.mapInArrow(_search(shared, window, similarity), "doc_id long, item_id long")
        out = found_here if out is None else out.unionByName(found_here)
    return out.distinct()


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items)
