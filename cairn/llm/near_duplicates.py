"""Near-duplicate texts by a distributed prefix-tree join.

Words (runs of letters, digits, underscores) form multisets; the k-th occurrence of a word is a token of its own, so
the share of common words is the Jaccard similarity of token sets.  All tokens have one global order, rare words
first.  Two texts of similarity t share a token among their first ``n - ceil(t n) + 1`` tokens, so every text is
routed to the groups of those tokens.  In each group the tokens that follow (``AHEAD`` of the prefix at most) stand in a
trie that grows in order of length; a text walks the trie, sharing partial overlaps, and leaves a subtree as soon as
the overlap so far plus all that can remain is under the need of the shortest text below.  A group takes its token for
the first that two texts have in common, which it is in one of the groups they meet in; so what stands before it needs
not be sent.  At a leaf the parities of all tokens in a few hundred bits bound the overlap once more.  What is left is
checked exactly on the words.

Tokens in tries and parities are short hashes: a collision can only raise a bound, so no pair is lost by one.

Scale: a route holds a bounded number of bytes, so what is shuffled grows as the number of words does, however long
texts are.  Texts of equal words form a class before routing, so copies cost one route each and a task counts them
once.  Word frequencies are kept in a table of ``BUCKETS`` hash counters over all texts – a fixed size, whatever the
corpus.  A word's group is split into blocks of ``BLOCK`` texts by its counter, and pairs of blocks become groups of
their own, so no task gets an unbounded group.  Only words of a counter of 2 or more are routed.  The texts of
candidates are picked out of the table by a filter of fixed size before they are shuffled.

Defined results: null texts and texts of fewer than ``min_words`` words are in no pair; equal texts are no pair;
texts that differ only between words are; rows of one id with several texts each have their links, repeated rows count
once; an empty table gives no pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cairn.runtime import cut

SIMILARITY = 0.8
MIN_WORDS = 20
BUCKETS, SEGMENT = 1 << 24, 1 << 14
BLOCK = 4000
#: Tokens of the prefix that go with a route, and bits of parities by words (512 above).
AHEAD = 16
PARITY_BITS = ((100, 64), (200, 128), (400, 256))
#: Counters of the filter that picks the texts of candidates.
FILTER = 1 << 24
#: Counters are kept as one byte, in eighths of a power of two.
_STEPS = 8
_WORD = re.compile(r"\w+")
#: Words remembered per Python worker with their hash; emptied when full.
_MEMO = 1 << 18
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def word_counts(text: str) -> Counter:
    """Runs of letters, digits or underscores of any script, with their counts."""
    return Counter(_WORD.findall(text))


class _Hash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _arrays(words: Counter, hashes: _Hash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a text's words."""
    return np.fromiter((hashes[w] for w in words), np.uint64, len(words)), np.fromiter(words.values(), np.uint64, len(words))


def content_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _signature(h: np.ndarray, c: np.ndarray) -> int:
    """Order-free 64-bit hash of a multiset of words, as a signed integer."""
    terms = (h ^ (h >> np.uint64(29)) ^ (c * np.uint64(_MIX))) * (c * np.uint64(2) + np.uint64(1))
    total = ((int(terms.sum(dtype=np.uint64)) ^ len(h)) * 0xBF58476D1CE4E5B9) & _MASK
    return total - (1 << 64) if total >> 63 else total


def _scan(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, df, seen = _Hash(), np.zeros(BUCKETS, np.int32), set()
        for b in batches:
            ids, sigs, ns, texts, bags = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = word_counts(text)
                n = words.total()
                if n >= min_words:
                    h, c = _arrays(words, hashes)
                    sig = _signature(h, c)
                    ids.append(i)
                    sigs.append(sig)
                    ns.append(n)
                    texts.append(content_hash(text))
                    if sig not in seen:
                        bags.append(h)
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(sig)
            if bags:
                at, k = np.unique((np.concatenate(bags) & np.uint64(BUCKETS - 1)).astype(np.int64), return_counts=True)
                df[at] += k.astype(np.int32)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(ns, pa.int32()), pa.array(texts, pa.int64())], ["id", "sig", "n", "content_hash"])
        at = np.flatnonzero(df)
        for k in range(0, len(at), 50_000):
            part = at[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(part), pa.nulls(len(part), pa.int32()), pa.array(df[part].astype(np.int64))], ["id", "sig", "n", "content_hash"])

    return run


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One segment of counters as bytes."""
    out = np.zeros(SEGMENT, np.uint8)
    c = pdf["c"].to_numpy(np.float64)
    out[pdf["bucket"].to_numpy(np.int64) % SEGMENT] = np.minimum(255, np.ceil(np.log2(np.maximum(c, 1)) * _STEPS) + 1)
    return pd.DataFrame({"segment": [int(pdf["bucket"].iloc[0]) // SEGMENT], "counters": [out.tobytes()]})


def frequencies(scan: DataFrame) -> np.ndarray:
    """BUCKETS one-byte counters of texts per word, collected as packed segments: a fixed size for any corpus."""
    sums = scan.where("id is null").groupBy(F.col("sig").alias("bucket")).agg(F.sum("content_hash").alias("c"))
    packed = sums.groupBy(F.floor(F.col("bucket") / SEGMENT).alias("s")).applyInPandas(_pack, "segment long, counters binary")
    table = np.zeros(BUCKETS, np.uint8)
    for segment, counters in packed.toLocalIterator():
        table[segment * SEGMENT : (segment + 1) * SEGMENT] = np.frombuffer(counters, np.uint8)
    return table


def _parities(tokens: np.ndarray, n: int) -> bytes:
    """Whether an odd number of tokens falls on each bit.  Two texts differ in at least as many tokens as bits."""
    size = next((b for upto, b in PARITY_BITS if n <= upto), 512)
    at = ((tokens ^ (tokens >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)) & np.uint64(size - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: int, size_a: int, b: int, size_b: int) -> int:
    """Tokens in which two texts differ at least, by their parities; the longer row of bits is folded."""
    while size_a > size_b:
        size_a //= 2
        a = (a >> size_a) ^ (a & ((1 << size_a) - 1))
    while size_b > size_a:
        size_b //= 2
        b = (b >> size_b) ^ (b & ((1 << size_b) - 1))
    return (a ^ b).bit_count()


def _routes(df_counts, min_words: int, t: float):
    names = ["token", "lo", "hi", "upper", "sig", "n", "rest", "ahead", "parities"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = df_counts.value
        hashes, seen = _Hash(), set()
        rows: list[tuple] = []
        for b in batches:
            for text in b.column(0).to_pylist():
                words = word_counts(text)
                n = words.total()
                if n < min_words:
                    continue
                h, c = _arrays(words, hashes)
                sig = _signature(h, c)
                if (sig, n) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add((sig, n))
                p = n - math.ceil(t * n - 1e-9) + 1
                q = df[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((h, q))
                counts = c[order].astype(np.int64)
                tokens = np.repeat(h[order], counts)
                nth = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
                tokens = tokens + nth.astype(np.uint64) * np.uint64(_MIX)
                heat = np.repeat(q[order], counts)[:p]
                at = np.flatnonzero(heat > 1)  # words of one text only can't be common, they only take places
                if not len(at):
                    continue
                codes = (tokens[at] >> np.uint64(17)).astype(np.uint16)
                parities = _parities(tokens, n)
                for k, (place, d, token) in enumerate(zip(at.tolist(), heat[at].tolist(), tokens[at].astype(np.int64).tolist())):
                    ahead = codes[k + 1 : k + 1 + AHEAD]
                    rest = n - p if k + 1 + AHEAD >= len(at) else n - int(at[k + AHEAD]) - 1
                    m = 1 + int(2 ** (d / _STEPS)) // BLOCK
                    own = (sig & _MASK) % m
                    for other in range(m):
                        rows.append((token, min(own, other), max(own, other), own >= other, sig, n, rest, ahead.tobytes(), parities))
                        if len(rows) >= 20_000:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    return run


class _Trie:
    """Tokens that follow the group's.  A node is [children, texts ended here, deepest text below, least n below, most
    rest below]."""

    def __init__(self, t: float):
        self.root, self.need = [{}, [], 0, 1 << 30, 0], t / (1 + t)

    def add(self, path: tuple[int, ...], sig: int, n: int, upper: bool, rest: int, parities: int, size: int) -> None:
        node = self.root
        for d in range(len(path) + 1):
            node[2], node[3], node[4] = max(node[2], len(path)), min(node[3], n), max(node[4], rest)
            if d < len(path):
                node = node[0].setdefault(path[d], [{}, [], 0, 1 << 30, 0])
        node[1].append((sig, n, upper, rest, parities, size))

    def partners(self, path: tuple[int, ...], n: int, least: float, rest: int, parities: int, size: int) -> list[tuple[int, bool]]:
        """Texts whose overlap with this one can suffice, if the group's token is the first they have in common.
        ``rest`` counts the tokens after those on the path, where more can be common."""
        own, out, need = set(path), [], self.need
        stack = [(self.root, 0, 1)]
        while stack:
            node, depth, common = stack.pop()
            for sig, m, upper, after, bits, width in node[1]:
                wanted = need * (n + m) - 1e-6
                if m >= least and common + max(rest, after) >= wanted and (n + m - least_difference(parities, size, bits, width)) / 2 >= wanted:
                    out.append((sig, upper))
            for token, child in node[0].items():
                c = common + (token in own)
                if c + child[2] - depth - 1 + max(rest, child[4]) >= need * (n + max(child[3], least)) - 1e-6:
                    stack.append((child, depth + 1, c))
        return out


def _join(t: float):
    def group(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        trie, last = _Trie(t), None
        for lo, hi, upper, sig, n, rest, ahead, parities in rows:  # by n, then sig: copies of a class follow each other
            if (sig, n) == last:
                continue
            last = (sig, n)
            path, bits, size = tuple(np.frombuffer(ahead, np.uint16).tolist()), int.from_bytes(parities, "little"), 8 * len(parities)
            for other, above in trie.partners(path, n, t * n - 1e-6, rest, bits, size):
                if (lo == hi or upper != above) and other != sig:
                    yield (min(sig, other), max(sig, other))
            trie.add(path, sig, n, upper, rest, bits, size)

    def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["sig_a", "sig_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for b in batches:
            for token, lo, hi, *row in zip(*[c.to_pylist() for c in b.columns]):
                if (token, lo, hi) != key:
                    if len(rows) > 1:
                        out += group(rows)
                    key, rows = (token, lo, hi), []
                rows.append((lo, hi, *row))
            if len(out) > 20_000:
                yield batch(out)
                out = []
        if len(rows) > 1:
            out += group(rows)
        if out:
            yield batch(out)

    return run


def _bucket(i: np.ndarray) -> np.ndarray:
    x = i.astype(np.int64).view(np.uint64)
    return (((x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(40)).astype(np.int64) % FILTER


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bucket(b.column(0).to_numpy(zero_copy_only=False))))], ["bucket"])


def _bits(pdf: pd.DataFrame) -> pd.DataFrame:
    """One segment of the filter, a bit a bucket."""
    marks = np.zeros(SEGMENT, np.uint8)
    marks[pdf["bucket"].to_numpy(np.int64) % SEGMENT] = 1
    return pd.DataFrame({"segment": [int(pdf["bucket"].iloc[0]) // SEGMENT], "counters": [np.packbits(marks).tobytes()]})


def id_filter(ids: DataFrame) -> np.ndarray:
    """FILTER bits that hold every id of ``ids`` (one long column): a fixed size for any table."""
    packed = ids.mapInArrow(_buckets, "bucket long").distinct().groupBy(F.floor(F.col("bucket") / SEGMENT).alias("s")).applyInPandas(_bits, "segment long, counters binary")
    bits = np.zeros(FILTER // 8, np.uint8)
    for segment, counters in packed.toLocalIterator():
        bits[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(counters, np.uint8)
    return bits


def in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether ids may be among those of the filter; those that are, surely."""
    at = _bucket(ids)
    return (bits[at >> 3] >> (7 - (at & 7))) & 1 == 1


def _picked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            keep = b.filter(pa.array(in_filter(bits, b.column(0).to_numpy(zero_copy_only=False))))
            if keep.num_rows:
                hashes = pa.array([content_hash(x) for x in keep.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([keep.column(0), hashes, keep.column(1)], ["id", "content_hash", "text"])

    return run


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    counted: dict[str, Counter] = {}

    def count(x: str) -> Counter:
        if x not in counted:
            counted[x] = word_counts(x)
        return counted[x]

    def one(x: str, y: str) -> float:
        p, q = count(x), count(y)
        common = sum(min(c, q[w]) for w, c in p.items() if w in q)
        return common / (p.total() + q.total() - common)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def classes(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links).  members: id, sig (class of texts with equal words), n, content_hash.
    links: sig_a, sig_b, similarity between different classes, each checked on the words themselves."""
    spark = df.sparkSession
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    scan = cut(texts.mapInArrow(_scan(min_words), "id long, sig long, n int, content_hash long"), "scan")
    members = scan.where("id is not null")
    shared = spark.sparkContext.broadcast(frequencies(scan))  # BUCKETS bytes
    routes = texts.select("text").mapInArrow(_routes(shared, min_words, t), "token long, lo int, hi int, upper boolean, sig long, n int, rest int, ahead binary, parities binary")
    grouped = routes.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "sig")
    maybe = cut(grouped.mapInArrow(_join(t), "sig_a long, sig_b long").distinct(), "maybe")
    ends = maybe.select(F.col("sig_a").alias("sig")).unionByName(maybe.select(F.col("sig_b").alias("sig"))).distinct()
    chosen = cut(members.join(ends, "sig").groupBy("sig").agg(F.min(F.struct("id", "content_hash")).alias("r")).select("sig", "r.id", "r.content_hash"), "chosen")
    wanted = spark.sparkContext.broadcast(id_filter(chosen.select("id")))  # FILTER bits
    picked = texts.mapInArrow(_picked(wanted), "id long, content_hash long, text string").join(chosen, ["id", "content_hash"]).groupBy("sig").agg(F.min("text").alias("text"))
    links = (
        maybe.join(picked.select(F.col("sig").alias("sig_a"), F.col("text").alias("ta")), "sig_a")
        .join(picked.select(F.col("sig").alias("sig_b"), F.col("text").alias("tb")), "sig_b")
        .select("sig_a", "sig_b", _similarity("ta", "tb").alias("similarity"))
        .where(F.col("similarity") >= t - 1e-12)
    )
    return members, cut(links, "links")


def pairs(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, t: float = SIMILARITY) -> DataFrame:
    """id_a < id_b of rows whose texts differ and whose words agree to the share t or more."""
    members, links = classes(df, id_col, text_col, min_words, t)
    members = members.select("sig", "content_hash", "id").distinct()
    variants = members.select("sig", "content_hash").distinct()
    varied = variants.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
    several = variants.join(varied, "sig")
    within = (
        several.join(several.withColumnRenamed("content_hash", "other"), "sig")
        .where("content_hash < other")
        .join(members.withColumnRenamed("id", "x"), ["sig", "content_hash"])
        .join(members.select("sig", F.col("content_hash").alias("other"), F.col("id").alias("y")), ["sig", "other"])
        .select("x", "y")
    )
    across = (
        links.select("sig_a", "sig_b")
        .join(members.select(F.col("sig").alias("sig_a"), F.col("id").alias("x")), "sig_a")
        .join(members.select(F.col("sig").alias("sig_b"), F.col("id").alias("y")), "sig_b")
        .select("x", "y")
    )
    both = within.unionByName(across).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (least node of its component) of every node that is linked.

    Stars are drawn larger and smaller in turn until nothing changes: in each round a node's neighbours are tied to the
    least of them, by one aggregate and one join, so rounds grow with the logarithm of a component's width."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("v", "m", "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _class_ids(members: DataFrame) -> DataFrame:
    return members.groupBy("sig").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))


def class_links(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, t: float = SIMILARITY) -> DataFrame:
    """class_a < class_b, similarity: pairs of representatives (least ids) of classes of equal words."""
    members, links = classes(df, id_col, text_col, min_words, t)
    ids = _class_ids(members).select("sig", "class_id")
    tied = links.join(ids.select(F.col("sig").alias("sig_a"), F.col("class_id").alias("x")), "sig_a").join(ids.select(F.col("sig").alias("sig_b"), F.col("class_id").alias("y")), "sig_b")
    return tied.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")


def groups(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, t: float = SIMILARITY) -> DataFrame:
    """One row per text of enough words: id, class_id (least id of the texts with the same words), group_id (least id of
    the texts that links lead to), links (number of other classes within t) and copies (rows of the class)."""
    members, links = classes(df, id_col, text_col, min_words, t)
    ids = cut(_class_ids(members), "class-ids")
    ends = links.select(F.col("sig_a").alias("sig")).unionByName(links.select(F.col("sig_b").alias("sig"))).groupBy("sig").agg(F.count("*").alias("links"))
    tied = links.join(ids.select(F.col("sig").alias("sig_a"), F.col("class_id").alias("x")), "sig_a").join(ids.select(F.col("sig").alias("sig_b"), F.col("class_id").alias("y")), "sig_b")
    roots = components(tied, "x", "y").withColumnRenamed("node", "class_id")
    known = ids.join(ends, "sig", "left").join(roots, "class_id", "left")
    return members.select("id", "sig").join(known, "sig").select("id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies")


def found(details: DataFrame) -> DataFrame:
    return pairs(details, "detail_id", "content").select(F.col("id_a").alias("detail_id_a"), F.col("id_b").alias("detail_id_b"))
