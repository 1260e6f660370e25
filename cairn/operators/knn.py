"""Vector search: exact top-k of many queries over a whole corpus, filters, level fallback, scope, and an index.

Queries are a stated set, broadcast in blocks of at most ``QUERY_BLOCK`` rows; the corpus is scanned once a block and
never shuffled.  Each partition keeps k rows a query, so what is shuffled is k x partitions x queries rows.  Where the
queries grow with the corpus, the index takes the place of the scan: its cells grow with the square root of the rows,
and its probes are set by the recall measured when it is fitted.  Ties go to the smaller id.

Defined results: null, empty, zero or other-length vectors match nothing; repeated ids are separate rows of the corpus;
an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import cut

QUERY_BLOCK = 4096
_HITS = "query_id long, id long, similarity double"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, unit: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors, of unit length if asked) of usable rows."""
    lists = column.to_pylist() if column.null_count else None
    if lists is None and len(column) and len(set(np.diff(column.offsets.to_numpy()))) == 1 and not column.flatten().null_count:
        rows, m = np.arange(len(column)), column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
        if m.shape[1] != dim:
            return np.zeros(0, int), np.zeros((0, dim))
    else:
        lists = column.to_pylist() if lists is None else lists
        rows = np.array([k for k, v in enumerate(lists) if v and len(v) == dim and None not in v], int)
        m = np.array([lists[k] for k in rows], np.float64).reshape(len(rows), dim)
    size = np.sqrt((m * m).sum(1))
    good = size > 0
    return rows[good], m[good] / size[good, None] if unit else m[good]


def _search(shared, k: int, groups: bool, unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        names = ["query_id", "id", "similarity"] + (["grp"] if groups else [])
        best: dict = {}
        for b in batches:
            rows, m = _matrix(b.column(1), q.shape[1], unit)
            if not len(rows):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
            labels = np.array(b.column(2).to_pylist(), object)[rows] if groups else np.zeros(len(rows), int)
            for g in set(labels.tolist()):
                pick = labels == g if groups else slice(None)
                gid, sims = ids[pick], q @ m[pick].T
                if g in best:
                    sims = np.concatenate([best[g][1], sims], axis=1)
                    cand = np.concatenate([best[g][0], np.broadcast_to(gid, (len(q), len(gid)))], axis=1)
                else:
                    cand = np.broadcast_to(gid, (len(q), len(gid)))
                order = np.lexsort((cand, -sims), axis=1)[:, :k]
                best[g] = (np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1))
        for g, (cand, sims) in best.items():
            n = cand.shape[1]
            cols = [pa.array(np.repeat(qids, n)), pa.array(cand.reshape(-1)), pa.array(sims.reshape(-1))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array([g] * (n * len(qids)), pa.string())] if groups else []), names)

    return run


def query_blocks(queries: DataFrame, query_id: str, vector: str, unit: bool = True, label: str | None = None) -> Iterator[tuple]:
    """The stated query set in blocks of at most QUERY_BLOCK rows: ids, vectors (of unit length if asked), labels."""
    q = queries.select(F.col(query_id).cast("long").alias("i"), F.col(vector).alias("v"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("l")).where("i is not null and v is not null")
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        got = q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").collect()
        dims = {len(r.v) for r in got if r.v}
        for dim in sorted(dims):
            rows = [r for r in got if len(r.v) == dim and None not in r.v]
            m = np.array([r.v for r in rows], np.float64)
            size = np.sqrt((m * m).sum(1))
            if (size > 0).any():
                yield np.array([r.i for r in rows], np.int64)[size > 0], m[size > 0] / (size[size > 0, None] if unit else 1.0), np.array([r.l for r in rows], object)[size > 0]


def _ranked(hits: DataFrame, k: int, by: list[str]) -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
    return ranked.withColumn("distance", 1.0 - F.col("similarity"))


def knn(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_id: str | None = None, query_vector: str | None = None, group: str | None = None, metric: str = "cosine") -> DataFrame:
    """query_id, id, similarity, distance, rank (from 1) [, grp]: the k nearest of each query [and group], by cosine or,
    with metric ``dot``, by the product of the vectors as they are."""
    spark, unit = corpus.sparkSession, metric == "cosine"
    if metric not in ("cosine", "dot"):
        raise ValueError(f"metric {metric!r}: cosine or dot")
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), *([F.col(group).cast("string").alias("grp")] if group else [])).where("id is not null and v is not null")
    out = None
    for qids, q, _ in query_blocks(queries, query_id or id_col, query_vector or vector, unit):
        hits = rows.mapInArrow(_search(spark.sparkContext.broadcast((qids, q)), k, bool(group), unit), _HITS + (", grp string" if group else ""))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], _HITS + (", grp string" if group else ""))
    return _ranked(out, k, ["query_id", "grp"] if group else ["query_id"])


def _search_labels(shared, k: int):
    """As ``_search``, where a row (id, v, label) is only compared with the queries that ask for its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, asking = shared.value
        best_sim, best_id = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            rows, m = _matrix(b.column(1), q.shape[1])
            if not len(rows):
                continue
            ids, labels = b.column(0).to_numpy(zero_copy_only=False)[rows], np.array(b.column(2).to_pylist(), object)[rows]
            for label in set(labels.tolist()):
                asks = asking.get(label)
                if asks is None:
                    continue
                pick = labels == label
                sims = np.concatenate([best_sim[asks], q[asks] @ m[pick].T], axis=1)
                cand = np.concatenate([best_id[asks], np.broadcast_to(ids[pick], (len(asks), int(pick.sum())))], axis=1)
                order = np.lexsort((cand, -sims), axis=1)[:, :k]
                best_sim[asks], best_id[asks] = np.take_along_axis(sims, order, 1), np.take_along_axis(cand, order, 1)
        at, place = np.nonzero(np.isfinite(best_sim))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(best_id[at, place]), pa.array(best_sim[at, place])], ["query_id", "id", "similarity"])

    return run


def knn_scoped(corpus: DataFrame, queries: DataFrame, k: int, scope: str, id_col: str = "vec_id", vector: str = "embedding", query_id: str | None = None) -> DataFrame:
    """As ``knn``, among the rows whose ``scope`` is the query's own; queries without a scope get no rows."""
    spark = corpus.sparkSession
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.col(scope).cast("string").alias("label")).where("id is not null and v is not null and label is not null")
    out = None
    for qids, q, labels in query_blocks(queries.where(F.col(scope).isNotNull()), query_id or id_col, vector, label=scope):
        asking: dict = {}
        for n, label in enumerate(labels.tolist()):
            asking.setdefault(label, []).append(n)
        hits = rows.mapInArrow(_search_labels(spark.sparkContext.broadcast((qids, q, {x: np.array(v) for x, v in asking.items()})), k), _HITS)
        out = hits if out is None else out.unionByName(hits)
    return _ranked(spark.createDataFrame([], _HITS) if out is None else out, k, ["query_id"])


def search_levels(first: DataFrame, second: DataFrame, queries: DataFrame, k: int, threshold: float, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Hits of the first level, and of the second for those queries only whose farthest hit is beyond the threshold (or
    that have none): they alone are searched there.  Adds level: chunks or details."""
    hits = cut(knn(first, queries, k, id_col, vector), "first-level")
    near = hits.groupBy(F.col("query_id").alias(id_col)).agg(F.max("distance").alias("d")).where(F.col("d") <= threshold).select(id_col)
    more = knn(second, queries.join(near, id_col, "left_anti"), k, id_col, vector)
    return hits.withColumn("level", F.lit("chunks")).unionByName(more.withColumn("level", F.lit("details")))


def with_fallback(hits: DataFrame, details: DataFrame, threshold: float) -> DataFrame:
    """As ``search_levels``, where both searches were made already.  Both sides: query_id, id, similarity, distance, rank."""
    low = hits.groupBy("query_id").agg(F.max("distance").alias("d")).where(F.col("d") > threshold).select("query_id")
    return hits.withColumn("level", F.lit("chunks")).unionByName(details.join(low, "query_id", "left_semi").withColumn("level", F.lit("details")))


def first_scope(hits: DataFrame, scope: str) -> DataFrame:
    """Per query the first non-empty value of ``scope`` by rank."""
    return hits.where(F.col(scope).isNotNull() & (F.col(scope) != "")).groupBy("query_id").agg(F.min_by(scope, "rank").alias(scope))


# ---- index -----------------------------------------------------------------------------------------------------

#: Rows the index is fitted on at most, bounds of its cells, the recall its probes are set for, files a cell is spread over.
SAMPLE, LEAST_CELLS, MOST_CELLS, RECALL, SALTS = 20_000, 16, 8192, 0.95, 8


def _sampled(rows: DataFrame, id_col: str, vector: str, sample: int) -> np.ndarray:
    """Unit vectors of at most ``sample`` rows, those of least hashed id."""
    got = rows.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample).select(vector).collect()
    m = np.array([r[0] for r in got if r[0] and None not in r[0]], np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(1)), 1e-12)[:, None] if len(m) else m


def _probes(m: np.ndarray, c: np.ndarray, k: int, target: float) -> int:
    asked = m[:: max(1, len(m) // 200)][:200]
    near = np.argsort(-(asked @ m.T), axis=1)[:, : k + 1]  # each row finds itself too
    order = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)  # rank of every cell for every asking row
    rank = np.take_along_axis(order, (m @ c.T).argmax(1)[near], 1)
    held = [(rank < p).mean() for p in range(1, len(c) + 1)]
    return next((p for p, share in enumerate(held, 1) if share >= target), len(c))


def fit_centres(corpus: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on at most ``sample`` rows, those of least hashed id; by default the square root of the number
    of rows as cells, within bounds."""
    return fit_index(corpus, id_col, vector, cells, sample, rounds)[0]


def fit_index(corpus: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, rounds: int = 12, k: int = 10, target: float = RECALL) -> tuple[np.ndarray, int]:
    """(centres, probes).  Probes are the fewest cells that hold the share ``target`` of the k nearest rows of 200 rows of
    the sample, by brute force over the sample."""
    whole = corpus.where(F.col(vector).isNotNull())
    cells = cells or int(min(MOST_CELLS, max(LEAST_CELLS, whole.count() ** 0.5)))
    m = _sampled(whole, id_col, vector, sample)
    if not len(m):
        return np.zeros((0, 0)), 1
    c = m[:: max(1, len(m) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (m @ c.T).argmax(1)
        for n in range(len(c)):
            if (own == n).any():
                v = m[own == n].sum(0)
                c[n] = v / max(np.linalg.norm(v), 1e-12)
    return c, _probes(m, c, k, target)


def build_index(corpus: DataFrame, centres: np.ndarray, path: str, id_col: str = "vec_id", vector: str = "embedding") -> None:
    """Write every row under its nearest centre's cell; a cell is spread over SALTS files, so a hot one stays split."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            rows, m = _matrix(b.column(1), c.shape[1])
            cell = np.full(b.num_rows, -1, np.int32)
            if len(rows):
                cell[rows] = (m @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["id", "v", "cell"])

    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    rows.mapInArrow(run, "id long, v array<float>, cell int").where("cell >= 0").repartition("cell", F.pmod("id", F.lit(SALTS))).write.partitionBy("cell").parquet(path)


def search_index(path: str, centres: np.ndarray, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
    """As ``knn``, over the cells of the ``probes`` nearest centres of each query; only the files of those cells are read,
    and each task keeps k rows a query.  Recall is that of the probed cells (see ``fit_index``, whose probes are found
    again on a sample of the index where none are given)."""
    spark = queries.sparkSession
    index = spark.read.parquet(path)
    if probes is None:
        m = _sampled(index, "id", "v", SAMPLE)
        probes = _probes(m, centres, 2 * k, RECALL) if len(m) else 1
    out = None
    for qids, q, _ in query_blocks(queries, id_col, vector):
        near = np.argsort(-(q @ centres.T), axis=1)[:, :probes]
        asking = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((qids, q, asking))
        hits = index.where(F.col("cell").isin(list(asking))).select("id", "v", "cell").mapInArrow(_search_labels(shared, k), _HITS)
        out = hits if out is None else out.unionByName(hits)
    return _ranked(spark.createDataFrame([], _HITS) if out is None else out, k, ["query_id"])


def recall(exact: DataFrame, found: DataFrame) -> float:
    """Share of the exact hits that were found."""
    e = cut(exact.select("query_id", "id"), "exact")
    n = e.count()
    return e.join(found.select("query_id", "id"), ["query_id", "id"]).count() / n if n else 1.0
