"""Exact top-k search by a Voronoi kNN join.

Vectors are assigned to the nearest of a bounded number of pivots.  Summaries
of the cells (their size, and the smallest distances to the pivot) give every
group of queries a score that k rows are certain to reach; a data row can
only enter a group's result if its distance to its own pivot is large enough
for that score, so just these rows are sent to the group.  Groups are solved
locally by a matrix product over blocks of bounded size, and the blocks' best
are merged.  Cells of any size are dealt over blocks by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, written

K = 20
PIVOTS = 256            # at most; a quarter of the square root of the rows
PIVOT_SAMPLE = 4096     # rows the pivots are fitted on
GROUP_QUERIES = 1024    # queries solved together
BLOCK_ROWS = 20_000     # data rows solved together


def _grid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(64 x) of the vectors that take part."""
    for b in batches:
        keep, out = [], []
        for k, (i, v) in enumerate(zip(b.column(0), b.column(1))):
            if not i.is_valid or not v.is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                keep.append(k), out.append(np.floor(64 * x).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["vec_id", "v"])


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of float64 bytes as a matrix; shorter vectors are filled with 0."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x = np.frombuffer(v.as_buffer())
        out[k, :len(x)] = x
    return out


def _fit(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots: some rows of the sample after three rounds of k-means."""
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[:n]]
    for _ in range(3):
        near = _distance(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[near == j].mean(axis=0) if (near == j).any() else pivots[j] for j in range(len(pivots))])
    return pivots


def _distance(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distance(_matrix(b.column("v"), pivots.shape[1]), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                                             [*b.schema.names, "cell", "d"])
    return run


def _top(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers, exact: in float64 where that cannot round,
    else in Python's integers (then limited to the range of a long)."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if bound < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    exact = whole(q) @ whole(x).T
    return np.clip(exact, -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


def _solve(width: int, k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        q, x = _matrix(queries["v"], width), _matrix(data["v"], width)
        order = np.argsort(data["vec_id"].to_numpy(), kind="stable")      # ties go to the smaller id
        x, ids, rid = x[order], data["vec_id"].to_numpy()[order], data["rid"].to_numpy()[order]
        own, names = queries["rid"].to_numpy(), queries["vec_id"].to_numpy()
        rows = []
        if len(own) and len(ids):
            scores = _top(q, x)
            for i in range(len(own)):
                other = np.nonzero(rid != own[i])[0]
                s = scores[i, other]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    at = np.nonzero(s >= least)[0]
                else:
                    at = np.arange(len(s))
                at = at[np.argsort(-s[at].astype(object) if least_long(s[at]) else -s[at], kind="stable")][:k]
                rows.append((np.full(len(at), own[i]), np.full(len(at), names[i]), ids[other[at]], s[at]))
        parts = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("q_rid", "query_id", "vec_id", "score"), map(pa.array, parts))))
    return run


def least_long(s: np.ndarray) -> bool:
    """Whether negation would overflow."""
    return bool(len(s)) and int(s.min()) == -(2 ** 63)


def _thresholds(pivots, cells, nearest, query_radius, k):
    """For each query cell i and data cell j the least distance to pivot j at
    which a row can still enter a result of cell i (inf: none can)."""
    p = len(pivots)
    dot, norm = pivots @ pivots.T, np.linalg.norm(pivots, axis=1)
    out = np.full((p, p), np.inf)
    for i, rho in query_radius.items():
        # q.x >= p_i.p_j - rho |p_j| - (|p_i| + rho) d for a row at distance d of pivot j
        sure = np.concatenate([dot[i, j] - rho * norm[j] - (norm[i] + rho) * np.array(ds) for j, ds in nearest.items()])
        slack = 1e-9 * (1 + np.abs(dot).max() + (norm.max() + rho) * (1 + max(r for _, r in cells.values())))
        reach = np.sort(sure)[-(k + 1)] - slack if len(sure) > k else -np.inf      # k rows besides the query's own
        need = reach - dot[i] - rho * norm
        steep = norm[i] + rho
        out[i] = np.where(need <= 0, 0.0, need / steep if steep > 0 else np.inf)
    return out


def top_k(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row marked by the
    column ``is_query`` (over vec_id) the k other rows of highest inner
    product of floor(64 x), ties to the smaller vec_id; all, if fewer.

    Rows with a null id, a null vector or a null or non-finite component take
    no part; vectors of different lengths compare on their common components
    (an empty vector scores 0).  Rows that repeat an id are separate rows and
    only the query's own row is left out.  Scores beyond a long are limited to
    it.  An empty table gives no rows; other columns are ignored.
    """
    data = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    data = data.mapInArrow(_grid_rows, "vec_id long, v binary")
    data = written(data.withColumn("rid", F.monotonically_increasing_id()), "knn-rows")
    n, width = data.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    empty = data.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    if not n:
        return empty
    width //= 8
    part = sampled(min(1.0, PIVOT_SAMPLE / n), "rid")
    sample = data.where(part).orderBy(F.xxhash64("rid", F.lit("order")), "rid").limit(2 * PIVOT_SAMPLE).select("v").toArrow()["v"] if n > 1 else data.select("v").toArrow()["v"]
    pivots = _fit(_matrix(sample, width) if len(sample) else np.zeros((1, width)), max(1, min(PIVOTS, int(n ** 0.5) // 4)))

    data = written(data.mapInArrow(_assign(pivots), "vec_id long, v binary, rid long, cell int, d double"), "knn-cells")
    queries = data.where(is_query)
    cells = {r[0]: (r[1], r[2]) for r in data.groupBy("cell").agg(F.count(F.lit(1)), F.max("d")).collect()}
    near = data.select("cell", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d")).alias("r")).where(F.col("r") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for cell, d, _ in near.collect():                              # at most pivots x (k + 1) numbers
        nearest.setdefault(cell, []).append(d)
    asked = {r[0]: (r[1], r[2]) for r in queries.groupBy("cell").agg(F.count(F.lit(1)), F.max("d")).collect()}
    if not asked:
        return empty
    least = _thresholds(pivots, cells, nearest, {c: r for c, (_, r) in asked.items()}, k)

    # classes of query cells, of about GROUP_QUERIES; a larger one is split by a hash
    classes: list[list[int]] = [[]]
    for cell in sorted(asked):
        if classes[-1] and sum(asked[c][0] for c in [*classes[-1], cell]) > GROUP_QUERIES:
            classes.append([])
        classes[-1].append(cell)
    reach = np.array([least[c].min(axis=0) for c in classes])
    chunks = [-(-sum(asked[c][0] for c in cs) // GROUP_QUERIES) for cs in classes]
    sent = [sum(m for j, (m, r) in cells.items() if r >= reach[g, j]) for g in range(len(classes))]
    blocks = [max(1, -(-m // BLOCK_ROWS)) for m in sent]

    spark = rows.sparkSession
    plan = spark.createDataFrame(
        [(g, int(j), float(reach[g, j]), chunks[g], blocks[g]) for g in range(len(classes)) for j, (_, r) in cells.items() if r >= reach[g, j]],
        "g int, cell int, reach double, chunks int, blocks int")                    # at most pivots x pivots rows
    of_query = spark.createDataFrame([(g, c, chunks[g], blocks[g]) for g, cs in enumerate(classes) for c in cs], "g int, cell int, chunks int, blocks int")
    deal = lambda seed, m: F.pmod(F.xxhash64("rid", F.lit(seed)), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    own = [F.col(c).alias(c) for c in ("rid", "vec_id", "v")]      # the two sides come from the same table
    q_side = queries.join(F.broadcast(of_query), "cell").select(
        "g", deal(1, "chunks").alias("c"), each("blocks").alias("b"), *own)
    d_side = data.join(F.broadcast(plan), "cell").where(F.col("d") >= F.col("reach")).select(
        "g", each("chunks").alias("c"), deal(2, "blocks").alias("b"), *own)
    found = q_side.groupBy("g", "c", "b").cogroup(d_side.groupBy("g", "c", "b")).applyInArrow(
        _solve(width, k), "q_rid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
