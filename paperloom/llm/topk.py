"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; a segment is described by its mean and its
deviation. For two segments of length m the inner product is at most
``m * (mean * mean' + deviation * deviation')``, so the sum over segments bounds
the score from above (and the distance from below). Bounds are computed from
one segment to many; only pairs whose bound reaches the k-th best score so far
go on to the next level, and only survivors get an exact integer score.

Queries are a stated set that meets all rows in blocks: both sides are cut into
blocks of bounded size, a task scores one block of queries against one block of
rows, and per query the k best of each block are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows and queries that meet in one task
BLOCK_ROWS, BLOCK_QUERIES = 16384, 2048
#: rows that are scored between two updates of the thresholds
TILE = 2048
LEVELS = (1, 2, 4, 8, 16)
_EXACT = float(2**53)
_LONG = float(2**62)


def quantised(embedding: Column, scale: int = 1024) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def _summaries(vectors: np.ndarray, levels: tuple[int, ...]) -> list[np.ndarray]:
    """Per level the scaled means and deviations of all segments, side by side."""
    result = []
    for segments in levels:
        columns = []
        for part in np.array_split(vectors, segments, axis=1):
            scale = np.sqrt(part.shape[1])
            mean = part.mean(axis=1)
            columns += [scale * mean, scale * np.sqrt(np.mean((part - mean[:, None]) ** 2, axis=1))]
        result.append(np.stack(columns, axis=1))
    return result


def block_top_k(
    query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query number, row id, score)`` of each query's k best rows of this block."""
    dim = queries.shape[1]
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    order = np.lexsort((row_ids, -np.einsum("ij,ij->i", x, x)))  # long vectors first: thresholds rise early
    x, rows, row_ids = x[order], rows[order], row_ids[order]
    # no partial sum of a pair's products exceeds the product of these two
    q_peak = np.abs(q).max(axis=1, initial=0) * max(dim, 1)
    x_peak = np.abs(x).max(axis=1, initial=0)
    q_norm, x_norm = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    levels = tuple(s for s in LEVELS if s < dim)
    q_levels, x_levels = _summaries(q, levels), _summaries(x, levels)
    best_q, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
    best_score = np.zeros(0, np.int64)
    threshold = np.full(len(q), -np.inf)
    for begin in range(0, len(x), TILE):
        tile = np.arange(begin, min(begin + TILE, len(x)))
        active = row_ids[tile][None, :] != query_ids[:, None]
        for q_stats, x_stats in zip(q_levels, x_levels, strict=True):
            columns = np.flatnonzero(active.any(axis=0))
            if not len(columns) or np.isinf(threshold).all():
                break
            bound = q_stats @ x_stats[tile[columns]].T
            bound += np.outer(q_norm, x_norm[tile[columns]]) * 1e-9 + 0.5  # rounding never hides a tie
            active[:, columns] &= bound >= threshold[:, None]
        pair_q, pair_x = np.nonzero(active)
        if not len(pair_q):
            continue
        columns = tile[pair_x]
        if len(pair_q) * 4 > active.size:
            products = (q @ x[tile].T)[pair_q, pair_x]
        else:
            products = np.empty(len(pair_q))
            for at in range(0, len(pair_q), 1 << 16):
                part = slice(at, at + (1 << 16))
                products[part] = np.einsum("ij,ij->i", q[pair_q[part]], x[columns[part]])
        # float sums of integers are exact below 2**53; larger pairs are summed as integers
        large = np.flatnonzero(q_peak[pair_q] * x_peak[columns] >= _EXACT)
        products[large] = 0
        scores = products.astype(np.int64)
        for at in range(0, len(large), 1 << 16):
            part = large[at : at + (1 << 16)]
            scores[part] = _large_scores(queries, rows, pair_q[part], columns[part], q_peak, x_peak)
        hopeful = scores >= threshold[pair_q]
        best_q = np.concatenate([best_q, pair_q[hopeful]])
        best_id = np.concatenate([best_id, row_ids[columns[hopeful]]])
        best_score = np.concatenate([best_score, scores[hopeful]])
        best_q, best_id, best_score = _first_k(best_q, best_id, best_score, k)
        counts = np.bincount(best_q, minlength=len(q))
        full = np.flatnonzero(counts >= k)
        threshold[full] = best_score[np.cumsum(counts)[full] - 1]
    return best_q, best_id, best_score


def _first_k(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    first = np.searchsorted(queries, queries)
    keep = np.arange(len(queries)) - first < k
    return queries[keep], ids[keep], scores[keep]


def _large_scores(
    queries: np.ndarray, rows: np.ndarray, pair_q: np.ndarray, pair_x: np.ndarray, q_peak: np.ndarray, x_peak: np.ndarray
) -> np.ndarray:
    """Exact scores in 64-bit integers; of pairs that could exceed them in Python integers, held to the range of a long."""
    scores = np.einsum("ij,ij->i", queries[pair_q], rows[pair_x])
    low, high = -(2**63) + 1, 2**63 - 1
    for at in np.flatnonzero(q_peak[pair_q] * x_peak[pair_x] >= _LONG):
        products = zip(queries[pair_q[at]].tolist(), rows[pair_x[at]].tolist(), strict=True)
        scores[at] = max(low, min(high, sum(a * b for a, b in products)))
    return scores


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: int = 1024,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k best other rows of every query row of ``vectors(vec_id, embedding)``.

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller vec_id. A
    row takes part if its id and vector are not null and all components are
    finite; vectors of different length never meet. Rows that share a query's
    vec_id are its own. Rows that repeat an id and a vector are one row; of
    different vectors under one query id the shortest, then the first in component order, asks.
    Scores beyond the range of a long are held to it. An empty table gives an
    empty result; other columns are ignored.
    """
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    rows = vectors.where(F.col("vec_id").isNotNull() & usable).select(
        "vec_id", quantised(F.col("embedding"), scale).alias("v"), F.size("embedding").alias("dim"), is_query.alias("q")
    )
    counted = rows.agg(F.count("*"), F.count_if("q")).first()
    session = vectors.sparkSession
    # block counts follow the sizes; small tables still use all cores
    spread = min(session.sparkContext.defaultParallelism, -(-counted[0] // TILE))
    n_rows = max(1, -(-counted[0] // block_rows), spread)
    n_queries = max(1, -(-counted[1] // block_queries))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # another seed than the shuffle's own hash
    block = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(n)).cast("int")
    asking = rows.where("q").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("first")).select("vec_id", "first.*")
    left = asking.select("dim", block(n_queries).alias("qb"), number(n_rows).alias("rb"), "vec_id", "v")
    right = rows.select("dim", number(n_queries).alias("qb"), block(n_rows).alias("rb"), "vec_id", "v")

    def score(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if q.empty or x.empty:
            return empty
        x = _distinct(x)
        matrix = lambda f: np.stack([np.asarray(v, np.int64) for v in f["v"]])
        ids = q["vec_id"].to_numpy(np.int64)
        of, found, scores = block_top_k(ids, matrix(q), x["vec_id"].to_numpy(np.int64), matrix(x), k)
        return pd.DataFrame({"query_id": ids[of], "vec_id": found, "score": scores})

    key = ["dim", "qb", "rb"]
    partial = (
        left.groupBy(key)
        .cogroup(right.groupBy(key))
        .applyInPandas(score, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _distinct(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows that repeat an id and a vector once."""
    repeated = frame["vec_id"].duplicated(keep=False)
    if not repeated.any():
        return frame
    marks = frame.loc[repeated, "v"].map(lambda v: np.asarray(v, np.int64).tobytes())
    again = pd.DataFrame({"id": frame.loc[repeated, "vec_id"], "v": marks}).duplicated()
    return frame.drop(index=again[again].index)
