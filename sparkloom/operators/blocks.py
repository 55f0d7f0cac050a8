"""Exact best-k of many queries against many rows: a grid of blocks, each cell within one task's bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a cell of the grid; a larger repository has more cells, not larger ones. Queries that a product of matrices takes at once.
ROWS, QUERIES, AT_ONCE = 16_384, 4096, 64


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, half away from zero, as Spark rounds."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x)


def best_of(scores: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    """Places of the `limit` best by rounded score (NaN first, as Spark sorts; -inf is no score), then smaller id. ids ascend."""
    r = np.where(np.isnan(scores), np.inf, rounded(scores))
    if len(r) <= limit:
        return np.flatnonzero(r > -np.inf)
    edge = np.partition(r, len(r) - limit)[len(r) - limit]
    above = np.flatnonzero(r > edge)
    return above if edge == -np.inf else np.concatenate([above, np.flatnonzero(r == edge)[: limit - len(above)]])


def dense(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as float64, which of them have `dims` components and no null)."""
    n = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    whole = n == dims
    flat = pa.compute.list_flatten(column.filter(pa.array(whole)))
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dims)
    out = np.zeros((len(n), dims))
    out[whole] = values
    whole[np.flatnonzero(whole)[flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims).any(1)]] = False
    return out, whole


def cosines(limit: int):
    """For a cell (rows: symbol_id, embedding; queries: query_id, vector): each query's best rows of the same length, by cosine."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        left, right = left.sort_by("symbol_id"), right.combine_chunks()
        ids, qids = left["symbol_id"].to_numpy(), right["query_id"].to_numpy()
        rows, vectors = left["embedding"].combine_chunks(), right["vector"].combine_chunks()
        sizes = pa.compute.list_value_length(vectors).drop_null().unique().to_pylist() if len(ids) else []
        with np.errstate(all="ignore"):
            for dims in filter(None, sizes):
                a, ok = dense(rows, dims)
                b, fine = dense(vectors, dims)
                norm, asked = np.sqrt((a * a).sum(1)), np.flatnonzero(fine)
                for at in range(0, len(asked), AT_ONCE):
                    some = asked[at : at + AT_ONCE]
                    size = np.sqrt((b[some] * b[some]).sum(1))[:, None] * norm
                    scores = np.where(ok & (size != 0), b[some] @ a.T / size, -np.inf)
                    for q, s in zip(some, scores, strict=True):
                        p = best_of(s, ids, limit)
                        found.append((np.full(len(p), qids[q]), ids[p], s[p]))
        q, i, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "symbol_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64(), from_pandas=False)})

    return run


def sums(limit: int):
    """For a cell (rows: symbol_id, query_id, both with keys and weights, each key once): each query's best rows by the sum
    over shared keys of the product of both weights; rows that share none are not found."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("symbol_id").combine_chunks(), right.combine_chunks()
        ids, qids = left["symbol_id"].to_numpy(), right["query_id"].to_numpy()
        lists, asked = left["keys"].combine_chunks(), right["keys"].combine_chunks()
        known = pa.compute.unique(pa.compute.list_flatten(asked))
        place = lambda x: pa.compute.fill_null(pa.compute.index_in(pa.compute.list_flatten(x), value_set=known), -1).to_numpy(zero_copy_only=False)
        key, row = place(lists), pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(key >= 0)
        kept = kept[np.argsort(key[kept], kind="stable")]
        row, weight = row[kept], pa.compute.list_flatten(left["weights"].combine_chunks()).to_numpy(zero_copy_only=False)[kept]
        start = np.searchsorted(key[kept], np.arange(len(known) + 1))
        qkey, qrow = place(asked), pa.compute.list_parent_indices(asked).to_numpy(zero_copy_only=False)
        qweight = pa.compute.list_flatten(right["weights"].combine_chunks()).to_numpy(zero_copy_only=False)
        bounds = np.searchsorted(qrow, np.arange(len(qids) + 1))
        found: list[tuple] = []
        for q in range(len(qids)) if len(ids) else ():
            score, hit = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for k, w in zip(qkey[bounds[q] : bounds[q + 1]], qweight[bounds[q] : bounds[q + 1]], strict=True):
                at = slice(start[k], start[k + 1])
                score[row[at]] += w * weight[at]
                hit[row[at]] = True
            p = best_of(np.where(hit, score, -np.inf), ids, limit)
            found.append((np.full(len(p), qids[q]), ids[p], score[p]))
        q, i, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "symbol_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def best_in_cells(queries: DataFrame, rows: DataFrame, cell) -> DataFrame:
    """(query_id, symbol_id, score) of all cells; queries and rows have a repository_id, and only those of one meet.

    A repository is dealt into as many blocks as its numbers of rows and queries need, so a cell is bounded and all
    pairs of a repository are seen; what a cell returns is bounded by its queries.
    """

    def dealt(df: DataFrame, most: int, n: str) -> DataFrame:
        return df.groupBy("repository_id").agg(F.ceil(F.count("*") / F.lit(float(most))).cast("int").alias(n))

    grid = dealt(rows, ROWS, "__r").join(dealt(queries, QUERIES, "__q"), "repository_id")
    share = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(grid, "repository_id").withColumn("__a", share("symbol_id", "__r")).withColumn("__b", each("__q")).drop("__r", "__q")
    right = queries.join(grid, "repository_id").withColumn("__b", share("query_id", "__q")).withColumn("__a", each("__r")).drop("__r", "__q")
    right = right.select(F.col("repository_id").alias("__of"), "__a", "__b", *(c for c in queries.columns if c != "repository_id"))  # else one column stands on both sides
    return left.groupBy("repository_id", "__a", "__b").cogroup(right.groupBy("__of", "__a", "__b")).applyInArrow(cell, "query_id long, symbol_id long, score double")
