"""Exact top-k inner products by Fagin's threshold algorithm, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries: what one task holds.
CANDIDATES, QUERIES = 16_384, 4096
#: Up to this size sums of products of whole numbers are exact in doubles.
EXACT = 2.0**52


class ThresholdLists:
    """Per-dimension lists of a block's vectors, sorted by value, for the threshold algorithm."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.n, self.dims = self.vectors.shape
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy() if self.n else np.zeros((self.dims, 0), int)
        self.values = np.take_along_axis(self.vectors, self.lists.T, 0).T.copy()

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best but `own`, by score and then smaller id.

        The lists (from the end where the query's component is positive, else from the start) are read in step, ever
        deeper; each new candidate is scored in full. With the k-th best score above the sum of query component times
        value at the depth reached, no unread candidate can come in; a tie can, so an equal bound reads on.
        """
        used = np.flatnonzero(query)
        seen = np.zeros(self.n, bool)
        best_s, best_i = np.zeros(0), np.zeros(0, int)
        depth, step = 0, max(8, min(64, 2 * k))
        if not len(used):  # every score is 0: the smallest ids win
            first = np.flatnonzero(self.ids != own)[:k]
            return self.ids[first], np.zeros(len(first))
        lists, values, up = self.lists[used], self.values[used], query[used] > 0
        while depth < self.n:
            to = min(self.n, depth + step)
            rows = np.concatenate([lists[up, self.n - to : self.n - depth].ravel(), lists[~up, depth:to].ravel()])
            new = np.zeros(self.n, bool)
            new[rows] = True
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            at = at[self.ids[at] != own]
            best_i = np.concatenate([best_i, at])
            best_s = np.concatenate([best_s, self.vectors[at] @ query])
            if len(best_i) > k:
                keep = np.lexsort((best_i, -best_s))[:k]
                best_i, best_s = best_i[keep], best_s[keep]
            depth, step = to, step * 2
            edge = np.where(up, values[:, self.n - to], values[:, to - 1])
            if len(best_s) == k and best_s.min() > float(edge @ query[used]):
                break
        order = np.lexsort((best_i, -best_s))
        return self.ids[best_i[order]], best_s[order]


def _cell(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            dims = max(map(len, left["v"]))
            fill = lambda col, d: np.array([np.pad(np.asarray(x, float), (0, max(0, d - len(x))))[:d] for x in col])
            lists, queries = ThresholdLists(left["id"].to_numpy(), fill(left["v"], dims)), fill(right["v"], dims)
            whole = np.abs(lists.vectors).max(initial=0) * np.abs(queries).max(initial=0) * dims < EXACT
            if not whole:
                lists.vectors, lists.values, queries = (a.astype(object) for a in (lists.vectors, lists.values, queries))
                for a in (lists.vectors, lists.values, queries):
                    a[...] = np.vectorize(int, otypes=[object])(a)
            for q, own in zip(queries, right["id"], strict=True):
                ids, scores = lists.search(q, own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": [int(s) for s in scores]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query, *, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `is_query` (a condition) holds for, its k best other rows.

    Each component x becomes floor(scale * x); a score is the inner product of these whole numbers; ties go to the
    smaller key. A query doesn't find rows of its own key. Null vectors, those with null or non-finite components,
    and null keys take no part; shorter vectors, empty ones too, count as if filled up with zeros. A repeated row is a
    candidate each time and a query once. Fewer candidates than k: all of them. No rows, or no query: no rows come out.

    Rows are dealt into blocks by a hash of the key, queries likewise; a cell of the grid of blocks is one task
    that holds one block of each, and gives k rows a query at most. Every cell is exact, and so is the best of all cells.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(good).select(F.col(key).cast("long").alias("id"), whole.alias("v"), is_query.alias("q"))
    n, nq = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    cb, qb = max(12, -(-n // CANDIDATES)), max(1, -(-nq // QUERIES))
    block = F.xxhash64("id")
    left = rows.select("id", "v", F.pmod(block, F.lit(cb)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    right = rows.filter("q").select("id", "v", F.explode(F.expr(f"sequence(0L, {cb - 1}L)")).alias("cb"), F.pmod(F.shiftrightunsigned(block, 20), F.lit(qb)).cast("int").alias("qb")).distinct()
    cells = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
