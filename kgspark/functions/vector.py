"""Vector expressions on array columns and exact top-k search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column | str) -> Column:
    """Divided by its length, which is worked out once, not for each element; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, _d(a)).otherwise(F.get(F.transform(F.array(n), lambda m: F.transform(_d(a), lambda x: x / m)), F.lit(0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def top_k(queries: DataFrame, items: DataFrame, k: int, threshold: float | None = None, by_cosine: bool = False) -> DataFrame:
    """(qid, id, score, rank): for each query (qid, qvec) the k items (id, vec) of largest inner product, or cosine, ties by id. Items
    may have a column `plus`, which is added to the score.

    A stated set of queries meets every item; each task keeps its own best k of each query before anything is
    shuffled, so about k rows a query and task move.
    """
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    extra = [F.col("plus").cast("double")] if "plus" in items.columns else []
    scored = _block_scores(queries, items.select("id", _d("vec").alias("vec"), *extra), k, by_cosine)
    if threshold is not None:
        scored = scored.where(F.col("score") > threshold)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_scores(queries: DataFrame, items: DataFrame, k: int, by_cosine: bool) -> DataFrame:
    """(qid, id, score) with each query's k best items of each batch at least, scores as dot() and cosine() give them.

    A matrix product finds which items can be among the k best, within its own error; those are added up again one term
    after the other, so equal vectors have equal scores, whatever their place in a matrix. Rows with vectors that
    are null, of another length or not finite are few, and go through the expressions.
    """
    same = queries.select("qid", _d("qvec").alias("qvec"))
    kind = {"qid": queries.schema["qid"].dataType.simpleString(), "id": items.schema["id"].dataType.simpleString()}
    plus = F.col("plus") if "plus" in items.columns else F.lit(0.0)
    exact = ((cosine if by_cosine else dot)("qvec", "vec") + plus) if "plus" in items.columns else (cosine if by_cosine else dot)("qvec", "vec")
    by_expressions = lambda i, q: with_queries(i, q).select("qid", "id", exact.alias("score"))
    fit = lambda c, n: (F.size(c) == n) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < 1e100))
    n = same.agg(F.count("*"), F.min(F.size("qvec")), F.max(F.size("qvec")), F.count_if(~F.coalesce(fit("qvec", F.size("qvec")), F.lit(False)) | F.col("qid").isNull())).first()
    if not n[0] or n[1] != n[2] or n[1] < 1 or n[3] or not {*kind.values()} <= {"string", "bigint", "int"}:
        return by_expressions(items, same)
    dim, blocks = n[1], max(1, -(-n[0] // SENT_QUERIES))
    regular = F.coalesce(fit("vec", dim) & F.col("id").isNotNull() & plus.isNotNull(), F.lit(False))
    out = by_expressions(items.where(~regular), same)
    for b in range(blocks):
        mine = same if blocks == 1 else same.where(F.pmod(F.xxhash64("qid", "qvec"), F.lit(blocks)) == b)
        run = _scorer(mine.toPandas(), k, by_cosine, dim)
        out = out.unionByName(items.where(regular).select("id", "vec", plus.alias("plus")).mapInPandas(run, f"qid {kind['qid']}, id {kind['id']}, score double"))
    return out


def _scorer(sent: pd.DataFrame, k: int, by_cosine: bool, dim: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches of items to the rows that can be among the k best of the queries sent."""
    qid, q = sent["qid"].to_numpy(), np.array(sent["qvec"].tolist(), float).reshape(len(sent), dim)

    def length(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for j in range(x.shape[1]):
            out += x[:, j] * x[:, j]
        return np.sqrt(out)

    def place(ids: np.ndarray) -> np.ndarray:
        return np.unique(ids, return_inverse=True)[1]

    def cut(at: np.ndarray, places: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Where each query's k best are, ties by the places of their ids."""
        order = np.lexsort((places, -score, at))
        own = at[order]
        first = np.searchsorted(own, own)
        return order[np.arange(len(own)) - first < k]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_len, best = length(q), np.full(len(q), -np.inf)
        held = (np.zeros(0, int), np.zeros(0, object), np.zeros(0))
        for p in parts:
            ids, plus = p["id"].to_numpy(), p["plus"].to_numpy(float)
            v = np.array(p["vec"].tolist(), float).reshape(len(p), dim)
            if not len(v):
                continue
            v_len, places = length(v), place(ids)
            # what a sum of dim products can be off by, on either side
            slack = 8 * (dim + 8) * np.finfo(float).eps
            for lo in range(0, len(q), 256):
                own = slice(lo, lo + 256)
                rough = q[own] @ v.T
                size = q_len[own, None] * v_len[None]
                if by_cosine:
                    rough = np.divide(rough, size, out=np.zeros_like(rough), where=size != 0) + plus
                    off = slack * (2 + np.abs(plus).max()) * np.ones(len(rough))
                else:
                    rough += plus
                    off = slack * (q_len[own] * v_len.max() + np.abs(plus).max()) + 1e-300
                if len(v) >= k:
                    best[own] = np.maximum(best[own], np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] - 2 * off)
                a, i = np.nonzero(rough >= (best[own] - 2 * off)[:, None])
                if not len(a):
                    continue
                score, at = np.zeros(len(a)), a + lo
                for j in range(dim):
                    score += q[at, j] * v[i, j]
                if by_cosine:
                    n = size[a, i]
                    score = np.divide(score, n, out=np.zeros_like(score), where=n != 0)
                score = score + plus[i]
                some = cut(at, places[i], score)
                held = tuple(np.concatenate([x, y]) for x, y in zip(held, (at[some], ids[i[some]].astype(object), score[some])))
            if len(held[0]) > 4 * k * len(q):
                held = _taken(held, cut(held[0], place(held[1]), held[2]))
        if len(held[0]):
            at, ids, score = _taken(held, cut(held[0], place(held[1]), held[2]))
            yield pd.DataFrame({"qid": qid[at], "id": list(ids), "score": score})

    return run


def _taken(columns: tuple, places: np.ndarray) -> tuple:
    return tuple(x[places] for x in columns)


#: Queries that are sent to every task at once.
SENT_QUERIES = 10_000


def with_queries(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Each item with each of a stated set of queries. The queries are counted, and sent to every task in blocks of about
    SENT_QUERIES, so the items are never shuffled and what is sent at once is bounded."""
    blocks = max(1, -(-queries.count() // SENT_QUERIES))
    if blocks == 1:
        return items.crossJoin(F.broadcast(queries))
    dealt = F.pmod(F.xxhash64(*queries.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, (items.crossJoin(F.broadcast(queries.where(dealt == b))) for b in range(blocks)))


def centroids(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, vec): the mean vector of each key."""
    parts = rows.select(key, F.posexplode(_d(vec)).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
