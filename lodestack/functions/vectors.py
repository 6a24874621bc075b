"""Vector arithmetic as columns, and nearest neighbours of a set of queries as block products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; null for vectors of different length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


#: Queries and rows in a block.
QUERY_BLOCK, ROW_BLOCK = 2_000, 4_000
#: Queries up to which their blocks are broadcast (about 100 MB at 64 dimensions); beyond, blocks are joined by a shuffle.
BROADCAST_QUERIES = 200_000
#: Rows of results that a task gathers before it hands them on.
GATHERED = 2_000_000
#: More than a product of blocks can differ from a score that is summed alone.
ROUNDING = 1e-9
BLOCK = "ids binary, vectors binary, n int"


def packed(size: int, numbered: bool):
    """For mapInPandas over (id, vector): blocks of ``size`` unit vectors as bytes; null vectors are left out. With ``numbered``, b is the partition."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def block(rows: list) -> pd.DataFrame:
            v = np.array([x for _, x in rows], dtype=np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            out = {"ids": [np.array([i for i, _ in rows], dtype=np.int64).tobytes()], "vectors": [(v / np.where(norm == 0, 1, norm)).tobytes()], "n": [len(rows)]}
            return pd.DataFrame(({"b": [TaskContext.get().partitionId()]} if numbered else {}) | out)

        rows: list = []
        for batch in batches:
            batch = batch[batch["vector"].notna()]
            rows.extend(zip(batch["id"], batch["vector"]))
            while not numbered and len(rows) >= size:
                yield block(rows[:size])
                rows = rows[size:]
        if rows:
            yield block(rows)

    return pack


def _best(ids: np.ndarray, q: np.ndarray, keys: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, id, score of the k best of a block of rows for every query of a block."""
    order = np.argsort(keys, kind="stable")
    keys, v = keys[order], v[order]
    own = pd.DataFrame({"v": [x.tobytes() for x in v]})
    place = own.groupby("v").cumcount().to_numpy()  # of equal vectors the k smallest ids besides the query's own can be among the k best
    keys, v = keys[place <= k], v[place <= k]
    s = q @ v.T
    s[ids[:, None] == keys[None, :]] = -np.inf
    edge = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(ids), -np.inf)
    found = []
    for i in range(len(ids)):
        cols = np.flatnonzero((s[i] >= edge[i] - ROUNDING) & (s[i] > -np.inf))
        exact = (v[cols] * q[i]).sum(axis=1)  # equal vectors score the same wherever they stand, unlike in a product of blocks
        best_first = np.lexsort((keys[cols], -exact))[:k]
        found.append((np.full(len(best_first), ids[i]), keys[cols][best_first], exact[best_first]))
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "id", "score"), zip(*found))})


def nearest(queries: DataFrame, rows: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """query_id, id, score (cosine), rank of the k best of ``rows`` (id, vector) for every one of ``queries`` (id, vector).

    Both sides are packed into blocks, and every block of rows is multiplied with every block of queries where the rows lie: blocks
    of up to ``BROADCAST_QUERIES`` queries are broadcast, more are joined by a shuffle; no vector goes through the driver. A task
    hands on no more than k rows a query for what it holds at a time. A query isn't its own neighbour; ties go by id. Null vectors
    have no neighbours and are none, zero vectors score 0; ids are whole numbers and unique among the queries.
    """
    asked = queries.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    q = asked.repartition(blocks, "id").mapInPandas(packed(QUERY_BLOCK, True), f"b int, {BLOCK}").toDF("b", "q_ids", "q_vectors", "q_n")
    q = F.broadcast(q) if n <= BROADCAST_QUERIES else q
    r = rows.select(F.col("id").cast("long").alias("id"), "vector").mapInPandas(packed(ROW_BLOCK, False), BLOCK)
    pairs = r.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q, "b")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[int, pd.DataFrame] = {}

        def handed() -> pd.DataFrame:
            out = pd.concat(top.values())
            return out if least is None else out[out["score"] >= least]

        for batch in batches:
            for x in batch.itertuples(index=False):
                q, v = (np.frombuffer(y, dtype=np.float64).reshape(m, -1) for y, m in ((x.q_vectors, x.q_n), (x.vectors, x.n)))
                found = _best(np.frombuffer(x.q_ids, dtype=np.int64), q, np.frombuffer(x.ids, dtype=np.int64), v, k)
                found = pd.concat([top[x.b], found]) if x.b in top else found
                top[x.b] = found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
            if sum(map(len, top.values())) > GATHERED:
                yield handed()
                top.clear()
        if top:
            yield handed()

    out = pairs.mapInPandas(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
