"""Operator 3: exact top-k search by the threshold algorithm over sorted lists per dimension.

Vectors are dealt into blocks. A block keeps a sorted list of its vectors for each dimension; for a query, the lists are
read from their better end, those first that the bound depends on most, and each vector that turns up is scored in full.
No vector that has not turned up can score above the sum of the query's components times the next values of the lists:
once this bound is below the k-th score known, the block is done. A first pass over one block gives each query a k-th
score, which all other blocks start from. A query's whole answer is merged from the blocks' answers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.llm.common import materialise

#: Sums of products below this are exact in double precision.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


class SortedLists:
    """One block: whole-numbered vectors (n, d) as doubles and, for each dimension, the order of its rows by rising value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, 0)
        self.top = np.abs(vectors).max(axis=0, initial=0)
        self.scored = 0

    def exact(self, q: np.ndarray) -> bool:
        return float(self.top @ np.abs(q)) < _EXACT

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products: in doubles where those are exact, else in whole numbers of any size."""
        self.scored += len(rows)
        if self.exact(q):
            return (self.x[rows] @ q).astype(np.int64)
        whole = [int(b) for b in q]
        return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in self.x[rows]], object)

    def search(self, query_id: int, q: np.ndarray, k: int, least: int | None = None, step: int = 32) -> list[tuple[int, int, int]]:
        """The block's best k as (score, id, row), ties to smaller ids, without the query itself; scores below `least` may be left out."""
        n = len(self.x)
        used = np.flatnonzero(q)
        up = q[used] > 0
        w = q[used]
        seen = np.zeros(n, bool)
        best: list[tuple[int, int, int]] = []
        depth = np.zeros(len(used), np.int64)
        low = np.where(up, self.sorted[0, used], self.sorted[n - 1, used]) if n else w
        while True:
            at = np.where(up, n - 1 - depth, depth)
            if (depth >= n).any() or not len(used):
                at = None  # a list is read to its end, so all rows have turned up
            if at is not None:
                value = self.sorted[at, used]
                known = best[-1][0] if len(best) == k else None
                floor = known if least is None else least if known is None else max(known, least)
                if floor is not None:
                    bound = int(value @ w) if self.exact(q) else sum(int(a) * int(b) for a, b in zip(value, w))
                    if bound < floor:
                        break
                # lists whose next value lies far above their worst one lower the bound most
                gap = w * (value - low)
                ahead = gap >= gap.mean()
                if not ahead.any():
                    ahead[:] = True
                more = np.where(ahead, np.minimum(n, np.maximum(step, 2 * depth)), depth)
                turned = np.zeros(n, bool)
                for d, (a, z) in enumerate(zip(depth, more)):
                    if z > a:
                        turned[self.order[n - z : n - a, used[d]] if up[d] else self.order[a:z, used[d]]] = True
                new = np.flatnonzero(turned & ~seen)
                depth = more
            else:
                new = np.flatnonzero(~seen)
            seen[new] = True
            new = new[self.ids[new] != query_id]
            s = self.scores(new, q)
            if len(s) > k:
                high = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, new = s[high], new[high]
            best = sorted([*best, *zip(s.tolist(), self.ids[new].tolist(), new.tolist())], key=lambda t: (-t[0], t[1], t[2]))[:k]
            if at is None:
                break
        return best


def _integers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v, times: floor(scale * component), a whole number in double precision, of the vectors that are complete and finite; equal rows as one."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    ok = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.when(F.abs(x) < F.lit(_EXACT), F.floor(x).cast("double")).otherwise(x))
    return df.where(ok & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"), whole.alias("v")).agg(F.count(F.lit(1)).alias("times"))


def threshold_topk(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, block_rows: int = 4096, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with all other rows.

    `is_query` is a condition on the id column; ties go to the smaller id. Vectors that are null or hold a null or
    non-finite component take no part, nor do null ids; an empty vector scores 0. A row that stands several times is as many
    answers. Rows of the query's own id are no answers, and a query id that stands on several rows is asked for each of its
    different vectors, the best scores kept. Scores beyond a long are given as the nearest long, but ranked by their
    double. A component that scaling takes beyond a double's range counts as the greatest double. Vectors are compared with
    those of their own length. Other columns are ignored; an empty table gives no rows.

    Every block of queries meets every block of candidates once, a task holds one block of each: what is shuffled is the
    table times the number of query blocks and the queries times the number of candidate blocks.
    """
    x = materialise(_integers(vectors.select(id_col, vector_col), id_col, vector_col, scale))
    n = x.count()
    n_blocks, n_query_blocks = max(1, -(-n // block_rows)), max(1, -(-x.where(is_query(F.col("id"))).count() // query_rows))
    size = F.size("v").alias("d")
    # dealt by a hash of the row, so that equal vectors spread as others do
    held = x.select(size, "id", "v", "times", F.xxhash64("id", "v").alias("row")).withColumn("cb", F.pmod("row", F.lit(n_blocks)))
    asked = x.where(is_query(F.col("id"))).select(size, "id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_query_blocks)).cast("int").alias("qb"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        cand, ask = pdf[~pdf.q], pdf[pdf.q]
        out: list[tuple[int, int, int, float, int, int]] = []
        if len(cand) and len(ask):
            lists = SortedLists(cand.id.to_numpy(), np.clip(np.stack(cand.v.to_numpy()).reshape(len(cand), -1).astype(np.float64), -np.finfo(float).max, np.finfo(float).max))
            times, rows = cand.times.tolist(), cand.row.tolist()
            for qid, qv, least in zip(ask.id.tolist(), ask.v, ask.least.astype(object).tolist()):
                for s, i, at in lists.search(qid, np.clip(np.asarray(qv, np.float64), -np.finfo(float).max, np.finfo(float).max), k, None if pd.isna(least) else int(least)):
                    out.append((qid, i, max(-_LONG - 1, min(_LONG, s)), float(s) if abs(s) < 1 << 1000 else (1e301 if s > 0 else -1e301), times[at], rows[at]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "rough", "times", "row"]).astype({"query_id": "int64", "vec_id": "int64", "row": "int64", "score": "int64", "rough": "float64", "times": "int64"})

    def searched(c: DataFrame, q: DataFrame, blocks) -> DataFrame:
        c = c.select("d", "id", "v", "times", "row", "cb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("qb"), F.lit(False).alias("q"), F.lit(None).cast("long").alias("least"))
        q = q.select("d", "id", "v", F.lit(1).cast("long").alias("times"), F.lit(0).cast("long").alias("row"), F.explode(blocks).alias("cb"), "qb", F.lit(True).alias("q"), "least")
        return q.unionByName(c).groupBy("d", "cb", "qb").applyInPandas(cell, "query_id long, vec_id long, score long, rough double, times long, row long")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id", "row").agg(F.max(F.struct("rough", "score", "times")).alias("b")).select("query_id", "vec_id", "b.*")
        best = best.select("query_id", "vec_id", "score", "rough", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))).alias("copy"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rough"), F.desc("score"), "vec_id", "copy"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)

    asked = asked.withColumn("least", F.lit(None).cast("long"))
    zero = F.array(F.lit(0).cast("long"))
    first = materialise(searched(held.where("cb = 0"), asked, zero))
    if n_blocks == 1:
        return ranked(first).select("query_id", "rank", "vec_id", "score")
    # several vectors of one query id share the k-th score of the best of them, which is a bound for their common answer
    known = ranked(first).where((F.col("rank") == k) & (F.abs("rough") < 2.0**62)).select(F.col("query_id").alias("of"), F.col("score").alias("least"))
    rest = asked.drop("least").join(known, asked["id"] == known["of"], "left").drop("of")
    found = searched(held.where("cb > 0"), rest, F.sequence(F.lit(1).cast("long"), F.lit(n_blocks - 1).cast("long")))
    return ranked(first.unionByName(found)).select("query_id", "rank", "vec_id", "score")


#: For DuckDB.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
