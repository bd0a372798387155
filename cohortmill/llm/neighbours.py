"""Operator 12: approximate nearest neighbours by counting collisions of single projections.

Vectors are dealt into blocks. A block keeps one sorted array for each of some random projections. For a query, a window
around its own projection is looked up in every array; a vector that lies in at least `least` of the windows is verified by its
exact inner product, all others are left alone. Windows grow by virtual rehashing, that is in the same arrays, until they are
as wide as the distance of the k-th best verified vector asks for: any vector as near as that one is then in enough windows with
a probability of `sure`. A first pass over one block gives each query a k-th score, which sets the windows of all other blocks
at once.

Inner products become distances by one more component: a block's vectors are scaled to norms of at most 1 and raised to the unit
sphere, queries are scaled to it. As the windows follow from distances, the probability holds for any data; how many vectors
are verified depends on how far the nearest stand out.
"""

from __future__ import annotations

from math import comb, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.llm.common import materialise

#: Projections, and the share of them in which a vector at the k-th distance is to collide.
FUNCTIONS, NEAR, SURE = 64, 0.62, 0.93
#: Windows are wide where they hold more than one part in so many of a block's entries.
WIDE = 40
_HUGE = np.finfo(float).max


def threshold(functions: int = FUNCTIONS, near: float = NEAR, sure: float = SURE) -> tuple[int, float]:
    """(least, width): vectors at distance r that collide in each window of half-width r * width with probability `near` do so in at least `least` of them with probability `sure`."""
    tail, least = 0.0, functions + 1
    while tail < sure and least:
        least -= 1
        tail += comb(functions, least) * near**least * (1 - near) ** (functions - least)
    return least, NormalDist().inv_cdf((1 + near) / 2)


class SortedProjections:
    """One block: vectors (n, d) as doubles, none of them zero, and the sorted arrays of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, functions: int = FUNCTIONS, near: float = NEAR, sure: float = SURE):
        self.ids, self.x = ids, vectors
        self.least, self.width = threshold(functions, near, sure)
        self.axes = np.random.default_rng([12, vectors.shape[1]]).standard_normal((vectors.shape[1] + 1, functions))
        self.largest = np.abs(vectors).max()
        small = vectors / self.largest
        norms = np.sqrt((small**2).sum(1))
        self.norm = norms.max()
        rise = np.sqrt(np.maximum(0.0, 1 - (norms / self.norm) ** 2))
        h = (small / self.norm) @ self.axes[:-1] + rise[:, None] * self.axes[-1]
        self.order = np.argsort(h, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(h.T, self.order, 1)
        # where each vector stands in each array, for wide windows
        self.place = np.empty(self.order.shape, np.uint16 if len(ids) <= 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=self.place.dtype)[None], 1)
        self.verified = 0

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many of the windows, places `low` to `high` - 1 of each array, each vector lies.

        Narrow windows are read from the sorted arrays. Where together they hold more than a part in WIDE of all entries, places are
        compared with them instead, as adding up in order is so much cheaper than by number.
        """
        n = len(self.x)
        if (high - low).sum() * WIDE <= self.place.size:
            return np.bincount(np.concatenate([o[i:j] for o, i, j in zip(self.order, low.tolist(), high.tolist())]), minlength=n)
        counts = np.zeros(n, np.uint8 if len(low) < 256 else np.int64)
        kind = self.place.dtype.type
        own, inside = np.empty_like(self.place[0]), np.empty(n, bool)
        for p, i, j in zip(self.place, low.tolist(), high.tolist()):
            if j > i:  # places below the window wrap around and are too large
                np.less_equal(np.subtract(p, kind(i), out=own), kind(j - i - 1), out=inside)
                np.add(counts, inside.view(np.uint8), out=counts)
        return counts

    def _distance(self, score: float, unit: tuple[float, float]) -> float:
        """Of a vector with this inner product with the query, on the sphere."""
        return sqrt(min(4.0, max(0.0, 2 - 2 * (score / self.largest / unit[0]) / (self.norm * unit[1]))))

    def _scores(self, rows: np.ndarray, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best or reach the floor, and their inner products, each summed in the same way wherever it stands."""
        self.verified += len(rows)
        with np.errstate(over="ignore", invalid="ignore"):
            rough = np.nan_to_num(self.x.take(rows, 0) @ q, nan=-_HUGE)
            if len(rough) > k:
                floor = max(floor, np.partition(rough, len(rough) - k)[len(rough) - k])
            slack = 1e-12 * np.abs(q).max() * self.largest * len(q) if floor > -_HUGE else 0.0
            rows = rows[~(rough < floor - slack)]
            return rows, np.clip(np.nan_to_num((self.x[rows] * q).sum(1), nan=-_HUGE), -_HUGE, _HUGE)

    def search(self, query_id: int, q: np.ndarray, k: int, known: float | None = None) -> list[tuple[float, int, int]]:
        """(score, id, row) of the k best that are found, ties to smaller ids, without the query itself; scores below `known` may be left out."""
        return self.search_all([query_id], q[None], k, [known])[0]

    def search_all(self, query_ids: list[int], queries: np.ndarray, k: int, known: list[float | None], begin: float = 0.7, grow: float = 1.25) -> list[list[tuple[float, int, int]]]:
        """`search` of each query. All ask a sorted array for their windows at once."""
        tops = np.abs(queries).max(1)
        units = [(top, sqrt(float(((q / top) ** 2).sum()))) for q, top in zip(queries, tops)]
        h = np.stack([(q / top / length) @ self.axes[:-1] for q, (top, length) in zip(queries, units)])
        done: list[np.ndarray | None] = [None] * len(queries)
        best: list[list[tuple[float, int, int]]] = [[] for _ in done]
        reach = np.array([begin if x is None else self._distance(x, u) for x, u in zip(known, units)])
        left = list(range(len(queries)))
        while left:
            r = (reach[left] * self.width * (1 + 1e-9) + 1e-9)[:, None]
            low = np.stack([s.searchsorted(x) for s, x in zip(self.sorted, (h[left] - r).T)], 1)
            high = np.stack([s.searchsorted(x, "right") for s, x in zip(self.sorted, (h[left] + r).T)], 1)
            wider = []
            for i, a, z in zip(left, low, high):
                if done[i] is None:
                    done[i] = self.ids == query_ids[i]
                new = np.flatnonzero((self.collisions(a, z) >= self.least) & ~done[i])
                floor = best[i][-1][0] if len(best[i]) == k else -_HUGE
                rows, s = self._scores(new, queries[i], k, max(floor, -_HUGE if known[i] is None else known[i]))
                best[i] = sorted([*best[i], *zip(s.tolist(), self.ids[rows].tolist(), rows.tolist())], key=lambda t: (-t[0], t[1], t[2]))[:k]
                kth = self._distance(best[i][-1][0], units[i]) if len(best[i]) == k else 2.0
                if reach[i] >= min(2.0, kth) or known[i] is not None:
                    done[i] = None
                    continue
                done[i][new] = True
                reach[i] = min(reach[i] * grow, kth)
                wider.append(i)
            left = wider
        return best


def _clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v, times: complete, finite vectors that are not zero, in doubles; equal rows as one."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.col(vector_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(ok & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"), v.alias("v")).agg(F.count(F.lit(1)).alias("times"))


def nearest_by_collisions(vectors: DataFrame, is_query, k: int = 20, block_rows: int = 8192, query_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", functions: int = FUNCTIONS, near: float = NEAR, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row the k nearest that are found by inner product among all other rows.

    `is_query` is a condition on the id column; ties go to the smaller id. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do null ids. Rows of the query's own id are no answers. A row that stands several
    times is as many answers; a query id on several rows is asked for each of its different vectors, the best kept.
    Vectors are compared with those of their own length. Inner products beyond a double's range count as the greatest double. A
    query with k candidates or fewer gets all of them. Other columns are ignored; an empty table gives no rows.

    A block of at least k candidates answers with k at least in the first pass. All blocks of candidates meet all blocks of
    queries, one of each in a task: what is shuffled is the table times the number of query blocks and the queries times the
    number of candidate blocks, so both sizes should be as large as memory of a task allows.
    """
    x = materialise(_clean(vectors.select(id_col, vector_col), id_col, vector_col))
    n, asked_n = x.count(), x.where(is_query(F.col("id"))).count()
    n_blocks, n_query_blocks, first_query_blocks = max(1, -(-n // block_rows)), max(1, -(-asked_n // query_rows)), max(1, -(-asked_n // (query_rows // 16 or 1)))
    row = F.xxhash64("id", "v")
    held = x.select(F.size("v").alias("d"), "id", "v", "times", row.alias("row")).withColumn("cb", F.pmod("row", F.lit(n_blocks)))
    asked = x.where(is_query(F.col("id"))).select(F.size("v").alias("d"), "id", "v", row.alias("row"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        cand, ask = pdf[~pdf.q], pdf[pdf.q]
        out: list[tuple[int, int, float, int, int]] = []
        if len(cand) and len(ask):
            block = SortedProjections(cand.id.to_numpy(), np.stack(cand.v.to_numpy()).astype(np.float64), functions, near, sure)
            times, rows = cand.times.tolist(), cand.row.tolist()
            for of in range(0, len(ask), 256):
                some = ask.iloc[of : of + 256]
                known = [None if np.isnan(x) else x for x in some.known.tolist()]
                for qid, found in zip(some.id.tolist(), block.search_all(some.id.tolist(), np.stack(some.v.to_numpy()).astype(np.float64), k, known)):
                    out += [(qid, i, s, times[at], rows[at]) for s, i, at in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "times", "row"]).astype({"query_id": "int64", "vec_id": "int64", "row": "int64", "score": "float64", "times": "int64"})

    def searched(c: DataFrame, q: DataFrame, blocks, parts: int) -> DataFrame:
        c = c.select("d", "id", "v", "times", "row", "cb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qb"), F.lit(False).alias("q"), F.lit(None).cast("double").alias("known"))
        q = q.select("d", "id", "v", F.lit(1).cast("long").alias("times"), "row", F.explode(blocks).alias("cb"), F.pmod("row", F.lit(parts)).cast("int").alias("qb"), F.lit(True).alias("q"), "known")
        return q.unionByName(c).groupBy("d", "cb", "qb").applyInPandas(cell, "query_id long, vec_id long, score double, times long, row long")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id", "row").agg(F.max(F.struct("score", "times")).alias("b")).select("query_id", "vec_id", "b.*")
        best = best.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))).alias("copy"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k)

    zero = F.array(F.lit(0).cast("long"))
    first = materialise(searched(held.where("cb = 0"), asked.withColumn("known", F.lit(None).cast("double")), zero, first_query_blocks))
    if n_blocks == 1:
        return ranked(first).select("query_id", "rank", "vec_id", "score")
    known = ranked(first).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("known"))
    rest = asked.join(known, asked["id"] == known["of"], "left").drop("of")
    found = searched(held.where("cb > 0"), rest, F.sequence(F.lit(1).cast("long"), F.lit(n_blocks - 1).cast("long")), n_query_blocks)
    return ranked(first.unionByName(found)).select("query_id", "rank", "vec_id", "score")
