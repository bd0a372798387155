"""Operator 12 against brute force: recall, order and scores of what is found, and the edge cases."""

import math
from math import comb

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, score double, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0.5, "own") for i, v in rows], VECTORS)


def check(rows, vectors, k=20, every=20):
    """Ranks, scores and order of the answers; returns the recall."""
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(float)
    got: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in ids[ids % every == 0]:
        s = x @ x[ids == q][0]
        order = sorted(((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != q))[:k]
        own = got.pop(q, [])
        assert len(own) == len(order) and [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        at = {int(i): j for j, i in enumerate(ids)}
        assert all(r["score"] == pytest.approx(s[at[r["vec_id"]]], rel=1e-12, abs=1e-15) for r in own)
        hits += len({int(i) for _, i in order} & {r["vec_id"] for r in own})
        total += len(order)
    assert not got
    return hits / max(1, total)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "norms", "copies"])
def test_nearest_by_collisions(spark, kind):
    from cohortmill.llm.neighbours import nearest_by_collisions

    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 32))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "clusters":
        x = rng.standard_normal((12, 32))[rng.integers(0, 12, 1500)] + 0.05 * x
    if kind == "norms":
        x *= np.exp(rng.standard_normal((1500, 1)) * 2)
    if kind == "copies":
        x[::3] = x[0]
    vectors = list(enumerate(x.astype(np.float32)))
    rows = nearest_by_collisions(table(spark, vectors), lambda i: i % 20 == 0, block_rows=400, query_rows=64).collect()
    assert check(rows, vectors) >= 0.9
    if kind == "copies":  # ties go to the smaller ids
        mine = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 60)
        assert mine == [(i + 1, 3 * i) for i in range(20)]


def test_windows_leave_most_vectors_alone():
    """Where the nearest stand out, few others are verified."""
    from cohortmill.llm.neighbours import SortedProjections

    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 64))[np.repeat(np.arange(200), 20)] + 0.1 * rng.standard_normal((4000, 64))
    block = SortedProjections(np.arange(4000), x)
    found = {q: {i for _, i, _ in block.search(q, x[q], 19)} for q in range(0, 4000, 200)}
    assert sum(len(v & set(range(q, q + 20))) for q, v in found.items()) >= 0.9 * 19 * 20
    assert block.verified < 0.1 * 20 * 4000


@pytest.mark.parametrize("rows", [300, 70_000])
def test_wide_windows_count_like_narrow_ones(monkeypatch, rows):
    """Counts of places within wide windows are those of reading the sorted arrays, with empty and full windows too."""
    from cohortmill.llm import neighbours

    rng = np.random.default_rng(7)
    block = neighbours.SortedProjections(np.arange(rows), rng.standard_normal((rows, 4)), functions=16)
    low = rng.integers(0, rows // 2, 16)
    high = low + rng.integers(0, rows // 2, 16)
    low[0], high[0], low[1], high[1] = 0, rows, 5, 5
    counts = {}
    for wide in (0, 1 << 40):  # all narrow, all wide
        monkeypatch.setattr(neighbours, "WIDE", wide)
        counts[wide] = block.collisions(low, high)
    brute = sum(np.isin(np.arange(rows), block.order[j, low[j] : high[j]]).astype(int) for j in range(16))
    assert (counts[0] == brute).all() and (counts[1 << 40] == brute).all()


def test_queries_together_find_what_each_finds_alone():
    from cohortmill.llm.neighbours import SortedProjections

    x = np.random.default_rng(8).standard_normal((900, 16))
    block = SortedProjections(np.arange(900), x)
    known = [None, 2.0, None, -1.0]
    assert block.search_all([0, 1, 2, 3], x[:4], 9, known) == [block.search(i, x[i], 9, known[i]) for i in range(4)]


def test_threshold():
    from cohortmill.llm.neighbours import threshold

    least, width = threshold(64, 0.62, 0.93)
    p = math.erf(width / math.sqrt(2))
    assert p == pytest.approx(0.62)
    tail = lambda l: sum(comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(l, 65))
    assert tail(least) >= 0.93 > tail(least + 1)


def test_neighbour_edges(spark):
    from cohortmill.llm.neighbours import nearest_by_collisions

    near = lambda rows, **kw: sorted(tuple(r)[:4] for r in nearest_by_collisions(table(spark, rows), lambda i: i % 20 == 0, **kw).collect())
    assert near([]) == [] and near([(0, None), (1, [1, 2])]) == [] and near([(0, [1, 2])]) == []
    odd = [(40, [0, 0]), (41, [None, 1]), (42, [math.nan, 1]), (43, [math.inf, 1]), (None, [1, 1]), (44, []), (45, [1, 2, 3]), (46, [0, 0])]
    assert near([(0, [1, 2]), (1, [3, 4]), (2, [-1, -1]), *odd]) == [(0, 1, 1, 11.0), (0, 2, 2, -3.0)]
    assert near([(0, [1, 2]), (5, [1, 0]), (5, [1, 0]), (6, [1, 0]), (0, [9, 9])], k=3) == [(0, 1, 5, 9.0), (0, 2, 5, 9.0), (0, 3, 6, 9.0)]
    assert near([(0, [3e38, 1]), (1, [3e38, 0]), (2, [1e-38, 0])], k=2)[0][2] == 1


def test_op12_on_the_tables(spark):
    from cohortmill.llm.queries import op12_collision_neighbours

    sf = "/root/testdata/sf0.1"
    vectors = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert check(op12_collision_neighbours(spark, sf).collect(), vectors) >= 0.9
