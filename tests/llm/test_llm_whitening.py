"""Operator 13 and its eigenvectors against numpy's own decomposition, and the edge cases."""

import math
from collections import defaultdict

import numpy as np
import pytest

VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 5, "own") for i, v in rows], VECTORS)


def check(rows, vectors):
    """`rows` against the definition over `vectors`, which all have one length."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(32, x.shape[1])
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    deviation = sorted(int(t) for t in ((n * x.astype(object) - s.astype(object)) ** 2).sum(1))
    assert sorted(r["deviation"] for r in rows) == sorted(deviation * k)
    for i in range(k):
        own = [r for r in rows if r["component"] == i + 1]
        assert own[0]["explained"] == pytest.approx(values[i] / values.sum(), rel=1e-9)
    return values, axes, y


def test_whitening(spark):
    from cohortmill.llm.whitening import whiten

    rng = np.random.default_rng(1)
    for d, n in ((64, 700), (5, 60)):
        x = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.3 + 5
        x = x.astype(np.float32)
        df = table(spark, [*enumerate(x), (-1, None), (-2, [None] * d), (-3, [math.nan] * d), (-4, [math.inf] * d), (-5, [])]).repartition(5)
        rows = whiten(df).collect()
        values, axes, y = check(rows, x)
        by = defaultdict(dict)
        for r in rows:
            by[r["component"]][r["vec_id"]] = r["whitened"]
        w = np.array([[by[c + 1][i] for i in range(n)] for c in range(min(32, d))])
        want = (y @ axes / np.sqrt(values)).T[: len(w)]
        sign = np.sign((w * want).sum(1))[:, None]
        assert np.abs(w * sign - want).max() < 1e-9
        error = {r["identity_error"] for r in rows}
        assert len(error) == 1 and error.pop() < 1e-10
        assert np.abs(w @ w.T / n - np.eye(len(w))).max() < 1e-10


def test_whitening_edges(spark):
    from cohortmill.llm.whitening import whiten

    assert whiten(table(spark, [])).collect() == [] and whiten(table(spark, [(1, None)])).collect() == []
    one = whiten(table(spark, [(None, [1, 2, 3])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(None, c, 1, 0, None, None, None) for c in (1, 2, 3)]
    # repeated rows and vectors in a plane; another length is fitted by itself
    rng = np.random.default_rng(2)
    flat = np.repeat(rng.integers(-50, 50, (40, 1)) * np.array([[1, 1, 0]]) + rng.integers(-9, 9, (40, 1)) * np.array([[0, 0, 1]]), 3, 0)
    rows = whiten(table(spark, [*((7, v) for v in flat), (8, [1, 2]), (9, [3, 5])])).collect()
    mine = [r for r in rows if r["n"] == 120]
    check(mine, flat)
    assert {r["whitened"] is None for r in mine if r["component"] == 3} == {True} and {r["whitened"] is None for r in mine if r["component"] < 3} == {False}
    assert max(r["identity_error"] for r in mine) < 1e-9 and len(rows) == 120 * 3 + 2 * 2
    huge = whiten(table(spark, [(1, [3e38, 0]), (2, [-3e38, 1])])).collect()
    assert {r["deviation"] for r in huge} == {(1 << 63) - 1} and all(r["whitened"] is None or math.isfinite(r["whitened"]) for r in huge)


def test_moments_merge():
    from cohortmill.llm.whitening import Moments

    x = np.random.default_rng(3).standard_normal((500, 6)) + 1e6
    m = Moments(6)
    for part in np.array_split(x, 7):
        m.add(part)
    y = x - x.mean(0)
    assert m.n == 500 and np.abs(m.m2 - y.T @ y).max() < 1e-6 * 500


@pytest.mark.parametrize("kind", ["random", "equal", "rank", "spread", "close", "chain", "small"])
def test_leading_eigen(kind):
    from cohortmill.llm.eigen import leading_eigen

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 40, 64):
        x = rng.standard_normal((2 * n, n))
        turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
        a = {
            "random": x.T @ x, "equal": np.eye(n) * 3, "rank": x[:2].T @ x[:2], "spread": (turn * 10.0 ** -np.arange(n)) @ turn.T, "close": (turn * (1 + 1e-13 * np.arange(n))) @ turn.T,
            "chain": np.diag(np.abs(np.arange(n) - n // 2) * 1.0) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1), "small": x.T @ x * 1e-200,
        }[kind]
        values, q = leading_eigen(a, 32)
        want = np.linalg.eigvalsh(a)[::-1][:32]
        size = max(np.abs(want).max(), 1e-290)
        assert np.abs(values - want).max() < 1e-13 * size and np.abs(q @ q.T - np.eye(len(q))).max() < 1e-12 and np.abs(a @ q.T - q.T * values).max() < 1e-13 * size


def test_op13_on_the_tables(spark):
    from cohortmill.llm.queries import op13_embedding_whitening

    sf = "/root/testdata/sf0.001"
    rows = op13_embedding_whitening(spark, sf).collect()
    check(rows, [r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()])
    assert {r["identity_error"] < 1e-9 for r in rows} == {True}
