"""The statistics against enumeration and pairwise counting."""

import itertools
import math
import random

import numpy as np
import pytest

from cohortmill.operators import stats as S


def brute_u(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def brute_exact(n1, n2, u):
    total = hits = 0
    m = max(u, n1 * n2 - u)
    for pick in itertools.combinations(range(n1 + n2), n1):
        total += 1
        hits += sum(p - i for i, p in enumerate(pick)) >= m
    return min(1.0, 2 * hits / total)


def cells(spark, groups):
    rows = [("c", "p", g, side, v) for g, (x, y) in groups.items() for side, vs in (("context", x), ("comparator", y)) for v in vs]
    return spark.createDataFrame(rows, "cancer_id string, comparison_type string, gene string, analysis_group string, effect double")


def test_exact_distribution():
    assert brute_exact(2, 2, 4) == pytest.approx(1 / 3)
    for n1, n2 in ((2, 2), (3, 3), (4, 7), (5, 8), (1, 3)):
        d = S.u_distribution(n1, n2)
        assert d.sum() == pytest.approx(1.0)
        for u in range(n1 * n2 + 1):
            m = max(u, n1 * n2 - u)
            assert min(1.0, 2 * d[m:].sum()) == pytest.approx(brute_exact(n1, n2, u))


def test_rank_sum_random(spark):
    rng = random.Random(5)
    groups = {}
    for i in range(12):
        vals = (lambda: rng.choice([1.0, 2.0, 3.0])) if i % 2 else rng.random
        groups[f"g{i}"] = ([vals() for _ in range(rng.randint(2, 12))], [vals() for _ in range(rng.randint(2, 12))])
    groups["gap"] = ([None, float("nan"), 1.0, 2.0], [3.0, 4.0])
    groups["alone"] = ([1.0, 2.0], [])
    groups["same"] = ([1.0] * 3, [1.0] * 3)
    out = {r["gene"]: r for r in S.mann_whitney(S.rank_sum(cells(spark, groups))).collect()}
    for g, (x, y) in groups.items():
        x, y = ([v for v in vs if v is not None and not math.isnan(v)] for vs in (x, y))
        r = out[g]
        assert (r["n1"], r["n2"]) == (len(x), len(y))
        if len(x) < 2 or len(y) < 2:
            assert not r["performed"] and r["p_value"] is None and r["cliffs_delta"] is None
            continue
        u, n1, n2 = brute_u(x, y), len(x), len(y)
        assert r["u1"] == pytest.approx(u)
        assert r["cliffs_delta"] == pytest.approx(sum((a > b) - (a < b) for a in x for b in y) / (n1 * n2))
        tied = len(set(x + y)) < n1 + n2
        if min(n1, n2) <= 8 and not tied:
            assert r["test"] == "exact"
            if n1 + n2 <= 14:
                assert r["p_value"] == pytest.approx(brute_exact(n1, n2, u))
        else:
            t = sum(c**3 - c for c in (sum(v == w for w in x + y) for v in set(x + y)))
            n = n1 + n2
            var = n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))
            z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(var) if var > 0 else 0
            assert r["p_value"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))) if var > 0 else 1.0)


def test_cliff_sign(spark):
    r = S.mann_whitney(S.rank_sum(cells(spark, {"k": ([-1.2, -1.0, -0.8], [-0.2, -0.1, 0.0])}))).collect()[0]
    assert r["cliffs_delta"] == -1.0 and r["p_value"] == pytest.approx(0.1)


def test_bh_qvalues(spark):
    rng = random.Random(3)
    rows = [(f, rng.choice([0.01, 0.02, 0.5, rng.random(), None, 0.0])) for f in ("a", "b", None) for _ in range(40)]
    df = spark.createDataFrame(rows, "f string, p_value double")
    got = sorted((str(r["f"]), r["p_value"], r["q_value"]) for r in S.bh_qvalues(df, ["f"]).collect() if r["p_value"] is not None)
    want = []
    for f in ("a", "b", None):
        ps = sorted(p for g, p in rows if g == f and p is not None)
        for p in ps:
            want.append((str(f), p, min(1.0, *(q * len(ps) / sum(x <= q for x in ps) for q in ps if q >= p))))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    assert S.bh_qvalues(df.limit(0), ["f"]).count() == 0


def test_absent_comparator_is_not_low_sample(spark):
    df = spark.createDataFrame([(66, 0, 0), (3, 9, 9), (9, 2, 4)], "c int, r int, m int")
    assert [x[0] for x in df.select(S.low_sample_flag(df.c, df.r, df.m)).collect()] == [False, True, True]


def test_exact_tail_of_any_size(spark):
    """Whole-number tails against the table, and far beyond it against the normal distribution; the test is exact however large a group is."""
    from pyspark.sql import functions as F

    for n1, n2 in ((1, 5), (2, 2), (3, 7), (8, 8), (8, 120), (5, 900)):
        table = np.cumsum(S.u_distribution(n1, n2)[::-1])[::-1]
        for u in {0, 1, n1 * n2 // 3, n1 * n2 // 2, n1 * n2 - 1, n1 * n2}:
            assert S.exact_tail(n1, n2, u) == pytest.approx(float(table[u]), rel=1e-9, abs=1e-15)
    n = 2_000_000
    assert S.exact_tail(8, n, 8 * n) == pytest.approx(1 / math.comb(n + 8, 8))
    z = 1.5
    assert S.exact_tail(8, n, int(8 * n / 2 + z * math.sqrt(8 * n * (n + 9) / 12))) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=0.01)
    ranks = spark.createDataFrame([(1.0 * a, 1.0 * b, 1.0 * u, t) for a, b, u, t in ((8, 10**5, 1000, 0.0), (8, 200_001, 10**6, 0.0), (9, 10**6, 5, 0.0), (8, 10**6, 5, 6.0))], "n1 double, n2 double, u1 double, ties double")
    got = S.mann_whitney(ranks).collect()
    assert [r["test"] for r in got] == ["exact", "exact", "asymptotic", "asymptotic"]
    assert got[1]["p_value"] == pytest.approx(2 * S.exact_tail(8, 200_001, 10**6))


def _quantile(values, share):
    v = sorted(values)
    at = share * (len(v) - 1)
    low, high = math.floor(at), math.ceil(at)
    return v[low] + (v[high] - v[low]) * (at - low)


@pytest.mark.parametrize("limit", [10**9, 5])
def test_summary_from_value_counts(spark, limit):
    """Medians, quartiles, U and ties of one table of value counts, with keys in one range and cut into several."""
    rng = random.Random(11)
    groups = {"gap": ([None, float("nan"), 1.0], [3.0, None]), "none": ([None], []), "one": ([2.0], []), "equal": ([7.0] * 40, [7.0] * 30), "zero": ([-0.0, 0.0, 1.0], [0.0, -1.0])}
    for i in range(8):
        pick = (lambda: rng.choice([-1.0, 0.0, 2.0, 3.5])) if i % 2 else (lambda: rng.gauss(0, 1) * 10.0 ** rng.randint(-200, 200))
        groups[f"g{i}"] = ([pick() for _ in range(rng.randint(1, 60))], [pick() for _ in range(rng.randint(0, 60))])
    from pyspark.sql import functions as F

    df = cells(spark, groups).withColumn("prob", F.when(F.isnan("effect"), None).when(F.col("effect") > 1, 0.9).when(F.col("effect") > 0, 0.1)).repartition(3)
    cuts = S.value_ranges(df, limit=limit, ranges=7)
    assert (cuts is None) == (limit > 1000)
    got = {r["gene"]: r for r in S.group_summary(df, cuts=cuts).collect()}
    assert set(got) == set(groups)
    ranks = {r["gene"]: r for r in S.rank_sum(df, cuts=cuts).collect()}
    for gene, both in groups.items():
        r = got[gene]
        known = [[v for v in vs if v is not None and not math.isnan(v)] for vs in both]
        for side, vs in zip(S.GROUPS, known):
            assert r[f"{side}_effect_n"] == len(vs)
            assert r[f"{side}_prob_n"] == sum(v > 0 for v in vs) and r[f"{side}_dependent_n"] == sum(v > 1 for v in vs)
            if not vs:
                assert r[f"{side}_median"] is None and r[f"{side}_mean"] is None and r[f"{side}_iqr"] is None
                continue
            assert (r[f"{side}_min"], r[f"{side}_max"]) == (min(vs), max(vs))
            assert r[f"{side}_median"] == pytest.approx(_quantile(vs, 0.5), rel=1e-12) and r[f"{side}_iqr"] == pytest.approx(_quantile(vs, 0.75) - _quantile(vs, 0.25), rel=1e-9)
            assert r[f"{side}_mean"] == pytest.approx(math.fsum(vs) / len(vs), rel=1e-9, abs=1e-12)
        if not any(known):
            assert r["u1"] is None and gene not in ranks
            continue
        every = known[0] + known[1]
        assert r["u1"] == ranks[gene]["u1"] == brute_u(*known)
        assert r["ties"] == ranks[gene]["ties"] == sum(c**3 - c for c in (every.count(v) for v in set(every)))


def test_one_huge_key(spark):
    """A million values of one key: ranges, one grouping of the cells, and no sorting of the whole key in one task."""
    from pyspark.sql import functions as F

    n = 1_000_000
    df = spark.range(n).select(F.lit("c").alias("cancer_id"), F.lit("p").alias("comparison_type"), F.lit("g").alias("gene"), F.when(F.col("id") % 3 == 0, "context").otherwise("comparator").alias("analysis_group"), ((F.col("id") * 7919) % n).cast("double").alias("effect"))
    cuts = S.value_ranges(df, limit=100_000)
    assert 200 <= len(cuts.collect()[0]["cuts"]) <= 255
    t = S.placed(S.value_counts(df, S.KEYS, cuts=cuts), S.KEYS, cuts)
    assert max(r["count"] for r in t.groupBy("_range").count().collect()) < n / 50
    r = S.group_location(df, cuts=cuts).join(S.rank_sum(df, cuts=cuts), list(S.KEYS)).collect()[0]
    values = [(i * 7919) % n for i in range(n)]
    own, rest = sorted(values[::3]), sorted(v for i, v in enumerate(values) if i % 3)
    below = np.searchsorted(np.array(rest), np.array(own))
    assert r["u1"] == float(below.sum()) and r["ties"] == 0 and (r["n1"], r["n2"]) == (len(own), len(rest))
    assert r["context_median"] == _quantile(own, 0.5) and r["comparator_iqr"] == _quantile(rest, 0.75) - _quantile(rest, 0.25)


def test_plan_of_the_screen(spark):
    """One grouping of the cells gives all statistics in two shuffles, and nothing leaves the JVM. With cuts, windows over values stay within a range."""
    from pyspark.sql import functions as F

    df = cells(spark, {"g": ([1.0, 2.0], [3.0])}).withColumn("prob", F.lit(0.5))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    plain = plan(S.mann_whitney(S.group_summary(df)))
    assert not any(x in plain for x in ("EvalPython", "InPandas", "InArrow")) and plain.count("Scan ExistingRDD") == 1 and plain.count("Exchange hashpartitioning") == 2
    cuts = S.value_ranges(df, limit=1)
    windows = [x for x in plan(S.placed(S.value_counts(df, S.KEYS, cuts=cuts), S.KEYS, cuts)).split("\n") if "Window [" in x]
    # the one that does not is over the sums of the ranges
    assert len(windows) == 3 and sum("_range" in x for x in windows) == 2


def test_tails_are_columns(spark):
    """Both distributions against whole numbers and the library's erfc, to 1e-12 of their value."""
    from cohortmill.functions.special import erfc
    from pyspark.sql import functions as F

    x = [i / 16 for i in range(-100, 430)] + [0.46875, 4.0, 4.0000001, 1e-9, 26.5]
    for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", erfc(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-12, abs=1e-300)
    assert spark.range(1).select(erfc(F.lit(None).cast("double"))).collect()[0][0] is None
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        a, b = rng.randint(1, 8), int(10 ** rng.uniform(0, 6))
        m = a * b
        rows.append((float(a), float(b), float(rng.choice([0, m, m // 2, rng.randint(0, m), rng.randint(0, min(m, 3 * b))]))))
    for a, b, u, p in spark.createDataFrame(rows, "a double, b double, u double").select("a", "b", "u", S.exact_two_sided(F.col("a"), F.col("b"), F.col("u")).alias("p")).collect():
        assert p == pytest.approx(min(1.0, 2 * S.exact_tail(int(a), int(b), int(max(u, a * b - u)))), rel=1e-12)
