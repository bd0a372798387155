"""Two-cohort statistics for each key, from one table of value counts.

The cells of a key are grouped by value once. Running sums over the values give ranks, and with them medians, quartiles, U and
its ties, so neither pairs nor sorted arrays of a group are ever made. Values of very large keys are dealt into ranges, which
exchange only their counts. Distributions are column expressions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.functions.special import erfc

KEYS = ("cancer_id", "comparison_type", "gene")
GROUPS = ("context", "comparator")
EXACT_MAX = 8


def normal_two_sided(z: Column) -> Column:
    """erfc(z / sqrt 2)."""
    return erfc(z / math.sqrt(2))


def u_distribution(n1: int, n2: int) -> np.ndarray:
    """The probabilities of U = 0 .. n1 * n2 without ties, from the generating function of partitions in a box."""
    a, b = min(n1, n2), max(n1, n2)
    f = np.zeros(a * b + 1)
    f[0] = 1.0
    for i in range(1, a + 1):
        # times (1 - x ** (b + i)), divided by (1 - x ** i), kept as probabilities
        if b + i <= a * b:
            f[b + i :] -= f[: len(f) - b - i].copy()
        for r in range(i):
            f[r::i] = np.cumsum(f[r::i])
        f *= i / (b + i)
    return np.clip(f, 0.0, None)


def _period(parts: int) -> int:
    """Along whole numbers with the same remainder by this, `_small_counts` is a polynomial."""
    return math.lcm(*range(1, parts + 1))


@lru_cache(maxsize=None)
def _small_counts(parts: int) -> list[int]:
    """For n up to period * (parts + 1), in how many ways n is a sum of ones of two kinds and of parts 2 .. `parts`: the partitions of at most n into parts of at most that size."""
    out = [1] + [0] * (_period(parts) * (parts + 1) - 1)
    for part in (1, *range(1, parts + 1)):
        for n in range(part, len(out)):
            out[n] += out[n - part]
    return out


@lru_cache(maxsize=None)
def _differences(parts: int) -> list[list[int]]:
    """For each remainder, the differences that give the polynomial of degree `parts`."""
    small, out = _small_counts(parts), []
    for r in range(_period(parts)):
        y, own = small[r :: _period(parts)], []
        while y:
            own.append(y[0])
            y = [b - a for a, b in zip(y, y[1:])]
        out.append(own)
    return out


def _box_terms(parts: int) -> dict[tuple[int, int], int]:
    """The product of 1 - x ** (b + i) over i = 1 .. `parts` by (number of factors taken, sum of their i)."""
    out: Counter[tuple[int, int]] = Counter()
    for size in range(parts + 1):
        for over in combinations(range(1, parts + 1), size):
            out[size, sum(over)] += (-1) ** size
    return out


def exact_tail(n1: int, n2: int, u: int) -> float:
    """P(U >= u) without ties, in whole numbers however large the greater group is: at most n1 * n2 - u is shared by n1 ranks of at most n2 each; ranks above n2 are taken out again by their sizes."""
    a, b = min(n1, n2), max(n1, n2)
    total = 0
    for (size, over), times in _box_terms(a).items():
        n = n1 * n2 - u - over - size * b
        if n >= 0:
            x, r = divmod(n, _period(a))
            total += times * sum(math.comb(x, j) * d for j, d in enumerate(_differences(a)[r]))
    return total / math.comb(a + b, a)


def _tail_of(a: int, b: Column, k: Column) -> Column:
    """`exact_tail` for a smaller group of `a`, as an expression over doubles; k is what U lacks to its greatest value, at most half of that. Terms are positive and at most a few times the result, so nothing cancels."""
    flat = ",".join(str(float(d)) for own in _differences(a) for d in own)
    differences = F.split(F.lit(flat), ",").cast("array<double>")
    terms = [t for t in _box_terms(a).items() if 2 * t[0][0] <= a]
    listed = F.from_json(F.lit("[" + ",".join(f'{{"w":{w},"s":{s},"o":{o}}}' for (s, o), w in terms) + "]"), "array<struct<w:double,s:bigint,o:bigint>>")

    def counted(n: Column) -> Column:
        x, at = F.floor(n / _period(a)).cast("double"), ((n % _period(a)) * (a + 1)).cast("int")
        out = F.get(differences, at + a)
        for j in range(a - 1, -1, -1):
            out = F.get(differences, at + j) + (x - j) / (j + 1) * out
        return out

    def added(acc: Column, t: Column) -> Column:
        n = k - t["o"] - t["s"] * b
        return acc + F.when(n >= 0, t["w"] * counted(n)).otherwise(0.0)

    ways = F.lit(1.0)
    for i in range(1, a + 1):
        ways = ways * ((b + i) / i)
    return F.aggregate(listed, F.lit(0.0), added) / ways


def exact_two_sided(n1: Column, n2: Column, u: Column) -> Column:
    """min(1, 2 P(U' >= max(U, n1 n2 - U))) for a smaller group of 1 to EXACT_MAX; null where a number is missing."""
    a, b = F.least(n1, n2), F.greatest(n1, n2).cast("long")
    k = F.least(u, n1 * n2 - u).cast("long")
    tail = None
    for size in range(1, EXACT_MAX + 1):
        tail = (F if tail is None else tail).when(a == size, _tail_of(size, b, k))
    return F.when(n1.isNotNull() & n2.isNotNull() & u.isNotNull(), F.least(F.lit(1.0), 2 * tail))


# ---- value counts --------------------------------------------------------------------------------------------------


def _of(group: str) -> Column:
    return F.col("analysis_group") == group


def _known(value: str) -> Column:
    """The value; NaN is none."""
    return F.when(~F.isnan(value), F.col(value))


def _same(names: Sequence[str], tag: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"{tag}{c}"))
    return out


def _tagged(df: DataFrame, names: Sequence[str], tag: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{tag}{c}" for c in names})


def value_ranges(cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "effect", limit: int = 1_000_000, ranges: int = 256) -> DataFrame | None:
    """keys, cuts: bounds of about equal ranges of values for each key with more than `limit` of them; None where there is none, which is what one count of the cells says.

    At most the number of cells over `limit` keys have cuts. Where the bounds lie changes how work is dealt out, never a result.
    """
    known = cells.where(_known(value).isNotNull())
    large = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
    if large.isEmpty():
        return None
    own = known.join(_tagged(large, keys, "_l_"), _same(keys, "_l_"), "left_semi")
    at = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    return own.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, at, 10_000))).alias("cuts"))


#: Rows of cuts, of 2 kB each, up to which they are broadcast.
_FEW = 10_000


def value_counts(cells: DataFrame, keys: Sequence[str], value: str = "effect", cuts: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """keys, _range, _v, context_n, comparator_n: how often each value stands in both groups; a row without a value stands for cells that lack it.

    With `threshold`, also how many of these cells have a probability, and one above it. The one grouping of the cells.
    """
    v = _known(value)
    place = F.lit(0)
    if cuts is not None:
        small = cuts.limit(_FEW + 1).count() <= _FEW
        there = _tagged(cuts, keys, "_c_")
        cells = cells.join(F.broadcast(there) if small else there, _same(keys, "_c_"), "left")
        place = F.coalesce(F.size(F.filter("cuts", lambda c: c < v)), F.lit(0))
        place = F.when(v.isNotNull() & F.col("cuts").isNotNull(), place).otherwise(0)
    aggs = [F.count_if(_of(g) & F.col("_v").isNotNull()).cast("double").alias(f"{g}_n") for g in GROUPS]
    own = [c for c in ("analysis_group", "prob") if c in cells.columns]
    if threshold is not None:
        aggs += [F.count(F.when(_of(g), F.col("prob"))).alias(f"{g}_prob_n") for g in GROUPS]
        aggs += [F.count_if(_of(g) & (F.col("prob") > threshold)).alias(f"{g}_dependent_n") for g in GROUPS]
    return cells.select(*keys, place.alias("_range"), v.alias("_v"), *own).groupBy(*keys, "_range", "_v").agg(*aggs)


def placed(counts: DataFrame, keys: Sequence[str], cuts: DataFrame | None = None) -> DataFrame:
    """`value_counts` with, for each group, how many of its values are smaller (*_below) and how many it has in all (*_all).

    Sums run within a range of a key's values. Only keys with cuts have more than one; the ranges of those exchange their sums.
    """
    inside = W.partitionBy(*keys, "_range")
    before = inside.orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    out = counts.select("*", *(F.coalesce(F.sum(f"{g}_n").over(before), F.lit(0.0)).alias(f"{g}_below") for g in GROUPS))
    if cuts is None:
        return out.select("*", *(F.sum(f"{g}_n").over(inside).alias(f"{g}_all") for g in GROUPS))
    # as many rows for a key as it has ranges
    sums = counts.groupBy(*keys, "_range").agg(*(F.sum(f"{g}_n").alias(f"{g}_n") for g in GROUPS))
    of = W.partitionBy(*keys)
    smaller = of.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", *(F.coalesce(F.sum(f"{g}_n").over(smaller), F.lit(0.0)).alias(f"_{g}_before") for g in GROUPS), *(F.sum(f"{g}_n").over(of).alias(f"{g}_all") for g in GROUPS))
    out = out.join(_tagged(sums, [*keys, "_range"], "_s_"), _same([*keys, "_range"], "_s_"))
    out = out.withColumns({f"{g}_below": F.col(f"{g}_below") + F.col(f"_{g}_before") for g in GROUPS})
    return out.select(*counts.columns, *(f"{g}_{x}" for x in ("below", "all") for g in GROUPS))


def _at(group: str, share: float) -> Column:
    """The value of a group's order statistic at this share, between two values by their distance, as an aggregate of `placed` rows."""
    n, below, own = F.col(f"{group}_all"), F.col(f"{group}_below"), F.col(f"{group}_n")
    pick = lambda k: F.max(F.when((below <= k) & (k < below + own), F.col("_v")))
    place = share * (F.max(n) - 1)
    low, high = pick(F.floor(share * (n - 1))), pick(F.ceil(share * (n - 1)))
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def _location_columns() -> list[Column]:
    aggs = []
    for g in GROUPS:
        own = F.when(F.col(f"{g}_n") > 0, F.col("_v"))
        mean = F.sum(own * F.col(f"{g}_n")) / F.nullif(F.sum(f"{g}_n"), F.lit(0.0))
        aggs += [_at(g, 0.5).alias(f"{g}_median"), mean.alias(f"{g}_mean"), (_at(g, 0.75) - _at(g, 0.25)).alias(f"{g}_iqr"), F.min(own).alias(f"{g}_min"), F.max(own).alias(f"{g}_max")]
    return aggs


def _rank_columns() -> list[Column]:
    c, r = F.col("context_n"), F.col("comparator_n")
    t = c + r
    return [F.sum(c).alias("n1"), F.sum(r).alias("n2"), F.sum(c * (F.col("comparator_below") + r / 2)).alias("u1"), F.sum(t * t * t - t).alias("ties")]


# ---- statistics ----------------------------------------------------------------------------------------------------


def _count_columns() -> list[Column]:
    of = lambda g, c: F.count(F.when(_of(g), F.col(c)))
    return [of(g, c).alias(f"{g}_{c}_n") for g in GROUPS for c in ("effect", "prob")]


def with_members(got: DataFrame, members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row of sizes for each comparison is joined; there are as many of those as comparisons."""
    who = [k for k in keys if k in ("cancer_id", "comparison_type")]
    n = members.groupBy(*who).agg(*(F.count_if(_of(g)).alias(f"{g}_models_n") for g in GROUPS))
    out = got.join(n, who)
    return out.select("*", *(F.greatest(F.lit(0), F.col(f"{g}_models_n") - F.col(f"{g}_effect_n")).alias(f"{g}_missing_n") for g in GROUPS))


def group_counts(cells: DataFrame, members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Of each key, how many context and comparator models have an effect and a probability; *_models_n counts members whether the matrix has them or not; *_missing_n what is lacking."""
    return with_members(cells.groupBy(*keys).agg(*_count_columns()), members, keys)


def group_location(cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "effect", cuts: DataFrame | None = None) -> DataFrame:
    """Median, mean, inter-quartile range, least and greatest value of both groups."""
    return placed(value_counts(cells, keys, value, cuts), keys, cuts).groupBy(*keys).agg(*_location_columns())


def fraction(n: Column, of: Column) -> Column:
    return n / F.nullif(of.cast("double"), F.lit(0.0))


def dependency_fraction(cells: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.5) -> DataFrame:
    """Of both groups, how many and what share have a probability above the threshold; null without any."""
    n = {g: F.count_if(_of(g) & (F.col("prob") > threshold)) for g in GROUPS}
    return cells.groupBy(*keys).agg(*(x for g in GROUPS for x in (n[g].alias(f"{g}_dependent_n"), fraction(n[g], F.count(F.when(_of(g), F.col("prob")))).alias(f"{g}_dependency_fraction"))))


def group_summary(cells: DataFrame, keys: Sequence[str] = KEYS, threshold: float = 0.5, cuts: DataFrame | None = None) -> DataFrame:
    """Counts, location, fractions and `rank_sum` of each key, from one grouping of the cells. Without values u1 and ties are null."""
    t = placed(value_counts(cells, keys, "effect", cuts, threshold), keys, cuts)
    counts = [x for g in GROUPS for x in (F.sum(f"{g}_n").cast("long").alias(f"{g}_effect_n"), F.sum(f"{g}_prob_n").alias(f"{g}_prob_n"))]
    shares = [x for g in GROUPS for x in (F.sum(f"{g}_dependent_n").alias(f"{g}_dependent_n"), fraction(F.sum(f"{g}_dependent_n"), F.sum(f"{g}_prob_n")).alias(f"{g}_dependency_fraction"))]
    out = t.groupBy(*keys).agg(*counts, *_location_columns(), *shares, *_rank_columns())
    return out.withColumns({c: F.when(F.col("n1") + F.col("n2") > 0, F.col(c)) for c in ("u1", "ties")})


def broad(share: Column, warn: float = 0.8) -> Column:
    return F.coalesce(share >= warn, F.lit(False))


def background_fraction(cells: DataFrame, threshold: float = 0.5, warn: float = 0.8, cuts: DataFrame | None = None) -> DataFrame:
    """Of each gene over all models: how many have a probability, what share is above the threshold, and whether that is broad."""
    return background_of(group_summary(cells.withColumn("analysis_group", F.lit("context")), ["gene"], threshold, cuts), warn)


def background_of(summary: DataFrame, warn: float = 0.8) -> DataFrame:
    """The same from a summary in which all models are the context."""
    share = F.col("context_dependency_fraction")
    return summary.select("gene", F.col("context_prob_n").alias("broad_n"), share.alias("broad_dependency_fraction"), F.col("context_median").alias("all_median_effect"), broad(share, warn).alias("broad_dependency_warning"))


def rank_sum(cells: DataFrame, keys: Sequence[str] = KEYS, value: str = "effect", cuts: DataFrame | None = None) -> DataFrame:
    """keys, n1, n2, u1, ties: the Mann-Whitney U of the context against the comparator, and the sum of t ** 3 - t over tied values. Keys without values are left out."""
    known = cells.where(_known(value).isNotNull())
    return placed(value_counts(known, keys, value, cuts), keys, cuts).groupBy(*keys).agg(*_rank_columns())


def cliffs_delta(u1: Column, n1: Column, n2: Column) -> Column:
    """2 U / (n1 n2) - 1: negative where the context is lower; null for an empty group."""
    return 2 * u1 / F.nullif(n1 * n2, F.lit(0.0)) - 1


def asymptotic_z(u1: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """The continuity-corrected z of max(U1, U2) with tied ranks; null where all values are equal or a group is empty."""
    m, n = n1 * n2, n1 + n2
    var = m / 12 * ((n + 1) - ties / F.nullif(n * (n - 1), F.lit(0.0)))
    return F.when(var > 0, (F.greatest(u1, m - u1) - m / 2 - 0.5) / F.sqrt(var))


def mann_whitney(ranks: DataFrame, min_n: int = 2) -> DataFrame:
    """`rank_sum` rows with performed, test, p_value, cliffs_delta, z.

    A test needs `min_n` values in both groups. It is exact where the smaller group has at most 8 values and no values are
    tied, however many the other group has; `test` names which it was.
    """
    n1, n2, u1 = F.col("n1"), F.col("n2"), F.col("u1")
    gate = (n1 >= min_n) & (n2 >= min_n)
    exact = gate & (F.least(n1, n2) <= EXACT_MAX) & (F.col("ties") == 0)
    r = ranks.withColumn("performed", gate).withColumn("test", F.when(exact, "exact").when(gate, "asymptotic"))
    r = r.withColumn("z", F.when(gate, asymptotic_z(u1, n1, n2, F.col("ties"))))
    p = F.when(F.col("test") == "exact", exact_two_sided(n1, n2, u1)).when(gate, F.coalesce(F.least(F.lit(1.0), normal_two_sided(F.col("z"))), F.lit(1.0)))
    return r.withColumn("p_value", p).withColumn("cliffs_delta", F.when(gate, cliffs_delta(u1, n1, n2)))


def low_sample_flag(context_n: Column, comparator_n: Column, comparator_models: Column, min_context: int = 5, min_comparator: int = 5) -> Column:
    """Too few context values, or too few comparator values where there are comparator models at all."""
    return F.coalesce((context_n < min_context) | ((comparator_models > 0) & (comparator_n < min_comparator)), F.lit(False))


def bh_qvalues(df: DataFrame, family: Sequence[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """`df` with Benjamini-Hochberg q within each family; null p neither counts nor gets a q.

    Equal p are one row of the work. They are dealt into ranges by their logarithm, and ranges exchange only their counts and
    least values, so one large family is no single task.
    """
    fam = list(family)
    d = df.where(F.col(p).isNotNull()).groupBy(*fam, p).agg(F.count(F.lit(1)).alias("_c"))
    d = d.withColumn("_b", F.when(F.col(p) > 0, F.floor(F.ln(p) * 100)).otherwise(F.lit(-1_000_000)).cast("long"))
    ranges = d.groupBy(*fam, "_b").agg(F.sum("_c").alias("_n"))
    over = W.partitionBy(*fam)
    named = lambda frame, cols, tag: frame.withColumnsRenamed({c: f"{tag}{c}" for c in cols})
    same = lambda cols, tag: [F.col(c).eqNullSafe(F.col(f"{tag}{c}")) for c in cols]
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(over.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_m", F.sum("_n").over(over))
    d = d.join(named(ranges.drop("_n"), [*fam, "_b"], "_x_"), same([*fam, "_b"], "_x_")).drop(*(f"_x_{c}" for c in [*fam, "_b"]))
    inside = W.partitionBy(*fam, "_b")
    d = d.withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_before") + F.sum("_c").over(inside.orderBy(p))))
    d = d.withColumn("_least", F.min("_raw").over(inside.orderBy(F.desc(p))))
    least = d.groupBy(*fam, "_b").agg(F.min("_raw").alias("_low"))
    least = least.withColumn("_later", F.min("_low").over(over.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1))).drop("_low")
    d = d.join(named(least, [*fam, "_b"], "_y_"), same([*fam, "_b"], "_y_"))
    d = d.select(*(F.col(c).alias(f"_k_{c}") for c in [*fam, p]), F.least("_least", F.coalesce("_later", "_least"), F.lit(1.0)).alias(q))
    return df.join(d, [*same(fam, "_k_"), F.col(p) == F.col(f"_k_{p}")], "left").select(*df.columns, q)
