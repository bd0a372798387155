"""Operator 10: mixing sources to target weights, with DataFrame functions only.

A budget of tokens goes down the tree domain - language - source. At each node it is split among the children by weight;
a child cannot get more than its subtree can give, and what it leaves goes to its siblings first. A subtree is never
given more than it holds, so only what a whole subtree lacks reaches the siblings of its ancestors. A leaf with more
budget than tokens repeats whole epochs; of the last one it takes the prefix that fits, in the order of a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.llm.common import materialise

LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words: runs other than blank, tab and line end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long")


def split_budget(children: DataFrame, parent: list[str], budget: str, weight: str, cap: str) -> DataFrame:
    """`share` of each child: its part of the parent's budget by weight, none above its cap, the rest filled up alike.

    Children are taken by rising cap / weight: while the next one's cap is below its part of what is left, it gets its cap.
    """
    part = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = part.orderBy((F.col(cap) / F.col(weight)).asc(), *(F.col(c).asc_nulls_first() for c in LEVELS if c in children.columns))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(after)
    d = children.withColumn("_level", level).withColumn("_full", F.col(cap) <= F.col(weight) * F.col("_level"))
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(part.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = d.withColumn("_common", common)
    return d.withColumn("share", F.when(F.col("_full"), F.col(cap)).otherwise(F.least(F.col(cap), F.col(weight) * F.col("_common")))).drop("_level", "_full", "_common")


def leaf_budgets(leaves: DataFrame, total: Column, alpha: float, max_epochs: int, targets: DataFrame | None = None) -> DataFrame:
    """domain, lang, source, tokens, share of each leaf. `targets` as in `mix_sources`; one row a leaf is looked at here, never documents."""
    out = leaves.where("tokens > 0").withColumn("_b", F.least(total, F.sum("tokens").over(W.partitionBy(F.lit(0))) * float(max_epochs)))
    for i, name in enumerate(LEVELS):
        up, keys = list(LEVELS[:i]), list(LEVELS[: i + 1])
        nodes = out.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("t"), F.first("_b").alias("_b"))
        weight = F.pow("t", F.lit(float(alpha)))
        if targets is not None:
            own = targets.where(F.col("depth") == i + 1).groupBy(*(F.col(k).alias("t_" + k) for k in keys)).agg(F.max(F.col("weight").cast("double")).alias("t_w"))
            nodes = nodes.join(own, [nodes[k].eqNullSafe(own["t_" + k]) for k in keys], "left")
            of = W.partitionBy(*up) if up else W.partitionBy(F.lit(0))
            given, others = F.sum("t_w").over(of), F.sum(F.when(F.col("t_w").isNull(), weight)).over(of)
            weight = F.coalesce("t_w", F.when(given.isNull(), weight).otherwise(F.greatest(1 - given, F.lit(0.0)) * weight / others))
        nodes = nodes.withColumn("w", weight).withColumn("cap", F.when(F.col("w") > 0, F.col("t") * float(max_epochs)).otherwise(0.0)).withColumn("w", F.greatest("w", F.lit(1e-300)))
        nodes = split_budget(nodes, up, "_b", "w", "cap").select(*(F.col(k).alias("_" + k) for k in keys), "share")
        on = [out[k].eqNullSafe(nodes["_" + k]) for k in keys]
        out = out.join(nodes, on).drop("_b", *("_" + k for k in keys)).withColumnRenamed("share", "_b")
    return out.withColumnRenamed("_b", "share")


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix_sources(docs: DataFrame, fraction: float = 0.75, alpha: float = 0.5, max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that the budget of `fraction` of all tokens selects, with `mix_epoch` (from 0): a row stands once for each epoch.

    `domain` is a column expression; without one, all sources are in one domain. `targets` has domain, lang, source, depth and
    weight: a row of depth 1, 2 or 3 sets the share that this domain, language of it or source of that gets of its parent's budget.
    What the rows leave of 1 is shared by the siblings without a target, by tokens ** alpha; so are all where none has one. Weights
    of siblings are taken in proportion; a weight of 0 or less gives nothing. A target for a node without documents has no effect.

    A null language or source is a node of its own. Rows of one leaf that share
    an id are taken or left together. A text without tokens (null, empty) costs nothing and stands in the whole epochs and
    prefixes its hash falls in; a leaf without any token gives nothing. A column of `docs` named mix_epoch gives way, all others stay; an
    empty table gives no rows. Nodes of the tree (domains, languages, sources) are split one window a parent: some thousands
    of children each; documents are dealt into 4096 buckets a leaf.
    """
    docs = docs.drop("mix_epoch")
    names = {"domain": domain if domain is not None else F.lit("all"), "lang": F.col(lang_col), "source": F.col(source_col)}
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("_id"), *(c.alias("_" + k) for k, c in names.items()), token_count(F.col(text_col)).alias("tokens"))
    small = materialise(base.drop("row"))
    leaves = materialise(small.groupBy(*(F.col("_" + k).alias(k) for k in LEVELS)).agg(F.sum("tokens").alias("tokens")))
    total = F.floor(F.lit(float(fraction)) * F.sum("tokens").over(W.partitionBy(F.lit(0)))).cast("double")
    plan = leaf_budgets(leaves.withColumn("_total", total), F.col("_total"), alpha, max_epochs, targets).drop("_total")
    plan = plan.withColumn("want", F.floor(F.round("share", 6)).cast("long")).withColumn("whole", F.floor(F.col("want") / F.col("tokens")).cast("long"))
    plan = materialise(plan.withColumn("rest", F.col("want") - F.col("whole") * F.col("tokens")).select(*(F.col(k).alias("l_" + k) for k in LEVELS), "whole", "rest"))

    on = lambda d: [d["_" + k].eqNullSafe(F.col("l_" + k)) for k in LEVELS]
    keyed = small.join(plan, on(small)).where("rest > 0").select(*("l_" + k for k in LEVELS), "rest", "tokens", _key(seed, F.col("whole"), F.col("_id")).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    leaf = ["l_" + k for k in LEVELS]
    buckets = keyed.groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("t"))
    buckets = buckets.withColumn("upto", F.sum("t").over(W.partitionBy(*leaf).orderBy("bucket")))
    edge = buckets.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest"))).select(*(F.col(c).alias("e_" + c) for c in leaf), "bucket", (F.col("upto") - F.col("t")).alias("before"))
    edge = edge.withColumnRenamed("bucket", "e_bucket")
    inside = keyed.join(edge, [keyed[c].eqNullSafe(F.col("e_" + c)) for c in leaf] + [F.col("bucket") == F.col("e_bucket")])
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy(*leaf).orderBy("key")))
    # of the bucket in which the budget ends, the first key that no longer fits
    stop = inside.where("upto > rest").groupBy(*leaf).agg(F.min("key").alias("stop"))
    stop = stop.select(*(F.col(c).alias("s_" + c) for c in leaf), "stop")
    plan = materialise(plan.join(stop, [plan[c].eqNullSafe(F.col("s_" + c)) for c in leaf], "left").select(*leaf, "whole", "rest", "stop"))

    taken = base.drop("tokens").join(plan, on(base))
    n = F.col("whole") + ((F.col("rest") > 0) & (F.col("stop").isNull() | (_key(seed, F.col("whole"), F.col("_id")) < F.col("stop")))).cast("long")
    taken = taken.select("row", n.alias("_n")).where("_n > 0").select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("mix_epoch"))
    return taken.select("row.*", "mix_epoch")


def _sql_level(n: int) -> str:
    """The relations of one level of the tree: children with weights and caps, the level at which the rest is filled up, shares."""
    keys, up = LEVELS[: n + 1], LEVELS[:n]
    cols = ", ".join(keys)
    same = lambda a, b, of: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in of) or "true"
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    order = f"{part} ORDER BY cap / w, {', '.join(k + ' NULLS FIRST' for k in keys)}"
    budget = f"(SELECT share FROM s{n - 1} AS x WHERE {same('x', 'l', up)})" if n else "(SELECT least(floor({fraction} * sum(t)), sum(t) * {epochs}) FROM leaves)"
    return f"""
a{n} AS (SELECT l.*, y.weight AS t_w, pow(l.t, {{alpha}}) AS p, {budget} AS b FROM (SELECT {cols}, sum(t) AS t FROM leaves GROUP BY ALL) AS l
         LEFT JOIN (SELECT {cols}, max(weight) AS weight FROM targets WHERE depth = {n + 1} GROUP BY ALL) AS y ON {same('l', 'y', keys)}),
w{n} AS (SELECT *, coalesce(t_w, CASE WHEN sum(t_w) OVER ({part}) IS NULL THEN p ELSE greatest(1 - sum(t_w) OVER ({part}), 0) * p / sum(CASE WHEN t_w IS NULL THEN p END) OVER ({part}) END) AS w0 FROM a{n}),
c{n} AS (SELECT *, CASE WHEN w0 > 0 THEN t * {{epochs}} ELSE 0 END AS cap, greatest(w0, 1e-300) AS w FROM w{n}),
l{n} AS (SELECT *, (b - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c{n}),
s{n} AS (SELECT {cols}, t, CASE WHEN cap <= w * lv THEN cap ELSE least(cap, w * max(CASE WHEN cap > w * lv THEN lv END) OVER ({part})) END AS share FROM l{n})"""


#: The same selection for DuckDB; {docs} is a relation with doc_id, text, lang, source, {domain} an expression, {targets} a relation as `mix_sources` takes it.
MIX_SQL = (
    """
WITH targets AS (SELECT * FROM {targets}),
small AS (SELECT doc_id, {domain} AS domain, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS DOUBLE) AS t FROM small GROUP BY ALL HAVING sum(tokens) > 0),"""
    + ",".join(_sql_level(n) for n in range(3))
    + """,
plan AS (SELECT domain, lang, source, CAST(floor(floor(round(share, 6)) / t) AS BIGINT) AS whole, floor(round(share, 6)) AS want, t FROM s2),
keyed AS (SELECT s.doc_id, s.domain, s.lang, s.source, s.tokens, p.whole, p.want - p.whole * p.t AS rest,
                 md5(concat_ws(':', '{seed}', CAST(p.whole AS VARCHAR), coalesce(CAST(s.doc_id AS VARCHAR), 'null'))) AS key
          FROM small s JOIN plan p ON s.domain IS NOT DISTINCT FROM p.domain AND s.lang IS NOT DISTINCT FROM p.lang AND s.source IS NOT DISTINCT FROM p.source),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
n AS (SELECT doc_id, lang, source, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM summed)
"""
)
#: A `targets` relation without rows.
NO_TARGETS = "(SELECT '' AS domain, '' AS lang, '' AS source, 0 AS depth, 0.0 AS weight WHERE false)"
