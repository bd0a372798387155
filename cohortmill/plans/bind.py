"""The star-schema test tables in the roles of the library's inputs: DataFrames, and the same for SQL as named subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.operators import cohorts as C

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
URGENT = r"^1-URGENT$"
HIGH_PRICE = 300000.0
#: Each segment is a context of gene F; the split looks at the same.
CONTEXTS = tuple(C.Context(f"CTX-{s}", C.EXACT, (C.GeneRule("F", (URGENT,)),), {"code": (s,)}, None, False) for s in SEGMENTS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def models(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("c_custkey").alias("model_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("code"), F.col("n_name").alias("subtype"), F.col("r_name").alias("lineage"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("model_id"), F.col("o_orderstatus").alias("gene"), F.col("o_orderpriority").alias("change"), F.when(F.col("o_totalprice") > HIGH_PRICE, "Y").otherwise("N").alias("driver_flag"), F.concat(F.lit("note "), F.col("o_orderpriority")).alias("note"))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return e.select(F.col("user_id").alias("model_id"), F.col("event_type").alias("datatype"), F.when(even, "true").otherwise("false").alias("is_default"))


def profiled(spark: SparkSession, sf: str) -> DataFrame:
    return C.profiled_models(profiles(spark, sf), ("purchase", "view"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """model_id, gene, effect (the greatest price), prob (the least tax in 0 .. 1): no averages, whose last bits would depend on the order of summing."""
    li, o, p = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "part")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return j.groupBy(F.col("o_custkey").alias("model_id"), F.col("p_brand").alias("gene")).agg(F.max("l_extendedprice").alias("effect"), (F.min("l_tax") / 0.08).alias("prob"))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return C.cohort_assign(models(spark, sf), events(spark, sf), profiled(spark, sf), CONTEXTS, columns=("change", "driver_flag"))


def split(spark: SparkSession, sf: str) -> DataFrame:
    return C.cohort_split_variant(models(spark, sf), events(spark, sf), profiled(spark, sf), CONTEXTS, ["driver_flag"])


def members(spark: SparkSession, sf: str) -> DataFrame:
    s = split(spark, sf)
    return C.membership(C.cohort_project(audit(spark, sf), "primary"), C.cohort_project(s, "wildtype"), C.cohort_project(s, "other-driver"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand with every context, and a context without models."""
    g = table(spark, sf, "part").select(F.col("p_brand").alias("gene")).distinct()
    g = g.select("gene", F.explode(F.array(*(F.lit(f"CTX-{s}") for s in (*SEGMENTS, "NONE")))).alias("cancer_id"))
    return g.select(F.concat_ws(":", "cancer_id", "gene").alias("evidence_id"), "cancer_id", F.concat(F.lit("T-"), F.col("gene")).alias("target_id"), "gene")


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("row"), F.concat(F.lit("ID:"), F.col("p_partkey").cast("string")).alias("hgnc_id"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("symbol"),
        F.when(F.col("p_partkey") % 50 == 0, "Pending").otherwise("Approved").alias("status"), F.regexp_replace("p_name", " ", "|").alias("alias_symbol"), F.concat(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("prev_symbol"),
        F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string")).alias("ensembl_gene_id"), F.col("p_partkey").cast("string").alias("entrez_id"), F.concat(F.lit("U"), F.col("p_partkey").cast("string"), F.lit("|V"), F.col("p_size").cast("string")).alias("uniprot_ids"),
    )


def withdrawn(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the ten smallest sizes had another name; those of the five smallest were split into two."""
    p = table(spark, sf, "part").where("p_size <= 10")
    own = F.concat(F.lit("ID:"), F.col("p_partkey").cast("string"), F.lit("|"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")), F.lit("|Approved"))
    return p.select(F.concat(F.lit("OLD"), F.col("p_partkey").cast("string")).alias("withdrawn_symbol"), F.when(F.col("p_size") <= 5, F.concat(own, F.lit(",ID:0|OTHER|Approved"))).otherwise(own).alias("merged_into"))


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all kinds, some unknown, some blank."""
    p = table(spark, sf, "part")
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.lower(F.concat_ws("-", "p_brand", key))).when(k == 1, F.concat(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"))).when(k == 2, F.split("p_name", " ")[0]).when(k == 3, F.concat(F.lit("OLD"), key)).when(k == 4, F.concat(F.lit("none"), key)).otherwise(F.lit(" "))
    return p.select(F.concat(F.lit("S"), key).alias("target_id"), name.alias("input_symbol"), F.concat(F.lit("ENSG"), (F.col("p_partkey") + (F.col("p_partkey") % 12 == 0).cast("int")).cast("string")).alias("existing_ensembl_gene_id"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Association pages: nations are diseases, brands are targets; shares of the nation's customers' line items by segment are the scores."""
    c, o, li, p = (table(spark, sf, t) for t in ("customer", "orders", "lineitem", "part"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    per = j.groupBy("c_nationkey", "p_brand", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = per.groupBy("c_nationkey", "p_brand").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct(F.col("c_mktsegment").alias("id"), (F.least(F.col("n"), F.lit(64)) / 64).alias("score")))).alias("scores"))
    row = F.struct(F.struct(F.concat(F.lit("ENSG"), F.col("p_brand")).alias("id"), F.col("p_brand").alias("approvedSymbol")).alias("target"), (F.least(F.col("all"), F.lit(256)) / 256).alias("score"), F.col("scores").alias("datatypeScores"), F.col("scores").alias("datasourceScores"))
    by = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
    disease = F.struct(F.concat(F.lit("EFO_"), F.col("c_nationkey").cast("string")).alias("id"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("name"), F.struct(F.col("n").alias("count"), F.col("rows")).alias("associatedTargets"))
    return by.select(F.lit(0).alias("page"), F.struct(disease.alias("disease")).alias("data"))


def ontology(spark: SparkSession, sf: str) -> DataFrame:
    """Nations; the regions' names belong to all of their nations, so they are ambiguous."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    own = n.select(F.concat(F.lit("EFO_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    more = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("REG_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("r_name").alias("name"))
    return own.unionByName(more)


def mappings(spark: SparkSession, sf: str) -> DataFrame:
    """One mapping for each nation: current id, stale id with a unique name, ambiguous name, another name, or unknown."""
    n = table(spark, sf, "nation")
    k, key = F.col("n_nationkey") % 5, F.col("n_nationkey").cast("string")
    return n.select(F.concat(F.lit("C"), key).alias("cancer_id"), F.when(k.isin(0, 3), F.concat(F.lit("EFO_"), key)).otherwise(F.concat(F.lit("OLD_"), key)).alias("disease_id"), F.when(k == 2, F.lit("ASIA")).when(k == 3, F.lit("another name")).when(k == 4, F.lit("unknown")).otherwise(F.lower(F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")))).alias("expected_disease_name"))


_IN = ", ".join(f"'{s}'" for s in SEGMENTS)
#: The same inputs for SQL.
CTES = {
    "models": "SELECT c_custkey AS model_id, c_name AS name, c_mktsegment AS code, n_name AS subtype, r_name AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "evts": f"SELECT o_custkey AS model_id, o_orderstatus AS gene, o_orderpriority AS change, CASE WHEN o_totalprice > {HIGH_PRICE} THEN 'Y' ELSE 'N' END AS driver_flag, 'note ' || o_orderpriority AS note FROM orders",
    "profs": "SELECT user_id AS model_id, event_type AS datatype, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'true' ELSE 'false' END AS is_default FROM events",
    "profiled": "SELECT DISTINCT model_id FROM profs WHERE datatype IN ('purchase', 'view') AND is_default = 'true'",
    "cells": "SELECT o_custkey AS model_id, p_brand AS gene, max(l_extendedprice) AS effect, min(l_tax) / 0.08 AS prob FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "recs": """SELECT model_id, gene = 'F' AND change = '1-URGENT' AS hit, '{"change":"' || change || '","driver_flag":"' || driver_flag || '"}' AS rec, driver_flag FROM evts WHERE gene = 'F'""",
    "per": "SELECT model_id, bool_or(hit) AS t, true AS a, bool_or(NOT hit AND driver_flag = 'Y') AS v, coalesce(string_agg(rec, ' ' ORDER BY rec) FILTER (hit), '') AS ql, coalesce(string_agg(rec, ' ' ORDER BY rec) FILTER (NOT hit), '') AS ol FROM recs GROUP BY ALL",
    "audit": f"""SELECT 'CTX-' || code AS cancer_id, m.model_id, name, p.model_id IS NOT NULL AS sequenced, CASE WHEN p.model_id IS NULL THEN 'unsequenced' WHEN coalesce(t, false) THEN 'defining_present' ELSE 'defining_absent' END AS molecular_status,
        CASE WHEN p.model_id IS NULL THEN 'excluded' WHEN coalesce(t, false) THEN 'context' ELSE 'comparator' END AS assigned_group,
        CASE WHEN p.model_id IS NULL THEN 'no default profile of a covered type' WHEN coalesce(t, false) THEN 'a defining variant' ELSE 'no defining variant' END AS reason,
        CASE WHEN p.model_id IS NULL THEN '' ELSE coalesce(ql, '') END AS qualifying, CASE WHEN p.model_id IS NULL THEN '' ELSE coalesce(ol, '') END AS other
        FROM models m LEFT JOIN per USING (model_id) LEFT JOIN profiled p ON p.model_id = m.model_id WHERE code IN ({_IN})""",
    "split0": f"""SELECT 'CTX-' || code AS cancer_id, '1-URGENT' AS target_label, m.model_id, name, p.model_id IS NOT NULL AS sequenced,
        CASE WHEN p.model_id IS NULL THEN 'unsequenced' WHEN coalesce(t, false) THEN 'target_variant' WHEN NOT coalesce(a, false) THEN 'wildtype_proxy' WHEN coalesce(v, false) THEN 'other_driver_hotspot' ELSE 'ambiguous_variant' END AS molecular_status,
        CASE WHEN p.model_id IS NULL THEN '' ELSE coalesce(ql, '') END AS qualifying, CASE WHEN p.model_id IS NULL THEN '' ELSE coalesce(ol, '') END AS other
        FROM models m LEFT JOIN per USING (model_id) LEFT JOIN profiled p ON p.model_id = m.model_id WHERE code IN ({_IN})""",
    "split": """SELECT *, CASE WHEN molecular_status IN ('unsequenced', 'ambiguous_variant') THEN 'excluded' ELSE molecular_status END AS assigned_group,
        CASE molecular_status WHEN 'unsequenced' THEN 'no default profile of a covered type' WHEN 'target_variant' THEN 'target variant 1-URGENT' WHEN 'wildtype_proxy' THEN 'no record of the gene' WHEN 'other_driver_hotspot' THEN 'another variant with a driver mark' ELSE 'another variant without a driver mark' END AS reason FROM split0""",
    "members": """SELECT cancer_id, 'primary' AS comparison_type, model_id, assigned_group AS analysis_group FROM audit WHERE assigned_group <> 'excluded'
        UNION ALL SELECT cancer_id, 'wildtype', model_id, CASE assigned_group WHEN 'target_variant' THEN 'context' ELSE 'comparator' END FROM split WHERE assigned_group IN ('target_variant', 'wildtype_proxy')
        UNION ALL SELECT cancer_id, 'other-driver', model_id, CASE assigned_group WHEN 'target_variant' THEN 'context' ELSE 'comparator' END FROM split WHERE assigned_group IN ('target_variant', 'other_driver_hotspot')""",
    "own": "SELECT cancer_id, comparison_type, analysis_group, model_id, gene, effect, prob FROM cells JOIN members USING (model_id)",
    "nmod": "SELECT cancer_id, comparison_type, count(*) FILTER (analysis_group = 'context') AS context_models_n, count(*) FILTER (analysis_group = 'comparator') AS comparator_models_n FROM members GROUP BY ALL",
    "counts": """SELECT cancer_id, comparison_type, gene, count(effect) FILTER (analysis_group = 'context') AS context_effect_n, count(prob) FILTER (analysis_group = 'context') AS context_prob_n,
        count(effect) FILTER (analysis_group = 'comparator') AS comparator_effect_n, count(prob) FILTER (analysis_group = 'comparator') AS comparator_prob_n FROM own GROUP BY ALL""",
    "gc": "SELECT *, greatest(0, context_models_n - context_effect_n) AS context_missing_n, greatest(0, comparator_models_n - comparator_effect_n) AS comparator_missing_n FROM counts JOIN nmod USING (cancer_id, comparison_type)",
    "loc": "SELECT cancer_id, comparison_type, gene, " + ", ".join(f"quantile_cont(effect, 0.5) FILTER (analysis_group = '{g}') AS {g}_median, avg(effect) FILTER (analysis_group = '{g}') AS {g}_mean, quantile_cont(effect, 0.75) FILTER (analysis_group = '{g}') - quantile_cont(effect, 0.25) FILTER (analysis_group = '{g}') AS {g}_iqr, min(effect) FILTER (analysis_group = '{g}') AS {g}_min, max(effect) FILTER (analysis_group = '{g}') AS {g}_max" for g in ("context", "comparator")) + " FROM own GROUP BY ALL",
    "dep": "SELECT cancer_id, comparison_type, gene, " + ", ".join(f"count(*) FILTER (analysis_group = '{g}' AND prob > 0.5) AS {g}_dependent_n, count(*) FILTER (analysis_group = '{g}' AND prob > 0.5) / CAST(nullif(count(prob) FILTER (analysis_group = '{g}'), 0) AS DOUBLE) AS {g}_dependency_fraction" for g in ("context", "comparator")) + " FROM own GROUP BY ALL",
    "broad": "SELECT gene, count(prob) AS broad_n, count(*) FILTER (prob > 0.5) / CAST(nullif(count(prob), 0) AS DOUBLE) AS broad_dependency_fraction, quantile_cont(effect, 0.5) AS all_median_effect, coalesce(count(*) FILTER (prob > 0.5) / CAST(nullif(count(prob), 0) AS DOUBLE) >= 0.8, false) AS broad_dependency_warning FROM cells GROUP BY ALL",
    "vc": "SELECT cancer_id, comparison_type, gene, effect, CAST(count(*) FILTER (analysis_group = 'context') AS DOUBLE) AS c, CAST(count(*) FILTER (analysis_group = 'comparator') AS DOUBLE) AS r FROM own WHERE effect IS NOT NULL GROUP BY ALL",
    "vb": "SELECT *, coalesce(sum(r) OVER (PARTITION BY cancer_id, comparison_type, gene ORDER BY effect ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM vc",
    "ranks": "SELECT cancer_id, comparison_type, gene, sum(c) AS n1, sum(r) AS n2, sum(c * (below + r / 2)) AS u1, sum(pow(c + r, 3) - (c + r)) AS ties FROM vb GROUP BY ALL",
    "gate": "SELECT *, n1 >= 2 AND n2 >= 2 AS performed, CASE WHEN n1 >= 2 AND n2 >= 2 AND least(n1, n2) <= 8 AND ties = 0 THEN 'exact' WHEN n1 >= 2 AND n2 >= 2 THEN 'asymptotic' END AS test FROM ranks",
    "zs": "SELECT *, CASE WHEN performed AND n1 * n2 / 12 * ((n1 + n2 + 1) - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0)) > 0 THEN (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))) END AS z, CASE WHEN performed THEN 2 * u1 / nullif(n1 * n2, 0) - 1 END AS cliffs_delta FROM gate",
    "asy": "SELECT *, CASE WHEN NOT performed THEN NULL WHEN z IS NULL OR z <= 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 300), lambda n: exp(n * ln(2) + (2 * n + 1) * ln(z / sqrt(2)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)))))) END AS p_asy FROM zs",
    "sizes": "SELECT DISTINCT CAST(least(n1, n2) AS INT) AS a, CAST(n1 + n2 AS INT) AS n FROM gate WHERE test = 'exact'",
    "dp": """SELECT a, n, 0 AS i, 0 AS k, 0 AS s, CAST(1 AS DOUBLE) AS cnt FROM sizes
        UNION ALL SELECT a, n, i + 1, k + j, s + j * (i + 1), sum(cnt) FROM dp, (VALUES (0), (1)) t(j) WHERE i < n AND k + j <= a GROUP BY 1, 2, 3, 4, 5""",
    "dist": "SELECT a, n, s - a * (a + 1) // 2 AS u, cnt / sum(cnt) OVER (PARTITION BY a, n) AS pr FROM dp WHERE i = n AND k = a",
    "tails": "SELECT a, n, u, sum(pr) OVER (PARTITION BY a, n ORDER BY u DESC) AS tail FROM dist",
    "mw": "SELECT z.* EXCLUDE (p_asy), CASE WHEN test = 'exact' THEN least(1.0, 2 * tail) WHEN performed THEN p_asy END AS p_value FROM asy z LEFT JOIN tails ON test = 'exact' AND a = least(n1, n2) AND n = n1 + n2 AND u = greatest(u1, n1 * n2 - u1)",
    "qs": """SELECT cancer_id, comparison_type, gene, p_value, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(raw) OVER (PARTITION BY cancer_id, comparison_type, p_value IS NULL ORDER BY p_value DESC)) END AS q_value FROM (
        SELECT *, p_value * count(p_value) OVER (PARTITION BY cancer_id, comparison_type) / count(p_value) OVER (PARTITION BY cancer_id, comparison_type, p_value IS NULL ORDER BY p_value) AS raw FROM mw)""",
    "res": """SELECT gc.*, loc.* EXCLUDE (cancer_id, comparison_type, gene), dep.* EXCLUDE (cancer_id, comparison_type, gene), coalesce(performed, false) AS performed, test, u1, ties, z, cliffs_delta, mw.p_value, q_value,
        context_median - comparator_median AS delta_median, coalesce(context_effect_n < 5 OR (comparator_models_n > 0 AND comparator_effect_n < 5), false) AS low_sample,
        broad_n, broad_dependency_fraction, all_median_effect, broad_dependency_warning, coalesce(q_value < 0.05, false) AS fdr_0_05
        FROM gc JOIN loc USING (cancer_id, comparison_type, gene) JOIN dep USING (cancer_id, comparison_type, gene) LEFT JOIN mw USING (cancer_id, comparison_type, gene) LEFT JOIN qs USING (cancer_id, comparison_type, gene) JOIN broad USING (gene)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY cancer_id, comparison_type ORDER BY CASE WHEN comparator_models_n > 0 THEN delta_median ELSE context_median END NULLS LAST, CASE WHEN comparator_models_n > 0 THEN q_value END NULLS LAST, gene) AS screen_rank FROM res",
    "tops": "SELECT * FROM (SELECT cancer_id, comparison_type, gene, row_number() OVER (PARTITION BY cancer_id, comparison_type ORDER BY delta_median, gene) AS rank, delta_median FROM res WHERE NOT broad_dependency_warning AND NOT low_sample AND delta_median IS NOT NULL) WHERE rank <= 10",
    "rec": "SELECT gene, count(DISTINCT cancer_id || ' ' || comparison_type) AS comparisons_n, string_agg(DISTINCT cancer_id || ' ' || comparison_type, '; ' ORDER BY cancer_id || ' ' || comparison_type) AS comparisons, min(rank) AS best_rank, avg(rank) AS mean_rank, avg(delta_median) AS mean_delta FROM tops GROUP BY ALL",
    "ctxs": f"SELECT unnest([{', '.join(repr('CTX-' + s) for s in (*SEGMENTS, 'NONE'))}]) AS cancer_id",
    "prs": "SELECT cancer_id || ':' || gene AS evidence_id, cancer_id, 'T-' || gene AS target_id, gene FROM (SELECT DISTINCT p_brand AS gene FROM part), ctxs",
    "dict": """SELECT p_partkey AS row, 'ID:' || p_partkey AS hgnc_id, p_brand || '-' || p_partkey AS symbol, CASE WHEN p_partkey % 50 = 0 THEN 'Pending' ELSE 'Approved' END AS status, replace(p_name, ' ', '|') AS alias_symbol,
        p_brand || p_type || p_size AS prev_symbol, 'ENSG' || p_partkey AS ensembl_gene_id, CAST(p_partkey AS VARCHAR) AS entrez_id, 'U' || p_partkey || '|V' || p_size AS uniprot_ids FROM part""",
    "wdr": "SELECT 'OLD' || p_partkey AS withdrawn_symbol, CASE WHEN p_size <= 5 THEN 'ID:' || p_partkey || '|' || p_brand || '-' || p_partkey || '|Approved,ID:0|OTHER|Approved' ELSE 'ID:' || p_partkey || '|' || p_brand || '-' || p_partkey || '|Approved' END AS merged_into FROM part WHERE p_size <= 10",
    "sds": """SELECT 'S' || p_partkey AS target_id, CASE p_partkey % 6 WHEN 0 THEN lower(p_brand || '-' || p_partkey) WHEN 1 THEN p_brand || p_type || p_size WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN 'OLD' || p_partkey WHEN 4 THEN 'none' || p_partkey ELSE ' ' END AS input_symbol,
        'ENSG' || (p_partkey + CASE WHEN p_partkey % 12 = 0 THEN 1 ELSE 0 END) AS existing_ensembl_gene_id FROM part""",
    "lk": """SELECT 'approved' AS class, upper(symbol) AS key, symbol FROM dict UNION ALL SELECT 'previous', upper(prev_symbol), symbol FROM dict
        UNION ALL SELECT 'alias', upper(unnest(string_split(alias_symbol, '|'))), symbol FROM dict UNION ALL SELECT 'withdrawn', upper(withdrawn_symbol), split_part(unnest(string_split(merged_into, ',')), '|', 2) FROM wdr""",
    "agg": """SELECT key, max(symbol) FILTER (class = 'approved') AS a, count(*) FILTER (class = 'previous') AS np, max(symbol) FILTER (class = 'previous') AS sp, count(*) FILTER (class = 'alias') AS na, max(symbol) FILTER (class = 'alias') AS sa,
        count(DISTINCT symbol) FILTER (class = 'withdrawn') AS nw, max(symbol) FILTER (class = 'withdrawn') AS sw FROM lk GROUP BY key""",
    "rsv": """SELECT s.*, CASE WHEN trim(input_symbol) = '' THEN 'not_found' WHEN g.a IS NOT NULL THEN 'exact_approved_symbol' WHEN np = 1 THEN 'previous_symbol' WHEN np > 1 THEN 'manual_review_required' WHEN na = 1 THEN 'alias_symbol' WHEN na > 1 THEN 'manual_review_required'
        WHEN nw = 1 AND o.symbol IS NOT NULL THEN 'withdrawn_merged' WHEN nw > 0 THEN 'manual_review_required' ELSE 'not_found' END AS mapping_status,
        CASE WHEN trim(input_symbol) = '' THEN NULL WHEN g.a IS NOT NULL THEN g.a WHEN np = 1 THEN sp WHEN np > 1 THEN NULL WHEN na = 1 THEN sa WHEN na > 1 THEN NULL WHEN nw = 1 THEN o.symbol END AS resolved_symbol
        FROM sds s LEFT JOIN agg g ON g.key = upper(trim(input_symbol)) AND trim(input_symbol) <> '' LEFT JOIN dict o ON nw = 1 AND o.symbol = sw""",
    "idn": "SELECT r.target_id, input_symbol, existing_ensembl_gene_id, mapping_status, d.symbol AS hgnc_symbol, d.hgnc_id, d.status AS hgnc_status, d.ensembl_gene_id, d.entrez_id AS ncbi_gene_id, split_part(d.uniprot_ids, '|', 1) AS uniprot_id FROM rsv r LEFT JOIN dict d ON d.symbol = resolved_symbol",
    "apr": "SELECT c_nationkey AS nk, p_brand AS b, c_mktsegment AS seg, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(*) > 1",
    "asc0": "SELECT 'EFO_' || nk AS disease_id, 'NATION_' || nk AS disease_name, 'ENSG' || b AS target_id, b AS symbol, least(sum(n), 256) / 256.0 AS score FROM apr GROUP BY ALL",
    "ont": "SELECT 'EFO_' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'REG_' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "mps": "SELECT 'C' || n_nationkey AS cancer_id, CASE WHEN n_nationkey % 5 IN (0, 3) THEN 'EFO_' ELSE 'OLD_' END || n_nationkey AS disease_id, CASE n_nationkey % 5 WHEN 2 THEN 'ASIA' WHEN 3 THEN 'another name' WHEN 4 THEN 'unknown' ELSE lower(' ' || n_name || ' ') END AS expected_disease_name FROM nation",
    "hits": "SELECT lower(trim(name)) AS nm, count(DISTINCT id) AS h, min(id) AS hit, min(name) AS hname FROM ont GROUP BY 1",
    "dsr": """SELECT m.*, coalesce(o.id, CASE WHEN h = 1 THEN hit END) AS resolved_id, coalesce(o.name, CASE WHEN h = 1 THEN hname END) AS resolved_name, CASE WHEN o.id IS NOT NULL THEN 'configured_id' WHEN h = 1 THEN 'exact_name' ELSE 'unresolved' END AS resolution_method,
        coalesce(coalesce(o.id, CASE WHEN h = 1 THEN hit END) <> m.disease_id, false) AS id_changed, CASE WHEN o.id IS NULL AND coalesce(h, 0) <> 1 THEN 'expected one exact name, found ' || coalesce(h, 0) END AS resolution_error
        FROM mps m LEFT JOIN ont o ON o.id = m.disease_id LEFT JOIN hits ON nm = lower(trim(expected_disease_name))""",
}


def sql(query: str) -> str:
    """A query over the named inputs."""
    if query.lstrip().startswith("WITH "):
        query = f"SELECT * FROM ({query})"
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + "\n" + query
