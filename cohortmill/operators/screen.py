"""The screen of all features in all comparisons, and what is read off it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.operators import stats as S


#: The comparison that holds every model of the matrix as context; no context has it.
ALL = "all models"


def matrix_select_models(cells: DataFrame, members: DataFrame, background: bool = False) -> DataFrame:
    """The cells of cohort models, once for each comparison a model is in; members the matrix lacks give nothing here.

    With `background`, every cell once more under the comparison `ALL`: one pass over the matrix then serves both.
    """
    cols = ("cancer_id", "comparison_type", "analysis_group")
    if not background:
        return cells.join(members, "model_id").select(*cols, "model_id", "gene", "effect", "prob")
    # as many entries for a model as it has comparisons
    own = members.groupBy("model_id").agg(F.collect_list(F.struct(*cols)).alias("_in"))
    every = F.array(F.struct(F.lit("").alias("cancer_id"), F.lit(ALL).alias("comparison_type"), F.lit("context").alias("analysis_group")))
    x = cells.join(own, "model_id", "left").select(F.explode(F.when(F.col("_in").isNull(), every).otherwise(F.concat(every, F.col("_in")))).alias("x"), "model_id", "gene", "effect", "prob")
    return x.select(*(f"x.{c}" for c in cols), "model_id", "gene", "effect", "prob")


def matrix_gene_intersection(effects: DataFrame, probs: DataFrame) -> DataFrame:
    """The genes that both matrices have."""
    return effects.select("gene").distinct().join(probs.select("gene").distinct(), "gene")


def _finished(summary: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = S.with_members(summary, members, keys).withColumn("delta_median", F.col("context_median") - F.col("comparator_median"))
    return out.withColumn("low_sample", S.low_sample_flag(F.col("context_effect_n"), F.col("comparator_effect_n"), F.col("comparator_models_n")))


def gene_statistics(cells: DataFrame, members: DataFrame, keys: Sequence[str] = S.KEYS, min_n: int = 2) -> DataFrame:
    """Counts, location, fractions and the rank test of each key; low_sample and delta_median too."""
    keys = list(keys)
    summary = S.group_summary(cells, keys, cuts=S.value_ranges(cells, keys))
    return _finished(S.mann_whitney(summary, min_n).drop("n1", "n2"), members, keys)


def screen_statistics(cells: DataFrame, members: DataFrame, keep=None, min_n: int = 2) -> tuple[DataFrame, DataFrame]:
    """`gene_statistics` of all comparisons, and the background of each gene, from one grouping of the cells.

    `keep` may write the selected cells and the statistics, which several results are taken from, and read them back.
    """
    own = matrix_select_models(cells, members, background=True)
    own = keep(own) if keep else own
    summary = S.mann_whitney(S.group_summary(own, cuts=S.value_ranges(own)), min_n).drop("n1", "n2")
    summary = keep(summary) if keep else summary
    every = F.col("comparison_type") == ALL
    return _finished(summary.where(~every), members, S.KEYS), S.background_of(summary.where(every))


def genomewide_screen(cells: DataFrame, members: DataFrame, genes: DataFrame | None = None, keep=None) -> DataFrame:
    """All genes in all comparisons in one pass: `screen_statistics`, q within each comparison, background and flags."""
    statistics, background = screen_statistics(cells, members, keep)
    out = S.bh_qvalues(statistics, ["cancer_id", "comparison_type"])
    out = out.join(background, "gene").withColumn("fdr_0_05", F.coalesce(F.col("q_value") < 0.05, F.lit(False)))
    return gene_metadata_join(out, genes) if genes is not None else out.withColumn("entrez", F.lit(None).cast("string"))


def gene_metadata_join(results: DataFrame, genes: DataFrame) -> DataFrame:
    """The number of each gene beside its symbol."""
    return results.join(genes.select("gene", "entrez").dropDuplicates(["gene"]), "gene", "left")


def screen_order(results: DataFrame) -> DataFrame:
    """`screen_rank` in each comparison: by delta, q and symbol where there is a comparator, else by context median and symbol."""
    lead = F.when(F.col("comparator_models_n") > 0, F.col("delta_median")).otherwise(F.col("context_median"))
    w = W.partitionBy("cancer_id", "comparison_type").orderBy(lead.asc_nulls_last(), F.when(F.col("comparator_models_n") > 0, F.col("q_value")).asc_nulls_last(), F.col("gene").asc_nulls_last())
    return results.withColumn("screen_rank", F.row_number().over(w))


def top_k_heatmap(results: DataFrame, own_cells: DataFrame, k: int = 30) -> DataFrame:
    """The cells of the k genes with the lowest delta (or context median) of each comparison. k is kept within 5 and 100."""
    top = screen_order(results).where(F.col("screen_rank") <= min(100, max(5, k))).select("cancer_id", "comparison_type", "gene", "screen_rank")
    return own_cells.join(top, ["cancer_id", "comparison_type", "gene"]).select("cancer_id", "comparison_type", "screen_rank", "gene", "model_id", "analysis_group", "effect")


def screen_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("cancer_id", "comparison_type").agg(F.count(F.lit(1)).alias("genes_n"), F.count_if("fdr_0_05").alias("fdr_n"), F.count_if("broad_dependency_warning").alias("broad_n"), F.max("context_models_n").alias("context_models_n"), F.max("comparator_models_n").alias("comparator_models_n"))


def scatter_payload(results: DataFrame) -> DataFrame:
    """Genes with both medians."""
    return results.where("context_median IS NOT NULL AND comparator_median IS NOT NULL").select("cancer_id", "comparison_type", "gene", "context_median", "comparator_median", "delta_median", "q_value", "fdr_0_05", "broad_dependency_warning")


def screen_filter(results: DataFrame, text: str = "", fdr_only: bool = False, hide_broad: bool = False, sort: str = "delta_median") -> DataFrame:
    """Rows whose symbol holds the text, in the order of the chosen column."""
    out = results.where(F.contains(F.lower("gene"), F.lit(text.lower())))
    if fdr_only:
        out = out.where("fdr_0_05")
    if hide_broad:
        out = out.where("NOT broad_dependency_warning")
    return out.orderBy(F.col(sort).asc_nulls_last(), "gene")


def exploratory_top(results: DataFrame, k: int = 100) -> DataFrame:
    """The k lowest deltas of each comparison among genes that are neither broad nor low in samples, with their rank."""
    ok = results.where("NOT broad_dependency_warning AND NOT low_sample AND delta_median IS NOT NULL")
    w = W.partitionBy("cancer_id", "comparison_type").orderBy("delta_median", "gene")
    return ok.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("cancer_id", "comparison_type", "gene", "rank", "delta_median")


def cross_context_recurrence(top: DataFrame) -> DataFrame:
    """Of each gene in several top lists: how many and which, best and mean rank, mean delta."""
    label = F.concat_ws(" ", "cancer_id", "comparison_type")
    return top.groupBy("gene").agg(F.count_distinct(label).alias("comparisons_n"), F.array_join(F.array_sort(F.collect_set(label)), "; ").alias("comparisons"), F.min("rank").alias("best_rank"), F.round(F.avg("rank"), 2).alias("mean_rank"), F.round(F.avg("delta_median"), 4).alias("mean_delta"))


def recurrent_candidates(recurrence: DataFrame, least: int = 2) -> DataFrame:
    return recurrence.where(F.col("comparisons_n") >= least)


def pair_evidence_join(pairs: DataFrame, statistics: DataFrame, members: DataFrame, comparison: str = "primary") -> DataFrame:
    """Each pair with its statistics; a pair whose cohort is empty stays, with counts of 0 and null statistics. q is over all pairs together."""
    n = members.where(F.col("comparison_type") == comparison).groupBy("cancer_id").agg(*(F.count_if(F.col("analysis_group") == g).alias(f"{g}_members_n") for g in ("context", "comparator")))
    s = statistics.where(F.col("comparison_type") == comparison).drop("comparison_type")
    counts = [c for c in s.columns if c.endswith("_n")]
    out = pairs.join(s, ["cancer_id", "gene"], "left").join(n, "cancer_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"performed": F.coalesce("performed", F.lit(False)), "low_sample": F.coalesce("low_sample", F.lit(True))})
    out = out.withColumns({f"{g}_models_n": F.coalesce(f"{g}_members_n", F.lit(0)) for g in ("context", "comparator")}).drop("context_members_n", "comparator_members_n")
    return S.bh_qvalues(out.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


def pair_comparison_expand(pairs: DataFrame, eligible: DataFrame, comparisons: Sequence[str] = ("wildtype", "other-driver")) -> DataFrame:
    """The pairs of eligible contexts, once for each comparison, under an id that names it."""
    kind = F.explode(F.array(*(F.lit(c) for c in comparisons)))
    p = pairs.join(eligible.select("cancer_id").distinct(), "cancer_id", "left_semi").withColumn("comparison_type", kind)
    return p.withColumn("sensitivity_id", F.concat_ws("|", "evidence_id", "comparison_type"))


def symbol_union_distinct(*frames: DataFrame) -> DataFrame:
    """The distinct genes of some frames."""
    out = frames[0].select("gene")
    for f in frames[1:]:
        out = out.union(f.select("gene"))
    return out.where("gene IS NOT NULL").distinct()
