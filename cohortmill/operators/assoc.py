"""Association evidence joined onto curated pairs; an absent association is not a score of zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions.scalars import score_get, score_map, sorted_json


def pair_association_join(pairs: DataFrame, identities: DataFrame, resolved: DataFrame, assoc: DataFrame, datatypes: Sequence[str]) -> DataFrame:
    """Each pair with its target's id, its context's resolved disease and their association: association_found, association_score, one column for each datatype, all scores as JSON."""
    ids = identities.select("target_id", F.col("ensembl_gene_id").alias("target_ensembl_id"))
    dis = resolved.select("cancer_id", F.col("resolved_id").alias("disease_id"))
    a = assoc.select(F.col("disease_id").alias("_d"), F.col("target_id").alias("_t"), "score", "datatype_scores", "datasource_scores")
    j = pairs.join(ids, "target_id", "left").join(dis, "cancer_id", "left")
    j = j.join(a, (j["disease_id"] == a["_d"]) & (j["target_ensembl_id"] == a["_t"]), "left").withColumn("_m", score_map(F.col("datatype_scores")))
    return j.select(*pairs.columns, "target_ensembl_id", "disease_id", F.col("_t").isNotNull().alias("association_found"), F.col("score").alias("association_score"), *(score_get(F.col("_m"), [d]).alias(f"score_{d}") for d in datatypes), sorted_json(F.col("_m")).alias("datatype_scores_json"), sorted_json(score_map(F.col("datasource_scores"))).alias("datasource_scores_json"))


def attach_tractability(rows: DataFrame, tractability: DataFrame) -> DataFrame:
    """`rows` with the list of tractability records of each target, and the same as JSON; an empty list where there is none."""
    t = tractability.groupBy("target_ensembl_id").agg(F.array_sort(F.collect_list(F.struct("label", "modality", "value"))).alias("tractability"))
    empty = F.array().cast("array<struct<label:string,modality:string,value:boolean>>")
    out = rows.join(t, "target_ensembl_id", "left").withColumn("tractability", F.coalesce("tractability", empty))
    return out.withColumn("tractability_json", F.to_json("tractability"))
