"""Disease mappings against the release of an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _name(c):
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def disease_resolve(mappings: DataFrame, ontology: DataFrame) -> DataFrame:
    """`mappings` with resolved_id, resolved_name, resolution_method, id_changed, resolution_error.

    The configured id stands if the ontology (id, name) has it. Else the terms whose name is exactly the expected one, but
    for case, are looked at: only a single id is taken, and it must stand in the ontology.
    """
    o = ontology.select(F.col("id").alias("_oid"), F.col("name").alias("_oname")).dropDuplicates(["_oid"])
    names = ontology.where("id IS NOT NULL").groupBy(_name(F.col("name")).alias("_n")).agg(F.count_distinct("id").alias("_hits"), F.min("id").alias("_hit"))
    back = ontology.select(F.col("id").alias("_bid"), F.col("name").alias("_bname")).dropDuplicates(["_bid"])
    m = mappings.join(o, mappings["disease_id"] == o["_oid"], "left")
    m = m.join(names, _name(F.col("expected_disease_name")) == names["_n"], "left").withColumn("_hits", F.coalesce("_hits", F.lit(0)))
    m = m.join(back, (F.col("_hits") == 1) & (F.col("_hit") == back["_bid"]), "left")
    own, by_name = F.col("_oid").isNotNull(), F.col("_bid").isNotNull()
    rid = F.when(own, F.col("_oid")).when(by_name, F.col("_bid"))
    return m.select(
        *mappings.columns, rid.alias("resolved_id"), F.when(own, F.col("_oname")).when(by_name, F.col("_bname")).alias("resolved_name"),
        F.when(own, "configured_id").when(by_name, "exact_name").otherwise("unresolved").alias("resolution_method"),
        F.coalesce(rid != F.col("disease_id"), F.lit(False)).alias("id_changed"),
        F.when(~own & ~by_name, F.concat(F.lit("expected one exact name, found "), F.col("_hits").cast("string"))).alias("resolution_error"),
    )


def disease_validate(resolved: DataFrame) -> DataFrame:
    """cancer_id, resolved_id, name_match, id_changed, status: ERROR unresolved, WARNING another name or id, else PASS."""
    match = _name(F.col("resolved_name")) == _name(F.col("expected_disease_name"))
    status = F.when(F.col("resolved_id").isNull(), "ERROR").when(~match | F.col("id_changed"), "WARNING").otherwise("PASS")
    return resolved.select("cancer_id", "resolved_id", match.alias("name_match"), "id_changed", status.alias("status"))
