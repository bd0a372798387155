"""Identifiers by a dictionary of approved, previous, alias and withdrawn names; an ambiguous name is never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.functions.scalars import blank_to_null, first_present, record_hash, split_multi


def _key(c):
    return F.upper(F.trim(c))


def approved_records(dictionary: DataFrame) -> DataFrame:
    """key and the record of each approved symbol; of equal symbols the last row, by the column `row`, wins."""
    d = dictionary.where(blank_to_null(F.col("symbol")).isNotNull())
    rank = F.row_number().over(W.partitionBy(_key(F.col("symbol"))).orderBy(F.desc("row")))
    return d.withColumn("key", _key(F.col("symbol"))).withColumn("_r", rank).where("_r = 1").drop("_r")


def dict_lookup_build(dictionary: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """class, key, symbol: one row for each name a record is known by; a name listed twice counts twice.

    `dictionary` has row, symbol and the lists alias_symbol and prev_symbol; `withdrawn` has withdrawn_symbol and
    merged_into, a list of 'id|symbol|status' separated by commas.
    """
    approved = approved_records(dictionary).select(F.lit("approved").alias("class"), "key", "symbol")
    named = dictionary.where(blank_to_null(F.col("symbol")).isNotNull())
    lists = [named.select(F.lit(k).alias("class"), F.explode(split_multi(F.col(c))).alias("name"), "symbol").select("class", _key(F.col("name")).alias("key"), "symbol") for k, c in (("previous", "prev_symbol"), ("alias", "alias_symbol"))]
    parts = withdrawn.where(blank_to_null(F.col("withdrawn_symbol")).isNotNull()).select(_key(F.col("withdrawn_symbol")).alias("key"), F.explode(split_multi(F.col("merged_into"), ",")).alias("part"))
    into = parts.select(F.lit("withdrawn").alias("class"), "key", blank_to_null(F.get(F.split("part", r"\|"), F.lit(1))).alias("symbol")).where("symbol IS NOT NULL")
    return approved.unionByName(lists[0]).unionByName(lists[1]).unionByName(into)


def _spread(key: str) -> Column:
    """The key for a join that it has to find; nulls, which find nothing, each become a text of their own that no name has, so they don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))


def resolve_symbols(seeds: DataFrame, lookup: DataFrame, symbol_col: str = "input_symbol") -> DataFrame:
    """`seeds` with mapping_status, resolved_symbol and notes.

    Approved names win, then previous ones, then aliases; at the last two several records end the search for manual
    review. A withdrawn name resolves to its only replacement if that is approved. Blank and unknown names are not found.
    """
    agg = lookup.groupBy("key").agg(
        F.max(F.when(F.col("class") == "approved", F.col("symbol"))).alias("a"),
        *(x for k in ("previous", "alias") for x in (F.count(F.when(F.col("class") == k, 1)).alias(f"n_{k}"), F.max(F.when(F.col("class") == k, F.col("symbol"))).alias(f"s_{k}"))),
        F.collect_set(F.when(F.col("class") == "withdrawn", F.col("symbol"))).alias("w"),
    )
    # what a withdrawn name has become is found among the names, so each seed is looked up once
    ok = lookup.where("class = 'approved'").select(F.col("key").alias("_wkey"), F.col("symbol").alias("_wsym"))
    agg = agg.withColumn("_into", F.when(F.size("w") == 1, _key(F.col("w")[0])))
    agg = agg.join(ok, agg["_into"] == ok["_wkey"], "left")
    s = seeds.withColumn("_key", F.nullif(_key(F.col(symbol_col)), F.lit(""))).withColumn("_at", _spread("_key"))
    j = s.join(agg, s["_at"] == agg["key"], "left")
    n_w = F.coalesce(F.size("w"), F.lit(0))
    status = (
        F.when(F.col("_key").isNull(), "not_found")
        .when(F.col("a").isNotNull(), "exact_approved_symbol")
        .when(F.col("n_previous") == 1, "previous_symbol")
        .when(F.col("n_previous") > 1, "manual_review_required")
        .when(F.col("n_alias") == 1, "alias_symbol")
        .when(F.col("n_alias") > 1, "manual_review_required")
        .when((n_w == 1) & F.col("_wsym").isNotNull(), "withdrawn_merged")
        .when(n_w > 0, "manual_review_required")
        .otherwise("not_found")
    )
    j = j.withColumn("mapping_status", status)
    hit = F.when(F.col("mapping_status") == "exact_approved_symbol", F.col("a")).when(F.col("mapping_status") == "previous_symbol", F.col("s_previous")).when(F.col("mapping_status") == "alias_symbol", F.col("s_alias")).when(F.col("mapping_status") == "withdrawn_merged", F.col("_wsym"))
    notes = F.when(F.col("_key").isNull(), "empty symbol").when(F.col("mapping_status") == "manual_review_required", "several candidate records").when(F.col("mapping_status") == "not_found", "no record of this name")
    return j.select(*seeds.columns, "mapping_status", hit.alias("resolved_symbol"), notes.alias("notes"))


def normalize_targets(seeds: DataFrame, dictionary: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Seeds with the record they resolve to: ids, first cross-references, lists and the record's hash; null ids where unresolved."""
    r = resolve_symbols(seeds, dict_lookup_build(dictionary, withdrawn))
    rec = approved_records(dictionary)
    cols = [c for c in dictionary.columns if c != "row"]
    rec = rec.select(F.col("key").alias("_k"), F.col("symbol").alias("hgnc_symbol"), "hgnc_id", F.col("status").alias("hgnc_status"), first_present([F.col("ensembl_gene_id")]).alias("ensembl_gene_id"), first_present([F.col("entrez_id")]).alias("ncbi_gene_id"), first_present([F.col("uniprot_ids")]).alias("uniprot_id"), split_multi(F.col("alias_symbol")).alias("aliases"), split_multi(F.col("prev_symbol")).alias("previous_symbols"), record_hash(cols).alias("record_hash"))
    r = r.withColumn("_of", _key(F.col("resolved_symbol"))).withColumn("_of", _spread("_of"))
    return r.join(rec, r["_of"] == rec["_k"], "left").drop("_k", "_of", "resolved_symbol")


def mapping_status_counts(identities: DataFrame) -> DataFrame:
    return identities.groupBy("mapping_status").agg(F.count(F.lit(1)).alias("n"))
