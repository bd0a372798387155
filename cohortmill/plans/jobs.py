"""End-to-end jobs: each takes DataFrames and gives named result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortmill.operators import assoc as A
from cohortmill.operators import cohorts as C
from cohortmill.operators import identity as I
from cohortmill.operators import ontology as O
from cohortmill.operators import provenance as P
from cohortmill.operators import qc as Q
from cohortmill.operators import screen as R
from cohortmill.operators import stats as S
from cohortmill.plans import bind as B
from cohortmill.sources import tables as T

Tables = dict[str, DataFrame]
IDENTITY_FIELDS = ("input_symbol", "hgnc_symbol", "hgnc_id", "hgnc_status", "ensembl_gene_id", "ncbi_gene_id", "uniprot_id", "mapping_status", "record_hash", "notes")
#: Source, nature and file of each field of the evidence of a pair.
EVIDENCE_FIELDS = (
    {c: ("effects", "Derived", "effects.csv") for c in ("delta_median", "cliffs_delta", "p_value", "q_value")} | {"context_median": ("effects", "Observed", "effects.csv"), "context_effect_n": ("effects", "Observed", "effects.csv")}
    | {"context_models_n": ("models and profiles", "Derived", "models.csv"), "context_dependency_fraction": ("probabilities", "Observed", "probabilities.csv"), "broad_dependency_fraction": ("probabilities", "Derived", "probabilities.csv")}
)
#: Those of a comparison of sensitivity; no background belongs to it.
SENSITIVITY_FIELDS = {k: v for k, v in EVIDENCE_FIELDS.items() if k != "broad_dependency_fraction"}


def kept(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Written to the shared folder and read again: what several results are taken from is computed once, and survives lost executors. Rows and whatever else is asked for are counted while they are written."""
    path, seen = T.shared_path(df.sparkSession, "stage"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counts.items())).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def cached(df: DataFrame) -> DataFrame:
    return kept(df)[0]


def checked(findings: DataFrame, check: str, gate: bool, unless: tuple[str, ...] = ("ERROR", "WARNING")) -> tuple[DataFrame, dict[str, int]]:
    """The findings written once, with a record that all passed if none has one of the severities, and their number by severity. With `gate`, any finding of severity ERROR ends the job."""
    rows, n = kept(findings, **{s: F.count_if(F.col("severity") == s) for s in ("ERROR", "WARNING", "INFO")})
    if gate and n["ERROR"]:
        worst = rows.where("severity = 'ERROR'").orderBy("check", "entity_id").limit(5).collect()
        raise ValueError(f"{check}: {n['ERROR']} errors: " + "; ".join(f"{r['check']} {r['entity_id']}" for r in worst))
    if not sum(n[s] for s in unless):
        rows = rows.unionByName(findings.sparkSession.createDataFrame([tuple(Q.passed(check)[f] for f in Q.FIELDS)], ", ".join(f"{f} string" for f in Q.FIELDS)))
    return rows, {"qc_errors": n["ERROR"], "qc_warnings": n["WARNING"]}


def run_counts(spark: SparkSession, job: str, **n: int) -> DataFrame:
    """What a run counted, as a table."""
    return spark.createDataFrame([(job, k, int(v)) for k, v in n.items()], "job string, counter string, n long")


def job_normalize_targets(seeds: DataFrame, dictionary: DataFrame, withdrawn: DataFrame, release: str = "r1", gate: bool = False) -> Tables:
    ids, n = kept(I.normalize_targets(seeds, dictionary, withdrawn))
    qc, found = checked(Q.target_findings(seeds, ids), "target_normalization", gate, ("ERROR", "WARNING", "INFO"))
    src = ("dictionary", "Observed", "dictionary.tsv")
    provenance = P.unpivot_fields(ids, "target", "target_id", {f: src for f in IDENTITY_FIELDS}, release, "1", "record_hash")
    return {"identities": ids, "qc": qc, "status": I.mapping_status_counts(ids), "provenance": provenance, "counts": run_counts(ids.sparkSession, "normalize_targets", identities=n["rows"], **found)}


def job_validate_diseases(mappings: DataFrame, ontology: DataFrame, gate: bool = False) -> Tables:
    resolved, n = kept(O.disease_resolve(mappings, ontology))
    qc, found = checked(Q.qc_disease_mapping(resolved), "disease_mapping", gate)
    return {"resolved": resolved, "validation": O.disease_validate(resolved), "qc": qc, "counts": run_counts(resolved.sparkSession, "validate_diseases", mappings=n["rows"], **found)}


def job_associations(pairs: DataFrame, identities: DataFrame, mappings: DataFrame, ontology: DataFrame, assoc: DataFrame, tractability: DataFrame | None, datatypes: list[str], expected: int, release: str = "r1", gate: bool = False) -> Tables:
    """From landed pages or a bulk export. The mapping's findings stand beside the rows' own; the record that all passed speaks of the rows."""
    resolved = cached(O.disease_resolve(mappings, ontology))
    rows = A.pair_association_join(pairs, identities, resolved, assoc, datatypes)
    rows = A.attach_tractability(rows, tractability) if tractability is not None else rows
    rows, n = kept(rows, found=F.count_if("association_found"))
    validation = O.disease_validate(resolved)
    record = F.to_json(F.struct(F.col("disease_id").alias("configured_id"), "resolved_id", F.col("resolved_name").alias("name"), "resolution_method"))
    # of each context six fields of its mapping, two of them found and the others given, and a record of its validation
    mapped = resolved.select("cancer_id", F.col("disease_id").alias("configured_disease_id"), F.col("resolved_id").alias("resolved_disease_id"), "resolution_method", *(F.col(c).cast("string").alias(c) if c in resolved.columns else F.lit(None).cast("string").alias(c) for c in ("mapping_scope", "mapping_confidence", "rationale")), record.alias("disease_validation"))
    found = ("resolved_disease_id", "resolution_method", "disease_validation")
    own = {c: ("disease mapping", "Observed" if c in found else "Inferred", "mappings.tsv") for c in mapped.columns if c != "cancer_id"}
    scores = {c: ("associations", "Aggregated evidence", "pages.json") for c in ("association_score", *(f"score_{d}" for d in datatypes))} | ({"tractability_json": ("associations", "Aggregated evidence", "tractability.json")} if tractability is not None else {})
    provenance = P.unpivot_fields(rows, "cancer_target_pair", "evidence_id", scores, release, "1").unionByName(P.unpivot_fields(mapped, "cancer_context", "cancer_id", own, release, "1"))
    qc, own_n = checked(Q.association_findings(rows, expected, n=n["rows"]), "associations", gate)
    more, map_n = checked(Q.qc_disease_mapping(resolved), "disease_mapping", gate, ("ERROR", "WARNING", "INFO"))
    more = more if map_n["qc_errors"] + map_n["qc_warnings"] else more.limit(0)
    n = run_counts(rows.sparkSession, "associations", pairs=n["rows"], found=n["found"], **{k: own_n[k] + map_n[k] for k in own_n})
    return {"rows": rows, "validation": validation, "qc": qc.unionByName(more), "provenance": provenance, "counts": n}


def job_validate_inputs(models: DataFrame, profiles: DataFrame, matrix_genes: DataFrame, pairs: DataFrame, audit: DataFrame, gate: bool = False, events: DataFrame | None = None, contexts=(), flags=(), rejected: DataFrame | None = None) -> Tables:
    """`rejected` holds what the readers could not read (`rejections`, `matrix_rejections`)."""
    d = cached(C.cohort_diagnostics(audit))
    qc, found = checked(Q.input_findings(models, profiles, matrix_genes, pairs, d, events=events, contexts=contexts, flags=flags, rejected=rejected), "inputs", gate)
    return {"qc": qc, "diagnostics": d, "feasibility": d.select("cancer_id", (F.col("context_n") > 0).alias("feasible")), "counts": run_counts(d.sparkSession, "validate_inputs", **found)}


def job_pair_evidence(pairs: DataFrame, cells: DataFrame, members: DataFrame, audit: DataFrame, release: str = "r1", gate: bool = False) -> Tables:
    """Only the genes of the pairs are compared; q is over the whole table of pairs."""
    genes = R.symbol_union_distinct(pairs)
    c = cells.join(genes, "gene", "left_semi")
    primary = members.where("comparison_type = 'primary'")
    statistics, background = R.screen_statistics(c, primary, cached)
    rows, n = kept(R.pair_evidence_join(pairs, statistics.join(background, "gene"), members))
    audit, audit_n = kept(audit)
    qc, found = checked(Q.evidence_findings(rows, audit, pairs.count(), n["rows"]), "pair_analysis", gate)
    n = run_counts(rows.sparkSession, "pair_evidence", evidence=n["rows"], audit=audit_n["rows"], **found)
    return {"evidence": rows, "audit": audit, "qc": qc, "provenance": P.unpivot_fields(rows, "cancer_target_evidence", "evidence_id", EVIDENCE_FIELDS, release, "1"), "counts": n}


def job_sensitivity(pairs: DataFrame, cells: DataFrame, members: DataFrame, split: DataFrame, release: str = "r1", gate: bool = False) -> Tables:
    """Pairs of eligible contexts against both other cohorts; q is over all rows together."""
    split, audit_n = kept(split)
    expanded, expected = kept(R.pair_comparison_expand(pairs, split))
    own = cached(R.matrix_select_models(cells, members.where("comparison_type <> 'primary'")))
    s = cached(R.gene_statistics(own, members))
    n = members.groupBy("cancer_id", "comparison_type").agg(*(F.count_if(F.col("analysis_group") == g).alias(f"{g}_members_n") for g in ("context", "comparator")))
    out = expanded.join(s, ["cancer_id", "comparison_type", "gene"], "left").join(n, ["cancer_id", "comparison_type"], "left")
    counts = [c for c in s.columns if c.endswith("_n")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"performed": F.coalesce("performed", F.lit(False)), "low_sample": F.coalesce("low_sample", F.lit(True))})
    out = cached(out.withColumns({f"{g}_models_n": F.coalesce(f"{g}_members_n", F.lit(0)) for g in ("context", "comparator")}).drop("context_members_n", "comparator_members_n"))
    rows, n = kept(S.bh_qvalues(out.withColumn("_all", F.lit(1)), ["_all"]).drop("_all"))
    qc, found = checked(Q.sensitivity_findings(rows, split, expected["rows"], n["rows"]), "sensitivity_analysis", gate)
    provenance = P.unpivot_fields(rows, "cancer_target_sensitivity", "sensitivity_id", SENSITIVITY_FIELDS, release, "1")
    return {"rows": rows, "audit": split, "qc": qc, "provenance": provenance, "counts": run_counts(rows.sparkSession, "sensitivity", evidence=n["rows"], expected=expected["rows"], audit=audit_n["rows"], **found)}


def job_genomewide(cells: DataFrame, members: DataFrame, genes: DataFrame | None = None, gate: bool = False) -> Tables:
    """All contexts and comparisons in one pass."""
    results, n = kept(R.genomewide_screen(cells, members, genes, cached), low_sample=F.count_if("low_sample"), fdr=F.count_if("fdr_0_05"), broad=F.count_if("broad_dependency_warning"))
    qc, found = checked(Q.qc_screen(results), "screen_analysis", gate, ("ERROR", "WARNING", "INFO"))
    return {"results": results, "qc": qc, "summary": R.screen_summary(results), "counts": run_counts(results.sparkSession, "genomewide", **n, **found)}


def job_recurrence(results: DataFrame, k: int = 100) -> Tables:
    top, n = kept(R.exploratory_top(results, k))
    rec = cached(R.cross_context_recurrence(top))
    return {"top": top, "recurrence": rec, "recurrent": R.recurrent_candidates(rec, 2), "core": R.recurrent_candidates(rec, 3), "counts": run_counts(top.sparkSession, "recurrence", top=n["rows"])}


# ---- the jobs on the bound test tables ----------------------------------------------------------------------------


def screen_tables(spark: SparkSession, sf: str) -> Tables:
    return job_genomewide(cached(B.cells(spark, sf)), cached(B.members(spark, sf)))


def sensitivity_tables(spark: SparkSession, sf: str) -> Tables:
    """Members of the primary comparison have no part in it, so the split, made once, gives all that it needs."""
    split = cached(B.split(spark, sf))
    members = C.membership(*(C.cohort_project(split, c) for c in ("wildtype", "other-driver")))
    return job_sensitivity(B.pairs(spark, sf), cached(B.cells(spark, sf)), cached(members), split)
