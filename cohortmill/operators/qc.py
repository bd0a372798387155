"""Quality checks; each gives rows of one schema: severity, check, entity_id, field, observed, expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.operators.cohorts import Context, duplicate_models

FIELDS = ("severity", "check", "entity_id", "field", "observed", "expected")


def _text(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("string")


def finding(when: Column, severity: str, check: str, entity, observed="", expected="", field="") -> Column:
    """A record where `when` holds, else null."""
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*(_text(v).alias(k) for k, v in zip(FIELDS, (severity, check, entity, field, observed, expected)))))


def findings(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """The records of all rules over all rows, in one pass."""
    x = df.select(F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("x"))
    return x.select(*(F.col(f"x.{f}").alias(f) for f in FIELDS))


def duplicates(df: DataFrame, keys: Sequence[str], check: str, severity: str = "ERROR") -> DataFrame:
    return findings_once(df, keys, check, [], severity)


def findings_once(df: DataFrame, keys: Sequence[str], unique: str, rules: Sequence[Column], severity: str = "ERROR") -> DataFrame:
    """The records of all rules, and one for each value of `keys` that stands more than once, from one scan of `df`.

    Each row sends its records and a mark of its keys; equal ones are counted on the way, so a key that stands very often is a
    number. Marks that were counted once are dropped.
    """
    text = {k: F.lit("") for k in FIELDS} | {"check": F.lit(unique), "entity_id": F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), "observed": F.to_json(F.struct(*keys))}
    mark = F.struct(*(text[k].alias(k) for k in FIELDS))
    sent = df.select(F.explode(F.concat(F.array(mark), F.filter(F.array(*rules), lambda r: r.isNotNull()))).alias("x")) if rules else df.select(mark.alias("x"))
    n = sent.select("x.*").groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("_n"))
    is_mark = F.col("severity") == ""
    own = {"severity": F.when(is_mark, severity).otherwise(F.col("severity")), "observed": F.when(is_mark, F.col("_n").cast("string")).otherwise(F.col("observed")), "expected": F.when(is_mark, "1").otherwise(F.col("expected"))}
    times = F.sequence(F.lit(1).cast("long"), F.when(is_mark, F.lit(1).cast("long")).otherwise(F.col("_n")))
    out = n.where(~is_mark | (F.col("_n") > 1)).select(*(own.get(k, F.col(k)).alias(k) for k in FIELDS), F.explode(times))
    return out.select(*FIELDS)


def passed(check: str) -> dict[str, str]:
    """The record of a table without findings."""
    return dict.fromkeys(FIELDS, "") | {"severity": "INFO", "check": check}


def with_all_passed(rows: DataFrame, check: str, unless: Sequence[str] = ("ERROR", "WARNING")) -> DataFrame:
    """`rows`, and one INFO record if none has one of these severities."""
    n = rows.agg(F.count_if(F.col("severity").isin(*unless)).alias("n"))
    return rows.unionByName(findings(n, [finding(F.col("n") == 0, "INFO", check, "")]))


def row_count(df: DataFrame, expected: int, n: int | None = None) -> DataFrame:
    """A record where the number of rows is not the expected one; `n` is the number if it is known, so `df` is not read."""
    known = df.agg(F.count(F.lit(1)).alias("n")) if n is None else df.sparkSession.createDataFrame([(n,)], "n long")
    return findings(known, [finding(F.col("n") != expected, "ERROR", "row_count", "", F.col("n"), expected)])


def qc_severity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def target_findings(seeds: DataFrame, identities: DataFrame) -> DataFrame:
    """`qc_targets` without the record that all passed."""
    old = [c for c in ("existing_uniprot_id", "existing_ensembl_gene_id", "existing_ncbi_gene_id") if c in seeds.columns]
    have = [c for c in old if c not in identities.columns]
    j = identities if not have else identities.join(seeds.select("target_id", *have).dropDuplicates(["target_id"]), "target_id", "left")
    bad = F.col("mapping_status").isin("not_found", "manual_review_required")
    rules = [finding(bad, "ERROR", "mapping_resolved", F.col("target_id"), F.col("mapping_status"), "", "input_symbol"), finding(~bad & (F.lower("hgnc_status") != "approved"), "ERROR", "hgnc_status", F.col("target_id"), F.col("hgnc_status"), "Approved")]
    for c in old:
        new = c.removeprefix("existing_")
        rules.append(finding(~bad & (F.col(c) != "") & (F.col(new) != "") & (F.col(c) != F.col(new)), "WARNING", "existing_identifier_conflict", F.col("target_id"), F.col(c), F.col(new), new))
    return findings_once(j, ["target_id"], "unique_target_id", rules).unionByName(duplicates(identities.where("hgnc_symbol IS NOT NULL"), ["hgnc_symbol"], "unique_hgnc_symbol"))


def qc_targets(seeds: DataFrame, identities: DataFrame) -> DataFrame:
    """Unique ids and symbols; unresolved names, on which nothing more is checked; records that are not approved; ids that differ from the seed's. The pass record needs no finding at all."""
    return with_all_passed(target_findings(seeds, identities), "target_normalization", ("ERROR", "WARNING", "INFO"))


def qc_inputs(models: DataFrame, profiles: DataFrame, matrix_genes: DataFrame, pairs: DataFrame, diagnostics: DataFrame, min_context: int = 5, min_comparator: int = 5, events: DataFrame | None = None, contexts: Sequence[Context] = (), flags: Sequence[str] = (), rejected: DataFrame | None = None) -> DataFrame:
    """Unique models, metadata and profile columns, genes of the pairs in the matrix, and for each context whether it can be studied.

    With `events`: whether they name the changes that rules of `contexts` ask for (else how many are of their genes), and whether any of the driver columns `flags` is there.
    With `rejected` (source, kind, field, n of the readers): what could not be read.
    """
    out = input_findings(models, profiles, matrix_genes, pairs, diagnostics, min_context, min_comparator, events, contexts, flags, rejected)
    return with_all_passed(out, "inputs")


def input_findings(models: DataFrame, profiles: DataFrame, matrix_genes: DataFrame, pairs: DataFrame, diagnostics: DataFrame, min_context: int = 5, min_comparator: int = 5, events: DataFrame | None = None, contexts: Sequence[Context] = (), flags: Sequence[str] = (), rejected: DataFrame | None = None) -> DataFrame:
    """`qc_inputs` without the record that all passed."""
    out = findings(duplicate_models(models), [finding(F.lit(True), "ERROR", "model_id_unique", F.col("model_id"), F.col("n"), "1")])
    known = [c for c in ("code", "subtype", "primary_disease", "lineage") if c in models.columns]
    n = profiles.agg(F.count_distinct("model_id").alias("n"))
    out = out.unionByName(findings(n, [finding(F.lit(not known), "ERROR", "disease_columns", "models"), finding(F.col("n") == 0, "ERROR", "profiles", "profiles", F.col("n"), ">0"), finding(F.col("n") > 0, "INFO", "profiles", "profiles", F.col("n"), ">0"), finding(F.lit("is_default" not in profiles.columns), "WARNING", "default_flag", "profiles")]))
    out = out.unionByName(findings(pairs.select("gene").distinct().join(matrix_genes, "gene", "left_anti"), [finding(F.lit(True), "ERROR", "matrix_has_gene", F.col("gene"))]))
    if events is not None:
        genes = sorted({x.gene.upper() for c in contexts for x in c.rules})
        lacks = "change" not in events.columns and any(x.changes for c in contexts for x in c.rules)
        own = events.where(F.upper(F.trim("gene")).isin(genes)).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(findings(own, [finding(F.lit(lacks), "ERROR", "event_change_column", "events", "not found", "change"), finding(F.lit(not lacks), "INFO", "event_columns", "events", F.col("n"), "relevant rows"), finding(F.lit(not any(f in events.columns for f in flags)), "WARNING", "event_driver_flags", "events", "none", "driver columns")]))
    if rejected is not None:
        out = out.unionByName(findings(rejected, [finding(F.col("n") > 0, "WARNING", "rejected_records", F.col("source"), F.col("n"), 0, F.concat_ws(":", "kind", "field"))]))
    c, r, who = F.col("context_n"), F.col("comparator_n"), F.col("cancer_id")
    return out.unionByName(findings(diagnostics, [
        finding(c == 0, "ERROR", "context_feasible", who, c, ">0"), finding(r == 0, "WARNING", "comparator_feasible", who, r, ">0"),
        finding((c > 0) & (c < min_context), "WARNING", "context_size", who, c, min_context), finding((r > 0) & (r < min_comparator), "WARNING", "comparator_size", who, r, min_comparator),
        finding(F.lit(True), "INFO", "context_models", who, F.concat_ws("/", c.cast("string"), r.cast("string"), F.col("excluded_n").cast("string"))),
    ]))


def _range(col: str, check: str, entity: Column) -> Column:
    return finding((F.col(col) < 0) | (F.col(col) > 1), "ERROR", check, entity, F.round(F.col(col), 6), "0..1", col)


def _statistics(entity: Column) -> list[Column]:
    return [
        finding(F.col("performed") & (F.col("p_value").isNull() | F.col("q_value").isNull()), "ERROR", "statistics_complete", entity, "", "both p and q"),
        finding(~F.col("performed") & F.col("p_value").isNotNull(), "ERROR", "statistics_consistency", entity, "", "empty"),
    ]


def _sizes() -> Column:
    return F.concat(F.lit("context="), F.col("context_effect_n").cast("string"), F.lit("; comparator="), F.col("comparator_effect_n").cast("string"))


def _audit_findings(audit: DataFrame, unique: str, groups: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Models that stand twice in a context, and groups (name, severity, check) that a context lacks. Both read one grouping of the audit."""
    per = audit.groupBy("cancer_id", "model_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("assigned_group") == g).alias(g) for g, _, _ in groups))
    twice = findings(per, [finding(F.col("n") > 1, "ERROR", unique, F.concat_ws("|", "cancer_id", F.col("model_id").cast("string")), F.col("n"), "1")])
    n = per.groupBy("cancer_id").agg(*(F.sum(g).alias(g) for g, _, _ in groups))
    return twice.unionByName(findings(n, [finding(F.col(g) == 0, severity, check, F.col("cancer_id"), 0, ">0") for g, severity, check in groups]))


def evidence_findings(rows: DataFrame, audit: DataFrame, expected: int, n: int | None = None) -> DataFrame:
    """`qc_evidence` without the record that all passed."""
    e = F.concat_ws("|", "cancer_id", "target_id")
    out = findings_once(rows, ["cancer_id", "target_id"], "unique_cancer_target", [
        finding(F.col("context_models_n") == 0, "ERROR", "context_nonempty", e, 0, ">0"), finding(F.col("comparator_models_n") == 0, "WARNING", "comparator_nonempty", e, 0, ">0"),
        finding(F.col("context_effect_n") == 0, "ERROR", "context_effect_available", e, 0, ">0"), finding(F.col("context_prob_n") == 0, "ERROR", "context_probability_available", e, 0, ">0"),
        finding(F.col("low_sample"), "WARNING", "low_sample_size", e, _sizes(), "minimum sizes"), _range("context_dependency_fraction", "dependency_fraction_range", e), _range("broad_dependency_fraction", "broad_dependency_fraction_range", e), *_statistics(e),
    ])
    return row_count(rows, expected, n).unionByName(out).unionByName(_audit_findings(audit, "context_audit_unique", [("context", "ERROR", "context_audit_has_context")]))


def qc_evidence(rows: DataFrame, audit: DataFrame, expected: int, n: int | None = None) -> DataFrame:
    """Pair evidence: count, uniqueness, cohorts, availability, sizes, ranges and statistics; the audit's uniqueness and contexts."""
    return with_all_passed(evidence_findings(rows, audit, expected, n), "pair_analysis")


def sensitivity_findings(rows: DataFrame, audit: DataFrame, expected: int, n: int | None = None) -> DataFrame:
    """`qc_sensitivity` without the record that all passed."""
    e = F.concat_ws("|", "cancer_id", "target_id", "comparison_type")
    none = (F.col("context_models_n") == 0) | (F.col("context_effect_n") == 0)
    out = findings_once(rows, ["cancer_id", "target_id", "comparison_type"], "unique_sensitivity_comparison", [
        finding(none, "ERROR", "context_available", e, F.col("context_effect_n"), ">0"), finding(F.col("comparator_models_n") == 0, "WARNING", "comparator_nonempty", e, 0, ">0"),
        finding((F.col("comparator_models_n") > 0) & (F.col("comparator_effect_n") == 0), "WARNING", "comparator_effect_available", e, 0, ">0"), finding(F.col("low_sample"), "WARNING", "low_sample_size", e, _sizes(), "minimum sizes"), *_statistics(e),
    ])
    groups = [(g, s, f"audit_{g}_nonempty") for g, s in (("target_variant", "ERROR"), ("wildtype_proxy", "WARNING"), ("other_driver_hotspot", "WARNING"))]
    return row_count(rows, expected, n).unionByName(out).unionByName(_audit_findings(audit, "audit_unique", groups))


def qc_sensitivity(rows: DataFrame, audit: DataFrame, expected: int, n: int | None = None) -> DataFrame:
    """Sensitivity evidence: as for pairs, by comparison; and which groups each context has."""
    return with_all_passed(sensitivity_findings(rows, audit, expected, n), "sensitivity_analysis")


def qc_screen(results: DataFrame) -> DataFrame:
    """A few records for each comparison, however many genes it has."""
    twice = results.groupBy("cancer_id", "comparison_type", "gene").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("cancer_id", "comparison_type").agg(F.count(F.lit(1)).alias("dup"))
    fr = ("context_dependency_fraction", "comparator_dependency_fraction", "broad_dependency_fraction")
    g = results.groupBy("cancer_id", "comparison_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("context_models_n").alias("c"), F.max("comparator_models_n").alias("r"), *(F.count_if((F.col(x) < 0) | (F.col(x) > 1)).alias(f"out_{x}") for x in fr),
        F.count_if(F.col("performed") & (F.col("p_value").isNull() | F.col("q_value").isNull())).alias("open"), F.count_if(F.col("p_value").isNotNull() | F.col("q_value").isNotNull()).alias("tested"),
        F.count_if("low_sample").alias("low"), F.count_if("fdr_0_05").alias("fdr"), F.count_if("broad_dependency_warning").alias("broad"),
    ).join(twice, ["cancer_id", "comparison_type"], "left")
    e = F.concat_ws("|", "cancer_id", "comparison_type")
    rules = [
        finding(F.col("dup") > 0, "ERROR", "gene_symbol_unique", e, F.col("dup"), 0), finding(F.col("c") == 0, "ERROR", "context_nonempty", e, 0, ">0"), finding(F.col("r") == 0, "WARNING", "comparator_nonempty", e, 0, ">0"),
        *(finding(F.col(f"out_{x}") > 0, "ERROR", "dependency_fraction_range", e, F.col(f"out_{x}"), 0, x) for x in fr), finding(F.col("open") > 0, "ERROR", "statistics_complete", e, F.col("open"), 0),
        finding((F.col("r") == 0) & (F.col("tested") > 0), "ERROR", "descriptive_mode_statistics", e, F.col("tested"), 0), finding(F.col("low") > 0, "WARNING", "low_sample_size", e, F.concat_ws("/", F.col("low").cast("string"), F.col("n").cast("string")), 0),
        finding(F.lit(True), "INFO", "genes_analyzed", e, F.col("n"), ">0"), finding(F.lit(True), "INFO", "fdr_hits", e, F.col("fdr")), finding(F.lit(True), "INFO", "broad_dependency_flags", e, F.col("broad")),
        finding((F.coalesce("dup", F.lit(0)) == 0) & (F.col("c") > 0) & (F.col("r") > 0) & (F.col("open") == 0) & (F.col("low") == 0) & (sum(F.col(f"out_{x}") for x in fr) == 0), "INFO", "screen_analysis", e),
    ]
    return findings(g, rules)


def association_findings(rows: DataFrame, expected: int, prefix: str = "ENSG", json_cols: Sequence[str] = ("datatype_scores_json", "datasource_scores_json", "tractability_json"), n: int | None = None) -> DataFrame:
    """`qc_associations` without the record that all passed."""
    e = F.col("evidence_id")
    broken = F.lit(False)
    for c in (x for x in json_cols if x in rows.columns):
        broken = broken | (F.col(c).isNotNull() & F.try_parse_json(c).isNull())
    claim = F.col("context_encoded") if "context_encoded" in rows.columns else F.lit(False)
    out = findings_once(rows, ["cancer_id", "target_id"], "unique_cancer_target", [
        finding(~F.startswith(F.coalesce("target_ensembl_id", F.lit("")), F.lit(prefix)), "ERROR", "target_identifier", F.col("target_id"), F.col("target_ensembl_id"), prefix),
        finding((F.col("association_score") < 0) | (F.col("association_score") > 1), "ERROR", "association_score_range", e, "", "0..1"), finding(claim, "WARNING", "molecular_context_claim", e, "true", "false"),
        finding(~F.col("association_found"), "INFO", "association_absent", e, "false", ""), finding(broken, "ERROR", "json_serialization", e, "invalid", "valid"),
    ])
    return row_count(rows, expected, n).unionByName(out)


def qc_associations(rows: DataFrame, expected: int, prefix: str = "ENSG", json_cols: Sequence[str] = ("datatype_scores_json", "datasource_scores_json", "tractability_json"), n: int | None = None) -> DataFrame:
    """Association rows: count, uniqueness, target ids, score range, claims of a molecular context, absence, readable JSON."""
    return with_all_passed(association_findings(rows, expected, prefix, json_cols, n), "associations")


def qc_disease_mapping(resolved: DataFrame) -> DataFrame:
    """Unresolved mappings are errors, names and ids that differ are warnings."""
    who, name = F.col("cancer_id"), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ok = F.col("resolved_id").isNotNull()
    return findings(resolved, [
        finding(~ok, "ERROR", "disease_resolution", who, "unresolved", F.col("expected_disease_name"), "disease_id"),
        finding(ok & (name(F.col("resolved_name")) != name(F.col("expected_disease_name"))), "WARNING", "disease_name_validation", who, F.col("resolved_name"), F.col("expected_disease_name"), "disease_name"),
        finding(ok & (F.col("resolved_id") != F.col("disease_id")), "WARNING", "disease_identifier_drift", who, F.col("resolved_id"), F.col("disease_id"), "disease_id"),
    ])
