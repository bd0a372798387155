"""The columns and types of every table that a job gives, for `write_table`. A table that has drifted from its contract is refused.

Ids of models are text in files, whatever type a job has read. Score columns of association rows follow the datatypes asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortmill.sources.tables import write_table

QC = "severity string, check string, entity_id string, field string, observed string, expected string"
COUNTS = "job string, counter string, n long"
PROVENANCE = "entity_type string, entity_id string, field_name string, value string, source_name string, source_release string, evidence_nature string, parser_version string, raw_file string, raw_record_hash string"
_N = ", ".join(f"{g}_{x}_n long" for g in ("context", "comparator") for x in ("effect", "prob", "models", "missing", "dependent"))
_V = ", ".join(f"{g}_{x} double" for g in ("context", "comparator") for x in ("median", "mean", "iqr", "min", "max", "dependency_fraction"))
STATISTICS = f"{_N}, {_V}, delta_median double, u1 double, ties double, performed boolean, test string, z double, p_value double, q_value double, cliffs_delta double, low_sample boolean"
BACKGROUND = "broad_n long, broad_dependency_fraction double, all_median_effect double, broad_dependency_warning boolean"
_PAIR = "evidence_id string, cancer_id string, target_id string, gene string"
_MEMBER = "model_id string, name string, sequenced boolean, molecular_status string, assigned_group string, reason string, qualifying array<string>, other array<string>"
_VALIDATION = "cancer_id string, resolved_id string, name_match boolean, id_changed boolean, status string"
_RECURRENCE = "gene string, comparisons_n long, comparisons string, best_rank int, mean_rank double, mean_delta double"

CONTRACTS: dict[str, dict[str, str]] = {
    "normalize_targets": {
        "identities": "target_id string, input_symbol string, existing_ensembl_gene_id string, mapping_status string, notes string, hgnc_symbol string, hgnc_id string, hgnc_status string, ensembl_gene_id string, ncbi_gene_id string, uniprot_id string, aliases array<string>, previous_symbols array<string>, record_hash string",
        "status": "mapping_status string, n long", "provenance": PROVENANCE,
    },
    "validate_diseases": {"resolved": "cancer_id string, disease_id string, expected_disease_name string, resolved_id string, resolved_name string, resolution_method string, id_changed boolean, resolution_error string", "validation": _VALIDATION},
    "associations": {
        "rows": f"{_PAIR}, target_ensembl_id string, disease_id string, association_found boolean, association_score double, datatype_scores_json string, datasource_scores_json string, tractability array<struct<label:string,modality:string,value:boolean>>, tractability_json string",
        "validation": _VALIDATION, "provenance": PROVENANCE,
    },
    "validate_inputs": {
        "diagnostics": "cancer_id string, " + ", ".join(f"{x}_n long" for x in ("matched", "sequenced", "defining_present", "defining_absent", "ambiguous", "unsequenced", "context", "comparator", "excluded")),
        "feasibility": "cancer_id string, feasible boolean",
    },
    "pair_evidence": {"evidence": f"{_PAIR}, {STATISTICS}, {BACKGROUND}", "audit": f"cancer_id string, {_MEMBER}", "provenance": PROVENANCE},
    "sensitivity": {"rows": f"{_PAIR}, comparison_type string, sensitivity_id string, {STATISTICS}", "audit": f"cancer_id string, target_label string, {_MEMBER}", "provenance": PROVENANCE},
    "genomewide": {"results": f"cancer_id string, comparison_type string, gene string, entrez string, {STATISTICS}, {BACKGROUND}, fdr_0_05 boolean", "summary": "cancer_id string, comparison_type string, genes_n long, fdr_n long, broad_n long, context_models_n long, comparator_models_n long"},
    "recurrence": {"top": "cancer_id string, comparison_type string, gene string, rank int, delta_median double", "recurrence": _RECURRENCE, "recurrent": _RECURRENCE, "core": _RECURRENCE},
}
for _tables in CONTRACTS.values():
    _tables["counts"] = COUNTS
for _job in ("normalize_targets", "validate_diseases", "associations", "validate_inputs", "pair_evidence", "sensitivity", "genomewide"):
    CONTRACTS[_job]["qc"] = QC


def contract(job: str, table: str, datatypes: Sequence[str] = ()) -> str:
    """The contract of a table; the scores of some datatypes belong to the rows of associations."""
    return ", ".join([CONTRACTS[job][table], *(f"score_{d} double" for d in datatypes if (job, table) == ("associations", "rows"))])


def write_job(job: str, tables: dict[str, DataFrame], path: str, datatypes: Sequence[str] = (), mirror: bool = False) -> list[str]:
    """Writes every table of a job under path/job/table, each as its contract has it; gives their names."""
    for name, df in tables.items():
        write_table(df, f"{path}/{job}/{name}", mirror=mirror, contract=contract(job, name, datatypes))
    return sorted(tables)
