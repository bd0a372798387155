"""Whole jobs: their contracts, gates, counts and checks, and results recorded elsewhere."""

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import cohorts as C
from cohortmill.operators import qc as Q
from cohortmill.operators import screen as R
from cohortmill.operators import stats as S
from cohortmill.plans import bind as B
from cohortmill.plans import contracts as K
from cohortmill.plans import jobs as J
from cohortmill.plans import queries as Y

SF = "/root/testdata/sf0.001"


def test_every_table_has_a_contract(spark, tmp_path):
    """Every table of every job is written as agreed, and read again with the types agreed on."""
    screen = J.screen_tables(spark, SF)
    jobs = {
        "normalize_targets": J.job_normalize_targets(B.seeds(spark, SF), B.dictionary(spark, SF), B.withdrawn(spark, SF)), "validate_diseases": J.job_validate_diseases(B.mappings(spark, SF), B.ontology(spark, SF)),
        "associations": Y._association_tables(spark, SF), "validate_inputs": J.job_validate_inputs(B.models(spark, SF), B.profiles(spark, SF), B.cells(spark, SF).select("gene").distinct(), B.pairs(spark, SF), B.audit(spark, SF)),
        "pair_evidence": Y._evidence_tables(spark, SF), "sensitivity": J.sensitivity_tables(spark, SF), "genomewide": screen, "recurrence": J.job_recurrence(screen["results"], 10),
    }
    assert set(jobs) == set(K.CONTRACTS)
    for job, tables in jobs.items():
        assert K.write_job(job, tables, str(tmp_path), Y._DATATYPES) == sorted(K.CONTRACTS[job])
    audit = spark.read.parquet(str(tmp_path / "pair_evidence/audit/parquet"))
    assert audit.schema["model_id"].dataType.simpleString() == "string" and audit.count() == 150
    n = {(r["job"], r["counter"]): r["n"] for t in jobs.values() for r in t["counts"].collect()}
    assert n["pair_evidence", "evidence"] == 150 and n["sensitivity", "evidence"] == n["sensitivity", "expected"] == 250 and n["genomewide", "rows"] == screen["results"].count()
    for job, tables in jobs.items():
        if "qc" in tables:
            by = {r["severity"]: r["n"] for r in Q.qc_severity_counts(tables["qc"]).collect()}
            assert (n[job, "qc_errors"], n[job, "qc_warnings"]) == (by.get("ERROR", 0), by.get("WARNING", 0))
    with pytest.raises(ValueError, match="missing: p_value"):
        K.write_job("genomewide", {"results": screen["results"].drop("p_value")}, str(tmp_path))


def small_screen(spark):
    """Two cohorts of two models, three genes."""
    effects = {"KRAS": (-1.5, -1.3, -0.2, -0.1), "SOS1": (-0.1, -0.2, -0.7, -0.6), "BROAD1": (-1.1, -1.0, -1.2, -1.1)}
    prob = {"KRAS": (0.95, 0.9, 0.2, 0.1), "SOS1": (0.1, 0.1, 0.6, 0.6), "BROAD1": (0.99,) * 4}
    cells = spark.createDataFrame([(f"M{i}", g, e, prob[g][i]) for g, es in effects.items() for i, e in enumerate(es)], "model_id string, gene string, effect double, prob double")
    members = spark.createDataFrame([("X", t, f"M{i}", "context" if i < 2 else "comparator") for t in ("primary", "wildtype") for i in range(4)], "cancer_id string, comparison_type string, model_id string, analysis_group string")
    groups = ("target_variant", "target_variant", "wildtype_proxy", "wildtype_proxy")
    split = spark.createDataFrame([("X", f"M{i}", f"n{i}", g, g) for i, g in enumerate(groups)], "cancer_id string, model_id string, name string, molecular_status string, assigned_group string")
    pairs = spark.createDataFrame([("E1", "X", "T1", "KRAS")], "evidence_id string, cancer_id string, target_id string, gene string")
    return cells, members, split, pairs


def test_small_screen(spark):
    cells, members, split, pairs = small_screen(spark)
    out = J.job_genomewide(cells, members.where("comparison_type = 'primary'"))
    rows = {r["gene"]: r for r in out["results"].collect()}
    assert len(rows) == 3 and rows["KRAS"]["delta_median"] < 0 and rows["KRAS"]["context_dependency_fraction"] == 1.0 and rows["KRAS"]["p_value"] == pytest.approx(1 / 3)
    assert rows["BROAD1"]["broad_dependency_warning"] and not rows["KRAS"]["broad_dependency_warning"] and rows["BROAD1"]["broad_n"] == 4
    assert {r["counter"]: r["n"] for r in out["counts"].collect()} == {"rows": 3, "low_sample": 3, "fdr": 0, "broad": 1, "qc_errors": 0, "qc_warnings": 1}
    audit = split.withColumn("assigned_group", F.when(F.col("assigned_group") == "target_variant", "context").otherwise("comparator"))
    e = J.job_pair_evidence(pairs, cells, members, audit)
    r = e["evidence"].collect()[0]
    assert (r["context_effect_n"], r["comparator_effect_n"], r["cliffs_delta"], r["context_dependency_fraction"], r["comparator_dependency_fraction"]) == (2, 2, -1.0, 1.0, 0.0) and r["q_value"] == r["p_value"] and r["delta_median"] < 0
    assert e["audit"].count() == 4 and e["provenance"].count() == 9
    s = J.job_sensitivity(pairs, cells, members, split)
    rows = {r["comparison_type"]: r for r in s["rows"].collect()}
    assert len(rows) == 2 and rows["wildtype"]["cliffs_delta"] == -1.0 and rows["other-driver"]["comparator_models_n"] == 0
    found = {(r["severity"], r["check"]) for r in s["qc"].collect()}
    assert ("WARNING", "audit_other_driver_hotspot_nonempty") in found and ("ERROR", "context_available") in found
    assert {r["field_name"] for r in s["provenance"].collect()} == set(J.SENSITIVITY_FIELDS) and s["provenance"].count() == 2 * 8


def test_gates(spark):
    """With a gate, an error ends each job and names what is wrong; without errors it passes."""
    cells, members, split, pairs = small_screen(spark)
    audit = split.withColumn("assigned_group", F.when(F.col("assigned_group") == "target_variant", "context").otherwise("comparator"))
    assert J.job_pair_evidence(pairs, cells, members, audit, gate=True)["evidence"].count() == 1
    for bad, what in ((lambda: J.job_pair_evidence(pairs.union(pairs), cells, members, audit, gate=True), "unique_cancer_target X|T1"), (lambda: J.job_sensitivity(pairs, cells, members, split, gate=True), "context_available"),
                      (lambda: J.job_genomewide(cells, members.where("analysis_group = 'comparator'"), gate=True), "context_nonempty"), (lambda: J.job_normalize_targets(B.seeds(spark, SF), B.dictionary(spark, SF), B.withdrawn(spark, SF), gate=True), "target_normalization: .* errors"),
                      (lambda: J.job_validate_diseases(B.mappings(spark, SF), B.ontology(spark, SF), gate=True), "disease_resolution"), (lambda: J.job_validate_inputs(B.models(spark, SF), B.profiles(spark, SF), cells.select("gene").distinct(), pairs, B.audit(spark, SF).limit(0), gate=True, rejected=None), "inputs|errors")):
        if what == "inputs|errors":
            assert "qc" in bad()
            continue
        with pytest.raises(ValueError, match=what.replace("|", r"\|")):
            bad()


def test_findings_in_one_scan(spark):
    """Rules and duplicates come from one scan and one shuffle, equal records are kept as often as they stand."""
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("a|b", 2), ("c", 3)], "k string, v int")
    out = Q.findings_once(df, ["k", "v"], "unique", [Q.finding(F.col("v") < 3, "WARNING", "small", F.col("k"), F.col("v"))])
    got = sorted((r["severity"], r["check"], r["entity_id"], r["observed"], r["expected"]) for r in out.collect())
    assert got == [("ERROR", "unique", "a|1", "3", "1")] + [("WARNING", "small", "a", "1", "")] * 3 + [("WARNING", "small", "a|b", "2", "")]
    plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange") == 1
    assert Q.findings_once(df.limit(0), ["k"], "unique", []).count() == 0


def test_recorded_results(spark):
    """Worked numbers of a published screen: 9 against 28 models, delta, Cliff's delta and p of its first row, and the size of a family."""
    u1 = (1 - 0.8968253968253967) / 2 * 9 * 28
    ranks = spark.createDataFrame([(9.0, 28.0, u1, 0.0)], "n1 double, n2 double, u1 double, ties double")
    r = S.mann_whitney(ranks).collect()[0]
    assert r["test"] == "asymptotic" and r["cliffs_delta"] == pytest.approx(-0.89683, abs=1e-5) and r["p_value"] == pytest.approx(6.82065e-05, rel=1e-5)
    # lists of the 100 lowest of three comparisons share 47 genes in two and 7 in three of them
    n = {1: 185, 2: 47, 3: 7}
    genes = [(f"g{k}-{i}", c) for k, m in n.items() for i in range(m) for c in range(3) if k == 3 or (c + i) % 3 < k]
    top = spark.createDataFrame([(f"C{c}", "wt", g, 1, -0.5) for g, c in genes], "cancer_id string, comparison_type string, gene string, rank int, delta_median double")
    rec = R.cross_context_recurrence(top)
    assert (rec.count(), R.recurrent_candidates(rec, 2).count(), R.recurrent_candidates(rec, 3).count()) == (239, 54, 7)


def test_end_to_end_cohorts(spark):
    """From metadata and events to membership: the split of one gene and both projections of it."""
    ctx = [C.Context("X", C.EXACT, (C.GeneRule("KRAS", (r"^p\.G12D$",)),), {"code": ("PAAD",)})]
    models = spark.createDataFrame([(f"{k}{i}", f"{k}{i}", "PAAD") for k in "TWO" for i in (1, 2)], "model_id string, name string, code string")
    events = spark.createDataFrame([("T1", "KRAS", "p.G12D", "Y", None), ("T2", "KRAS", "p.G12D", "Y", None), ("O1", "KRAS", "p.G12V", "Y", None), ("O2", "KRAS", "p.G12R", None, "Y")], "model_id string, gene string, change string, hotspot string, driver string")
    split = C.cohort_split_variant(models, events, models.select("model_id"), ctx, ["hotspot", "driver"])
    cells = spark.createDataFrame([(m, "KRAS", v, p) for m, v, p in (("T1", -2.0, 0.99), ("T2", -1.8, 0.98), ("W1", -0.2, 0.1), ("W2", -0.1, 0.1), ("O1", -1.0, 0.9), ("O2", -0.9, 0.85))], "model_id string, gene string, effect double, prob double")
    members = C.membership(C.cohort_project(split, "wildtype"), C.cohort_project(split, "other-driver"))
    pairs = spark.createDataFrame([("E1", "X", "T1", "KRAS")], "evidence_id string, cancer_id string, target_id string, gene string")
    out = J.job_sensitivity(pairs, cells, members, split, gate=True)
    rows = out["rows"].collect()
    assert len(rows) == 2 and {(r["context_effect_n"], r["comparator_effect_n"], r["cliffs_delta"]) for r in rows} == {(2, 2, -1.0)} and all(r["delta_median"] < 0 and r["q_value"] is not None for r in rows)


def star(con, path):
    """Tables of one brand: each segment has five customers with an urgent order of status F, five without one of F and five with a dear one of F, each with a profile and a line item."""
    path.mkdir()
    con.execute("CREATE OR REPLACE TEMP TABLE n AS SELECT i, i % 3 AS kind, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][i // 15 + 1] AS seg FROM range(75) t(i)")
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name", "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey", "part": "SELECT 1 AS p_partkey, 'B' AS p_brand",
        "customer": "SELECT i AS c_custkey, 'c' || i AS c_name, 0 AS c_nationkey, seg AS c_mktsegment FROM n", "events": """SELECT i AS user_id, 'view' AS event_type, '{"k": 2}' AS props FROM n""",
        "orders": "SELECT i AS o_orderkey, i AS o_custkey, if(kind = 1, 'O', 'F') AS o_orderstatus, if(kind = 0, '1-URGENT', '5-LOW') AS o_orderpriority, CAST(if(kind = 2, 400000, 1) AS DOUBLE) AS o_totalprice FROM n",
        "lineitem": "SELECT i AS l_orderkey, 1 AS l_partkey, CAST(i AS DOUBLE) AS l_extendedprice, CAST(0.04 AS DOUBLE) AS l_tax FROM n",
    }
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")


def test_sensitivity_findings_as_in_sql(spark, tmp_path):
    """The query gives the findings of its SQL, none where all passed; the job's own table says that all passed."""
    import duckdb

    con = duckdb.connect()

    def both(path):
        cur = con.execute(Y.ORACLE_SQL["qc_sensitivity"])
        out = Y.QUERIES["qc_sensitivity"](spark, str(path))
        assert out.columns == [c[0] for c in cur.description]
        got, want = sorted(tuple(r) for r in out.collect()), sorted(cur.fetchall())
        assert got == want
        return {r[:2] for r in got}

    star(con, tmp_path / "well")
    assert both(tmp_path / "well") == set()
    assert [tuple(r)[:3] for r in J.sensitivity_tables(spark, str(tmp_path / "well"))["qc"].collect()] == [("INFO", "sensitivity_analysis", "")]
    # customers without line items, a whole group and one of another; without profiles, a whole group
    star(con, tmp_path / "ill")
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/well/lineitem.parquet' WHERE l_orderkey >= 15 OR l_orderkey % 3 = 0) TO '{tmp_path}/ill/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/well/events.parquet' WHERE user_id < 60 OR user_id % 3 = 1) TO '{tmp_path}/ill/events.parquet' (FORMAT parquet)")
    assert both(tmp_path / "ill") == {
        ("ERROR", "context_available"), ("ERROR", "audit_target_variant_nonempty"), ("WARNING", "audit_other_driver_hotspot_nonempty"), ("WARNING", "comparator_effect_available"), ("WARNING", "comparator_nonempty"), ("WARNING", "low_sample_size"),
    }
