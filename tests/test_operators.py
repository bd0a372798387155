"""Identity, cohorts, sources and checks on small tables."""

import pytest
from pyspark.sql import functions as F

from cohortmill.functions import scalars as X
from cohortmill.operators import cohorts as C
from cohortmill.operators import identity as I
from cohortmill.operators import ontology as O
from cohortmill.operators import qc as Q
from cohortmill.operators import stats as S
from cohortmill.sources import tables as T

DICT = [("HGNC:6407", "KRAS", "K-Ras|K-RAS2", "KRAS2", "3845", "ENSG00000133703", "P01116"), ("HGNC:3236", "EGFR", "ERBB|ERBB1", "ERBB1", "1956", "ENSG00000146648", "P00533"), ("HGNC:1097", "BRAF", "BRAF1|BRAF-1", "", "673", "ENSG00000157764", "P15056"),
        ("HGNC:9605", "PTGS2", "COX2|COX-2", "", "5743", "ENSG00000073756", "P35354"), ("HGNC:90001", "TESTA", "DUPALIAS", "", "90001", "ENSGTESTA", "PTESTA"), ("HGNC:90002", "TESTB", "DUPALIAS", "", "90002", "ENSGTESTB", "PTESTB")]


def dictionary(spark):
    return spark.createDataFrame([(i, *r, "Approved") for i, r in enumerate(DICT)], "row int, hgnc_id string, symbol string, alias_symbol string, prev_symbol string, entrez_id string, ensembl_gene_id string, uniprot_ids string, status string")


def withdrawn(spark):
    return spark.createDataFrame([("OLDKRAS", "HGNC:6407|KRAS|Approved"), ("OLDSPLIT", "HGNC:6407|KRAS|Approved,HGNC:3236|EGFR|Approved")], "withdrawn_symbol string, merged_into string")


def test_resolver(spark):
    want = {"KRAS": ("exact_approved_symbol", "KRAS"), "KRAS2": ("previous_symbol", "KRAS"), "COX2": ("alias_symbol", "PTGS2"), "OLDKRAS": ("withdrawn_merged", "KRAS"), "DUPALIAS": ("manual_review_required", None), "OLDSPLIT": ("manual_review_required", None), "ERBB1": ("previous_symbol", "EGFR"), "nope": ("not_found", None), "": ("not_found", None)}
    seeds = spark.createDataFrame([(f"T{i}", s) for i, s in enumerate(want)], "target_id string, input_symbol string")
    got = {r["input_symbol"]: (r["mapping_status"], r["resolved_symbol"]) for r in I.resolve_symbols(seeds, I.dict_lookup_build(dictionary(spark), withdrawn(spark))).collect()}
    assert got == want
    ids = I.normalize_targets(seeds.where("input_symbol IN ('KRAS', 'COX2')"), dictionary(spark), withdrawn(spark))
    assert {r["hgnc_symbol"] for r in ids.collect()} == {"KRAS", "PTGS2"}
    assert [r["severity"] for r in Q.qc_targets(seeds, ids).collect()] == ["INFO"]


def cohort(spark, rules, mode, events, models=("1", "2", "3"), profiled=("1", "2"), other=True):
    ctx = C.Context("X", mode, rules, {"code": ("AAA",)}, None, other)
    m = spark.createDataFrame([(x, "n" + x, "AAA") for x in models], "model_id string, name string, code string")
    e = spark.createDataFrame(events, "model_id string, gene string, change string, hotspot string")
    p = spark.createDataFrame([(x,) for x in profiled], "model_id string")
    return m, e, p, [ctx]


def test_cohort_rules(spark):
    got = C.cohort_assign(*cohort(spark, (C.GeneRule("KRAS", (r"^p\.G12D$",)),), C.EXACT, [("1", "KRAS", "p.G12D", ""), ("2", "KRAS", "p.G12C", "")], other=False), ["hotspot"]).collect()
    assert {r["model_id"]: r["assigned_group"] for r in got} == {"1": "context", "2": "comparator", "3": "excluded"}
    by = {r["model_id"]: r for r in got}
    assert by["3"]["molecular_status"] == "unsequenced" and by["3"]["qualifying"] == by["3"]["other"] == []
    assert (by["1"]["molecular_status"], by["1"]["qualifying"], by["1"]["other"]) == ("defining_present", ['{"change":"p.G12D"}'], []) and by["2"]["other"] == ['{"change":"p.G12C"}']
    rules = (C.GeneRule("IDH1", (r"^p\.R132",)), C.GeneRule("IDH2", (r"^p\.R172",)))
    got = C.cohort_assign(*cohort(spark, rules, C.ABSENCE, [("2", "IDH1", "p.R132H", ""), ("3", "IDH1", "p.A100T", "")], profiled=("1", "2", "3"))).collect()
    assert {r["model_id"]: r["assigned_group"] for r in got} == {"1": "context", "2": "comparator", "3": "excluded"}


def test_three_way_split(spark):
    events = [("T", "KRAS", "p.G12D", "Y"), ("O", "KRAS", "p.G12V", "Y"), ("A", "KRAS", "p.M188V", "False"), ("U", "KRAS", "p.G12D", "Y")]
    args = cohort(spark, (C.GeneRule("KRAS", (r"^p\.G12D$",)),), C.EXACT, events, tuple("TOAWU"), tuple("TOAW"))
    rows = {r["model_id"]: r for r in C.cohort_split_variant(*args, flags=["hotspot"]).collect()}
    assert {k: r["assigned_group"] for k, r in rows.items()} == {"T": "target_variant", "O": "other_driver_hotspot", "A": "excluded", "W": "wildtype_proxy", "U": "excluded"}
    assert {k: r["molecular_status"] for k, r in rows.items()} == {"T": "target_variant", "O": "other_driver_hotspot", "A": "ambiguous_variant", "W": "wildtype_proxy", "U": "unsequenced"}
    assert rows["T"]["reason"] == "target variant p.G12D" and rows["T"]["qualifying"] == ['{"change":"p.G12D","hotspot":"Y"}'] and rows["O"]["other"] == ['{"change":"p.G12V","hotspot":"Y"}'] and rows["U"]["qualifying"] == []
    m = args[0]
    with pytest.raises(ValueError, match="duplicate"):
        C.assert_unique_models(m.union(m))
    with pytest.raises(ValueError):
        C.cohort_project(m, "nothing")


def test_profiles_and_flags(spark):
    p = spark.createDataFrame([("ACH-1", "wes", "True"), ("ACH-2", "rna", "True"), ("ACH-3", "wgs", "False"), ("ACH-4", "WGS", "Yes")], "model_id string, datatype string, is_default string")
    assert {r[0] for r in C.profiled_models(p).collect()} == {"ACH-1", "ACH-4"}
    f = spark.createDataFrame([("unlikely",), ("False",), (None,), ("Y",), ("na",)], "f string")
    assert [r[0] for r in f.select(X.driver_signal([F.col("f")])).collect()] == [True, False, False, True, False]


def test_wide_matrix(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("﻿ModelID,KRAS (3845),GENE2 (2),PTPN11\nA,0.9,0.9,\nB,0.2,0.8,nan\nC,0.1,0.7,x\n", encoding="utf-8")
    got = {(r["model_id"], r["gene"]): (r["entrez"], r["value"]) for r in T.read_matrix_long(spark, str(path)).collect()}
    assert got[("A", "KRAS")] == ("3845", 0.9) and got[("B", "PTPN11")] == (None, None) and len(got) == 9
    assert {r["gene"] for r in T.read_matrix_genes(spark, str(path), ["GENE2"]).collect()} == {"GENE2"}
    with pytest.raises(ValueError, match="NOPE"):
        T.read_matrix_genes(spark, str(path), ["NOPE"])
    cells = T.read_matrix_long(spark, str(path)).withColumnRenamed("value", "prob").withColumn("effect", F.lit(0.0))
    broad = {r["gene"]: r for r in S.background_fraction(cells).collect()}
    assert broad["KRAS"]["broad_dependency_fraction"] == pytest.approx(1 / 3) and broad["GENE2"]["broad_dependency_warning"] and broad["PTPN11"]["broad_dependency_fraction"] is None
    path.write_text("ModelID,K,K\nA,1,2\n")
    with pytest.raises(ValueError, match="duplicate"):
        T.read_matrix_long(spark, str(path))


def test_delimited_and_aliases(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("﻿a\tb\n1\t \n2\tx\n", encoding="utf-8")
    df = T.read_delimited(spark, str(path))
    assert [(r["a"], r["b"]) for r in df.orderBy("a").collect()] == [("1", None), ("2", "x")]
    assert T.resolve_aliases(df, {"k": ("z", "a"), "o": ("q",)}, optional=("o",)).columns == ["k", "o"]
    with pytest.raises(ValueError, match="missing"):
        T.resolve_aliases(df, {"k": ("z",)})


def test_ontology(spark):
    o = spark.createDataFrame([("E1", "One"), ("E2", "Two"), ("E3", "Same"), ("E4", "same")], "id string, name string")
    m = spark.createDataFrame([("a", "E1", "one"), ("b", "OLD", " two "), ("c", "OLD", "same"), ("d", "E2", "other"), ("e", "X", "none")], "cancer_id string, disease_id string, expected_disease_name string")
    r = {x["cancer_id"]: x for x in O.disease_resolve(m, o).collect()}
    assert (r["a"]["resolution_method"], r["b"]["resolved_id"], r["b"]["id_changed"]) == ("configured_id", "E2", True)
    assert r["c"]["resolved_id"] is None and r["c"]["resolution_error"].endswith("found 2") and r["e"]["resolution_error"].endswith("found 0")
    assert {x["cancer_id"]: x["status"] for x in O.disease_validate(O.disease_resolve(m, o)).collect()} == {"a": "PASS", "b": "WARNING", "c": "ERROR", "d": "WARNING", "e": "ERROR"}


def test_matrix_quotes_and_headers(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    (d / "a.csv").write_text('ModelID,"K, 1 (7)",G2\n"A",1.5,"2"\n"B, x",,3\n')
    (d / "b.csv").write_text('ModelID,"K, 1 (7)",G2\nC,"4",5\n')
    got = {(r["model_id"], r["gene"]): (r["entrez"], r["value"]) for r in T.read_matrix_long(spark, str(d)).collect()}
    assert got == {("A", "K, 1"): ("7", 1.5), ("A", "G2"): (None, 2.0), ("B, x", "K, 1"): ("7", None), ("B, x", "G2"): (None, 3.0), ("C", "K, 1"): ("7", 4.0), ("C", "G2"): (None, 5.0)}
    (d / "b.csv").write_text("ModelID,G2,K\nC,4,5\n")
    with pytest.raises(ValueError, match="headers"):
        T.read_matrix_long(spark, str(d))


def test_ambiguity_defaults(spark):
    events = [("1", "KRAS", "p.G12C", "")]
    rules = (C.GeneRule("KRAS", (r"^p\.G12D$",)),)
    for mode, want in ((C.EXACT, C.ABSENT), (C.ABSENCE, C.AMBIGUOUS), (C.DRIVER, C.AMBIGUOUS)):
        got = C.cohort_assign(*cohort(spark, rules, mode, events, models=("1",), profiled=("1",), other=None)).collect()
        assert [r["molecular_status"] for r in got] == [want]


def test_input_checks(spark):
    m = spark.createDataFrame([("1", "AAA")], "model_id string, code string")
    p = spark.createDataFrame([("1", "wes")], "model_id string, datatype string")
    g, pairs = spark.createDataFrame([("KRAS",)], "gene string"), spark.createDataFrame([("X", "KRAS")], "cancer_id string, gene string")
    ctx = [C.Context("X", C.EXACT, (C.GeneRule("KRAS", ("G12D",)),))]
    d = spark.createDataFrame([("X", 6, 6, 0)], "cancer_id string, context_n int, comparator_n int, excluded_n int")
    bare = spark.createDataFrame([("1", "KRAS")], "model_id string, gene string")
    found = lambda e, flags: {(r["severity"], r["check"]) for r in Q.qc_inputs(m, p, g, pairs, d, events=e, contexts=ctx, flags=flags).collect()}
    assert {("ERROR", "event_change_column"), ("WARNING", "event_driver_flags"), ("WARNING", "default_flag")} <= found(bare, ["hotspot"])
    full = bare.withColumn("change", F.lit("p.G12D")).withColumn("hotspot", F.lit("Y"))
    got = found(full, ["hotspot"])
    assert ("INFO", "event_columns") in got and not {c for _, c in got} & {"event_change_column", "event_driver_flags"}


def test_association_job(spark):
    from cohortmill.plans import jobs as J

    pairs = spark.createDataFrame([("e1", "c1", "t1"), ("e2", "c1", "t2"), ("e3", "c2", "t1")], "evidence_id string, cancer_id string, target_id string")
    ids = spark.createDataFrame([("t1", "ENSG1"), ("t2", "ENSG2")], "target_id string, ensembl_gene_id string")
    maps = spark.createDataFrame([("c1", "EFO_1", "one", "broad"), ("c2", "OLD", "two", "exact")], "cancer_id string, disease_id string, expected_disease_name string, mapping_scope string")
    onto = spark.createDataFrame([("EFO_1", "One"), ("EFO_2", "Two")], "id string, name string")
    score = "array<struct<id:string,score:double>>"
    assoc = spark.createDataFrame([("EFO_1", "ENSG1", 0.9, [("drug", 0.5)], [("src", 0.25)]), ("EFO_2", "ENSG1", 0.0, [], [])], f"disease_id string, target_id string, score double, datatype_scores {score}, datasource_scores {score}")
    tract = spark.createDataFrame([("ENSG1", "x", "SM", True)], "target_ensembl_id string, label string, modality string, value boolean")
    out = J.job_associations(pairs, ids, maps, onto, assoc, tract, ["drug", "rna"], 3)
    rows = {r["evidence_id"]: r for r in out["rows"].collect()}
    assert [(rows[e]["association_found"], rows[e]["association_score"], rows[e]["score_drug"], rows[e]["score_rna"]) for e in ("e1", "e2", "e3")] == [(True, 0.9, 0.5, None), (False, None, None, None), (True, 0.0, None, None)]
    assert rows["e1"]["datasource_scores_json"] == '{"src":0.25}' and rows["e2"]["tractability_json"] == "[]" and rows["e1"]["tractability_json"] == '[{"label":"x","modality":"SM","value":true}]'
    assert {(r["severity"], r["check"]) for r in out["qc"].collect()} == {("INFO", "association_absent"), ("WARNING", "disease_identifier_drift"), ("INFO", "associations")}
    p = {(r["entity_id"], r["field_name"]): (r["value"], r["evidence_nature"]) for r in out["provenance"].collect()}
    assert len(p) == 3 * 4 + 2 * 7 and p["e2", "association_score"] == (None, "Aggregated evidence") and p["c1", "mapping_scope"] == ("broad", "Inferred") and p["c2", "resolved_disease_id"] == ("EFO_2", "Observed")
    assert p["c2", "disease_validation"][0] == '{"configured_id":"OLD","resolved_id":"EFO_2","name":"Two","resolution_method":"exact_name"}'
    assert {r["cancer_id"]: r["status"] for r in out["validation"].collect()} == {"c1": "PASS", "c2": "WARNING"}


def test_association_checks(spark):
    rows = spark.createDataFrame([("e1", "c", "t", "ENSG1", True, 1.5, "{}"), ("e2", "c", "t", "ENSG1", False, None, "{bad")], "evidence_id string, cancer_id string, target_id string, target_ensembl_id string, association_found boolean, association_score double, datatype_scores_json string")
    got = {(r["severity"], r["check"]) for r in Q.qc_associations(rows, 2).collect()}
    assert got == {("ERROR", "unique_cancer_target"), ("ERROR", "association_score_range"), ("INFO", "association_absent"), ("ERROR", "json_serialization")}


def test_registered(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert e.entry(spark).count() > 0


def test_thousands_of_contexts(spark):
    """The plan is as large for 5000 contexts as for two, and the cohorts are those of each context alone."""
    import random

    rng = random.Random(8)
    codes, genes, modes = [f"C{i}" for i in range(40)], [f"G{i}" for i in range(30)], (C.EXACT, C.ABSENCE, C.DRIVER)
    contexts = [C.Context(f"X{i}", rng.choice(modes), tuple(C.GeneRule(rng.choice(genes), (f"^{rng.choice('ABC')}",), ("odd",) if rng.random() < 0.3 else ()) for _ in range(rng.randint(1, 3))), {rng.choice(("code", "subtype")): tuple(rng.sample(codes, 2))}, ("lineage", rng.choice("ab")) if rng.random() < 0.4 else None, rng.choice((None, True, False))) for i in range(5000)]
    models = [(f"M{i}", f"n{i}", rng.choice(codes).upper(), f" {rng.choice(codes)} ", rng.choice("AB")) for i in range(30)]
    events = [(f"M{rng.randrange(32)}", rng.choice(genes).lower(), rng.choice("ABCD") + str(rng.randrange(9)), rng.choice(("Y", "no", None)), rng.choice(("odd", "even", None))) for _ in range(300)]
    profiled = [m[0] for m in models if rng.random() < 0.8]
    m = spark.createDataFrame(models, "model_id string, name string, code string, subtype string, lineage string")
    e = spark.createDataFrame(events, "model_id string, gene string, change string, hotspot string, note string")
    p = spark.createDataFrame([(x,) for x in profiled], "model_id string")
    size = lambda cs: len(C.cohort_assign(m, e, p, cs, ["hotspot"], ["note"])._jdf.queryExecution().optimizedPlan().toString())
    assert size(contexts) < 1.2 * size(contexts[:2]) + 4000
    want = {}
    for c in contexts:
        for mid, _, code, subtype, lineage in models:
            own = {"code": code.lower(), "subtype": subtype.strip().lower()}
            if not any(own[k] in [v.lower() for v in vs] for k, vs in c.aliases.items()) or (c.lineage and c.lineage[1] != lineage.lower()):
                continue
            there = [x for x in events if x[0] == mid and x[1].upper() in [r.gene for r in c.rules]]
            of = lambda x: [r for r in c.rules if r.gene == x[1].upper()]  # noqa: E731, B023
            hit = lambda x: any(x[2].startswith(r.changes[0][1:]) for r in of(x)) or (c.mode == C.DRIVER and (x[3] == "Y" or any("odd" in r.texts and x[4] == "odd" for r in of(x))))  # noqa: E731, B023
            hits = [x for x in there if hit(x)]
            counts = c.mode != C.EXACT if c.other_ambiguous is None else c.other_ambiguous
            status = C.UNSEQUENCED if mid not in profiled else C.PRESENT if hits else C.AMBIGUOUS if there and counts else C.ABSENT
            seen = mid in profiled
            want[c.cancer_id, mid] = (status, "context" if status == c.context_status else "comparator" if status == c.comparator_status else "excluded", len(hits) * seen, (len(there) - len(hits)) * seen)
    got = {(r["cancer_id"], r["model_id"]): (r["molecular_status"], r["assigned_group"], len(r["qualifying"]), len(r["other"])) for r in C.cohort_assign(m, e, p, contexts, ["hotspot"], ["note"]).collect()}
    assert got == want and len(got) > 5000


def test_rejected_records(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("a\tn\tc\n1\t2.5\tx\n2\n3\tabc\ty\tmore\n4\tNA\tz\n5\t\t\n6\t1e3\tx\n", encoding="utf-8")
    df = T.read_delimited(spark, str(path), rejected="bad")
    got = {r["a"]: (r["n"], r["c"], r["bad"]) for r in df.collect()}
    assert got["1"] == ("2.5", "x", None) and got["2"][2] == "2" and got["3"][2] == "3\tabc\ty\tmore" and got["5"] == (None, None, None) and len(got) == 6
    n = {(r["source"], r["kind"], r["field"]): r["n"] for r in T.rejections(df, "events", "bad", ["n"]).collect()}
    assert n == {("events", "width", ""): 2, ("events", "number", "n"): 1}
    m = tmp_path / "m.csv"
    m.write_text('ModelID,K (1),"G, 2"\nA,1,2\nB,1\nC,1,2,3\nD,odd,NA\n"E, x",,"7"\n')
    assert {r["kind"]: r["n"] for r in T.matrix_rejections(spark, str(m), "effects").collect()} == {"width": 2, "number": 1}
    bad = T.rejections(df, "events", "bad", ["n"])
    models = spark.createDataFrame([("1", "AAA")], "model_id string, code string")
    profiles = spark.createDataFrame([("1", "wes", "true")], "model_id string, datatype string, is_default string")
    d = spark.createDataFrame([("X", 6, 6, 0)], "cancer_id string, context_n int, comparator_n int, excluded_n int")
    genes = spark.createDataFrame([("K",)], "gene string")
    q = Q.qc_inputs(models, profiles, genes, genes.withColumn("cancer_id", F.lit("X")), d, rejected=bad).collect()
    assert {(r["entity_id"], r["field"], r["observed"]) for r in q if r["check"] == "rejected_records"} == {("events", "width:", "2"), ("events", "number:n", "1")} and "inputs" not in {r["check"] for r in q}


def test_landed_matrix(spark, tmp_path):
    path = tmp_path / "m.csv"
    genes = [f"G{i:03d}" for i in range(600)]
    path.write_text("ModelID," + ",".join(f"{g} ({i})" for i, g in enumerate(genes)) + "\n" + "".join(f"M{m}," + ",".join(str(m + i / 8) if (m + i) % 5 else "" for i in range(600)) + "\n" for m in range(20)))
    cells = T.read_matrix_long(spark, str(path))
    T.land_matrix(cells, str(tmp_path / "landed"))
    key = lambda df: sorted((r["model_id"], r["gene"], r["entrez"], r["value"]) for r in df.collect() if r["value"] is not None)
    few = T.read_matrix_genes(spark, str(tmp_path / "landed"), ["G007", "G300"], landed=True)
    assert key(few) == key(T.read_matrix_genes(spark, str(path), ["G300", "G007"])) and len(key(few)) == 32
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gene, [G007,G300])]" in plan
    many = T.read_landed(spark, str(tmp_path / "landed"), genes[20:580])
    assert key(many) == [x for x in key(cells) if "G020" <= x[1] <= "G579"]
    with pytest.raises(ValueError, match="NOPE"):
        T.read_landed(spark, str(tmp_path / "landed"), ["G001", "NOPE"])
    # a plan of the text file is as large for many genes as for few
    size = lambda g: len(T.read_matrix_genes(spark, str(path), g)._jdf.queryExecution().optimizedPlan().toString())
    assert size(genes[:500]) < size(genes[:2]) + 4000


def test_wide_export(spark, tmp_path):
    rows = [(m, g, e, v) for m in ("A", "B") for g, e, v in (("K", "7", 1.5), ("G, x", None, -2e-9))] + [("C", "K", "7", None)]
    cells = spark.createDataFrame(rows, "model_id string, gene string, entrez string, value double")
    T.write_matrix_wide(cells, str(tmp_path / "w"))
    back = {(r["model_id"], r["gene"], r["entrez"], r["value"]) for r in T.read_matrix_long(spark, str(tmp_path / "w")).collect()}
    assert back == {*rows, ("C", "G, x", None, None)}
    with pytest.raises(ValueError, match="more than 1 genes"):
        T.write_matrix_wide(cells, str(tmp_path / "x"), max_genes=1)
    with pytest.raises(Exception, match="two values"):
        T.write_matrix_wide(cells.union(cells), str(tmp_path / "y"))


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, [1])], "k string, n int, l array<int>")
    T.write_table(df, str(tmp_path / "t"), ["k"], contract="l array<int>, k string, n long")
    assert spark.read.parquet(str(tmp_path / "t/parquet")).schema["n"].dataType.simpleString() == "bigint"
    assert [tuple(r) for r in T.read_delimited(spark, str(tmp_path / "t/tsv")).collect()] == [("[1]", "a", "1")]
    for contract, what in (("k string, n int", "unknown: l"), ("k string, n int, l array<int>, m int", "missing: m"), ("k string, n boolean, l array<int>", "not as agreed")):
        with pytest.raises(ValueError, match=what):
            T.write_table(df, str(tmp_path / "u"), contract=contract)
