"""Cohorts of models from metadata, annotation events and profile coverage, by declarative rules.

Rules are tables: values of metadata columns, and changes of genes, by context. Metadata become rows of (column, value) and meet
the first, events of the models that matched meet the second, so a plan is the same for one context and for thousands.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.functions.scalars import any_of, driver_signal, norm_text, payload, truthy_flag, variant_label

EXACT, ABSENCE, DRIVER = "exact_change", "absence_of_changes", "driver_or_change"
PRESENT, ABSENT, AMBIGUOUS, UNSEQUENCED = "defining_present", "defining_absent", "ambiguous", "unsequenced"


@dataclass(frozen=True)
class GeneRule:
    """A gene and the changes of it that count."""

    gene: str
    changes: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Context:
    """One context: which models it looks at, and what divides them into context and comparator."""

    cancer_id: str
    mode: str
    rules: tuple[GeneRule, ...]
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)  # metadata column -> values
    lineage: tuple[str, str] | None = None  # column and value that must hold besides
    other_ambiguous: bool | None = None  # whether other events of the gene make a model ambiguous; unset, not in the exact mode

    @property
    def context_status(self) -> str:
        return ABSENT if self.mode == ABSENCE else PRESENT

    @property
    def comparator_status(self) -> str:
        return PRESENT if self.mode == ABSENCE else ABSENT


#: Rows of rules, of some hundred bytes each, up to which a table of them is broadcast.
_FEW_RULES = 100_000


def _rules(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= _FEW_RULES else df


def disease_match(models: DataFrame, contexts: Sequence[Context]) -> DataFrame:
    """cancer_id and the columns of `models` for each context and row of metadata that has one of the context's values in any of its columns, and the lineage if one is set and there."""
    spark, columns = models.sparkSession, models.columns
    aliases = [(c.cancer_id, col, " ".join(v.lower().split())) for c in contexts for col, values in c.aliases.items() if col in columns for v in values]
    used = sorted({a[1] for a in aliases})
    if not used:
        return models.select(F.lit("").alias("cancer_id"), "*").limit(0)
    own = F.struct(*(F.col(c) for c in columns))
    cells = models.select(own.alias("_m"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), norm_text(F.col(c)).alias("alias")) for c in used))).alias("x"))
    hits = cells.select("_m", "x.*").join(_rules(spark, sorted(set(aliases)), "cancer_id string, column string, alias string"), ["column", "alias"]).select("cancer_id", "_m").distinct()
    lineages = [(c.cancer_id, c.lineage[0], " ".join(c.lineage[1].lower().split())) for c in contexts if c.lineage and c.lineage[0] in columns]
    if lineages:
        there = F.create_map(*(x for c in sorted({t[1] for t in lineages}) for x in (F.lit(c), norm_text(F.col(f"_m.{c}")))))
        hits = hits.join(_rules(spark, lineages, "cancer_id string, _column string, _value string"), "cancer_id", "left")
        hits = hits.where(F.col("_column").isNull() | (F.try_element_at(there, F.col("_column")) == F.col("_value")))
    return hits.select("cancer_id", *(F.col(f"_m.{c}").alias(c) for c in columns))


def profiled_models(profiles: DataFrame, datatypes: Sequence[str] = ("wes", "wgs"), flag_col: str | None = "is_default") -> DataFrame:
    """model_id of each model with a profile of these types; where there is a flag column, only rows that it marks."""
    ok = F.lower(F.trim("datatype")).isin([d.lower() for d in datatypes])
    if flag_col and flag_col in profiles.columns:
        ok = ok & truthy_flag(F.col(flag_col))
    return profiles.where(ok).select("model_id").distinct()


def duplicate_models(models: DataFrame, key: str = "model_id") -> DataFrame:
    """Keys that stand more than once, and how often."""
    return models.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique_models(models: DataFrame, key: str = "model_id") -> None:
    twice = [str(r[0]) for r in duplicate_models(models, key).orderBy(key).limit(10).collect()]
    if twice:
        raise ValueError("duplicate models: " + ", ".join(twice))


def _either(patterns: Sequence[str]) -> str | None:
    """One pattern for any of several, whatever the case."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns) if patterns else None


def gene_rules(spark: SparkSession, contexts: Sequence[Context]) -> DataFrame:
    """cancer_id, gene, changes, texts, drivers: what makes an event of a gene one that defines the context. Rules of one gene are one."""
    of: dict[tuple[str, str], tuple[list[str], list[str]]] = defaultdict(lambda: ([], []))
    mode = {c.cancer_id: c.mode for c in contexts}
    for c in contexts:
        for r in c.rules:
            own = of[c.cancer_id, r.gene.upper()]
            own[0].extend(r.changes)
            own[1].extend(r.texts)
    rows = [(who, gene, _either(changes), _either(texts), mode[who] == DRIVER) for (who, gene), (changes, texts) in of.items()]
    return _rules(spark, rows, "cancer_id string, gene string, changes string, texts string, drivers boolean")


def relevant_events(events: DataFrame, contexts: Sequence[Context], flags: Sequence[str] = (), texts: Sequence[str] = (), pairs: DataFrame | None = None) -> DataFrame:
    """cancer_id, model_id, the columns of `events`, _hit (defines the context) and _driver, for each context and event of its genes; with `pairs`, of these contexts and models only."""
    rules = gene_rules(events.sparkSession, contexts).withColumnsRenamed({"gene": "_gene", "texts": "_texts", "changes": "_changes"})
    e = events.withColumn("_gene", F.upper(F.trim("gene"))).join(rules.select("_gene").distinct(), "_gene", "left_semi")
    e = e.join(rules, "_gene") if pairs is None else e.join(pairs.select("cancer_id", "model_id").distinct(), "model_id").join(rules, ["cancer_id", "_gene"])
    matches = lambda c, p: F.coalesce(F.rlike(F.col(c), F.col(p)), F.lit(False))
    driver = driver_signal([F.col(c) for c in flags])
    hit = matches("change", "_changes") | (F.col("drivers") & (driver | any_of([matches(c, "_texts") for c in texts])))
    return e.select("cancer_id", *events.columns, hit.alias("_hit"), driver.alias("_driver"))


def classify(events: DataFrame, contexts: Sequence[Context], flags: Sequence[str] = (), texts: Sequence[str] = (), pairs: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """cancer_id, model_id, _defining, _other, _driver, qualifying, other: of each context and model with an event of the context's genes, whether it has a defining one, another one, and another one that speaks of a driver.

    The sorted JSON records of defining and other events hold `columns` (none: change, flags and texts). One grouping of the
    events for all contexts.
    """
    cols = list(dict.fromkeys(["change", *flags, *texts])) if columns is None else list(columns)
    hit, record = F.col("_hit"), payload(cols)
    lists = [F.array_sort(F.collect_list(F.when(when, record))).alias(name) for name, when in (("qualifying", hit), ("other", ~hit))]
    return relevant_events(events, contexts, flags, texts, pairs).groupBy("cancer_id", "model_id").agg(F.max(hit).alias("_defining"), F.max(~hit).alias("_other"), F.max(~hit & F.col("_driver")).alias("_driver"), *lists)


def variant_lists(events: DataFrame, context: Context, columns: Sequence[str], flags: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """model_id, qualifying, other: the sorted JSON records of a model's defining and other events."""
    return classify(events, [context], flags, texts, columns=columns).select("model_id", "qualifying", "other")


def context_rules(spark: SparkSession, contexts: Sequence[Context]) -> DataFrame:
    """cancer_id, _mode, _other_counts, _in, _out: whether other events make a model ambiguous, and the status of context and comparator."""
    rows = [(c.cancer_id, c.mode, c.mode != EXACT if c.other_ambiguous is None else c.other_ambiguous, c.context_status, c.comparator_status) for c in contexts]
    return _rules(spark, rows, "cancer_id string, _mode string, _other_counts boolean, _in string, _out string")


def status_of() -> Column:
    """The molecular status from `classify` and `context_rules` columns."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.when(on("_defining"), PRESENT).when(on("_other") & F.col("_other_counts"), AMBIGUOUS).otherwise(ABSENT)


def _cohort(models: DataFrame, events: DataFrame, profiled: DataFrame, contexts: Sequence[Context], flags: Sequence[str], texts: Sequence[str], columns: Sequence[str] | None) -> DataFrame:
    """Matched models with their rules, events and `sequenced`. Lists of unsequenced models are empty."""
    matched = disease_match(models, contexts)
    own = classify(events, contexts, flags, texts, matched, columns)
    covered = profiled.select("model_id").distinct().withColumn("sequenced", F.lit(True))
    out = matched.join(own, ["cancer_id", "model_id"], "left").join(covered, "model_id", "left").join(context_rules(models.sparkSession, contexts), "cancer_id")
    out = out.withColumn("sequenced", F.coalesce("sequenced", F.lit(False)))
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.when(F.col("sequenced"), F.coalesce(c, none)).otherwise(none) for c in ("qualifying", "other")})


def cohort_assign(models: DataFrame, events: DataFrame, profiled: DataFrame, contexts: Sequence[Context], flags: Sequence[str] = (), texts: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each context and model that its metadata match: cancer_id, model_id, name, sequenced, molecular_status, assigned_group, reason, qualifying, other (variants as `classify` gives them)."""
    out = _cohort(models, events, profiled, contexts, flags, texts, columns).withColumn("molecular_status", F.when(~F.col("sequenced"), UNSEQUENCED).otherwise(status_of()))
    status = F.col("molecular_status")
    group = F.when(status == F.col("_in"), "context").when(status == F.col("_out"), "comparator").otherwise("excluded")
    reason = F.when(~F.col("sequenced"), "no default profile of a covered type").when(status == PRESENT, "a defining variant").when(status == AMBIGUOUS, "only other variants of the defining genes").otherwise("no defining variant")
    return out.select("cancer_id", "model_id", "name", "sequenced", "molecular_status", group.alias("assigned_group"), reason.alias("reason"), "qualifying", "other")


TARGET, WILDTYPE, OTHER_DRIVER, OTHER_UNCLEAR = "target_variant", "wildtype_proxy", "other_driver_hotspot", "ambiguous_variant"
SPLIT_GROUPS = (TARGET, WILDTYPE, OTHER_DRIVER, "excluded")


def split_contexts(contexts: Sequence[Context]) -> list[Context]:
    """Those that the three-way split takes: of the exact mode, with one rule."""
    return [c for c in contexts if c.mode == EXACT and len(c.rules) == 1]


def cohort_split_variant(models: DataFrame, events: DataFrame, profiled: DataFrame, contexts: Sequence[Context], flags: Sequence[str] = (), texts: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The three-way split of one gene: models with the target change, without any record of the gene, with another record that speaks of a driver, or excluded.

    cancer_id, target_label, model_id, name, sequenced, molecular_status, assigned_group, reason, qualifying, other. Contexts of
    the exact mode with one rule take part. A model that stands twice is an error.
    """
    chosen = split_contexts(contexts)
    assert_unique_models(models)
    labels = _rules(models.sparkSession, [(c.cancer_id, variant_label(c.rules[0].changes, "configured variant")) for c in chosen], "cancer_id string, target_label string")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = _cohort(models, events, profiled, chosen, flags, texts, columns).join(labels, "cancer_id")
    status = F.when(~F.col("sequenced"), UNSEQUENCED).when(on("_defining"), TARGET).when(~on("_other"), WILDTYPE).when(on("_driver"), OTHER_DRIVER).otherwise(OTHER_UNCLEAR)
    out = out.withColumn("molecular_status", status)
    group = F.when(F.col("molecular_status").isin(UNSEQUENCED, OTHER_UNCLEAR), "excluded").otherwise(F.col("molecular_status"))
    said = {UNSEQUENCED: "no default profile of a covered type", WILDTYPE: "no record of the gene", OTHER_DRIVER: "another variant with a driver mark", OTHER_UNCLEAR: "another variant without a driver mark"}
    reason = F.when(F.col("molecular_status") == TARGET, F.concat(F.lit("target variant "), F.col("target_label")))
    for k, v in said.items():
        reason = reason.when(F.col("molecular_status") == k, v)
    return out.select("cancer_id", "target_label", "model_id", "name", "sequenced", "molecular_status", group.alias("assigned_group"), reason.alias("reason"), "qualifying", "other")


COMPARISONS = {"primary": ("context", "comparator"), "wildtype": ("target_variant", "wildtype_proxy"), "other-driver": ("target_variant", "other_driver_hotspot")}


def cohort_project(audit: DataFrame, comparison: str) -> DataFrame:
    """The audit of either kind with comparison_type and analysis_group: context, comparator or excluded for that comparison."""
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}; known are {', '.join(COMPARISONS)}")
    a, b = COMPARISONS[comparison]
    group = F.when(F.col("assigned_group") == a, "context").when(F.col("assigned_group") == b, "comparator").otherwise("excluded")
    return audit.select("cancer_id", F.lit(comparison).alias("comparison_type"), "model_id", "name", "sequenced", "molecular_status", "reason", "assigned_group", group.alias("analysis_group"))


def membership(*projected: DataFrame) -> DataFrame:
    """The context and comparator rows of some projections together."""
    out = projected[0]
    for p in projected[1:]:
        out = out.unionByName(p)
    return out.where("analysis_group <> 'excluded'").select("cancer_id", "comparison_type", "model_id", "analysis_group")


def cohort_diagnostics(audit: DataFrame) -> DataFrame:
    """Of each context: models matched and sequenced, and how many there are of each status and group."""
    return audit.groupBy("cancer_id").agg(
        F.count(F.lit(1)).alias("matched_n"), F.count_if("sequenced").alias("sequenced_n"),
        *(F.count_if(F.col("molecular_status") == s).alias(f"{s}_n") for s in (PRESENT, ABSENT, AMBIGUOUS, UNSEQUENCED)),
        *(F.count_if(F.col("assigned_group") == g).alias(f"{g}_n") for g in ("context", "comparator", "excluded")),
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of `left` that `right` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")
