"""The registered queries of the numbered operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.fingerprints import version_fingerprints

    return version_fingerprints(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.topk import threshold_topk

    return threshold_topk(_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, k=10)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), run_words=50)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.html import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.kneser_ney import score_quality, trusted_ids

    return score_quality(_table(spark, sf_dir, "documents"), trusted_ids(_table(spark, sf_dir, "labels")), repetition=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cohortmill.llm.bpe import bpe_digests

    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Shares of four domains, and of the languages of each. Sources share theirs by size.
MIX_TARGETS = [(f"domain{i}", None, None, 1, w) for i, w in enumerate((0.4, 0.3, 0.2, 0.1))] + [(f"domain{i}", lang, None, 2, w) for i in range(4) for lang, w in (("en", 0.4), ("de", 0.25), ("fr", 0.25))]


def source_domain(source: Column) -> Column:
    """The domain of a test source, which the tables do not name: the remainder by four of the number in its name, 'other' without one."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(n == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (n.cast("long") % 4).cast("string")))


def mix_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_TARGETS, "domain string, lang string, source string, depth int, weight double")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.mixing import mix_sources

    out = mix_sources(_table(spark, sf_dir, "documents"), domain=source_domain(F.col("source")), targets=mix_targets(spark))
    return out.select("doc_id", "lang", "source", "mix_epoch")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.conversations import repair_conversations

    return repair_conversations(_table(spark, sf_dir, "conversations"), damage=True)


def op12_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.neighbours import nearest_by_collisions

    return nearest_by_collisions(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortmill.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_iblt_fingerprints": op1_iblt_fingerprints,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_threshold_topk": op3_threshold_topk,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_text": op5_html_text,
    "op6_personal_data": op6_personal_data,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_source_mix": op10_source_mix,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collision_neighbours": op12_collision_neighbours,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: All pairs that share a shingle are counted, and components found by following links: for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) WHEN len(w) > 0 THEN [concat_ws(' ', w[1], w[2])] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT y, root FROM r JOIN e ON x = doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY ALL
"""

#: For the test pages, which have one layout: the main text is what stands in the article element, a block for each heading and paragraph.
PAGES_SQL = r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>|<br>', ' ', 'g'), '</?(?:p|h1)>') AS parts FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

DOMAIN_SQL = "CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 'other' ELSE 'domain' || (CAST(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS BIGINT) % 4) END"


def _oracles() -> dict[str, str]:
    from cohortmill.llm.conversations import REPAIR_SQL
    from cohortmill.llm.mixing import MIX_SQL
    from cohortmill.llm.topk import TOPK_SQL

    say = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
    targets = "(VALUES " + ", ".join(f"({', '.join(map(say, t[:3]))}, {t[3]}, CAST({t[4]} AS DOUBLE))" for t in MIX_TARGETS) + ") AS t(domain, lang, source, depth, weight)"
    return {
        "op2_ngram_jaccard": JACCARD_SQL,
        "op3_threshold_topk": TOPK_SQL,
        "op5_html_text": PAGES_SQL,
        "op11_conversation_repair": REPAIR_SQL,
        "op10_source_mix": MIX_SQL.format(docs="documents", fraction=0.75, alpha=0.5, epochs=2, seed=7, domain=DOMAIN_SQL, targets=targets) + "SELECT doc_id, lang, source, CAST(unnest(range(n)) AS BIGINT) AS mix_epoch FROM n",
    }


ORACLE_SQL: dict[str, str] = _oracles()
