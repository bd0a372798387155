"""Readers of landed files and writers of result tables."""

from __future__ import annotations

import csv
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.functions.scalars import blank_to_null, to_number


def shared_path(spark: SparkSession, name: str = "") -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
    path = f"{base.rstrip('/')}/{name or 'table'}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", rejected: str | None = None) -> DataFrame:
    """All columns as text, blanks as null; a byte-order mark does no harm.

    With `rejected`, a column of that name holds the whole line of rows that have more or fewer fields than the header.
    """
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, escape='"')
    names = df.columns
    if rejected is not None:
        fields = [T.StructField(c, T.StringType()) for c in (*names, rejected)]
        # a reader that skips columns would not see how many there are
        df = spark.read.option("columnPruning", False).csv(path, schema=T.StructType(fields), sep=sep, header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=rejected)
    more = [F.col(f"`{rejected}`")] if rejected is not None else []
    return df.select(*(blank_to_null(F.col(f"`{c}`")).alias(c) for c in names), *more)


#: What stands for a missing number, in lower case.
MISSING = ("", "na", "n/a", "nan", "null", "none")


def not_a_number(c: Column) -> Column:
    """Whether text is there that is neither a number nor a word for a missing one."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*MISSING) & c.try_cast("double").isNull(), F.lit(False))


REJECTED = "source string, kind string, field string, n long"


def rejections(df: DataFrame, source: str, rejected: str | None = None, numeric: Sequence[str] = ()) -> DataFrame:
    """source, kind, field, n: how many rows of `read_delimited` have a wrong width, and how many values of each of the columns that should be numbers are none. One pass, a row for each question."""
    asked = ([("width", "", F.col(f"`{rejected}`").isNotNull())] if rejected else []) + [("number", c, not_a_number(F.col(f"`{c}`"))) for c in numeric]
    if not asked:
        return df.sparkSession.createDataFrame([], REJECTED)
    n = df.agg(*(F.count_if(bad).alias(f"n{i}") for i, (_, _, bad) in enumerate(asked)))
    return n.select(F.explode(F.array(*(F.struct(F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.col(f"n{i}").alias("n")) for i, (kind, field, _) in enumerate(asked)))).alias("x")).select("x.*")


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]], optional: Sequence[str] = ()) -> DataFrame:
    """One column for each canonical name, from the first of its aliases that is there; optional ones may be null, others must exist."""
    out, missing = [], []
    for name, known in aliases.items():
        hit = next((a for a in known if a in df.columns), None)
        if hit is not None:
            out.append(F.col(f"`{hit}`").alias(name))
        elif name in optional:
            out.append(F.lit(None).cast("string").alias(name))
        else:
            missing.append(f"{name} (any of {', '.join(known)})")
    if missing:
        raise ValueError("missing columns: " + "; ".join(missing))
    return df.select(*out)


_LABEL = re.compile(r"\s*(.*?)\s*\((\d+)\)\s*")


def _header(spark: SparkSession, path: str, sep: str) -> tuple[str, str, list[tuple[int, str, str | None]]]:
    """The first line, the label of the id column, and (position, symbol, number) of the others."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError("empty matrix file")
    labels = next(csv.reader([head[0][0].removeprefix("\ufeff")], delimiter=sep))
    names = []
    for i, label in enumerate(labels[1:], 1):
        m = _LABEL.fullmatch(label)
        names.append((i, m[1], m[2]) if m else (i, label.strip(), None))
    twice = sorted({n for n, k in Counter(g for _, g, _ in names).items() if k > 1})
    if twice:
        raise ValueError(f"duplicate gene symbols in the header: {', '.join(twice[:10])}")
    return head[0][0], labels[0].strip(), names


def _fields(sep: str) -> Column:
    """The fields of a line; ones in quotes may hold the separator."""
    mark = re.escape(sep)
    quoted = F.transform(F.regexp_extract_all("value", F.lit(f'(?:^|{mark})("(?:[^"]|"")*"|[^{mark}]*)'), 1), lambda x: F.regexp_replace(x, '^"|"$', ""))
    return F.when(F.contains("value", F.lit('"')), quoted).otherwise(F.split("value", mark))


def _body(spark: SparkSession, path: str, first: str) -> DataFrame:
    return spark.read.text(path).where((F.col("value") != first) & (F.trim("value") != ""))


def read_matrix_long(spark: SparkSession, path: str, genes: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """model_id, gene, entrez, value of a wide file: an id column and one column for each 'SYMBOL (number)'.

    The file is read as lines, so its tens of thousands of columns never become columns of a plan; with `genes`, only their
    positions are exploded, and genes that the header lacks are an error. Values that are no numbers are null
    (`matrix_rejections` counts them); values in quotes may hold the separator. Ids or symbols that stand twice are an error, and
    so are files of one folder whose headers differ: one aggregate over the first fields says so before the cells are read.
    """
    first, id_label, names = _header(spark, path, sep)
    if genes is not None:
        absent = sorted(set(genes) - {g for _, g, _ in names})
        if absent:
            raise ValueError("genes missing from the matrix: " + ", ".join(absent[:20]))
        names = [n for n in names if n[1] in set(genes)]
    body = _body(spark, path, first)
    mark = F.regexp_extract("value", '^\ufeff?"((?:[^"]|"")*)"', 1)
    lead = F.trim(F.when(F.col("value").rlike('^\ufeff?"'), mark).otherwise(F.regexp_replace(F.substring_index("value", sep, 1), "^\ufeff", "")))
    odd = body.groupBy(lead.alias("id")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("id") == id_label)).limit(10).collect()
    if any(r["id"] == id_label for r in odd):
        raise ValueError("the headers of the files differ")
    if odd:
        raise ValueError(f"duplicate model ids: {', '.join(r['id'] for r in odd)}")
    rows = body.select(_fields(sep).alias("v")).select(F.trim(F.col("v")[0]).alias("model_id"), "v")
    if genes is not None:
        # one literal, however many genes there are
        at = F.split(F.lit(",".join(str(n[0]) for n in names)), ",").cast("array<int>")
        cells = rows.select("model_id", F.explode(F.transform(at, lambda p: F.struct(p.alias("pos"), F.get("v", p).alias("x")))).alias("c")).select("model_id", "c.pos", "c.x")
    else:
        cells = rows.select("model_id", F.posexplode("v").alias("pos", "x")).where("pos > 0")
    # a row for each column of the header
    return cells.join(F.broadcast(spark.createDataFrame(names, "pos int, gene string, entrez string")), "pos").select("model_id", "gene", "entrez", to_number(F.trim("x")).alias("value"))


def matrix_rejections(spark: SparkSession, path: str, source: str, sep: str = ",") -> DataFrame:
    """source, kind, field, n as `rejections` gives them: lines of a wide file whose number of fields is not the header's, and cells that hold text but no number."""
    first, _, names = _header(spark, path, sep)
    rows = _body(spark, path, first).select(_fields(sep).alias("v"))
    bad = F.size(F.filter(F.slice("v", 2, len(names) + 1), not_a_number))
    n = rows.agg(F.count_if(F.size("v") != len(names) + 1).alias("width"), F.coalesce(F.sum(bad), F.lit(0)).alias("number"))
    return n.select(F.explode(F.array(*(F.struct(F.lit(source).alias("source"), F.lit(k).alias("kind"), F.lit("").alias("field"), F.col(k).cast("long").alias("n")) for k in ("width", "number")))).alias("x")).select("x.*")


def land_matrix(cells: DataFrame, path: str) -> None:
    """Cells of `read_matrix_long` in Parquet, clustered by gene: later reads of some genes skip the row groups of all others."""
    cells.repartitionByRange("gene", "model_id").sortWithinPartitions("gene", "model_id").write.mode("overwrite").parquet(path)


#: Genes named in a filter that reaches the file; more of them are joined.
_NAMED = 500


def read_landed(spark: SparkSession, path: str, genes: Sequence[str] | None = None) -> DataFrame:
    """A landed matrix, or the named genes of it; genes that it lacks are an error."""
    df = spark.read.parquet(path)
    if genes is None:
        return df
    own = sorted(set(genes))
    if len(own) <= _NAMED:
        picked = df.where(F.col("gene").isin(own))
    else:
        picked = df.where(F.col("gene").between(own[0], own[-1])).join(spark.createDataFrame([(g,) for g in own], "gene string"), "gene", "left_semi")
    found = {r[0] for r in picked.select("gene").distinct().collect()}
    if absent := [g for g in own if g not in found]:
        raise ValueError("genes missing from the matrix: " + ", ".join(absent[:20]))
    return picked


def read_matrix_genes(spark: SparkSession, path: str, genes: Sequence[str], sep: str = ",", landed: bool = False) -> DataFrame:
    """The named genes alone, from a wide file or a landed matrix."""
    return read_landed(spark, path, genes) if landed else read_matrix_long(spark, path, genes, sep)


def read_events_filtered(df: DataFrame, genes: Sequence[str], gene_col: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of the events of some genes, whatever the case of the name."""
    return df.where(F.upper(F.trim(F.col(gene_col))).isin([g.upper() for g in genes])).select(*columns)


SCORES = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())]))
ASSOC_ROW = T.StructType([
    T.StructField("target", T.StructType([T.StructField("id", T.StringType()), T.StructField("approvedSymbol", T.StringType())])),
    T.StructField("score", T.DoubleType()), T.StructField("datatypeScores", SCORES), T.StructField("datasourceScores", SCORES),
])
ASSOC_PAGE = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("data", T.StructType([T.StructField("disease", T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("associatedTargets", T.StructType([T.StructField("count", T.LongType()), T.StructField("rows", T.ArrayType(ASSOC_ROW))])),
]))]))])


def flatten_assoc(pages: DataFrame) -> DataFrame:
    """disease_id, disease_name, target_id, symbol, score, datatype_scores, datasource_scores: rows without a target id go, of equal ones the last page and place stays."""
    rows = pages.select("page", F.col("data.disease.id").alias("disease_id"), F.col("data.disease.name").alias("disease_name"), F.posexplode("data.disease.associatedTargets.rows").alias("place", "r"))
    rows = rows.where("r.target.id IS NOT NULL AND r.target.id <> ''")
    flat = rows.select("page", "place", "disease_id", "disease_name", F.col("r.target.id").alias("target_id"), F.col("r.target.approvedSymbol").alias("symbol"), F.col("r.score").alias("score"), F.col("r.datatypeScores").alias("datatype_scores"), F.col("r.datasourceScores").alias("datasource_scores"))
    last = F.max_by(F.struct("disease_name", "symbol", "score", "datatype_scores", "datasource_scores"), F.struct("page", "place"))
    return flat.groupBy("disease_id", "target_id").agg(last.alias("x")).select("disease_id", "x.disease_name", "target_id", "x.symbol", "x.score", "x.datatype_scores", "x.datasource_scores")


def read_assoc_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of association responses, one JSON document a line or file."""
    return flatten_assoc(spark.read.schema(ASSOC_PAGE).json(path))


def read_assoc_bulk(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from a bulk export in Parquet."""
    return spark.read.parquet(path).select("disease_id", "disease_name", "target_id", "symbol", "score", "datatype_scores", "datasource_scores")


def text_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, so that any row can be written as text."""
    return df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns))


def conform(df: DataFrame, contract: T.StructType | str, name: str = "table") -> DataFrame:
    """`df` with the columns of the contract, in its order and types. Columns that are missing or unknown, and types that don't widen to the contract's, are an error."""
    schema = T._parse_datatype_string(contract) if isinstance(contract, str) else contract
    missing, unknown = [f.name for f in schema if f.name not in df.columns], [c for c in df.columns if c not in schema.names]
    if missing or unknown:
        raise ValueError(f"{name} is not as agreed" + (f"; missing: {', '.join(missing)}" if missing else "") + (f"; unknown: {', '.join(unknown)}" if unknown else ""))
    try:
        return df.to(schema)
    except AnalysisException as e:
        raise ValueError(f"{name} is not as agreed: {e.getMessage()}") from None


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mirror: bool = True, contract: T.StructType | str | None = None) -> None:
    """Parquet under path/parquet and, unless switched off, a tab-separated mirror under path/tsv with blanks for nulls. With a contract, `conform` comes first; the mirror is written from what has been written."""
    df = df if contract is None else conform(df, contract, path.rstrip("/").rpartition("/")[2])
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/parquet")
    if mirror:
        # columns that name folders get their types back
        text_columns(df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet").select(*df.columns)).write.mode("overwrite").csv(f"{path}/tsv", sep="\t", header=True, nullValue="", emptyValue="")


def write_json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_provenance(new: DataFrame, path: str, keys: Sequence[str] = ("source_name", "parser_version", "source_release")) -> None:
    """Puts new rows beside those that are there; rows of an earlier run with the same keys are replaced, so running twice changes nothing."""
    spark = new.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        new.write.mode("overwrite").partitionBy(*keys).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_matrix_subset(cells: DataFrame, membership: DataFrame, path: str) -> None:
    """Cells of the models of each comparison, in Parquet by comparison."""
    rows = cells.join(membership.select("cancer_id", "comparison_type", "model_id", "analysis_group"), "model_id")
    rows.write.mode("overwrite").partitionBy("cancer_id", "comparison_type").parquet(path)


def write_matrix_wide(cells: DataFrame, path: str, value: str = "value", max_genes: int = 2000) -> None:
    """A wide comma-separated file, a row for each model and a column for each gene, with its number if `cells` has one; `read_matrix_long` reads it back.

    Genes become columns of a plan here, so more than `max_genes` are refused. A gene of two numbers, or two values of a cell, are an error.
    """
    number = F.max("entrez") if "entrez" in cells.columns else F.lit(None).cast("string")
    numbers = F.count_distinct("entrez") if "entrez" in cells.columns else F.lit(0)
    genes = cells.groupBy("gene").agg(number.alias("entrez"), numbers.alias("n")).limit(max_genes + 1).collect()
    if len(genes) > max_genes:
        raise ValueError(f"more than {max_genes} genes: a wide table of them would be too wide; keep the cells long")
    if odd := sorted(r["gene"] for r in genes if r["n"] > 1):
        raise ValueError(f"genes with two numbers: {', '.join(odd[:10])}")
    label = {r["gene"]: f"{r['gene']} ({r['entrez']})" if r["entrez"] is not None else r["gene"] for r in genes}
    names = sorted(label)
    # two values of a cell end the job
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a cell has two values"))).otherwise(F.max(value))
    single = cells.groupBy("model_id", "gene").agg(one.alias("_v"))
    wide = single.groupBy(F.col("model_id").alias("ModelID")).pivot("gene", names).agg(F.max("_v"))
    wide.select("ModelID", *(F.col(f"`{g}`").alias(label[g]) for g in names)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
