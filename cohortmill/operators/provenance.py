"""Provenance in long form: one row for each field of each entity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("entity_type", "entity_id", "field_name", "value", "source_name", "source_release", "evidence_nature", "parser_version", "raw_file", "raw_record_hash")


def unpivot_fields(df: DataFrame, entity_type: str, entity_id: str, fields: Mapping[str, tuple[str, str, str]], release: str, parser: str, record_hash: str | None = None) -> DataFrame:
    """One row for each row of `df` and field. `fields` gives (source, nature, file) of each column; null values stay."""
    items = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"), F.lit(src).alias("source_name"), F.lit(nature).alias("evidence_nature"), F.lit(raw).alias("raw_file")) for f, (src, nature, raw) in fields.items()]
    x = df.select(F.lit(entity_type).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"), (F.col(record_hash) if record_hash else F.lit(None).cast("string")).alias("raw_record_hash"), F.explode(F.array(*items)).alias("f"))
    return x.select("entity_type", "entity_id", "f.field_name", "f.value", "f.source_name", F.lit(release).alias("source_release"), "f.evidence_nature", F.lit(parser).alias("parser_version"), "f.raw_file", "raw_record_hash")
