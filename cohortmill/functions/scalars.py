"""Scalar expressions over text, flags and score lists; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that flags and driver marks are written with.
TRUTHY = ("1", "true", "yes", "y", "t")
DRIVER_WORDS = ("likely", "oncogenic", "hotspot")
DRIVER_PARTS = ("oncogenic", "driver", "hotspot", "likely")
NOT_DRIVER = ("false", "no", "0", "none", "na", "nan")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def norm_text(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; null as ''."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


_LABEL = r"^\s*(.*?)\s*\((\d+)\)\s*$"


def label_symbol(c: Column) -> Column:
    """'SYM (12)' -> 'SYM'; text without a number in parentheses as it is."""
    return F.when(c.rlike(_LABEL), F.regexp_extract(c, _LABEL, 1)).otherwise(F.trim(c))


def label_number(c: Column) -> Column:
    """'SYM (12)' -> '12', else null."""
    return F.nullif(F.regexp_extract(c, _LABEL, 2), F.lit(""))


def truthy_flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUTHY), F.lit(False))


def any_of(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def driver_signal(flags: Sequence[Column]) -> Column:
    """Whether any flag reads as yes, or holds a word that speaks of a driver. 'unlikely' holds such a word too."""
    found = []
    for c in flags:
        v = F.lower(F.trim(c))
        found.append(v.isin(*TRUTHY, *DRIVER_WORDS) | (v.rlike("|".join(DRIVER_PARTS)) & ~v.isin(*NOT_DRIVER)))
    return any_of(found)


def regex_any(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern is found, whatever the case; false without patterns and for null."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def combined_text(cols: Sequence[Column]) -> Column:
    """The non-blank texts, joined by ' | '."""
    return F.concat_ws(" | ", *(blank_to_null(c) for c in cols))


def variant_label(patterns: Sequence[str], default: str) -> str:
    """The change that the first anchored, escaped pattern spells out, else the default. For rules, on the driver."""
    for p in patterns:
        m = re.fullmatch(r"\^(.+)\$", p)
        if m:
            return m[1].replace("\\", "")
    return default


def variant_label_column(c: Column, default: str) -> Column:
    """`variant_label` for a column that holds patterns."""
    return F.when(c.rlike(r"^\^.+\$$"), F.regexp_replace(F.regexp_extract(c, r"^\^(.+)\$$", 1), r"\\", "")).otherwise(F.lit(default))


def to_number(c: Column) -> Column:
    """A double; null for anything else, NaN included."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def split_multi(c: Column, sep: str = "|") -> Column:
    """The trimmed non-empty items of a list in text; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")


def first_present(cols: Sequence[Column], sep: str = "|") -> Column:
    """The first item of the first column that has any."""
    return F.coalesce(*(F.get(split_multi(c, sep), F.lit(0)) for c in cols))


def record_hash(cols: Sequence[str]) -> Column:
    """SHA-256 of the record as compact JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(cols))), {"ignoreNullFields": "false"}), 256)


def score_map(scores: Column) -> Column:
    """array<struct<id, score>> as a map without null ids and scores; the last of equal ids wins."""
    kept = F.filter(F.coalesce(scores, F.array()), lambda x: x["id"].isNotNull() & x["score"].isNotNull())
    n = F.size(kept)
    last = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, n), lambda y: y["id"] == x["id"]))
    return F.map_from_arrays(F.transform(last, lambda x: x["id"]), F.transform(last, lambda x: x["score"]))


def score_get(scores: Column, keys: Sequence[str]) -> Column:
    """The first of the keys that the map has."""
    return F.coalesce(*(F.try_element_at(scores, F.lit(k)) for k in keys))


def sorted_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def payload(cols: Sequence[str]) -> Column:
    """The non-blank ones of some text columns as a JSON record."""
    return F.to_json(F.struct(*(blank_to_null(F.col(c)).alias(c) for c in cols)))


def flag(c: Column) -> Column:
    """A comparison, false where it is null."""
    return F.coalesce(c, F.lit(False))
