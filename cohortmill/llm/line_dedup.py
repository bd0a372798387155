"""Operator 4: removal of repeated runs of lines by content-defined chunks.

A hash over the hashes of a line has a local maximum at every third line or so; chunks end there, so that an insertion
moves only the boundaries beside it. Chunks of two and more lines that stand in the corpus more than once are removed
except for their first place, once their bytes have been compared. A whole text of several chunks counts as one more
chunk, so a copy goes with its last short line.

Chunk ends depend on the lines beside, so chunks alone miss the edges of a passage, and short passages as a whole. With
`run_words`, units are lines or their sentences, and the shortest run of that many words from each unit on, and that up to
each unit, counts too. Such a run lies within the passage, and those of a passage of `run_words` words or more cover all
its units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.llm.common import _powers, discard, joined, materialise, mix64, running_sums, span_hashes, text_blocks, tidied, word_spans

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True


def _split(data: np.ndarray, at: np.ndarray, word_ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the units: a unit ends with a line end, with `word_ends` also with the space after a full stop."""
    stop = data == 10
    if word_ends is not None:
        stop[word_ends[(data[word_ends] == 32) & _END[data[word_ends - 1]]]] = True
    stop[at[1:] - 1] = True
    ends = np.flatnonzero(stop) + 1
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(at, starts, "right") - 1
    cut = np.minimum(ends, at[1:][doc] - 1)  # without the space between texts
    real = cut > starts
    return starts[real], cut[real], doc[real]


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def block_of(texts: list[str]) -> Block:
    """What `chunks` and `runs` both need of texts: their bytes, where each starts, and running sums for hashes."""
    data, at = joined(texts)
    return data, at, running_sums(data)


def chunks(texts: list[str], block: Block | None = None) -> tuple[bytes, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """The bytes of all texts, and for each text the starts, ends, hashes and numbers of lines of its chunks, which cover it."""
    data, at, sums = block or block_of(texts)
    raw = data.tobytes()
    starts, cut, doc = _split(data, at)
    r = mix64(span_hashes(data, starts, cut, sums))
    n = len(r)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    lower, upper = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if n:
        lower[1:], upper[:-1] = r[:-1], r[1:]
    last = np.concatenate([first[1:], [True]]) if n else first
    lower[first] = 0
    upper[last] = 0
    edge = last | ((r > lower) & (r >= upper) & ~first)
    tail = np.flatnonzero(edge)
    head = np.concatenate([[0], tail[:-1] + 1]) if len(tail) else tail
    a, b, units, of = starts[head], cut[tail], tail - head + 1, doc[head]
    hashes = span_hashes(data, a, b, sums)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return raw, [(a[i:j], b[i:j], hashes[i:j], units[i:j]) for i, j in zip(bounds, bounds[1:])]


class Runs(NamedTuple):
    """The units of one text that are not blank, and its runs: the first unit, the number of units and the hash of each."""

    start: np.ndarray  # of a unit's content
    end: np.ndarray
    upto: np.ndarray  # where the next unit begins, or the text ends
    first: np.ndarray
    units: np.ndarray
    hashes: np.ndarray


def runs(texts: list[str], words: int, block: Block | None = None) -> tuple[bytes, list[Runs]]:
    """The bytes of all texts, and for each text the shortest runs of `words` words from each unit on and up to each unit.

    Blanks around a unit do not count. Where words are not set apart by blanks, 12 bytes count as one.
    """
    data, at, of_bytes = block or block_of(texts)
    begins, stops = word_spans(data, ~_BLANK)
    starts, cut, doc = _split(data, at, stops)
    # units end at blanks, so no word lies in two of them
    i, j = np.searchsorted(begins, starts), np.searchsorted(begins, cut)
    full = j > i
    i, j, doc = i[full], j[full], doc[full]
    a, z = begins[i], stops[j - 1]
    long = np.maximum(j - i, (z - a) // 12)
    n = len(a)
    upto = np.append(a[1:], 0)[:n]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    upto[bounds[1:][np.diff(bounds) > 0] - 1] = (at[1:] - 1)[np.diff(bounds) > 0]
    total = np.concatenate([[0], np.cumsum(long)])
    every = np.arange(n)
    after = np.searchsorted(total, total[:-1] + words)
    before = np.searchsorted(total, total[1:] - words, "right") - 1
    ahead, back = after <= bounds[doc + 1], before >= bounds[doc]
    pairs = np.sort(np.concatenate([every[ahead] << 32 | after[ahead], before[back] << 32 | (every + 1)[back]]))
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    first, stop = pairs >> 32, pairs & 0xFFFFFFFF
    with np.errstate(over="ignore"):
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(span_hashes(data, a, z, of_bytes)) * up[:n], out=sums[1:])
        h = mix64((sums[stop] - sums[first]) * down[first] ^ (stop - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    cuts = np.searchsorted(first, bounds)
    return data.tobytes(), [Runs(a[x:y], z[x:y], upto[x:y], first[u:v] - x, (stop - first)[u:v], h[u:v]) for x, y, u, v in zip(bounds, bounds[1:], cuts, cuts[1:])]


def _runs_where(texts: list[str], wanted: list[list[int] | None], words: int | None, block: Block | None = None) -> tuple[bytes, list[Runs | None], list[int]]:
    """`runs` of those texts of which the place of a run is wanted, None for the others: bytes, runs, and where each text starts in the bytes. `block` is of all texts."""
    own = [i for i, w in enumerate(wanted) if words and w and max(w) >= RUN]
    found: list[Runs | None] = [None] * len(texts)
    starts = [0] * len(texts)
    if not own:
        return b"", found, starts
    if block and 4 * len(own) >= 3 * len(texts):
        raw, some = runs(texts, words, block)
        for i in own:
            found[i] = some[i]
        return raw, found, block[1].tolist()
    raw, some = runs([texts[i] for i in own], words)
    at = 0
    for i, m in zip(own, some):
        found[i], starts[i] = m, at
        at += len(texts[i].encode("utf-8", "surrogatepass")) + 1
    return raw, found, starts


WHOLE = -1  # the place of a whole text
RUN = 1 << 50  # the least place of a run; its first unit and number of units are added


def _wholes(hashes: np.ndarray, local: np.ndarray) -> np.ndarray:
    """The hashes of texts from those of their chunks, of which `local` has the numbers within their texts; none for a text without chunks."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix64(hashes + mix64(local.astype(np.uint64) + np.uint64(1))), np.flatnonzero(local == 0)) if len(hashes) else hashes


def _whole(hashes: np.ndarray) -> np.uint64:
    """The hash of one text."""
    return _wholes(hashes, np.arange(len(hashes)))[0]


def line_dedup(docs: DataFrame, min_units: int = 2, id_col: str = "doc_id", text_col: str = "text", run_words: int | None = None) -> DataFrame:
    """The rows of `docs` with all columns, the text without repeated chunks, and n_chunks and n_removed.

    A chunk counts from `min_units` lines on, and so does a whole text of several chunks. The first place of a chunk, by id (null last) and
    place, stays, within a text too. Rows that agree in id and text are one document: both keep or lose the same chunks. Chunks
    that share a hash are told apart by their bytes. A null text stays null; it and an empty text have no
    chunks. With `run_words`, all units of repeated runs of that many words or more go too, except for their first place;
    blanks around units may differ, and contents are compared by digests of 128 bits. Where a run overlaps its own first
    place, that stays as a whole. n_removed counts the chunks that lost all or part. An empty table gives no rows. Columns
    of `docs` of the names n_chunks and n_removed give way to those.
    """
    docs = docs.drop("n_chunks", "n_removed")
    names = docs.columns
    keyed = docs.select(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    kind = docs.schema[id_col].dataType.simpleString()

    def all_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = 0
            for keys, texts in text_blocks(iter([b.select([1, 2])])):
                ids, n = b.column(0).slice(start, len(texts)), len(texts)
                start += n
                block = block_of(texts)
                _, found = chunks(texts, block)
                more = runs(texts, run_words, block)[1] if run_words else None
                sizes = np.array([len(x[0]) for x in found])
                of, hashes, units = np.repeat(np.arange(n), sizes), np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])
                local = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                long, several = units >= min_units, np.flatnonzero(sizes > 1)
                of, h, place = [of[long], several], [hashes[long], _wholes(hashes, local)[np.searchsorted(np.flatnonzero(sizes), several)]], [local[long], np.full(len(several), WHOLE)]
                if more:
                    of.append(np.repeat(np.arange(n), [len(x.first) for x in more]))
                    h.append(np.concatenate([x.hashes for x in more]))
                    place.append(RUN + (np.concatenate([x.first for x in more]) << 20 | np.concatenate([x.units for x in more])))
                of = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([ids.take(of), keys.take(of), pa.array(np.concatenate(place), pa.int64()), pa.array(np.concatenate(h).view(np.int64))], ["doc_id", "_key", "place", "h"])

    source = keyed.select("doc_id", "_key", F.coalesce("text", F.lit("")).alias("text"))
    places = materialise(source.mapInArrow(tidied(all_chunks), f"doc_id {kind}, _key long, place long, h long").select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key", "place", "h"))
    repeated = materialise(places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("no_id", "doc_id", "_key", "place")).alias("first")).where("n > 1").select("h", F.col("first._key").alias("first_key"), F.col("first.place").alias("first_place")))
    # how many units of a run lie past its first place in the same text: all, if they do not overlap
    past = F.shiftright(F.col("place") - F.col("first_place"), 20)
    inside = (F.col("place") > RUN) & (F.col("_key") == F.col("first_key")) & (past < F.col("place").bitwiseAND(F.lit((1 << 20) - 1)))
    gone = F.when(inside, F.col("place") + F.shiftleft(F.col("place").bitwiseAND(F.lit((1 << 20) - 1)) - past, 20) - F.col("place").bitwiseAND(F.lit((1 << 20) - 1)) + past).otherwise(F.col("place"))
    found = materialise(places.join(repeated, "h").select("_key", "place", "h", ((F.col("_key") != F.col("first_key")) | (F.col("place") != F.col("first_place"))).alias("again"), gone.alias("gone")))
    discard(places, repeated)

    def bytes_of(batches: Iterator[pa.RecordBatch], placed: bool = False) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, wanted = 0, b.column(2)
            for keys, texts in text_blocks(iter([b.select([0, 1])])):
                all_of = block_of(texts)
                raw, parts = chunks(texts, all_of)
                wants = wanted.slice(start, len(texts)).to_pylist()
                of_runs, more, _ = _runs_where(texts, wants, run_words, all_of)
                h, out = [], []
                for (a, z, hashes, _u), m, want in zip(parts, more, wants):
                    if m:
                        at = {(f << 20 | u) + RUN: i for i, (f, u) in enumerate(zip(m.first.tolist(), m.units.tolist()))}
                        units = [of_runs[x:y] for x, y in zip(m.start.tolist(), m.end.tolist())]
                    for i in want:
                        if i >= RUN:
                            f = i - RUN >> 20
                            h.append(m.hashes[at[i]])
                            out.append(hashlib.blake2b(b"\n".join(units[f : f + (i & 0xFFFFF)]), digest_size=16).digest())
                            continue
                        h.append(_whole(hashes) if i == WHOLE else hashes[i])
                        out.append(raw[a[0] : z[-1]] if i == WHOLE else raw[a[i] : z[i]])
                hs, at = pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.repeat(np.arange(len(texts)), [len(w) for w in wants]))
                if placed:
                    wide = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in out], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(3).slice(start, len(texts)).take(at), keys.take(at), wanted.slice(start, len(texts)).flatten(), hs, wide], ["doc_id", "_key", "place", "h", "chunk"])
                else:
                    yield pa.RecordBatch.from_arrays([hs, pa.array(out, pa.binary())], ["h", "chunk"])
                start += len(texts)

    one = keyed.select("_key", "text", "doc_id").join(found.groupBy("_key").agg(F.collect_list("place").alias("want")), "_key").select("_key", "text", "want", "doc_id")
    compared = one.mapInArrow(tidied(bytes_of), "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    differ = materialise(compared.where("low <> high").select("h"))
    if not differ.isEmpty():
        # chunks of one hash and different bytes: each kind has a first place of its own
        kinds = one.mapInArrow(lambda batches: bytes_of(batches, True), f"doc_id {kind}, _key long, place long, h long, chunk binary").join(differ, "h", "left_semi")
        kinds = materialise(kinds.withColumn("at", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key", "place")))
        first = kinds.groupBy("h", "chunk").agg(F.min("at").alias("first"))
        again = (F.col("_key") != F.col("first._key")) | (F.col("place") != F.col("first.place"))
        found = found.join(differ, "h", "left_anti").unionByName(kinds.join(first, ["h", "chunk"]).select("_key", "place", "h", again.alias("again"), F.col("place").alias("gone")))
    drop = found.where("again").groupBy("_key").agg(F.collect_list("gone").alias("_drop"))
    full = keyed.select("_key", "row").join(drop, "_key", "left").select("row", "_drop")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            row = b.column(0)
            texts, lists = row.field(at).to_pylist(), b.column(1).to_pylist()
            out, n_chunks, n_removed = [], [], []
            start = 0
            for _, block in text_blocks(iter([pa.RecordBatch.from_arrays([b.column(1), pa.array([t or "" for t in texts], pa.string())], ["x", "t"])])):
                all_of = block_of(block)
                raw, parts = chunks(block, all_of)
                _, more, begins = _runs_where(block, lists[start : start + len(block)], run_words, all_of)
                for k, (a, z, _h, _u) in enumerate(parts):
                    if not lists[start + k]:
                        out.append(texts[start + k])
                        n_chunks.append(len(a))
                        n_removed.append(0)
                        continue
                    lost = np.zeros(int(z[-1] - a[0]) if len(a) else 0, bool)
                    for i in set(lists[start + k]):
                        if i >= RUN:
                            f, m = i - RUN >> 20, more[k]
                            lost[m.start[f] - begins[k] : m.upto[f + (i & 0xFFFFF) - 1] - begins[k]] = True
                        elif i == WHOLE:
                            lost[:] = True
                        else:
                            lost[a[i] - a[0] : z[i] - a[0]] = True
                    n_chunks.append(len(a))
                    n_removed.append(int(np.count_nonzero(np.logical_or.reduceat(lost, a - a[0]))) if lost.any() else 0)
                    out.append(texts[start + k] if not lost.any() else np.frombuffer(raw, np.uint8)[a[0] : z[-1]][~lost].tobytes().decode("utf-8", "surrogatepass"))
                start += len(block)
            columns = [pa.array(out, pa.string()) if i == at else row.field(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type)), pa.array(n_chunks, pa.int64()), pa.array(n_removed, pa.int64())], ["row", "n_chunks", "n_removed"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("n_chunks", T.LongType()), T.StructField("n_removed", T.LongType())])
    return full.mapInArrow(tidied(remove), schema).select("row.*", "n_chunks", "n_removed")
