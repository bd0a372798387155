"""Operator 7: quality by the perplexity under an interpolated modified Kneser-Ney model of trusted text, by sharded joins.

The model is over characters (code points, so every script has its own), one for each language. Texts fall into two halves
by a hash; each is scored by the model of the other half's trusted texts, so that no text, nor a copy, meets its own counts.

Counts are dealt out by model and context and turned into probabilities and back-off weights by joins on n-grams. To be
scored, the texts of a partition are put into chunks of one model each. A chunk asks for each of its distinct n-grams once:
the questions are dealt out to the shards of the table, joined there, and the answers go back to the chunk. So nothing but
sums for each model is sent to the driver, no task holds a whole model, and a frequent n-gram is one question a chunk. The
two halves are scored one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmill.llm.common import checked_broadcast, discard, joined, materialise, mix64, span_hashes, tidied, tidy

ORDER = 5
#: The model of all trusted texts, for texts whose language has none of its own.
POOLED = "*"
#: Names of the halves of the texts.
HALVES = "01"
#: The noncharacter that stands before a text.
PAD = 0x10FFFF
#: Characters of a chunk, and of all chunks that a task holds open.
CHUNK, HELD = 660_000, 2_640_000
_P = np.uint64(0x9E3779B97F4A7C15)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids that are labelled good and not toxic, and never otherwise."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select("doc_id")


# ---- n-grams of a chunk -------------------------------------------------------------------------------------------


class Grams(NamedTuple):
    """The distinct n-grams of each order 0 to `order` in a chunk, in the order of their symbols, and what stands where."""

    codes: list[np.ndarray]  # (number, n) code points
    suffix: list[np.ndarray]  # the number of each one's last n - 1 symbols in the order below
    context: list[np.ndarray]  # and of its first n - 1
    top: np.ndarray  # the number of the highest order's n-gram that ends at each character
    bounds: np.ndarray  # where the characters of each text begin in `top`


def _ranked(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each code among the distinct ones, and a place where each of those stands. Codes are below `span`."""
    if span <= max(1 << 22, 4 * len(codes)):
        place = np.full(span, -1, np.int32)
        place[codes] = np.arange(len(codes), dtype=np.int32)
        held = np.flatnonzero(place >= 0)
        at = place[held]
        place[held] = np.arange(len(held), dtype=np.int32)
        return place[codes], at
    _, at, rank = np.unique(codes, return_index=True, return_inverse=True)
    return rank.astype(np.int32), at


def grams_of(texts: list[str], order: int) -> Grams:
    pad = chr(PAD) * (order - 1) or chr(PAD)
    n_pad = len(pad)
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    real = np.ones(len(data), bool)
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + n_pad)]) if len(texts) else np.zeros(1, np.int64)
    for i in range(n_pad):
        real[starts + i] = False
    symbols, first = _ranked(data.astype(np.int64), PAD + 1)
    one, kinds = symbols.astype(np.int64), len(first)
    codes, suffix, context = [np.zeros((1, 0), np.uint32)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    ids, at = np.zeros(len(data), np.int32), np.zeros(1, np.int64)
    for n in range(1, order + 1):
        before = np.concatenate([ids[:1], ids[:-1]]).astype(np.int64)
        nxt, place = _ranked(before * kinds + one, len(at) * kinds)
        rows = place[:, None] + np.arange(1 - n, 1)
        codes.append(data[np.maximum(rows, 0)])
        suffix.append(ids[place].astype(np.int64))
        context.append(before[place])
        ids, at = nxt, place
    return Grams(codes, suffix, context, ids[real], bounds)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(codes), mix64(np.full(1, codes.shape[1] + 1, np.uint64))[0])
        for i in range(codes.shape[1]):
            h = mix64(h + codes[:, i].astype(np.uint64)) * _P
        return mix64(h)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """n-grams of one context stand in one shard."""
    return (gram_hashes(codes[:, : max(0, codes.shape[1] - 1)]) % np.uint64(shards)).astype(np.int32)


def _squeezed(a: np.ndarray) -> bytes:
    """The bytes of a number array by their place in a number, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unsqueezed(b: bytes, dtype) -> np.ndarray:
    size, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).reshape(-1)


def _narrowed(a: np.ndarray) -> bytes:
    """Floats to 16 bits of their significand, rounded, compressed in parts that are alike: which are negative, the three leading bytes of these, which of the others differ from the one before, and the leading bytes of those that do."""
    bits = np.ascontiguousarray(a, np.float32).view(np.uint32) + np.uint32(0x80) >> np.uint32(8)
    below = bits >> np.uint32(23) == 1
    rest = bits[~below]
    new = np.append(True, rest[1:] != rest[:-1])[: len(rest)]
    parts = [np.packbits(below), np.packbits(new)]
    for x in (bits[below], rest[new]):
        parts += [(x >> np.uint32(k)).astype(np.uint8) for k in (0, 8, 16)]
    out, codec = [len(bits).to_bytes(8, "little")], pa.Codec("zstd", compression_level=3)
    for x in parts:
        raw = codec.compress(x.tobytes(), asbytes=True)
        out += [len(raw).to_bytes(4, "little"), raw]
    return b"".join(out)


def _widened(b: bytes) -> np.ndarray:
    n, at = int.from_bytes(b[:8], "little"), 8

    def part(size: int) -> np.ndarray:
        nonlocal at
        start, at = at + 4, at + 4 + int.from_bytes(b[at : at + 4], "little")
        return np.frombuffer(pa.decompress(b[start:at], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)

    below = np.unpackbits(part(-(-n // 8)), count=n).astype(bool)
    k = n - int(np.count_nonzero(below))
    new = np.unpackbits(part(-(-k // 8)), count=k).astype(bool)
    value = lambda size: sum(part(size).astype(np.uint32) << np.uint32(8 + i) for i in (0, 8, 16))
    out = np.zeros(n, np.uint32)
    out[below] = value(n - k)
    out[~below] = value(int(np.count_nonzero(new)))[np.cumsum(new) - 1]
    return out.view(np.float32)


def _packed(codes: list[np.ndarray]) -> bytes:
    """n-grams of all orders, symbol by symbol, so that those with common beginnings cost little."""
    return _squeezed(np.concatenate([c.T.ravel() for c in codes])) if sum(c.size for c in codes) else b""


def _unpacked(b: bytes, numbers: list[int]) -> list[np.ndarray]:
    a = _unsqueezed(b, np.uint32) if b else np.zeros(0, np.uint32)
    out, at = [], 0
    for n, k in enumerate(numbers):
        out.append(a[at : at + n * k].reshape(n, k).T)
        at += n * k
    return out


def _strings(codes: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    n = codes.shape[1]
    text = np.ascontiguousarray(codes).tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + n] for i in range(0, len(text), n)] if n else [""] * len(codes), pa.string())


def _codes(grams: pa.Array, n: int) -> np.ndarray:
    """Strings of n characters as rows of code points."""
    return np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), n)


# ---- the model ----------------------------------------------------------------------------------------------------


class _Buffers:
    """Rows held for each model until they make a chunk. What a chunk holds depends on the order of the rows alone."""

    def __init__(self, chunk: int = CHUNK, held: int = HELD, rows: int = 50_000):
        self.chunk, self.held, self.rows = chunk, held, rows
        self.by: dict[str, list[tuple[str, object]]] = {}
        self.size: dict[str, int] = {}

    def add(self, model: str, text: str, row: object) -> Iterator[tuple[str, list[tuple[str, object]]]]:
        of = self.by.setdefault(model, [])
        of.append((text, row))
        self.size[model] = self.size.get(model, 0) + len(text)
        if self.size[model] >= self.chunk or len(of) >= self.rows:
            yield self.take(model)
        elif sum(self.size.values()) > self.held:
            yield self.take(max(self.size, key=self.size.get))

    def take(self, model: str) -> tuple[str, list[tuple[str, object]]]:
        self.size.pop(model)
        return model, self.by.pop(model)

    def rest(self) -> Iterator[tuple[str, list[tuple[str, object]]]]:
        for model in list(self.by):
            yield self.take(model)


def count_ngrams(texts: DataFrame, order: int, shards: int) -> DataFrame:
    """model, g, c of each n-gram of the highest order, with the sum of c, the numbers of n-grams of count 1, 2 and more for its first symbols (all, m1, m2, m3), and head at one of each such group.

    `texts` has model and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers = _Buffers()

        def packs(model: str, rows: list) -> pa.RecordBatch:
            g = grams_of([t for t, _ in rows], order)
            c = np.bincount(g.top, minlength=len(g.codes[order]))
            own = np.flatnonzero(c)
            codes, c = g.codes[order][own], c[own]
            at = shard_of(codes, shards)
            cells = [(s, np.flatnonzero(at == s)) for s in np.unique(at)]
            return pa.RecordBatch.from_arrays([pa.array([model] * len(cells), pa.string()), pa.array([int(s) for s, _ in cells], pa.int32()), pa.array([_squeezed(codes[i].T.ravel()) for _, i in cells], pa.binary()), pa.array([_squeezed(c[i].astype(np.int64)) for _, i in cells], pa.binary())], ["model", "shard", "grams", "counts"])

        for b in batches:
            for m, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for full in buffers.add(m, t, None):
                    yield packs(*full)
        for full in buffers.rest():
            yield packs(*full)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        codes, c = np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed(parts):
            g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            rows, at = np.unique(np.ascontiguousarray(g).view([("", np.uint32)] * order).ravel(), return_inverse=True)
            return rows.view(np.uint32).reshape(-1, order), np.bincount(at, n).astype(np.int64)

        for g, n in zip(t.column("grams"), t.column("counts")):
            held.append((_unsqueezed(g.as_py(), np.uint32).reshape(order, -1).T, _unsqueezed(n.as_py(), np.int64)))
            if sum(len(p[1]) for p in held[1:]) > 500_000:
                held = [summed(held)]
        if held:
            codes, c = summed(held)
        head = np.ones(len(c), bool)
        head[1:] = (codes[1:, :-1] != codes[:-1, :-1]).any(axis=1)
        group, first = np.cumsum(head) - 1, np.flatnonzero(head)
        per = lambda x: np.add.reduceat(x.astype(np.int64), first)[group] if len(c) else x.astype(np.int64)
        return pa.table([pa.array([key[0].as_py()] * len(c), pa.string()), _strings(codes), pa.array(c), pa.array(per(c)), *(pa.array(per(x)) for x in (c == 1, c == 2, c > 2)), pa.array(head)], names=["model", "g", "c", "all", "m1", "m2", "m3", "head"])

    packed = texts.select("model", "text").mapInArrow(tidied(run), "model string, shard int, grams binary, counts binary")
    return packed.groupBy("model", "shard").applyInArrow(merge, "model string, g string, c long, all long, m1 long, m2 long, m3 long, head boolean")


def _discounts(level: DataFrame) -> DataFrame:
    """model, d1, d2, d3: the discounts of counts of 1, 2 and more, and kinds, the number of n-grams. One row a model."""
    k = level.groupBy("model").agg(F.count(F.lit(1)).alias("kinds"), *(F.count(F.when(F.col("c") == i, 1)).cast("double").alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") + F.col("n2") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))))).otherwise(F.lit(0.5)) for i in (1, 2, 3)]
    return k.select("model", "kinds", *(x.alias(f"d{i + 1}") for i, x in enumerate(d)))


def model_table(top: DataFrame, order: int) -> DataFrame:
    """model, n, g, lp, lb: the log probability of each n-gram seen, the log weight that each context leaves to the order below, and, as n = 0, the log probability of a symbol never seen.

    `top` is of `count_ngrams`. Counts of the lower orders are of the different symbols before.
    """
    levels = [top]
    for n in range(order - 1, 0, -1):
        c = levels[-1].groupBy("model", F.substring("g", 2, n).alias("g")).agg(F.count(F.lit(1)).alias("c")).withColumn("x", F.substring("g", 1, n - 1))
        w = W.partitionBy("model", "x")
        count = lambda x: F.count(F.when(x, 1)).over(w)
        levels.append(materialise(c.select("model", "g", "c", F.sum("c").over(w).alias("all"), count(F.col("c") == 1).alias("m1"), count(F.col("c") == 2).alias("m2"), count(F.col("c") > 2).alias("m3"), (F.row_number().over(w.orderBy("g")) == 1).alias("head"))))
    below, out, stored = None, None, []
    for n, level in enumerate(reversed(levels), 1):
        own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        left = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("all")
        t = level.join(F.broadcast(_discounts(level)), "model").select("model", "g", "head", ((F.col("c") - own) / F.col("all")).alias("a"), left.alias("w"), "kinds")
        part = lambda df, n, g, lp, lb: df.select("model", F.lit(n).alias("n"), g.alias("g"), lp.cast("float").alias("lp"), lb.cast("float").alias("lb"))
        if n == 1:
            p = t.select("model", "g", (F.col("a") + F.col("w") / (F.col("kinds") + 1)).alias("p"))
            out = part(t.where("head"), 0, F.lit(""), F.log(F.col("w") / (F.col("kinds") + 1)), F.lit(None))
        else:
            low = below.select("model", F.col("g").alias("s"), F.col("p").alias("low"))
            p = t.withColumn("s", F.substring("g", 2, n - 1)).join(low, ["model", "s"]).select("model", "g", (F.col("a") + F.col("w") * F.col("low")).alias("p"))
            out = out.unionByName(part(t.where("head"), n - 1, F.substring("g", 1, n - 1), F.lit(None), F.log("w")))
        below = materialise(p) if n < order else p
        stored += [below] if n < order else []
        out = out.unionByName(part(below, n, F.col("g"), F.log("p"), F.lit(None)))
    table = materialise(out)
    discard(*levels[1:], *stored)
    return table


# ---- scoring ------------------------------------------------------------------------------------------------------


def _sharded(table: DataFrame, shards: int, salts: int) -> DataFrame:
    """The model's rows in each shard and salt that asks for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, at, weight = b.column("n").to_numpy(), np.zeros(b.num_rows, np.int32), b.column("lp").is_null().to_numpy(False)
            for k in np.unique(n).tolist():
                for i, of in ((np.flatnonzero((n == k) & ~weight), k), (np.flatnonzero((n == k) & weight), k + 1)):
                    codes = _codes(b.column("g").take(pa.array(i)), k)
                    at[i] = shard_of(codes if of == k else np.pad(codes, ((0, 0), (0, 1))), shards)  # a weight goes where the n-grams of its context are
            yield b.append_column("shard", pa.array(at))

    out = table.mapInArrow(tidied(run), T.StructType([*table.schema.fields, T.StructField("shard", T.IntegerType())]))
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


class _Table:
    """The n-grams of one model in a shard, by their hashes."""

    def __init__(self, t: pa.Table):
        n = t.column("n").to_numpy()
        self.p: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.b: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(n).tolist():
            own = t.filter(pa.array(n == k))
            for name, held in (("lp", self.p), ("lb", self.b)):
                some = own.filter(pc.is_valid(own.column(name)))
                h = gram_hashes(_codes(some.column("g").combine_chunks(), k))
                o = np.argsort(h)
                held[k] = h[o], some.column(name).to_numpy()[o]

    @staticmethod
    def find(held: tuple[np.ndarray, np.ndarray] | None, h: np.ndarray, default: float) -> np.ndarray:
        if held is None or not len(held[0]):
            return np.full(len(h), default, np.float32)
        at = np.minimum(np.searchsorted(held[0], h), len(held[0]) - 1)
        return np.where(held[0][at] == h, held[1][at], default).astype(np.float32)


def _answers(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
    """Of each chunk's questions to a shard: one number for each n-gram, to 16 bits, 1 part in 65,536.

    Of an n-gram seen, that is its log probability, with the sign bit set. Of one not seen, it is the log weight that its context leaves to the order
    below, with the sign bit clear: nothing else of the context is ever used.
    """
    models = {m: _Table(table.filter(pc.equal(table.column("model"), m))) for m in pc.unique(table.column("model")).to_pylist()}
    none = _Table(table.slice(0, 0))
    out = []
    for m, numbers, grams in zip(asked.column("model").to_pylist(), asked.column("numbers").to_pylist(), asked.column("grams")):
        t = models.get(m, none)
        told = []
        for n, codes in enumerate(_unpacked(grams.as_py(), numbers)):
            p = _Table.find(t.p.get(n), gram_hashes(codes), np.nan)
            new = np.flatnonzero(np.isnan(p)) if n else np.zeros(0, np.int64)
            p = np.copysign(p, np.float32(-1))
            p[new] = np.abs(_Table.find(t.b.get(n - 1), gram_hashes(codes[new, : n - 1]), 0.0)) if len(new) else p[new]
            told.append(p)
        out.append(_narrowed(np.concatenate(told)))
    tidy()
    return pa.table([asked.column("chunk"), pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "shard", "answers"])


def _log_probabilities(g: Grams, answers: dict[int, bytes], shards: int, at: list[np.ndarray] | None = None) -> np.ndarray:
    """The log probability of each n-gram of the highest order in a chunk; `at` has the shards of its n-grams, where they are known."""
    order = len(g.codes) - 1
    told = [np.full(len(c), np.nan, np.float32) for c in g.codes]
    at = at or [shard_of(c, shards) for c in g.codes]
    for s, raw in answers.items():
        a, k = _widened(raw), 0
        for n in range(order + 1):
            i = np.flatnonzero(at[n] == s)
            told[n][i] = a[k : k + len(i)]
            k += len(i)
    lp = told[0]
    for n in range(1, order + 1):
        lp = np.where(np.signbit(told[n]), told[n], lp[g.suffix[n]] - told[n])
    return lp


def distinct_share(texts: list[str]) -> np.ndarray:
    """The share of different ones among the sequences of three words of each text; 1 for shorter ones. Characters of scripts without blanks count as words."""
    data, at = joined(texts)
    word = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
    bare = (data >= 0xE0) & (data <= 0xED)
    begins = word & bare
    begins[1:] |= word[1:] & ~word[:-1]
    begins[:1] |= word[:1]
    begins[3:] |= word[3:] & bare[:-3]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(~word)
    ends = np.minimum(np.append(starts[1:], len(data)), stops[np.searchsorted(stops, starts)]) if len(starts) else starts
    doc = np.searchsorted(at, starts, "right") - 1
    with np.errstate(over="ignore"):
        h = span_hashes(data, starts, ends)
        three = mix64(mix64(h[:-2] * _P + h[1:-1]) * _P + h[2:])
        whole = doc[:-2] == doc[2:]
        three, of = three[whole], doc[:-2][whole]
        _, first = np.unique(mix64(three ^ mix64(of.astype(np.uint64) + np.uint64(1))), return_index=True)
    n, kinds = np.bincount(of, minlength=len(texts)), np.bincount(of[first], minlength=len(texts))
    return np.where(n > 0, kinds / np.maximum(n, 1), 1.0)


def _chunk_id(model: str, texts: list[str]) -> int:
    h = hashlib.blake2b(model.encode(), digest_size=8)
    for t in texts:
        h.update(t.encode("utf-8", "surrogatepass") + b"\xff")
    return int.from_bytes(h.digest(), "little", signed=True)


def score_texts(rows: DataFrame, table: DataFrame, order: int, text_at: int, shards: int, salts: int, keep_text: bool) -> DataFrame:
    """`rows` (row, a struct whose field `text_at` is the text; model; and any others) with n, the number of characters, h, the mean negative log probability of one, and share, that of `distinct_share`; these two null for texts without characters.

    Without `keep_text` the texts come back as null. `rows` is read twice and has to give the same rows in the same order, as a stored table does.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], list]]:
        buffers = _Buffers()
        for b in batches:
            texts = b.column(0).field(text_at).to_pylist()
            for i, (m, t) in enumerate(zip(b.column(1).to_pylist(), texts)):
                for m2, of in buffers.add(m, t or "", (b, i)):
                    yield m2, [t for t, _ in of], [r for _, r in of]
        for m2, of in buffers.rest():
            yield m2, [t for t, _ in of], [r for _, r in of]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, texts, _ in chunks(batches):
            if not any(texts):
                continue
            g, chunk = grams_of(texts, order), _chunk_id(model, texts)
            at = [shard_of(c, shards) for c in g.codes]
            out = []
            for s in np.unique(np.concatenate(at)).tolist():
                own = [c[a == s] for c, a in zip(g.codes, at)]
                out.append((s, chunk % salts, chunk, model, [len(c) for c in own], _packed(own)))
            c = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.list_(pa.int32())), pa.array(c[5], pa.binary())], ["shard", "salt", "chunk", "model", "numbers", "grams"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for model, texts, held in chunks(batches):
            parts: list[tuple[pa.RecordBatch, list[int]]] = []
            for b, i in held:
                if not parts or parts[-1][0] is not b:
                    parts.append((b, []))
                parts[-1][1].append(i)
            sink = pa.BufferOutputStream()
            # as one batch, so that all texts of a chunk are compressed together
            own = pa.Table.from_batches([b.take(pa.array(i)) for b, i in parts]).combine_chunks()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
                w.write_table(own)
            yield pa.RecordBatch.from_arrays([pa.array([_chunk_id(model, texts)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    fields = rows.schema.fields
    result = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("h", T.DoubleType()), T.StructField("share", T.DoubleType())])

    def score(key: tuple, stored: pa.Table, answered: pa.Table) -> pa.Table:
        answers = dict(zip(answered.column("shard").to_pylist(), (x.as_py() for x in answered.column("answers"))))
        out = []
        for raw in stored.column("rows"):
            t = pa.ipc.open_stream(raw.as_buffer()).read_all()
            texts = [x or "" for x in pc.struct_field(t.column("row"), [text_at]).to_pylist()]
            g = grams_of(texts, order)
            at = [shard_of(c, shards) for c in g.codes]
            used = set(np.unique(np.concatenate(at)).tolist())
            if any(texts) and used != answers.keys():
                raise RuntimeError("the texts differ between two reads; store them first")
            n = np.diff(g.bounds)
            sums = np.concatenate([[0.0], np.cumsum(_log_probabilities(g, answers, shards, at)[g.top], dtype=np.float64)]) if any(texts) else np.zeros(1)
            h = np.where(n > 0, -np.diff(sums[g.bounds]) / np.maximum(n, 1), np.nan)
            if not keep_text:
                row = t.column("row").combine_chunks()
                parts = [pa.nulls(len(row), row.field(i).type) if i == text_at else row.field(i) for i in range(row.type.num_fields)]
                t = t.set_column(0, "row", pa.StructArray.from_arrays(parts, fields=list(row.type)))
            t = t.append_column("n", pa.array(n, pa.int64()))
            for name, x in (("h", h), ("share", np.where(n > 0, distinct_share(texts), np.nan))):
                t = t.append_column(name, pa.array(x, pa.float64(), from_pandas=True))
            out.append(t)
        tidy()
        return pa.concat_tables(out) if out else _empty

    _empty = pa.table([pa.array([], f) for f in (pa.null(),) * len(result.fields)], names=result.names)
    questions = rows.mapInArrow(tidied(ask), "shard int, salt int, chunk long, model string, numbers array<int>, grams binary")
    answers = _sharded(table, shards, salts).groupBy("shard", "salt").cogroup(questions.groupBy("shard", "salt")).applyInArrow(_answers, "chunk long, shard int, answers binary")
    stored = rows.mapInArrow(tidied(keep), "chunk long, rows binary")
    return stored.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, result)


# ---- limits -------------------------------------------------------------------------------------------------------

#: The share of a group's trusted texts that may lie beyond a limit, and how many standard errors a limit allows for the number of texts it comes from.
TAIL, ERRORS = 0.005, 3.0


def _limits(trusted: DataFrame, group: list[str], tail: float) -> DataFrame:
    """For each group of `trusted`: top, the 1 - tail quantile of h, and new, the tail quantile of share, to 3 digits; the number of texts, and the standard deviations of both (at least 0.01)."""
    w = lambda x: W.partitionBy(*group).orderBy(x)
    out = None
    for x, name, q in (("h", "top", 1 - tail), ("share", "new", tail)):
        bins = trusted.groupBy(*group, F.round(x, 3).alias("x")).agg(F.count(F.lit(1)).alias("c"))
        bins = bins.withColumn("upto", F.sum("c").over(w("x"))).withColumn("all", F.sum("c").over(W.partitionBy(*group)))
        n, mean = F.sum("c"), F.sum(F.col("c") * F.col("x")) / F.sum("c")
        spread = F.sqrt(F.greatest(F.sum(F.col("c") * F.col("x") * F.col("x")) / n - mean * mean, F.lit(1e-4)))
        part = bins.groupBy(*group).agg(F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("x"))).alias(name), n.alias(f"of_{x}"), spread.alias(f"sd_{x}"))
        out = part if out is None else out.join(part, group)
    return out.select(*group, "top", "new", F.col("of_h").alias("of"), "sd_h", "sd_share")


def judged(docs: DataFrame, trusted: DataFrame, order: int = ORDER, tail: float = TAIL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_text: bool = True, repetition: bool = True) -> DataFrame:
    """row (a struct of the columns of `docs`, the text null without `keep_text`), model, n, h, share, top, keep. The texts whose id is in the first column of `trusted` train the models.

    A language with trusted texts in both halves has its own model; the others, and null, share that of all trusted texts.
    A text is rejected where its mean negative log probability lies above the 1 - tail quantile of the trusted texts of its language and
    length (powers of 2 of characters; where there are none, of its language) by more than ERRORS standard errors of their number; with
    `repetition`, also where its share of distinct word trigrams lies as far below the tail quantile of theirs, as in repetitive text. A text without characters has no perplexity and is kept; so are all
    without any trusted text. Nulls and repeats among the trusted ids do not matter; repeated rows give repeated rows.
    """
    text, lang = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col), F.lit(POOLED))
    ids, few_ids = checked_broadcast(materialise(trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id IS NOT NULL").distinct()), 2_000_000)
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), lang.alias("lang"), F.pmod(F.xxhash64(text, F.lit(5)), F.lit(2)).cast("string").alias("half"))
    inner = F.col("row").getField(text_col)
    d = d.join(ids, d["id"] == ids["_id"], "left").select("row", "lang", "half", (F.col("_id").isNotNull() & (inner != "")).alias("good"))
    sizes = d.groupBy("lang").agg(*(F.sum(F.when(F.col("half") == x, F.length(inner))).alias("chars" + x) for x in HALVES), F.max("good").alias("any"), F.countDistinct(F.when(F.col("good"), F.col("half"))).alias("halves"), F.sum(F.when(F.col("good"), F.length(inner))).alias("learnt"))
    sizes = materialise(sizes)
    total = sizes.agg(*(F.sum("chars" + x) for x in HALVES), F.sum("learnt"), F.max(F.when((F.col("halves") < 2) | (F.col("lang") == POOLED), 1)))
    *chars, learnt, pooled = total.first()
    own, few_own = checked_broadcast(sizes.where((F.col("halves") == 2) & (F.col("lang") != POOLED)).select(F.col("lang").alias("own")), 50_000)
    d = d.join(own, d["lang"] == own["own"], "left").drop("lang")
    if not (few_ids and few_own):
        d = materialise(d)  # a shuffle may give rows in another order each time
    name = lambda half: F.concat(F.coalesce("own", F.lit(POOLED)), F.lit(":"), half)
    good = d.where("good").select(inner.alias("text"), name(F.col("half")).alias("model"), F.concat(F.lit(POOLED + ":"), "half").alias("all"), F.col("own").isNotNull().alias("has"))
    teach = good.where("has").select("model", "text")
    if pooled:
        teach = teach.unionByName(good.select(F.col("all").alias("model"), "text"))
    top = materialise(count_ngrams(teach, order, -(-(learnt or 0) // 64_000_000) or 1))
    table = model_table(top, order)
    discard(top)
    text_at = docs.columns.index(text_col)
    scored = None
    # one half's texts meet the other half's models only, so each half has its turn, and what is shuffled for one is gone before the other's
    for x, n in zip(HALVES, chars):
        rows = d.where(F.col("half") == x).select("row", name((1 - F.col("half").cast("int")).cast("string")).alias("model"), "good")
        known = table.where(F.col("model").endswith(f":{1 - int(x)}"))
        shards = max(1, -(-known.count() // 400_000))
        salts = max(1, -(-(n or 0) // (shards * 300_000_000)))
        part = materialise(score_texts(rows, known, order, text_at, shards, salts, keep_text))
        scored = part if scored is None else scored.unionByName(part)
    discard(table)
    return _verdict(scored.withColumn("model", F.split("model", ":(?=[01]$)")[0]), tail, repetition)


def _verdict(scored: DataFrame, tail: float, repetition: bool) -> DataFrame:
    scored = scored.withColumn("size", F.floor(F.log2("n")))
    known = scored.where(F.col("good") & F.col("h").isNotNull())
    every = _limits(known, ["model"], tail)
    like = _limits(known, ["model", "size"], tail).drop("sd_h", "sd_share").join(every.select("model", "sd_h", "sd_share"), "model")
    # a quantile of few texts is known less well; the error falls with their number and is the same rule at any
    some = lambda df, tag, keys: materialise(df.select(*(F.col(k).alias(k[0] + tag) for k in keys), *((F.col(x) + sign * ERRORS * F.col(sd) / F.sqrt("of")).alias(x + tag) for x, sign, sd in (("top", 1, "sd_h"), ("new", -1, "sd_share")))))
    # some tens of rows a language
    like, every = checked_broadcast(some(like, "1", ["model", "size"]), 1_000_000)[0], checked_broadcast(some(every, "2", ["model"]), 1_000_000)[0]
    out = scored.join(like, (F.col("model") == F.col("m1")) & (F.col("size") == F.col("s1")), "left").join(every, F.col("model") == F.col("m2"), "left")
    top, new = F.coalesce("top1", "top2"), F.coalesce("new1", "new2")
    keep = F.round("h", 3) <= top
    keep = keep & (F.round("share", 3) >= new) if repetition else keep
    return out.select("row", "model", "n", "h", "share", top.alias("top"), F.coalesce(keep, F.lit(True)).alias("keep"))


def score_quality(docs: DataFrame, trusted: DataFrame, order: int = ORDER, tail: float = TAIL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", repetition: bool = True) -> DataFrame:
    """doc_id, model, n_chars, perplexity (of a character), threshold, new_share (of distinct word trigrams), keep for each row, by `judged`.

    Other columns are ignored; an empty table gives no rows.
    """
    out = judged(docs.select(id_col, text_col, lang_col), trusted, order, tail, id_col, text_col, lang_col, keep_text=False, repetition=repetition)
    return out.select(F.col("row").getField(id_col).alias("doc_id"), "model", F.col("n").alias("n_chars"), F.exp("h").alias("perplexity"), F.exp("top").alias("threshold"), F.col("share").alias("new_share"), "keep")


def filter_quality(docs: DataFrame, trusted: DataFrame, order: int = ORDER, tail: float = TAIL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", repetition: bool = True) -> DataFrame:
    """The rows of `docs`, with all their columns, that `judged` keeps."""
    return judged(docs, trusted, order, tail, id_col, text_col, lang_col, repetition=repetition).where("keep").select("row.*")
