"""Operator 2: n-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are the distinct shingle sets, columns are shingles. Only the entries of the product that can reach the
limit are computed. Which ones these are is known from few columns: two sets that are similar enough share an entry
among the first few of their shingles in any fixed order, which puts shingles that are known to be frequent last, for
speed alone. In tiles of at most `tile` rows of such a column, pairs are given up that a bound on their sizes, or on the
symmetric difference that a parity bitmap proves, rules out. For all others, overlap counts are accumulated over two
blocks of columns: after the first, a pair goes unless its count so far and the sizes of what is left can reach the
limit; the sum over both decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.llm.common import LOWER, checked_broadcast, discard, joined, materialise, shingle_hashes, text_blocks, tidied, word_hashes, word_spans
from cohortmill.llm.components import connected_components

#: Words are runs of bytes other than white space.
_IS_WORD = np.ones(256, bool)
_IS_WORD[0x20] = False
_IS_WORD[0x09:0x0E] = False
BITS = 8  # words of 64 bits in a parity bitmap
WIDE_BITS, WIDE_FROM = 8192, 1000  # of the second bitmap, which sets of so many shingles get


def _sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    data, at = joined(texts)
    low = LOWER[data]
    starts, ends = word_spans(low, _IS_WORD)
    with np.errstate(over="ignore"):
        words = word_hashes(low, starts, ends)
        cut = np.searchsorted(starts, at)
        return [shingle_hashes(words[cut[i] : cut[i + 1]], n) for i in range(len(texts))]


def _digest(s: np.ndarray) -> bytes:
    """A digest of 128 bits of the whole set, the same for equal sets."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _bitmap(s: np.ndarray, bits: int = 64 * BITS) -> np.ndarray:
    """The parity of the number of shingles that fall on each bit: each difference between two sets flips one bit."""
    return np.packbits((np.bincount((s >> np.uint64(17)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _frequent(docs: DataFrame, n: int, share: float, sample_docs: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are not rare, and about how many documents hold each; at most `most` of them. Only an order is made from it.

    The hashes below `share`, from which the first entries are taken, are counted in all documents, the others in
    `sample_docs` of them. What is kept is bounded by `most` however many there are: the counts of counts say from which count on.
    """
    total = docs.count()
    if not total or not most:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    part = max(1e-6, min(1.0, sample_docs / total))
    limit = np.uint64(int(share * (2**64 - 1)))
    drawn = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, texts in text_blocks(batches):
            s = _sets(texts, n)
            s = [x if f else x[: np.searchsorted(x, limit)] for x, f in zip(s, few.to_pylist())]
            h, c = np.unique(np.concatenate(s), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["h", "c"])

    counted = docs.select(drawn < int(1_000_000 * part), "text").mapInArrow(tidied(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    # hashes are unsigned: from `limit` on they were counted in the sample only
    high = (F.col("h") >= int(limit)) | (F.col("h") < 0) if limit < 1 << 63 else (F.col("h") < 0) & (F.col("h") >= int(limit) - (1 << 64))
    counted = materialise(counted.select("h", F.when(high, F.col("c") / part).otherwise(F.col("c")).cast("long").alias("c")))
    least, held = 1 << 62, 0
    for r in sorted(counted.groupBy(F.least("c", F.lit(10_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["c"]):
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    t = counted.where(F.col("c") >= least).toArrow()
    discard(counted)
    h, c = t.column("h").to_numpy().view(np.uint64), t.column("c").to_numpy()
    o = np.argsort(h)
    return h[o], c[o]


def _signatures(docs: DataFrame, n: int, num: int, den: int, frequent) -> DataFrame:
    """doc_id, rid (the row's digest), n_shingles, digest (of its set), prefix, bitmap, wide of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, count = frequent.value
        for b in batches:
            start = 0
            for rid, texts in text_blocks(iter([b.select([1, 2])])):
                ids = b.column(0).slice(start, len(texts))
                start += len(texts)
                sizes, nodes, prefixes, bitmaps, wide = [], [], [], [], []
                for s in _sets(texts, n):
                    sizes.append(len(s))
                    if not len(s):
                        nodes.append(None)
                        prefixes.append([])
                        bitmaps.append([0] * BITS)
                        wide.append(None)
                        continue
                    p = len(s) - -(-num * len(s) // den) + 1
                    first = s[:p]
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        weight = np.where(heavy[at] == s, count[at], 0)
                        if weight.any():
                            first = s[np.argsort(weight, kind="stable")[:p]]
                    nodes.append(_digest(s))
                    prefixes.append(first.view(np.int64))
                    bitmaps.append(_bitmap(s))
                    wide.append(_bitmap(s, WIDE_BITS).tobytes() if len(s) >= WIDE_FROM else None)
                yield pa.RecordBatch.from_arrays([ids, rid, pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bitmaps, pa.list_(pa.int64())), pa.array(wide, pa.binary())], ["doc_id", "rid", "n_shingles", "digest", "prefix", "bitmap", "wide"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "rid", "text").mapInArrow(tidied(run), f"doc_id {kind}, rid binary, n_shingles long, digest binary, prefix array<long>, bitmap array<long>, wide binary")


def _may_link(num: int, den: int):
    """The bounds on a pair with sizes na, nb and bitmaps wa0.., wb0..: overlap o links when den * o >= num * (na + nb - o)."""
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    differ = sum((F.bit_count(F.col(f"wa{i}").bitwiseXOR(F.col(f"wb{i}"))) for i in range(BITS)), F.lit(0))
    # o <= (na + nb - differ) / 2, and o must be at least num * (na + nb) / (num + den)
    return (F.lit(den) * low >= F.lit(num) * high) & ((num + den) * (F.col("na") + F.col("nb") - differ) >= 2 * num * (F.col("na") + F.col("nb")))


def _close(pairs: DataFrame, one: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b, sizes: the sum of both) the pairs (a, b) that the wide bitmaps of long sets, in `one` (node, wide), do not rule out."""
    side = lambda x: one.where("wide IS NOT NULL").select(F.col("node").alias(x), F.col("wide").alias("w" + x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for sizes, wa, wb in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                differ = 0 if wa is None or wb is None else int(np.bitwise_count(np.frombuffer(wa, np.uint64) ^ np.frombuffer(wb, np.uint64)).sum())
                keep.append((num + den) * (sizes - differ) >= 2 * num * sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", "sizes", "wa", "wb").mapInArrow(tidied(run), "a long, b long")


#: Of 256 parts of the range of hashes, those of the first block of columns.
FIRST = 32


def _overlaps(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The overlap counts of pairs of sorted sets: of each run of pairs with one left side, all products at once."""
    out, i = np.zeros(len(a), np.int64), 0
    while i < len(a):
        j = i + 1
        while j < len(a) and a[j] == a[i]:
            j += 1
        x = np.frombuffer(a[i], np.uint64)
        y = np.frombuffer(b"".join(b[i:j]), np.uint64)
        if len(x) and len(y):
            hits = np.concatenate([[0], np.cumsum(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)])
            ends = np.cumsum([len(z) // 8 for z in b[i:j]])
            out[i:j] = hits[ends] - hits[np.concatenate([[0], ends[:-1]])]
        i = j
    return out


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by the overlap counts of their sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = materialise(nodes.join(wanted, "node", "left_semi").select("digest", "node", "rid"))
    asked_of, _ = checked_broadcast(asked, 1_000_000)
    rids = asked_of.select("rid")
    texts = docs.join(rids, "rid", "left_semi").select("rid", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in text_blocks(batches):
            s = _sets(block, n)
            cut = [int(np.searchsorted(x, np.uint64(FIRST << 56))) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in s], pa.binary()), pa.array([len(x) for x in s], pa.int64()), pa.array(cut, pa.int64()), pa.array([x[:c].tobytes() for x, c in zip(s, cut)], pa.binary()), pa.array([x[c:].tobytes() for x, c in zip(s, cut)], pa.binary())], ["digest", "size", "cut", "first", "rest"])

    sets = texts.mapInArrow(tidied(to_sets), "digest binary, size long, cut long, first binary, rest binary").join(asked_of.select("digest", "node"), "digest").drop("digest")
    # a row that stands several times gives its set several times
    sets = materialise(sets.dropDuplicates(["node"]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = _overlaps(b.column(2).to_pylist(), b.column(3).to_pylist())
            na, nb, ca, cb = (b.column(i).to_numpy() for i in range(4, 8))
            most = o + np.minimum(na - ca, nb - cb)
            keep = (num + den) * most >= num * (na + nb)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(o), pa.array(na + nb)], ["a", "b", "o", "sizes"]).filter(pa.array(keep))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = b.column(2).to_numpy() + _overlaps(b.column(4).to_pylist(), b.column(5).to_pylist())
            keep = (num + den) * o >= num * b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    side = lambda x, part: sets.select(F.col("node").alias(x), F.col(part).alias("m" + x), F.col("size").alias("n" + x), F.col("cut").alias("c" + x))
    joined_first = pairs.join(side("b", "first"), "b").join(side("a", "first"), "a").select("a", "b", "ma", "mb", "na", "nb", "ca", "cb")
    left = materialise(joined_first.mapInArrow(tidied(first), "a long, b long, o long, sizes long"))
    joined_rest = left.join(side("b", "rest").select("b", "mb"), "b").join(side("a", "rest").select("a", "ma"), "a").select("a", "b", "o", "sizes", "ma", "mb")
    links = materialise(joined_rest.mapInArrow(tidied(rest), "a long, b long"))
    discard(asked, sets, left)
    return links


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns), doc_id, text, and rid, a digest of these two."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.withColumn("rid", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("\0"), F.col("text")))))


def _groups(d: DataFrame, n: int, num: int, den: int, sample_docs: int, most_frequent: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows of `d` (doc_id, text, rid), and for each set (digest) its component's root and smallest doc_id and its number of rows."""
    spark = d.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(d, n, min(1.0, 2 * (1 - num / den)), sample_docs, most_frequent))
    wide = materialise(_signatures(d, n, num, den, frequent).withColumn("node", F.monotonically_increasing_id()))
    sig = materialise(wide.select("doc_id", "rid", "n_shingles", "digest"))
    # a set is known by the number of one of its rows as stored
    nodes = wide.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("rid", "node")).alias("one"), F.min("n_shingles").alias("size"), F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.select("digest", "one.rid", "size", "min_id", "copies", "one.node"))
    # the other rows of sets are told by their numbers, which are few and small, so the signatures stay where they are
    known = wide.where("digest IS NOT NULL")
    others = materialise(known.select("node").join(nodes.select("node"), "node", "left_anti"))
    others_of, _ = checked_broadcast(others, 1_000_000)
    one = materialise(known.select("node", "n_shingles", "prefix", "bitmap", "wide").join(others_of, "node", "left_anti"))
    discard(wide, others)
    column = W.partitionBy("s")
    entries = one.select(F.posexplode("prefix").alias("pos", "s"), "node")
    entries = materialise(entries.select("s", "pos", "node", F.count(F.lit(1)).over(column).alias("block"), F.min("node").over(column).alias("leader")).where("block > 1"))
    words = [F.col("bitmap")[i] for i in range(BITS)]

    def side(x: str) -> DataFrame:
        return one.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), *(w.alias(f"w{x}{i}") for i, w in enumerate(words)))

    star = entries.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b").where(_may_link(num, den))
    pairs = materialise(_close(star.select("a", "b", (F.col("na") + F.col("nb")).alias("sizes")), one, num, den))
    links = _verified(pairs, d, nodes, n, num, den)
    discard(pairs)
    # what links to one leader is joined already; chains of leaders are left to the end
    roots = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))

    marked = entries.join(roots, "node", "left").select("s", "pos", "block", "node", F.coalesce("root", "node").alias("root"))
    mixed = marked.withColumn("r0", F.min("root").over(column)).withColumn("r1", F.max("root").over(column)).where("r0 != r1")
    marked = materialise(mixed.drop("r0", "r1"))
    discard(entries)
    rest = marked
    # a pair is made at the first of the columns that both are in; sets in very many columns do without
    lists = rest.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("all")).select("node", F.when(F.size("all") <= 64, F.col("all")).alias("all"))
    rest = rest.join(lists, "node").join(side("node"), "node")
    rest = rest.withColumn("tiles", F.ceil(F.col("block") / tile)).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")))
    rest = materialise(rest)
    discard(marked)

    # a row stands in one cell for each tile of its column: its own tile with that one. Both sides of the join are this table, so it is shuffled once
    cells = rest.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cells = cells.withColumn("t0", F.least("t", "u")).withColumn("t1", F.greatest("t", "u"))

    def tiled(x: str) -> DataFrame:
        return cells.select("s", "t0", "t1", F.col("t").alias(f"t{x}"), F.col("node").alias(x), F.col("pos").alias(f"p{x}"), F.col("root").alias(f"root{x}"), F.col("nnode").alias(f"n{x}"), F.col("all").alias(f"all{x}"), *(F.col(f"wnode{i}").alias(f"w{x}{i}") for i in range(BITS)))

    # nothing before the first column is shared, so what stands from there on in both bounds the overlap; at later columns a pair may be lost, as it is made at the first
    at_first = (num + den) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= num * (F.col("na") + F.col("nb"))
    once = (F.col("ta") < F.col("tb")) | (F.col("t0") == F.col("t1")) & (F.col("a") < F.col("b"))
    cross = tiled("a").join(tiled("b"), ["s", "t0", "t1"]).where((F.col("roota") != F.col("rootb")) & once & _may_link(num, den) & at_first & F.coalesce(F.get(F.array_intersect("alla", "allb"), F.lit(0)) == F.col("s"), F.lit(True)))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("sizes")).distinct()
    pairs2 = materialise(_close(cross, one, num, den))
    discard(rest, one)
    links2 = _verified(pairs2, d, nodes, n, num, den)
    discard(pairs2)
    roots = connected_components(links.unionByName(links2))

    groups = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = groups.groupBy("root").agg(F.min("min_id").alias("component_id"))
    by_set = materialise(groups.join(smallest, "root").select("digest", "root", "component_id", "copies"))
    discard(nodes, links, links2)
    return sig, by_set


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, sample_docs: int = 4096, most_frequent: int = 2_000_000, tile: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents link when den * overlap >= num * union of their shingle sets.

    Words are runs other than ASCII white space with A-Z in lower case; a shingle is n consecutive words, and a shorter
    text is one shingle. component_id is the smallest doc_id that links reach, the own one included. Texts without words,
    null or empty, have no shingles and link with nothing. Rows with equal sets link, also those with equal ids, each row
    by its own text; a null id never is a component_id unless no other is reached. Other columns are ignored; an empty
    table gives no rows. Shingles are told apart by 64-bit hashes within a pair, whole sets and rows by 128-bit digests.

    Equal sets are one node, numbered on the stored table. Links are looked for in two passes: each member of a column against the column's smallest
    node, then all pairs of a column that those links have not joined yet. `sample_docs` and `most_frequent` bound what
    is gathered to order the shingles, not what is compared.
    """
    sig, by_set = _groups(_rows(docs, id_col, text_col).drop("row"), n, num, den, sample_docs, most_frequent, tile)
    by_set = by_set.drop("root")
    # sets of a thousandth of all rows each, at most a thousand, are joined as a broadcast, so that no task gets all copies of one
    hot = F.broadcast(by_set.where(F.col("copies") > max(1000, sig.count() // 1000)).select("digest", F.col("component_id").alias("of_hot"), F.lit(True).alias("hot")))
    rows = sig.select("doc_id", "n_shingles", "digest").join(hot, "digest", "left")
    done = rows.where("hot OR digest IS NULL").select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("of_hot")).alias("component_id"))
    rest = rows.where("hot IS NULL AND digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(by_set.drop("copies"), "digest")
    return done.unionByName(rest.select("doc_id", "n_shingles", "component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, sample_docs: int = 4096, most_frequent: int = 2_000_000, tile: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, of which one of each component of `ngram_join` stays: that of the smallest id (null last), of equal ids one, of equal rows one. Texts without words all stay."""
    d = _rows(docs, id_col, text_col)
    sig, by_set = _groups(d.drop("row"), n, num, den, sample_docs, most_frequent, tile)
    firsts = sig.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
    best = by_set.select("digest", "root").join(firsts, "digest").groupBy("root").agg(F.min("first").alias("first")).select("first.rid")
    best = materialise(best)
    keep, _ = checked_broadcast(materialise(best.unionByName(sig.where("digest IS NULL").select("rid")).distinct()), 1_000_000)
    out = d.join(keep, "rid", "left_semi")
    twice = materialise(sig.where("digest IS NOT NULL").groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(best, "rid", "left_semi").select("rid", F.lit(True).alias("twice")))
    if not twice.isEmpty():
        out = out.join(twice, "rid", "left")
        one = out.where("twice").withColumn("_n", F.row_number().over(W.partitionBy("rid").orderBy("rid"))).where("_n = 1")
        out = out.where("twice IS NULL").select("row").unionByName(one.select("row"))
    return out.select("row.*")
