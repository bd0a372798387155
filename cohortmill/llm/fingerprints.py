"""Operator 1: document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is the set of the digests of its paragraphs, a line or a sentence each; a paragraph that stands in it several times counts
once. A sketch has three subtables; each digest stands in one cell of each, which keeps the count and the exclusive ors of
digests and of their checks. The fingerprint of a text is its sketch. Cells of two versions' fingerprints subtract to a
sketch of the difference. A cell of one digest gives it away; taking it out of its other cells frees further ones.
Subtables take turns, so no digest comes out twice in a turn. What is left after two turns of each subtable is written and
goes on; it is a small part of the cells, and after some more turns nothing. Where something is left at the end, the pair is
tried again with sketches of larger subtables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortmill.llm.common import materialise, new_path

PARAGRAPH = r"\n+|(?<=[.!?]) +"
#: Cells of each of the three subtables of a fingerprint, and of the larger sketches of pairs whose difference it can't tell; ever larger ones follow.
PRINT_CELLS, LARGER = 64, (512, 4096, 32768)


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.filter(F.split(text, PARAGRAPH), lambda p: p != ""), lambda p: F.xxhash64(p)))


def _cell(digest: Column, table: int, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return (F.lit(table).cast("long") * size + F.pmod(F.xxhash64(digest, F.lit(101 + table)), size)).cast("long")


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(17))


#: What a text is known by: its id, a hash of it, and a hash of both by which rows are dealt out.
_WHERE = ("at", "key", "row")


def sketch(sets: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, cell, n, d, c: the cells of the sketch of each array `set` of digests, with `size` cells in each subtable; cells that no digest is in are left out."""
    one = sets.select(*keys, F.explode("set").alias("d"))
    one = one.select(*keys, "d", F.explode(F.array(*(_cell(F.col("d"), t, size) for t in range(3)))).alias("cell"))
    return one.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("d").alias("d"), F.bit_xor(_check(F.col("d"))).alias("c"))


def _difference(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cells with the same place joined, those that come to nothing left out."""
    g = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
    return g.where((F.col("n") != 0) | (F.col("d") != 0) | (F.col("c") != 0) | (F.col("cell") < 0))


def _round(cells: DataFrame, size: int) -> DataFrame:
    """One turn of each subtable. `cells` is dealt out by `at`, and every grouping here keeps to that. The cell -1 of a pair counts the digests that have come out."""
    keys = (*_WHERE, "which")
    for table in range(3):
        pure = (F.col("cell") >= table * size) & (F.col("cell") < (table + 1) * size) & (F.abs("n") == 1) & (F.col("c") == _check(F.col("d")))
        item = lambda cell, n, d, c: F.struct(cell.alias("cell"), n.alias("n"), d.alias("d"), c.alias("c"))
        zero = F.lit(0).cast("long")
        out = [item(_cell(F.col("d"), t, size), -F.col("n"), F.col("d"), F.col("c")) for t in range(3) if t != table]
        out.append(item(F.lit(-1).cast("long"), F.lit(1).cast("long"), zero, zero))
        x = F.explode(F.when(pure, F.array(*out)).otherwise(F.array(item(F.col("cell"), F.col("n"), F.col("d"), F.col("c")))))
        cells = _difference(cells.select(*keys, x.alias("x")).select(*keys, "x.cell", "x.n", "x.d", "x.c"), keys)
    return cells


#: A pair that has more than this part of its cells left after two rounds holds more digests than peeling can tell apart.
_FULL = 0.8


def peel(cells: DataFrame, size: int, rounds: int) -> DataFrame:
    """key, row, which, found, left: of each subtracted sketch the number of digests recovered and of cells left over. `cells` is dealt out by `at`.

    Two rounds are done where the cells are made; of what they leave only the pairs with some cells left, and not nearly all, go on.
    """
    keys = [*_WHERE, "which"]
    first = _round(_round(cells, size), size)
    pair = W.partitionBy(*keys)
    first = first.withColumns({"_n": F.count(F.when(F.col("cell") >= 0, 1)).over(pair), "_last": F.max("cell").over(pair)})
    # of the cells of a hopeless pair one stays, which says that something is left
    left, done = materialise(first.where((F.col("cell") < 0) | (F.col("_n") <= int(_FULL * 3 * size)) | (F.col("cell") == F.col("_last"))).drop("_n", "_last")), None
    for i in range(rounds - 1):
        per = left.groupBy(*keys).agg(F.sum(F.when(F.col("cell") < 0, F.col("n")).otherwise(0)).alias("found"), F.count(F.when(F.col("cell") >= 0, 1)).alias("left"))
        if i == rounds - 2:
            break
        per = materialise(per)
        goes_on = per.where("left > 1").select(*keys)
        if goes_on.isEmpty():
            break
        ended = per.join(goes_on, keys, "left_anti")
        done = ended if done is None else done.unionByName(ended)
        left = materialise(_round(left.join(goes_on, keys, "left_semi"), size))
    return per if done is None else done.unionByName(per)


def _pairs(cells: DataFrame) -> DataFrame:
    """The cells of own, edited and next text as those of the two subtracted pairs: own less edited, own less next."""
    to = F.when(F.col("kind") == "own", F.array(F.lit("edited"), F.lit("next"))).otherwise(F.array(F.col("kind")))
    n = F.when(F.col("kind") == "own", F.col("n")).otherwise(-F.col("n"))
    return _difference(cells.select(*_WHERE, F.explode(to).alias("which"), "cell", n.alias("n"), "d", "c"), (*_WHERE, "which"))


def fingerprints(sets: DataFrame, size: int = PRINT_CELLS) -> DataFrame:
    """key, row, kind, print: the sketch of each as text, cell=count:digests:checks for each cell that is not empty, numbers in hexadecimal."""
    cells = sketch(sets, size, (*_WHERE, "kind"))
    say = F.concat_ws(":", F.hex("n"), F.hex("d"), F.hex("c"))
    cell = F.struct("cell", F.concat(F.hex("cell"), F.lit("="), say).alias("s"))
    return cells.groupBy(*_WHERE).agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, cell))), lambda x: x["s"]), ",").alias(k) for k in ("own", "edited")))


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join of rows that stand for the same text. Spark deals both sides out by all columns that are compared for equality, so only `at` is, by which they already are; the others are compared otherwise."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in _WHERE})
    same = lambda c: F.col(c).bitwiseXOR(F.col(f"_r_{c}")) == 0
    return left.join(right, (F.col("at") == F.col("_r_at")) & same("key") & same("row"), how).drop(*(f"_r_{c}" for c in _WHERE))


def _dealt(df: DataFrame, rows: int, part: int) -> DataFrame:
    """`df` written to the shared folder, dealt out by `at` into parts of about `part` of `rows`. Only a table in the catalog can say that it is, so it stands there until it has been looked up."""
    spark, name = df.sparkSession, "t" + uuid.uuid4().hex
    df.write.format("parquet").bucketBy(max(4, -(-rows // part)), "at").option("path", new_path(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def _sets(one: DataFrame) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("set")) for k, c in (("own", "own"), ("edited", "edit"), ("next", "next_set"))))
    return one.select(*_WHERE, F.explode(kinds).alias("x")).select(*_WHERE, "x.kind", "x.set")


def likeness(one: DataFrame, rows: int, sizes: tuple[int, ...] = (PRINT_CELLS, *LARGER), rounds: int = 6) -> DataFrame:
    """key, row, which, likeness: shared digests as a part of all digests of both, from what peeling the subtracted fingerprints recovers.

    `one`, of about `rows` rows, has key, row and digest arrays own, edit and next_set, and is dealt out by `at`. Equal sets, two empty ones too, are
    1. Larger sketches than fingerprints are made only of the texts of pairs that fail, as long as there are such.
    """
    all_of = F.explode(F.array(*(F.struct(F.lit(w).alias("which"), (F.size("own") + F.size(c)).alias("total")) for w, c in (("edited", "edit"), ("next", "next_set")))))
    totals = one.select(*_WHERE, all_of.alias("x")).select(*_WHERE, "x.which", "x.total")
    keys, todo, done, level = [*_WHERE, "which"], one, None, 0
    while True:
        size = sizes[level] if level < len(sizes) else sizes[-1] * 8 ** (level - len(sizes) + 1)
        # digests were dealt out once; their cells, which are many more, stay where they are made
        found = peel(_pairs(sketch(_sets(todo), size, (*_WHERE, "kind"))), size, rounds)
        want = totals if not level else todo.select(*_WHERE, F.explode("again").alias("again")).select(*_WHERE, "again.which", "again.total")
        peeled = materialise(want.join(found, keys, "left").withColumn("found", F.coalesce("found", F.lit(0))).withColumn("left", F.coalesce("left", F.lit(0))))
        shared = (F.col("total") - F.col("found")) / 2
        good = peeled.where("left = 0").select(*keys, F.when(F.col("total") == 0, F.lit(1.0)).otherwise(shared / (shared + F.col("found"))).alias("likeness"))
        done = good if done is None else done.unionByName(good)
        failed = peeled.where("left > 0")
        if failed.isEmpty():
            return done
        failed = materialise(failed.groupBy(*_WHERE).agg(F.collect_list(F.struct("which", "total")).alias("again")))
        rows = failed.count()
        # of a text that has one pair left, the other pair's set is not needed again
        still = lambda c, w: F.when(F.exists("again", lambda x: x["which"] == w), F.col(c)).otherwise(F.array().cast("array<bigint>")).alias(c)
        todo = _dealt(_beside(todo.drop("again"), failed).select(*_WHERE, "own", still("edit", "edited"), still("next_set", "next"), "again"), rows, 500)
        level += 1


def next_ids(ids: DataFrame) -> DataFrame:
    """key, next: of each distinct key the next smaller one, of the smallest the largest. Ranges of keys are looked at on their own, and the few edges of the ranges are joined."""
    dealt = materialise(ids.select("key").repartitionByRange("key").select("key", F.spark_partition_id().alias("part")))
    inside = dealt.withColumn("next", F.lag("key").over(W.partitionBy("part").orderBy("key")))
    edges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edges = edges.select("low", F.coalesce(F.lag("high").over(W.orderBy("part")), F.last("high").over(every)).alias("edge"))
    return inside.join(edges, inside["key"] == edges["low"], "left").select("key", F.coalesce("next", "edge").alias("next"))


def version_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text has its last floor(n_chars / 3) characters replaced by the first as many, or all, of the next document
    by descending id, after the last the first. Ids are whole numbers; a null id counts as the smallest number. Rows that
    share an id have the same next id, and stand for it together with the smallest of their texts. A null or empty text has no
    paragraphs; two such are alike by 1, one and another text by 0. Other columns are ignored, an empty table gives no rows.
    """
    t = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = materialise(t.groupBy("key").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")))
    after = next_ids(ids)
    wants = materialise(after.join(ids, "key").select(F.col("next").alias("key"), F.col("key").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("need")))
    give = t.join(wants, "key").select("to", F.struct(F.col("text").substr(F.lit(1), F.col("need")).alias("head"), digests(F.col("text")).alias("set")).alias("given"))
    give = give.groupBy(F.col("to").alias("key")).agg(F.min("given").alias("given"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("given.head").substr(F.lit(1), cut))
    both = t.join(give, "key").select("key", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.col("given.set").alias("next_set"))
    row = F.xxhash64("text")
    both = both.select(F.xxhash64("key", row).alias("at"), "key", "n_chars", row.alias("row"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edit"), "next_set")
    rows = ids.agg(F.sum("rows")).first()[0] or 0
    return _finish(_dealt(both, rows, 5000), rows)


def _finish(both: DataFrame, rows: int) -> DataFrame:
    # the sets of both pairs stand in one row for each different text of an id
    one = both.dropDuplicates([*_WHERE]).select(*_WHERE, "own", "edit", "next_set")
    near = likeness(one, rows).groupBy(*_WHERE).agg(*(F.max(F.when(F.col("which") == w, F.col("likeness"))).alias(f"near_{w}") for w in ("edited", "next")))
    prints = fingerprints(_sets(one).where("kind <> 'next'")).withColumnsRenamed({"own": "fingerprint", "edited": "edited_fingerprint"})
    out = _beside(_beside(both.drop("own", "edit", "next_set"), near), prints, "left")
    doc_id = F.when(F.col("key") != F.lit(-(1 << 63)).cast("long"), F.col("key"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", blank("fingerprint"), blank("edited_fingerprint"), "near_edited", "near_next")
