"""Operator 11: the cheapest repair of a conversation's structure, by a program over runs of equal messages.

A message is a symbol: the class of its role and its fault. Equal consecutive symbols are a run. How a message moves the roles
written so far on to others is a 4 x 4 matrix of least costs; a run of n is the n-th power of its symbol's matrix, taken from
cached powers of two. The costs still to come at the end of each run are found from the last run back, and the edits are then
read off from the first, the least letter among the cheapest.

The work is done in three stages. Messages without their texts (a digest stands for each) are counted and sorted by range, so
that a long conversation is spread over tasks, and become runs there. Runs of a conversation, in the size of the audit that it
gets, meet for the program. The texts are then sorted within their conversations and stream through the hash, which is
sequential by its definition: no task holds more than a batch of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import materialise, tidied

BLANK = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What has been written so far: nothing, a system message alone, a user's message last, an assistant's message last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after writing user or assistant next; only one of both can be written.
NEXT = (USER, USER, ASSISTANT, USER)
#: Least cost of insertions that make a state a finished conversation.
FINISH = (0, 2 * INSERT, INSERT, 0)
INF = 1 << 60
#: Symbols: role initial (x for all others), in capitals if truncated; d for what must be deleted.
SYMBOLS = "uasxUASXd"
Matrix = tuple[tuple[int, ...], ...]
_LONG = (1 << 63) - 1


# ---- the program ---------------------------------------------------------------------------------------------------


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def _applied(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def _kept(symbol: str, state: int) -> int | None:
    """The state after keeping a message, if it may be kept here."""
    role = symbol.lower()
    if role == "s":
        return SYSTEM if state == EMPTY else None
    return NEXT[state] if role in "ua" and role == ("u" if NEXT[state] == USER else "a") else None


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Matrix:
    """Least costs from state to state over 2 ** k messages of one symbol, insertions before each of them included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    more = TRUNCATED if symbol.isupper() else 0
    step = [[INF] * 4 for _ in range(4)]
    for a in range(4):
        step[a][a] = DELETE
        if symbol != "d":
            step[a][NEXT[a]] = min(step[a][NEXT[a]], REROLE + more)
            if (b := _kept(symbol, a)) is not None:
                step[a][b] = min(step[a][b], KEEP + more)
    insert = tuple(tuple(0 if a == b else INSERT if NEXT[a] == b else INF for b in range(4)) for a in range(4))
    closed = _times(_times(insert, insert), insert)
    return _times(closed, tuple(map(tuple, step)))


def ahead(symbol: str, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost to the end from each state before n messages of a symbol, given that after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = _applied(power(symbol, k), after)
    return after


def _edits(symbol: str, n: int, state: int, after: tuple[int, ...], out: list[str]) -> int:
    """Appends the least letters of the cheapest edits of a run, and gives the state after it. Long runs are halved, so only a few cost vectors are held."""
    if symbol == "d":
        out.append("D" * n)
        return state
    if n > 32:
        half = n // 2
        state = _edits(symbol, half, state, ahead(symbol, n - half, after), out)
        return _edits(symbol, n - half, state, after, out)
    vectors = [after]
    for _ in range(n - 1):
        vectors.append(_applied(power(symbol, 0), vectors[-1]))
    more = TRUNCATED if symbol.isupper() else 0
    for later in reversed(vectors):
        here = _applied(power(symbol, 0), later)
        while True:
            left, nxt = here[state], NEXT[state]
            kept = _kept(symbol, state)
            if DELETE + later[state] == left:
                out.append("D")
            elif INSERT + here[nxt] == left:
                out.append("I")
                state = nxt
                continue
            elif kept is not None and KEEP + more + later[kept] == left:
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = nxt
            break
    return state


def repair(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """The least cost of making a conversation well-formed, and the least of the cheapest audits."""
    after = [FINISH]
    for symbol, n in reversed(runs):
        after.append(ahead(symbol, n, after[-1]))
    out: list[str] = []
    state = EMPTY
    for (symbol, n), later in zip(runs, reversed(after[:-1])):
        state = _edits(symbol, n, state, later, out)
    out.append("I" * (FINISH[state] // INSERT))
    return after[-1][EMPTY], "".join(out)


@lru_cache(maxsize=1 << 14)
def _repair_short(symbols: str, sizes: tuple[int, ...]) -> tuple[int, str]:
    return repair(list(zip(symbols, sizes)))


def repair_runs(symbols: str, sizes: list[int]) -> tuple[int, str]:
    return _repair_short(symbols, tuple(sizes)) if len(symbols) <= 64 and sum(sizes) <= 1024 else repair(list(zip(symbols, sizes)))


# ---- messages ------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copies: the messages after damage by crc32 of `conv:turn`, nulls there and in role and text read as one space. No copies: dropped."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say(conv), F.lit(":"), say(turn)).cast("binary")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.translate(say(text), ".!?", "")).otherwise(say(text))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(say(role)).alias("role"), body.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def as_messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The same of messages as they are, without damage."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), say(role).alias("role"), say(text).alias("text"), F.lit(1).cast("long").alias("copies"))


def _digest(role: str, text: str) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256))


_ORDER = ("turn", "role", "digest")


def _symbols(messages: DataFrame) -> DataFrame:
    """conv, turn, role, digest, initial, first, rest, times: without texts. `first` is the fault of the first of `times` equal messages of a turn, `rest` that of the others."""
    end = F.rtrim("text", F.lit(BLANK))
    initial = F.substring("role", 1, 1)
    light = messages.select(
        "conv", "turn", "role", _digest("role", "text").alias("digest"), "copies", F.when(initial.isin("u", "a", "s"), initial).otherwise("x").alias("initial"),
        F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "n").otherwise("t").alias("own"),
    )
    light = light.groupBy("conv", "turn", "role", "digest", "initial", "own").agg(F.sum("copies").alias("times"))
    # a message is a duplicate if its role and text stand at an earlier turn; nulls come first
    when = F.struct("turn")
    began = light.where("times > 0").groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(when).alias("_began"))
    joined = light.join(began, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    first = F.when(F.col("own") == "b", "b").when(when > F.col("_began"), "d").otherwise(F.col("own"))
    return joined.select("conv", *_ORDER, "initial", first.alias("first"), F.when(F.col("own") == "b", "b").otherwise("d").alias("rest"), "times")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


class _Part:
    """The runs of one conversation within one range of messages, and what is counted besides."""

    def __init__(self, conv):
        self.conv, self.symbols, self.sizes = conv, [], []
        self.n = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.low, self.high, self.turns = 0, None, None, 0
        self.initials = ["", ""]

    def run(self, initial: str, fault: str, n: int) -> None:
        if not n:
            return
        if fault in self.n:
            self.n[fault] += n
        symbol = "d" if fault in "bd" else initial.upper() if fault == "t" else initial
        if self.symbols and self.symbols[-1] == symbol:
            self.sizes[-1] += n
        else:
            self.symbols.append(symbol)
            self.sizes.append(n)
        last = self.initials[1]
        self.illegal += n - 1 + (bool(last) and last + initial not in LEGAL)
        self.initials = [self.initials[0] or initial, initial]

    def turn(self, turn) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn


LEGAL = ("su", "ua", "au")


def _runs(messages: DataFrame) -> DataFrame:
    """One row for each conversation and range of the sorted messages."""
    s = materialise(_symbols(messages))
    kind, turn_kind = s.schema["conv"].dataType.simpleString(), s.schema["turn"].dataType.simpleString()
    schema = f"conv {kind}, part int, place long, symbols string, sizes array<long>, blank long, duplicate long, truncated long, illegal long, head string, tail string, low {turn_kind}, high {turn_kind}, turns long"

    def work(batches):
        out, part, place = [], None, 0

        def rows():
            nonlocal out, place
            if part is not None:
                out.append((part.conv, task, place, "".join(part.symbols), part.sizes, part.n["b"], part.n["d"], part.n["t"], part.illegal, *part.initials, part.low, part.high, part.turns))
                place += 1

        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        started = False
        for conv, turn, _role, _digest, initial, first, rest, times in _rows(batches):
            if not started or part.conv != conv:
                rows()
                part, started = _Part(conv), True
            if times:
                part.turn(turn)
                part.run(initial, first, 1)
                part.run(initial, rest, times - 1)
            if len(out) >= 2000:
                yield _batch(out, target)
                out = []
        rows()
        if out:
            yield _batch(out, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    ranged = s.repartitionByRange("conv", *_ORDER).sortWithinPartitions("conv", *_ORDER)
    return ranged.select("conv", *_ORDER, "initial", "first", "rest", "times").mapInArrow(tidied(work), schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows with the same first field."""
    held: list[tuple] = []
    for r in rows:
        if held and held[0][0] != r[0]:
            yield held[0][0], held
            held = []
        held.append(r)
    if held:
        yield held[0][0], held


def _joined_parts(parts: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit of the parts of one conversation in order."""
    symbols, sizes, counts, illegal, tail = [], [], [0, 0, 0], 0, ""
    low = high = None
    turns = 0
    for _, _, _, sym, size, *more, part_illegal, head, last, part_low, part_high, part_turns in parts:
        for s, n in zip(sym, size):
            if symbols and symbols[-1] == s:
                sizes[-1] += n
            else:
                symbols.append(s)
                sizes.append(n)
        counts = [a + b for a, b in zip(counts, more)]
        illegal += part_illegal + (bool(tail and head) and tail + head not in LEGAL)
        tail = last or tail
        if part_turns:
            turns += part_turns - (part_low == high)
            low, high = part_low if low is None else low, part_high
    gaps = min(high - low + 1 - turns, _LONG) if turns else 0
    return (gaps, *counts, illegal, *repair_runs("".join(symbols), sizes))


def repair_messages(messages: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation of `damaged` or `as_messages` rows.

    Equal turns are ordered by role, then by a digest of role and text; null turns come first. Conversations that share a null
    id are one. A repeated row is a duplicate. A role without letters, or another one, can be kept nowhere. A conversation
    without messages has zeros, an empty audit and the hash of the empty text. An empty table gives no rows.
    """
    kind = messages.schema["conv"].dataType.simpleString()
    figures = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    solved_schema = to_arrow_schema(_parse_datatype_string(f"conv {kind}, {figures}"))
    final_schema = to_arrow_schema(_parse_datatype_string(f"conv {kind}, {figures}, repaired_sha256 string"))

    def solve(batches):
        out = []
        for conv, parts in _grouped(_rows(batches)):
            out.append((conv, *_joined_parts(parts)))
            if len(out) >= 2000:
                yield _batch(out, solved_schema)
                out = []
        if out:
            yield _batch(out, solved_schema)

    runs = _runs(messages).repartition("conv").sortWithinPartitions("conv", "part", "place")
    solved = materialise(runs.mapInArrow(tidied(solve), f"conv {kind}, {figures}"))

    def hashed(batches):
        out, now = [], None
        for conv, is_text, role, text, copies, *head in _rows(batches):
            if not is_text:
                if now is not None:
                    out.append((*now.figures, now.digest()))
                now = _Repaired((conv, *head))
            else:
                for _ in range(copies):
                    now.message(role, text)
            if len(out) >= 2000:
                yield _batch(out, final_schema)
                out = []
        if now is not None:
            out.append((*now.figures, now.digest()))
        if out:
            yield _batch(out, final_schema)

    names = [x.split()[0] for x in figures.split(", ")]
    texts = messages.where("copies > 0").select("conv", F.lit(True).alias("is_text"), "role", "text", "copies", "turn", _digest("role", "text").alias("digest"), *(F.lit(None).cast(solved.schema[c].dataType).alias(c) for c in names))
    heads = solved.select("conv", F.lit(False).alias("is_text"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast(messages.schema["turn"].dataType).alias("turn"), F.lit(None).cast("binary").alias("digest"), *names)
    both = texts.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "is_text", *_ORDER)
    return both.select("conv", "is_text", "role", "text", "copies", *names).mapInArrow(tidied(hashed), f"conv {kind}, {figures}, repaired_sha256 string")


class _Repaired:
    """Takes the messages of a conversation one by one and hashes what its audit makes of them."""

    def __init__(self, figures: tuple):
        self.figures, self.audit, self.at, self.state = figures, figures[-1], 0, EMPTY
        self.sha, self.any = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def _new(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._write("user" if self.state == USER else "assistant", text)

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._new("")
            self.at += 1

    def message(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._new(text)
        elif edit == "K":
            self.state = SYSTEM if role.startswith("s") else NEXT[self.state]
            self._write(role, text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """`repair_messages` of a table of messages, under the name of its id column; with `damage`, of its damaged rows. Other columns are ignored."""
    messages = (damaged if damage else as_messages)(rows, conv, turn, role, text)
    return repair_messages(messages).withColumnRenamed("conv", conv)


#: For DuckDB: the damage, the faults, and the least (cost, audit) of each state message by message.
REPAIR_SQL = r"""
WITH RECURSIVE
m0 AS (SELECT conv_id, turn, coalesce(CAST(role AS VARCHAR), ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
c0 AS (SELECT DISTINCT k, list_transform(range(0, octet_length(k)), lambda i: CAST(('0x' || substr(hex(k), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)) AS b FROM m0),
crc AS (SELECT k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: list_reduce(list_prepend(xor(a, x), CAST(range(0, 8) AS BIGINT[])), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind FROM c0),
m1 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, kind FROM m0 JOIN crc USING (k)),
m2 AS (SELECT conv_id, turn, role, text, sha256(length(role) || ':' || role || text) AS d, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m1),
m3 AS (SELECT *, row_number() OVER o AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(role[1]) OVER o AS before,
       CASE WHEN role[1] IN ('u', 'a', 's') THEN role[1] ELSE 'x' END AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM m2 WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d, copy)),
m AS (SELECT conv_id, turn, role, text, i, r, before, CASE WHEN t = '' THEN 'b' WHEN again THEN 'd' WHEN t[-1] IN ('.', '!', '?') THEN 'n' ELSE 't' END AS f FROM m3),
ids AS (SELECT DISTINCT conv_id FROM m0),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
          count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
nx AS (SELECT * FROM (VALUES ('e', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) t(st, w)),
ins AS (SELECT st, 0 AS k, '' AS ia, st AS st2, [] :: VARCHAR[] AS io FROM nx UNION ALL SELECT i.st, k + 1, ia || 'I', w, list_append(io, CASE w WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM ins i JOIN nx ON nx.st = i.st2 WHERE k < 3),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 'e' AS st, {'c': CAST(0 AS BIGINT), 'a': '', 'o': [] :: VARCHAR[]} AS best FROM ids
  UNION ALL
  SELECT dp.conv_id, m.i, e.st3, min({'c': dp.best.c + 5 * ins.k + e.c, 'a': dp.best.a || ins.ia || e.a, 'o': list_concat(dp.best.o, list_concat(ins.io, e.o))})
  FROM dp JOIN m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.i = dp.i + 1 JOIN ins ON ins.st = dp.st JOIN nx ON nx.st = ins.st2,
    (SELECT unnest(list_filter([
       {'c': 2, 'a': 'D', 'st3': ins.st2, 'o': [] :: VARCHAR[], 'ok': true},
       {'c': CASE m.f WHEN 't' THEN 5 ELSE 0 END, 'a': 'K', 'st3': m.r, 'o': [m.role || ':' || m.text], 'ok': m.f IN ('n', 't') AND (m.r = nx.w OR m.r = 's' AND ins.st2 = 'e')},
       {'c': CASE m.f WHEN 't' THEN 6 ELSE 1 END, 'a': 'R', 'st3': nx.w, 'o': [CASE nx.w WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text], 'ok': m.f IN ('n', 't')}], lambda z: z.ok), recursive := true)) e
  GROUP BY dp.conv_id, m.i, e.st3),
fin AS (SELECT dp.conv_id, min({'c': dp.best.c + 5 * ins.k, 'a': dp.best.a || ins.ia, 'o': list_concat(dp.best.o, ins.io)}) AS best FROM dp LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id JOIN ins ON ins.st = dp.st WHERE dp.i = coalesce(s.n, 0) AND ins.st2 IN ('e', 'a') GROUP BY dp.conv_id)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM fin f LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM f.conv_id
"""
