"""Operator 11 against a shortest-path search over whole conversations, and its edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

CONV = "conv_id long, turn long, role string, text string"
BLANK = r"[^\x20\x09-\x0D]"


def cheapest(messages):
    """(cost, audit, repaired) by search over (row, last written initial); messages are (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(messages) and last in ("", "a"):
            return cost, audit, out
        new = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, new[0], (*out, f"{new}:")))
        if i < len(messages):
            role, text, fault = messages[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, new[0], (*out, f"{new}:{text}")))
                if role[:1] == new[0] or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))


def by_hand(rows, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20 if damage else 9
        role, text = say(role), say(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, own in convs.items():
        key = lambda t, r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
        own.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), key(*m)))
        seen, messages, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated", "none"), 0)
        for _, role, text in own:
            solid = re.findall(BLANK, text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "none" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            messages.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, repaired = cheapest(messages)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def results(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_repair_conversations(spark, partitions):
    from cohortmill.llm.conversations import repair_conversations

    rng = random.Random(3)
    say = ["Yes.", "No!", "cut off", "", " \t ", "Why?\n", None, "é. ", "end. "]
    rows = []
    for conv in [None, *range(120)]:
        roles = rng.choice([("user", "assistant"), ("user", "assistant", "system"), ("user",), ("system", "User", "", "tool", None, "usher", "assistant")])
        for turn in range(rng.randint(1, 12)):
            t = rng.choice([turn, turn, turn, turn + 3, turn // 2, None])
            rows.append((conv, t, rng.choice(roles) if rng.random() < 0.3 else roles[turn % len(roles)], rng.choice(say) if rng.random() < 0.4 else f"{turn} done."))
    rows += [(500, 1, "user", "same.")] * 70 + [(500, 2, "assistant", "same.")] * 3 + [(501, None, "user", "x.")] * 2 + [(502, t, "user", f"{t}.") for t in range(150)] + [(503, 0, "user", "long. " * 40_000), (503, 1, "assistant", "a.")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "own") for r in rows], CONV + ", audit string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for damage in (True, False):
            assert results(repair_conversations(df, damage=damage)) == by_hand(rows, damage)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_conversation_over_many_ranges(spark):
    """Parts of one conversation that are cut anywhere join to the same result."""
    from cohortmill.llm import conversations as V

    rng = random.Random(4)
    for _ in range(200):
        messages = [(rng.choice("uas"), rng.choice("nnnntbd"), rng.choice([1, 1, 2, 9]), t) for t in range(rng.randint(0, 20))]
        rows = []
        for cut in (1000, 3, 1):
            parts, part = [], V._Part(0)
            for i, (initial, fault, n, turn) in enumerate(messages):
                part.turn(turn // 2)
                part.run(initial, fault, n)
                if (i + 1) % cut == 0:
                    parts.append(part)
                    part = V._Part(0)
            parts.append(part)
            rows.append(V._joined_parts([(0, 0, i, "".join(p.symbols), p.sizes, p.n["b"], p.n["d"], p.n["t"], p.illegal, *p.initials, p.low, p.high, p.turns) for i, p in enumerate(parts)]))
        assert rows[0] == rows[1] == rows[2]


def test_repair_of_runs():
    from cohortmill.llm import conversations as V

    assert V.ahead("u", 10**12, V.FINISH)[V.EMPTY] == 5 * 10**11
    for symbol in V.SYMBOLS:
        for n in (33, 70, 100):
            own = [({"d": "user"}.get(symbol, {"u": "user", "a": "assistant", "s": "system", "x": "x"}.get(symbol.lower())), "", "blank" if symbol == "d" else "truncated" if symbol.isupper() else "none")] * n
            assert V.repair([("u", 1), (symbol, n), ("a", 1)]) == cheapest([("user", "", "none"), *own, ("assistant", "", "none")])[:2]


def test_no_conversations(spark):
    from cohortmill.llm.conversations import repair_conversations

    assert repair_conversations(spark.createDataFrame([], CONV), damage=True).collect() == []
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = results(repair_conversations(spark.createDataFrame([(7, dropped, "user", "x.")], CONV), damage=True))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_op11_on_the_tables(spark):
    from cohortmill.llm.queries import op11_conversation_repair

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(op11_conversation_repair(spark, sf)) == by_hand(rows)
