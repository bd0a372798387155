"""The numbered operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"src{i % 3}", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "an", "er", "in", "é", "on"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


EDGE = {0: None, 1: "", 2: " \n\t ", 3: "word", 4: "Word", 5: prose(1, 30), 6: prose(1, 30), 7: prose(1, 30).upper(), 8: prose(2, 20_000), 9: "a" * 50_000}


# ---- 1 ------------------------------------------------------------------------------------------------------------


def pieces(t):
    return {p for p in re.split(r"\n+|(?<=[.!?]) +", t) if p}


def test_fingerprints(spark):
    from cohortmill.llm.fingerprints import version_fingerprints

    texts = EDGE | {10: "One. Two. Three.", 11: "One. Two. Three.", 12: "\n".join(f"line {i}" for i in range(900))}
    df = frame(spark, texts)
    out = version_fingerprints(df.union(df.where("doc_id = 5"))).collect()
    assert len(out) == len(texts) + 1
    got = {r["doc_id"]: r for r in out}
    ids = sorted(texts, reverse=True)
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for i, x in enumerate(ids):
        t, nxt = texts[x] or "", texts[ids[(i + 1) % len(ids)]] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        r = got[x]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(pieces(t), pieces(e))) and r["near_next"] == pytest.approx(like(pieces(t), pieces(nxt)))
    assert got[10]["fingerprint"] == got[11]["fingerprint"] != got[5]["fingerprint"]
    assert version_fingerprints(df.limit(0)).count() == 0
    one = version_fingerprints(spark.createDataFrame([(None, "abcdef", 1)], "doc_id long, text string, key int")).collect()[0]
    assert one["doc_id"] is None and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


# ---- 2 ------------------------------------------------------------------------------------------------------------


def components(texts, n, num):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "num", "tile", "frequent"), [(3, 90, 256, 2_000_000), (5, 80, 3, 0)])
def test_ngram_join(spark, n, num, tile, frequent):
    """With counts of shingles and without, when the order is by hash alone."""
    from cohortmill.llm.ngram_join import ngram_join

    rng = random.Random(n)
    texts, base = dict(EDGE), prose(9, 120).split()
    for i in range(20, 60):  # near copies of one text, at all distances
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = "other" + str(rng.randint(0, 9))
        texts[i] = " ".join(w)
    for i in range(60, 90):  # a passage that many share
        texts[i] = prose(i, rng.randint(0, 60)) + " the passage that stands in many of these texts " + prose(100 + i, 5)
    a, b = "a", "b"
    for _ in range(10):  # two words of 1024 letters that sums modulo a power of two can't tell apart
        a, b = a + b, b + a
    texts |= {95: f"{a} x y", 96: f"{b} x y", 97: f"{a} x Y"}
    long = prose(3, 1500).split()
    for i in range(90, 94):
        texts[i] = " ".join([*long[: 1500 - 40 * (i - 90)], *prose(i, 40 * (i - 90)).split()])
    df = frame(spark, texts)
    got = ngram_join(df.union(df.where("doc_id < 25")), n, num, 100, tile=tile, most_frequent=frequent).collect()
    assert len(got) == len(texts) + sum(i < 25 for i in texts)
    want = components(texts, n, num)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert want[96][1] == 96 and want[97][1] == 95
    if n == 5:
        assert ngram_join(df.limit(0)).count() == 0


def test_keep_one(spark):
    from cohortmill.llm.ngram_join import keep_one
    from pyspark.sql import functions as F

    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60).replace("é", "e")
    rows = [(5, a), (3, a + " end"), (3, a + " end"), (7, b), (7, b), (None, b), (None, c), (2, c.upper()), (1, None), (1, None), (9, ""), (7, prose(4, 40)), (None, prose(5, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(f"own {x}").alias(x) for x in ("row", "rid", "digest", "twice", "_n")))
    out = keep_one(df)
    assert out.columns == df.columns and all(r["rid"] == "own rid" for r in out.collect())
    want = [(3, a + " end"), (7, b), (2, c.upper()), (1, None), (1, None), (9, ""), (7, prose(4, 40)), (None, prose(5, 40))]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)


def test_keep_one_leaves_small_tables(spark):
    """Prefixes, bitmaps, sets and the tables of columns go as soon as nothing reads them; the result can still be read twice."""
    from pathlib import Path

    from cohortmill.llm.common import shared_dir
    from cohortmill.llm.ngram_join import keep_one

    folder = Path(shared_dir(spark).removeprefix("file://"), "tables")
    df = frame(spark, {i: prose(i % 12, 60) + (" end" if i >= 12 else "") for i in range(24)})
    df.count()
    had = set(folder.glob("*"))
    out = keep_one(df)
    left = [set(spark.read.parquet(f"file://{p}").columns) for p in set(folder.glob("*")) - had]
    assert left and not [c for c in left if c & {"prefix", "bitmap", "wide", "s", "first", "rest", "sizes", "c"}]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in out.collect()) == list(range(12))


def test_columns_are_shuffled_once(spark, monkeypatch):
    """No table of a join shuffles the entries of columns twice: not to count them, not to find mixed ones, and not for the two sides of a tile."""
    from cohortmill.llm import ngram_join as module

    plans = []
    monkeypatch.setattr(module, "materialise", lambda df, of=module.materialise: (plans.append(df._jdf.queryExecution().executedPlan().toString()), of(df))[1])
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    had = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        out = module.ngram_join(frame(spark, {i: prose(i % 12, 60) + (" end" if i >= 12 else "") for i in range(24)}), tile=4).collect()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: i % 12 for i in range(24)}
    by_column = [len(re.findall(r"- Exchange hashpartitioning\(s#", p)) for p in plans]
    assert by_column.count(1) >= 3 and max(by_column) == 1


def test_written_tables_leave_no_shuffle_files(spark):
    from cohortmill.llm.common import materialise

    blocks = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    own = lambda: set(re.findall(r"/(shuffle_\d+)_", blocks()))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, was = own(), spark.conf.get(key)
    out = materialise(spark.range(1000).repartition(3, "id").groupBy("id").count())
    assert not own() - had and spark.conf.get(key) == was
    assert out.count() == out.distinct().count() == 1000


def test_overlap_counts():
    from cohortmill.llm.common import joined, word_hashes, word_spans
    from cohortmill.llm.ngram_join import _IS_WORD, _overlaps

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    pairs = [(i, int(j)) for i in range(30) for j in rng.integers(0, 30, 5)]
    got = _overlaps([sets[i].tobytes() for i, _ in pairs], [sets[j].tobytes() for _, j in pairs])
    assert got.tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in pairs]
    words = ["a" * n for n in (*range(1, 40), 256, 257, 300)] + ["é", "日本", "a\x00", "ab" * 200]
    data, _ = joined([" ".join(words) + " " + " ".join(reversed(words))])
    h = word_hashes(data, *word_spans(data, _IS_WORD))
    assert len(set(h[: len(words)].tolist())) == len(words) and (h[: len(words)] == h[: len(words) - 1 : -1]).all()


def test_components_of_a_chain(spark):
    from cohortmill.llm.components import connected_components

    links = [(i, i + 1) for i in range(40)] + [(1000, 1001), (1000, 1000), (None, 3)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {1000: 1000, 1001: 1000}


# ---- 3 ------------------------------------------------------------------------------------------------------------


def test_threshold_topk(spark):
    from cohortmill.llm.topk import threshold_topk

    rng = np.random.default_rng(1)
    vectors = {i: [float(x) for x in rng.normal(size=8)] for i in range(400)}
    vectors |= {i: [0.5] * 8 for i in range(400, 460)} | {460: None, 461: [None] * 8, 462: [float("nan")] * 8, 463: [float("inf")] * 8, 500: [0.0] * 8, 600: [1e12] * 8, 601: [-1e12] * 8, 602: [1e13, 0.0] * 4, 603: [1e300, -1e300] * 4}
    df = spark.createDataFrame([(i, v, 7) for i, v in vectors.items()], "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in threshold_topk(df.union(df.where("vec_id IN (100, 600)")), lambda i: i % 100 == 0, 10, block_rows=64, query_rows=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (i for i in whole if i % 100 == 0):
        best = sorted(((-float(sum(a * b for a, b in zip(whole[q], v))), -sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() for _ in range(1 + (i in (100, 600))) if i != q))[:10]
        assert got[q] == [(i, clip(-x)) for _, x, i in best]
    assert set(got) == {i for i in whole if i % 100 == 0}
    assert threshold_topk(df.limit(0), lambda i: i % 100 == 0).count() == 0
    assert threshold_topk(df.where("vec_id = 0"), lambda i: i % 100 == 0).count() == 0


def test_threshold_stops_early():
    """On skewed vectors most rows are never scored, fewer still from a known k-th score on."""
    from cohortmill.llm.topk import SortedLists

    rng = np.random.default_rng(3)
    x = np.floor(rng.pareto(1.2, size=(4000, 12)) * 100) * (rng.random((4000, 12)) < 0.3)
    lists, scored = SortedLists(np.arange(4000), x), []
    for least in (False, True):
        lists.scored = 0
        for q in range(40):
            s = sorted(((-int(v @ x[q]), i) for i, v in enumerate(x) if i != q))[:10]
            got = lists.search(q, x[q], 10, -s[-1][0] if least else None)
            assert [(-v, i) for v, i, _ in got] == s
        scored.append(lists.scored / (40 * 4000))
    assert scored[1] <= scored[0] < 0.5


# ---- 4 ------------------------------------------------------------------------------------------------------------


def slow_chunks(text, hashed):
    """Lines, cut behind each line whose hash is above that of the line before and not below that of the next."""
    lines = re.findall("[^\n]*\n|[^\n]+$", text)
    h = [hashed(x) for x in lines]
    out, held = [], []
    for i, x in enumerate(lines):
        held.append(x)
        if i == len(lines) - 1 or i and h[i] > h[i - 1] and h[i] >= h[i + 1]:
            out.append(held)
            held = []
    return out


def test_line_dedup(spark):
    from cohortmill.llm.common import joined, mix64, span_hashes
    from cohortmill.llm.line_dedup import line_dedup
    from pyspark.sql import functions as F

    def hashed(line):
        data, _ = joined([line])
        return int(mix64(span_hashes(data, np.array([0]), np.array([len(data) - 1])))[0])

    part = "\n".join(prose(50 + i, 14) for i in range(9))
    short = "Yes.\nNo.\nOh\nso"
    texts = EDGE | {20: prose(4, 60) + "\n" + part + "\n" + prose(5, 60), 21: prose(6, 33) + "\n" + part, 22: part + "\n" + part, 23: "Ünï. Cödé.\r\nüber\n" * 4} | {30 + i: short for i in range(5)}
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in line_dedup(df).collect()}
    seen, removed = set(), 0
    for i in sorted(texts):
        found = slow_chunks(texts[i] or "", hashed)
        kept = []
        whole = ("whole", texts[i]) if len(found) > 1 else None
        copy = whole in seen
        if whole:
            seen.add(whole)
        for c in map(tuple, found):
            if copy:
                continue
            if len(c) >= 2:
                if c in seen:
                    removed += 1
                    continue
                seen.add(c)
            kept += c
        assert got[i]["text"] == (None if texts[i] is None else "".join(kept)), i
    assert removed >= 4 and got[21]["n_removed"] > 0 and got[0]["text"] is None and [got[i]["text"] for i in range(30, 35)] == [short, "", "", "", ""]
    assert line_dedup(df).columns == [*df.columns, "n_chunks", "n_removed"]
    assert line_dedup(df.limit(0)).count() == 0
    twice = line_dedup(df.where("doc_id = 20").union(df.where("doc_id = 20"))).collect()
    assert [r["text"] for r in twice] == [texts[20]] * 2
    more = ["n_chunks", "n_removed", "_key", "_drop", "row", "place", "h"]
    wide = df.select("*", *(F.lit(f"own {c}").alias(c) for c in more))
    out = {r["doc_id"]: r for r in line_dedup(wide).collect()}
    assert all(out[i]["text"] == got[i]["text"] and out[i]["n_removed"] == got[i]["n_removed"] and out[i]["h"] == "own h" and out[i]["_key"] == "own _key" for i in texts)


def test_line_dedup_compares_bytes(spark):
    """Chunks of one hash and different bytes: only real repeats go."""
    from cohortmill.llm import line_dedup as module

    a, b = "a", "b"
    for _ in range(10):  # two texts of 1024 letters whose polynomial hashes modulo a power of two agree
        a, b = a + b, b + a
    texts = {0: f"{a}\n{b}\n", 1: f"{b}\n{a}\n", 2: f"{a}\n{b}\n", 3: f"{a}\n{a}\n"}
    out = {r["doc_id"]: r["text"] for r in module.line_dedup(frame(spark, texts)).collect()}
    assert out == {0: texts[0], 1: texts[1], 2: "", 3: texts[3]}


def test_runs_only_where_they_are_wanted():
    """Runs are made of the texts of which one is wanted, and stand where they would among all texts; shared sums change no hash."""
    from cohortmill.llm.line_dedup import RUN, _runs_where, block_of, chunks, runs

    texts = ["", "\n" + prose(3, 200), "é\n\n" + prose(4, 120), prose(5, 90), "x"]
    raw, found, starts = _runs_where(texts, [None, [3, RUN + (1 << 20 | 2)], [0], [RUN], []], 50)
    assert [f is not None for f in found] == [False, True, False, True, False]
    alone = {i: runs([texts[i]], 50) for i in (1, 3)}
    for i, (own, (m,)) in alone.items():
        assert all((x == y).all() for x, y in zip(found[i][3:], m[3:])) and (found[i].start - starts[i] == m.start).all() and (found[i].upto - starts[i] == m.upto).all()
        assert [raw[a:z] for a, z in zip(found[i].start, found[i].end)] == [own[a:z] for a, z in zip(m.start, m.end)]
    assert _runs_where(texts, [None, [0], None, [1], []], 50)[1] == [None] * 5 and _runs_where(texts, [None, [RUN], None, None, None], None)[1] == [None] * 5
    block = block_of(texts)
    for x, y in ((chunks(texts, block), chunks(texts)), (runs(texts, 50, block), runs(texts, 50))):
        assert x[0] == y[0] and all((p == q).all() for u, v in zip(x[1], y[1]) for p, q in zip(u, v))


def test_runs_share_the_sums_of_a_block(monkeypatch):
    """Where most texts of a block want runs, its running sums are made once; whole texts are hashed together as each alone."""
    from cohortmill.llm import line_dedup as module

    sums, made = module.running_sums, []
    monkeypatch.setattr(module, "running_sums", lambda data: made.append(len(data)) or sums(data))
    some = [" é. " + prose(i, 120) + "\n" + prose(100 + i, 60) for i in range(10)]
    block = module.block_of(some)
    raw, found, starts = module._runs_where(some, [[module.RUN]] * 8 + [None, [0]], 50, block)
    assert len(made) == 1 and starts[:10] == block[1].tolist()[:10] and raw == block[0].tobytes() and [m is None for m in found] == [False] * 8 + [True] * 2
    for text, at, m in list(zip(some, starts, found))[:8]:
        own, (x,) = module.runs([text], 50)
        assert (m.hashes == x.hashes).all() and (m.start - at == x.start).all() and [raw[a:z] for a, z in zip(m.start, m.end)] == [own[a:z] for a, z in zip(x.start, x.end)]
    hashes = np.arange(1, 7, dtype=np.uint64)
    assert module._wholes(hashes, np.array([0, 0, 1, 2, 0, 1])).tolist() == [int(module._whole(x)) for x in (hashes[:1], hashes[1:4], hashes[4:])]


def test_line_dedup_recall(spark):
    """Passages of 51 words and more planted between other texts, without a look at chunks()."""
    from cohortmill.llm.line_dedup import line_dedup

    sentence = lambda r, n: " ".join("w" + str(r.randrange(10**6)) for _ in range(n)) + "."
    rng, texts, planted = random.Random(11), {}, {}
    for k in range(40):
        n = [1, 2, 3, 4, 6, 9][k % 6]
        passage = [sentence(rng, -(-51 // n) + k % 3) for _ in range(n)]
        for copy in range(2):
            own = [[sentence(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 5))] for _ in range(2)]
            gap, end = ("\n", " ") if copy else (" ", "\n")
            texts[100 * copy + k] = " ".join(own[0]) + "\n" + gap.join(passage) + (end + " ".join(own[1]) if k % 4 else "")
            planted[100 * copy + k] = (passage, own)
    texts[300] = " ".join(["The same sentence of six words."] * 40)
    got = {r["doc_id"]: r for r in line_dedup(frame(spark, texts), run_words=50).collect()}
    for i, (passage, own) in planted.items():
        assert [p in got[i]["text"] for p in passage] == [i < 100] * len(passage), (i, len(passage))
        assert all(s in got[i]["text"] for s in own[0] + (own[1] if i % 100 % 4 else []))
    assert got[300]["text"] == "The same sentence of six words. " * 9  # the first run stays as a whole
    copies = {1: "no", 2: "\n".join(texts[5].split("\n")), 3: texts[5], 4: "水" * 400 + "。\nend", 5: "beginning\n" + "水" * 400 + "。"}
    out = {r["doc_id"]: r for r in line_dedup(frame(spark, copies), run_words=50).collect()}
    assert out[3]["text"].strip() == "" and out[3]["n_removed"] == out[3]["n_chunks"] and out[5]["text"] == "beginning\n" and out[4]["n_removed"] == 0


# ---- 5 ------------------------------------------------------------------------------------------------------------


TWO = "<p>A long enough paragraph of prose that says several things, as articles do.</p><p>And a second one, also of some length, so there is a text.</p>"


def test_html_text(spark):
    from cohortmill.llm.html import blocks_of, extract_pages, fit_costs, label, main_text, min_cut

    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site">Logo</header><nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies, and this is a long text that says so in many words.</div>
      <main><h1>Head &amp; more</h1><p>One&nbsp;two   three<br>four<p>Short.<div class=ad>Buy</div><aside>Also</aside><ul><li>item</ul><form>Name <input></form><script>var x="<p>no</p>"</script>
      <section class="comments"><article><p>A reader says a lot of things here, long enough to look like content of its own.</p></article></section></main><footer>foot</footer>"""
    assert main_text(page) == "Head & more\nOne two three four\nShort.\nitem"
    rows = [(0, "u", page), (1, None, None), (2, "v", ""), (3, "w", "<nav>only</nav>"), (4, "x", "<article>" + "<p>x y z</p>" * 3000), (0, "u", page)]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in out] == [(0, "u", len(main_text(page))), (1, None, 0), (2, "v", 0), (3, "w", 0), (4, "x", 3000 * 6 - 1), (0, "u", len(main_text(page)))]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert label(blocks_of(""), fit_costs()) == []
    two = "\n".join(re.findall("<p>(.*?)</p>", TWO))
    for around in ('<body class="has-sidebar"><div>@</div>', '<div class="content with-sidebar">@</div>', '<article class="post social-news">@</article>', '<article><div class="story-related-science">@</div></article>', '<article>@</article><div class="discussion"><p>A reader says a lot of things here, long enough to look like content.</p></div>'):
        assert main_text(around.replace("@", TWO)) == two, around
    assert main_text(f'<article><p title="a > b" class=\'x\'>This is some text, and not markup.</p>{TWO}</article>') == "This is some text, and not markup.\n" + two
    for tag in ("button", "select", "iframe", "template", "svg", "title", "textarea", "noscript", "script", "style"):
        assert main_text(f"<body><article><div><{tag}>unseen</div>{TWO}</article><footer>f</footer>") == two, tag
        assert main_text(f"<body><article>{TWO}<{tag}>unseen</{tag}></article>") == two, tag
    inserted = {"cookie-notice": "We use cookies to improve your experience on our site.", "advert": "Buy our new and improved product today, at half the price."}
    for name, text in inserted.items():
        assert main_text(f'<body><article><h1>Head</h1>{TWO}<div class="{name}"><p>{text}</p></div>{TWO}</article>') == f"Head\n{two}\n{two}", name
    assert main_text(f"<article><button>Click<h1>Head of it</h1>{TWO}</article><button>x</button>") == f"Head of it\n{two}"
    assert main_text(f"<article><button><div>Click</div></button>{TWO}</article>") == two
    side = '<div class="sidebar"><h3>More</h3><ul><li><a href=x>Link to it</a></li><li><a href=x>Other one</a></li></ul></div>' * 6
    assert main_text(f"<body>{side}{TWO}{side}</body>") == two
    assert len(main_text("<article>" + "".join(f"<div>some words of block {i}" for i in range(5000))).split("\n")) == 5000
    for odd in ("<", "<>", "</", "<!--", "<!-- x", "<p '", '<p a="', "&#xFFFFFFFF;", "<a" * 1000, "<script", "<!" * 1000):
        main_text(f"<article>{TWO}{odd}")


def test_html_pages_held_out():
    """Blocks of pages that the classifier has not seen, and the pages of the test tables against a pattern that knows their one layout."""
    import html as html_lib

    import pyarrow.parquet as pq

    from cohortmill.llm.html import blocks_of, fit_costs, label, main_text
    from cohortmill.llm.page_sample import pages

    right = kept = wanted = 0
    for page in pages(300, seed=77):
        blocks = blocks_of(page)
        for b, k in zip(blocks, label(blocks, fit_costs())):
            right, kept, wanted = right + (k and b.label == 1), kept + k, wanted + (b.label == 1)
    assert right / kept > 0.97 and right / wanted > 0.98
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in table:
        inside = re.search("<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html_lib.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert main_text(page) == "\n".join(x for x in parts if x)


def test_minimum_cut():
    from cohortmill.llm.html import min_cut

    rng = random.Random(2)
    for _ in range(60):  # against all cuts
        n = rng.randint(1, 7)
        s, t = [rng.choice([0, rng.random() * 3]) for _ in range(n)], [rng.choice([0, rng.random() * 3]) for _ in range(n)]
        e = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda m: sum(s[i] for i in range(n) if not m >> i & 1) + sum(t[i] for i in range(n) if m >> i & 1) + sum(w for i, j, w in e if (m >> i ^ m >> j) & 1)
        side = min_cut(s, t, e)
        assert cost(sum(x << i for i, x in enumerate(side))) == pytest.approx(min(map(cost, range(1 << n))))


# ---- 6 ------------------------------------------------------------------------------------------------------------


def brute_spans(t):
    from cohortmill.llm.pii import luhn

    out = [(m.start(), m.end(), 0, "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1, "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2, "card"))
    out += [(m.start(), m.end(), 3, "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, b, k) for a, b, _, k in sorted(out, key=lambda x: (x[0], x[2]))]


def test_pii(spark):
    from cohortmill.llm.pii import base_spans, find_pii, marginals

    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("a1.2@+-( )b0%é9") for _ in range(rng.randint(0, 40)))
        assert base_spans(t) == brute_spans(t)
    # loopy passing is exact on a tree
    nodes, edges, pots = np.random.default_rng(0).normal(size=(3, 2)), np.array([[0, 1], [1, 2]]), np.random.default_rng(1).normal(size=(2, 2, 2))
    joint = np.exp(nodes[0][:, None, None] + nodes[1][None, :, None] + nodes[2][None, None, :] + pots[0][:, :, None] + pots[1][None, :, :])
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]) / joint.sum()
    assert np.allclose(marginals(nodes, edges, pots, 60), want, atol=1e-6)
    card = "4539578763621486"
    texts = EDGE | {20: f"mail me.x@mail.example.com and 10.0.0.1 and {card} or +1 (974) 555-3436 now", 21: 'token = "' + "ab12" * 10 + '" and again ' + "ab12" * 10, 22: "version 2.0 of 1999, page 7"}
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in find_pii(df).collect()}
    for i, t in texts.items():
        b = brute_spans(t or "")
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[2] == k for x in b) for k in ("email", "ip", "card", "phone")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in b).encode()).hexdigest()
        assert {f"{k}:{a}:{z}" for a, z, k in b} <= set(got[i]["spans"].split(","))
    assert got[22]["spans"] == "" and got[20]["n_card"] == 1 and got[0]["spans"] == ""
    assert find_pii(df.limit(0)).count() == 0


def test_pii_field():
    """Repeats share a label: what is clear at one place is found at the others, and not without the skip links; long texts without blanks take no long time."""
    import time

    from cohortmill.llm.pii import base_spans, field_spans, tokens_of, train

    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    number = lambda: str(rng.randrange(1, 10**6))
    learn = [" ".join(rng.choice([f'token = "{key()}"', number(), f"ab.{number()}@mail.example.com", f"10.2.{rng.randrange(256)}.7", "+1 (974) 555-3436", "4539578763621486", prose(i, 6)]) for _ in range(12)) for i in range(120)]
    field = train(learn)
    a, b = key(), key()
    text = f'{prose(1, 30)} token = "{a}" {prose(2, 30)} {a} {prose(3, 30)} {b} {prose(4, 10)}.'
    at = lambda x, t=text: [(m.start(), m.end(), "secret") for m in re.finditer(x, t)]
    assert field_spans(text, base_spans(text), field, 24) == at(a)
    assert field_spans(text, base_spans(text), field._replace(skip=0.0), 24) == at(a)[:1]
    assert field_spans(f"see {a} and {a}", [], field, 24) == []
    for unit in ("水", "a", "a.", "9", "+", "@", "a@", "1.", "(", "1 "):
        began = time.time()
        t = "5 " + unit * (1_000_000 // len(unit)) + " 7"
        spans = base_spans(t)
        if len(tokens_of(t)) < 1000:
            field_spans(t, spans, field, 24)
        assert time.time() - began < 5, unit


# ---- 7 ------------------------------------------------------------------------------------------------------------


def slow_kneser_ney(texts, order):
    """Probabilities by the definition, from plain dictionaries."""
    from cohortmill.llm.kneser_ney import PAD

    levels = []
    counts = Counter()
    for t in texts:
        s = chr(PAD) * (order - 1) + t
        counts.update(s[i : i + order] for i in range(len(t)))
    for n in range(order, 0, -1):
        k = Counter(counts.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else None
        d = [0, *(0.5 if y is None or not k[i] else max(0.05, min(i - 0.05, i - (i + 1) * y * k[i + 1] / max(k[i], 1))) for i in (1, 2, 3))]
        by = defaultdict(dict)
        for g, c in counts.items():
            by[g[:-1]][g[-1]] = c
        levels.append((d, by))
        nxt = Counter()
        for g in counts:
            nxt[g[1:]] += 1
        kinds = len(counts)
        counts = nxt

    def p(g):
        if not g:
            return 1 / (kinds + 1)
        d, by = levels[order - len(g)]
        seen = by.get(g[:-1])
        if not seen:
            return p(g[1:])
        total = sum(seen.values())
        c = seen.get(g[-1], 0)
        return (c - d[min(c, 3)] if c else 0.0) / total + sum(d[min(x, 3)] for x in seen.values()) / total * p(g[1:])

    return p


def half_of(spark, texts):
    from pyspark.sql import functions as F

    return {r[0]: r[1] for r in spark.createDataFrame([(i, t) for i, t in texts.items()], "i long, t string").select("i", F.pmod(F.xxhash64("t", F.lit(5)), F.lit(2))).collect()}


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney(spark, order):
    """Perplexities by the definition; folds, repeats, nulls and columns of the names used inside."""
    from cohortmill.llm.kneser_ney import PAD, filter_quality, score_quality, trusted_ids

    texts = {i: prose(i, 60) for i in range(40)} | {40: "ж水\x00é🙂 " * 9, 200: None, 201: "", 202: "there", 203: prose(203, 70), 204: "水火" * 40}
    rows = [(i, t, "en", i, 1.5, "m") for i, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, h long, good double, model string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(41)] + [(3, 1, 0), (39, 1, 1), (100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ids = trusted_ids(labels)
    assert ids.where("doc_id = 39").count() == 0
    out = score_quality(df, ids, order).collect()
    got, half = {r["doc_id"]: r for r in out}, half_of(spark, {i: t or "" for i, t in texts.items()})
    assert len(out) == len(rows) + 1 and [got[i]["perplexity"] for i in (200, 201)] == [None, None] and got[200]["keep"] and got[201]["keep"]
    learnt = [i for i in [*range(39), 40]]
    p = [slow_kneser_ney([texts[i] for i in learnt if half[i] == k] + [texts[3]] * (half[3] == k), order) for k in (0, 1)]
    for i in (0, 1, 2, 3, 40, 202, 203, 204):
        s = chr(PAD) * (order - 1) + texts[i]
        h = -sum(np.log(p[1 - half[i]](s[k : k + order])) for k in range(len(texts[i]))) / len(texts[i])
        assert np.log(got[i]["perplexity"]) == pytest.approx(h, abs=1e-4), i
    for g in ("xxxx"[: order - 1], ("th" * order)[: order - 1]):
        seen = {c for t in (texts[i] for i in learnt if half[i] == 0) for c in t}
        assert sum(p[0](g + c) for c in [*seen, "\x7f"]) == pytest.approx(1.0)
    kept = filter_quality(df, ids, order)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out if r["keep"])
    assert all(r["keep"] and r["perplexity"] is None for r in score_quality(df.where("doc_id < 5"), ids.limit(0), order).collect())
    assert score_quality(df.limit(0), ids, order).count() == 0


def test_kneser_ney_limits(spark):
    """Junk and repetitive texts lie beyond the quantiles of their language, found again from the scores; each of 18 languages has a model of its own script."""
    from cohortmill.llm.kneser_ney import score_quality

    clean = {i: prose(i, 150) for i in range(900)}
    bad = {1000: "The. " * 150, 1001: prose(1, 8) * 20, 1002: prose(3, 150).upper(), 1003: " ".join(prose(2000 + i, 3) for i in range(5)) * 10}
    df = frame(spark, clean | bad)
    out = {r["doc_id"]: r for r in score_quality(df, df.where("doc_id < 800").select("doc_id"), 4).collect()}
    assert not any(out[i]["keep"] for i in bad) and sum(out[i]["keep"] for i in clean) >= 870
    size = lambda i: len(clean[i]).bit_length() - 1
    for s in {size(i) for i in range(800)}:
        # the same rule for a group of a few texts and one of hundreds
        h = sorted(round(np.log(out[i]["perplexity"]), 3) for i in range(800) if size(i) == s)
        spread = np.std([round(np.log(out[i]["perplexity"]), 3) for i in range(800)])
        limit = h[-(-995 * len(h) // 1000) - 1] + 3 * max(spread, 0.01) / np.sqrt(len(h))
        assert all(np.log(out[i]["threshold"]) == pytest.approx(limit, abs=3e-3) for i in clean if size(i) == s)
    plain = {r["doc_id"]: r["keep"] for r in score_quality(df, df.where("doc_id < 800").select("doc_id"), 4, repetition=False).collect()}
    assert all(plain[i] == (np.log(out[i]["perplexity"]) <= np.log(out[i]["threshold"]) + 5e-4) for i in [*clean, *bad] if abs(np.log(out[i]["perplexity"] / out[i]["threshold"])) > 2e-3)
    rows = []
    for k in range(18):
        rng = random.Random(k)
        words = ["".join(chr(0x430 + rng.randrange(32)) for _ in range(5)) for _ in range(12)]
        line = lambda s: " ".join(words[(s + i) % 12] for i in range(60))
        rows += [(100 * k + i, line(i), f"l{k:02}", "s", 1) for i in range(12)] + [(100 * k + 50, " ".join(rng.choice(words)[::-1] for _ in range(60)), f"l{k:02}", "s", 1)]
    rows += [(9000, None, None, "s", 1), (9001, "", "l00", "s", 1), (9002, rows[0][1], "none", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in score_quality(df, df.where("doc_id % 100 < 12 AND doc_id < 9000").select("doc_id")).collect()}
    assert len({r["model"] for r in out.values()}) == 19 and out[9002]["model"] == "*" and out[9000]["keep"] and out[9001]["perplexity"] is None
    assert all(out[100 * k + 50]["perplexity"] > 3 * max(out[100 * k + i]["perplexity"] for i in range(12)) for k in range(18))


def test_kneser_ney_scores_a_half_at_a_time(spark, monkeypatch):
    """Each pass holds the texts of one half and the models of the other alone; both together hold each text once, also one half without any trusted text."""
    from cohortmill.llm import kneser_ney as module

    seen = []
    models = lambda df: {r["model"][-2:] for r in df.select("model").distinct().collect()}
    monkeypatch.setattr(module, "score_texts", lambda rows, table, *more, of=module.score_texts: (seen.append((models(rows), models(table))), of(rows, table, *more))[1])
    df = frame(spark, {i: prose(i, 40) for i in range(20)} | {20: None, 21: ""})
    for trusted in (range(20), [3]):
        seen.clear()
        out = module.score_quality(df, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()
        assert sorted(r["doc_id"] for r in out) == list(range(22))
        assert len(seen) == 2 and [r for r, _ in seen] == [{":1"}, {":0"}] and all(t <= r for r, t in seen)


def test_grams_of_a_chunk():
    from cohortmill.llm.kneser_ney import PAD, _packed, _unpacked, distinct_share, grams_of

    texts = ["abcab", "", "水火ab" * 3, "x"]
    g = grams_of(texts, 3)
    s = [chr(PAD) * 2 + t for t in texts]
    want = [x[i : i + 3] for x in s for i in range(len(x) - 2)]
    assert ["".join(map(chr, g.codes[3][i])) for i in g.top] == want and g.bounds.tolist() == [0, 5, 5, 17, 18]
    for n in (1, 2, 3):
        for i in set(g.top.tolist()) if n == 3 else ():
            assert (g.codes[2][g.suffix[3][i]] == g.codes[3][i][1:]).all() and (g.codes[2][g.context[3][i]] == g.codes[3][i][:-1]).all()
    back = _unpacked(_packed(g.codes), [len(c) for c in g.codes])
    assert all((a == b).all() for a, b in zip(back, g.codes))
    assert distinct_share(["a b", "a b c a b c", "水水水水水", ""]).tolist() == [1.0, 0.75, pytest.approx(1 / 3), 1.0]


def test_kneser_ney_answers():
    """A shard answers each n-gram with one number, its log probability or the weight of its context, and chunks make the same sums of them."""
    import pyarrow as pa

    from cohortmill.llm.kneser_ney import _answers, _log_probabilities, _packed, _widened, grams_of, shard_of

    g = grams_of(["abab", "ac"], 2)
    rows = [("m", 0, "", -3.0, None), ("m", 1, "a", -1.0, None), ("m", 1, "a", None, -0.5), ("m", 1, "b", -2.0, None), ("m", 2, "ab", -0.25, None)]
    table = pa.table([pa.array(x) for x in zip(*rows)], names=["model", "n", "g", "lp", "lb"]).cast(pa.schema([("model", pa.string()), ("n", pa.int32()), ("g", pa.string()), ("lp", pa.float32()), ("lb", pa.float32())]))
    assert (np.concatenate([shard_of(c, 1) for c in g.codes]) == 0).all()
    asked = pa.table([pa.array([7]), pa.array(["m"]), pa.array([[len(c) for c in g.codes]], pa.list_(pa.int32())), pa.array([_packed(g.codes)], pa.binary())], names=["chunk", "model", "numbers", "grams"])
    raw = _answers((pa.scalar(0),), table, asked).column("answers")[0].as_py()
    assert len(_widened(raw)) == sum(len(c) for c in g.codes)
    lp = dict(zip(("".join(map(chr, c)) for c in g.codes[2]), _log_probabilities(g, {0: raw}, 1).tolist()))
    pad = chr(0x10FFFF)
    assert {k: round(v, 4) for k, v in lp.items() if k[-1] != pad} == {pad + "a": -1.0, "ab": -0.25, "ba": -1.0, "ac": -3.5}


def test_kneser_ney_answers_are_small():
    """Log probabilities and weights come back as they went to 16 bits, in fewer bytes than as three planes of all of them."""
    import pyarrow as pa

    from cohortmill.llm.kneser_ney import _narrowed, _widened

    rng = np.random.default_rng(3)
    a = -rng.gamma(1.5, 2.0, 50_000).astype(np.float32)
    at = np.flatnonzero(rng.random(50_000) < 0.2)
    a[at] = np.repeat(rng.random(len(at) // 3 + 1), 3)[: len(at)]
    for x in (a, a[at], a[:1], a[:0], np.array([0.0, -0.0, np.nan, -np.inf], np.float32)):
        back = _widened(_narrowed(x))
        assert back.shape == x.shape and (np.signbit(back) == np.signbit(x)).all() and np.allclose(back, x, rtol=2**-16, atol=0, equal_nan=True)
    planes = (a.view(np.uint32) + np.uint32(0x80)).view(np.uint8).reshape(-1, 4)[:, 1:].T.tobytes()
    assert len(_narrowed(a)) < 0.95 * len(pa.compress(planes, codec="zstd", asbytes=True))


# ---- 8 ------------------------------------------------------------------------------------------------------------


def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    from cohortmill.llm.bpe import Codec, bpe_decode, bpe_digests, bpe_encode, load_ranks, merge_by_rank

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = load_ranks(path)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = Codec(path, P.PATTERN)
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice("abc 'sXé \t\n\n  12٣中文字🙂.,!?-_\x1c\x85ßllre") for _ in range(rng.randint(0, 30)))
        ids = c.encode(t)
        assert ids == ref.encode_ordinary(t) and c.decode(ids, 3) == t
    other = r"\S+\s*|\s+"  # its matches reach over the blanks behind a word
    plain, whole = Codec(path, other, words=False), tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    assert all(plain.encode(t) == whole.encode_ordinary(t) for t in ("a b c\nd  e", "one two\n three", ""))
    c.forget()
    assert c.encode("word one") == ref.encode_ordinary("word one")
    inv = list(c.fst.bytes_of)
    for _ in range(3000):
        a, b = rng.choice(inv), rng.choice(inv)
        x, y = c.fst.bytes_of[a], c.fst.bytes_of[b]
        assert c.fst.seam_holds(a, b) == (merge_by_rank(x + y, ranks) == [x, y])
    texts = EDGE | {20: "x <|endoftext|> y", 21: "é" * 3000, 22: "🙂" * 2000 + "ab" * 5000}
    df = frame(spark, texts)
    for r in bpe_digests(df, path, P.PATTERN).collect():
        t = texts[r["doc_id"]] or ""
        ids = ref.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe_decode(bpe_encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in texts.items()}
    assert bpe_digests(df.limit(0), path, P.PATTERN).count() == 0


def test_bpe_keeps_frequent_words():
    """Words that are met again are encoded once, however many rare ones pass, and the cache stays small."""
    import public_tokenizers as P
    import tiktoken

    from cohortmill.llm.bpe import Codec, load_ranks

    path = P.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    c, sent, rng = Codec(path, P.PATTERN, cache=200), [], random.Random(9)
    real = c.fst.encode_all
    c.fst.encode_all = lambda pieces: (sent.extend(pieces), real(pieces))[1]
    for _ in range(30):
        t = "some frequentishly met wordlike " + " ".join("".join(rng.choice("abcdefé") for _ in range(9)) for _ in range(60))
        assert c.encode_all([t, ""]) == [ref.encode_ordinary(t), []]
        assert len(c.known) <= 300 and len(c.old) <= 300
    assert sent.count(b" frequentishly") == 1 and sent.count(b" wordlike") == 1


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    from cohortmill.llm.license_texts import TEMPLATES
    from cohortmill.llm.licenses import BASE_PHRASES, WORD, Automaton, license_scan

    texts = EDGE | {
        20: "Released under the MIT License. under-the mit LICENSE", 21: "Licensed under the Apache License, Version 2.0.", 22: "CC BY-NC CC BY-NC 4.0", 23: "This work is licensed under the terms of the GNU General Public License, version 3.",
        24: "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files, to deal in the Software without restriction", 25: "under the mit licenseé", 26: "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software",
    }
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in license_scan(df).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        at = [(j, lab) for p, lab in BASE_PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        places = [j for j, _ in at]
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= got[i]["score"] <= 1
    assert [got[i]["labels"] for i in (20, 21, 22, 23, 24, 25, 26)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "mit", "", ""]
    assert got[26]["score"] == pytest.approx(15 / 26) and got[24]["score"] == 1
    nested = Automaton("y", "a <<opt>>b <<opt>>c <<any 1>><<end>> d<<end>> e")
    for t, end in (("a e", 2), ("a b d e", 4), ("a b c d e", 5), ("a b c x d e", 6), ("a b c x y d e", -1), ("a c e", -1), ("a b e", -1)):
        assert nested.match(t.encode().split(), 0)[0] == end
    assert nested.n_mandatory == 2 and nested.match(b"a x".split(), 0)[1] == 1
    a = Automaton("x", "one <<opt>>or two<<end>> <<any 2>> end")
    assert len({label for label, _ in TEMPLATES}) >= 20
    for label, t in TEMPLATES:  # without markup a template is its own longest text, without optional regions its shortest
        automaton = Automaton(label, t)
        most = WORD.findall(re.sub("<<.*?>>", " ", t).lower().encode())
        least = t
        while "<<opt>>" in least:
            least = re.sub("<<opt>>(?:(?!<<opt>>).)*?<<end>>", " ", least, flags=re.S)
        least = WORD.findall(re.sub("<<.*?>>", " ", least).lower().encode())
        assert automaton.n_mandatory == len(least)
        for words in (most, least):
            assert automaton.match(words, 0) == (len(words), automaton.n_mandatory), label
            for k in range(0, len(words), 7):
                wrong = [*words[:k], b"qqq", *words[k + 1 :]]
                if words is least:
                    assert automaton.match(wrong, 0)[1] < automaton.n_mandatory or "<<any" in t
        cut = least[: len(least) // 2]
        assert 0 < automaton.match(cut, 0)[1] / automaton.n_mandatory < 1
    assert [a.match(s.encode().split(), 0)[0] for s in ("one end", "one or two end", "one or end", "one a b end", "one a b c end", "one or two a b end", "one")] == [2, 4, 3, 4, -1, 6, -1]
    assert license_scan(df.limit(0)).count() == 0


# ---- 10 -----------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    import duckdb

    from cohortmill.llm.mixing import MIX_SQL, NO_TARGETS, mix_sources
    from cohortmill.llm.queries import DOMAIN_SQL, source_domain
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, prose(i, rng.choice([0, 1, 5, 40])) or None, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "web7", "x", None]), 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("t", df.toPandas())
    tokens = {r[0]: len((r[1] or "").split()) for r in rows}
    # far from the sizes: small nodes first, so that what they lack goes to siblings and then past them to other domains
    goals = [("domain3", None, None, 1, 0.6), ("other", None, None, 1, 0.3), ("domain1", None, None, 1, 0.0), ("domain0", "de", None, 2, 0.9), ("domain0", None, None, 2, 0.1), ("domain0", "de", "src0", 3, 0.5), ("nowhere", None, None, 1, 0.1)]
    con.register("goals", spark.createDataFrame(goals, "domain string, lang string, source string, depth int, weight double").toPandas())
    for fraction, epochs, given in ((0.5, 1, False), (1.5, 3, False), (5.0, 2, False), (0.5, 1, True), (0.9, 2, True)):
        targets = spark.createDataFrame(goals, "domain string, lang string, source string, depth int, weight double") if given else None
        out = mix_sources(df, fraction=fraction, max_epochs=epochs, domain=source_domain(F.col("source")), targets=targets)
        assert out.columns == [*df.columns, "mix_epoch"]
        got = sorted((r["doc_id"], r["mix_epoch"]) for r in out.collect())
        sql = MIX_SQL.format(docs="t", fraction=fraction, alpha=0.5, epochs=epochs, seed=7, domain=DOMAIN_SQL, targets="goals" if given else NO_TARGETS) + "SELECT doc_id, CAST(unnest(range(n)) AS BIGINT) AS e FROM n ORDER BY ALL"
        assert got == con.execute(sql).fetchall()
        total = sum(tokens.values())
        used = sum(tokens[i] for i, _ in got)
        if not given:
            assert min(fraction, epochs) * total - 40 * 20 <= used <= min(fraction, epochs) * total
        else:
            domain = lambda r: "other" if not re.search("[0-9]$", r[3] or "") else "domain" + str(int(r[3][-1]) % 4)
            held = Counter()
            for r in rows:
                held[domain(r)] += tokens[r[0]]
            by = Counter()
            for i, _ in got:
                by[domain(rows[i])] += tokens[i]
            assert by["domain1"] == 0 and by["domain3"] <= held["domain3"] * epochs and by["domain0"] > 0.1 * fraction * total
    assert mix_sources(df.limit(0)).count() == 0
    assert mix_sources(df.where("text IS NULL")).count() == 0
    more = ["whole", "rest", "stop", "_n", "mix_epoch", "l_domain", "row", "_id", "_source", "tokens", "share"]
    wide = df.select("*", *(F.lit(f"own {c}").alias(c) for c in more))
    out = mix_sources(wide, 0.5, max_epochs=1)
    assert out.columns == [*(c for c in wide.columns if c != "mix_epoch"), "mix_epoch"]
    assert all(r[c] == f"own {c}" for r in out.collect() for c in more if c != "mix_epoch")


# ---- the pipeline -------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    part = "\n".join(prose(50 + i, 14) for i in range(9))
    clean = {i: "\n".join(prose(1000 + 100 * i + k, 14) for k in range(14)) for i in range(60)}
    texts = clean | {60: " ".join(w.upper() + "!!" for w in prose(400, 200).split()), 61: clean[5], 62: clean[7] + " end", 63: prose(90, 80) + "\n" + part, 64: prose(91, 80) + "\n" + part, 65: None}
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, sizes = docs, {}
    for name, stage in P.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        sizes[name] = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name != "encode":
            assert kept.columns == docs.columns
    assert sizes["quality"] == set(texts) - {60}
    assert not {61} & sizes["lines"] and set(clean) <= sizes["lines"]
    assert set(clean) <= sizes["near_duplicates"] and 61 not in sizes["near_duplicates"]
    assert sizes["mix"] <= sizes["near_duplicates"] and sizes["encode"] == sizes["mix"]
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == sizes["encode"]
