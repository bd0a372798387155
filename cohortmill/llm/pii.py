"""Operator 6: personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels the tokens that hold a digit or an at sign: chain potentials tie
neighbours, skip potentials tie each token to the next one that is equal or similar, and loopy message passing lets a
clear mention decide unclear ones in the same document. Other tokens can only be "none", so the field falls apart into
the pieces between them and inference over those is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import text_blocks, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_STOP = re.compile(r"[\s\"'<>()|,;]")
_STOPS = frozenset("\"'<>()|,;")
_ACTIVE = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind, in code points."""
    out: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]]))


_SECRET_WORD = re.compile(r"(?:token|secret|password|passwd|api[_-]?key|key|bearer)\W{0,5}\Z", re.I)
_FEATURES = 14


def features(text: str, start: int, end: int) -> list[float]:
    """What a token looks like and what stands before it."""
    tok = text[start:end]
    digits = sum("0" <= c <= "9" for c in tok)
    n = len(tok)
    before = text[max(0, start - 12) : start]
    hexish = n >= 16 and not tok.isdigit() and all(c in "0123456789abcdefABCDEF" for c in tok)
    return [
        1.0, float("@" in tok), float("@" in tok and "." in tok[tok.find("@") :]), float(tok.count(".") == 3 and digits >= 4), float(12 <= digits <= 19), float(digits > 19 and not hexish),
        float(7 <= digits < 12), float(0 < digits < 7), float(tok.isdigit()), float(tok[:1] == "+"), float(12 <= digits <= 19 and luhn("".join(c for c in tok if "0" <= c <= "9"))),
        float(before.endswith(("+", "(")) or bool(re.search(r"\+[0-9() .-]*\Z", before))), float(hexish), float(bool(_SECRET_WORD.search(before))),
    ]


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Runs with a digit or an at sign between blanks, quotes, brackets and the like, found from the digits on: each character is looked at once."""
    out, done = [], 0
    while m := _ACTIVE.search(text, done):
        a = m.start()
        while a > done and text[a - 1] not in _STOPS and not text[a - 1].isspace():
            a -= 1
        stop = _STOP.search(text, m.end())
        b = done = stop.start() if stop else len(text)
        while text[b - 1] in ".!?:*#$%&":
            b -= 1
        out.append((a, b))
    return out


def links(text: str, toks: list[tuple[int, int]], gap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of neighbours at most `gap` characters apart, and pairs of each token with the last one before that is equal, has the same seven digits or more, or the same name before the at sign."""
    chain, skip = [], []
    seen: dict[str, int] = {}
    for i, (a, b) in enumerate(toks):
        if i and a - toks[i - 1][1] <= gap:
            chain.append((i - 1, i))
        word = text[a:b].lower()
        digits = re.sub("[^0-9]", "", word)
        keys = {"=" + word} | ({"#" + digits} if len(digits) >= 7 else set()) | ({"@" + word.partition("@")[0]} if len(word) >= 6 and "@" in word else set())
        skip += [(j, i) for j in sorted({seen[k] for k in keys if k in seen})]
        seen.update(dict.fromkeys(keys, i))
    return chain, skip


def weak_labels(text: str, toks: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[int]:
    """For training: 0 for none, else 1 + the kind of a base span over the token; long hexadecimal tokens after a telling word count as secrets."""
    out = []
    for a, b in toks:
        kind = next((k for s, e, k in base if s < b and a < e), None)
        if kind is None and (f := features(text, a, b))[12] and f[13]:
            kind = "secret"
        out.append(0 if kind is None else 1 + _ORDER[kind])
    return out


class Field(NamedTuple):
    """Weights of the features (features, kinds), potentials of neighbours (kinds, kinds), and what it is worth that linked tokens agree."""

    weights: np.ndarray
    chain: np.ndarray
    skip: float


#: The features that tell a kind by themselves.
_TELLING = [1, 2, 3, 9, 10, 11, 13]


def train(texts: list[str], rounds: int = 1500, gap: int = 24, lone: float = 0.3) -> Field:
    """All weights at once, by regularised pseudo-likelihood: each token's label given its features and its neighbours' labels.

    Weak labels rest on features that tell a kind by themselves, so nothing else would be learnt from the texts as they are.
    Each text stands there twice more without those features: linked to its own clear mentions, with their labels, and on its
    own, where what is not clear is none; these count `lone` times, as a mention without a clear one beside it says little.
    """
    k = len(KINDS) + 1
    x, y, prev, nxt, skip, much = ([np.zeros((0, n))] for n in (_FEATURES, k, k, k, k, 1))
    for t in texts:
        toks = tokens_of(t)
        if not toks:
            continue
        f, labels = np.array([features(t, a, b) for a, b in toks]), np.eye(k)[weak_labels(t, toks, base_spans(t))]
        chain, far = links(t, toks, gap)
        before, after, same = np.zeros((3, len(toks), k))
        for i, j in chain:
            before[j] += labels[i]
            after[i] += labels[j]
        for i, j in far:
            same[j] += labels[i]
            same[i] += labels[j]
        unclear = f.copy()
        unclear[:, _TELLING] = 0
        alone = np.tile(np.eye(k)[0], (len(toks), 1))
        for parts, new in ((x, (f, unclear, unclear)), (y, (labels, labels, alone)), (prev, (before, before, 0 * before)), (nxt, (after, after, 0 * after)), (skip, (same, same + labels, 0 * same)), (much, [np.full((len(toks), 1), m) for m in (1.0, 1.0, lone)])):
            parts += new
    x, y, prev, nxt, skip, much = map(np.concatenate, (x, y, prev, nxt, skip, much))
    w, c, s = np.zeros((_FEATURES, k)), np.zeros((k, k)), 0.0
    w[0, 0] = 2.0
    moves = [np.zeros_like(w), np.zeros_like(c), 0.0]
    for _ in range(rounds if len(x) else 0):
        z = x @ w + prev @ c + nxt @ c.T + s * skip
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = much * (y - p) / len(x)
        steps = x.T @ d - 1e-5 * w, prev.T @ d + d.T @ nxt - 1e-2 * c, float((d * skip).sum() - 1e-4 * s)
        moves = [0.9 * m + g for m, g in zip(moves, steps)]
        w, c, s = w + moves[0], c + moves[1], s + moves[2]
    return Field(w, c, s)


def marginals(nodes: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Loopy sum-product: node log-potentials (n, k), edges (m, 2), log-potentials of each edge (m, k, k). Returns beliefs (n, k)."""
    n, k = nodes.shape
    m = len(edges)
    if m:
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.exp(np.concatenate([potentials, potentials.transpose(0, 2, 1)]))
        msg = np.zeros((2 * m, k))
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        for _ in range(rounds):
            total = nodes.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("mi,mij->mj", out, pot) + 1e-300)
            new -= new.max(1, keepdims=True)
            msg = 0.5 * msg + 0.5 * new
        total = nodes.copy()
        np.add.at(total, dst, msg)
    else:
        total = nodes
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def field_spans(text: str, base: list[tuple[int, int, str]], field: Field, gap: int) -> list[tuple[int, int, str]]:
    """Spans that the field adds to the base spans: tokens more likely an entity than not that overlap no base span. Tokens in base spans have their labels for sure."""
    toks = tokens_of(text)
    if not toks:
        return []
    nodes = np.array([features(text, a, b) for a, b in toks]) @ field.weights
    k = 0
    for i, (a, b) in enumerate(toks):
        while k < len(base) and base[k][1] <= a:
            k += 1
        if k < len(base) and base[k][0] < b:
            nodes[i, 1 + _ORDER[base[k][2]]] += 30.0
    chain, far = links(text, toks, gap)
    pots = [field.chain] * len(chain) + [field.skip * np.eye(len(KINDS) + 1)] * len(far)
    p = marginals(nodes, np.array(chain + far, np.int64).reshape(-1, 2), np.array(pots).reshape(-1, len(KINDS) + 1, len(KINDS) + 1))
    out, k = [], 0
    for (a, b), y, most in zip(toks, p.argmax(1), p.max(1)):
        while k < len(base) and base[k][1] <= a:
            k += 1
        if y and most > 0.5 and not (k < len(base) and base[k][0] < b):
            out.append((a, b, KINDS[y - 1]))
    return out


def training_sample(docs: DataFrame, sample_docs: int, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most `sample_docs` texts that hold a digit or an at sign, the smallest by a hash: the bounded sample the field is fitted on.

    Only hashes below a share of about forty times `sample_docs` of all rows are looked at, so no task sends more than its part of that.
    """
    total = max(1, docs.count())
    t = text_of(docs, id_col, text_col).withColumn("_h", F.xxhash64("text"))
    t = t.where((F.pmod("_h", F.lit(1_000_000)) < int(1 + 1_000_000 * min(1.0, 40 * sample_docs / total))) & F.col("text").rlike("[0-9@]") & (F.length("text") < 20_000))
    return [r[0] for r in t.orderBy("_h").select("text").limit(sample_docs).collect()]


def find_pii(docs: DataFrame, sample_docs: int = 300, gap: int = 24, model: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Spans are kind:start:end in code points, the end exclusive, by start and then kind, joined by commas; base_sha256 is
    the digest of the base ones alone. The field is fitted on `training_sample` (at most `sample_docs` texts of under 20,000 characters, weakly
    labelled by the base patterns) unless a `model` from `train` is given; every text is searched whole. A null or empty
    text has no spans. Repeated rows give repeated rows, other columns are ignored, an empty table gives no rows.
    """
    field = model or train(training_sample(docs, sample_docs, id_col, text_col), gap=gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        for ids, texts in text_blocks(batches):
            rows = []
            for t in texts:
                base = base_spans(t) if _ACTIVE.search(t) else []
                more = field_spans(t, base, field, gap) if _ACTIVE.search(t) else []
                n = [sum(k == kind for _, _, k in base) for kind in KINDS[:4]]
                rows.append((*n, hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more, key=lambda x: (x[0], _ORDER[x[2]]))), len(more)))
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.string()), pa.array(c[6], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    t = text_of(docs, id_col, text_col)
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
