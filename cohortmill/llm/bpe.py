"""Operator 8: byte-level BPE encoding and decoding by a lazily determinised transducer.

A token sequence is the BPE encoding of its bytes exactly when each pair of neighbours is the encoding of the pair's own
bytes. So encoding is a nondeterministic transducer over bytes: a hypothesis is a place where a token may end, the
token that ends there and the node of the vocabulary's trie for the bytes since. Its sets of hypotheses are determinised
as inputs need them and each transition is computed once. A transition tells the last token of the encoding of what was
read so far; tokens before the place where all hypotheses agree are put out. A hypothesis lives no longer than the
longest token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.common import text_blocks, text_of, tidied

ROOT = 0
#: A hypothesis is one number: the node of the trie, and in the last _BITS bits the token before plus 1.
_BITS = 20
_TOKEN = (1 << _BITS) - 1
#: Characters of texts whose new words are encoded together.
BLOCK = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The defining, slow procedure: join the neighbours of the lowest rank, the first of equals, until none can be joined."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if r == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """The lazily determinised transducer for one rank table. `max_states` bounds the memory: beyond it all states are forgotten."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.lengths[list(self.length)] = list(self.length.values())
        self.child: dict[int, int] = {}
        self.token_at, self.leaf, self.depth = [-1], [True], [0]
        for token, rank in ranks.items():
            node = ROOT
            for b in token:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    self.leaf[node] = False
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.leaf.append(True)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, bytes]]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[int, ...]] = [(ROOT << _BITS,)]
        self.number = {self.states[0]: 0}
        # transitions by state << 8 | byte, sorted for many at once: the next state and the token that then comes last
        self.keys, self.to, self.last = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.fresh: dict[int, tuple[int, int]] = {}

    def spine(self, token: int, right: bool) -> list[tuple[int, bytes]]:
        """The nodes of the token's merge tree along one edge, from the byte up, each with the time at which it stands: the highest rank merged below it."""
        known = self.spines.get((token, right))
        if known is None:
            b = self.bytes_of[token]
            if len(b) == 1:
                known = [(-1, b)]
            else:
                rank = self.ranks.pop(b)  # without its own rank, the encoding stops at the two halves
                left, other = merge_by_rank(b, self.ranks)
                self.ranks[b] = rank
                a, c = self.spine(self.ranks[left], right), self.spine(self.ranks[other], right)
                known = [*(c if right else a), (max(rank, a[-1][0], c[-1][0]), b)]
            self.spines[token, right] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`; at the start, whether `right` is its own encoding.

        Walks both merge trees along the seam in the order in which their nodes come to stand: `right` may not follow if
        two nodes that stand side by side join before either goes into its own parent. Equal times are left to
        `merge_by_rank`.
        """
        key = left + 1 << _BITS | right
        known = self.fits.get(key)
        if known is None:
            b = self.bytes_of[right]
            if left < 0:
                known = merge_by_rank(b, self.ranks) == [b]
            else:
                known = self.compatible(-1, right) and self.seam_holds(left, right)
            if len(self.fits) > 500_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def seam_holds(self, left: int, right: int) -> bool:
        x, y, i, j, never = self.spine(left, True), self.spine(right, False), 0, 0, 1 << 60
        while True:
            px = x[i + 1][0] if i + 1 < len(x) else never
            py = y[j + 1][0] if j + 1 < len(y) else never
            joint = self.ranks.get(x[i][1] + y[j][1])
            if joint is not None:
                joint = max(joint, x[i][0], y[j][0])
                if joint < px and joint < py:
                    return False
            if px == py or joint is not None and joint == min(px, py):
                if px == py == never:
                    return True
                a, b = self.bytes_of[left], self.bytes_of[right]
                return merge_by_rank(a + b, self.ranks) == [a, b]
            if px < py:
                i += 1
            else:
                j += 1

    def move(self, key: int) -> tuple[int, int]:
        """The transition of state key >> 8 on byte key & 255: the next state and the token that now comes last."""
        alive, last, b = [], -1, key & 255
        child, token_at, leaf, fits = self.child, self.token_at, self.leaf, self.fits
        for h in self.states[key >> 8]:
            nxt = child.get(h >> _BITS << 8 | b)
            if nxt is None:
                continue
            before = h & _TOKEN
            if last < 0:
                t = token_at[nxt]
                if t >= 0:
                    fit = fits.get(before << _BITS | t)
                    if fit or fit is None and self.compatible(before - 1, t):
                        last = t
            if not leaf[nxt]:
                alive.append(nxt << _BITS | before)
        alive.append(ROOT << _BITS | last + 1)
        state = tuple(alive)
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number, last

    def end(self, key: int) -> int:
        """The token that comes last after state key >> 8 and the byte key & 255, where nothing follows: no state is made."""
        child, token_at, fits, b = self.child, self.token_at, self.fits, key & 255
        for h in self.states[key >> 8]:
            nxt = child.get(h >> _BITS << 8 | b)
            if nxt is not None and (t := token_at[nxt]) >= 0:
                before = h & _TOKEN
                fit = fits.get(before << _BITS | t)
                if fit or fit is None and self.compatible(before - 1, t):
                    return t
        return -1

    def step(self, states: np.ndarray, data: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the last token for each state and byte. Transitions that are not known yet are determined once each; only the first `more` need a state, as for the others nothing follows."""
        key = states.astype(np.int64) << 8 | data
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        to, last = (self.to[at], self.last[at]) if len(self.keys) else (np.zeros(len(key), np.int32), np.zeros(len(key), np.int32))
        fresh = self.fresh
        new, which = np.unique(key[:more][~known[:more]], return_inverse=True)
        if len(new):
            made = []
            for k in new.tolist():
                m = fresh.get(k)
                if m is None:
                    m = fresh[k] = self.move(k)
                made.append(m)
            made = np.array(made, np.int32)
            open_ = np.flatnonzero(~known[:more])
            to[open_], last[open_] = made[which, 0], made[which, 1]
        new, which = np.unique(key[more:][~known[more:]], return_inverse=True)
        if len(new):
            closed = more + np.flatnonzero(~known[more:])
            last[closed] = np.array([m[1] if (m := fresh.get(k)) else self.end(k) for k in new.tolist()], np.int32)[which]
        return to, last

    def store(self) -> None:
        """Puts the new transitions among the sorted ones."""
        if self.fresh:
            new = np.array(sorted(self.fresh), np.int64)
            made = np.array([self.fresh[k] for k in new.tolist()], np.int32)
            place = np.searchsorted(self.keys, new)
            self.keys, self.to, self.last = np.insert(self.keys, place, new), np.insert(self.to, place, made[:, 0]), np.insert(self.last, place, made[:, 1])
            self.fresh = {}

    def settled(self, state: int, lasts: list[int]) -> int:
        """The end of the tokens on which all hypotheses agree."""
        here, length = len(lasts), self.length
        ends = {here - self.depth[h >> _BITS] for h in self.states[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - length[lasts[far - 1]])
        return ends.pop()

    def trace(self, lasts: list[int], end: int) -> list[int]:
        """The tokens up to `end`, from the last of each prefix."""
        out, length = [], self.length
        while end:
            t = lasts[end - 1]
            out.append(t)
            end -= length[t]
        out.reverse()
        return out

    def encode(self, piece: bytes, step: int = 1024) -> list[int]:
        """The ids of one pre-token of any length, put out while it is read; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self.reset()
        out: list[int] = []
        lasts: list[int] = []
        state, moves = 0, {}
        for b in piece:
            key = state << 8 | b
            known = moves.get(key)
            if known is None:
                known = moves[key] = self.move(key)
            state, last = known
            lasts.append(last)
            if len(lasts) == step:
                end = self.settled(state, lasts)
                out += self.trace(lasts, end)
                del lasts[:end]
                step = len(lasts) + 1024
        return out + self.trace(lasts, len(lasts))

    def encode_all(self, pieces: list[bytes], longest: int = 64) -> list[list[int]]:
        """`encode` of each piece. Those of at most `longest` bytes advance together, a byte at a time; the tokens of each are then traced back from its end, all pieces at once."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        for i in np.flatnonzero(size > longest).tolist():
            out[i] = self.encode(pieces[i])
        short = np.flatnonzero((size > 0) & (size <= longest))
        # the longest first, so that those still being read are the first ones
        short = short[np.argsort(-size[short], kind="stable")]
        n = size[short]
        if not len(short):
            return out
        if len(self.states) > self.max_states:
            self.reset()
        wide = int(n[0])
        data = np.frombuffer(b"".join(pieces[i].ljust(wide, b"\0") for i in short.tolist()), np.uint8).reshape(-1, wide)
        lasts = np.full((wide, len(short)), -1, np.int32)
        states = np.zeros(len(short), np.int32)
        for k in range(wide):
            live, more = (int(np.searchsorted(-n, -x, "left")) for x in (k, k + 1))  # pieces of more than so many bytes
            states[:live], lasts[k, :live] = self.step(states[:live], data[:live, k], more)
        self.store()
        end, every = n.copy(), np.arange(len(short))
        tokens: list[np.ndarray] = []
        while (left := every[end > 0]).size:
            t = np.full(len(short), -1, np.int32)
            t[left] = lasts[end[left] - 1, left]
            tokens.append(t)
            end[left] -= self.lengths[t[left]]
        rows = np.stack(tokens[::-1], 1)
        flat, cuts = rows[rows >= 0].tolist(), [0, *np.cumsum((rows >= 0).sum(1)).tolist()]
        for i, x, y in zip(short.tolist(), cuts, cuts[1:]):
            out[i] = flat[x:y]
        for i in short.tolist():
            whole = self.ranks.get(pieces[i])
            if whole is not None:
                out[i] = [whole]
        return out


#: Number of bytes that a UTF-8 lead byte asks for.
_NEED = bytes([1] * 0x80 + [0] * 0x42 + [2] * 0x1E + [3] * 0x10 + [4] * 5 + [0] * 11)


class StreamDecoder:
    """Ids to text, a few at a time: a state machine holds back the at most three bytes of a character that is not complete."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.held = bytes_of, b""

    def feed_bytes(self, ids) -> bytes:
        """The bytes of the characters that these ids complete."""
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            need = _NEED[data[-back]]
            if need:
                cut -= back if need > back else 0
                break
        self.held = data[cut:]
        return data[:cut]

    def feed(self, ids) -> str:
        return self.feed_bytes(ids).decode("utf-8", "replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


@contextmanager
def uncollected():
    """Without the collector of cycles, which would go through all that is cached time and again; encoding makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Codec:
    """A pattern, a transducer and a bounded cache of what the pattern finds.

    The cache holds two generations of about `cache` parts and matches, or those of one block of texts. Those that are met again go to the younger one; when that
    is full, the older one goes, with what was not met since. So frequent parts stay, however many rare ones pass.

    With `words`, the pattern is one whose matches never reach from a word past the blank behind it, as those that put a
    blank before a word do. Then, where every run of white space is one space or one line end, words can be looked up without matching the pattern again; other texts are matched as a whole.
    """

    def __init__(self, rank_path: str, pattern: str, cache: int = 150_000, words: bool = True):
        import regex

        self.fst = Transducer(load_ranks(rank_path))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.size, self.words = cache, words

    def forget(self) -> None:
        """Empties what grows with the texts, for the worker may go on with other work."""
        self.known.clear()
        self.old.clear()
        self.fst.fits.clear()
        self.fst.spines.clear()
        self.fst.reset()

    def parts(self, text: str) -> list[str]:
        """What is looked up: words with the blank before them where those can stand for the pattern's matches, else the matches."""
        if not self.words or " ".join(text.split()) != text.replace("\n", " "):
            return self.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else self.split(text)

    def unknown(self, parts: set[str]) -> list[str]:
        """Those of neither generation; those of the older one become those of the younger."""
        known, old, new = self.known, self.old, []
        for p in parts.difference(known):
            ids = old.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        return new

    @uncollected()
    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; parts that are new are encoded together."""
        parts = [self.parts(t) for t in texts]
        met = set().union(*parts)
        met.discard("")
        if len(self.known) + len(met) > self.size:
            self.old, self.known = self.known, {}
        known, split = self.known, self.split
        wanted, several = set(), []
        for p in self.unknown(met):
            own = split(p)
            if len(own) == 1:
                wanted.add(p)
            else:
                several.append((p, own))
                wanted.update(own)
        new = self.unknown(wanted)
        for p, ids in zip(new, self.fst.encode_all([p.encode("utf-8") for p in new])):
            known[p] = tuple(ids)  # tuples of numbers cost the garbage collector nothing
        for p, own in several:
            known[p] = tuple(i for w in own for i in known[w])
        known[""] = ()
        out = []
        for own in parts:
            ids: list[int] = []
            for p in own:
                ids += known[p]
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int], step: int = 65_536) -> str:
        d = StreamDecoder(self.fst.bytes_of)
        return "".join([*(d.feed(ids[i : i + step]) for i in range(0, len(ids), step)), d.finish()])

    def decoded_sha256(self, ids: list[int], step: int = 65_536) -> str:
        d, h = StreamDecoder(self.fst.bytes_of), hashlib.sha256()
        for i in range(0, len(ids), step):
            h.update(d.feed_bytes(ids[i : i + step]))
        h.update(d.held)
        return h.hexdigest()


_CODECS: dict[tuple[str, str, bool], Codec] = {}


def codec(rank_path: str, pattern: str, words: bool = True) -> Codec:
    """One codec for each Python worker."""
    key = (rank_path, pattern, words)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_path, pattern, words=words)
    return _CODECS[key]


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", words: bool = True) -> DataFrame:
    """doc_id, ids array<int>: the BPE ids of each whole text, without special tokens.

    `rank_path` is read on the executors (a file that each of them has, such as one of an installed package). `words` is false for patterns that `Codec` can't split at blanks. A null or
    empty text has no ids. Repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern, words)
        for keys, texts in text_blocks(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([keys, pa.array(c.encode_all(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])
        c.forget()

    t = text_of(docs, id_col, text_col)
    return t.mapInArrow(tidied(run), f"doc_id {t.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, text: the ids of `bpe_encode` as text again, by the incremental UTF-8 state machine. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                few = b.slice(at, 200)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([c.decode(x or []) for x in few.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", words: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `bpe_encode` and the streaming decode in one pass, the ids not kept.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded bytes. Cases as in `bpe_encode`;
    an empty text has 0 tokens and twice the digest of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern, words)
        names = {i: str(i) for i in c.fst.bytes_of}
        for keys, texts in text_blocks(batches, BLOCK):
            n, a, d = [], [], []
            for ids in c.encode_all(texts):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                d.append(c.decoded_sha256(ids))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    t = text_of(docs, id_col, text_col).select(F.col("doc_id"), F.col("text"))
    return t.mapInArrow(tidied(run), f"doc_id {t.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
