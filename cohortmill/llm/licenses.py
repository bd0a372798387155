"""Operator 9: license scan by template markup.

A template is wording with `<<opt>> ... <<end>>` around what may be left out, nested at will, and `<<any n>>` where up to n
words may stand. It is compiled into an automaton over words; a text is accepted where all mandatory words match exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortmill.llm.common import LOWER, joined, text_blocks, text_of, word_spans
from cohortmill.llm.license_texts import TEMPLATES

#: The phrases whose places are counted, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


class Automaton:
    """One template as a nondeterministic automaton over words: state -> arcs (word or None for any word, next state)."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.need: list[int] = [0]
        self.n_mandatory = 0
        opened: list[int] = []
        for item in re.findall(r"<<any \d+>>|<<opt>>|<<end>>|[^<]+", template):
            here = len(self.arcs) - 1
            if item == "<<opt>>":
                opened.append(here)
            elif item == "<<end>>":
                self.free[opened.pop()].append(here)
            elif item.startswith("<<any"):
                stops = [here]
                for _ in range(int(item[6:-2])):
                    stops.append(self.add(stops[-1], None, 0))
                for s in stops[:-1]:
                    self.free[s].append(stops[-1])
            else:
                for word in WORD.findall(item.lower().encode()):
                    here = self.add(here, word, int(not opened))
                    self.n_mandatory += not opened
        if opened or not self.n_mandatory:
            raise ValueError(f"a region without an end, or no mandatory word: {template[:80]}")
        self.last = len(self.arcs) - 1
        self.starts = {w for s in self.closure({0: 0}) for w, _ in self.arcs[s]}
        if None in self.starts:
            raise ValueError(f"a template must begin with a word: {template[:80]}")

    def add(self, state: int, word: bytes | None, counts: int) -> int:
        new = len(self.arcs)
        self.arcs.append([])
        self.free.append([])
        self.need.append(counts)
        self.arcs[state].append((word, new))
        return new

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.free[s]:
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def match(self, words: list[bytes], start: int) -> tuple[int, int]:
        """The end of the longest accepted run of words from `start`, or -1, and how many mandatory words matched."""
        states, end, most, i = self.closure({0: 0}), -1, 0, start
        while states and i < len(words):
            nxt: dict[int, int] = {}
            for s, n in states.items():
                for w, t in self.arcs[s]:
                    if w is None or w == words[i]:
                        nxt[t] = max(nxt.get(t, -1), n + self.need[t])
            i += 1
            states = self.closure(nxt)
            most = max([most, *states.values()])
            if self.last in states:
                end = i
        return end, most


def scan_text(low: bytes, automata: list[Automaton], phrases) -> tuple[int, int | None, int | None, list[str], list[str], float]:
    """Of one text in lower case: count, first and last word of base places, base labels, all labels, score."""
    near = [p for p in phrases if all(w in low for w in p[0])]
    likely = [a for a in automata if any(w in low for w in a.starts)]
    if not likely and not near:
        return 0, None, None, [], [], 0.0
    words = WORD.findall(low)
    wanted = {w for a in likely for w in a.starts} | {p[0][0] for p in near}
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            places.setdefault(w, []).append(i)
    found, base = [], set()
    for phrase, label in near:
        for i in places.get(phrase[0], ()):
            if tuple(words[i : i + len(phrase)]) == phrase:
                found.append(i)
                base.add(label)
    labels, score = set(base), float(bool(base))
    for a in likely:
        for w in a.starts:
            for i in places.get(w, ()):
                end, most = a.match(words, i)
                if end >= 0:
                    labels.add(a.label)
                score = max(score, 1.0 if end >= 0 else most / a.n_mandatory)
    return len(found), min(found, default=None), max(found, default=None), sorted(base), sorted(labels), score


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of `docs`.

    Words are those of the whole text with A-Z in lower case. Base places are where the words of a phrase stand
    consecutively, also where two overlap; `labels` adds those of accepted templates. `score` is 1 where anything was
    found, else the largest share of a template's mandatory words that matched in order from one of its first words on. A null or empty text has no
    words, no labels and a score of 0. Repeated rows give repeated rows, other columns are ignored, an empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(*t) for t in templates]
        cut = [(tuple(p.encode().split()), label) for p, label in phrases]
        for ids, texts in text_blocks(batches):
            data, at = joined(texts)
            low = LOWER[data]
            starts, _ = word_spans(low, _IS_WORD)
            n_words = np.diff(np.searchsorted(starts, at))
            raw = low.tobytes()
            rows = [scan_text(raw[at[i] : at[i + 1]], automata, cut) for i in range(len(texts))]
            n, first, last, base, labels, score = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([",".join(x) for x in base], pa.string()), pa.array([",".join(x) for x in labels], pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    t = text_of(docs, id_col, text_col)
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
