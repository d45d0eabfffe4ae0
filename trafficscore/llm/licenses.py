"""Licence scan: a generalised suffix automaton of licence tokens.

Texts are sequences of words (runs of digits, A-Z, a-z and all code points from
U+0080 on; only A-Z lowered).  The automaton holds every substring of every
template and phrase; it is built once per worker from fixed texts
(``license_texts``), so its size doesn't depend on the data.

1. Matching statistics.  A file is streamed through the automaton word by word:
   after each word the state and length of the longest suffix that stands in
   some template.  Words that no template has reset it.
2. Matches.  The end positions of a state's strings, and those of its suffix
   links for shorter suffixes, give each template's own matches; one is kept
   where template and file go on differently.  It is *long* with ``LONG`` words,
   or half of a template that is shorter than twice that.
3. Chains.  Long matches of a template that follow each other in both file and
   template, at most ``GAP`` words apart in the file, are chained for most
   covered template words.  A chain that covers ``SIMILARITY`` of its template
   is a span.  Of spans that overlap in the file the one with most words stays.
4. Phrases (``PHRASES``) are strings of the automaton too: all places where a
   phrase ends are read off the state.

Documents are independent: nothing is shuffled, and copies or hot sources cost
no more than other rows.  Null text counts as empty and has no words; very long
texts are tokenised in pieces of ``PIECE`` bytes and kept as 4 bytes a word.
Repeated rows come out as often as they went in; null doc_ids stay null.  Other
columns of the input are not read, whatever their names.  Empty table: empty
result.  Ties between spans: more words, then higher similarity, then the
earlier template.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trafficscore.llm.common import map_arrow
from trafficscore.llm.license_texts import PHRASES, TEMPLATES

LONG = 4             # words of a long match
GAP = 16             # file words between two matches of a chain
SIMILARITY = 0.8     # share of a template's words that a span covers
PIECE = 1 << 20      # bytes of a text that are split into words at a time

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# every byte outside words becomes a blank, A-Z become a-z
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """Suffix automaton of several token sequences."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _shorter(self, p: int, token: int) -> int:
        """The state of (longest string of p) + token, split off its present state if that holds longer ones."""
        q = self.step[p][token]
        if self.size[q] == self.size[p] + 1:
            return q
        own = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.step[p].get(token) == q:
            self.step[p][token] = own
            p = self.link[p]
        return own

    def add(self, tokens: list[int]) -> None:
        at = 0
        for token in tokens:
            if token in self.step[at]:
                at = self._shorter(at, token)
                continue
            new = self._state(self.size[at] + 1, {}, 0)
            while at >= 0 and token not in self.step[at]:
                self.step[at][token] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._shorter(at, token)
            at = new

    def states(self, tokens: list[int]):
        at = 0
        for token in tokens:
            at = self.step[at][token]
            yield at


@dataclass
class Scanner:
    """The automaton with what each state's strings end."""

    labels: list[str]                # per template
    sizes: list[int]                 # its words
    need: list[int]                  # words of a long match
    phrases: list[tuple[str, int]]   # label and words of each phrase
    vocabulary: dict[bytes, int]
    follows: list[list[int]]         # per template: the token after each position, -2 at its end
    automaton: Automaton
    #: per state: (template, position, most words of the match) of all template places that its strings end
    ends: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)
    said: dict[int, list[int]] = field(default_factory=dict)     # per state: phrases that its strings end

    @staticmethod
    def of(templates=TEMPLATES, phrases=PHRASES) -> Scanner:
        vocabulary: dict[bytes, int] = {}
        texts = [[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)] for _, t in (*templates, *phrases)]
        auto = Automaton()
        for tokens in texts:
            auto.add(tokens)
        n = len(templates)
        sizes = [len(t) for t in texts[:n]]
        scan = Scanner([label for label, _ in templates], sizes, [min(LONG, -(-m // 2)) for m in sizes],
                       [(label, len(t)) for (label, _), t in zip(phrases, texts[n:], strict=True)], vocabulary,
                       [[*t[1:], -2] for t in texts[:n]], auto)
        # a place belongs to its prefix's state and to all states that are suffixes of it
        places: list[dict[tuple[int, int], None]] = [{} for _ in auto.size]
        for t, tokens in enumerate(texts[:n]):
            for i, state in enumerate(auto.states(tokens)):
                while state > 0:
                    places[state][t, i] = None
                    state = auto.link[state]
        for state in range(1, len(auto.size)):
            known, at = {}, state
            while at > 0:
                for t, i in places[at]:
                    if auto.size[at] >= scan.need[t]:
                        known.setdefault((t, i), auto.size[at])
                at = auto.link[at]
            if known:
                scan.ends[state] = [(t, i, size) for (t, i), size in known.items()]
        for k, tokens in enumerate(texts[n:]):
            own = list(auto.states(tokens))[-1]
            for state in range(1, len(auto.size)):
                at = state
                while at > 0 and at != own:
                    at = auto.link[at]
                if at == own:
                    scan.said.setdefault(state, []).append(k)
        return scan

    def tokens(self, text: bytes) -> np.ndarray:
        """Token of each word, -1 for words that no template has."""
        parts, at, get = [], 0, self.vocabulary.get
        clean = text.translate(_BYTES)
        while at < len(clean):
            end = min(at + PIECE, len(clean))
            if end < len(clean):
                space = clean.find(b" ", end)
                end = len(clean) if space < 0 else space
            words = clean[at:end].split()
            parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def statistics(self, tokens: np.ndarray):
        """(word, state, length) where the longest match is of two words or more."""
        step, link, size = self.automaton.step, self.automaton.link, self.automaton.size
        known = tokens >= 0
        beside = np.zeros(len(tokens), dtype=bool)
        beside[1:] |= known[:-1]
        beside[:-1] |= known[1:]
        at = np.flatnonzero(known & beside)
        state, length, last = 0, 0, -2
        for i, token in zip(at.tolist(), tokens[at].tolist(), strict=True):
            if i != last + 1:
                state, length = 0, 0
            last = i
            while state and token not in step[state]:
                state = link[state]
                length = size[state]
            state = step[state].get(token, 0)
            length = length + 1 if state else 0
            if length > 1:
                yield i, state, length

    def scan(self, text: str | bytes | None) -> Found:
        raw = text.encode() if isinstance(text, str) else text or b""
        tokens = self.tokens(raw)
        found = Found(len(tokens))
        matches: dict[int, list[tuple[int, int, int]]] = {}
        ends, said = self.ends, self.said
        for i, state, length in self.statistics(tokens):
            for k in said.get(state, ()):
                if self.phrases[k][1] <= length:
                    found.places.append((i + 1 - self.phrases[k][1], k))
            if state in ends:
                after = int(tokens[i + 1]) if i + 1 < len(tokens) else -1
                for t, p, most in ends[state]:
                    own = min(most, length)
                    if own >= self.need[t] and self.follows[t][p] != after:
                        matches.setdefault(t, []).append((i + 1, p + 1, own))
        found.spans = apart([s for t, own in sorted(matches.items()) for s in self.chains(t, own)])
        return found

    def chains(self, t: int, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Spans of template ``t`` from its long matches (file end, template end, words), in file order."""
        best, before = [], []
        stops = [f for f, _, _ in matches]
        for k, (f, p, n) in enumerate(matches):
            value, back = n, -1
            for j in range(bisect_left(stops, f - n - GAP), k):
                f2, p2, _ = matches[j]
                if f2 < f and p2 < p:
                    own = best[j] + min(n, f - f2, p - p2)
                    if own > value:
                        value, back = own, j
            best.append(value)
            before.append(back)
        spans, used = [], set()
        for k in sorted(range(len(matches)), key=lambda k: (-best[k], k)):
            if k in used:
                continue
            first, at, shared = k, k, 0
            while at >= 0:
                if at in used:
                    shared = best[at]
                    break
                used.add(at)
                first, at = at, before[at]
            covered = best[k] - shared
            if covered >= SIMILARITY * self.sizes[t] - 1e-9:
                spans.append(Span(t, self.labels[t], matches[first][0] - matches[first][2], matches[k][0], covered,
                                  covered / self.sizes[t]))
        return spans


@dataclass(frozen=True)
class Span:
    template: int
    label: str
    start: int          # words of the file, end exclusive
    end: int
    covered: int        # words of the template
    similarity: float


@dataclass
class Found:
    words: int
    places: list[tuple[int, int]] = field(default_factory=list)     # first word and number of each phrase
    spans: list[Span] = field(default_factory=list)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def apart(spans: list[Span]) -> list[Span]:
    """Of spans that overlap in the file, the one with most covered words stays; in file order."""
    out: list[Span] = []
    spans = sorted(spans, key=lambda s: (s.start, s.end))
    at = 0
    while at < len(spans):
        # a run of overlapping spans is settled by itself
        end, stop = spans[at].end, at + 1
        while stop < len(spans) and spans[stop].start < end:
            end = max(end, spans[stop].end)
            stop += 1
        taken = np.zeros(end - spans[at].start, dtype=bool)
        base = spans[at].start
        for s in sorted(spans[at:stop], key=lambda s: (-s.covered, -s.similarity, s.template, s.start)):
            if not taken[s.start - base:s.end - base].any():
                taken[s.start - base:s.end - base] = True
                out.append(s)
        at = stop
    return sorted(out, key=lambda s: s.start)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner.of()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(1).cast(pa.binary()).to_pylist()


def spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, label, template, start, end, covered, similarity): every template span; start and end in code points."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        scan, rows, at = scanner(), [], []
        for k, text in enumerate(_texts(batch)):
            found = scan.scan(text).spans
            if found:
                wanted = {s.start for s in found} | {s.end - 1 for s in found}
                where = {i: m.span() for i, m in enumerate(_WORD.finditer(text.decode())) if i in wanted}
                for s in found:
                    rows.append((s.label, s.template, where[s.start][0], where[s.end - 1][1], s.covered, s.similarity))
                    at.append(k)
        if not rows:
            return None
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
            names=[id_col, "label", "template", "start", "end", "covered", "similarity"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, label string, template int, start long, "
                     "end long, covered int, similarity double")


def report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_words, n_base (phrase places), first_word and last_word of them, base_labels, labels, score
    (1 with a phrase, else the best span's similarity, else 0) and n_spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan, rows = scanner(), []
        for text in _texts(batch):
            found = scan.scan(text)
            base = sorted({scan.phrases[k][0] for _, k in found.places})
            starts = [w for w, _ in found.places]
            score = 1.0 if base else max((s.similarity for s in found.spans), default=0.0)
            rows.append((found.words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(base),
                         ",".join(sorted({*base, *(s.label for s in found.spans)})), score, len(found.spans)))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
            names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, "
                     "last_word long, base_labels string, labels string, score double, n_spans long")
