"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task collects the distinct words (matches of the split pattern) of the texts
it holds and lays their bytes out in one array of token ids with links to the
left and right neighbour.  An inverted index leads from the rank of a token
pair to the positions where the pair stands.  It is emptied in rank order: the
lowest ranks are taken, every word merges its own lowest pair (leftmost first),
and only the pairs that a merge touches (with its left and right neighbour) are
looked up and posted again.  That is the order of greedy BPE in each word, also
where a merge makes a pair of a lower rank.  Texts are then the concatenation
of their words' ids.

``encode`` adds ``ids``, ``decode`` turns ids into bytes.  No shuffle; a task
holds one chunk of texts.  Null text: no ids, like the empty text.  Rows with
any other columns pass through unchanged; equal rows stay equal rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import map_arrow

SHIFT = 20                       # ids stay below 2**20; a pair is one integer key
NONE = 0x7FFFFFFF                # "this pair has no rank"
SHELF = 6                        # the index is kept by shelves of 2**SHELF neighbouring ranks
STEP = 40_000                    # positions taken from the index at a time
LONG = 128                       # bytes; longer words are merged alone, by a heap
CHUNK = 4 << 20                  # bytes of text, or of ids, that a worker takes at a time
BLOCK_WORDS = 60_000             # words replayed together; bounds the memory of the index
WORDS_KEPT = 100_000             # distinct words whose ids a worker keeps between chunks
_LOADED: dict = {}


class Ranks:
    """Merge ranks of a vocabulary file (base64 token, rank per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        by_id = {i: t for t, i in self.rank.items()}
        self.token_bytes = np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), dtype=np.uint8)
        self.token_size = np.zeros(max(by_id) + 1, dtype=np.int64)
        self.token_size[list(by_id)] = [len(t) for t in by_id.values()]
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.of_byte = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pair = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    self.pair[left << SHIFT | right] = r
        self.pair_key = np.array(sorted(self.pair), dtype=np.int64)
        self.pair_rank = np.array([self.pair[k] for k in self.pair_key.tolist()], dtype=np.int64)
        self.split = regex.compile(pattern).findall
        # For texts of common Latin characters only, Python's own engine splits alike, and faster.
        latin = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
        plain = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^\\s{latin}0-9]").replace("\\p{L}", f"[{latin}]")
        plain = plain.replace("\\p{N}", "[0-9]")
        self.other = re.compile(f"[^\\t-\\r -~{latin}]").search
        self.split_plain = None if "\\p" in plain else re.compile(plain).findall

    def words(self, text: str) -> list[str]:
        if self.split_plain is None or self.other(text):
            return self.split(text)
        return self.split_plain(text)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def long_word(self, word: bytes) -> list[int]:
        """Greedy merging of one word through a heap of (rank, position)."""
        tok = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(tok)
        right, left, now = [*range(1, n), -1], list(range(-1, n - 1)), [NONE] * n
        heap = []

        def post(p: int) -> None:
            now[p] = self.pair.get(tok[p] << SHIFT | tok[right[p]], NONE) if right[p] >= 0 else NONE
            if now[p] != NONE:
                heapq.heappush(heap, (now[p], p))

        for p in range(n):
            post(p)
        while heap:
            r, p = heapq.heappop(heap)
            if now[p] != r:
                continue
            gone = right[p]
            tok[p], tok[gone], now[gone] = r, -1, NONE
            right[p] = right[gone]
            if right[p] >= 0:
                left[right[p]] = p
            post(p)
            if left[p] >= 0:
                post(left[p])
        return [t for t in tok if t >= 0]


def load_ranks(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Ranks(path, pattern)
    return _LOADED[path, pattern]


def replay(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, concatenated, and each word's number of ids."""
    alone = {i: [ranks.rank[w]] if w in ranks.rank else ranks.long_word(w)
             for i, w in enumerate(words) if w in ranks.rank or len(w) > LONG}
    laid = [b"" if i in alone else w for i, w in enumerate(words)]
    sizes = np.array([len(w) for w in laid], dtype=np.int64)
    tok = ranks.of_byte[np.frombuffer(b"".join(laid), dtype=np.uint8)]
    n, ends = len(tok), np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
    right[ends[sizes > 0] - 1] = -1
    left[(ends - sizes)[sizes > 0]] = -1
    rank_at = np.full(n, NONE, dtype=np.int64)
    index: dict[int, list[np.ndarray]] = {}      # shelf of ranks -> positions of the pairs' left tokens
    waiting: list[int] = []                      # shelves in the index, a heap

    def post(at: np.ndarray) -> None:
        at = at[rank_at[at] != NONE]
        shelf = rank_at[at] >> SHELF
        order = np.argsort(shelf, kind="stable")
        at, shelf = at[order], shelf[order]
        starts = np.flatnonzero(np.diff(shelf, prepend=-1))
        for k, part in zip(shelf[starts].tolist(), np.split(at, starts[1:]), strict=False):
            if k not in index:
                index[k] = []
                heapq.heappush(waiting, k)
            index[k].append(part)

    paired = np.flatnonzero(right >= 0)
    rank_at[paired] = ranks.of_pairs(tok[paired], tok[right[paired]])
    post(paired)
    while waiting:
        parts, taken = [], 0
        while waiting and taken < STEP:
            shelf = heapq.heappop(waiting)
            own = index.pop(shelf)
            parts += own
            taken += sum(map(len, own))
        at = np.unique(np.concatenate(parts))
        at = at[rank_at[at] >> SHELF <= shelf]      # without those that stand elsewhere by now
        # of each word the lowest rank, leftmost: what greedy merging takes next; the rest waits
        order = np.lexsort((at, rank_at[at], owner[at]))
        at = at[order]
        first = np.diff(owner[at], prepend=-1) != 0
        rest, at = at[~first], at[first]
        gone = right[at]
        after, before = right[gone], left[at]
        tok[at], tok[gone] = rank_at[at], -1
        rank_at[gone] = rank_at[at] = NONE
        right[at] = after
        left[after[after >= 0]] = at[after >= 0]
        touched = np.concatenate([at[after >= 0], before[before >= 0]])
        rank_at[touched] = ranks.of_pairs(tok[touched], tok[right[touched]])
        post(np.concatenate([touched, rest]))
    flat, sizes = tok[tok >= 0], np.bincount(owner[tok >= 0], minlength=len(words))
    if alone:
        places = np.repeat((np.cumsum(sizes) - sizes)[list(alone)], [len(x) for x in alone.values()])
        flat = np.insert(flat, places, [t for x in alone.values() for t in x])
        sizes[list(alone)] = [len(x) for x in alone.values()]
    return flat, sizes


def ragged_take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[starts[w]:starts[w] + sizes[w]]`` for w in which."""
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(total)]


class Encoder:
    """Encodes chunks of texts; the ids of words met before are kept."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.clear()

    def clear(self) -> None:
        self.number = defaultdict(count().__next__)
        self.flat = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.done = 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's number of ids."""
        if self.done > WORDS_KEPT:
            self.clear()
        split, get = self.ranks.words, self.number.__getitem__
        words = [np.fromiter(map(get, split(t)), dtype=np.int32) if t else np.zeros(0, dtype=np.int32)
                 for t in texts]
        new = [w.encode("utf-8", "surrogatepass") for w in list(self.number)[self.done:]]
        for at in range(0, len(new), BLOCK_WORDS):
            flat, sizes = replay(self.ranks, new[at:at + BLOCK_WORDS])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        self.done = len(self.number)
        starts = np.cumsum(self.sizes) - self.sizes
        ids = [ragged_take(self.flat, starts, self.sizes, w).astype(np.int32) for w in words]
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), np.array([len(i) for i in ids])


def _list_array(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: array<int> of token ids instead of ``text_col``."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, out)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` array<int>"])
    names = [f.name for f in kept]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = ("encoder", path, pattern)
        if key not in _LOADED:
            _LOADED[key] = Encoder(load_ranks(path, pattern))
        flat, sizes = _LOADED[key].encode(batch.column(text_col).to_pylist())
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _list_array(flat, sizes)],
                                          names=[*names, out])

    return map_arrow(df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text_col}`")), run, schema, CHUNK)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the ids of each row stand for."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` binary"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = load_ranks(path, pattern)
        ids = batch.column(batch.schema.get_field_index(ids_col)).fill_null([])
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths())
        decoded = [ragged_take(ranks.token_bytes, ranks.token_start, ranks.token_size, part).tobytes()
                   for part in np.split(flat, ends[:-1])]
        return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(decoded, pa.binary())],
                                          names=[*(f.name for f in kept), out])

    return map_arrow(df.select(*[F.col(f"`{f.name}`") for f in kept]), run, schema, CHUNK)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes they decode to."""
    ids = encode(df.select("doc_id", "text"), path, pattern)
    return (decode(ids, path, pattern)
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256")))
