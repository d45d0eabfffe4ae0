"""Benchmark decontamination: documents that hold a benchmark item, also edited.

Texts are sequences of words (``\\w+``, lowered).  A document holds an item of m
words if some passage of it is at most ``floor((1 - SIMILARITY) * m)`` word
edits (insert, delete, replace) away.

1. Windows.  An item with at most e edits keeps a run of ceil((m - e) / (e + 1))
   words, so a passage shares a run of that length (four at most are used)
   with the item.  Each shared run lays an item-sized window over the text.
2. CGK random-walk embedding: step t of 3m emits the current word and moves on
   if a random bit of (t, word) is set.  Two sequences that share the bits
   fall into step again after an edit, so edit distance becomes Hamming distance.
3. Bit sampling: ``REPEATS`` walks are sampled at ``SAMPLES`` steps each; a
   window stays if it collides with the item in any of them.  With the chance c
   that a step of a pair at the largest distance agrees (over 0.4 as measured in
   the tests), the recall is 1 - (1 - c**SAMPLES)**REPEATS, over 0.99.
4. Exact verification: the smallest edit distance of the item to any passage
   around the window, by bit-parallel dynamic programming.

Items are taken in blocks of ``BLOCK_ITEMS``, so what a task holds of them is
bounded; documents are never shuffled.  Items of no words match nothing.  Null
and empty texts hold nothing.  Repeated rows and items are each reported.
Empty tables: empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import cut, map_arrow, number_rows, unused

SIMILARITY = 0.8
REPEATS = 32             # random walks
SAMPLES = 2              # steps of a walk that must agree
RUN_MAX = 4              # words of a shared run that lays a window
BLOCK_ITEMS = 20_000     # items that a task holds at a time
SEED = 0x9E3779B97F4A7C15

_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[str]:
    return [w.lower() for w in _WORD.findall(text or "")]


def allowed(m: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of m words may have."""
    return int((1 - similarity) * m + 1e-9)


def run_length(m: int, similarity: float = SIMILARITY) -> int:
    e = allowed(m, similarity)
    return max(1, min(RUN_MAX, -(-(m - e) // (e + 1))))


def mix(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(31))


def embed(windows: np.ndarray, repeats: int = REPEATS) -> np.ndarray:
    """CGK walks: (repeats, rows, 3m) codes of ``windows`` (rows, m) of word ids."""
    rows, m = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), -2, dtype=np.int64)], axis=1)
    at = np.zeros((repeats, rows), dtype=np.int64)
    out = np.empty((repeats, rows, 3 * m), dtype=np.int64)
    lane = np.arange(rows)
    seeds = mix(np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(SEED))[:, None]
    for t in range(3 * m):
        code = padded[lane, at]
        out[:, :, t] = code
        bit = mix(code.astype(np.uint64) * np.uint64(2 * t + 1) ^ seeds + np.uint64(t)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), m)
    return out


def sampled_steps(m: int, repeats: int = REPEATS, samples: int = SAMPLES) -> np.ndarray:
    """(repeats, samples): the steps at which a walk over m words is sampled."""
    rng = np.random.default_rng(m)
    return rng.integers(0, 3 * m, size=(repeats, samples))


def collide(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether each window (rows, m) agrees with its item (rows, m) at all samples of some walk."""
    m = windows.shape[1]
    steps = sampled_steps(m)
    a, b = (np.take_along_axis(embed(x), np.broadcast_to(steps[:, None, :], (REPEATS, len(x), SAMPLES)), axis=2)
            for x in (windows, item))
    return (a == b).all(axis=2).any(axis=0)


def best_passage(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end): the passage of ``text`` nearest to ``item``, the first
    and then shortest of equals; Myers' bit-parallel search, once from either side."""

    def search(pattern, stream, anchored):
        full, top = (1 << len(pattern)) - 1, 1 << len(pattern) - 1
        where: dict[int, int] = {}
        for i, c in enumerate(pattern):
            where[c] = where.get(c, 0) | 1 << i
        up, down, score = full, 0, len(pattern)
        best, at = score, 0
        for k, c in enumerate(stream):
            eq = where.get(c, 0)
            x = ((eq & up) + up ^ up) | eq | down
            plus, minus = down | ~(x | up) & full, up & x
            score += bool(plus & top) - bool(minus & top)
            plus = (plus << 1 | anchored) & full
            minus = minus << 1 & full
            v = eq | down
            up, down = minus | ~(v | plus) & full, plus & v
            if score < best:
                best, at = score, k + 1
        return best, at

    edits, end = search(item, text, 0)
    _, size = search(item[::-1], text[:end][::-1], 1)
    return edits, end - size, end


@dataclass
class Index:
    """Items of one block, their words and runs."""

    ids: list[int]
    items: list[list[int]]
    vocabulary: dict[str, int]
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(rows: list[tuple[int, str]], similarity: float) -> Index:
        vocabulary: dict[str, int] = {}
        items = [[vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)] for _, t in rows]
        index = Index([i for i, _ in rows], items, vocabulary)
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, item in enumerate(items):
            q = run_length(len(item), similarity)
            codes = run_codes(np.array(item, dtype=np.int64), q)
            by_size.setdefault(q, []).extend((int(c), k, j) for j, c in enumerate(codes.tolist()))
        for q, found in by_size.items():
            if found:
                found.sort()
                index.runs[q] = (np.array([c for c, _, _ in found], dtype=np.uint64),
                                 np.array([k for _, k, _ in found]), np.array([j for _, _, j in found]))
        return index


def run_codes(ids: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of each run of q ids."""
    n = len(ids) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    code = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        code = mix(code * np.uint64(31) + ids[j:j + n].astype(np.uint64) + np.uint64(SEED))
    return code


def windows_of(ids: np.ndarray, index: Index) -> np.ndarray:
    """(item, start) of all windows that a shared run lays over the text, each once."""
    known = ids >= 0
    found = []
    for q, (codes, items, places) in index.runs.items():
        n = len(ids) - q + 1
        if n <= 0:
            continue
        whole = known[:n].copy()
        for j in range(1, q):
            whole &= known[j:j + n]
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        own = np.zeros(len(at), dtype=np.uint64)
        for j in range(q):
            own = mix(own * np.uint64(31) + ids[at + j].astype(np.uint64) + np.uint64(SEED))
        low, high = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
        n_hits = high - low
        hit = np.repeat(np.arange(len(at)), n_hits)
        entry = np.arange(n_hits.sum()) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits) + np.repeat(low, n_hits)
        found.append(np.stack([items[entry], np.maximum(at[hit] - places[entry], 0)], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


def matches(text: str | None, index: Index, similarity: float = SIMILARITY) -> list[dict]:
    """The items that a text holds, each with its nearest passage (code points)."""
    found = _WORD.findall(text or "")
    ids = np.fromiter(map(index.vocabulary.get, map(str.lower, found), [-1] * len(found)), np.int64, len(found))
    laid = windows_of(ids, index)
    if not len(laid):
        return []
    sizes = np.array([len(index.items[k]) for k in laid[:, 0]])
    stays = []
    for m in np.unique(sizes):
        own = laid[sizes == m]
        take = np.minimum(own[:, 1], max(0, len(ids) - m))[:, None] + np.arange(m)
        padded = np.concatenate([ids, np.full(max(0, m - len(ids)), -1)])
        items = np.array([index.items[k] for k in own[:, 0]], dtype=np.int64)
        stays.append(own[collide(padded[take], items)])
    best: dict[int, tuple[int, int, int]] = {}
    for k, start in np.concatenate(stays).tolist():
        item = index.items[k]
        e = allowed(len(item), similarity)
        low = max(0, start - e)
        edits, a, b = best_passage(item, ids[low:start + len(item) + 2 * e].tolist())
        if edits <= e and (k not in best or (edits, low + a) < best[k][:2]):
            best[k] = (edits, low + a, low + b)
    if not best:
        return []
    spots = [m.span() for m in _WORD.finditer(text)]
    return [{"item_id": index.ids[k], "edits": edits, "similarity": 1 - edits / len(index.items[k]),
             "start": spots[a][0], "end": spots[b - 1][1]} for k, (edits, a, b) in sorted(best.items())]


_MATCH = pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64()),
                    ("start", pa.int64()), ("end", pa.int64())])
MATCH = "array<struct<item_id: bigint, edits: bigint, similarity: double, start: bigint, end: bigint>>"


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY,
           size: int = BLOCK_ITEMS):
    """Indexes of the benchmark's items, block by block."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t is not null")
    n = items.count()
    if n > size:
        items = cut(number_rows(items.withColumn("key", F.xxhash64("id", "t")), [], "key", "place"))
    for k in range(-(-n // size)):
        part = items.where(F.col("place").between(k * size, (k + 1) * size - 1)) if n > size else items
        rows = sorted(((r["id"], r["t"]) for r in part.select("id", "t").collect()), key=lambda r: (r[0] is None, r))
        yield Index.of(rows, similarity)


def _with_matches(docs: DataFrame, index: Index, similarity: float, text_col: str, out: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{out}` {MATCH}"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [matches(t, sent.value, similarity) for t in batch.column(names.index(text_col)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(_MATCH))], names=[*names, out])

    return map_arrow(docs, run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, similarity, start, end): every item that a document holds."""
    found = None
    for index in blocks(benchmark, similarity=similarity):
        own = _with_matches(docs.select("doc_id", "text"), index, similarity, "text", "_m").select("doc_id", F.inline("_m"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        empty = f"{docs.schema['doc_id'].dataType.simpleString()}"
        found = docs.select("doc_id", F.lit(None).cast(MATCH).alias("_m")).select(
            F.col("doc_id").cast(empty).alias("doc_id"), F.inline("_m"))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns as they were, whatever their names."""
    own = unused(docs, "_m")
    for index in blocks(benchmark, similarity=similarity):
        docs = _with_matches(docs, index, similarity, text_col, own).where(F.size(own) == 0).drop(own)
    return docs
