"""Quality classifier: a generalised additive model with pairwise interactions.

``features`` reads each whole text once and gives the numbers of ``FEATURES``.
``fit`` learns on a bounded sample of labelled rows (``SAMPLE_ROWS``, those of
smallest hash, so the sample is the same at every run): features are cut into
at most ``BINS`` bins at quantiles, and shallow trees (``LEAVES`` leaves) over
one feature's bins at a time are boosted in turn; each adds to that feature's
lookup table.  Then the ``PAIRS`` pairs of features whose quadrants explain
most of what is left get two-dimensional tables, boosted likewise.

``score`` finds each feature's bin and adds table entries for a whole batch;
a score in [0, 1] is the estimated chance of label 1.

Null text counts as empty and is scored like any text.  Labels that are null or
not 0/1 are ignored; rows with several labels count once each.  With no usable
label every score is 0.5.  Empty table: empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import map_arrow, unused

SAMPLE_ROWS = 20_000     # labelled rows that a model is fitted on, at most
BINS = 64                # of a feature
GRID = 12                # bins of each side of an interaction
LEAVES = 4
ROUNDS = 150             # cycles over all features
PAIRS = 8
PAIR_ROUNDS = 60
RATE = 0.15
DAMPING = 4.0            # added to the second derivatives of a leaf
MIN_LEAF = 8             # rows
ACCEPT = 0.7             # score from which on a text counts as good

FEATURES = ("chars", "words", "word_length", "shouted", "capital", "digits", "marks", "exclaimed", "piped", "signs",
            "sentence", "distinct", "most_common", "echoes", "longest_echo", "trigrams", "repeated_lines", "line_words",
            "ended", "long_words")

_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CAPITAL = re.compile(r"(?<!\S)[^\W\d_a-z]").findall


def of_text(text: str) -> list[float]:
    """The features of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in text.split("\n") if x]
    same = list(map(eq, words, words[1:]))
    longest, at = 0, 0
    for hit in same:
        at = at + 1 if hit else 0
        longest = max(longest, at)
    counts = Counter(words)
    triples = max(1, len(words) - 2)
    return [np.log1p(len(text)), np.log1p(len(words)), len(text) / n, sum(map(str.isupper, words)) / n,
            sum(w[0].isupper() for w in words) / n, (size - len(raw.translate(None, b"0123456789"))) / size,
            (size - len(raw.translate(None, _MARKS))) / size, raw.count(b"!") / n, raw.count(b"|") / n,
            (size - len(raw.translate(None, b"#$%&*@^~<>{}[]_\\"))) / n, n / (1 + raw.count(b".")),
            len(counts) / n, max(counts.values(), default=0) / n, sum(same) / n, longest / n,
            len(set(zip(words, words[1:], words[2:], strict=False))) / triples, 1 - len(set(lines)) / max(1, len(lines)),
            n / max(1, len(lines)), sum(x.endswith((".", "!", "?")) for x in lines) / max(1, len(lines)),
            sum(len(w) > 14 for w in words) / n]


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All other columns of ``df`` and ``x``: array<double> of ``FEATURES``."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, "x")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "x array<double>"])
    names = [f.name for f in kept]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [of_text(t or "") for t in batch.column(len(names)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*names, "x"])

    return map_arrow(df.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text_col}`")), run, schema)


@dataclass
class Model:
    """Bin edges, one lookup table per feature and one per pair of features."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                          np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins, half way between neighbouring values around the quantiles."""
    cuts = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))
    distinct = np.unique(values)
    after = distinct[np.minimum(np.searchsorted(distinct, cuts, side="right"), len(distinct) - 1)]
    return np.unique((cuts + after)[after > cuts] / 2)


def _tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Leaf values, spread over the bins, of the best ``LEAVES``-leaf tree found greedily."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (grad, hess, rows))

    def gain(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + DAMPING)

    leaves = [(0, len(grad))]
    while len(leaves) < LEAVES:
        best = None
        for i, (a, b) in enumerate(leaves):
            cuts = np.arange(a + 1, b)
            cuts = cuts[(cn[cuts] - cn[a] >= MIN_LEAF) & (cn[b] - cn[cuts] >= MIN_LEAF)]
            if len(cuts):
                won = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(won.argmax())
                if best is None or won[k] > best[0]:
                    best = (won[k], i, int(cuts[k]))
        if best is None or best[0] <= 1e-9:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + DAMPING)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four quadrants."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (grad, hess))
    best, values = -1.0, np.zeros_like(grad)
    rows, cols = grad.shape

    def block(c, a, b, x, y):
        return c[b, y] - c[a, y] - c[b, x] + c[a, x]

    for i in range(1, rows):
        for j in range(1, cols):
            parts = [(a, b, x, y) for a, b in ((0, i), (i, rows)) for x, y in ((0, j), (j, cols))]
            won = sum(block(cg, *p) ** 2 / (block(ch, *p) + DAMPING) for p in parts)
            if won > best:
                best, values = won, np.zeros_like(grad)
                for a, b, x, y in parts:
                    values[a:b, x:y] = block(cg, a, b, x, y) / (block(ch, a, b, x, y) + DAMPING)
    return best, values


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the feature tables, then of the chosen pairs' tables."""
    prior = np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98)
    base = float(np.log(prior / (1 - prior)))
    k = x.shape[1]
    edges = [_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(k)]
    coarse = [_edges(x[:, j], GRID) if len(x) else np.zeros(0) for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables, coarse, [], [])
    if not len(x) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(x), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            if len(tables[j]) > 1:
                g, h = slopes()
                step = RATE * _tree(*(np.bincount(bins[j], w, len(tables[j])) for w in (g, h, np.ones(len(x)))))
                tables[j] += step
                total += step[bins[j]]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(a, b):
        g, h = slopes()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = cells[a] * shape[1] + cells[b]
        return [np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h)]

    usable = [j for j in range(k) if len(coarse[j])]
    gains = sorted(((_quadrants(*grid(a, b))[0], a, b) for a, b in combinations(usable, 2)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    model.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), own in zip(model.pairs, model.grids, strict=True):
            step = RATE * _quadrants(*grid(a, b))[1]
            own += step
            total += step[cells[a], cells[b]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model of ``labels`` (doc_id, quality) of documents that aren't held out."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(~held_out()).where("y in (0, 1)")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    # at most sample_rows rows of two numbers: bounded, so it may be broadcast
    rows = features(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    got = rows.orderBy(F.xxhash64("doc_id"), "y").limit(sample_rows).select("x", "y").collect()
    x = np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(FEATURES))
    return boost(x, np.array([r["y"] for r in got], dtype=float))


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``df`` and ``out``: the chance of label 1."""
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` double"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([of_text(t or "") for t in batch.column(names.index(text_col)).to_pylist()], dtype=float)
        own = model.score(x.reshape(-1, len(FEATURES)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*names, out])

    return map_arrow(df.select(*(F.col(f"`{n}`") for n in names)), run, schema)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: held_out, score, predicted."""
    model = model or fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that the classifier accepts, with their columns as they were, whatever their names."""
    model = model or fit(docs, labels)
    own = unused(docs, "_quality_score")
    return score(docs, model, out=own).where(F.col(own) >= ACCEPT).drop(own)
