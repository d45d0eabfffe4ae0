"""Ranked lexical search, reversed: documents stream through an index of the queries.

The items (queries) are few and their index is broadcast; the documents are many
and are read twice, never shuffled.

1. Statistics.  Over all documents: N (those with a term), L (their terms), and
   per term of the items df (documents that hold it); each task adds up its own
   before anything is shuffled.
2. Scores.  Each document's counts of the items' terms run through the inverted
   index (term -> items and how often they hold it).  Weights are floored
   thousandths of log odds; the rest is whole numbers, so scores don't depend on order.
3. Heaps.  A task keeps the best ``TOP`` documents of each item, and passes over
   documents below the worst of them.  The tasks' heaps are merged in two
   steps, by ``MERGES`` hashes of the document and then by item, each cut down
   before its shuffle, so an item's heaps don't meet in one task before they are few.

Items are taken in blocks of at most ``BLOCK_BYTES`` of text (or one run of
``STEP`` items, if that is longer), so what is broadcast is bounded whatever
the number of items.

Terms are runs of digits, ASCII letters and all code points from U+0080 on, only A-Z lowered.
Null and empty texts, of documents or items, have no terms: they count nowhere
and get no rows.  Each row is a document or item of its own, also if ids repeat
(then ranks are per row); rows of equal score rank by doc_id, null ids last.
Long texts are counted in pieces.  Only the id and text columns are read, so
other columns may have any names.  Empty tables: empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficscore.llm.common import CHUNK_BYTES, _pieces, cut, number_rows

TOP = 10
SLOPE = 75                 # hundredths of a document's length that count
BLOCK_BYTES = 8 << 20      # item text of a broadcast index
STEP = 16                  # items that stand in one block whatever their size
MERGES = 64                # parts of the first merge
CELLS = 1 << 20            # scores (documents x items), and postings met, that a task holds at a time
PIECE = 1 << 20

# every byte outside terms becomes a blank, A-Z become a-z
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    clean = (text.encode() if isinstance(text, str) else text or b"").translate(_BYTES)
    at = 0
    while at < len(clean):
        end = min(at + PIECE, len(clean))
        if end < len(clean):
            space = clean.find(b" ", end)
            end = len(clean) if space < 0 else space
        yield clean[at:end].split()
        at = end


@dataclass
class Index:
    """Inverted index of a block of items."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    first: np.ndarray        # per term: where its postings start
    items: np.ndarray        # postings: item and how often it holds the term
    times: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, str]]) -> Index:
        vocabulary: dict[bytes, int] = {}
        postings: list[tuple[int, int, int]] = []
        for k, (_, text) in enumerate(rows):
            counts: Counter = Counter()
            for words in terms_of(text):
                counts.update(words)
            postings += [(vocabulary.setdefault(w, len(vocabulary)), k, n) for w, n in counts.items()]
        postings.sort()
        table = np.array(postings, dtype=np.int64).reshape(-1, 3)
        first = np.searchsorted(table[:, 0], np.arange(len(vocabulary) + 1))
        return Index([i for i, _ in rows], vocabulary, first, table[:, 1], table[:, 2])

    def counts(self, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
        """Terms of a text with repeats, the index's terms in it and how often each stands there."""
        n, found, get = 0, [], self.vocabulary.get
        for words in terms_of(text):
            n += len(words)
            ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            found.append(ids[ids >= 0])
        terms, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return n, terms, tf


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of all items with a text, block by block."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t <> ''")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if total <= size:
        parts = [rows] if total else []
    else:
        rows = cut(number_rows(rows.withColumn("key", F.xxhash64("id", "t")), [], "key", "place"))
        run = F.floor(F.col("place") / STEP)
        sizes = sorted((r["run"], r["b"]) for r in rows.groupBy(run.alias("run")).agg(
            F.sum(F.octet_length("t")).alias("b")).collect())
        cuts, held = [0], 0
        for k, own in sizes:
            if held and held + own > size:
                cuts.append(k)
                held = 0
            held += own
        cuts.append(sizes[-1][0] + 1)
        parts = [rows.where(F.col("place").between(a * STEP, b * STEP - 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for part in parts:
        yield Index.of(sorted(((r["id"], r["t"]) for r in part.select("id", "t").collect()),
                              key=lambda r: (r[0] is None, r)))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(1).cast(pa.binary()).to_pylist()


def statistics(docs: DataFrame, index: Index) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each of the index's terms."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    n_terms = len(index.vocabulary)

    def run(batches):
        own = sent.value
        df, n_docs, n_all = np.zeros(n_terms, dtype=np.int64), 0, 0
        for piece in _pieces(batches, CHUNK_BYTES):
            for text in _texts(piece):
                n, terms, _ = own.counts(text)
                df[terms] += 1
                n_docs += n > 0
                n_all += n
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [n_docs, n_all]))],
                                         names=["term", "n"])

    # one row a term of the block, and two: as bounded as the block
    rows = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    df = np.zeros(n_terms, dtype=np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-1, 0), found.get(-2, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class Heaps:
    """The best documents of each item: (item, score, doc) rows, at most ``top`` an item."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.unknown = np.zeros(0, dtype=bool)               # rows whose doc is null
        self.worst = np.zeros(n_items, dtype=np.int64)       # scores below it can't enter

    def update(self, scores: np.ndarray, docs: np.ndarray, unknown: np.ndarray) -> None:
        """``scores``: (documents, items); ``docs``: their ids, ``unknown`` where those are null."""
        row, item = np.nonzero((scores > 0) & (scores >= self.worst))
        if not len(row):
            return
        score = np.concatenate([self.score, scores[row, item]])
        item = np.concatenate([self.item, item])
        doc = np.concatenate([self.doc, docs[row]])
        null = np.concatenate([self.unknown, unknown[row]])
        order = np.lexsort((doc, null, -score, item))        # nulls last among equal scores
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
        keep = rank < self.top
        order = order[keep]
        self.item, self.score, self.doc, self.unknown = item[keep], score[order], doc[order], null[order]
        last = rank[keep] == self.top - 1
        self.worst[self.item[last]] = self.score[last]


def _scores(index: Index, weight: np.ndarray, n_docs: int, n_all: int, counted: list) -> np.ndarray:
    """(documents, items) scores of documents given as (n, terms, tf)."""
    sizes = [len(t) for _, t, _ in counted]
    doc = np.repeat(np.arange(len(counted)), sizes)
    terms = np.concatenate([t for _, t, _ in counted])
    tf = np.concatenate([f for _, _, f in counted])
    # whole numbers of any size: 75 * n * N may pass 64 bits
    m = np.array([100 - SLOPE + SLOPE * n * n_docs // n_all if n else 0 for n, _, _ in counted], dtype=np.int64)
    value = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
    width = index.first[terms + 1] - index.first[terms]
    entry = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(index.first[terms], width)
    out = np.zeros((len(counted), len(index.ids)), dtype=np.int64)
    np.add.at(out.reshape(-1), np.repeat(doc, width) * len(index.ids) + index.items[entry],
              np.repeat(value, width) * index.times[entry])
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, doc, score long): the ``top`` documents of each item with a score above 0."""
    docs = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType.simpleString()
    found = None
    for index in blocks(items, item_col, item_text_col, block_bytes):
        own = _best(docs, index, top, kind)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.limit(0).select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id",
                                     F.lit(0).cast("long").alias("score"))
    return found.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(doc_col), "score")


def _best(docs: DataFrame, index: Index, top: int, kind: str) -> DataFrame:
    n_docs, n_all, df = statistics(docs, index)
    weight = weights(n_docs, df)
    sent = docs.sparkSession.sparkContext.broadcast((index, weight))

    def run(batches):
        own, weight = sent.value
        heaps = Heaps(len(own.ids), top)
        for piece in _pieces(batches, CHUNK_BYTES):
            ids = piece.column(0)
            docs, unknown = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            counted, met, first = [], 0, 0
            for text in _texts(piece):
                counted.append(own.counts(text))
                terms = counted[-1][1]
                met += int((own.first[terms + 1] - own.first[terms]).sum()) + len(own.ids)
                if met > CELLS:
                    to = first + len(counted)
                    heaps.update(_scores(own, weight, n_docs, n_all, counted), docs[first:to], unknown[first:to])
                    counted, met, first = [], 0, to
            if counted:
                heaps.update(_scores(own, weight, n_docs, n_all, counted), docs[first:], unknown[first:])
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item), pa.array(heaps.doc, mask=heaps.unknown),
                                          pa.array(heaps.score)], names=["item", "doc_id", "score"])

    best = docs.mapInArrow(run, "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGES))
    for by in (["item", part], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    # one row an item of the block
    names = docs.sparkSession.createDataFrame(list(enumerate(index.ids)), f"item long, item_id {kind}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
