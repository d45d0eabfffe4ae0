"""Ranked lexical search against a plain ranking of all documents."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from trafficscore.llm import lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, top=10):
    """{row of items: [(rank, doc_id, score)]}"""
    texts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_all = sum(n > 0 for *_, n in texts), sum(n for *_, n in texts)
    df = Counter(w for _, c, _ in texts for w in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts, n in texts:
            if not n:
                continue
            m = 100 - 75 + (75 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * (1000000000 * counts[w] // (1000 * counts[w] + 8 * m)) for w in terms(text) if counts[w])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def check(docs, items, **kw):
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()],
                 [(r.item_id, r.text) for r in items.select("item_id", "text").collect()])
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, **kw).collect()), key=str)
    assert got == want
    return got


def test_tables(read):
    assert check(read("documents"), read("benchmark"))


def test_blocks_and_small_tasks(read, monkeypatch):
    """Many blocks of items, few scores held at a time, short pieces: the same result."""
    monkeypatch.setattr(lexical, "CELLS", 50)
    monkeypatch.setattr(lexical, "PIECE", 61)
    docs, items = read("documents").limit(60), read("benchmark")
    assert len(list(lexical.blocks(items, size=2_000))) > 2
    check(docs, items, block_bytes=2_000)


def test_ties_repeats_nulls_and_odd_texts(spark, documents, odd_texts):
    rng = random.Random(6)
    rows = [*enumerate(odd_texts), *((100 + i, " ".join(rng.choices("a b c d e the ÉX éx".split(), k=6))) for i in range(40))]
    rows += [(500 + i, "same text here") for i in range(30)] + [(500, "same text here"), (None, "same text here"), (7, "a b c")]
    items = spark.createDataFrame([(1, "same text"), (2, None), (3, ""), (4, "a a a b THE"), (4, "a b"), (None, "c d"), (5, "nowhere"),
                                   (6, "éX ÉX 😀😀"), (7, "..,")], "item_id long, text string")
    got = check(documents(rows), items)
    assert [d for i, _, d, _ in sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1])) if i == 1][:3] == [500, 500, 501]


def test_empty_and_clashing_columns(spark, documents):
    items = spark.createDataFrame([(1, "a b", 5, "x")], "item_id long, text string, rank int, score string")
    none = items.where("false")
    assert check(documents([]), items) == [] == check(documents([(1, "a")]), none)
    docs = documents([(1, "a b"), (2, "b"), (3, "c")]).withColumns({"rank": F.lit(0), "item": F.lit(9), "score": F.lit("s"), "item_id": F.lit(1)})
    assert len(check(docs, items)) == 2
