"""Repeated substrings against a dictionary of all 50-byte windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficscore.llm import queries, suffixes
from trafficscore.llm.suffixes import LAST, MATCH


def plain_report(rows):
    first = {}
    raw = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for k in range(len(t) - MATCH + 1):
            w = t[k:k + MATCH]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - MATCH + 1):
            if first[t[k:k + MATCH]] < i:
                gone[k:k + MATCH] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out.append((LAST if i is None else i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(rows, got):
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in got) == plain_report(rows)


@pytest.mark.parametrize("shard", [suffixes.SHARD, 3000])
def test_query_over_the_whole_table(spark, read, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rows = [(r.doc_id, r.text) for r in read("documents").collect()]
    check(rows, queries.op7_suffixes(spark, "/root/testdata/sf0.001").collect())


@pytest.mark.parametrize("shard", [1 << 20, 200])
def test_small_alphabet_overlaps_and_edges(documents, odd_texts, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rng = random.Random(7)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = [(i, t) for i, t in enumerate(odd_texts)]
    for i in range(120):
        a = rng.randrange(0, 330)
        cut = base[a:a + rng.choice([49, 50, 51, 60, 120, 300])]
        rows.append((1000 - 3 * i, "".join(rng.choice("abé") for _ in range(rng.randrange(0, 40))) + cut
                     + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))))
    rows += [(5, "x" * 200), (6, "x" * 130), (2000, base), (2000, base), (None, base), (1, "é" * 25), (0, "é" * 30)]
    check(rows, suffixes.report(documents(rows)).collect())


def test_suffix_groups_and_common_prefixes():
    rng = np.random.default_rng(2)
    part = rng.integers(97, 99, 300).astype(np.uint8)
    buf = np.concatenate([part, rng.integers(97, 99, 500).astype(np.uint8), part[40:200], part])
    words, n = suffixes.words8(buf), len(buf)
    found, group = suffixes.suffix_groups(words, n)
    raw = buf.tobytes() + b"\0" * 64
    by = {}
    for i in range(n):
        by.setdefault(raw[i:i + MATCH], []).append(i)
    want = [g for _, g in sorted(by.items()) if len(g) > 1]
    cuts = np.flatnonzero(suffixes._heads(group))
    assert [g.tolist() for g in np.split(found, cuts[1:])] == want
    lcp = suffixes.common_prefixes(words, n, found, group)
    for k in range(1, len(found)):
        a, b = found[k - 1], found[k]
        true = next((x for x in range(n - max(a, b)) if buf[a + x] != buf[b + x]), n - max(a, b))
        assert lcp[k] == (true if group[k] == group[k - 1] else 0)


def test_only_suffixes_that_may_have_an_equal_are_sorted():
    rng = np.random.default_rng(4)
    part = rng.integers(97, 123, 400).astype(np.uint8)
    buf = np.concatenate([part, rng.integers(97, 123, 60_000).astype(np.uint8), part[100:300], part[:200]])
    words, n = suffixes.words8(buf), len(buf)
    raw, by = buf.tobytes(), {}
    for i in range(n - MATCH + 1):
        by.setdefault(raw[i:i + MATCH], []).append(i)
    want = sorted(i for group in by.values() if len(group) > 1 for i in group)
    found = suffixes._repeated(words, np.arange(n - MATCH + 1)).tolist()
    assert set(want) <= set(found) and len(found) < len(want) + 20
    places, _ = suffixes.suffix_groups(words, n, np.arange(n) + MATCH <= n)
    assert sorted(places.tolist()) == want
    assert not len(suffixes._repeated(words, np.zeros(0, dtype=np.int64)))


def test_rows_without_id_or_of_one_id_are_dealt_over_all_tasks(documents):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh") for _ in range(90))
    texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 90))) for _ in range(120)]
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, t + (passage if k % 4 < 2 else "")) for k, t in enumerate(texts)]
    df = documents(rows)
    dealt, _ = suffixes.repeated_spans(df)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(n for _, n in sizes) < 40
    check(rows, suffixes.report(df).collect())


def test_windows_of_zero_bytes_across_shards(documents):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdefgh") for _ in range(20)) + "\0" * (40 + k) + "z" * 20) for k in range(30)]
    check(rows, suffixes.report(documents(rows)).collect())


def test_all_places_of_a_document_with_the_same_surroundings(documents):
    """A passage that a text holds twice, or two texts of one doc_id once each, among the same neighbours;
    other texts have it among others."""
    rng = random.Random(5)

    def some(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    passage, rows = some(60), []
    for k in range(40):
        own = some(40) + passage + some(40)
        rows += [(k, own + some(20) + own)] if k % 2 else [(k, own + "1"), (k, own + "2")]
    check(rows, suffixes.report(documents(rows)).collect())


def test_empty(documents):
    assert suffixes.report(documents([])).collect() == []
    check([(1, None)], suffixes.report(documents([(1, None)])).collect())
