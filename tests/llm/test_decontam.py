"""Decontamination against brute force, and the recall of the bit sampling."""

import random

import numpy as np

from trafficscore.llm import decontam, queries


def nearest(item, text):
    """Smallest edit distance of item to any passage of text: full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        old, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(old[j - 1] + (a != b), old[j] + 1, row[j - 1] + 1)
    return min(row)


def edit(words, n, rng):
    words = list(words)
    for _ in range(n):
        at, what = rng.randrange(len(words)), rng.random()
        if what < 0.34:
            words[at] = f"z{rng.randrange(10**6)}"
        elif what < 0.67:
            words.insert(at, f"y{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def test_search_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        edits, a, b = decontam.best_passage(item, text)
        assert edits == nearest(item, text)
        assert 0 <= a <= b <= len(text) and (a == b == 0 or nearest(text[a:b], item) <= edits)


def test_recall_at_the_largest_distance():
    rng = random.Random(2)
    names = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(names, k=rng.choice([16, 25, 40, 59])))) for i in range(200)]
    index = decontam.Index.of(rows, 0.8)
    hit = 0
    for i, t in rows:
        own = edit(t.split(), decontam.allowed(len(t.split())), rng)
        text = " ".join([*rng.choices(names, k=40), *own, *rng.choices(names, k=40)])
        hit += any(m["item_id"] == i for m in decontam.matches(text, index))
    assert hit >= 0.97 * len(rows)


def test_small_fixture_equals_brute_force(spark, documents, odd_texts):
    rng = random.Random(3)
    common = ["the", "of", "and", "to", "in"]
    items = [(i, " ".join(rng.choices(common + [f"v{k}" for k in range(40)], k=rng.choice([5, 9, 17, 30])))) for i in range(20)]
    items += [(50, ""), (51, None), (52, "single"), (0, "repeated item id with other words here")]
    rows = []
    for d in range(80):
        words = rng.choices(common + [f"v{k}" for k in range(40)], k=rng.randint(0, 60))
        if d % 2:
            own = items[d % 20][1].split()
            words += edit(own, rng.randint(0, decontam.allowed(len(own)) + 2), rng)
        rows.append((d, " ".join(words) + " Single!" * (d % 9 == 0)))
    rows += [(1000 + i, t) for i, t in enumerate(odd_texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(documents(rows), benchmark).collect()
    want = set()
    for d, t in rows:
        words = decontam.words_of(t)
        for i, x in items:
            own = decontam.words_of(x)
            if own and nearest(own, words) <= decontam.allowed(len(own)):
                want.add((d, i, nearest(own, words)))
    found = {(r.doc_id, r.item_id, r.edits) for r in got}
    assert found <= want and len(found) >= 0.99 * len(want)
    text = dict(rows)
    for r in got:
        passage, item = decontam.words_of(text[r.doc_id][r.start:r.end]), None
        item = min((decontam.words_of(x) for i, x in items if i == r.item_id), key=lambda w: nearest(w, passage))
        assert nearest(item, passage) == r.edits and r.similarity >= 0.8
    clean = decontam.keep_clean(documents(rows), benchmark)
    assert clean.columns == documents(rows).columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _, _ in found}


def test_blocks_give_the_same(spark, documents):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i}") for i in range(7)], "item_id long, text string")
    rows = [(i, f"x alpha{i} beta{i} gamma{i} delta{i} eps{i} y") for i in range(9)]
    one = decontam.contaminated(documents(rows), items).collect()
    assert sorted(r.item_id for r in one) == list(range(7))
    parts = list(decontam.blocks(items, size=3))
    assert sorted(i for p in parts for i in p.ids) == list(range(7)) and len(parts) == 3


def test_query_finds_all_plain_copies(spark, read):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontam(spark, sf).collect()}
    items = read("benchmark", sf).collect()
    want = {(d.doc_id, i.item_id) for d in read("documents", sf).collect() for i in items if i.text in d.text}
    assert want and want <= got
    assert len(got) < 1.3 * len(want)


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(documents([(1, "a b")]), none).collect() == []
    assert decontam.contaminated(documents([]), none).collect() == []
    assert decontam.keep_clean(documents([(1, "a b")]), none).count() == 1


def test_embedding_brings_near_sequences_close():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 10**6, size=(50, 40))
    b = a.copy()
    b[:, 20] += 10**6
    near = (decontam.embed(a) == decontam.embed(b)).mean()
    far = (decontam.embed(a) == decontam.embed(rng.integers(0, 10**6, size=(50, 40)))).mean()
    assert near > 0.6 and far < 0.35
