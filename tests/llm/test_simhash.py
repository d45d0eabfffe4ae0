"""SimHash near-duplicates against an all-pairs brute force."""

import re

import xxhash

from trafficscore.llm import simhash
from trafficscore.llm.common import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits):
    """{id: smallest id reachable} by flood fill over all pairs of different fingerprints."""
    ids = {}
    for i, f in fps:
        ids.setdefault(f, []).append(i)
    todo, out = set(ids), {}
    while todo:
        seen = frontier = {todo.pop()}
        while frontier:
            frontier = {g for g in todo for f in frontier if (f ^ g).bit_count() <= max_bits}
            todo -= frontier
            seen = seen | frontier
        least = min(i for f in seen for i in ids[f])
        out |= {i: least for f in seen for i in ids[f]}
    return out


def check(rows, got):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    want = plain_components(fps, 2)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == \
        sorted((i, f"{f:016x}", want[i]) for i, f in fps)


def test_documents_table(read, spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = read("documents", sf)
        check([(r.doc_id, r.text) for r in docs.collect()], simhash.near_duplicates(docs).collect())


def test_odd_texts_ties_and_repeats(documents, odd_texts):
    rows = [*enumerate(odd_texts), (0, None), (3, "\n\n"), (900, "The A b C"), (901, "the a B c")]
    check(rows, simhash.near_duplicates(documents(rows)).collect())


def test_links_of_long_lists_equal_brute_force(spark):
    """Crowded fingerprints, so that lists overflow; chains and a ring of two-bit steps."""
    base = 0x0123456789ABCDEF
    fps = {base}
    for i in range(64):
        fps |= {base ^ (1 << i), base ^ (3 << i) & (2**64 - 1)}
    step = 0xFEDCBA9876543210
    for i in range(0, 62, 2):
        step ^= 3 << i
        fps.add(step)
    for i in range(64):
        for j in range(i):
            if (i * j) % 7 == 0:
                fps.add(base ^ (1 << i) ^ (1 << j) ^ (1 << (i + j) % 64))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "fp long, rep long")
    want = plain_components([(i, f % (1 << 64)) for f, i in rows], 2)
    for list_max in (2, 8, 10_000):
        found = {r.node: r.component for r in components(simhash.linked(df, 2, list_max)).collect()}
        assert {i: found.get(i, i) for _, i in rows} == want, list_max


def test_keep_one(documents):
    rows = [(5, "one two three four"), (3, "one two three four"), (3, "one two three four"), (8, "other words here now"),
            (None, "x"), (9, None), (10, "")]
    got = simhash.keep_one(documents(rows))
    assert got.columns == documents(rows).columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 3, 8, 9]


def test_keep_one_loses_no_text_of_a_repeated_id(documents):
    """(7, A), (7, B), (9, B): A and B each keep one row; equal rows keep one."""
    a, b = "alpha beta gamma delta", "one two three four five"
    rows = [(7, a), (7, b), (9, b), (9, b), (11, a), (7, None), (7, "")]
    got = sorted((r.doc_id, r.text or "") for r in simhash.keep_one(documents(rows)).collect())
    assert got == [(7, ""), (7, a), (7, b)]


def test_keep_one_with_clashing_names(documents):
    from pyspark.sql import functions as F
    df = documents([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x y z w")])
    names = ["_digest", "_kept_id", "_kept_digest", "key", "fp", "rep", "node", "component", "digest", "id"]
    df = df.withColumns({c: F.lit(c) for c in names})
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert all(r[c] == c for r in got.collect() for c in names)


def test_components_of_a_long_chain(spark):
    n = 300
    df = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    assert {(r.node, r.component) for r in components(df).collect()} == {(i, 0) for i in range(n)}


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
