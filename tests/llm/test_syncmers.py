"""Closed-syncmer fingerprints against a plain computation."""

import hashlib
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from trafficscore.llm import syncmers


def chain(*codes):
    seed = 42
    for c in codes:
        seed = xxhash.xxh64_intdigest((c % (1 << 64)).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_marks(text):
    codes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not codes:
        return []
    codes = [0] * 4 + codes + [0] * 4
    s = [signed(chain(a, b)) for a, b in zip(codes, codes[1:], strict=False)]
    return [(signed(chain(s[i], s[i + 2], s[i + 3])) % (1 << 48), i - 4) for i in range(len(s) - 3)
            if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]


def plain_print(marks):
    return ",".join(f"{h:012x}:{p}" for h, p in marks)


def plain_likeness(a, b):
    def links(marks):
        own = [(h, g, q - p) for (h, p), (g, q) in zip(marks, marks[1:], strict=False)]
        return Counter(own + [marks[-1][:1]] if marks else [])

    a, b = links(a), links(b)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0], r[1]), reverse=True)
    want = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        a, b, c = plain_marks(text), plain_marks(edited), plain_marks(after)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_print(a), plain_print(b),
                     round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                   round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_documents_table(read):
    docs = read("documents")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = syncmers.edited_fingerprints(docs).collect()
    check(rows, got)
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.45
    assert sum(r.near_next for r in long) / len(long) < 0.05


def test_odd_texts(documents, odd_texts):
    rows = [(7 * i, t) for i, t in enumerate(odd_texts)]
    check([(i, t or "") for i, t in rows], syncmers.edited_fingerprints(documents(rows)).collect())


def test_repeated_ids_and_single_rows(documents):
    rows = [(4, "b b b c d e"), (4, "a x y z"), (4, "a x y z"), (2, "q r s"), (9, "zz top of the world")]
    check(rows, syncmers.edited_fingerprints(documents(rows)).collect())
    check(rows[:1], syncmers.edited_fingerprints(documents(rows[:1])).collect())
    assert len(syncmers.edited_fingerprints(documents([*rows, (None, None)])).collect()) == 6
    assert syncmers.edited_fingerprints(documents([])).collect() == []


def test_no_python_on_the_way(documents):
    plan = syncmers.edited_fingerprints(documents([(1, "a b"), (2, "c d")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_moved_passage_keeps_its_anchors(documents):
    body = " ".join(f"w{i}" for i in range(60))
    df = documents([(1, body), (2, "some other head " + body)]).select(
        "doc_id", syncmers.anchors(F.col("text")).alias("a"))
    a, b = ({x.hash: x.pos for x in r.a if 0 <= x.pos} for r in df.orderBy("doc_id").collect())
    inner = {h: p for h, p in a.items() if 4 <= p <= 55}
    assert inner and all(b[h] == p + 3 for h, p in inner.items())


def test_one_passage_of_a_long_text_shows(documents):
    long = [f"w{i * 7919 % 20011}" for i in range(20_000)]
    other = long[:10_000] + [f"v{i}" for i in range(50)] + long[10_050:]
    first, last = syncmers.edited_fingerprints(documents([(1, " ".join(long)), (2, " ".join(other))])).orderBy("doc_id").collect()
    assert first.fingerprint != last.fingerprint and 0.98 < first.near_next < 1.0 and first.near_next == last.near_next
    assert first.fingerprint.count(":") > 9_000
    assert set(x[:12] for x in first.fingerprint.split(",")) - set(x[:12] for x in last.fingerprint.split(","))


def test_repeats_and_order_count(documents):
    rows = [(4, "a b c d e f g h " * 40), (3, "a b c d e f g h " * 20), (2, "t u v w x y z " * 9), (1, "z y x w v u t " * 9)]
    got = {r.doc_id: r.near_next for r in syncmers.edited_fingerprints(documents(rows)).collect()}
    assert 0.4 < got[4] < 0.6 and got[3] == 0 and got[2] < 0.2


def test_ranges_are_dealt_evenly(spark, documents):
    df = documents([(i, f"text of document number {i}") for i in range(800)])
    sizes = [r["n"] for r in syncmers.with_next(df.select("doc_id", "text")).groupBy(F.spark_partition_id())
             .agg(F.count(F.lit(1)).alias("n")).collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 800 and max(sizes) <= 3 * 800 / parts
