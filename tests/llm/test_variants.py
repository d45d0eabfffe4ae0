"""Spelling variants against plain edit comparison of all words."""

import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from trafficscore.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:]


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return counts


def plain(rows):
    words = {w: n for w, n in plain_counts(rows).items() if n >= 3 and len(w) >= 5}
    out, forms = {}, {}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    for w, n in words.items():
        near = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [forms[w], None, n, len(near), words[best] if forms[w] else None]
    for w in words:
        at = w
        while forms[at]:
            at = forms[at]
        out[w][1] = at
    return {w: tuple(r) for w, r in out.items()}


def check(df):
    got = variants.variants(df).collect()
    want = plain([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert len(got) == len(want)
    for r in got:
        assert (r.form, r.root, r.n, r.n_near, r.form_n) == want[r.word], r
    return got


def test_documents_table(read):
    got = check(read("documents"))
    assert any(r.form for r in got) and any(r.root != r.form for r in got if r.form)


def test_crowded_words_ties_and_odd_texts(documents, odd_texts):
    """Few letters, so that prefixes are shared by many; runs of equal letters; chains of forms."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randint(4, 8))) for _ in range(300)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "straße", "strasse", "strase", "Éclair", "éclair", "eclair"]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(150)]
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdzfyx", "abcwzfyx"]
    rows += [(1000 + i, " ".join([w] * 3 * 3 ** i)) for i, w in enumerate(chain)]
    rows += [*((2000 + i, t) for i, t in enumerate(odd_texts)), (0, rows[0][1]), (None, rows[1][1])]
    got = {r.word: r for r in check(documents(rows))}
    assert got["abcdefgh"].root == "abcwzfyx" and got["abcdefgh"].form == "abcdefgx"


def test_long_words_meet_by_hash(documents, monkeypatch):
    """Around the literal limit and far over it; the same with all prefixes hashed."""
    rng = random.Random(8)
    rows = []
    for size in (61, 62, 63, 64, 65, 66, 400):
        for _ in range(4):
            w = "".join(rng.choice("ab") for _ in range(size))
            at = rng.randrange(size)
            for own, n in ((w, 9), (w[:at] + "c" + w[at + 1:], 3), (w[:at] + w[at + 1:], 4), (w[:at] + "a" + w[at:], 3)):
                rows.append((len(rows), " ".join([own] * n)))
    got = check(documents(rows))
    assert sum(r.n_near for r in got) > 100
    giant = "x" * 30_000
    got = {len(r.word): r.n_near for r in variants.variants(documents([(i, giant) for i in range(3)] + [
        (i, giant + "y") for i in range(10, 13)])).collect()}
    assert got == {30_000: 1, 30_001: 1}
    pairs = {w: list(variants.rotations(w)) for w in ("abba", "aabb", "abb")}
    monkeypatch.setattr(variants, "LITERAL", 0)
    hashed = {w: list(variants.rotations(w)) for w in pairs}
    told = {}
    for w, own in pairs.items():
        for (a, k), (b, k2) in zip(own, hashed[w], strict=True):
            assert k == k2 and told.setdefault(a, b) == b
    assert len(set(told.values())) == len(told)


def test_flushing_counts_in_parts(documents, monkeypatch):
    rows = [(i, f"alpha beta{chr(97 + i % 20)} gamma") for i in range(100)]
    whole = {r.word: r.n for r in variants.word_counts(documents(rows)).collect()}
    assert whole == dict(plain_counts(rows))
    monkeypatch.setattr(variants, "WORDS_AT_ONCE", 3)
    assert {r.word: r.n for r in variants.word_counts(documents(rows)).collect()} == whole


def test_empty_and_clashing_columns(documents):
    assert variants.variants(documents([])).collect() == []
    assert variants.variants(documents([(1, None), (2, "")])).collect() == []
    df = documents([(i, "spelling spelling speling") for i in range(5)])
    df = df.withColumns({"word": F.lit(1), "n": F.lit("x"), "wid": F.lit(2.0), "root": F.lit(None), "form": F.lit(3)})
    check(df)
