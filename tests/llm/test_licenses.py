"""Licence scan: matching statistics, phrase places and chains against plain searches."""

import random
import re

from trafficscore.llm import licenses
from trafficscore.llm.license_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_base(text):
    words = plain_words(text)
    places = [(i, label) for label, phrase in PHRASES for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def check_base(df):
    got = licenses.report(df).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append(plain_base(r.text))
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in want[r.doc_id], r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.base_labels)
    return got


def test_base_of_documents(read):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert sum(r.n_base for r in check_base(read("documents", sf))) > 0


def test_odd_texts_and_repeats(documents, odd_texts):
    extra = ["cc by cc by", "CC-BY", "ccby", "All  rights\nreserved; all rights reserved", "General Public\x00License",
             "generalé public license", "cc cc by", "ALL RIGHTS RESERVED" * 2, "all rights all rights reserved"]
    rows = [*enumerate(odd_texts + extra), (0, None), (len(odd_texts), extra[0]), (None, extra[0])]
    check_base(documents(rows))
    assert licenses.report(documents([])).collect() == [] == licenses.spans(documents([])).collect()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "all rights reserved", "x", 2, "y")], "doc_id long, text string, labels string, score int, template string")
    assert [(r.doc_id, r.base_labels) for r in licenses.report(df).collect()] == [(1, "reserved")]
    named = df.select(df.doc_id.alias("label"), df.text.alias("start"))
    assert [r["label"] for r in licenses.report(named, "start", "label").collect()] == [1]


def test_statistics_equal_longest_suffixes():
    rng = random.Random(3)
    for _ in range(30):
        words = "abc"
        templates = [("t", " ".join(rng.choice(words) for _ in range(rng.randint(4, 12)))) for _ in range(4)]
        scan = licenses.Scanner.of(templates, (("p", "a b"),))
        texts = [t.split() for _, t in templates] + [["a", "b"]]
        subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        file = [rng.choice("abcd") for _ in range(80)]
        got = {i: length for i, _, length in scan.statistics(scan.tokens(" ".join(file).encode()))}
        for i in range(len(file)):
            want = max((n for n in range(i + 2) if n == 0 or tuple(file[i + 1 - n:i + 1]) in subs), default=0)
            assert got.get(i, 0) == (want if want > 1 else 0)


def test_matches_equal_all_maximal_matches():
    """With the chain rule off, a template's matches are all its maximal common runs that end where it says."""
    rng = random.Random(9)
    for _ in range(30):
        templates = [("t", " ".join(rng.choice("abcd") for _ in range(10))) for _ in range(3)]
        scan = licenses.Scanner.of(templates, ())
        file = [rng.choice("abcd") for _ in range(60)]
        seen = {}
        scan.chains = lambda t, own: seen.setdefault(t, own) and []
        scan.scan(" ".join(file))
        for t, (_, text) in enumerate(templates):
            own, want = text.split(), set()
            for i in range(len(file)):
                for p in range(len(own)):
                    n = 0
                    while n <= min(i, p) and file[i - n] == own[p - n]:
                        n += 1
                    ends = i + 1 == len(file) or p + 1 == len(own) or file[i + 1] != own[p + 1]
                    if n >= scan.need[t] and ends:
                        want.add((i + 1, p + 1, n))
            assert set(seen.get(t, ())) == want


def edited(words, every, rng):
    return [w if i % every else rng.choice(["foo", "bar"]) for i, w in enumerate(words)]


def test_spans_of_whole_and_edited_templates(documents):
    """Each template is found by itself, also with every fifteenth word replaced, at the right place."""
    rng = random.Random(1)
    filler = [f"w{i}" for i in range(40)]
    rows, want = [], {}
    for k, (label, text) in enumerate(TEMPLATES):
        words = licenses.words_of(text)
        for j, body in enumerate((words, edited([w.decode() for w in words], 15, rng)) if len(words) > 30 else (words,)):
            body = [w.decode() if isinstance(w, bytes) else w for w in body]
            rows.append((10 * k + j, " ".join([*filler, *body, *filler])))
            want[10 * k + j] = label
    got = {}
    for r in licenses.spans(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, label in want.items():
        text = dict(rows)[i]
        assert [r.label for r in got[i]] == [label], (i, label, got.get(i))
        r = got[i][0]
        inside = text[r.start:r.end].split()
        assert r.similarity >= licenses.SIMILARITY and abs(len(inside) - licenses.scanner().sizes[r.template]) <= 8


def test_repeated_templates_and_clean_texts(documents):
    mit = TEMPLATES[2][1]
    rows = [(1, f"{mit}\n" * 300), (2, "the software is to be used by the authors, in no event by the holders"),
            (3, "Permission is hereby granted")]
    got = licenses.report(documents(rows)).collect()
    assert {r.doc_id: (r.labels, r.n_spans) for r in got} == {1: ("mit", 300), 2: ("", 0), 3: ("", 0)}


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["cc", "by", "all", "rights", "reserved", "é", "zz"]) for _ in range(5000))
    whole = licenses.Scanner.of().scan(text)
    monkeypatch.setattr(licenses, "PIECE", 97)
    parts = licenses.Scanner.of().scan(text)
    assert (whole.words, whole.places, whole.spans) == (parts.words, parts.places, parts.spans)
