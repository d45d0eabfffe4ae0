"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

from trafficscore.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH, PATTERN).rank,
                             special_tokens={})


def test_ids_equal_the_library_and_round_trip(documents, odd_texts, library):
    odd = [*odd_texts, "<|endoftext|>", "don't I'll we've", "a" * 3001, "ab" * 900 + " " + "ba" * 700]
    df = documents(list(enumerate(odd)))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    for i, text in enumerate(odd):
        assert got[i].ids == library.encode_ordinary(text or ""), repr(text)[:80]
        assert bytes(got[i].decoded) == (text or "").encode()
        assert got[i].source == "src0"


def test_query_over_the_whole_table(spark, read, library):
    got = {r.doc_id: r for r in queries.op6_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = read("documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_words_that_make_lower_ranks_and_blocks(monkeypatch, library):
    ranks = bpe.load_ranks(PATH, PATTERN)
    words = [bytes([a, b, c, d]) for a in b"ae " for b in range(0, 256, 5) for c in b"th\xc3" for d in b"en\xa9"]
    flat, sizes = bpe.replay(ranks, words)
    want = [ranks.long_word(w) if w not in ranks.rank else [ranks.rank[w]] for w in words]
    assert flat.tolist() == [t for w in want for t in w] and sizes.tolist() == [len(w) for w in want]
    monkeypatch.setattr(bpe, "STEP", 3)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 7)
    enc = bpe.Encoder(ranks)
    text = "Then the other one, heretofore unseen; then the 12345 'll others."
    assert enc.encode([text, None, text])[0].tolist() == library.encode_ordinary(text) * 2


def test_empty_table(documents):
    assert bpe.digests(documents([]), PATH, PATTERN).collect() == []


def test_repeated_rows_stay(documents):
    got = bpe.digests(documents([(1, "same"), (1, "same"), (None, "x")]), PATH, PATTERN).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 2), (False, 2), (True, 1)]
