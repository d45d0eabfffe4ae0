"""Spelling variants by permuterm rotations.

``word_counts``: words of whole texts (runs of ASCII letters and U+00C0 to
U+00FF, only A-Z lowered), one code point less in the rows and runs that
``slip`` picks, and how often each occurs.  Tasks count their own words before
anything is shuffled, so a word that is a third of all rows costs one row per task.

``near``: two words are near if one inserted, deleted or replaced code point
turns one into the other.  Each word is marked by ``$`` and rotated:

* the rotation that starts behind a character ends with it; without its last
  character it is a *prefix* ``after $ before``.  Words that share it differ in
  that character alone (replaced);
* a whole rotation that equals such a prefix belongs to a word that lacks the
  character (deleted; seen from there, inserted).

Rotations are sorted by prefix and each prefix's group is scanned: members hold
different characters in one place, so a group has at most as many members as the
alphabet has letters, and one more.  Each member hears of the others by counts
and by the two best of the group; no pairs are made.  A deletion from a run of
equal characters shows up in several groups and is counted in the run's first place only.

A word's ``form`` is its near word of largest count (ties: smallest in code-point
order) if that has at least ``RATIO`` times the word's own; counts double along
forms, so there are no cycles, and ``root`` (the last of them) is found by
pointer jumping in a number of rounds that grows with the logarithm of the chain.

Words are known by numbers in code-point order.  Prefixes over ``LITERAL``
characters are told by a 127-bit polynomial hash (computed from prefix sums, so
that a word of a million characters costs a million short rows, not their
square); shorter ones are compared as they are.

Null texts have no words.  A null id counts as an empty one in ``slip``.
Repeated rows count as often as they stand.  Only the id and text columns are
read, so other columns may have any names.  Empty table: empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import cut

SLIP = 97            # one in so many (document, run) loses a code point
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
LITERAL = 64         # characters of a prefix that is compared as it is
WORDS_AT_ONCE = 200_000   # distinct words that a task counts before it passes them on
ROWS_AT_ONCE = 50_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_PRIME = (1 << 127) - 1
_BASE = 0x1F3D5B79A8C6E4F20B1D3F5A7C9E8B61


def slip(doc_id: int | None, run: str) -> str:
    """``run`` as it counts in that document."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): all words of all texts, whatever their length and count."""

    def batches_of(counts: Counter):
        words = list(counts)
        for at in range(0, len(words), ROWS_AT_ONCE):
            part = words[at:at + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[w] for w in part], pa.int64())],
                                             names=["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                if not text:
                    continue
                doc_id = batch.column(0)[at].as_py()
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():   # bytes: only A-Z change
                    total[slip(doc_id, word)] += n
                if len(total) > WORDS_AT_ONCE:
                    yield from batches_of(total)
                    total = Counter()
        yield from batches_of(total)

    counted = docs.select(id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''")


def rotations(word: str):
    """(prefix, kind) of each rotation: kind 0 whole rotations, 1 and 2 those
    that end with the skipped character (2: it repeats the one before)."""
    size = len(word)
    around = f"{word}${word}"
    if size + 1 <= LITERAL:
        for i in range(size + 1):
            yield around[i:i + size + 1], 0
        for i in range(size):
            yield around[i + 1:i + 1 + size], 2 if i and word[i] == word[i - 1] else 1
        return
    sums, h = [0], 0
    for c in around:
        h = (h * _BASE + ord(c)) % _PRIME
        sums.append(h)

    def part(a: int, width: int, power: int) -> str:
        if width <= LITERAL:
            return around[a:a + width]
        return f"#{width}:{(sums[a + width] - sums[a] * power) % _PRIME:x}"

    power = pow(_BASE, size + 1, _PRIME)
    for i in range(size + 1):
        yield part(i, size + 1, power), 0
    power = pow(_BASE, size, _PRIME)
    for i in range(size):
        yield part(i + 1, size, power), 2 if i and word[i] == word[i - 1] else 1


def permuterm(words: DataFrame) -> DataFrame:
    """(prefix, kind, wid, n) of all rotations of ``words`` (wid, word, n)."""

    def run(batches):
        for batch in batches:
            prefix, kind, wid, n = [], [], [], []
            for i, word, count in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for own, k in rotations(word):
                    prefix.append(own)
                    kind.append(k)
                    wid.append(i)
                    n.append(count)
                    if len(prefix) >= ROWS_AT_ONCE:
                        yield _batch(prefix, kind, wid, n)
                        prefix, kind, wid, n = [], [], [], []
            yield _batch(prefix, kind, wid, n)

    return words.select("wid", "word", "n").mapInArrow(run, "prefix string, kind byte, wid long, n long")


def _batch(prefix, kind, wid, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(prefix, pa.string()), pa.array(kind, pa.int8()), pa.array(wid, pa.int64()),
                                       pa.array(n, pa.int64())], names=["prefix", "kind", "wid", "n"])


def near(words: DataFrame) -> DataFrame:
    """(wid, n_near, best_n, best): per word of ``words`` (wid, word, n) with a
    near word their number, and the one of largest n, then smallest wid."""
    member = F.struct("n", (-F.col("wid")).alias("w"), "kind")
    groups = (permuterm(words).groupBy("prefix")
              .agg(F.sort_array(F.collect_list(member), asc=False).alias("members"))
              .where(F.size("members") > 1))
    # at most one whole rotation; of the rest, those that count beside it
    skipped = F.size(F.filter("members", lambda m: m["kind"] > 0))
    first = F.size(F.filter("members", lambda m: m["kind"] == 1))
    groups = groups.select("members", skipped.alias("skipped"), first.alias("first"))

    def heard(m):
        others = F.when(m["kind"] == 0, F.col("first")).otherwise(
            F.col("skipped") - 1 + F.when(m["kind"] == 1, F.size("members") - F.col("skipped")).otherwise(0))
        top, second = F.col("members")[0], F.col("members")[1]
        best = F.when(m["w"] == top["w"], second).otherwise(top)
        return F.struct((-m["w"]).alias("wid"), others.cast("long").alias("others"),
                        F.struct(best["n"].alias("n"), best["w"].alias("w")).alias("best"))

    return (groups.select(F.inline(F.transform("members", heard)))
            .groupBy("wid").agg(F.sum("others").alias("n_near"), F.max("best").alias("best"))
            .select("wid", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.w")).alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root): the last word of each chain of ``forms`` (wid, form), by pointer jumping."""
    at = cut(forms.select("wid", F.col("form").alias("root"), F.lit(False).alias("ended")))
    while True:
        onward = at.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        at = cut(at.where("not ended").join(onward, "root", "left")
                 .select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("ended"))
                 .unionByName(at.where("ended")))
        if at.where("not ended").isEmpty():
            return at.select("wid", "root")


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least
    ``min_length`` code points and ``min_count`` occurrences."""
    counted = word_counts(docs, text_col, id_col).where((F.length("word") >= min_length) & (F.col("n") >= min_count))
    # numbers that rise along the sorted partitions: code-point order
    words = cut(counted.orderBy("word").withColumn("wid", F.monotonically_increasing_id()))
    told = cut(words.join(near(words), "wid", "left")
               .withColumn("form_id", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))))
    changed = told.where("form_id is not null").select("wid", "form_id")
    last = roots(changed.select("wid", F.col("form_id").alias("form"))).withColumnRenamed("root", "root_id")
    form = words.select(F.col("wid").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = words.select(F.col("wid").alias("root_id"), F.col("word").alias("root"))
    # words without a form have no part in these joins, so no null key is dealt to one task
    named = changed.join(form, "form_id").join(last, "wid").join(root, "root_id").select("wid", "form", "form_n", "root")
    return (told.join(named, "wid", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
