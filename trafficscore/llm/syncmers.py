"""Document fingerprints from closed syncmers, in DataFrame functions only.

Symbols are words (runs of other than ASCII white space), padded by ``K - 1``
empty symbols on both sides, so that texts of a single word have anchors too.
An s-mer is ``S`` = 2 consecutive symbols, hashed with XXH64.  A k-mer of
``K`` = 5 symbols has four inner s-mers; it is a closed syncmer if the smallest
of their hashes stands first or last.  Whether a k-mer is chosen depends on
the k-mer alone, so an unchanged passage keeps its anchors wherever it moves.

A text's fingerprint is the list of all its anchors, written as
``hash:position`` in text order, the position in symbols.  ``likeness`` of two
fingerprints chains shared anchors by position: an anchor counts with the one
after it and the distance between them (its link; the last counts alone), so
a link is shared where both texts hold two successive anchors equally far
apart, wherever that passage stands.  The likeness is the links that both hold
over those that either holds, repeats included: 1 for equal texts, 1 for two
texts without words, 0 if just one has words.

``edited_fingerprints`` needs each document's successor in descending doc_id
(after the last: the first).  Documents are dealt into ranges of doc_id by
approximate quantiles, one range a task, and a window looks ahead inside a
range; the first rows of each range also go, as guests, to the end of the
range before.  So whole texts are shuffled once (anchors are found behind the
shuffle), and no task sees more than its range.

Null text counts as empty (fingerprint "").  Rows that repeat a doc_id follow
each other in descending order of the text; null doc_ids come last.  A table
of one document is its own successor.  Empty table: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficscore.llm.common import partitions

K, S = 5, 2
HEX = 12                # hex digits of an anchor's hash that are kept
SPACES = "[ \\t-\\r]+"


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def anchors(text: Column) -> Column:
    """array<struct<hash: long, pos: int>> of all closed syncmers of a text."""
    pad = F.array_repeat(F.lit(0).cast("bigint"), K - 1)

    def smers(codes: Column) -> Column:
        # rolled once over neighbours; a missing neighbour at the end is null and cut off
        return F.zip_with(codes, F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.xxhash64(a, b))

    def chosen(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(s) - K)        # size(s) is one more than the s-mers
        closed = F.filter(starts, lambda i: F.least(s[i], s[i + 3]) <= F.least(s[i + 1], s[i + 2]))
        return F.transform(closed, lambda i: F.struct(
            F.pmod(F.xxhash64(s[i], s[i + 2], s[i + 3]), F.lit(1 << 4 * HEX)).alias("hash"),
            (i - (K - 1)).cast("int").alias("pos")))

    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(hashed, lambda codes: F.when(F.size(codes) == 0, F.lit(None)).otherwise(
        let(F.concat(pad, codes, pad), lambda padded: let(smers(padded), chosen))))


def fingerprint(marks: Column) -> Column:
    """``hash:position`` in text order; no anchors: empty."""
    written = F.transform(marks, lambda x: F.concat(
        F.lower(F.lpad(F.hex(x["hash"]), HEX, "0")), F.lit(":"), x["pos"].cast("string")))
    return F.coalesce(F.array_join(written, ","), F.lit(""))


def links(marks: Column) -> Column:
    """array<long>: each anchor hashed with the next one and the distance to it; the last by itself."""
    def of(a: Column) -> Column:
        return F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.xxhash64(x["hash"], y["hash"], y["pos"] - x["pos"]))

    return F.coalesce(of(marks), F.array().cast("array<bigint>"))


def likeness(a: Column, b: Column) -> Column:
    """Links of both over links of either, repeats included.

    Both lists are sorted together, the lowest bit telling them apart; runs of
    equal values are counted, and neighbouring runs of one link are shared."""
    either = F.sort_array(F.concat(F.transform(links(a), lambda x: x.bitwiseAND(F.lit(-2))),
                                   F.transform(links(b), lambda x: x.bitwiseOR(F.lit(1)))))

    def runs(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (m[i] != m[F.greatest(i - 1, F.lit(0))]))
        return F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(m)), F.array(F.size(m))), lambda i, end: F.struct(
            m[i].alias("link"), (end - i).alias("n")))

    def shared(r: Column) -> Column:
        pairs = F.zip_with(r, F.slice(r, 2, F.size(r)), lambda x, y: F.when(
            x["link"].bitwiseOR(F.lit(1)) == y["link"], F.least(x["n"], y["n"])).otherwise(F.lit(0)))
        return F.aggregate(pairs, F.lit(0), lambda total, n: total + F.coalesce(n, F.lit(0)))

    def of(m: Column) -> Column:
        return F.when(F.size(m) == 0, F.lit(1.0)).otherwise(
            let(let(runs(m), shared), lambda both: both / (F.size(m) - both)))

    return let(either, of)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of sorted ``bounds`` <= key, looked up in two steps."""
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = bounds[::step], [bounds[i:i + step] for i in range(0, len(bounds), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    def array(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    at = below(array(coarse))
    return F.when(at == 0, F.lit(0)).otherwise(
        let(at, lambda c: (c - 1) * step + below(F.array(*[array(f) for f in fine])[c - 1]))).cast("int")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """``df`` with ``next``: struct of the text and ``extra`` columns of the
    document that follows in descending id (after the last: the first)."""
    parts = partitions(df)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    cuts = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(id_col, F.array(*map(F.lit, cuts)), 20_000)).first()[0] if cuts else []
    bounds = sorted({int(b) for b in found or []})
    # the largest key of each range: at most ``parts`` rows
    ranged = df.withColumn("_key", key).withColumn("_range", _range_of(F.col("_key"), bounds) if bounds else F.lit(0))
    tops = {r["_range"]: r["top"] for r in
            ranged.groupBy("_range").agg(F.max("_key").alias("top")).collect()}
    order = sorted(tops, reverse=True)                       # ranges as they follow each other
    host = {tops[r]: order[i - 1] for i, r in enumerate(order)}
    hosts = F.create_map(*[x for top, r in host.items() for x in (F.lit(top).cast("bigint"), F.lit(r))]) if host else None
    own = F.struct(F.col("_range").alias("_at"), F.lit(False).alias("_guest"))
    guest = F.struct(hosts[F.col("_key")].alias("_at"), F.lit(True).alias("_guest")) if host else own
    places = F.when(hosts[F.col("_key")].isNotNull(), F.array(own, guest)).otherwise(F.array(own)) if host else F.array(own)
    dealt = ranged.select("*", F.inline(places))
    # guests stand after the rows of the range; among themselves like their own rows
    dealt = dealt.repartitionByRange(parts, "_at")           # neighbouring ranges, about one a task
    window = Window.partitionBy("_at").orderBy("_guest", F.desc("_key"), F.desc_nulls_last(text_col))
    ahead = F.struct(F.col(text_col).alias("text"), *(F.col(c) for c in extra or []))
    return (dealt.withColumn("next", F.lead(ahead).over(window)).where("not _guest")
            .drop("_key", "_range", "_at", "_guest"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third
    (floor) of its code points replaced by the first as many, or all, of the
    next document's."""
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("n_chars", F.char_length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = with_next(docs, id_col, "text")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")),
                      F.substring(F.col("next.text"), F.lit(1), third))
    rows = rows.select(id_col, "n_chars", edited.alias("edited"), anchors(F.col("text")).alias("marks"),
                       anchors(F.col("next.text")).alias("next_marks"))
    rows = rows.withColumn("edited_marks", anchors(F.col("edited")))
    return rows.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("marks")).alias("fingerprint"),
        fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
