"""SimHash near-duplicates: byte-position inverted index with count filtering.

``fingerprints``: 64 bits per text.  A-Z are lowered, words are runs of other
than ASCII white space, shingles are ``shingle`` consecutive words joined by
one space, repeats included (fewer words: the whole sequence; none:
fingerprint 0).  A bit is 1 if over half of the shingles' XXH64 hashes
(seed 42) have it.

``linked``: fingerprints that differ in at most ``max_bits`` bits.  A pair at
distance d shares at least 8 - d of its 8 positional bytes.  Lists of one byte would hold
1/256 of all fingerprints, so a list is keyed by several positions: the 8 are
cut into d + 2 blocks, of which at least two must agree as a whole, and each
distinct fingerprint is posted under every pair of blocks.  Fingerprints that meet in a list are paired once, their equal
positional bytes are tallied, pairs below the guaranteed minimum of 8 - d are
dropped, and the rest is verified by the bits of the XOR.

A list longer than ``LIST_MAX`` isn't paired (that is quadratic).  Its members
post the codes within ``max_bits``/2 flipped bits of themselves; two
fingerprints share such a code if and only if they are at most ``max_bits``
apart, and each code's members are linked to the smallest.  That is exact and
grows in proportion to the members.

``near_duplicates``: per document its fingerprint and the smallest doc_id it
reaches over links.  Exact copies collapse to one fingerprint (pre-aggregated)
before anything is compared, so a group of copies of any size costs one row.

Null text counts as empty; all texts without words share fingerprint 0 and are
linked.  Repeated rows come out as often as they went in.  Null doc_ids come
out with the component of their fingerprint.  Empty table: empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import components, cut, map_arrow, unused

SHINGLE_WORDS = 3
MAX_BITS = 2
LIST_MAX = 64          # fingerprints of one list that are paired with each other
ROWS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    words = text.lower().split()          # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends, strict=True)),
                         dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, ROWS_AT_ONCE):
        part = hashes[at:at + ROWS_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t or b"", shingle) for t in texts], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {kind}, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def postings(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, rep, list int, key long): the byte-position index of distinct fingerprints."""
    cuts = np.array_split(np.arange(8), max_bits + 2)
    lists = []
    for i, (a, b) in enumerate(combinations([c.tolist() for c in cuts], 2)):
        mask = sum(255 << 8 * k for k in a + b)
        signed = mask - (1 << 64) if mask >> 63 else mask
        lists.append(F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    return fps.select("fp", "rep", F.inline(F.array(*lists)))


def linked(fps: DataFrame, max_bits: int = MAX_BITS, list_max: int = LIST_MAX) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps`` (fp, rep) given as
    their ``rep``; every pair at most ``max_bits`` apart is connected by links,
    and every link is such a pair."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: codes lie half way between two fingerprints")
    posted = postings(fps, max_bits)
    sizes = posted.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(posted.join(sizes, ["list", "key"]))
    short = met.where(F.col("n") <= list_max)
    pairs = (short.select("list", "key", "fp", F.col("rep").alias("a"))
             .join(short.select("list", "key", F.col("fp").alias("fp2"), F.col("rep").alias("b")), ["list", "key"])
             .where("a < b"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    tally = sum((F.when(_byte(x, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))
    pairs = pairs.where(tally >= 8 - max_bits).where(F.bit_count(x) <= max_bits).select("a", "b").distinct()

    hot = met.where(F.col("n") > list_max).select("fp", "rep").distinct()
    flips = [0, *(sum(1 << i for i in c) for k in range(1, max_bits // 2 + 1) for c in combinations(range(64), k))]
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    codes = hot.select("rep", F.explode(F.transform(F.lit(flips).cast("array<bigint>"),
                                                    lambda f: F.col("fp").bitwiseXOR(f))).alias("code"))
    least = codes.groupBy("code").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = codes.join(least, "code").select(F.col("b").alias("a"), F.col("rep").alias("b")).where("a < b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint: 16 hex digits, component_id) for every row of ``df``."""
    rows = cut(fingerprints(df, text_col, id_col, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min(id_col).alias("rep")).where("rep is not null"))
    found = components(linked(fps, max_bits))
    classes = (fps.join(found, F.col("rep") == F.col("node"), "left")
               .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return (rows.join(classes, "fp", "left")
            .select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: the one with the smallest id, of those that share that id the one whose
    text has the smallest digest (one of equal rows).  A repeated id with texts of different groups thus
    leaves one row of each.  Rows without an id stay as they are.  All columns stay, whatever their names."""
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    known = df.where(F.col(id_col).isNotNull())
    keyed = known.select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("key"), F.col(text_col).alias("text"))
    # a group of copies of any size is one fingerprint from here on
    fps = cut(fingerprints(keyed, "text", "key", shingle).groupBy("fp").agg(F.min("key").alias("key")))
    found = components(linked(fps.select("fp", F.col("fp").alias("rep")), max_bits))
    least = (fps.join(found, F.col("fp") == F.col("node"), "left")
             .groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("key").alias("key")))
    own, kept_id, kept_digest = (unused(df, name) for name in ("_digest", "_kept_id", "_kept_digest"))
    keep = least.select(F.col("key.id").alias(kept_id), F.col("key.digest").alias(kept_digest))
    rows = known.withColumn(own, digest)
    kept = rows.join(keep, (F.col(id_col) == F.col(kept_id)) & (F.col(own) == F.col(kept_digest)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own).unionByName(df.where(F.col(id_col).isNull()))
