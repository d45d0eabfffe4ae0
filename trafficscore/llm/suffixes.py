"""Removal of repeated substrings with suffix arrays.

A byte goes if it lies in a string of ``MATCH`` = 50 bytes that also starts in a
document with a smaller doc_id, judged on the input.

1. Per shard (texts of about ``SHARD`` bytes) a suffix array sorted to depth 50
   by Larsson-Sadakane refinement in numpy: suffixes start out sorted by their
   first 8 bytes, and groups that are still tied are sorted again by the rank
   of the suffix 8, then 16, then 18 bytes further on; sorted suffixes are left
   alone.  Common prefixes of neighbours follow Kasai: where both go on by one
   byte the length falls by one, so only heads of such runs are compared.
   Neighbours with 50 bytes in common form classes; windows of a class that has
   a smaller doc_id are marked.
2. Across shards.  Of the windows that a shard couldn't mark, each is stood for
   by its smallest hash of 16 bytes (its anchor), the same in every copy of the
   window.  Anchors are dealt out by their hash; every task sorts the anchors of
   its hashes and merges the shards' lists by binary search.  Anchors with the same
   surroundings (all windows that have the anchor) settle each other's windows: all go
   but those of the smallest doc_id.  Where the surroundings of one anchor agree
   only in part, each kind of them is fetched from all its places in texts of its
   smallest doc_id, and step 1 runs over them.

Hot passages: copies within a shard are settled there, so a passage reaches
the merge once per shard, not once per document.  Texts are shuffled once, compressed,
by doc_id and the hash of the text, which is also how what is found comes back to
them; so texts without doc_id, or of one doc_id, are dealt over all tasks.

Null text counts as empty.  Rows that repeat a doc_id don't remove each other's
bytes.  Rows without doc_id stand after all others.  Empty table: empty result.
Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import cut, map_arrow, partitions
from trafficscore.plans.strategies import materialize

MATCH = 50               # bytes of a repeated string
ANCHOR = 16              # bytes of an anchor; MATCH - ANCHOR + 1 of them lie in a window
SHARD = 4 << 20          # bytes of text per suffix array
LAST = (1 << 63) - 1     # stands for a missing doc_id
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words8(buf: np.ndarray, extra: int = 128) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number; zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(extra + 8, dtype=np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(buf) + extra]
    return np.ascontiguousarray(views).view(">u8").ravel().astype(np.uint64)


def _heads(values: np.ndarray) -> np.ndarray:
    """True where a sorted array's value differs from the one before."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _repeated(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` whose ``MATCH`` bytes may stand at another as well: all that do,
    and hardly others.  By hashes, sorted with the place's number in the low bits."""
    if not len(at):
        return at
    h, depth = words, 8
    while depth < MATCH:
        step = min(depth, MATCH - depth)
        h = h[:len(h) - step] * _A + h[step:]
        depth += step
    bits = np.uint64(len(at).bit_length())
    key = (h[:at[-1] + 1] * _B)[at] >> bits << bits
    key |= np.arange(len(at), dtype=np.uint64)
    key.sort()
    own = key >> bits
    same = np.zeros(len(at), dtype=bool)
    same[1:] = own[1:] == own[:-1]
    same[:-1] |= same[1:]
    number = (key[same] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    number.sort()
    return at[number]


def _shifted(places: np.ndarray, steps: tuple[int, ...], size: int) -> np.ndarray:
    """True at the places and at each of the steps from them."""
    out = np.zeros(size, dtype=bool)
    for step in steps:
        out[places + step] = True
    return out


def suffix_groups(words: np.ndarray, n: int, windows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, group): suffixes (of those at True in ``windows``) that share their first
    ``MATCH`` bytes with another, in sorted order, groups ascending; by Larsson-Sadakane
    refinement of those that may have an equal and of the suffixes that tell them apart."""
    places = _repeated(words, np.arange(n) if windows is None else np.flatnonzero(windows[:n]))
    order = np.flatnonzero(_shifted(places, (0, 8, 16, 24, 18, 26, 34, 42), len(words))[:n])
    order = order[np.argsort(words[order])]
    heads = _heads(words[order])
    at = np.flatnonzero(heads)
    sizes = np.diff(at, append=len(order))
    rank = np.zeros(len(words), dtype=np.int64)
    rank[order] = np.repeat(at, sizes) + 1            # 0 stands for the end of the buffer
    tied = order[np.repeat(sizes > 1, sizes)]
    depth = 8
    # suffixes whose rank to the depth that a round reaches is read later on
    for read in ((0, 16, 18, 34), (0, 18), (0,)):
        tied = tied[_shifted(places, read, len(words))[tied]]
        step = min(depth, MATCH - depth)
        key = rank[tied] << 32 | rank[tied + step]
        key_order = np.argsort(key)
        tied, key = tied[key_order], key[key_order]
        at = np.flatnonzero(_heads(key))
        sizes = np.diff(at, append=len(tied))
        old = key >> 32
        starts = np.maximum.accumulate(np.where(_heads(old), np.arange(len(old)), 0))
        rank[tied] = old + np.repeat(at, sizes) - starts
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth += step
    order = np.lexsort((tied, rank[tied]))
    return tied[order], rank[tied[order]]


def common_prefixes(words: np.ndarray, n: int, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix has in common with the one before
    it (0 for the first of a group), by Kasai's rule over text order."""
    out = np.zeros(len(suffixes), dtype=np.int64)
    second = np.flatnonzero(~_heads(group))
    if not len(second):
        return out
    by_place = second[np.argsort(suffixes[second])]
    p, q = suffixes[by_place], suffixes[by_place - 1]
    head = np.ones(len(p), dtype=bool)
    head[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
    a, b = p[head], q[head]
    size = np.zeros(len(a), dtype=np.int64)
    going = np.arange(len(a))
    while len(going):
        x, y = a[going] + size[going], b[going] + size[going]
        inside = np.maximum(x, y) < n
        same = inside & (words[np.minimum(x, n)] == words[np.minimum(y, n)])
        ended = going[~same & inside]
        if len(ended):
            differ = words[a[ended] + size[ended]] ^ words[b[ended] + size[ended]]
            size[ended] += 7 - np.floor(np.log2(np.maximum(differ >> np.uint64(1), 1).astype(float))).astype(np.int64) // 8
        going = going[same]
        size[going] += 8
    size = np.minimum(size, n - np.maximum(a, b))
    index = np.flatnonzero(head)
    run = np.cumsum(head) - 1
    out[by_place] = size[run] - (np.arange(len(p)) - index[run])
    return out


def marked(buf: np.ndarray, sizes: np.ndarray, owner: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """True at each start of a 50-byte window, inside one segment, that a
    segment with a smaller owner has as well."""
    n = len(buf)
    out = np.zeros(n, dtype=bool)
    if n < MATCH or len(sizes) < 2:
        return out
    words = words8(buf) if words is None else words
    segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    suffixes, group = suffix_groups(words, n, np.arange(n) + MATCH <= np.cumsum(sizes)[segment])
    if not len(suffixes):
        return out
    first = np.flatnonzero(common_prefixes(words, n, suffixes, group) < MATCH)
    own = owner[segment[suffixes]]
    least = np.repeat(np.minimum.reduceat(own, first), np.diff(first, append=len(own)))
    out[suffixes[own > least]] = True
    return out


def merged(pairs: np.ndarray) -> np.ndarray:
    """Union of (start, end) pairs: sorted, disjoint, not touching; shape (n, 2)."""
    if not len(pairs):
        return np.zeros((0, 2), dtype=np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.r_[True, pairs[1:, 0] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(pairs) - 1]
    return np.stack([pairs[new, 0], reach[last]], axis=1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


def anchors(words: np.ndarray, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of the windows that start at True in ``windows``."""
    h = np.full(n, _B)                                # or zero bytes would hash to 0, which stands for no window
    for j in range(0, ANCHOR, 8):
        h = _mix(h * _A + words[j:j + n])
    wide = MATCH - ANCHOR + 1
    least, s = h.copy(), 1                            # smallest hash from each position on, over doubling widths
    while 2 * s <= wide:
        least[:n - s] = np.minimum(least[:n - s], least[s:])
        s *= 2
    r = wide - s
    if r:
        least[:n - r] = np.minimum(least[:n - r], least[r:])
    least[~windows] = 0
    most, s = least, 1                                # a position is an anchor if a window that holds it has its hash
    while 2 * s <= wide:
        most[s:] = np.maximum(most[s:], most[:-s].copy())
        s *= 2
    r = wide - s
    if r:
        most[r:] = np.maximum(most[r:], most[:-r].copy())
    at = np.flatnonzero((most == h) & (h != 0))
    return at, h[at]


#: Bytes before an anchor that its windows can reach.
BEFORE = MATCH - ANCHOR
HALF = BEFORE // 2
#: An anchor: its hash, hashes of the HALF bytes on its left and right and of all
#: surroundings, its place, the bytes of the text from there on (MATCH at most), and its text.
ANCHORS = np.dtype([("h", "<u8"), ("left", "u1"), ("right", "u1"), ("all", "<u8"), ("place", "<u4"), ("tail", "u1"),
                    ("did", "<i8"), ("rep", "<i8")])
#: A span a..b to remove, or (ask) a place a to fetch for the anchor hash b.
RECORDS = np.dtype([("did", "<i8"), ("rep", "<i8"), ("a", "<u4"), ("b", "<i8"), ("ask", "u1")])
#: Surroundings fetched for an anchor hash: from which place of which text, how many bytes.
PIECES = np.dtype([("key", "<i8"), ("did", "<i8"), ("rep", "<i8"), ("low", "<u4"), ("size", "u1")])
#: Bytes that are sent of the hashes: 40 bits of an anchor's (in its bucket), 48 + 16 of its surroundings.
SENT = {"h": 5, "all": 6}
#: Columns sent as differences, since rows are sent in the order of their texts.
STEPS = ("did", "rep", "place", "a", "low")
SCHEMA = "bucket int, kind int, blob binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
OF_ANCHORS, OF_RECORDS, OF_PIECES = range(3)


def _sent(kind: np.dtype) -> dict[str, int]:
    return {c: min(kind[c].itemsize, SENT.get(c, 8)) for c in kind.names}


def _unsigned(column: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(column).view(f"<u{column.dtype.itemsize}")


def pack(rows: np.ndarray) -> bytes:
    """Rows byte by byte of each column, compressed."""
    planes = []
    for c, k in _sent(rows.dtype).items():
        column = _unsigned(rows[c])
        if c in STEPS:
            column = np.diff(column, prepend=column.dtype.type(0))
        planes.append(column.view(np.uint8).reshape(len(rows), -1)[:, :k].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, list[int]]:
    """(rows, number of rows of each blob)."""
    widths = _sent(kind)
    total = sum(widths.values())
    counts = [zstandard.frame_content_size(x) // total for x in blobs]
    out, at = np.zeros(sum(counts), dtype=kind), 0
    open_up = zstandard.ZstdDecompressor().decompress
    for blob, n in zip(blobs, counts, strict=True):
        raw, byte = open_up(blob), 0
        for c, k in widths.items():
            whole = np.zeros((n, kind[c].itemsize), dtype=np.uint8)
            whole[:, :k] = np.frombuffer(raw, dtype=np.uint8, count=k * n, offset=byte).reshape(k, n).T
            column = whole.view(f"<u{kind[c].itemsize}").ravel()
            if c in STEPS:
                column = np.cumsum(column, dtype=column.dtype)
            out[c][at:at + n] = column.view(kind[c])
            byte += k * n
        at += n
    return out, counts


def _dealt(rows: np.ndarray, bucket: np.ndarray, kind: int) -> list[dict]:
    """One packed row per bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(_heads(bucket))
    parts = np.split(rows, cuts[1:]) if len(cuts) else []
    return [{"bucket": int(b), "kind": kind, "blob": pack(x)} for b, x in zip(bucket[cuts].tolist(), parts, strict=True)]


def _doc_bucket(did: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(did.view(np.uint64) * _A) % np.uint64(buckets)).astype(np.int64)


def _hash_of(words: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Hash of the bytes low..high (at most ``most``) and of their number."""
    size = np.maximum(high - low, 0)
    h = _mix(size.astype(np.uint64) + _A)
    for j in range(0, most, 8):
        take = np.clip(size - j, 0, 8).astype(np.uint64)
        word = words[np.minimum(low + j, len(words) - 1)]
        word = np.where(take == 0, np.uint64(0), word >> np.minimum((np.uint64(8) - take) * np.uint64(8), np.uint64(63)))
        h = _mix(h * _A + word)
    return h


def _spans(did: np.ndarray, rep: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Records of the union of spans, text by text."""
    order = np.lexsort((low, rep, did))
    did, rep, low, high = did[order], rep[order], low[order], high[order]
    text = np.cumsum(_heads(did) | _heads(rep)) - 1
    pairs = merged(np.stack([(text << 33) + low, (text << 33) + high], axis=1))
    out = np.zeros(len(pairs), dtype=RECORDS)
    first = np.flatnonzero(_heads(text))[pairs[:, 0] >> 33] if len(pairs) else np.zeros(0, dtype=np.int64)
    out["did"], out["rep"] = did[first], rep[first]
    out["a"], out["b"] = pairs[:, 0] & (1 << 33) - 1, pairs[:, 1] & (1 << 33) - 1
    return out


def _pack_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The last column's texts, compressed, since they are shuffled and kept."""
    press = zstandard.ZstdCompressor(level=3).compress
    raw = [press(t) for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())],
                                      names=[*batch.schema.names[:-1], "packed"])


def _texts(column: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def _shards(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Shards of about ``SHARD`` bytes from the texts of a batch: their own
    spans, and the anchors of windows that they can't settle."""
    sizes = batch.column(2).to_numpy()
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SHARD, prepend=-1)).tolist() + [len(sizes)]
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows += _shard(batch.slice(a, b - a), buckets)
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _shard(batch: pa.RecordBatch, buckets: int) -> list[dict]:
    did, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    texts = _texts(batch.column(3))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n, ends = len(buf), np.cumsum(sizes)
    if n < MATCH:
        return []
    starts = ends - sizes
    words = words8(buf)
    own = marked(buf, sizes, did, words)
    segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at = np.flatnonzero(own)
    k = segment[at]
    spans = _spans(did[k], rep[k], at - starts[k], at - starts[k] + MATCH)
    rows = _dealt(spans, _doc_bucket(spans["did"], buckets), OF_RECORDS)
    at, h = anchors(words, n, ~own & (np.arange(n) + MATCH <= ends[segment]))
    k = segment[at]
    low, high = np.maximum(at - BEFORE, starts[k]), np.minimum(at + MATCH, ends[k])
    found = np.zeros(len(at), dtype=ANCHORS)
    found["h"], found["place"], found["did"], found["rep"] = h, at - starts[k], did[k], rep[k]
    found["tail"] = high - at
    found["left"] = _hash_of(words, np.maximum(at - HALF, low), at, HALF) >> np.uint64(56)
    found["right"] = _hash_of(words, at + ANCHOR, np.minimum(at + ANCHOR + HALF, high), HALF) >> np.uint64(56)
    found["all"] = _hash_of(words, low, high, MATCH + BEFORE)
    return rows + _dealt(found, (h >> np.uint64(40)).astype(np.int64) % buckets, OF_ANCHORS)


def _merge(batches, buckets: int):
    """Merges the shards' anchors of this task's buckets: settled spans and, of
    anchors whose surroundings partly agree, where to fetch each kind."""
    blobs, of = [], []
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        if (kinds == OF_RECORDS).any():
            yield batch.filter(pa.array(kinds == OF_RECORDS))
        mine = batch.filter(pa.array(kinds == OF_ANCHORS))
        blobs += mine.column(2).to_pylist()
        of += mine.column(0).to_pylist()
    if not blobs:
        return
    # buckets apart, since a hash is only whole together with its bucket
    found, counts = unpack(blobs, ANCHORS)
    bucket = np.repeat(np.array(of), counts)
    blobs.clear()
    found["h"] += bucket.astype(np.uint64) << np.uint64(40)
    # sorted once, the shards' lists are merged by binary search: a hash's anchors are the
    # rows between its first and last place
    order = np.argsort(found["h"])
    found = found[order]
    at = np.flatnonzero(_heads(found["h"]))
    size = np.searchsorted(found["h"], found["h"][at], side="right") - at
    least, most = np.minimum.reduceat(found["did"], at), np.maximum.reduceat(found["did"], at)
    found = found[np.repeat(least != most, size)]
    if not len(found):
        return
    found = found[np.lexsort((found["did"], found["all"], found["right"], found["left"], found["h"]))]
    new_hash = _heads(found["h"])
    new_kind = new_hash | _heads(found["left"]) | _heads(found["right"]) | _heads(found["all"])
    first = np.flatnonzero(new_kind)
    kind = np.cumsum(new_kind) - 1
    settled = found["did"] > found["did"][first][kind]
    # kinds that share a window agree in the bytes on their left or on their right.  Of those, all
    # places of a kind's smallest doc_id are fetched that a smaller one may settle, else one
    group = np.cumsum(new_hash)[first]
    own = found["did"][first]
    asked, later = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
    for side in ("left", "right"):
        _, back = np.unique(group * 256 + found[side][first], return_inverse=True)
        order = np.argsort(back, kind="stable")
        starts = np.flatnonzero(_heads(back[order]))
        least = np.minimum.reduceat(own[order], starts)[back]
        asked |= np.maximum.reduceat(own[order], starts)[back] > least
        later |= own > least
    wanted = later[kind] & ~settled
    wanted[first] = asked
    place = found["place"].astype(np.int64)
    gone = np.flatnonzero(settled)
    spans = _spans(found["did"][gone], found["rep"][gone], np.maximum(place[gone] - BEFORE, 0),
                   place[gone] + found["tail"][gone])
    ask = np.flatnonzero(wanted)
    records = np.zeros(len(ask), dtype=RECORDS)
    records["did"], records["rep"], records["a"] = found["did"][ask], found["rep"][ask], place[ask]
    records["b"], records["ask"] = found["h"][ask].view(np.int64), 1
    records = np.concatenate([spans, records])
    yield pa.RecordBatch.from_pylist(_dealt(records, _doc_bucket(records["did"], buckets), OF_RECORDS), schema=_ARROW)


_FOUND = "did long, rep long, spans array<int>, places array<int>, keys array<long>"


def _collect(batches):
    """One row per text of this task's buckets: its spans, and what to fetch of it."""
    blobs = [x for batch in batches for x in batch.column(2).to_pylist()]
    rows, _ = unpack(blobs, RECORDS)
    rows = rows[np.lexsort((rows["a"], rows["rep"], rows["did"]))]
    head = _heads(rows["did"]) | _heads(rows["rep"])
    text, first = np.cumsum(head) - 1, np.flatnonzero(head) if len(rows) else np.zeros(0, dtype=int)

    def lists(mask, values, width, kind):
        counts = np.bincount(text[mask], minlength=len(first)) * width
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

    span, ask = rows["ask"] == 0, rows["ask"] == 1
    pairs = np.stack([rows["a"][span].astype(np.int64), rows["b"][span]], axis=1).ravel()
    yield pa.RecordBatch.from_arrays(
        [pa.array(rows["did"][first]), pa.array(rows["rep"][first]),
         lists(span, pairs, 2, pa.int32()), lists(ask, rows["a"][ask], 1, pa.int32()),
         lists(ask, rows["b"][ask], 1, pa.int64())], names=["did", "rep", "spans", "places", "keys"])


def _fetch(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """The surroundings of the places asked for in each text, dealt by anchor hash."""
    did, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    rows, parts = [], []
    for i, (raw, places, keys) in enumerate(zip(_texts(batch.column(2)), batch.column(3), batch.column(4), strict=True)):
        place = places.values.to_numpy().astype(np.int64)
        own = np.zeros(len(place), dtype=PIECES)
        low, high = np.maximum(place - BEFORE, 0), np.minimum(place + MATCH, len(raw))
        own["key"], own["did"], own["rep"], own["low"], own["size"] = keys.values.to_numpy(), did[i], rep[i], low, high - low
        rows.append(own)
        parts += [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    rows = np.concatenate(rows)
    bucket = (_mix(rows["key"].view(np.uint64) * _A) % np.uint64(buckets)).astype(np.int64)
    out = []
    press = zstandard.ZstdCompressor(level=1).compress
    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(_heads(bucket[order]))[1:]):
        head = pack(rows[own])
        blob = len(head).to_bytes(8, "little") + head + press(b"".join(parts[i] for i in own.tolist()))
        out.append({"bucket": int(bucket[own[0]]), "kind": OF_PIECES, "blob": blob})
    return pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _settle(batches, buckets: int):
    """Step 1 over fetched surroundings, about ``SHARD`` bytes at a time, an anchor's all together."""
    open_up = zstandard.ZstdDecompressor().decompress
    heads, texts = [], []
    for batch in batches:
        for blob in batch.column(2).to_pylist():
            end = 8 + int.from_bytes(blob[:8], "little")
            heads.append(blob[8:end])
            texts.append(open_up(blob[end:]))
    rows, _ = unpack(heads, PIECES)
    if not len(rows):
        return
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    texts.clear()
    sizes = rows["size"].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(rows["key"], kind="stable")
    anchor = np.flatnonzero(_heads(rows["key"][order]))
    before = (np.cumsum(sizes[order]) - sizes[order])[anchor]
    cuts = anchor[np.flatnonzero(np.diff(before // SHARD, prepend=-1) != 0)]
    for own in np.split(order, cuts[1:]):
        size = sizes[own]
        ends = np.cumsum(size)
        part = buf[np.repeat(starts[own] - (ends - size), size) + np.arange(ends[-1])]
        hit = np.flatnonzero(marked(part, size, rows["did"][own]))
        k = np.searchsorted(ends, hit, side="right")
        at = hit - (ends - size)[k] + rows["low"][own][k]
        spans = _spans(rows["did"][own][k], rows["rep"][own][k], at, at + MATCH)
        yield pa.RecordBatch.from_pylist(_dealt(spans, _doc_bucket(spans["did"], buckets), OF_RECORDS), schema=_ARROW)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(texts, spans): the texts (id, did, rep, size, packed), dealt out by did and rep, and
    tables (did, rep, spans) of what to remove, as flat (start, end) pairs that may overlap."""
    n = partitions(df)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"),
                      F.xxhash64(text).alias("rep"), F.octet_length(text).cast("long").alias("size"), text.alias("text"))
    texts = map_arrow(texts, _pack_texts, f"{id_col} {kind}, did long, rep long, size long, packed binary")
    # rep, the hash of the text, tells different texts of one doc_id apart
    texts = materialize(texts.repartition(n, "did", "rep"))
    shards = map_arrow(texts.select("did", "rep", "size", "packed"), lambda batch: _shards(batch, n), SCHEMA, SHARD)
    found = shards.repartition(n, "bucket").mapInArrow(lambda batches: _merge(batches, n), SCHEMA)
    found = cut(found.repartition(n, "bucket").mapInArrow(_collect, _FOUND))
    asked = found.where(F.size("places") > 0).select("did", "rep", "places", "keys")
    pieces = map_arrow(texts.select("did", "rep", "packed").dropDuplicates(["did", "rep"]).join(asked, ["did", "rep"]),
                       lambda batch: _fetch(batch, n), SCHEMA, SHARD)
    settled = pieces.repartition(n, "bucket").mapInArrow(lambda batches: _settle(batches, n), SCHEMA)
    settled = settled.repartition(n, "bucket").mapInArrow(_collect, _FOUND)
    return texts, [x.select("did", "rep", "spans").where(F.size("spans") > 0) for x in (found, settled)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, removed (array of (start, end) byte spans, maximal), kept (binary)."""
    texts, spans = repeated_spans(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, kept = [], [], []
        for raw, own, more in zip(_texts(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
            gone = merged(np.array([*(own or ()), *(more or ())], dtype=np.int64).reshape(-1, 2)).tolist()
            at, parts = 0, []
            for a, b in gone:
                parts.append(raw[at:a])
                at = b
            sizes.append(len(raw))
            removed.append([{"start": a, "end": b} for a, b in gone])
            kept.append(b"".join([*parts, raw[at:]]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pair)),
                                           pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "removed", "kept"])

    rows = texts
    for i, own in enumerate(spans):
        rows = rows.join(own.withColumnRenamed("spans", f"spans{i}"), ["did", "rep"], "left")
    return map_arrow(rows.select(id_col, "packed", "spans0", "spans1"), run,
                     f"{id_col} {kind}, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")


def report(df: DataFrame) -> DataFrame:
    """Per document: bytes, bytes and spans removed, digest of what is left."""
    return remove_repeats(df).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
