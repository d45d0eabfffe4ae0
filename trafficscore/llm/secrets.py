"""Secret scans: fixed patterns, and a randomness test battery for the rest.

Base spans: the patterns of ``BASE``, leftmost and non-overlapping per kind,
short ones dropped after matching.  They always stay.

Further spans (kind ``random``): maximal runs of at least ``MIN_RUN`` key
characters that hold a letter and a digit.  The encoding is inferred from the
characters (hex, base32, base36, base64), and a battery tests the hypothesis
that the symbols are drawn evenly and independently from that alphabet:
chi-squared uniformity over as many bins as the length allows, a runs test
about the alphabet's middle, and the lag-1 serial correlation.  Fisher's
method joins the three p-values.  Random keys have even p-values; ordinary
text is crowded near 0.

False-discovery control by length: over the whole corpus, p-values are counted
per encoding and length band (histograms of fixed size, summed in Spark).  In
a band, the p-values above 1/2 tell how many runs are random; the threshold is
the lowest p-value at which the runs above it are at most a share ``fdr``
in excess of what random ones explain.  Bands with few runs take the
threshold of their encoding.

Null text counts as empty: no spans.  Offsets are code points, end exclusive.
Repeated rows get the same spans.  Empty table: no thresholds, empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficscore.llm.common import map_arrow

KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6            # characters of an assigned value
MIN_ACCESS = 20          # characters of an access key
MIN_HEX = 24             # characters of a hex run
MIN_RUN = 20             # characters of a run that the battery tests
FDR = 0.05               # tolerated share of ordinary runs among those reported
BINS = 40                # of the p-value histograms
MIN_BAND = 30            # runs that a band needs for a threshold of its own

# Letters of the key words in either case (spelled out, so that no other letter folds into them).
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                  for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}")       # shorter runs would be dropped
HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")                     # maximal runs; shorter ones would be dropped
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}")
_HINT = re.compile(r"[=:]").search
_DIGIT, _LETTER = re.compile("[0-9]").search, re.compile("[A-Za-z]").search

# Alphabets in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
_CODES = {}
for _name, _letters in ALPHABETS.items():
    _CODES[_name] = np.zeros(128, dtype=np.int64)
    _CODES[_name][[ord(c) for c in _letters]] = np.arange(len(_letters))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    if _HINT(text):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds all characters of the run."""
    have = set(run.rstrip("="))
    return next((name for name, letters in _SETS.items() if have <= letters), None)


def chi_squared_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str, name: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation."""
    size = len(ALPHABETS[name])
    codes = _CODES[name][np.frombuffer(run.rstrip("=").encode(), dtype=np.uint8)]
    n = len(codes)
    bins = min(size, max(2, n // 5))
    counts = np.bincount(codes * bins // size, minlength=bins)
    widths = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    uniform = chi_squared_tail(float(((counts - n * widths) ** 2 / (n * widths)).sum()), bins - 1)
    high = codes >= size // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        turns = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        runs = two_sided((turns - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 0.0
    x = codes - (size - 1) / 2
    serial = two_sided(float((x[1:] * x[:-1]).sum() / (x * x).sum()) * math.sqrt(n))
    return uniform, runs, serial


def joint(p_values: tuple[float, ...]) -> float:
    """Fisher's method: the tail of chi-squared with two degrees per p-value."""
    half = -sum(math.log(max(p, 1e-300)) for p in p_values)
    term = total = 1.0
    for k in range(1, len(p_values)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def band(n: int) -> int:
    """Length bands of half a power of two."""
    return int(2 * math.log2(n))


def tested_runs(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, joint p-value) of all runs that could be keys."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if _DIGIT(run) and _LETTER(run) and (name := encoding(run)):
            found.append((m.start(), m.end(), name, joint(battery(run, name))))
    return found


def thresholds(df: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[tuple[str, int | None], float]:
    """Lowest accepted p-value by (encoding, length band); band None: the encoding as a whole."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[tuple[str, int, int], int] = {}
        for text in batch.column(0).to_pylist():
            for start, end, name, p in tested_runs(text or ""):
                key = (name, band(end - start), min(BINS - 1, int(p * BINS)))
                rows[key] = rows.get(key, 0) + 1
        return pa.RecordBatch.from_pylist([{"name": a, "band": b, "bin": c, "n": n} for (a, b, c), n in rows.items()],
                                          schema=pa.schema([("name", pa.string()), ("band", pa.int32()),
                                                            ("bin", pa.int32()), ("n", pa.int64())]))

    counted = map_arrow(df.select(text_col), count, "name string, band int, bin int, n long")
    bands: dict[tuple[str, int | None], np.ndarray] = {}
    # at most encodings x bands x bins rows, whatever the corpus
    for r in counted.groupBy("name", "band", "bin").agg(F.sum("n").alias("n")).collect():
        for key in ((r["name"], r["band"]), (r["name"], None)):
            bands.setdefault(key, np.zeros(BINS))[r["bin"]] += r["n"]
    return {key: lowest(h, fdr) for key, h in bands.items() if key[1] is None or h.sum() >= MIN_BAND}


def lowest(histogram: np.ndarray, fdr: float) -> float:
    """Lowest p-value from which on at most a share ``fdr`` isn't explained by
    even p-values, whose number is told by the upper half, beyond two standard
    errors of such counts."""
    random = 2 * histogram[BINS // 2:].sum()
    above = np.cumsum(histogram[::-1])[::-1]
    for k in range(BINS):
        expected = random * (1 - k / BINS)
        if above[k] and max(0.0, above[k] - expected - 2 * math.sqrt(above[k])) / above[k] <= fdr:
            return max(k / BINS, fdr / 10)
    return 1.0


def all_spans(text: str, limits: dict) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans, by start and then kind."""
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[1])))
    more = []
    for start, end, name, p in tested_runs(text):
        limit = limits.get((name, band(end - start)), limits.get((name, None), 1.0))
        if p >= limit and not any(s < end and start < e for s, _, e in base):
            more.append((start, "random", end))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", fdr: float = FDR) -> DataFrame:
    """(id, base, spans): the base spans and all spans of each text, as arrays of (kind, start, end)."""
    limits = thresholds(df, text_col, fdr)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(t or "", limits) for t in batch.column(1).to_pylist()]
        as_list = [[[{"kind": k, "start": s, "end": e} for s, k, e in own[i]] for own in found] for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(_SPAN)) for x in as_list)],
                                          names=[id_col, "base", "spans"])

    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {kind}, base {spans}, spans {spans}")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``df`` with every span (overlapping ones as one) of the text replaced by
    ``mask``, and ``n_chars``, if there is such a column, brought up to date."""
    limits = thresholds(df, text_col, fdr)
    names = df.columns

    def masked(text: str | None) -> str | None:
        spans = all_spans(text, limits)[1] if text else []
        if not spans:
            return text
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [masked(t) for t in batch.column(names.index(text_col)).to_pylist()]
        columns = list(batch.columns)
        columns[names.index(text_col)] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out = map_arrow(df, run, schema)
    if "n_chars" in names and text_col != "n_chars":
        size = F.char_length(text_col).cast(df.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))
    return out


def report(df: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans as text."""
    def written(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return find(df).select("doc_id", *(number(k).alias(f"n_{k}") for k in KINDS[:3]),
                           F.sha2(written("base").cast("binary"), 256).alias("base_sha256"),
                           written("spans").alias("spans"))
