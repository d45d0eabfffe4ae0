"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans (``email``, ``ip``, ``card``, ``phone``): fixed patterns, leftmost and
non-overlapping per kind, then checked (address parts, digits and Luhn, digits);
matches that fail are dropped.  Base spans always stay.

Candidates: high-recall generators propose further, overlapping spans: loose runs of
digits with usual separators, and mail addresses also when written with [at] and
[dot].  Each gets coarse features of its format (digits, groups, separators)
and context (words before it, neighbours).  What the checks of the base kinds look at
(check digit, plus sign, ranges) is no feature: so a score is the chance that a
span of this format in this context is personal data, also where the check fails.

Boosted trees of ``DEPTH`` levels per kind are fitted on the candidates of a bounded
sample of documents (``SAMPLE_DOCS`` of smallest hash, ``SAMPLE_ROWS`` distinct feature
rows), labelled by their normalised value (``personal``): [at] and [dot] undone,
separators dropped, then the kind's check; or by overlap with a base span.  So a
form that no base pattern takes has positive examples too.  Half of the sample
fits, the other half calibrates: the lowest score from which on a share
``PRECISION`` of candidates is personal data.  Kinds without such a score,
or fewer than ``MIN_FOUND`` examples, add nothing.  Trees become CASE expressions.

Positions come from the lengths of the pieces between the matches.  Patterns
are possessive where that changes nothing, so that long texts can't overflow the
stack or run in quadratic time.  Null text counts as empty.  Offsets are code
points, end exclusive.  Repeated rows get equal spans.  Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE = 24, 2, 0.3
PRECISION = 0.98
MIN_FOUND = 20
BEFORE = 24              # code points of context before a candidate

# The base patterns.  Starts are tied to the start of a run (or the last match's end),
# and loops keep what they have taken, which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",             # of 13 digits or more: shorter ones would be dropped
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
NUMBER = r"(?<![0-9A-Za-z.+(-])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,30}+(?![0-9A-Za-z])"
MAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?\[at\]\x20?|\x20?\(at\)\x20?|@)[A-Za-z0-9-]{1,63}+"
        r"(?:(?:\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\.)[A-Za-z0-9-]{1,63}+){1,8}+")
# Words that announce a kind.
CUES = {1: "phone|mobile|call|tel[.: ]|fax|whatsapp", 2: "card|visa|master|amex|credit|debit|payment", 3: "addr|host|server|login from|ip[ :=]",
        4: "mail|contact|write to"}
FEATURES = ("digits", "groups", "longest", "first", "last", "separator", "cue", "neighbour", "mail", "lead")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


_SPAN = "array<struct<start: int, end: int, value: string>>"


def found(text: Column, pattern: str, hint: str | None = None) -> Column:
    """array<struct<start, end, value>> of all matches, in code points."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda gap, value: F.struct(F.char_length(gap).alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.char_length(x["value"]), F.lit(0))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    matches = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda acc: acc["out"])
    may = F.contains(text, F.lit(hint)) if hint else text.rlike(pattern)
    return F.when(may, matches).otherwise(F.array().cast(_SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & let(digits(value), luhn)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def personal(kind: str, value: Column) -> Column:
    """Whether a candidate passes the kind's check once its way of writing is undone."""
    if kind == "email":
        undone = F.regexp_replace(value, r"\x20?(?:\[at\]|\(at\))\x20?", "@")
        undone = F.regexp_replace(undone, r"\x20?(?:\[dot\]|\(dot\))\x20?", ".")
        return undone.rlike(f"^{PATTERNS['email']}$")
    dense = F.regexp_replace(value, r"[\x20()-]", "")
    if kind == "ip":
        return valid("ip", dense)
    dense = F.regexp_replace(dense, r"\.", "")
    return dense.rlike(r"^\+[0-9]+$" if kind == "phone" else "^[0-9]+$") & valid(kind, dense)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, PATTERNS[kind], HINTS.get(kind)), lambda s: valid(kind, s["value"]))


def features(text: Column, span: Column) -> Column:
    """struct of small integers that describe a candidate."""
    value = span["value"]
    groups = F.split(F.regexp_replace(value, "^[^0-9]+", ""), "[^0-9]+")
    plain = F.regexp_replace(value, "[0-9+]", "")
    before = F.lower(F.substring(text, F.greatest(span["start"] - BEFORE, F.lit(0)) + 1,
                                 F.least(span["start"], F.lit(BEFORE))))
    cue, lead = F.lit(0), F.substring(digits(value), 1, 1)
    for number, pattern in CUES.items():
        cue = F.when(before.rlike(pattern), number).otherwise(cue)
    separator = (F.when(plain == "", 0).when(plain.rlike(r"^\x20+$"), 1).when(plain.rlike("^-+$"), 2)
                 .when(plain.rlike(r"^\.+$"), 3).when(plain.rlike(r"[()]"), 4).otherwise(5))
    neighbour = (F.when((before == "") | before.rlike(r"\s$"), 0).when(before.rlike("[a-z]$"), 1).otherwise(2))
    mail = F.when(F.contains(value, F.lit("@")), 1).when(value.rlike("at[)\\]]"), 2).otherwise(0)

    def capped(c: Column, most: int) -> Column:
        return F.least(c, F.lit(most)).cast("int")

    return let(F.transform(groups, lambda g: F.length(g)), lambda sizes: F.struct(
        capped(F.length(digits(value)), 24).alias("digits"), capped(F.size(sizes), 10).alias("groups"),
        capped(F.array_max(sizes), 20).alias("longest"), capped(sizes[0], 10).alias("first"),
        capped(F.element_at(sizes, -1), 10).alias("last"), separator.alias("separator"), cue.alias("cue"),
        neighbour.alias("neighbour"), mail.alias("mail"),
        F.coalesce(lead.try_cast("int"), F.lit(0)).alias("lead")))


def candidates(text: Column) -> Column:
    """array<struct<start, end, f>> of what the generators propose."""
    numbers = found(text, NUMBER)
    mails = F.when(F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]"), found(text, MAIL)).otherwise(
        F.array().cast(_SPAN))
    return F.transform(F.concat(numbers, mails), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), features(text, s).alias("f"),
        *(personal(k, s["value"]).alias(k) for k in KINDS)))


def _overlaps(spans: Column, x: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def read(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, one array of base spans per kind, candidates)."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    rows = rows.select(id_col, *(base_spans(text, k).alias(k) for k in KINDS), candidates(text).alias("candidates"))
    return rows


class Trees:
    """Boosted trees over small-integer features, for one kind."""

    def __init__(self, base: float, trees: list, threshold: float):
        self.base, self.trees, self.threshold = base, trees, threshold

    def total(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _walk(tree, x)
        return out

    def column(self, f: Column) -> Column:
        """The trees' sum as nested CASE expressions over a feature struct."""
        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            j, cut, low, high = tree
            return F.when(f[FEATURES[j]] <= cut, node(low)).otherwise(node(high))

        out = F.lit(float(self.base))
        for tree in self.trees:
            out = out + node(tree)
        return out


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _walk(low, x), _walk(high, x))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A tree as nested (feature, cut, low, high), with Newton steps as leaves."""
    def value(own):
        return float(RATE * grad[own].sum() / (hess[own].sum() + 1.0))

    def gain(own):
        return grad[own].sum() ** 2 / (hess[own].sum() + 1.0)

    def split(own, depth):
        best = (1e-6, None)
        if depth:
            for j in range(x.shape[1]):
                for cut in np.unique(x[own, j])[:-1]:
                    low = own & (x[:, j] <= cut)
                    won = gain(low) + gain(own & ~low) - gain(own)
                    if won > best[0]:
                        best = (won, (j, int(cut), low))
        if best[1] is None:
            return value(own)
        j, cut, low = best[1]
        return (j, cut, split(low, depth - 1), split(own & ~low, depth - 1))

    return split(np.ones(len(x), dtype=bool), depth)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fitting: np.ndarray) -> Trees | None:
    """Trees for chances of y (share of ``weight``); the rest of the rows calibrates the threshold."""
    found_ = float((y * weight).sum())
    if found_ < MIN_FOUND or not fitting.any() or fitting.all():
        return None
    prior = float(np.clip((y * weight)[fitting].sum() / weight[fitting].sum(), 0.01, 0.99))
    model = Trees(float(np.log(prior / (1 - prior))), [], float("inf"))
    xf, yf, wf = x[fitting], y[fitting], weight[fitting]
    total = np.full(len(xf), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(xf, wf * (yf - p), wf * p * (1 - p), DEPTH)
        model.trees.append(tree)
        total += _walk(tree, xf)
    score = model.total(x[~fitting])
    order = np.argsort(-score, kind="stable")
    hits, all_ = np.cumsum((y * weight)[~fitting][order]), np.cumsum(weight[~fitting][order])
    ends = np.flatnonzero(np.diff(score[order], append=-np.inf) != 0)
    good = [k for k in ends if hits[k] >= PRECISION * all_[k] and hits[k] >= MIN_FOUND / 2]
    if not good:
        return None
    model.threshold = float(score[order][good[-1]]) - 1e-9
    return model


def fit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict[str, Trees]:
    """One model per kind that a bounded sample of documents has enough of."""
    ids = df.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample_docs).distinct()
    # at most sample_docs ids: bounded, so they may be broadcast
    sample = df.select(id_col, text_col).join(F.broadcast(ids), id_col, "left_semi")
    rows = read(sample, text_col, id_col)
    each = rows.select(F.pmod(F.xxhash64(id_col), F.lit(2)).alias("half"), *KINDS, F.explode("candidates").alias("c"))
    vectors = (each.groupBy("half", *(F.col("c.f")[f].alias(f) for f in FEATURES),
                            *((F.col("c")[k] | _overlaps(F.col(k), F.col("c"))).alias(f"is_{k}") for k in KINDS))
               .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *FEATURES).limit(SAMPLE_ROWS).collect())
    if not vectors:
        return {}
    x = np.array([[r[f] or 0 for f in FEATURES] for r in vectors], dtype=np.int64)
    weight = np.array([r["n"] for r in vectors], dtype=float)
    fitting = np.array([r["half"] == 0 for r in vectors])
    models = {k: boost(x, np.array([bool(r[f"is_{k}"]) for r in vectors], dtype=float), weight, fitting) for k in KINDS}
    return {k: m for k, m in models.items() if m}


def find(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", models: dict[str, Trees] | None = None) -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end), by kind as listed and then start."""
    models = fit(df, text_col, id_col) if models is None else models
    rows = read(df, text_col, id_col)
    sorted_kind = "array<struct<kind: int, start: int, end: int>>"

    def as_kind(k: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"),
                                                     s["end"].alias("end")))

    base = F.concat(*(as_kind(k, F.col(k)) for k in KINDS))
    rows = rows.select(id_col, "candidates", base.alias("_base"))
    clear = F.filter("candidates", lambda c: ~_overlaps(F.col("_base"), c))
    rows = rows.select(id_col, "_base", clear.alias("_clear"))

    def accepted(model: Trees) -> Column:
        return F.filter("_clear", lambda c: model.column(c["f"]) >= model.threshold)

    more = [as_kind(k, accepted(m)) for k, m in models.items()]
    rows = rows.select(id_col, "_base", F.sort_array(F.concat(F.col("_base"), *more)).cast(sorted_kind).alias("_all"))

    def named(spans: str) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.transform(spans, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"),
                                                     s["end"].alias("end")))

    return rows.select(id_col, named("_base").alias("base"), named("_all").alias("spans"))


def report(df: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans as text."""
    def written(col: str) -> Column:
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return find(df).select("doc_id", *(number(k).alias(f"n_{k}") for k in KINDS),
                           F.sha2(written("base").cast("binary"), 256).alias("base_sha256"),
                           written("spans").alias("spans"))
