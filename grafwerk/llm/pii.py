"""Personal data by candidate gradient boosting, in built-in SQL functions only.

*Base* spans are the validated matches of four fixed patterns; they are always selected.
High-recall generators propose further, overlapping candidates (obfuscated addresses, local
phone formats, digit groups that fail a check sum).  Each candidate has a few small integer
features of its format and its context, none of which tells whether the base pattern matches: how
an address spells its at sign and whether a number begins with a plus aren't among them.

Labels are positive and unlabelled.  A candidate over a base span of its kind is positive; one over
a base span of another kind only is negative; all others are unlabelled, and count as negative with the
weight ``UNLABELLED``.  The trees are fitted to the counts by (features, label, half): one aggregation over
all candidates of all documents whose result has at most as many rows as there are feature
combinations, however large the input.  The trees see one half of the texts (by hash), and the thresholds are
calibrated on the other: among groups of equal margins, from the best on, a kind's threshold lies after the last
group before the first whose share of positives falls below ``SHARE``.  Unlabelled candidates over
the threshold that overlap no base span and no better candidate are added.  So a form that occurs unlabelled
more than about (1 - SHARE) / SHARE / UNLABELLED times as often as labelled with like features is not added.

Positions come from splitting at a pattern: the lengths of the pieces and of the matches add up
to code point offsets.  Running sums and maxima are taken in blocks, so that a text with very many matches
costs little more than in proportion.  Patterns use possessive quantifiers and anchors at the start of
a run, so that a long run of one character class is scanned once.

Defined cases: null text is empty; documents without matches have empty span strings; further
columns pass through, whatever their names (those that this adds are replaced); repeated rows stay and have
equal results; very long texts are scanned whole; an empty table gives no rows (and a model that adds nothing).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which spans at one start are listed.
KINDS = ("email", "ip", "card", "phone")

#: Patterns for the base matches, with the same leftmost matches as
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: card [0-9]([\x20-]?[0-9])+ and phone \+[0-9][\x20().0-9-]+[0-9].
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this can't have a match.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: Generators of candidates; their matches may overlap each other and the base spans.
GENERATORS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}(?: ?@ ?| ?[(\[]at[)\]] ?)[A-Za-z0-9-]{1,40}(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]{1,24}){1,5}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])[+(]?[0-9][0-9 ().-]{6,20}[0-9]",
}
GENERATOR_NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}

#: Words that announce each kind, looked for in the characters before a candidate.
CONTEXT_WORDS = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)address|server|host|login|\bip\b",
    "card": r"(?i)card|visa|credit|debit|pay",
    "phone": r"(?i)call|phone|tel|fax|mobile|contact",
}
CONTEXT_CHARS = 24

FEATURES = ("kind", "digits", "separators", "before", "after", "context", "length")

#: Boosting: trees and shrinkage; the weight of an unlabelled candidate as a negative, and the least share of
#: positives in a group of equal margins that is still accepted.
TREES, SHRINKAGE, UNLABELLED, SHARE = 24, 0.3, 0.25, 0.5

#: Elements of a block of a running sum, and candidates on either side among which a better one is looked for: more
#: can't overlap, since candidates have 5 to ``REACH`` characters and those of a kind don't overlap.
BLOCK, REACH = 64, 300
AROUND = 4 * (2 * REACH // 5)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, least: int, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running sums or maxima of an array of longs, in blocks."""
    zero = F.lit(least).cast("long")
    block = lambda v, b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
    numbers = lambda v: F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int"))

    def before(v: Column) -> Column:
        sums = F.transform(numbers(v), lambda b: F.aggregate(block(v, b), zero, join))
        start = F.struct(zero.alias("at"), F.expr("cast(array() as array<long>)").alias("out"))
        return F.aggregate(sums, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def within(v: Column, first: Column, b: Column) -> Column:
        return _let(block(v, b), lambda part: F.transform(part, lambda _, i: F.aggregate(F.slice(part, F.lit(1), i + 1), F.get(first, b), join)))

    done = lambda v: _let(before(v), lambda first: F.flatten(F.transform(numbers(v), lambda b: within(v, first, b))))
    return _let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(done(v)))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, left, right) of the leftmost non-overlapping matches."""

    def located(x: Column) -> Column:
        found, pieces = x["m"], x["p"]

        def one(end: Column, i: Column) -> Column:
            match = F.get(found, i)
            return F.struct(
                (end - F.length(match)).cast("int").alias("start"), end.cast("int").alias("end"), match.alias("match"),
                F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)).alias("left"), F.left(F.get(pieces, i + 1), F.lit(1)).alias("right"),
            )

        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("long"))
        return F.transform(running(steps, 0, lambda a, b: a + b), one)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), located)


def overlapping(spans: Column, others: Column) -> Column:
    """For each span, whether it overlaps one of others; both are arrays by start, with start and end (long)."""
    far = -(2**62)
    row = lambda side: lambda s: F.struct(s["start"].alias("start"), F.lit(side).alias("side"), s["end"].alias("end"))

    def flags(u: Column) -> Column:
        ends = running(F.transform(u, lambda x: F.when(x["side"] == 0, x["end"]).otherwise(F.lit(far))), far, _larger)
        starts = running(F.reverse(F.transform(u, lambda x: F.when(x["side"] == 0, -x["start"]).otherwise(F.lit(far)))), far, _larger)
        both = _let(F.struct(ends.alias("e"), F.reverse(starts).alias("s")), lambda k: F.transform(u, lambda x, i: F.when(x["side"] == 1, (F.get(k["e"], i) > x["start"]) | (-F.get(k["s"], i) < x["end"]))))
        return F.filter(both, lambda x: x.isNotNull())

    alone = F.transform(spans, lambda s: F.lit(False))
    return F.when(F.size(others) == 0, alone).otherwise(_let(F.sort_array(F.concat(F.transform(others, row(0)), F.transform(spans, row(1)))), flags))


SPAN_TYPE = "array<struct<start:int,end:int,match:string,left:string,right:string>>"


def _guarded(text: Column, possible: Column, pattern: str) -> Column:
    return F.when(possible, _matches(text, pattern)).otherwise(F.expr(f"cast(array() as {SPAN_TYPE})"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """For up to 19 digits."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for place in range(20):
        digit = F.ascii(F.substring(padded, 20 - place, 1)) - 48
        total = total + (digit if place % 2 == 0 else digit * 2 - F.when(digit > 4, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    digits = _digits(match)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def _validity(kind: str):
    return lambda s: _valid(kind, s["match"])


def _numbered(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def with_base(docs: DataFrame) -> DataFrame:
    """(row, text, base): the columns as a struct, and an array of (start, kind, end), sorted; kind as a number."""
    docs = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    digits = text.rlike("[0-9]")
    parts = []
    for number, kind in enumerate(KINDS):
        possible = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else F.lit(True)
        if kind != "email":
            possible = digits & possible
        found = F.filter(_guarded(text, possible, BASE_PATTERNS[kind]), _validity(kind))
        parts.append(F.transform(found, _numbered(number)))
    return docs.withColumn("base", F.sort_array(F.concat(*parts)))


def _side(char: Column) -> Column:
    return F.when(F.coalesce(char, F.lit("")) == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"[\p{L}0-9]"), 2).otherwise(3)


def _features(kind: int, s: Column) -> list[Column]:
    """Small integers, in the order of FEATURES."""
    match = s["match"]
    n = F.length(_digits(match))
    marks = F.regexp_replace(match, "[A-Za-z0-9+()@]+", "")
    size = F.length(F.regexp_replace(match, r" ?[(\[](?:at|dot)[)\]] ?", "."))
    other = "|".join(f"(?:{w})" for k, w in CONTEXT_WORDS.items() if k != KINDS[kind])
    spelled = KINDS[kind] == "email"
    return [
        F.lit(kind),
        F.lit(0) if spelled else F.when(n < 7, 1).when(n < 9, 2).when(n < 13, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        F.lit(0) if spelled else F.when(marks == "", 0).when(marks.rlike("^ +$"), 1).when(marks.rlike("^-+$"), 2).when(marks.rlike(r"^\.+$"), 3).otherwise(4),
        _side(F.right(s["left"], F.lit(1))),
        _side(s["right"]),
        F.when(s["left"].rlike(CONTEXT_WORDS[KINDS[kind]]), 2).when(s["left"].rlike(other), 1).otherwise(0),
        F.when(size < 8, 0).when(size < 12, 1).when(size < 20, 2).when(size < 40, 3).otherwise(4),
    ]


#: Labels of candidates.
FREE, OTHER, OWN = 0, 1, 2


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _candidate(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *[f.cast("int").alias(n) for n, f in zip(FEATURES, _features(kind, s))])


def _apart(s: Column) -> Column:
    """Ends of a span on a line where spans of different kinds lie far apart."""
    far = s["kind"].cast("long") * F.lit(2**32)
    return F.struct((far + s["start"]).alias("start"), (far + s["end"]).alias("end"))


def _labelled(base: Column):
    def labelled(cand: Column) -> Column:
        """``cand`` is ordered by kind, then by start."""
        wide = lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))
        by_start = F.sort_array(F.transform(cand, lambda s, i: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), i.alias("i"))))
        hit = _let(by_start, lambda at: _let(overlapping(at, F.transform(base, wide)), lambda flags: F.transform(F.filter(at, lambda s, j: F.get(flags, j)), lambda s: s["i"])))
        own = overlapping(F.transform(cand, _apart), F.array_sort(F.transform(base, _apart)))

        def one(k: Column) -> Column:
            label = lambda i: F.when(F.get(k["own"], i), OWN).when(F.get(k["any"], i), OTHER).otherwise(FREE)
            return F.transform(cand, lambda s, i: s.withField("label", label(i)))

        # positions of the overlapping candidates, turned into a flag for each candidate
        flagged = _let(F.sort_array(hit), lambda h: F.when(F.size(h) == 0, F.transform(cand, lambda s: F.lit(False))).otherwise(overlapping(F.transform(cand, lambda s, i: F.struct(i.cast("long").alias("start"), (i + 1).cast("long").alias("end"))), F.transform(h, lambda x: F.struct(x.cast("long").alias("start"), (x + 1).cast("long").alias("end"))))))
        return F.when(F.size(base) == 0, F.transform(cand, lambda s: s.withField("label", F.lit(FREE)))).otherwise(_let(F.struct(own.alias("own"), flagged.alias("any")), one))

    return labelled


def with_candidates(based: DataFrame) -> DataFrame:
    """Adds ``cand``: array of (start, end, features, label) of all generators."""
    text = F.col("text")
    parts = [F.transform(_guarded(text, text.rlike(GENERATOR_NEEDS[kind]), GENERATORS[kind]), _candidate(number)) for number, kind in enumerate(KINDS)]
    return based.withColumn("cand", _let(F.concat(*parts), _labelled(F.col("base"))))


@dataclass(frozen=True)
class Model:
    """For each kind: a bias, boosted trees of depth two over small integers, and a threshold."""

    biases: tuple[float, ...]
    #: For each kind, (feature, cut, left, right) where a side is (feature, cut, value, value).
    trees: tuple[tuple[tuple[int, int, tuple, tuple], ...], ...]
    thresholds: tuple[float, ...]

    def margin_sql(self, name: str) -> str:
        """SQL for the margin of a candidate called ``name``, null for kinds that add nothing."""
        leaf = lambda t: f"CASE WHEN {name}.{FEATURES[t[0]]} <= {t[1]} THEN {t[2]!r}D ELSE {t[3]!r}D END"
        tree = lambda t: f"CASE WHEN {name}.{FEATURES[t[0]]} <= {t[1]} THEN {leaf(t[2])} ELSE {leaf(t[3])} END"
        kinds = [f"WHEN {name}.kind = {k} THEN " + " + ".join([f"{self.biases[k]!r}D", *map(tree, self.trees[k])]) for k in range(len(KINDS)) if self.thresholds[k] != math.inf]
        return f"CASE {' '.join(kinds)} END" if kinds else "cast(null as double)"

    def margins(self, kind: int, x: np.ndarray) -> np.ndarray:
        return _margins(self.biases[kind], self.trees[kind], x)


def _margins(bias: float, trees: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), bias)
    for f, cut, a, b in trees:
        sides = [np.where(x[:, t[0]] <= t[1], t[2], t[3]) for t in (a, b)]
        out += np.where(x[:, f] <= cut, *sides)
    return out


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, cut) from histograms of the small integer features."""
    best = (0.0, 0, 0)
    total_g, total_h = grad.sum(), hess.sum()
    for f in range(x.shape[1]):
        bins = int(x[:, f].max(initial=0)) + 1
        g = np.cumsum(np.bincount(x[:, f], grad, bins))[:-1]
        h = np.cumsum(np.bincount(x[:, f], hess, bins))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
        if len(gain) and gain.max() > best[0] + 1e-12:
            best = (float(gain.max()), f, int(gain.argmax()))
    return best


def _grown(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, trees: int, shrinkage: float) -> tuple[float, tuple]:
    """Newton boosting on counts; the rows are distinct feature combinations."""
    count = positive + negative
    share = (positive.sum() + 0.5) / (count.sum() + 1)
    bias = round(float(np.log(share / (1 - share))), 6)
    margin, grown = np.full(len(x), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = positive - p * count, p * (1 - p) * count
        gain, f, cut = _best_split(x, grad, hess)
        if gain <= 0:
            break
        sides = []
        for rows in (x[:, f] <= cut, x[:, f] > cut):
            _, f2, cut2 = _best_split(x[rows], grad[rows], hess[rows])
            values = [round(float(shrinkage * grad[r].sum() / (hess[r].sum() + 1)), 6) for r in (rows & (x[:, f2] <= cut2), rows & (x[:, f2] > cut2))]
            sides.append((f2, cut2, *values))
        grown.append((f, cut, *sides))
        margin = _margins(bias, grown, x)
    return bias, tuple(grown)


def threshold(margins: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The margin of the last group of equal margins before the first with too few positives; a group is taken
    or left as a whole, and groups without rows say nothing."""
    values, group = np.unique(np.round(margins, 5), return_inverse=True)
    p, n = np.bincount(group, positive, len(values)), np.bincount(group, negative, len(values))
    lowest = math.inf
    for k in range(len(values) - 1, -1, -1):
        if p[k] + n[k] == 0:
            continue
        if (p[k] + 0.5) / (p[k] + n[k] + 1) < SHARE or not p[k]:
            break
        lowest = float(values[k]) - 1e-5
    return lowest


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, trees: int = TREES, shrinkage: float = SHRINKAGE) -> Model:
    """x: distinct feature combinations; positive, negative: their counts in the half to grow and the half to calibrate."""
    parts = []
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        if not positive[own, 0].sum():
            parts.append((0.0, (), math.inf))
            continue
        bias, grown = _grown(x[own], positive[own, 0], negative[own, 0], trees, shrinkage)
        parts.append((bias, grown, threshold(_margins(bias, grown, x[own]), positive[own, 1], negative[own, 1])))
    return Model(*zip(*parts))


def train(docs: DataFrame) -> Model:
    """Counts over all candidates of all documents; the driver sees distinct combinations only."""
    found = with_candidates(with_base(docs.select("text"))).select(F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"), F.explode("cand").alias("c"))
    names = [F.col(f"c.{n}") for n in FEATURES]
    counts = [F.count_if((F.col("half") == h) & (F.col("c.label") == k)) for h in (0, 1) for k in (FREE, OTHER, OWN)]
    rows = sorted(tuple(r) for r in found.groupBy(*names).agg(*counts).collect())
    table = np.array(rows, dtype=np.int64).reshape(-1, len(FEATURES) + 6)
    free, other, own = (table[:, len(FEATURES) + k :: 3].astype(float) for k in (FREE, OTHER, OWN))
    return fit(table[:, : len(FEATURES)], own, other + UNLABELLED * free)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    made = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_added"]
    docs = docs.drop(*made)
    model = model or train(docs)
    based = with_base(docs)
    base, added = F.col("base"), F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    if any(t != math.inf for t in model.thresholds):
        limit = "CASE " + " ".join(f"WHEN c.kind = {k} THEN {t!r}D" for k, t in enumerate(model.thresholds) if t != math.inf) + " END"
        scored = F.expr(f"transform(filter(cand, c -> c.label = {FREE}), c -> struct(c.start AS start, c.kind AS kind, c.end AS end, ({model.margin_sql('c')}) AS score, ({limit}) AS least))")
        chosen = F.sort_array(F.filter(scored, lambda c: c["score"] >= c["least"]))
        based = with_candidates(based).withColumn("chosen", chosen)
        better = "d.start < c.end AND c.start < d.end AND (d.score > c.score OR (d.score = c.score AND (d.start < c.start OR (d.start = c.start AND d.kind < c.kind))))"
        around = f"slice(chosen, greatest(i - {AROUND}, 0) + 1, {2 * AROUND + 1})"
        added = F.expr(f"transform(filter(chosen, (c, i) -> NOT exists({around}, d -> {better})), c -> struct(c.start AS start, c.kind AS kind, c.end AS end))")
    based = based.withColumn("added", added)
    counts = [F.size(_of_kind(base, n)).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    every = F.sort_array(F.concat(base, F.col("added")))
    return based.select("row.*", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns, with each selected span of the text replaced by its kind in brackets; spans that
    overlap share one stretch of text, and each leaves its kind where its own part begins."""
    found = find_pii(docs, model)
    listed = found.select(F.struct("*").alias("row"), F.col("text"), F.filter(F.split("spans", ","), lambda x: x != "").alias("listed"))
    spans = F.transform("listed", lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"), F.split(x, ":")[0].alias("kind")))
    ends = running(F.transform("spans", lambda s: s["end"]), 0, _larger)

    def piece(s: Column, i: Column) -> Column:
        at = F.when(i == 0, 0).otherwise(F.get(F.col("ends"), i - 1))
        blank = F.substr(F.col("text"), at + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.concat(blank, F.when(s["end"] > at, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))

    rest = F.substr(F.col("text"), F.element_at("ends", -1) + 1, F.length("text"))
    done = listed.withColumn("spans", spans).withColumn("ends", ends)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), rest))
    return done.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def brute_force_base(text: str | None) -> list[tuple[int, int, int]]:
    """Plain Python for tests: (start, kind, end) of the base spans."""
    import re

    text = text or ""
    plain = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]

    def good(kind: int, found: str) -> bool:
        digits = [int(c) for c in found if c.isascii() and c.isdigit()]
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        if kind == 2:
            odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            return 12 <= len(digits) <= 19 and odd % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), kind, m.end()) for kind, p in enumerate(plain) for m in re.finditer(p, text) if good(kind, m[0]))
