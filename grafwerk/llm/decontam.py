"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in a plain form: lower case, with every run of blanks and punctuation (of ASCII,
Latin-1 and the general and CJK punctuation blocks) as one blank.  An item of n characters may differ in ``k = n * ERROR_PERCENT // 100`` edits.
Cut into ``k + 1`` pieces, one of them is found unchanged in every text that holds the item with
at most k edits.  One Aho-Corasick automaton finds all pieces of all items in one pass over a
text; every hit is verified with Myers' bit-parallel distance over the window where the item can
lie.  Nothing is shuffled.

The benchmark is broadcast in slices of at most ``SLICE_CHARS`` characters, one pass over the
documents for each, so the broadcast has a fixed bound.

Defined cases: null or empty texts and items match nothing; items of fewer than ``MIN_CHARS``
characters must occur unchanged between word boundaries; items with one plain form are all reported;
further columns pass through; an empty benchmark contaminates nothing; repeated rows have equal results; very
long texts are searched whole; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafwerk.llm.common import fresh, small_batches, store, texts_as_str

ERROR_PERCENT, MIN_CHARS = 6, 32
SLICE_CHARS = 8_000_000

#: Characters that count as blanks.
_ASCII_BLANKS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_OTHER_BLANKS = re.compile("[\x80-\xbf\u2000-\u206f\u3000-\u303f]")


def plain(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = _OTHER_BLANKS.sub(" ", text)
    return b" ".join(text.encode("utf-8", "replace").translate(_ASCII_BLANKS).split()).decode()


def budget(item: str) -> int:
    return len(item) * ERROR_PERCENT // 100 if len(item) >= MIN_CHARS else 0


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about the same length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(pattern_masks: dict[str, int], length: int, text: str) -> int:
    """The least edit distance of the pattern to any substring of ``text``."""
    every, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = every, 0, length, length
    get = pattern_masks.get
    for c in text:
        eq = get(c, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | ~(d0 | plus) & every, plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = up << 1 & every
        plus, minus = (down << 1 & every) | ~(d0 | up) & every, up & d0
    return best


class Matcher:
    """Finds the items of a slice in plain texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, p, budget(p)) for i, t in items if (p := plain(t))]
        self.masks = [masks(p) for _, p, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for at, (_, p, errors) in enumerate(self.items):
            for place, piece in pieces(p, errors):
                found.setdefault(piece, []).append((at, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """item id -> least distance, of the items within their budget."""
        if not self.items or not text:
            return {}
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for at, place in where:
                _, p, errors = self.items[at]
                first = end + 1 - length - place
                a, b = max(0, first - errors), first + len(p) + errors
                own = windows.setdefault(at, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                    own[-1][0] = min(own[-1][0], a)
                else:
                    own.append([a, b])
        out: dict[int, int] = {}
        for at, own in windows.items():
            item, p, errors = self.items[at]
            for a, b in own:
                if errors:
                    distance = least_distance(self.masks[at], len(p), text[a:b])
                elif len(p) < MIN_CHARS:
                    distance = 0 if f" {p} " in f" {text} " else 1
                else:
                    distance = 0
                if distance <= errors:
                    out[item] = min(distance, out.get(item, distance))
                    if not distance:
                        break
        return out


def _marked(schema: pa.Schema, items, into: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value)
        for batch in batches:
            index = {n: i for i, n in enumerate(batch.schema.names)}
            hits = [sorted(matcher.find(plain(t)).items()) for t in texts_as_str(batch.column(index["text"]))]
            made = {into[0]: pa.array([[i for i, _ in f] for f in hits], pa.list_(pa.int64())), into[1]: pa.array([[d for _, d in f] for f in hits], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(index[n]).cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Columns ``keep`` (all unless given) and contaminated (boolean), items (ids, ascending),
    edits (the least distance of each)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    made = ("contaminated", "items", "edits")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    every, least, found, edited, paired = (fresh(n, docs.columns) for n in ("every", "least", "found", "edited", "paired"))
    held = docs.select(*dict.fromkeys([*keep, "text"]))
    known = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    slices = max(1, -(-(known.agg(F.sum(F.length("text"))).first()[0] or 0) // slice_chars))
    items, edits = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<int>)")
    for number in range(slices):
        part = known if slices == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == number)
        part = spark.sparkContext.broadcast(sorted(map(tuple, part.collect())))  # about slice_chars characters
        fields = [T.StructField(f.name, f.dataType) for f in held.schema] + [T.StructField(found, T.ArrayType(T.LongType())), T.StructField(edited, T.ArrayType(T.IntegerType()))]
        schema = T.StructType([f for f in fields if f.name not in (every, least)] + [f for f in fields if f.name in (every, least)])
        held = held.select(*[f.name for f in schema if f.name not in (found, edited)]).mapInArrow(_marked(to_arrow_schema(schema), part, (found, edited)), schema)
        if slices > 1:
            before = (every in held.columns) and (F.col(every), F.col(least)) or (items, edits)
            held = held.withColumns({every: F.concat(before[0], found), least: F.concat(before[1], edited)}).drop(found, edited)
            held = store(held, "decontaminated") if number % 8 == 7 else held
    if slices > 1:
        pairs = F.sort_array(F.arrays_zip(F.col(every).alias("i"), F.col(least).alias("e")))
        held = held.withColumn(paired, pairs).withColumns({found: F.col(f"{paired}.i"), edited: F.col(f"{paired}.e")})
    return held.select(*keep, (F.size(found) > 0).alias("contaminated"), F.col(found).alias("items"), F.col(edited).alias("edits"))


def brute_force(text: str | None, items: list[tuple[int, str]]) -> dict[int, int]:
    """Plain dynamic programming for tests: item id -> least distance within its budget."""
    text, out = plain(text), {}
    for item, raw in items:
        p = plain(raw)
        if not p:
            continue
        if len(p) < MIN_CHARS:
            if f" {p} " in f" {text} ":
                out[item] = 0
            continue
        row, best = list(range(len(p) + 1)), len(p)
        for c in text:
            last, row[0] = row[0], 0
            for i, x in enumerate(p, 1):
                last, row[i] = row[i], min(last + (c != x), row[i] + 1, row[i - 1] + 1)
            best = min(best, row[-1])
        if text and best <= budget(p):
            out[item] = best
    return out
