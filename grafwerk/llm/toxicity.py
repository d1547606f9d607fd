"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the presence of its words (and their first letters), its word pairs
and its pairs with one word left out, hashed into ``2 ** BITS`` places.  FTRL-proximal keeps two sums for each place (per-
coordinate learning rates) and an L1 term that leaves most weights at exactly zero; only the
others are broadcast, as sorted places and weights (at most ``2 ** BITS``).

The fit sees at most ``FIT_ROWS`` labelled rows, half of them toxic: those with the smallest hash
of their id among rows that are not held out.  Their features go to the driver, and the bias is
set back to the share of toxic rows among all labels.  Every whole text is scored.

Defined cases: null or empty texts have no features and get the score of the bias; rows with
several labels count as toxic if one of them says so; without labels every score is 0; repeated rows have
equal scores; very long texts are read whole; an empty table gives none; further columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafwerk.llm.common import held_out, small_batches, texts_as_str

#: Labelled rows that the fit may see.
FIT_ROWS = 6000
BITS = 20
#: FTRL-proximal: learning rate, its offset, L1 and L2; passes over the rows.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1.5, 0.5, 4
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are features too, and words whose hashes a worker remembers.
STEMS = (4, 5)
_MEMORY = 1 << 18
_rows: dict[str, int] = {}
_table = np.zeros((_MEMORY, 1 + len(STEMS)), np.uint64)


def _hashes(word: str) -> list[int]:
    parts = [word, *(f"{word[:n]}~" if len(word) > n else word for n in STEMS)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) + 1 for p in parts]


def _remember(words: list[str]) -> None:
    for w in words:
        if w not in _rows:
            _table[len(_rows)] = _hashes(w)
            _rows[w] = len(_rows)


def _word_hashes(text: str) -> np.ndarray:
    """A row for each word: its hash and those of its beginnings."""
    words = _WORD.findall(text.lower())
    try:
        at = np.fromiter(map(_rows.__getitem__, words), np.int64, len(words))
    except KeyError:
        fresh = [w for w in set(words) if w not in _rows]
        if len(_rows) + len(fresh) > _MEMORY:
            _rows.clear()
            fresh = list(set(words))
        if len(fresh) > _MEMORY:
            return np.array([_hashes(w) for w in words], np.uint64)
        _remember(fresh)
        at = np.fromiter(map(_rows.__getitem__, words), np.int64, len(words))
    return _table[at]


def features(text: str) -> np.ndarray:
    """Places of a text's features, with repeats."""
    table = _word_hashes(text)
    h = table[:, 0]
    golden, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    parts = [table.ravel() * golden]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            parts.append((h[:-gap] * np.uint64(salt) + h[gap:]) * golden)
    return (np.concatenate(parts) >> shift).astype(np.int64)


@dataclass(frozen=True)
class Model:
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out


def fit(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """rows: distinct places of each document."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    last = 1 << BITS  # the bias, without L1

    def weight(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == last, 0.0, L1)
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(epochs if rows else 0):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], last)
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weight(np.arange(last + 1))
    places = np.flatnonzero(every[:last])
    return Model(float(every[last]) if rows else -50.0, places, every[places].astype(np.float32))


_ROWS_SCHEMA = "doc_id long, toxic int, places binary"
_ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("places", pa.binary())])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [np.unique(features(t)).astype(np.int32).tobytes() for t in texts_as_str(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(places, pa.binary())], schema=_ROWS_ARROW)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the texts and labels of rows that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    there = dict(known.groupBy("__toxic").count().collect())
    half = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = half.where("__toxic = 1").limit(fit_rows // 2).unionByName(half.where("__toxic = 0").limit(fit_rows // 2))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "__toxic", "text")  # fit_rows rows
    found = sorted((d, bytes(p), t) for d, t, p in rows.mapInArrow(_featurise, _ROWS_SCHEMA).collect())
    toxic = sum(t for _, _, t in found)
    model = fit([np.frombuffer(p, np.int32) for _, p, _ in found], [t for _, _, t in found])
    if 0 < toxic < len(found) and there.get(0) and there.get(1):  # back to the share of toxic rows among all
        model = replace(model, bias=model.bias + float(np.log(there[1] / there[0] * (len(found) - toxic) / toxic)))
    return model


def _scored(schema: pa.Schema, model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        dense = known.dense()
        for batch in batches:
            index = {n: i for i, n in enumerate(batch.schema.names)}
            margin = []
            for text in texts_as_str(batch.column(index["text"])):
                at = features(text)
                at = np.unique(at[dense[at] != 0])
                margin.append(known.bias + float(dense[at].sum(dtype=np.float64)))
            score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            made = {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(index[n]).cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def score_toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all unless given) and score, predicted."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    out = T.StructType([T.StructField(n, docs.schema[n].dataType) for n in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    return source.mapInArrow(_scored(to_arrow_schema(out), spark.sparkContext.broadcast(model)), out)
