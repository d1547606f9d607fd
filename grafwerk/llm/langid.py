"""Language identification by nearest centroid.

A document's vector holds hashed counts of its letter n-grams (1 to 3 letters, words padded by
a blank), damped, weighted by inverse document frequency and scaled to length one.  Every
language gets several centroids (spherical k-means over its documents of the fit).  A document
takes the language of the centroid with the largest cosine; it is rejected if its distance is
over what that language's own documents showed.  Texts with fewer than ``MIN_GRAMS`` n-grams are far
from every centroid by chance and are rejected only if they have no letter.

The fit sees at most ``FIT_DOCS`` documents a language, those with the smallest hash of their id
among rows with a language that are not held out; their n-gram counts (bounded) go to the driver.

Defined cases: null text or text without a letter is ``und`` with score 0 and rejected; without
any row to learn from everything is ``und``; ties go to the first language in code point order; repeated rows have
equal results; very long texts are read whole; an empty table gives none; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grafwerk.llm.common import held_out, small_batches, texts_as_str

#: Documents a language that the fit may see, and centroids a language.
FIT_DOCS, CENTROIDS, ROUNDS = 400, 3, 8
DIMENSIONS = 4096
#: Steepness of the score, and the room that rejection leaves over the largest distance seen.
STEEPNESS, SLACK = 25.0, 1.1
#: N-grams from which on a distance can reject.
MIN_GRAMS = 400

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return _LETTER


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts; None without a letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = _letters()[codes.astype(np.int64)]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint64(32))
    codes = codes[letter | np.concatenate(([True], letter[:-1]))]  # runs of other characters become one blank
    two = codes[:-1] * np.uint64(0x1FFFFF) + codes[1:]
    three = two[:-1] * np.uint64(0x1FFFFF) + codes[2:]
    grams = np.concatenate((codes, two + np.uint64(1 << 42), three ^ np.uint64(0x5BD1E995 << 31)))
    return np.bincount(((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64), minlength=DIMENSIONS)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    #: One row a centroid, and the number of its language.
    centroids: np.ndarray
    owner: np.ndarray
    #: The largest distance that is not rejected, a language.
    reach: np.ndarray

    def vectors(self, table: np.ndarray) -> np.ndarray:
        return _normal(np.log1p(table) * self.idf)

    def predict(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, score, rejected) of rows of counts."""
        cosine = self.vectors(table) @ self.centroids.T
        best = np.full((len(table), len(self.languages)), -1.0)
        for at, language in enumerate(self.owner):
            best[:, language] = np.maximum(best[:, language], cosine[:, at])
        which = best.argmax(axis=1)
        top = best[np.arange(len(table)), which]
        score = 1 / np.exp(STEEPNESS * (best - top[:, None])).sum(axis=1)
        return which, np.clip(score, 0, 1), (1 - top > self.reach[which]) & (table.sum(axis=1) >= MIN_GRAMS)


def _normal(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row and then the farthest rows."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centers = x[chosen]
    for _ in range(ROUNDS):
        home = (x @ centers.T).argmax(axis=1)
        centers = _normal(np.array([x[home == i].mean(axis=0) if (home == i).any() else centers[i] for i in range(len(centers))]))
    return centers


def fit(tables: dict[str, np.ndarray]) -> Model | None:
    """tables: rows of counts a language."""
    languages = tuple(sorted(k for k, v in tables.items() if len(v)))
    if not languages:
        return None
    every = np.concatenate([tables[k] for k in languages])
    idf = np.log((1 + len(every)) / (1 + (every > 0).sum(axis=0))) + 1
    centroids, owner, reach = [], [], []
    for number, language in enumerate(languages):
        x = _normal(np.log1p(tables[language]) * idf)
        centers = _cluster(x, CENTROIDS)
        centroids.append(centers)
        owner += [number] * len(centers)
        far = (1 - (x @ centers.T).max(axis=1))[tables[language].sum(axis=1) >= MIN_GRAMS]
        reach.append(min(1.0, SLACK * float(far.max(initial=0.0)) + 0.05))
    return Model(languages, idf, np.concatenate(centroids), np.array(owner), np.array(reach))


_COUNTS_SCHEMA = "lang string, at binary, n binary"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(lang, c) for lang, text in zip(batch.column(0).to_pylist(), texts_as_str(batch.column(1))) if (c := counts(text)) is not None]
        at = [np.flatnonzero(c).astype(np.int32) for _, c in rows]
        n = [c[i].astype(np.int32) for (_, c), i in zip(rows, at)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in n], pa.binary())], schema=_COUNTS_ARROW)


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """Learns from text and lang of rows that are not held out."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    # a language may hold any share of the rows: a threshold on the hash leaves about four times as many as are taken
    counts = known.groupBy("lang").agg(F.count("*").alias("held"))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.select("lang", "doc_id").join(F.broadcast(counts), "lang").where(hashed * F.col("held") < 4 * fit_docs)  # a row a language
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = some.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= fit_docs).select("doc_id").distinct()
    sample = known.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.col("lang").cast("string").alias("lang"), "text")  # fit_docs ids a language
    tables: dict[str, list[np.ndarray]] = {}
    for lang, at, n in sorted(map(tuple, sample.mapInArrow(_count_texts, _COUNTS_SCHEMA).collect())):
        row = np.zeros(DIMENSIONS, np.float32)
        row[np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int32)
        tables.setdefault(lang, []).append(row)
    return fit({k: np.array(v) for k, v in tables.items()})


def _labelled(schema: pa.Schema, model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model | None = model.value
        for batch in batches:
            index = {n: i for i, n in enumerate(batch.schema.names)}
            texts = texts_as_str(batch.column(index["text"]))
            lang, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            for first in range(0, len(texts) if known else 0, 256):
                rows = [(first + i, c) for i, t in enumerate(texts[first : first + 256]) if (c := counts(t)) is not None]
                if rows:
                    for (i, _), which, s, r in zip(rows, *known.predict(np.array([c for _, c in rows]))):
                        lang[i], score[i], rejected[i] = known.languages[which], float(s), bool(r)
            made = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(index[n]).cast(schema.field(n).type) for n in schema.names], schema=schema)

    return run


def identify(docs: DataFrame, model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all unless given) and lang_pred, score, rejected."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    model = model or train(docs)
    made = ("lang_pred", "score", "rejected")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    out = T.StructType([T.StructField(n, docs.schema[n].dataType) for n in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return source.mapInArrow(_labelled(to_arrow_schema(out), spark.sparkContext.broadcast(model)), out)
