"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document has hashed features: its words and their first letters, the shapes of its words with the share of words that have them, and its
repetition. One weight per feature gives a score, and ordered thresholds cut the score into grades: the probability of
a grade up to k is the logistic function of threshold k less the score. The model is fitted on a bounded sample of
rated documents; scoring goes over all documents with a table of weights of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweft import storage
from gridweft.llm import tokens

#: Bits of a feature's number; the table of weights has 2**BITS entries.
BITS = 20
#: Rated documents that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 8000
#: Features of these documents that the driver holds, at most.
FEATURES = 16_000_000
#: A feature is used if so many sampled documents have it.
LEAST_DOCS = 6
#: Rounds of the fit, its first step size, which falls to nothing, and the penalty on squared weights.
ROUNDS, RATE, PENALTY = 150, 0.1, 2e-3
#: Bytes at the head of a longer word that are features too.
PREFIXES = (4, 5, 6)

_U, _L, _D = 1, 2, 3
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = _U, _L, _D, _L


def _number(x: np.ndarray, salt: int) -> np.ndarray:
    return (tokens.mixed(x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - BITS)).astype(np.int64)


def _view(words: tokens.Words, data: np.ndarray) -> tokens.Words:
    """The same words over other bytes of the same length."""
    out = object.__new__(tokens.Words)
    out.__dict__.update(words.__dict__, data=data)
    return out


def _pairs(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) with counts."""
    both, n = np.unique(doc << BITS | feature, return_counts=True)
    return both >> BITS, both & (1 << BITS) - 1, n


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, document, feature) of blocks: distinct pairs, sorted by document."""
    for row, data, offsets in tokens.text_blocks(column):
        words = tokens.Words(data, offsets)
        doc = words.doc()
        kinds = _SHAPE[data]
        low = tokens.lowered(data)
        plain = np.where((kinds <= _D) | (data >= 128), low, np.uint8(0))
        lexical = _number(_view(words, plain).hashes(), 1)
        # A shape names each run of one kind once: bytes that repeat their predecessor's kind are left out.
        again = np.append(False, kinds[1:] == kinds[:-1])
        again[words.start] = False
        run = np.cumsum(~again)
        nth = np.minimum(_nth(run, words, len(data)), 15).astype(np.uint64)
        value = np.where(again, np.uint64(0), tokens.mixed(kinds.astype(np.uint64) + np.uint64(512) * nth))
        sums = np.append(np.uint64(0), np.cumsum(value))
        shape = _number(sums[words.end] - sums[words.start], 2)
        total = np.maximum(words.counts, 1)
        parts = []
        d, f, n = _pairs(doc, lexical)
        parts.append((d, f))
        for k, size in enumerate(PREFIXES):
            long = np.flatnonzero(words.end - words.start > size)
            head = plain[words.start[long][:, None] + np.arange(size)].astype(np.uint64)
            code = (head * np.uint64(257) ** np.arange(size, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            parts.append((doc[long], _number(code, 8 + k)))
        rows = np.arange(len(words.counts))
        distinct = np.bincount(d, minlength=len(rows))
        most = np.zeros(len(rows), np.int64)
        np.maximum.at(most, d, n)
        d, f, n = _pairs(doc, shape)
        share = np.floor(np.log2(n / total[d])).astype(np.int64) + 16
        parts.append((d, _number((f * 64 + share).astype(np.uint64), 3)))
        for salt, value in ((4, np.floor(10 * distinct / total)), (5, np.floor(np.log2(total))), (6, np.floor(10 * most / total)), (7, np.floor(np.diff(offsets) / total / 2).clip(0, 15))):
            parts.append((rows, _number(value.astype(np.uint64), salt)))
        d, f, _ = _pairs(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
        yield row, len(rows), d, f


def _nth(run: np.ndarray, words: tokens.Words, size: int) -> np.ndarray:
    """The number of each byte's run within its word."""
    first = np.zeros(size, np.int64)
    if len(words):
        first[words.start] = np.diff(run[words.start], prepend=0)
    return np.maximum(run - np.cumsum(first), 0)


@dataclass
class Model:
    """Weights of features and ordered thresholds between grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def upto(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of a grade up to k, a column for each threshold."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


#: Features of the sample that one step of a round looks at.
STEP = 1 << 20


def fit(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with a small quadratic penalty, by Adam with falling steps over all rows; row i has the next ``sizes[i]`` features."""
    weights = np.zeros(1 << BITS, np.float32)
    n = len(sizes)
    share = np.array([(np.sum(grades <= k) + 0.5) / (n + 1.0) for k in range(n_grades - 1)])
    theta = np.log(share / (1 - share))
    if len(np.unique(grades)) < 2:
        return Model(weights, theta if n else np.full(n_grades - 1, -20.0))
    used = np.flatnonzero(np.bincount(flat, minlength=1 << BITS) >= LEAST_DOCS)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    column = place[flat]
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)[column >= 0]
    column = column[column >= 0]
    steps = [slice(k, k + STEP) for k in range(0, len(row), STEP)]
    v = len(used)
    # Parameters: the weights, the first threshold, and the logarithms of the gaps to the next ones.
    parameters = np.concatenate([np.zeros(v), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    at = np.arange(n)
    thresholds = lambda: np.cumsum(np.append(parameters[v], np.exp(parameters[v + 1 :])))
    for t in range(1, rounds + 1):
        w, theta, s, gradient = parameters[:v], thresholds(), np.zeros(n), np.zeros(len(parameters))
        for k in steps:
            s += np.bincount(row[k], weights=w[column[k]], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -60, 60))), np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        by_s = (slope[at, grades + 1] - slope[at, grades]) / p / n
        by_theta = np.array([np.sum((slope[:, k + 1] / p)[grades == k + 1]) - np.sum((slope[:, k + 1] / p)[grades == k]) for k in range(len(theta))]) / n
        for k in steps:
            gradient[:v] += np.bincount(column[k], weights=by_s[row[k]], minlength=v)
        gradient[:v] += PENALTY * w
        gradient[v] = by_theta.sum()
        gradient[v + 1 :] = [by_theta[k + 1 :].sum() * np.exp(g) for k, g in enumerate(parameters[v + 1 :])]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        parameters = parameters - RATE * (1 - (t - 1) / rounds) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights[used] = parameters[:v]
    return Model(weights, thresholds())


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, n, d, f in features(batch.column(1)):
            cuts = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(f.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(2).slice(row, n), lists], names=["id", "grade", "features"])


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model of ``ratings`` (id, grade from 0): at most ``sample`` rated documents, those with the smallest id hashes.

    Of these the driver holds the first ones with FEATURES features in all. An id rated more than once counts once, with
    its lowest grade, and of rows that share an id the one with the least text; null ids and grades are left out.
    """
    rated = ratings.where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` rows of two numbers: a broadcast of proven size.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    once = rows.groupBy("id", "grade").agg(F.min("text").alias("text")).select("id", "text", "grade")
    lists = storage.Stored(storage.in_few_files(once.mapInArrow(_lists, "id long, grade int, features array<int>")), "quality-sample")
    # A window over ``sample`` rows.
    upto = F.sum(F.size("features")).over(Window.orderBy(F.xxhash64("id"), "id"))
    found = lists.df.withColumn("upto", upto).where(F.col("upto") <= FEATURES).select("id", "grade", "features").toArrow().sort_by("id")
    lists.drop()
    parts = [c for c in found.column("features").chunks if len(c)]
    flat = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in parts)])
    sizes = np.concatenate([np.zeros(0, np.int32), *(c.value_lengths().to_numpy() for c in parts)])
    grades = found.column("grade").to_numpy().astype(np.int64)
    del found, parts
    return fit(flat, sizes, grades, n_grades)


def grade(docs: DataFrame, model: Model, least_grade: int, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """Expected grade and tail probability: (id_col, expected_grade, tail_probability, selected), one row per row.

    tail_probability is that of ``least_grade`` or more; rows of ``threshold`` or more are selected. Null and empty
    texts have the features of a text without words. Rows repeated with the same id are graded on their own, a null id
    is kept, an empty table gives no rows. With ``carry`` the result is ``docs`` with the columns of the grades behind
    its own, which a grade replaces where a name clashes; else other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ["expected_grade", "tail_probability", "selected"]
    kept = [c for c in docs.columns if c not in added] if carry else [id_col]
    source = docs.select(*kept, F.col(text_col).alias("_text")) if text_col not in kept else docs.select(*kept)
    place = len(kept) if text_col not in kept else kept.index(text_col)
    schema = T.StructType([*source.schema.fields[: len(kept)], *(T.StructField(name, T.DoubleType()) for name in added[:2])])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for row, n, d, f in features(batch.column(place)):
                upto = model.upto(np.bincount(d, weights=model.weights[f], minlength=n))
                columns = [*(batch.column(k).slice(row, n) for k in range(len(kept))), pa.array(upto.shape[1] - upto.sum(axis=1)), pa.array(1 - upto[:, least_grade - 1])]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added[:2]])

    return source.mapInArrow(score, schema).withColumn("selected", F.col("tail_probability") >= threshold)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades 0 (toxic), 1 (low quality) and 2 (good) from labels."""
    value = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").alias("id"), value.alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: grades of all documents, and whether they are selected as good."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return grade(docs, train(docs, label_grades(labels), 3), 2)
