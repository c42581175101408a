"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(cut_k - w . x): one vector of weights, shared by ordered cuts. x counts, for
each hashed feature, the distinct words of the whole text that have it; a word's features are itself
and its prefixes of PREFIXES bytes, so that inflected forms share weight. Expected severity is the sum over k
of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, text_bytes

BITS = 20
PREFIXES = (4, 5)
#: No more labelled rows than this are taken for fitting, those with the least hash of their id.
FIT_ROWS = 16_000
GRADES = 4


def word_features(word: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return (crc32(word) & mask, *(crc32(word[:n], n) & mask for n in PREFIXES))


def _fit_features(docs: DataFrame) -> DataFrame:
    """(id, x): of each (id, text) the features of its distinct words, packed as int32."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            blobs = [np.array([f for w in set(t.translate(ALNUM).split()) for f in word_features(w)], np.int32).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "x"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, x binary")


@dataclass
class OrdinalModel:
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, in columns."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - margin[:, None], -30, 30)))


#: Rows that are summed at once while fitting; bounds the driver's memory.
CHUNK_ROWS = 1_000


def _chunks(parts: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end, features and their rows, from the first one on."""
    for at in range(0, len(parts), CHUNK_ROWS):
        some = parts[at : at + CHUNK_ROWS]
        yield at, at + len(some), np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])


def _margins(parts: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0), *(np.bincount(own, weights=w[flat], minlength=b - a) for a, b, flat, own in _chunks(parts))])


def _sums(parts: list[np.ndarray], per_row: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(size)
    for a, b, flat, own in _chunks(parts):
        total += np.bincount(flat, weights=per_row[a:b][own], minlength=size)
    return total


def grades_of(parts: list[np.ndarray], toxic: np.ndarray, grades: int) -> np.ndarray:
    """0 for rows that are not toxic; 1 .. grades - 1 for toxic ones, by equal shares of them in the order of
    how many of their features stand out among toxic rows (the labels have no grades of their own)."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    with_tox, without = (_sums(parts, np.asarray(x, np.float64), 1 << BITS) for x in (toxic, 1 - toxic))
    odds = np.log((with_tox + 0.5) / (n1 + 1)) - np.log((without + 0.5) / (n0 + 1))
    marks = _margins(parts, ((odds > 2) & (with_tox >= 3)).astype(np.float64))
    grade = np.zeros(len(toxic), np.int64)
    rows = np.flatnonzero(toxic == 1)
    order = rows[np.argsort(marks[rows], kind="stable")]
    grade[order] = 1 + np.arange(len(order)) * (grades - 1) // max(1, len(order))
    return grade


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _slopes(grade: np.ndarray, z: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log likelihood: times n by each row's margin, and by each cut."""
    top = len(cuts)
    edge = np.concatenate([[-30.0], cuts, [30.0]])
    a = np.where(grade == top, 1.0, _sigmoid(edge[grade + 1] - z))
    b = np.where(grade == 0, 0.0, _sigmoid(edge[grade] - z))
    p = np.maximum(a - b, 1e-9)
    by_cut = [np.sum((grade == k) * a * (1 - a) / p) - np.sum((grade == k + 1) * b * (1 - b) / p) for k in range(top)]
    return a + b - 1, np.array(by_cut) / len(grade)


def fit_ordinal(parts: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, penalty: float = 5e-4, rate: float = 0.1, steps: int = 120) -> OrdinalModel:
    """Lasso-penalised maximum likelihood by adaptive proximal gradient steps over all rows.

    parts: the features of each row. Features whose slope is within half the penalty before the first
    step are screened out. Without rows, or with one grade, weights are zero and the cuts give the
    smoothed shares of the grades.
    """
    n, tops = len(grade), np.arange(grades - 1)
    share = np.array([(np.sum(grade > k) + 0.5) / (n + 1) for k in tops])
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * tops)
    out = np.zeros(1 << BITS, np.float32)
    if n < 20 or grade.max() == grade.min():
        return OrdinalModel(out, cuts)
    penalty += 3 / n  # a few rows alone give a feature no weight
    first = _sums(parts, _slopes(grade, np.zeros(n), cuts)[0], 1 << BITS) / n
    used = np.flatnonzero(np.abs(first) > penalty / 2)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    parts = [x[x >= 0] for x in (place[x] for x in parts)]
    w, squares, cut_squares = np.zeros(len(used)), np.full(len(used), 1e-12), np.full(grades - 1, 1e-12)
    for _ in range(steps):
        per_row, by_cut = _slopes(grade, _margins(parts, w), cuts)
        slope = _sums(parts, per_row, len(used)) / n
        squares += slope**2
        pace = rate / np.sqrt(squares)
        w = w + pace * slope
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
        cut_squares += by_cut**2
        cuts = np.maximum.accumulate(cuts + rate * by_cut / np.sqrt(cut_squares))
    out[used] = w
    return OrdinalModel(out, cuts)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grades: int = GRADES, fit_rows: int = FIT_ROWS, use: Column | None = None) -> OrdinalModel:
    """A model of labels (id_col, label_col: 0 or 1) fitted on at most fit_rows labelled documents for which use holds.

    Null and other labels are ignored; of an id labelled twice the greater counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = (known if use is None else known.where(use)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known.select("id")), "id", "left_semi")  # at most fit_rows ids
    rows = _fit_features(own).join(F.broadcast(known), "id").orderBy("id", "x").collect()
    parts = [np.frombuffer(r["x"], np.int32) for r in rows]
    toxic = np.array([r["y"] for r in rows], np.int64)
    return fit_ordinal(parts, grades_of(parts, toxic, grades), grades)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(id, severity, p_toxic, grade, toxic) for each row of docs.

    severity is the expected grade, p_toxic = P(grade > 0), grade the likeliest one, toxic whether p_toxic
    is at least `least`. Null and empty texts score as texts without features; repeated rows are kept; an
    empty table gives no rows. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))  # of fixed size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, cuts = shared.value
        weights = weights.astype(np.float64)

        class Known(dict):
            def __missing__(self, word: bytes) -> float:
                if len(self) >= 400_000:
                    self.clear()
                value = self[word] = float(sum(weights[f] for f in word_features(word)))
                return value

        known = Known()
        for batch in batches:
            margin = np.array([sum(sorted(map(known.__getitem__, set(t.translate(ALNUM).split())))) for t in text_bytes(batch.column(1))], np.float64)
            above = OrdinalModel(weights, cuts).above(margin).reshape(len(margin), -1)
            each = np.concatenate([np.ones((len(margin), 1)), above], 1) - np.concatenate([above, np.zeros((len(margin), 1))], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(np.ascontiguousarray(above[:, 0])), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= least)], names=["id", "severity", "p_toxic", "grade", "toxic"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, severity double, p_toxic double, grade int, toxic boolean")
