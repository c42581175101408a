"""Quality classifier: a sparse rule ensemble.

Statistics of each whole text go into shallow boosted trees; every path of a tree from its root is a
conjunctive rule; lasso logistic regression weighs the rules and leaves few; those are compiled into
Spark column expressions, which score all documents without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

STATS = ("log_words", "word_length", "upper", "digits", "marks", "symbols", "bars", "exclaims", "white", "high", "distinct", "repeats", "top_word", "long_words", "line_words", "same_lines", "sentence")
#: No more labelled rows than this are taken for fitting, those with the least hash of their id.
FIT_ROWS = 20_000


def _classes() -> np.ndarray:
    out = np.zeros((256, 8))
    for c in range(256):
        ch = chr(c)
        out[c] = [65 <= c <= 90, 48 <= c <= 57, ch in ".,;:'\"()-?", ch in "#$%&*@^~<>{}[]\\/=+_`", ch == "|", ch == "!", ch in " \t\n\r\x0b\x0c", c >= 128]
    return out


def statistics(text: bytes, classes: np.ndarray) -> list[float]:
    """Of a whole text, in the order of STATS; all zero for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ classes / len(text)).tolist()
    words = text.split()
    n = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    letters = sum(map(len, words))
    return [np.log1p(len(words)), letters / n, *shares, len(counts) / n, sum(map(eq, words, words[1:])) / n, max(counts.values(), default=0) / n, sum(len(w) > 20 for w in words) / n, min(200.0, n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), min(200.0, n / max(1, stops))]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, one double for each of STATS) for each row of docs."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        classes = _classes()
        for batch in batches:
            m = np.array([statistics(t, classes) for t in text_bytes(batch.column(1))], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(m[:, i])) for i in range(len(STATS)))], names=["id", *STATS])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATS))


#: A rule is a tuple of conditions (statistic's index, True for >, threshold).
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The probability of label 1, as an expression over the columns STATS."""
        total: Column = F.lit(self.bias)
        for rule, weight in self.rules:
            hold: Column = F.lit(True)
            for k, above, t in rule:
                hold = hold & ((F.col(STATS[k]) > F.lit(t)) if above else (F.col(STATS[k]) <= F.lit(t)))
            total = total + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], allowed: np.ndarray, depth: int, path: Rule, rules: set, out: np.ndarray) -> None:
    """Splits rows by the best gain of the boosting objective, and gathers the path to each node."""
    best = (1e-6, -1, 0.0)
    if depth:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for k in allowed:
            if not len(cuts[k]):
                continue
            slot = np.searchsorted(cuts[k], x[rows, k], side="left")  # x <= cuts[slot]
            lg, lh, ln = (np.cumsum(np.bincount(slot, weights=w, minlength=len(cuts[k]) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
            gain[(ln < 20) | (len(rows) - ln < 20)] = -1
            if gain.max() > best[0]:
                best = (float(gain.max()), int(k), float(cuts[k][int(gain.argmax())]))
    if best[1] < 0:
        out[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    _, k, t = best
    low = x[rows, k] <= t
    for part, above in ((rows[low], False), (rows[~low], True)):
        longer = (*path, (k, above, t))
        rules.add(tuple(sorted(longer)))
        _grow(x, g, h, part, cuts, allowed, depth - 1, longer, rules, out)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 5) -> RuleModel:
    """Trees by gradient boosting on random halves of rows and statistics; then lasso logistic weights of all paths by accelerated proximal gradient.

    Without rows the score is 0.5 everywhere; with one class, its smoothed share.
    """
    n, share = len(y), (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if n < 40 or y.min() == y.max():
        return RuleModel(bias, [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 66)[1:-1])) for k in range(x.shape[1])]
    margin, rules = np.full(n, bias), set()
    for _ in range(trees):
        p = _sigmoid(margin)
        step = np.zeros(n)
        rows = np.sort(rng.permutation(n)[: max(40, n // 2)])
        allowed = np.sort(rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)])
        _grow(x, p - y, p * (1 - p), rows, cuts, allowed, depth, (), rules, step)
        margin += 0.3 * step
    found = sorted(rules)
    r = np.ones((n, len(found)), np.float32)
    for i, rule in enumerate(found):
        for k, above, t in rule:
            r[:, i] *= (x[:, k] > t) if above else (x[:, k] <= t)
    support = r.mean(0)
    usual = np.maximum(np.sqrt(support * (1 - support)), 0.05)
    r = (r - support) / usual
    rate = 4 * n / (np.linalg.norm(r, 2) ** 2 + n)
    w = look = np.zeros(len(found))
    b, turn = bias, 1.0
    for _ in range(steps):
        slope = _sigmoid(r @ look + b) - y
        new = look - rate * (r.T @ slope) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        b -= float(slope.mean())
        turn, old = (1 + np.sqrt(1 + 4 * turn * turn)) / 2, turn
        look, w = new + (old - 1) / turn * (new - w), new
    kept = np.flatnonzero(w)
    weights = w / usual
    return RuleModel(float(b - (weights * support).sum()), [(found[i], float(weights[i])) for i in kept])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, use: Column | None = None) -> RuleModel:
    """A model of labels (id_col, label_col: 0 or 1) fitted on at most fit_rows labelled documents for which use holds.

    Null and other labels are ignored; of an id labelled twice the greater counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = (known if use is None else known.where(use)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("id")), "id", "left_semi")  # at most fit_rows ids
    rows = with_statistics(own, "id", "text").join(F.broadcast(known), "id").orderBy("id", *STATS).collect()
    return fit_rules(np.array([[r[s] for s in STATS] for r in rows]).reshape(-1, len(STATS)), np.array([r["y"] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, the statistics, score double, predicted int) for each row of docs. Null texts score as empty ones, whose statistics are all zero; repeated rows are kept; an empty table gives no rows. Extra columns are ignored."""
    scored = with_statistics(docs, id_col, text_col).withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows that score below threshold; each row is judged by its own text, whatever its id. Null texts score as empty ones; an empty table gives no rows."""
    at, columns = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        classes = _classes()
        for batch in batches:
            m = np.array([statistics(t, classes) for t in text_bytes(batch.column(at))], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(m[:, i])) for i in range(len(STATS)))], names=[*columns, *STATS])

    fields = [*(f"{n} {f.dataType.simpleString()}" for n, f in zip(columns, docs.schema.fields, strict=True)), *(f"{s} double" for s in STATS)]
    scored = docs.toDF(*columns).mapInArrow(run, ", ".join(fields))
    return scored.where(model.score() >= threshold).select(*(F.col(n).alias(c) for n, c in zip(columns, docs.columns, strict=True)))
