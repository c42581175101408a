"""Boosted trees: all of them are made, and they are those of a plain version."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from brindle.operators import models


def plain(rows, clicks, trees):
    """Scores of rows (tuples of bins) after boosting; every node tries every split by adding up its rows."""
    start = math.log(sum(clicks) / (len(rows) - sum(clicks)))
    value = [start] * len(rows)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-v)) for v in value]
        g = [round((y - q) * models.UNIT) / models.UNIT for y, q in zip(clicks, p, strict=True)]
        h = [round(q * (1 - q) * models.UNIT) / models.UNIT for q in p]
        nodes = [list(range(len(rows)))]
        for _ in range(models.DEPTH):
            after = []
            for node in nodes:
                sums = lambda at: (sum(g[i] for i in at), sum(h[i] for i in at))
                score = lambda s: s[0] ** 2 / (s[1] + models.LEAF_L2)
                best, sides = 0.0, (node, [])
                for c in range(len(rows[0])):
                    for t in sorted({rows[i][c] for i in range(len(rows))}):
                        two = [i for i in node if rows[i][c] <= t], [i for i in node if rows[i][c] > t]
                        a, b = map(sums, two)
                        if min(a[1], b[1]) >= models.LEAST_CHILD and (gain := score(a) + score(b) - score(sums(node))) > best + 1e-12:
                            best, sides = gain, two
                after += sides
            nodes = after
        for leaf in nodes:
            for i in leaf:
                value[i] += models.STEP * sum(g[j] for j in leaf) / (sum(h[j] for j in leaf) + models.LEAF_L2)
    return value


def test_trees_are_those_of_a_plain_version():
    rng = np.random.default_rng(7)
    rows = [tuple(map(int, r)) for r in np.stack([rng.integers(0, w, 300) for w in (5, 3, 2, 7)], 1)]
    clicks = [int((a + b * c + d) % 3 == 0) for a, b, c, d in rows]
    cells = sorted(set(rows))
    seen, hit = (np.array([sum(w for r, w in zip(rows, ws, strict=True) if r == x) for x in cells], float) for ws in ([1] * 300, clicks))
    got, made = models.boost([np.array([x[c] for x in cells], np.uint8) for c in range(4)], seen, hit, [5, 3, 2, 7], 3)
    want = dict(zip(rows, plain(rows, clicks, 3), strict=True))
    assert len(made) == 3 and np.allclose(got, [want[x] for x in cells], atol=1e-4)


@pytest.mark.parametrize("tasks", [1, 3])
def test_all_trees_are_made(spark, monkeypatch, tasks):
    """Labels that five trees leave near even odds; rows without a label get the score of their columns, and results don't depend on the number of tasks."""
    monkeypatch.setattr(models, "TASK_ROWS", 10_000 if tasks == 1 else 50)
    df = spark.range(4000).selectExpr("id", "IF(id % 10 = 9, -1L, CAST(id % 3 + id % 5 > id % 7 AS BIGINT)) AS label", "id % 3 AS a", "IF(id % 5 = 0, NULL, id % 5) AS b", "id % 7 AS c")
    got = models.spark_ml(df, "gbt", ["a", "b", "c"])
    assert got.columns == [*df.columns, "pred"]
    rows = got.collect()
    assert len(rows) == 4000
    assert all(abs(r.pred - (r.a + (r.b or 0) > r.c)) < 0.1 for r in rows)
    test_all_trees_are_made.seen = old = getattr(test_all_trees_are_made, "seen", {r.id: r.pred for r in rows})
    assert old == {r.id: r.pred for r in rows}


def test_one_class_alone(spark):
    df = spark.range(10).selectExpr("id", "1L AS label", "id AS a")
    assert {r.pred for r in models.spark_ml(df, "gbt", ["a"]).collect()} == {0.5}
