"""Boosted-tree dumps: split values, and each feature's expected use and gain, also with a feature held at a value.

A dump lists trees, each after a line with its booster's number: inner nodes as
id:[feature<split] yes=..,no=..,missing=..,gain=..,cover=.. and leaves as id:leaf=..,cover=...
Trees are rows, and each is walked in a task; only sums by feature are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = re.compile(r"(\d+):\[(.+)<([^\]]+)\] yes=(\d+),no=(\d+),.*gain=([^,]+),cover=([^,\s]+)")
LEAF = re.compile(r"(\d+):leaf=([^,]+),cover=([^,\s]+)")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(tree, text) of a dump file."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"booster\[\d+\]:?")).alias("tree", "text"))
    return text.where("trim(text) <> ''")


def parse(text: str) -> dict[int, tuple]:
    """id -> (feature, split, yes, no, gain, cover); of leaves (None, value, None, None, 0, cover). Lines of another form raise ValueError."""
    nodes: dict[int, tuple] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        if m := NODE.fullmatch(line):
            nodes[int(m[1])] = (m[2], float(m[3]), int(m[4]), int(m[5]), float(m[6]), float(m[7]))
        elif m := LEAF.fullmatch(line):
            nodes[int(m[1])] = (None, float(m[2]), None, None, 0.0, float(m[3]))
        else:
            raise ValueError(f"not a node: {line!r}")
    if any(child not in nodes for n in nodes.values() for child in n[2:4] if child is not None):
        raise ValueError("a node's child is missing")
    return nodes


def uses(nodes: dict[int, tuple], given: dict[str, float]) -> Iterator[tuple[str, float, float]]:
    """(feature, probability, probability * gain) of each split that is reached when the features of given have these values."""

    def reached(i: int) -> int:
        while nodes[i][0] in given:
            feature, split, yes, no, *_ = nodes[i]
            i = yes if given[feature] < split else no
        return i

    todo = [(reached(min(nodes)), 1.0)]
    while todo:
        i, p = todo.pop()
        feature, _, yes, no, gain, cover = nodes[i]
        if feature is not None:
            yield feature, p, p * gain
            todo += [(j, p * nodes[j][5] / cover) for j in map(reached, (yes, no))]


def importances(trees: DataFrame, feature: str | None = None, values: list[float] | None = None) -> DataFrame:
    """(value, feature, fscore, gain): expected use and gain by feature with `feature` held at each of the values; without them value is null."""
    grid = [None] if feature is None else list(values or [])

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for text in batch["text"]:
                nodes = parse(text)
                for value in grid:
                    found = list(uses(nodes, {} if value is None else {feature: value}))
                    yield pd.DataFrame({"value": pd.Series([value] * len(found), dtype="float64"), "feature": pd.Series([f for f, *_ in found], dtype=object), "p": [p for _, p, _ in found], "g": [g for *_, g in found]})

    each = trees.select("text").mapInPandas(run, "value double, feature string, p double, g double")
    return each.groupBy(F.nanvl("value", F.lit(None).cast("double")).alias("value"), "feature").agg(F.sum("p").alias("fscore"), F.sum("g").alias("gain"))


def split_values(trees: DataFrame, feature: str) -> DataFrame:
    """(value, n): how often trees split the feature at a value."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"value": [n[1] for n in parse(text).values() if n[0] == feature]}, dtype="float64")

    return trees.select("text").mapInPandas(run, "value double").groupBy("value").agg(F.count("*").alias("n"))


def value_grid(trees: DataFrame, feature: str, points: int = 200) -> list[float]:
    """Evenly spaced values from one below the feature's least split to one above its greatest."""
    low, high = split_values(trees, feature).agg(F.min("value"), F.max("value")).first()
    if low is None:
        return []
    low, high = low - 1, high + 1
    return [low + (high - low) * i / (points - 1) for i in range(points)]
