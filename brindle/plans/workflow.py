"""Training on the splits in turn: two for validation, then all rows for a submission. What is written already is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, models
from ..sources import files

#: Model settings by profile: kind and assembled dataset; epochs, bags and seed of the first bag, and the options of models.fit.
PROFILES = {
    "ffm": {"kind": "ffm", "dataset": "f1", "epochs": 4, "bags": 2, "seed": 2017, "options": {}},
    "ffm_restricted": {"kind": "ffm", "dataset": "p1", "epochs": 4, "bags": 1, "seed": 2017, "options": {"restricted": True}},
    "ffm_nn": {"kind": "ffm_nn", "dataset": "f1", "epochs": 4, "bags": 1, "seed": 2017, "options": {"eta": 0.05}},
    "ftrl": {"kind": "ftrl", "dataset": "f2", "epochs": 4, "bags": 1, "seed": 2017, "options": {}},
    "nn": {"kind": "nn", "dataset": "f1", "epochs": 4, "bags": 1, "seed": 2017, "options": {"eta": 0.02}},
}
SEED_STEP = 3407


def fit_predict(profile: dict, train: DataFrame, test: DataFrame) -> DataFrame:
    """test with pred: the mean over the profile's bags, each with a seed of its own."""
    bags = [models.fit(train, profile["kind"], epochs=profile["epochs"], seed=profile["seed"] + i * SEED_STEP, **profile["options"]) for i in range(profile["bags"])]
    return models.predict_bags(bags, test)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def train_model(spark: SparkSession, name: str, out: str, splits: dict[str, Callable], predict: Callable, key: list[str], ties: list[str], cut_ms: int) -> dict[str, dict[str, float]]:
    """{split: {bucket: mean reciprocal rank}} of the validation splits; predictions, and of the split "full" a submission, go below out.

    splits: name -> function that gives (train, test); predict(train, test) gives test with pred. A split
    whose predictions are there is scored from them and not trained again.
    """
    scores: dict[str, dict[str, float]] = {}
    for split, make in splits.items():
        path = f"{out}/preds/{name}-{split}"
        train, test = make()
        if not _exists(spark, path):
            files.write_predictions(predict(train, test), path, key)
        pred = test.drop("pred").join(files.read_predictions(spark, path), key)
        if split != "full":
            scores[split] = {r["bucket"]: r["mrr"] for r in metrics.mrr_by_time(pred, ties, cut_ms).collect()}
        elif not _exists(spark, f"{out}/subm/{name}"):
            files.write_csv(metrics.submission(pred, ties).orderBy(F.col("display_id")), f"{out}/subm/{name}")
    return scores
