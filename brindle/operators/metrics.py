"""Ranking metrics. A display's positive is its clicked row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ad_mean(rows: DataFrame, smooth: float = 10.0) -> DataFrame:
    """(ad_id, pred): clicks / (views + smooth) over rows with a known label."""
    return rows.where("label >= 0").groupBy("ad_id").agg((F.sum("label") / (F.count("*") + F.lit(smooth))).alias("pred"))


def with_ad_mean(rows: DataFrame) -> DataFrame:
    return rows.join(ad_mean(rows), "ad_id", "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))


def map12(rows: DataFrame, ties: list[str], cut: int = 12) -> DataFrame:
    """(map12, displays): mean over displays with a positive of 1 / place of the first positive, 0 beyond cut; ties in pred by the columns ties."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("display_id").orderBy(F.desc("pred"), *ties)))
    best = ranked.where("clicked = 1").groupBy("display_id").agg(F.min("__r").alias("r"))
    return best.agg(F.round(F.avg(F.when(F.col("r") <= cut, 1 / F.col("r")).otherwise(0.0)), 6).alias("map12"), F.count("*").alias("displays"))


def map12_pessimistic(rows: DataFrame, ties: list[str], cut: int = 12, drop_last: bool = False) -> DataFrame:
    """As map12 with the place of a positive the number of rows that score at least as high, over all displays (without a positive: 0), of several positives the last by ties.

    drop_last leaves the display with the greatest id out, as a scorer that closes groups on a change of id does.
    """
    groups = rows.groupBy("display_id").agg(F.max(F.when(F.col("clicked") == 1, F.struct(*ties, "pred"))).alias("p"), F.collect_list("pred").alias("all"))
    if drop_last:
        groups = groups.join(rows.agg(F.max("display_id").alias("__last")), F.col("display_id") < F.col("__last")).drop("__last")
    place = F.size(F.filter("all", lambda x: x >= F.col("p.pred")))
    score = F.when(F.col("p").isNotNull() & (place <= cut), 1 / place).otherwise(0.0)
    return groups.agg(F.round(F.avg(score), 6).alias("map12"), F.count("*").alias("displays"))


def mrr_by_time(rows: DataFrame, ties: list[str], cut_ms: int) -> DataFrame:
    """(bucket, mrr, displays) for present (ts below cut_ms), future and total: the sum of 1 / place over all positives, by the number of displays."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("display_id").orderBy(F.desc("pred"), *ties)))
    each = ranked.groupBy("display_id").agg(F.first("ts").alias("ts"), F.sum(F.when(F.col("clicked") == 1, 1 / F.col("__r")).otherwise(0.0)).alias("s"))
    both = each.select("s", F.explode(F.array(F.lit("total"), F.when(F.col("ts") < cut_ms, "present").otherwise("future"))).alias("bucket"))
    return both.groupBy("bucket").agg(F.round(F.sum("s") / F.count("*"), 6).alias("mrr"), F.count("*").alias("displays"))


def submission(rows: DataFrame, ties: list[str], top: int = 12) -> DataFrame:
    """(display_id, ad_ids): the top ads of each display by pred, space-joined in order."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("display_id").orderBy(F.desc("pred"), *ties))).where(F.col("__r") <= top)
    return ranked.groupBy("display_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "ad_id"))), lambda x: x["ad_id"]), " ").alias("ad_ids"))


def logloss(rows: DataFrame, p: Column, eps: float = 1e-7) -> DataFrame:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return rows.where("label >= 0").agg(F.round(F.avg(-F.when(F.col("label") > 0, F.log(q)).otherwise(F.log(1 - q))), 6).alias("logloss"), F.count("*").alias("rows"))


def ad_mean_of_other_folds(rows: DataFrame, smooth: float = 10.0) -> DataFrame:
    """(ad_id, fold, pred): ad_mean over the rows of the other folds. rows: ad_id, fold and a known label."""
    own = rows.groupBy("ad_id", "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy("ad_id")
    clicks, views = F.sum("s").over(every) - F.col("s"), F.sum("n").over(every) - F.col("n")
    return own.select("ad_id", "fold", (clicks / (views + F.lit(smooth))).alias("pred"))


def fold_scores(rows: DataFrame, predictions: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(fold, rows, logloss) of rows (ad_id, fold, label) under predictions (ad_id, fold, pred)."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.coalesce("pred", F.lit(0.0))))
    return rows.join(predictions, ["ad_id", "fold"], "left").groupBy("fold").agg(F.count("*").alias("rows"), F.avg(-F.when(F.col("label") > 0, F.log(p)).otherwise(F.log(1 - p))).alias("logloss"))


def bag_mean(bags: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, pred, pred_of_score): means over bags of predictions (key, pred) with probabilities between 0 and 1: of the probabilities, and the probability of the mean score."""
    every = bags[0].select(*key, "pred")
    for b in bags[1:]:
        every = every.unionByName(b.select(*key, "pred"))
    return every.groupBy(*key).agg(F.avg("pred").alias("pred"), (1 / (1 + F.exp(-F.avg(F.log(F.col("pred") / (1 - F.col("pred"))))))).alias("pred_of_score"))
