"""Counters over the strictly earlier and strictly later displays of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def past_future(rows: DataFrame, keys: list[str], prefix: str, weight: Column | None = None, order: str = "display_id", label: str = "label") -> DataFrame:
    """Adds {prefix}_{past,future}_{views,clicks,all_views}: sums over rows of equal keys in earlier and later displays.

    views counts rows with a known label (>= 0), clicks those with a label above 0, all_views all rows.
    Rows of the row's own display are in neither. The future is a running frame over the descending
    order: rows are only ever added, so it stays linear and float sums keep exact zeros. With weight,
    sums of weight instead of counts. Null keys are a key of their own.
    """
    w = F.lit(1) if weight is None else weight
    what = {"views": F.when(F.col(label) >= 0, w), "clicks": F.when(F.col(label) > 0, w), "all_views": w}
    past = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"{prefix}_{when}_{name}": F.coalesce(F.sum(x).over(frame), F.lit(0) if weight is None else F.lit(0.0)) for when, frame in (("past", past), ("future", future)) for name, x in what.items()})


def weighted_history(rows: DataFrame, annotations: DataFrame, group: list[str], row_key: list[str], prefix: str, doc: str = "ad_document_id") -> DataFrame:
    """For each row and annotation of its document: the row's confidence times the sum of confidences of other displays' rows, summed over annotations and rounded to 6 places.

    row_key: unique by row. Rows dealt by the group, or by part of it, are not dealt again.
    """
    long = rows.select(*dict.fromkeys([*group, *row_key, doc, "display_id", "label"])).join(annotations.select(F.col("document_id").alias(doc), F.col("id").alias("__id"), "conf"), doc, "left")
    counted = past_future(long, [*group, "__id"], prefix, F.col("conf"))
    names = [f"{prefix}_{when}_{x}" for when in ("past", "future") for x in ("views", "clicks", "all_views")]
    sums = counted.groupBy(*dict.fromkeys([*group, *row_key])).agg(*(F.sum(F.col("conf") * F.col(n)).alias(n) for n in names))
    return sums.select(*row_key, *(F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n in names))


def with_weighted_history(rows: DataFrame, noted: DataFrame, group: list[str], row_key: list[str], prefix: str, doc: str = "ad_document_id") -> DataFrame:
    """rows with the sums of weighted_history; rows dealt by the group stay where they are, and none are joined again.

    noted: (document_id, annotations as array<struct<id, conf>>), unique by document. Other columns than group and row_key must be numbers or dates: one annotation of each row brings them along.
    """
    own = [c for c in rows.columns if c not in {*group, *row_key}]
    each = [c for c in rows.columns if c in {*group, *row_key, doc, "display_id", "label"}]
    long = rows.join(noted.withColumnRenamed("document_id", doc), doc, "left").select(*rows.columns, F.posexplode_outer("annotations").alias("__k", "__a"))
    first = F.coalesce("__k", F.lit(0)) == 0
    long = long.select(*each, F.col("__a.id").alias("__id"), F.col("__a.conf").alias("__conf"), *(F.when(first, F.col(c)).alias(c) for c in own if c not in each))
    counted = past_future(long, [*group, "__id"], prefix, F.col("__conf"))
    names = [f"{prefix}_{when}_{x}" for when in ("past", "future") for x in ("views", "clicks", "all_views")]
    sums = counted.groupBy(*dict.fromkeys([*group, *row_key])).agg(*(F.max(c).alias(c) for c in own), *(F.sum(F.col("__conf") * F.col(n)).alias(n) for n in names))
    return sums.withColumns({n: F.round(F.coalesce(n, F.lit(0.0)), 6) for n in names})


def seen_sets(rows: DataFrame, group: list[str], doc: str = "ad_document_id", order: str = "display_id", label: str = "label") -> DataFrame:
    """Adds {past,future}_{views,clicks}_docs: sorted space lists of the distinct documents in earlier and later displays of the group.

    A document is in a display's past if the group first had it before, and in its future if it last had
    it after: so a group's documents are reduced to first and last displays, and each display's lists are
    made once. Null keys are a key of their own.
    """
    clicked = F.when(F.col(label) > 0, F.col(order))
    each = rows.where(F.col(doc).isNotNull()).groupBy(*group, doc).agg(F.min(order).alias("f"), F.max(order).alias("l"), F.min(clicked).alias("cf"), F.max(clicked).alias("cl"))
    named = [F.col(g).alias(f"__{g}") for g in group]
    lists = each.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(doc).alias("doc"), "f", "l", "cf", "cl"))).alias("__seen")).select(*named, "__seen")
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.__{g}")) for g in group]
    shown = rows.select(*group, order).distinct().alias("s").join(lists.alias("t"), same("s", "t"), "left")
    some = lambda on: F.coalesce(F.array_join(F.transform(F.filter("__seen", on), lambda x: x["doc"]), " "), F.lit(""))
    now = F.col(order)
    made = {"past_views_docs": some(lambda x: x["f"] < now), "past_clicks_docs": some(lambda x: x["cf"] < now), "future_views_docs": some(lambda x: x["l"] > now), "future_clicks_docs": some(lambda x: x["cl"] > now)}
    shown = shown.select(*(F.col(f"s.{g}").alias(f"__{g}") for g in group), F.col(order).alias("__order"), *(c.alias(n) for n, c in made.items()))
    return rows.alias("r").join(shown.alias("s"), [*same("r", "s"), F.col(f"r.{order}") == F.col("s.__order")], "left").drop(*(f"__{g}" for g in group), "__order")


def later_document(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Adds later_flag: the ad's document is the page of a later display of the same uid. shown: (uid, ev_document_id, display_id)."""
    last = shown.groupBy("uid", F.col("ev_document_id").alias("ad_document_id")).agg(F.max("display_id").alias("__last"))
    return rows.join(last, ["uid", "ad_document_id"], "left").withColumn("later_flag", F.coalesce((F.col("__last") > F.col("display_id")).cast("int"), F.lit(0))).drop("__last")


def next_document(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Adds next_flag: the ad's document is the page of the uid's next display."""
    following = shown.distinct().withColumn("__next", F.lead("ev_document_id").over(Window.partitionBy("uid").orderBy("display_id"))).select("display_id", "__next")
    return rows.join(following, "display_id", "left").withColumn("next_flag", F.coalesce((F.col("__next") == F.col("ad_document_id")).cast("int"), F.lit(0))).drop("__next")
