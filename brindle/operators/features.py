"""Keyed feature tables: count pivots, view aggregates, similarity, rivals, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: The count pivots: name -> column of the star join.
PIVOTS = {
    "ads": "ad_id", "campaigns": "campaign_id", "advertisers": "advertiser_id", "ad_docs": "ad_document_id", "ad_doc_sources": "ad_source_id", "ad_doc_publishers": "ad_publisher_id",
    "ev_docs": "ev_document_id", "ev_doc_sources": "ev_source_id", "ev_doc_publishers": "ev_publisher_id", "countries": "country", "states": "state", "regions": "region", "uids": "uid",
}


def count_pivot(rows: DataFrame, column: str) -> DataFrame:
    """(id, train_count, test_count)"""
    return rows.groupBy(F.col(column).cast("string").alias("id")).agg(F.count_if(~F.col("is_test")).alias("train_count"), F.count_if("is_test").alias("test_count"))


def count_pivots(rows: DataFrame, pivots: dict[str, str] | None = None) -> DataFrame:
    """(feature, id, train_count, test_count) of all pivots from one pass over rows, by grouping sets."""
    pivots = pivots or PIVOTS
    pairs = ", ".join(f"'{name}', CAST({column} AS STRING)" for name, column in pivots.items())
    long = rows.selectExpr("is_test", f"stack({len(pivots)}, {pairs}) AS (feature, id)")
    return long.groupBy("feature", "id").agg(F.count_if(~F.col("is_test")).alias("train_count"), F.count_if("is_test").alias("test_count"))


def strict_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of table (unique by key); a key that table lacks raises an error."""
    found = table.withColumn("__found", F.lit(True))
    missing = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return rows.join(found, key, "left").where(F.when(F.col("__found"), F.lit(True)).otherwise(missing)).drop("__found")


def encode_first_seen(rows: DataFrame, column: str, ordinal: str) -> DataFrame:
    """(column, code): codes from 1 in the order of each value's first appearance. ordinal: an integer column.

    Values are numbered within ranges of the ordinal; only a count for each range is put in order as a whole.
    """
    first = rows.groupBy(column).agg(F.min(ordinal).alias("__first")).withColumn("__b", F.floor(F.col("__first") / (1 << 14)))
    sums = first.groupBy("__b").agg(F.count("*").alias("__n"))
    starts = sums.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    numbered = first.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__first", column))).join(starts, "__b")
    return numbered.select(column, (F.col("__r") + F.col("__start")).cast("long").alias("code"))


def leak_viewed(rows: DataFrame, views: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Adds viewed (views of the ad's document by the uid) and not_viewed (1 if others alone viewed it).

    users: every uid of rows, so that rows are not made twice; their views are then stored as counts, whose size decides between broadcast and sort-merge joins.
    """
    if users is None:
        wanted = rows.select("uid", "ad_document_id").distinct()
        seen = views.join(wanted, (views.uid == wanted.uid) & (views.document_id == wanted.ad_document_id), "left_semi")
    else:
        seen = views.join(users.select("uid").distinct(), "uid", "left_semi")
    own = seen.groupBy("uid", F.col("document_id").alias("ad_document_id")).agg(F.count("*").alias("viewed"))
    anyone = views.select(F.col("document_id").alias("ad_document_id")).distinct().withColumn("__any", F.lit(1))
    if users is not None:
        own, anyone = stored(own), stored(anyone)
    out = rows.join(own, ["uid", "ad_document_id"], "left").join(anyone, "ad_document_id", "left").withColumn("viewed", F.coalesce("viewed", F.lit(0)))
    return out.withColumn("not_viewed", ((F.col("viewed") == 0) & F.col("__any").isNotNull()).cast("int")).drop("__any")


def viewed_docs(rows: DataFrame, views: DataFrame, docs: DataFrame, group: list[str]) -> DataFrame:
    """Adds publisher_view_count and source_view_count: the group's views of documents of the ad's publisher and source; -1 where that id is 0."""
    of = views.join(docs.select("document_id", "source_id", "publisher_id"), "document_id")
    out = rows
    for name in ("publisher", "source"):
        n = stored(of.groupBy(*group, F.col(f"{name}_id").alias(f"ad_{name}_id")).agg(F.count("*").alias("__n")))
        out = out.join(n, [*group, f"ad_{name}_id"], "left").withColumn(f"{name}_view_count", F.when(F.col(f"ad_{name}_id") == 0, F.lit(-1)).otherwise(F.coalesce("__n", F.lit(0)))).drop("__n")
    return out


def viewed_weight(rows: DataFrame, views: DataFrame, annotations: DataFrame, group: list[str], row_key: list[str], name: str) -> DataFrame:
    """(row_key, name): over the annotations of the ad's document, the sum of the confidences with which the group's viewed documents have them."""
    weight = views.groupBy(*group, "document_id").agg(F.count("*").alias("__v")).join(annotations, "document_id").groupBy(*group, "id").agg(F.sum(F.col("conf") * F.col("__v")).alias("__w"))
    ad = annotations.select(F.col("document_id").alias("ad_document_id"), "id").distinct()
    sums = rows.select(*dict.fromkeys([*row_key, *group, "ad_document_id"])).join(ad, "ad_document_id").join(weight, [*group, "id"]).groupBy(*row_key).agg(F.sum("__w").alias(name))
    return rows.select(*row_key).join(sums, row_key, "left").withColumn(name, F.round(F.coalesce(name, F.lit(0.0)), 6))


def one_hour_after(rows: DataFrame, views: DataFrame, least_views: int = 1, span_ms: int = 3_600_000) -> DataFrame:
    """(uid, ts, doc_ids): the distinct documents that the uid viewed strictly within span_ms after a display, of those viewed at least least_views times.

    The range join is an equality join on uid and hour buckets: a view can only match displays of its own and the previous bucket.
    """
    kept = views.join(views.groupBy("document_id").count().where(F.col("count") >= least_views).select("document_id"), "document_id", "left_semi")
    shown = rows.select("uid", "ts").distinct().withColumn("__b", F.expr(f"ts DIV {span_ms}"))
    near = kept.select("uid", "document_id", F.col("ts").alias("__t")).withColumn("__b", F.explode(F.expr(f"array(__t DIV {span_ms}, __t DIV {span_ms} - 1)")))
    hits = shown.join(near, ["uid", "__b"]).where(f"__t - ts > 0 AND __t - ts < {span_ms}")
    return hits.groupBy("uid", "ts").agg(F.array_join(F.array_sort(F.collect_set("document_id")), " ").alias("doc_ids"))


def similarity(pairs: DataFrame, annotations: DataFrame, left: str, right: str, prefix: str) -> DataFrame:
    """(left, right, {prefix}_product, {prefix}_jaccard) of distinct pairs of documents: sum of products of confidences over shared ids, and shared over all ids (0 if none)."""
    ids = annotations.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "conf"))).alias("m"))
    both = pairs.select(left, right).distinct().join(ids.select(F.col("document_id").alias(left), F.col("m").alias("__a")), left, "left").join(ids.select(F.col("document_id").alias(right), F.col("m").alias("__b")), right, "left")
    shared = F.array_intersect(F.map_keys("__a"), F.map_keys("__b"))
    product = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(F.col("__a"), k) * F.element_at(F.col("__b"), k))
    whole = F.size(F.array_union(F.map_keys("__a"), F.map_keys("__b")))
    return both.select(left, right, F.round(F.coalesce(product, F.lit(0.0)), 6).alias(f"{prefix}_product"), F.round(F.coalesce(F.when(whole > 0, F.size(shared) / whole), F.lit(0.0)), 6).alias(f"{prefix}_jaccard"))


def rivals(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds rival_count, rank (0-based place in the display by order) and rivals (the other ads, by place)."""
    listed = F.collect_list("ad_id").over(Window.partitionBy("display_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = rows.withColumns({"__all": listed, "rank": F.row_number().over(Window.partitionBy("display_id").orderBy(*order)).cast("long") - 1})
    return out.withColumns({"rival_count": F.size("__all").cast("long"), "rivals": F.array_join(F.filter("__all", lambda x, i: i != F.col("rank")), " ")}).drop("__all")


def document_ad_code() -> Column:
    """The code of a row's page and ad: (document, 99, ad) as digits, modulo 2^22."""
    return F.pmod(F.concat(F.col("ev_document_id").cast("string"), F.lit("99"), F.col("ad_id").cast("string")).cast("long"), F.lit(4194304))


def document_ad_others(rows: DataFrame, least: int = 100) -> DataFrame:
    """(display_id, ids): for displays, the sorted codes (document, 99, ad as digits, modulo 2^22) of pairs that at least `least` rows have."""
    code = document_ad_code()
    n = F.count("*").over(Window.partitionBy("ev_document_id", "ad_id"))
    return rows.withColumn("__n", n).where(F.col("__n") >= least).groupBy("display_id").agg(F.array_join(F.array_sort(F.collect_list(code)), " ").alias("ids"))
