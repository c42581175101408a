"""Reading and writing the tables' files: CSV (plain, gzip, zip), keyed lookups, sparse datasets, text lines and predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas of the click log's files.
SCHEMAS = {
    "clicks": "display_id long, ad_id long, clicked int",
    "events": "display_id long, uuid string, document_id long, timestamp long, platform string, geo_location string",
    "promoted_content": "ad_id long, document_id long, campaign_id long, advertiser_id long",
    "documents_meta": "document_id long, source_id long, publisher_id long, publish_time string",
    "documents_categories": "document_id long, category_id long, confidence_level float",
    "documents_topics": "document_id long, topic_id long, confidence_level float",
    "documents_entities": "document_id long, entity_id string, confidence_level float",
    "page_views": "uuid string, document_id long, timestamp long, platform string, geo_location string, traffic_source string",
    "counts": "id long, train_count long, test_count long",
}
CHUNK_ROWS = 100_000


def _schema(table: str) -> str:
    return SCHEMAS.get(table, table)


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    r"""A CSV file with a header, plain or gzip; table: a name in SCHEMAS, or a schema. \N and empty fields are null."""
    return spark.read.csv(path, header=True, schema=_schema(table), nullValue="\\N", enforceSchema=False)


def read_zip_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """As read_csv of the CSV files within zip archives; each archive is a task's, read in chunks of CHUNK_ROWS rows."""
    schema = spark.createDataFrame([], _schema(table)).schema
    names = schema.names

    def rows(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(n for n in archive.namelist() if n.endswith(".csv")):
                        with archive.open(member) as f:
                            for part in pd.read_csv(f, dtype=str, keep_default_na=False, na_values=["", "\\N"], chunksize=CHUNK_ROWS):
                                part = part[names]
                                yield part.astype(object).where(part.notna(), None)

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"{n} string" for n in names))
    return text.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))


def unique_by(rows: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """One row for each key: the first in the given order, or the last."""
    others = F.struct(*(c for c in rows.columns if c != key))
    return rows.groupBy(key).agg((F.max_by if last else F.min_by)(others, F.col(order)).alias("__r")).select(key, "__r.*").select(rows.columns)


def lookup(rows: DataFrame, table: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Adds the columns of table (unique by key); rows without a match get the defaults, by column."""
    out = rows.join(table, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def sorted_lists(rows: DataFrame, key: str, columns: list[str], name: str = "items") -> DataFrame:
    """(key, items): all rows of a key as an array of structs, sorted."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def running_offsets(rows: DataFrame, order: list[str], size: str, name: str = "offset", block: int = 1 << 14, ranged: bool = False) -> DataFrame:
    """Adds the sum of size over all rows before a row in the order of columns `order`, of which the first is an integer.

    Sums run within blocks of `block` values of the first column; only a sum for each block is put in order as a whole.
    rows are read twice, so they should be stored. ranged: blocks are dealt in ranges, each in order.
    """
    cut = rows.withColumn("__b", F.floor(F.col(order[0]) / block))
    sums = cut.groupBy("__b").agg(F.sum(size).alias("__n"))
    starts = sums.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.repartitionByRange("__b") if ranged else cut
    return cut.withColumn(name, before).join(F.broadcast(starts) if ranged else starts, "__b").withColumn(name, F.col(name) + F.col("__start")).drop("__b", "__start")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with headers, gzip."""
    rows.write.csv(path, header=True, compression="gzip")


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_sparse(rows: DataFrame, path: str, order: list[str], made: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A sparse dataset (as assemble.dataset makes it) with the offset of each row's first feature, in ranges of the offset.

    rows (stored) need n_features alone; made then adds the features once rows are in order, so that these are never dealt.
    """
    placed = running_offsets(rows, order, "n_features", ranged=True)
    (made(placed) if made else placed).write.parquet(path, compression="zstd")


def read_sparse(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """The rows whose features begin at offsets from first to before last; the files' statistics skip the rest."""
    rows = spark.read.parquet(path).where(F.col("offset") >= first)
    return rows if last is None else rows.where(F.col("offset") < last)


def write_predictions(rows: DataFrame, path: str, key: list[str]) -> None:
    rows.select(*key, "pred").write.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
