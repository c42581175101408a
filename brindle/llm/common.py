"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: As LOWER, and turns each byte below 0x80 that is no letter or digit into a space.
ALNUM = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which is set only where it is unset (local tests)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/brindle-{uuid.uuid4().hex}"


def keep(df: DataFrame, scratch: str | None = None) -> DataFrame:
    """Writes df to the shared folder (below scratch, if given) and reads it back: cuts lineage, and survives lost executors."""
    path = f"{scratch}/{uuid.uuid4().hex}" if scratch else shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys of rows without an id of their own start above the greatest id; partitions take 2^33 of them each.
KEYS = 1 << 62


def with_key(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """docs with a long column key of its own for each row: the id, or a number above all ids for rows without one and for all but one of the rows of an id.

    Such rows are written once, so that their numbers stay. Ids of 2^62 and more fail beside them.
    """
    known = docs.withColumn(key, F.col(id_col).cast("long"))
    last, bare = known.agg(F.max(key), F.count(F.when(F.col(key).isNull(), 1))).first()
    again = keep(known.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if not bare and again.isEmpty():
        return known
    if (last or 0) >= KEYS:
        raise ValueError(f"no numbers are left above id {last} for rows without an id of their own")
    number, first = f"{key}_number", f"{key}_first"
    apart = known.where(F.col(key).isNull()).unionByName(known.join(again, key, "left_semi").select(known.columns))
    apart = keep(apart.withColumn(number, F.monotonically_increasing_id() + F.lit(max(0, (-1 if last is None else last) + 1)).cast("long")))
    firsts = apart.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(number).alias(first))
    apart = apart.join(firsts, key, "left").withColumn(key, F.when(F.col(number) == F.col(first), F.col(key)).otherwise(F.col(number)))
    return known.where(F.col(key).isNotNull()).join(again, key, "left_anti").select(known.columns).unionByName(apart.select(known.columns))


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that shared_dir() gave, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df in bytes (for files: theirs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes, None as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of a column's text modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered; emptied when it holds limit words, so its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        super().__init__()
        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hash(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of x reach the top bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes; empty when there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, factor = np.zeros(len(h) - n + 1, np.uint64), 1
    for j in range(n):
        out += h[j : j + len(out)] * np.uint64(factor)
        factor = factor * base % 2**64
    return mix64(out)
