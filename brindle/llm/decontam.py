"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

A record is a window of consecutive item words. Its words are ordered by rarity in the documents;
since a whole record must occur, its prefix is its rarest word. The records, keyed by prefix word,
are joined with each document's words; a hit at position p of a record whose prefix word has offset
o can only start at p - o (positional bound) and must end within the document (length bound); then
the window is verified word by word.

The index goes to the executors in blocks of bounded bytes: a larger benchmark takes more passes in
a row, not a larger broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, keep, text_bytes

#: Bytes of item text in a block of the index.
BLOCK_BYTES = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def records_of(words: list[bytes], window: int) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list]:
    """The items (id text, text bytes), block by block; each has about block_bytes of text."""
    src = items.select(F.coalesce(F.col(items.columns[0]).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(items.columns[1]).cast("string"), F.lit("")).cast("binary").alias("t"))
    total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        yield [(r["i"], bytes(r["t"])) for r in (src.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else src).collect()]


def _rarity(docs: DataFrame, text_col: str, vocabulary: frozenset) -> Counter:
    """How often each of the vocabulary's words stands in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                seen.update(filter(known.value.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return Counter({bytes(r["w"]): r["n"] for r in counted.collect()})  # bounded by the block's words


def _index(block: list, window: int, docs: DataFrame, text_col: str) -> dict:
    """Prefix word -> [(its offset, the record, the ids of its items)]."""
    owners: dict[tuple, set] = {}
    for item, text in block:
        for record in records_of(words_of(text), window):
            owners.setdefault(record, set()).add(item)
    counts = _rarity(docs, text_col, frozenset(w for record in owners for w in record))
    index: dict[bytes, list] = {}
    for record, ids in owners.items():
        rarest = min(record, key=lambda w: (counts[w], w))
        if counts[rarest]:  # else the record occurs nowhere
            index.setdefault(rarest, []).append((record.index(rarest), list(record), sorted(ids)))
    return index


def matches(words: list[bytes], index: dict) -> Iterator[tuple[int, int, list]]:
    """(start, stop, item ids) of each occurrence of a record in words."""
    n = len(words)
    for p in compress(range(n), map(index.__contains__, words)):
        for offset, record, ids in index[words[p]]:
            start = p - offset
            stop = start + len(record)
            if start >= 0 and stop <= n and words[start:stop] == record:
                yield start, stop, ids


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for each row of docs; items: its first two columns are id and text.

    Words are runs of ASCII letters and digits, lower-cased, and of other than ASCII characters. spans
    are the merged [start, stop) in words that item windows cover, n_hit the words in them, items the ids
    (as text, sorted, distinct) of items with a window there. An item of fewer words than a window is
    one window; one without words never occurs; null item ids read "null". Null and empty texts have no
    words; repeated rows are kept; without documents there are no rows, without items no hits. Extra
    columns are ignored.
    """
    span = "array<array<int>>"
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast(span).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    schema = state.schema
    for k, block in enumerate(_blocks(items, block_bytes)):
        state = keep(state) if k else state  # a pass's index is gone before the next one's is made
        shared = docs.sparkSession.sparkContext.broadcast(_index(block, window, docs, text_col))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                n_words, n_hit, spans, found = [], [], [], []
                for text, old, had in zip(text_bytes(batch.column(1)), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                    words = words_of(text)
                    hits = list(matches(words, shared.value))
                    own = _merged([*(old or []), *([a, b] for a, b, _ in hits)])
                    n_words.append(len(words))
                    n_hit.append(sum(b - a for a, b in own))
                    spans.append(own)
                    found.append(sorted({*(had or []), *(i for *_, ids in hits for i in ids)}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(pa.string()))], names=schema.names)

        state = state.mapInArrow(run, schema)
    return state.drop("text")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text has no window of an item (as find_contamination judges). Null texts stay, repeated rows are judged alike; an empty table gives no rows."""
    column = docs.columns.index(text_col)
    for k, block in enumerate(_blocks(items, block_bytes)):
        docs = keep(docs) if k else docs
        shared = docs.sparkSession.sparkContext.broadcast(_index(block, window, docs, text_col))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([next(matches(words_of(t), shared.value), None) is None for t in text_bytes(batch.column(column))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
