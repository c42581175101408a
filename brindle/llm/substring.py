"""Exact substring dedup by fixed-block anchors.

A repeat of `window` words holds, in the text that it repeats, a whole block of (window + 1) // 2
words whose start is a multiple of that length. The non-overlapping blocks of all documents are the
index; every rolling run of as many words of all documents probes it. Around each hit, windows are
extended to the full repeat and compared whole, by 96 bits of hash.

Texts are dealt into groups of documents once (an exchange that Spark reuses). Between groups and
hash buckets travel packed arrays: at most 4 bytes for a probe, a bit for its answer; only windows
around hits, that is repeats, travel whole. Each group sends a block or window once, however often
it has it, and settles repeats within itself; so a passage in many documents is an entry a group in
one bucket, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, rolling, size_bytes, text_bytes

BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LAST = 2**63 - 1
#: The texts of a group of documents, and so the memory of a task, have about these bytes at least and most.
CHUNK_BYTES = (4 << 20, 64 << 20)


def _planes(x: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane, so that compression finds its empty high bytes."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


class _Group:
    """The words of a group's documents in the order of (id, text), one after another."""

    def __init__(self, table):
        ids = [LAST if x is None else x for x in table.column("id").to_pylist()]
        texts = text_bytes(table.column("text").combine_chunks()) if table.num_rows else []
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows = order
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.docs = [texts[i].split() for i in order]
        self.sizes = np.array([len(w) for w in self.docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def hashes(self) -> np.ndarray:
        known = WordHashes()
        return np.concatenate([np.empty(0, np.uint64), *(known.of(w) for w in self.docs)])

    def fits(self, n: int) -> np.ndarray:
        """Whether n words of the document are left from each position that has n words of the group after it."""
        total = int(self.starts[-1])
        if total < n:
            return np.zeros(0, bool)
        return (np.repeat(self.starts[1:], self.sizes)[: total - n + 1] - np.arange(total - n + 1)) >= n

    def probes(self, h: np.ndarray, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all rolling blocks, and in one integer each one's bucket, whether it is not aligned (bit 32) and hash (32 bits)."""
        at = np.flatnonzero(self.fits(block))
        r = rolling(h, block, BASE_A)[at]
        inside = at - np.repeat(self.starts[:-1], self.sizes)[at]
        bucket = (r >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        return at, bucket << np.uint64(33) | (inside % block != 0).astype(np.uint64) << np.uint64(32) | r & np.uint64(0xFFFFFFFF)


def _bounds(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)], strict=True))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, whole_rows: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_text, spans) for each row of docs; with whole_rows also the row's own columns, as c0, c1 .. in the order of docs.

    Words are runs without ASCII white space. Each word inside a window of `window` words whose word
    sequence also starts earlier (smaller id, or earlier in the document) is removed; spans are the
    removed [start, stop) in words, kept_text the other words joined by a space. Windows are judged on
    the input. Rows with a null id count after all others, rows of one id in the order of their texts,
    repeated rows one after another; null and empty texts have no words; an empty table gives no rows.
    Extra columns are ignored.
    """
    block = (window + 1) // 2
    # the text goes along once
    columns = {f"c{i}": c for i, c in enumerate(docs.columns)} if whole_rows else {}
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(docs[c].alias(n) for n, c in columns.items() if c != text_col))
    total = size_bytes(docs) * 2
    if total > 1 << 58:  # no estimate
        total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = min(CHUNK_BYTES[1], int(CHUNK_BYTES[0] * max(1, (total / 2**30) ** (1 / 3))))
    groups = max(1, math.ceil(total / chunk))
    buckets = max(1, groups // 2)
    dealt = src.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def probe(key, table):
        import pyarrow as pa

        g = _Group(table)
        keys = np.unique(g.probes(g.hashes(), block, buckets)[1])
        out = []
        for a, b in _bounds(keys >> np.uint64(33)):
            own = keys[a:b]
            n = int(np.count_nonzero(own & np.uint64(1 << 32) == 0))
            out.append((int(own[0] >> np.uint64(33)), key[0].as_py(), n, _planes(np.diff(own.astype(np.uint32), prepend=np.uint32(0)))))
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate((("bucket", pa.int32()), ("grp", pa.int32()), ("aligned", pa.int32()), ("probes", pa.binary())))})

    def match(key, table):
        import pyarrow as pa

        parts = [np.cumsum(_unplanes(x, np.uint32), dtype=np.uint32) for x in table.column("probes").to_pylist()]
        counts = table.column("aligned").to_pylist()
        index, times = np.unique(np.concatenate([x[:n] for x, n in zip(parts, counts, strict=True)]), return_counts=True)
        if not len(index):
            return pa.table({"grp": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "hits": pa.array([], pa.binary())})
        rest = np.concatenate([x[n:] for x, n in zip(parts, counts, strict=True)])
        slot = np.minimum(np.searchsorted(index, rest), len(index) - 1)
        same = index[slot] == rest
        shared = (times > 1) | (np.bincount(slot[same], minlength=len(index)) > 0)
        grp, bits, done = [], [], 0
        for g, x, n in zip(table.column("grp").to_pylist(), parts, counts, strict=True):
            hit = np.concatenate([shared[np.searchsorted(index, x[:n])], same[done : done + len(x) - n]])
            done += len(x) - n
            if hit.any():
                grp.append(g)
                bits.append(np.packbits(hit).tobytes())
        return pa.table({"grp": pa.array(grp, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(grp), pa.int32()), "hits": pa.array(bits, pa.binary())})

    def extend(key, table, found):
        import pyarrow as pa

        out = []
        if table.num_rows:
            g = _Group(table)
            h = g.hashes()
            at, keys = g.probes(h, block, buckets)
            known, times = np.unique(keys, return_counts=True)
            on = (times > 1) & (known & np.uint64(1 << 32) == 0)
            for k, bits in zip(found.column("bucket").to_pylist(), found.column("hits").to_pylist(), strict=True):
                a, b = np.searchsorted(known, np.array([k << 33, (k + 1) << 33], np.uint64))
                on[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            hit, known = np.zeros(len(h) + 1, np.int32), known[on]
            if len(known):
                hit[at[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]] = 1
            sums = np.concatenate([[0], np.cumsum(hit)])
            s = np.flatnonzero(g.fits(window))
            s = s[sums[s + window - block + 1] > sums[s]]
            x, y = rolling(h, window, BASE_A)[s], rolling(h, window, BASE_B)[s].astype(np.uint32)
            order = np.lexsort((y, x))  # stable: of equal windows the group's first comes first
            s, x, y = s[order], x[order], y[order]
            again = np.concatenate([np.zeros(min(1, len(s)), bool), (x[1:] == x[:-1]) & (y[1:] == y[:-1])])
            if again.any():
                out.append((key[0].as_py() % buckets, key[0].as_py(), None, None, None, _planes(np.sort(s[again]).astype(np.uint32))))
            s, x, y = s[~again], x[~again], y[~again]
            lane = ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending, as x is
            ids = np.repeat(g.ids, g.sizes)[s]
            out += [(int(lane[a]), key[0].as_py(), x[a:b].tobytes(), y[a:b].tobytes(), _planes(ids[a:b]), _planes(s[a:b].astype(np.uint32))) for a, b in _bounds(lane)]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("bucket", pa.int32()), ("grp", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())))})

    def settle(key, table):
        import pyarrow as pa

        settled = table.filter(table.column("a").is_null())
        table = table.filter(table.column("a").is_valid())
        if not table.num_rows:
            return pa.table({"grp": settled.column("grp"), "later": settled.column("at")})
        a, b = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("a", np.uint64), ("b", np.uint32)))
        ids, at = ([_unplanes(x, t) for x in table.column(c).to_pylist()] for c, t in (("ids", np.int64), ("at", np.uint32)))
        owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
        ids, at = np.concatenate(ids), np.concatenate(at)
        order = np.lexsort((at, ids, b, a))
        a, b = a[order], b[order]
        later = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        order = np.sort(order[later])
        grp = table.column("grp").to_pylist()
        out = [(grp[int(owner[order[i]])], _planes(at[order[i:j]])) for i, j in _bounds(owner[order])]
        out += zip(settled.column("grp").to_pylist(), settled.column("at").to_pylist(), strict=True)
        return pa.table({"grp": pa.array([x[0] for x in out], pa.int32()), "later": pa.array([x[1] for x in out], pa.binary())})

    def remove(key, table, found):
        import pyarrow as pa

        g = _Group(table)
        edge = np.zeros(int(g.starts[-1]) + 1, np.int64)
        for x in found.column("later").to_pylist():
            s = _unplanes(x, np.uint32).astype(np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_removed, kept, offsets, spans = [], [], [0], []
        for words, a, b in zip(g.docs, g.starts[:-1].tolist(), g.starts[1:].tolist(), strict=True):
            own = gone[a:b]
            n = int(own.sum())
            n_removed.append(n)
            if n:
                step = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).reshape(-1, 2)
                spans.append(step)
                words = [w for w, x in zip(words, own.tolist(), strict=True) if not x]
            offsets.append(offsets[-1] + (len(step) if n else 0))
            kept.append(b" ".join(words))
        flat = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], names=["start", "stop"]))
        table = table.take(pa.array(g.rows, pa.int64()))
        rest = {n: table.column("text" if c == text_col else n) for n, c in columns.items()}
        return pa.table({"id": table.column("id"), "n_words": pa.array(g.sizes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "spans": lists, **rest})

    by_group = lambda: dealt.groupBy("grp")
    hits = by_group().applyInArrow(probe, "bucket int, grp int, aligned int, probes binary").groupBy("bucket").applyInArrow(match, "grp int, bucket int, hits binary")
    repeats = by_group().cogroup(hits.groupBy("grp")).applyInArrow(extend, "bucket int, grp int, a binary, b binary, ids binary, at binary").groupBy("bucket").applyInArrow(settle, "grp int, later binary")
    return by_group().cogroup(repeats.groupBy("grp")).applyInArrow(remove, ", ".join(["id long, n_words long, n_removed long, kept_text string, spans array<struct<start: long, stop: long>>", *(f"{n} {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for n, c in columns.items())]))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs with repeated passages cut out of their texts, and without rows of which no word is left.

    A text with a repeat becomes its kept words joined by a space; other texts, and texts without
    words, stay as they are. n_chars, where docs has it, follows the text. Each row keeps its own
    words, so of a repeated row the first stays, and several texts of one id stay apart.
    """
    found = dedup_substrings(docs, id_col, text_col, window, whole_rows=True).where("n_removed = 0 OR kept_text <> ''")
    cut = F.col("n_removed") > 0
    new = {"n_chars": F.length("kept_text"), text_col: F.col("kept_text")}
    return found.select(*((F.when(cut, new[c]).otherwise(F.col(f"c{i}")).cast(docs.schema[c].dataType) if c in new else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
