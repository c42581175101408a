"""LM scoring by a hashed maximum-entropy model.

P(word | history) = P(class | h) * P(slot | class, h) * P(word | cell), cell = (class, slot). The first two
are softmaxes whose weights stand in hashed tables, addressed by features of the history: the word
before (bigram) and the one before that (skip), by their hashes, whatever their frequency, and the cells
of the one before and of both (trigram); the third is the word's smoothed share of its cell. Frequent
words have cells of their own, others share one by a hash of their ending. Each cell keeps one part for
words that were never seen, so the probabilities of all words and the unknown sum to 1.

Words are counted over all training documents: groups of documents send packed (hash, count) arrays to
hash buckets, whose totals come back to the groups; the vocabulary is never collected or broadcast.
Weights are trained by distributed gradient updates: in each round the tasks sum gradients over their
share of the round's documents, blocks of the sums are added in two levels, and the driver takes a
step; all rounds together pass once over all training documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, keep, size_bytes, text_bytes
from .substring import CHUNK_BYTES, _planes, _unplanes

CLASSES = SLOTS = 16
#: Words with a cell of their own, the end of a text among them; as many cells are shared.
TOPS = CLASSES * SLOTS // 2
FEATURES = 4
ROW_BITS, SLOT_BITS = 16, 17
ROWS, SLOT_ROWS = 1 << ROW_BITS, 1 << SLOT_BITS
ROUNDS = 4
PART, SCORE_PART = 1 << 18, 1 << 14
BLOCK = 8192
#: Bytes of text that one task sums a gradient of, about.
TASK_BYTES = 64 << 20
END = b""


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shared_cell(word: bytes) -> int:
    """The cell, less TOPS, of a word without one of its own: by its last three bytes."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word[-3:], 9) % TOPS


def tokens_of(text: bytes) -> list[bytes]:
    words = text.translate(LOWER).split()
    words.append(END)
    return words


class _Ids(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Words(dict):
    """Of each word 32 bits of its hash, never 0, and from bit 0 on its cell; remembered within bounds. tops: hash -> cell."""

    def __init__(self, tops: dict[int, int], limit: int = 400_000):
        super().__init__()
        self.tops, self.limit = tops, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = word_hash(word)
        own = self.tops.get(h)
        value = self[word] = ((h >> 32) or 1) << 8 | (TOPS + shared_cell(word) if own is None else own)
        return value


@dataclass
class Vocabulary:
    """Totals of the training tokens. mass, words: tokens and distinct words of each cell."""

    tokens: int
    distinct: int
    tops: dict[int, int]
    mass: np.ndarray
    words: np.ndarray

    def prior(self) -> np.ndarray:
        p = (self.mass + self.words + 1).astype(np.float64)
        return p / p.sum()


@dataclass
class MaxEnt:
    """Weights of the class and slot softmaxes; bias: log priors."""

    w: np.ndarray
    v: np.ndarray
    bias: np.ndarray
    slot_bias: np.ndarray


def _mix(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def feature_rows(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rows of the FEATURES features of each token's history. words: as _Words gives them; starts: where documents start."""
    n = len(words)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    words = words.astype(np.uint64)

    def before(k: int, what: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[k:] = what[:-k] if n > k else out[k:]
        out[place < k] = 0
        return out

    hashes, cells = words >> np.uint64(8), (words & np.uint64(255)) + np.uint64(1)
    a, b = before(1, cells), before(2, cells)
    keys = (before(1, hashes), before(2, hashes) | np.uint64(1 << 40), a | np.uint64(1 << 41), a << np.uint64(10) | b | np.uint64(1 << 42))
    return np.stack([_mix(k ^ k >> np.uint64(29), ROW_BITS) for k in keys])


def _logits(rows: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Bounded: a weight moves at most 2 * rate in each round, so exp() of them can't overflow."""
    z = np.take(table, rows[0], axis=0, mode="clip")
    z += bias
    for r in rows[1:]:
        z += np.take(table, r, axis=0, mode="clip")
    return z


def _soft(rows: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = _logits(rows, table, bias)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def _log_soft(rows: np.ndarray, table: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    z = _logits(rows, table, bias)
    own = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], np.float32))


def slot_rows(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return _mix(rows.astype(np.int64) * CLASSES + classes + (1 << 40), SLOT_BITS)


def log_cells(model: MaxEnt, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The natural log of P(cell | history) of each token."""
    out = np.empty(len(cells))
    for at in range(0, len(cells), SCORE_PART):
        c, r = cells[at : at + SCORE_PART], rows[:, at : at + SCORE_PART]
        k = c // SLOTS
        out[at : at + SCORE_PART] = _log_soft(r, model.w, model.bias, k)
        out[at : at + SCORE_PART] += _log_soft(slot_rows(r, k), model.v, np.take(model.slot_bias, k, axis=0), c % SLOTS)
    return out


class _Gradient:
    """Sums, for each weight, of what was observed and of what the model expects."""

    def __init__(self):
        self.seen = [np.zeros((ROWS, CLASSES)), np.zeros((SLOT_ROWS, SLOTS))]
        self.hoped = [np.zeros((CLASSES, ROWS)), np.zeros((SLOTS, SLOT_ROWS))]  # column by column

    def add(self, model: MaxEnt, cells: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(cells), PART):
            c, r = cells[at : at + PART].astype(np.int64), rows[:, at : at + PART]
            k, s = c // SLOTS, c % SLOTS
            for table, own, weights, target in ((0, r, model.w, k), (1, slot_rows(r, k), model.v, s)):
                size, width = self.seen[table].shape
                columns = np.empty((width, len(c)))
                for b in range(0, len(c), SCORE_PART):  # few enough for the cache
                    part = slice(b, b + SCORE_PART)
                    columns[:, part] = _soft(own[:, part], weights, np.take(model.slot_bias, k[part], axis=0) if table else model.bias).T
                own = own.astype(np.int64)  # once, else each count converts them
                self.seen[table] += np.bincount((own * width + target).ravel(), minlength=size * width).reshape(size, width)
                for x in own:
                    for j in range(width):
                        self.hoped[table][j] += np.bincount(x, weights=columns[j], minlength=size)

    def blobs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, observed, expected), as _short arrays, of the blocks of rows that have any."""
        block = 0
        for seen, hoped in zip(self.seen, (np.ascontiguousarray(x.T) for x in self.hoped), strict=True):
            for at in range(0, len(seen), BLOCK):
                if hoped[at : at + BLOCK].any():
                    yield block, _short(seen[at : at + BLOCK]), _short(hoped[at : at + BLOCK])
                block += 1


def _short(x: np.ndarray) -> bytes:
    """The upper half of each float, rounded: sums to within 1 in 512."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16).tobytes()


def _long(b: bytes) -> np.ndarray:
    """_short's, or whole floats, by their number."""
    if len(b) == BLOCK * SLOTS * 2:
        return (np.frombuffer(b, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)
    return np.frombuffer(b, np.float32).astype(np.float64)


class _Texts:
    """The tokens of a group's documents in the order of (id, text)."""

    def __init__(self, table):
        ids = table.column("id").to_pylist()
        texts = text_bytes(table.column("text").combine_chunks()) if table.num_rows else []
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        known, flat, sizes = _Ids(), [], []
        for i in order:
            words = tokens_of(texts[i])
            flat.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        self.rows, self.sizes = order, np.array(sizes, np.int64)
        self.flat = np.concatenate([np.empty(0, np.int32), *flat])
        self.words = list(known)
        hashes = np.fromiter(map(word_hash, self.words), np.uint64, len(self.words))
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        train = np.array(table.column("train").to_pylist(), bool)[order] if table.num_rows else np.zeros(0, bool)
        self.train = np.repeat(train, self.sizes)

    def slices(self, buckets: int) -> list[tuple[int, int, int]]:
        """(bucket, start, stop) over the sorted hashes."""
        bucket = ((self.sorted >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]


def _dealt(docs: DataFrame, id_col: str, text_col: str, train: Column) -> tuple[DataFrame, int, int]:
    """(id, text, train, grp), the number of groups and about the bytes of all texts."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = size_bytes(docs) * 2
    if total > 1 << 58:  # no estimate
        total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = min(CHUNK_BYTES[1], int(CHUNK_BYTES[0] * max(1, (total / 2**30) ** (1 / 3))))
    groups = max(1, math.ceil(total / chunk))
    return src.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")), groups, total


def count_words(dealt: DataFrame, groups: int) -> tuple[DataFrame, Vocabulary]:
    """Training counts of all words of each group (grp, bucket, counts), and the vocabulary's totals."""
    buckets = max(1, groups // 8)

    def count(key, table):
        import pyarrow as pa

        t = _Texts(table)
        n = np.bincount(t.flat[t.train], minlength=len(t.words))[t.order]
        cell = np.array([shared_cell(w) for w in t.words], np.uint8)[t.order]
        out = [(b, key[0].as_py(), t.sorted[i:j].tobytes(), _planes(n[i:j].astype(np.uint32)), cell[i:j].tobytes()) for b, i, j in t.slices(buckets)]
        return pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate((("bucket", pa.int32()), ("grp", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("cells", pa.binary())))})

    kinds = "grp int, bucket int, counts binary, mass array<long>, words array<long>, tops array<struct<h: long, n: long, cell: int>>"

    def total(key, table):
        import pyarrow as pa

        parts = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        n = np.concatenate([_unplanes(x, np.uint32) for x in table.column("counts").to_pylist()])
        known, first, where = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        sums = np.bincount(where, weights=n, minlength=len(known)).astype(np.int64)
        cells = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("cells").to_pylist()])[first].astype(np.int64)
        mass = np.bincount(cells, weights=sums, minlength=TOPS).astype(np.int64)
        words = np.bincount(cells[sums > 0], minlength=TOPS)
        best = np.lexsort((known.view(np.int64), -sums, known != word_hash(END)))[:TOPS]  # as below
        tops = [{"h": int(known[i].astype(np.int64)), "n": int(sums[i]), "cell": int(cells[i])} for i in best if sums[i]]
        back = np.split(sums[where].astype(np.uint64), np.cumsum([len(x) for x in parts])[:-1])
        rows, bucket = len(back), key[0].as_py()
        return pa.table({
            "grp": pa.array([*table.column("grp").to_pylist(), None], pa.int32()),
            "bucket": pa.array([bucket] * (rows + 1), pa.int32()),
            "counts": pa.array([*map(_planes, back), None], pa.binary()),
            "mass": pa.array([None] * rows + [mass.tolist()], pa.list_(pa.int64())),
            "words": pa.array([None] * rows + [words.tolist()], pa.list_(pa.int64())),
            "tops": pa.array([None] * rows + [tops], pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64()), ("cell", pa.int32())]))),
        })

    packed = dealt.groupBy("grp").applyInArrow(count, "bucket int, grp int, words binary, counts binary, cells binary")
    found = keep(packed.groupBy("bucket").applyInArrow(total, kinds))
    stats = found.where("grp IS NULL")
    mass, words = np.zeros(2 * TOPS, np.int64), np.zeros(2 * TOPS, np.int64)
    for r in stats.select(F.posexplode(F.arrays_zip("mass", "words")).alias("cell", "x")).groupBy("cell").agg(F.sum("x.mass").alias("mass"), F.sum("x.words").alias("words")).collect():  # one row a cell
        mass[TOPS + r["cell"]], words[TOPS + r["cell"]] = r["mass"], r["words"]
    tokens, distinct = int(mass.sum()), int(words.sum())
    end = word_hash(END)
    signed = end - 2**64 if end >= 2**63 else end
    best = stats.select(F.explode("tops").alias("x")).select("x.*").orderBy(F.when(F.col("h") == signed, 0).otherwise(1), F.desc("n"), "h").limit(TOPS).collect()
    tops = {}
    for i, r in enumerate(best):
        # neighbours in rank go to different classes, so that no class has all the mass
        cell = (i % (CLASSES // 2)) * SLOTS + i // (CLASSES // 2)
        tops[r["h"] % 2**64] = cell
        mass[cell], words[cell] = r["n"], 1
        mass[TOPS + r["cell"]] -= r["n"]
        words[TOPS + r["cell"]] -= 1
    return found.where("grp IS NOT NULL").select("grp", "bucket", "counts"), Vocabulary(tokens, distinct, tops, mass, words)


def start_model(vocabulary: Vocabulary) -> MaxEnt:
    prior = vocabulary.prior().reshape(CLASSES, SLOTS)
    return MaxEnt(np.zeros((ROWS, CLASSES), np.float32), np.zeros((SLOT_ROWS, SLOTS), np.float32), np.log(prior.sum(1)).astype(np.float32), np.log(prior / prior.sum(1, keepdims=True)).astype(np.float32))


def step(model: MaxEnt, seen: list[np.ndarray], hoped: list[np.ndarray], rate: float, ridge: float) -> MaxEnt:
    """A gradient step, each weight's scaled by its expected count; no step is longer than 2."""
    new = []
    for old, s, h in zip((model.w, model.v), seen, hoped, strict=True):
        new.append((old + rate * np.clip((s - h) / (h + ridge), -2, 2)).astype(np.float32))
    return MaxEnt(new[0], new[1], model.bias, model.slot_bias)


def train(docs: DataFrame, vocabulary: Vocabulary, size: int, rounds: int = ROUNDS, rate: float = 0.5, ridge: float = 10.0) -> MaxEnt:
    """docs: (id, text, train), of about size bytes. Round k takes a step along the gradient of the training documents that a hash of the id deals to it."""
    model, sc = start_model(vocabulary), docs.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, -(-size // TASK_BYTES))
    blocks, lots = (ROWS + SLOT_ROWS) // BLOCK, math.isqrt(tasks) + 1
    sizes = ((ROWS, CLASSES), (SLOT_ROWS, SLOTS))
    for k in range(rounds):
        shared = sc.broadcast((model, vocabulary.tops))  # of fixed size

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            now, tops = shared.value
            known, total = _Words(tops), _Gradient()
            waiting: list[np.ndarray] = []

            def flush() -> None:
                if waiting:
                    words = np.concatenate(waiting)
                    starts = np.cumsum([0, *(len(x) for x in waiting[:-1])])
                    total.add(now, words & 255, feature_rows(words, starts))
                    waiting.clear()

            held = 0
            for batch in batches:
                for text in text_bytes(batch.column(0)):
                    words = tokens_of(text)
                    waiting.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                    held += len(words)
                    if held >= PART:
                        flush()
                        held = 0
            flush()
            for block, seen, hoped in total.blobs():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen], pa.binary()), pa.array([hoped], pa.binary())], names=["block", "seen", "hoped"])

        def add(batches: Iterator) -> Iterator:
            import pyarrow as pa

            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for block, *both in zip(*(batch.column(c).to_pylist() for c in ("block", "seen", "hoped")), strict=True):
                    both = [_long(x) for x in both]
                    if block in sums:
                        for x, y in zip(sums[block], both, strict=True):
                            x += y
                    else:
                        sums[block] = both
            for block, (s, h) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([s.astype(np.float32).tobytes()], pa.binary()), pa.array([h.astype(np.float32).tobytes()], pa.binary())], names=["block", "seen", "hoped"])

        kind = "block int, seen binary, hoped binary"
        own = docs.where(F.col("train") & (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(rounds)) == k)).select("text")
        seen, hoped = ([np.zeros(n) for n in sizes] for _ in range(2))
        parts = own.coalesce(tasks).mapInArrow(run, kind).withColumn("lot", F.spark_partition_id() % lots)
        sums = parts.repartition(max(blocks, tasks), "block", "lot").mapInArrow(add, kind).repartition(blocks, "block").mapInArrow(add, kind)
        for r in sums.collect():  # the tables' fixed size
            table, at = (0, r["block"] * BLOCK) if r["block"] < ROWS // BLOCK else (1, (r["block"] - ROWS // BLOCK) * BLOCK)
            seen[table][at : at + BLOCK] = np.frombuffer(r["seen"], np.float32).reshape(-1, sizes[table][1])
            hoped[table][at : at + BLOCK] = np.frombuffer(r["hoped"], np.float32).reshape(-1, sizes[table][1])
        model = step(model, seen, hoped, rate, ridge)
        shared.destroy()
    return model


def score_texts(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are the runs without ASCII white space of the whole text, A-Z lower-cased, and one end. Counts
    and weights come from the rows for which train_on holds. base_score is the log10 probability under
    add-one smoothed counts, score the model's. Null and empty texts are their end alone; repeated rows
    are kept and counted each; without training rows all tokens are unknown; an empty table gives no
    rows. Words are told apart by 64-bit hashes. Extra columns are ignored.
    """
    dealt, groups, total = _dealt(docs, id_col, text_col, train_on)
    counts, vocabulary = count_words(dealt, groups)
    model = train(dealt, vocabulary, total, rounds)
    buckets = max(1, groups // 8)
    shared = docs.sparkSession.sparkContext.broadcast((model, vocabulary))  # of fixed size

    def score(key, table, found):
        import pyarrow as pa

        now, total = shared.value
        t = _Texts(table)
        by_bucket = dict(zip(found.column("bucket").to_pylist(), found.column("counts").to_pylist(), strict=True))
        c = np.empty(len(t.words), np.int64)
        for bucket, i, j in t.slices(buckets):
            c[t.order[i:j]] = _unplanes(by_bucket[bucket], np.uint64).astype(np.int64)
        known = _Words(total.tops, 1 << 62)
        word = np.array([known[w] for w in t.words], np.int64)
        cell = word & 255
        n, starts = len(t.sizes), np.concatenate([[0], np.cumsum(t.sizes)[:-1]]).astype(np.int64) if len(t.sizes) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), t.sizes)
        base = np.log10((c + 1) / (total.tokens + total.distinct + 1))
        inside = np.log((c + 1) / (total.mass[cell] + total.words[cell] + 1))
        cells = cell[t.flat]
        lines = inside[t.flat] + log_cells(now, cells, feature_rows(word[t.flat], starts))
        columns = [
            table.column("id").take(pa.array(t.rows, pa.int64())), table.column("train").take(pa.array(t.rows, pa.int64())), pa.array(t.sizes, pa.int64()),
            pa.array(np.bincount(owner, weights=(c > 0)[t.flat], minlength=n).astype(np.int64)), pa.array(np.full(n, total.tokens, np.int64)),
            pa.array(np.bincount(owner, weights=base[t.flat], minlength=n)), pa.array(np.bincount(owner, weights=lines, minlength=n) / math.log(10)),
        ]
        return pa.table(columns, names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("grp").cogroup(counts.groupBy("grp")).applyInArrow(score, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
