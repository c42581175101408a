"""Near duplicates by SimHash and deletion-variant signatures.

A fingerprint lane has 64 bits. It is cut into fewer segments than a plain equality index needs, so
that of two fingerprints which differ in max_bits bits some segment differs in at most one: for 4
bits, 3 segments. Each segment is indexed once per bit with that bit deleted; two fingerprints then
agree in a deletion variant, which an equality join on packed keys finds, and the lane is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, keep, mix64, shared_dir, text_bytes, with_key
from .components import connected_components
from .substring import _bounds, _planes, _unplanes

#: (lowest bit, width) of the segments of a lane.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CHUNK = 65_536
#: Classes of a group, rows of a bucket and pairs that are compared at once, about.
GROUP, BUCKET, PAIRS = 4_096, 1 << 17, 1 << 20
#: Parities of the numbers of a set's elements in 512 hash classes, 64 a column.
PARITIES = [f"p{k}" for k in range(8)]
#: What goes along to the buckets: the set's size and its parities, folded to 256 classes.
SKETCH = ("size", "q0", "q1", "q2", "q3")


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of width words of a lower-cased text; all words where they are fewer."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[width - 1 :].tolist() if len(words) > width else [len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; zero without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, lanes: int = 1, sketch: bool = False) -> DataFrame:
    """(id, f0 .. f<lanes-1>): 64-bit fingerprints as signed longs of each whole text; null and wordless texts get zeros.

    Lane 0 takes the shingles' hashes as they are, later ones a bijective remix of them. With sketch
    also size and p0 .. p7 of the set of their low 32 bits.
    """
    names, more = [f"f{k}" for k in range(lanes)], ["size", *PARITIES] if sketch else []

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out, marks = np.empty((lanes, batch.num_rows), np.uint64), np.zeros((batch.num_rows, len(more)), np.int64)
            for i, text in enumerate(text_bytes(batch.column(1))):
                h = shingle_hashes(text, shingle_words)
                if sketch:
                    own = np.unique(h.astype(np.uint32))
                    marks[i] = [len(own), *np.packbits(np.bincount(own % 512, minlength=512) & 1).view(np.int64)]
                for k in range(lanes):
                    out[k, i] = fingerprint(h if k == 0 else mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.view(np.int64)) for x in out), *(pa.array(np.ascontiguousarray(x)) for x in marks.T)], names=["id", *names, *more])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, " + ", ".join(f"{x} long" for x in [*names, *more]))


def _index(rows: DataFrame, n: int, lanes: int, more: list[str], search, kind: str) -> DataFrame:
    """search() over the rows that may share a deletion variant. rows: node, the lanes, the longs `more`; n: about their number.

    All variants of a segment with the deleted bit in one half keep its other half. So each row goes to
    a bucket twice a segment, by the values of the halves, and its variants are made there: 48 entries
    for 512 variants of eight lanes. Entries travel in packed arrays. Each has its lane and the next one.
    search(segment, bits, lanes, columns) gets the segments of a bucket's rows, the bits whose deletion
    leaves the half that they share, and returns columns of longs by name, as in kind.
    """
    names = [f"f{k}" for k in range(lanes)]
    groups, ranges = max(1, -(-n // GROUP)), min(1 << 10, max(1, -(-n // BUCKET)))
    buckets = lanes * len(SEGMENTS) * 2 * ranges
    sent = ["node", "f", "g", *more]
    dealt = rows.select("node", *names, *more, F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int").alias("grp")).repartition(groups, "grp")  # a task for each, small as they are

    def pack(key, table):
        import pyarrow as pa

        column = {c: table.column(c).to_numpy() for c in ("node", *names, *more)}
        out: dict[str, list] = {c: [] for c in ("bucket", *sent)}
        for j in range(lanes * len(SEGMENTS) * 2):
            (lane, part), half = divmod(j // 2, len(SEGMENTS)), j % 2
            lo, width = SEGMENTS[part]
            low = width // 2
            value = column[f"f{lane}"].view(np.uint64) >> np.uint64(lo + (low if half == 0 else 0)) & np.uint64((1 << (width - low if half == 0 else low)) - 1)
            at = (mix64(value + np.uint64(1)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            for x, y in _bounds(at[order]):
                rows = order[x:y]
                out["bucket"].append(j * ranges + int(at[rows[0]]))
                for c, source in zip(sent, ("node", f"f{lane}", f"f{(lane + 1) % lanes}", *more), strict=True):
                    out[c].append(_planes(column[source][rows]))
        return pa.table({c: pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in out.items()})

    def look(key, table):
        import pyarrow as pa

        part, half = divmod(key[0].as_py() // ranges % (2 * len(SEGMENTS)), 2)
        lo, width = SEGMENTS[part]
        low = width // 2
        column = {c: np.concatenate([_unplanes(x, np.int64) for x in table.column(c).to_pylist()]) for c in sent}
        order = np.argsort(column["node"], kind="stable")
        column = {c: x[order] for c, x in column.items()}
        segment = (column["f"].view(np.uint64) >> np.uint64(lo) & np.uint64((1 << width) - 1)).astype(np.uint32)
        return pa.table(search(segment, range(low) if half == 0 else range(low, width), min(2, lanes), column))

    packed = dealt.groupBy("grp").applyInArrow(pack, ", ".join(["bucket int", *(f"{c} binary" for c in sent)]))
    return packed.repartition(min(buckets, 10_000), "bucket").groupBy("bucket").applyInArrow(look, kind)


def _near(columns: dict, i: np.ndarray, j: np.ndarray, lanes: int, max_bits: int, least: float | None) -> np.ndarray:
    """Whether rows i and j are within max_bits a lane over their lane and the next, and of sketches that allow the similarity."""
    f, g = columns["f"].view(np.uint64), columns["g"].view(np.uint64)
    apart = np.bitwise_count(f[i] ^ f[j]).astype(np.int64)
    if lanes > 1:
        apart += np.bitwise_count(g[i] ^ g[j])
    ok = apart <= max_bits * lanes
    if least is not None:
        # differing parities are elements of one set only, see _may_be_similar
        only = sum(np.bitwise_count(q[i] ^ q[j]).astype(np.int64) for q in (columns[c].view(np.uint64) for c in SKETCH[1:]))
        a, b = columns["size"][i], columns["size"][j]
        ok &= np.maximum(only, np.abs(a - b)) * (1 + least) <= (a + b) * (1 - least) + 1e-6
    return ok


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the sorted keys the first place of its run and the place after it."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    return np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)


def _hubs(max_bits: int, least: float | None):
    """A search for (u, v): each row's smallest near row that is the smallest of a variant."""

    def search(segment, bits, lanes, columns):
        node = columns["node"]
        best = node.copy()
        for bit in bits:
            keys = segment & np.uint32(~(1 << bit) & 0xFFFFFFFF)
            order = np.argsort(keys, kind="stable")  # of one variant the smallest node first
            hub = order[_groups(keys[order])[0]]
            order, hub = order[hub != order], hub[hub != order]
            ok = _near(columns, order, hub, lanes, max_bits, least)
            best[order[ok]] = np.minimum(best[order[ok]], node[hub[ok]])
        far = best < node
        return {"u": node[far], "v": best[far]}

    return search


def _across(max_bits: int, least: float | None, by_component: bool):
    """A search for (u, v): near rows of different components c; those components instead, if by_component."""

    def search(segment, bits, lanes, columns):
        node, c = columns["node"], columns["c"]
        found = [np.zeros((0, 2), np.int64)]
        rank = np.unique(c, return_inverse=True)[1].astype(np.uint64)
        for bit in bits:
            keys = (segment & np.uint32(~(1 << bit) & 0xFFFFFFFF)).astype(np.uint64) << np.uint64(32) | rank
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            after, end = _groups(keys)[1], _groups(keys >> np.uint64(32))[1]
            count = end - after  # rows of the variant in later components
            some = np.flatnonzero(count)
            total = np.cumsum(count[some])
            for lot in np.split(some, np.searchsorted(total, np.arange(PAIRS, total[-1] if len(total) else 0, PAIRS), side="right")):
                i = np.repeat(lot, count[lot])
                j = np.repeat(after[lot] - np.concatenate([[0], np.cumsum(count[lot])[:-1]]).astype(np.int64), count[lot]) + np.arange(len(i))
                i, j = order[i], order[j]
                ok = _near(columns, i, j, lanes, max_bits, least)
                value = c if by_component else node
                x, y = value[i[ok]], value[j[ok]]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return {"u": np.ascontiguousarray(pairs[:, 0]), "v": np.ascontiguousarray(pairs[:, 1])}

    return search


def _may_be_similar(least: float, marks: list[str], a: str, b: str) -> str:
    """SQL: false only of sets with a Jaccard similarity below least: of size and parities, each differing parity is an element of one set only."""
    apart = " + ".join(f"bit_count({a}{m} ^ {b}{m})" for m in marks)
    return f"greatest({apart}, abs({a}size - {b}size)) * {1 + least}D <= ({a}size + {b}size) * {1 - least}D + 1e-6D"


def _similar(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int, least: float, scratch: str) -> DataFrame:
    """The (u, v) whose documents' sets of shingles, told apart by 32 bits of hash, have a Jaccard similarity of at least least."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            blobs = [np.unique(shingle_hashes(t, shingle_words).astype(np.uint32)).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "s"])

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = []
            for a, b in zip(*(c.to_pylist() for c in (batch.column(2), batch.column(3))), strict=True):
                x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi").dropDuplicates(["id"])
    held = shared_dir(docs.sparkSession)
    found = keep(src.mapInArrow(sets, "id long, s binary"), held)
    x, y = (found.select(F.col("id").alias(n), F.col("s").alias(f"s{n}")) for n in "uv")
    out = keep(pairs.join(x, "u").join(y, "v").select("u", "v", "su", "sv").mapInArrow(verify, "u long, v long"), scratch)
    discard(docs.sparkSession, held)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 4, lanes: int = 1, min_jaccard: float | None = None) -> DataFrame:
    """(id, f0 .., component): each row of docs with its fingerprints and the smallest id that links reach.

    Two fingerprints link if in some lane a segment differs in at most one bit and the lane in at most
    max_bits (with one lane and max_bits <= 4 that is every pair within max_bits; with more lanes that lane
    and the next together, in twice as many); with min_jaccard their documents' sets of shingles must be
    that similar, too. Equal fingerprints always link. Classes of equal fingerprints count once. Each is
    compared with the smallest member of each of its variants first; only pairs between the components
    that this leaves are searched, so a dense group yields no pairs within it. Pairs whose sets can't be
    that similar by their sizes and parities aren't verified; that loses none.
    Null and wordless texts have fingerprint zero and link with each other; rows with a null id form
    classes but are no one's representative unless a class has no other (their component is null
    then); repeated rows and ids are kept; an empty table gives no rows. Extra columns are ignored.
    """
    spark, scratch = docs.sparkSession, shared_dir(docs.sparkSession)
    try:
        return _near_duplicates(docs, id_col, text_col, shingle_words, max_bits, lanes, min_jaccard, scratch)
    finally:
        discard(spark, scratch)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int, lanes: int, min_jaccard: float | None, scratch: str) -> DataFrame:
    names = [f"f{k}" for k in range(lanes)]
    sketch = min_jaccard is not None
    rows = keep(fingerprints(docs, id_col, text_col, shingle_words, lanes, sketch), scratch)
    sizes = [F.min_by(x, "id").alias(x) for x in ("size", *PARITIES)] if sketch else []
    classes = keep(rows.groupBy(*names).agg(F.min("id").alias("node"), *sizes), scratch)
    short = [F.expr(f"p{k} ^ p{k + 4}").alias(f"q{k}") for k in range(4)] if sketch else []
    named = classes.where("node is not null").select("*", *short)
    n, more = named.count(), list(SKETCH) if sketch else []

    def possible(pairs: DataFrame) -> DataFrame:
        x, y = (named.select(F.col("node").alias(m), *(F.col(c).alias(f"{a}_{c}") for c in ("size", *PARITIES))) for m, a in (("u", "a"), ("v", "b")))
        return pairs.join(x, "u").join(y, "v").where(_may_be_similar(min_jaccard, PARITIES, "a_", "b_")).select("u", "v")

    verified = (lambda p: keep(p, scratch)) if min_jaccard is None else (lambda p: _similar(keep(possible(p), scratch), docs, id_col, text_col, shingle_words, min_jaccard, scratch))
    hubs = _index(named, n, lanes, more, _hubs(max_bits, min_jaccard), "u long, v long")
    stars = verified(hubs.groupBy("u").agg(F.min("v").alias("v")))
    part = keep(connected_components(stars, scratch=scratch), scratch)
    known = named.join(part, "node", "left").withColumn("c", F.coalesce("component", "node"))
    pairs = _index(known, n, lanes, [*more, "c"], _across(max_bits, min_jaccard, not sketch), "u long, v long")
    links = verified(pairs.distinct()).union(part.select(F.col("node").alias("u"), F.col("component").alias("v")))
    whole = connected_components(links, scratch=scratch)
    reach = classes.join(whole, "node", "left").select(*names, F.coalesce("component", "node").alias("component"))
    return keep(rows.join(reach, names).select("id", *names, "component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 16, lanes: int = 8, min_jaccard: float = 0.8) -> DataFrame:
    """docs without the near duplicates of a row with a smaller id; of each group one row stays.

    Rows are judged one by one by their texts: of repeated rows one stays, and several texts of one id
    stay apart. Rows without an id, and all but one of the rows of an id, count after all others. Null and
    wordless texts are one group. An empty table gives no rows.
    """
    keyed = with_key(docs, id_col, "__key")
    found = near_duplicates(keyed, "__key", text_col, shingle_words, max_bits, lanes, min_jaccard)
    gone = found.where("id <> component").select(F.col("id").alias("__key")).distinct()
    return keyed.join(gone, "__key", "left_anti").drop("__key")
