"""Models over sparse features: FTRL-proximal regression, field-aware factorization machine, its network variant and an embedding network; boosted trees; baselines from pyspark.ml.

Training is by averaged parameters: each task runs steps over its rows from the same start, and the
averages start the next epoch, for which rows are dealt and ordered anew by a seeded hash. Parameters
have a fixed size, whatever the data; the number of tasks follows the number of rows, so results don't
depend on the cluster. Layers and factors are as wide as usual for these models; the slots into which
features are hashed are fewer (SLOT_BITS), so that a task's parameters stay at some 20 MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .metrics import logloss

FIELDS = 40
#: Hashed slots, as bits, and factors of each kind unless given.
SLOT_BITS = {"ftrl": 20, "ffm": 12, "ffm_nn": 12, "nn": 14}
FACTORS = {"ftrl": 0, "ffm": 14, "ffm_nn": 16, "nn": 96}
HIDDEN = {"ffm_nn": (24,), "nn": (64, 48)}
#: Rows of a task in an epoch, about.
PART_ROWS = 20_000
#: Of FTRL-proximal steps.
ALPHA, BETA, L1, L2 = 1.0, 2.0, 2e-4, 5e-4


@dataclass
class Params:
    kind: str
    arrays: dict[str, np.ndarray]
    bits: int = 12
    k: int = 4
    restricted: bool = False
    #: Of each epoch: the mean log loss of training rows as they were learned, and that of the validation rows after it (or None).
    losses: tuple = ()


#: Restricted pairs hold a feature of the page or common fields and one of the common or ad fields.
LAST_LOW, FIRST_HIGH = 29, 10


def _start(kind: str, bits: int, k: int, seed: int = 2017) -> Params:
    rng, n = np.random.default_rng(seed), 1 << bits
    layer = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape)
    if kind == "ftrl":
        a = {"z": np.zeros(n), "n": np.zeros(n)}
    elif kind == "nn":
        one, two = HIDDEN["nn"]
        a = {"e": rng.normal(0, 0.1, (n, k)), "w1": layer(k, one), "w2": layer(one, two), "w3": layer(two), "b": np.zeros(1)}
    else:
        a = {"w": np.zeros(n), "v": rng.uniform(0, 1 / np.sqrt(k), (n, FIELDS, k)), "b": np.zeros(1)}
        if kind == "ffm_nn":
            a |= {"w1": layer(k, *HIDDEN["ffm_nn"]), "w2": layer(*HIDDEN["ffm_nn"])}
    return Params(kind, a, bits, k)


#: Of a code, the bits below those of the field.
CODE_BITS = 24


def _codes(bits: int) -> Column:
    """array<int>: of each feature its slot and, above CODE_BITS, its field. Rows travel so instead of as structs."""
    slot = lambda f: F.pmod(F.shiftright(f["index"] * F.lit(0x9E3779B1).cast("long") + f["field"].cast("long") * F.lit(0x85EBCA6B).cast("long"), 7), F.lit(1 << bits).cast("long"))
    return F.transform("features", lambda f: (f["field"].cast("long") * F.lit(1 << CODE_BITS) + slot(f)).cast("int"))


def _values() -> Column:
    return F.transform("features", lambda f: f["value"].cast("double"))


def _flat(codes, values) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of an Arrow batch: where each row's features begin (and the last row's end), and their fields, slots and values."""
    at = np.concatenate([[0], np.cumsum(codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    c = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return at, c >> CODE_BITS, c & ((1 << CODE_BITS) - 1), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


@lru_cache(maxsize=512)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _sigmoid(t: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(t, -30, 30))))


def _weights(p: Params, i: np.ndarray) -> np.ndarray:
    z, n = p.arrays["z"][i], p.arrays["n"][i]
    return np.where(np.abs(z) < L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _forward(p: Params, x, drop_log: int = 0, rng=None) -> tuple[float, dict]:
    """The score and what the gradient needs; with drop_log, each pair is left out with probability 2^-drop_log, the others count more for it."""
    field, i, v = x
    a = p.arrays
    if p.kind == "ftrl":
        return float(_weights(p, i) @ v), {}
    if p.kind == "nn":
        h0 = np.maximum((a["e"][i] * v[:, None]).sum(0) / max(1, len(i)), 0)
        h1 = np.maximum(h0 @ a["w1"], 0)
        h2 = np.maximum(h1 @ a["w2"], 0)
        return float(h2 @ a["w3"] + a["b"][0]), {"h0": h0, "h1": h1, "h2": h2}
    s, t = _pairs(len(i))
    if p.restricted:
        on = (np.minimum(field[s], field[t]) <= LAST_LOW) & (np.maximum(field[s], field[t]) >= FIRST_HIGH)
        s, t = s[on], t[on]
    scale = 1.0
    if drop_log and rng is not None:
        on = rng.random(len(s)) >= 0.5**drop_log
        s, t, scale = s[on], t[on], 2**drop_log / (2**drop_log - 1)
    norm = max(1e-9, float(v @ v))
    at = np.concatenate([i[s] * FIELDS + field[t], i[t] * FIELDS + field[s]])
    both = a["v"].reshape(-1, p.k).take(at, axis=0)
    left, right = both[: len(s)], both[len(s) :]
    c = (scale * v[s] * v[t] / norm).astype(both.dtype)
    products = c @ (left * right)
    linear = float(a["w"][i] @ v) / max(1, len(i)) + float(a["b"][0])
    if p.kind == "ffm":
        return linear + float(products.sum()), {"at": at, "both": both, "c": c}
    h0 = np.maximum(products, 0)
    h1 = np.maximum(h0 @ a["w1"], 0)
    return linear + float(h1 @ a["w2"]), {"at": at, "both": both, "c": c, "h0": h0, "h1": h1}


def _update(p: Params, x, y: float, eta: float, l2: float, sums: dict, drop_log: int = 0, rng=None) -> float:
    """One step of adaptive gradient descent (FTRL-proximal for ftrl); the row's log loss before it."""
    field, i, v = x
    a = p.arrays
    t, m = _forward(p, x, drop_log, rng)
    g, loss = _sigmoid(t) - y, float(np.logaddexp(0, -t if y > 0 else t))
    if p.kind == "ftrl":
        grad, w, n = g * v, _weights(p, i), a["n"][i]
        np.add.at(a["z"], i, grad - (np.sqrt(n + grad**2) - np.sqrt(n)) / ALPHA * w)
        np.add.at(a["n"], i, grad**2)
        return loss

    def move(name: str, at, grad) -> None:
        old = a[name][at]
        grad = grad + l2 * old
        so_far = sums[name][at] + grad**2
        sums[name][at] = so_far
        a[name][at] = old - eta * grad / np.sqrt(so_far)

    if p.kind == "nn":
        d2 = g * a["w3"] * (m["h2"] > 0)
        d1 = (a["w2"] @ d2) * (m["h1"] > 0)
        d0 = (a["w1"] @ d1) * (m["h0"] > 0)
        move("w3", slice(None), g * m["h2"])
        move("w2", slice(None), np.outer(m["h1"], d2))
        move("w1", slice(None), np.outer(m["h0"], d1))
        move("e", i, d0[None, :] * v[:, None] / max(1, len(i)))
        move("b", slice(None), np.array([g]))
        return loss
    move("w", i, g * v / max(1, len(i)))
    move("b", slice(None), np.array([g]))
    each = np.full(p.k, g, m["both"].dtype)
    if p.kind == "ffm_nn":
        d1 = g * a["w2"] * (m["h1"] > 0)
        each = ((a["w1"] @ d1) * (m["h0"] > 0)).astype(each.dtype)
        move("w2", slice(None), g * m["h1"])
        move("w1", slice(None), np.outer(m["h0"], d1))
    at, both, n = m["at"], m["both"], len(m["c"])
    share = m["c"][:, None] * each
    grad = np.concatenate([both[n:] * share, both[:n] * share])  # both sides of each pair in one step
    grad += both.dtype.type(l2) * both
    weights, seen = a["v"].reshape(-1, p.k), sums["v"].reshape(-1, p.k)
    so_far = seen.take(at, axis=0)
    so_far += grad * grad
    seen[at] = so_far
    np.sqrt(so_far, out=so_far)
    grad *= both.dtype.type(eta)
    grad /= so_far
    weights[at] = both - grad
    return loss


def _scores(p: Params, at: np.ndarray, field: np.ndarray, i: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The scores of many rows, as _forward gives them one by one.

    Pairs are not formed: a row's vectors are summed by field, and the sums' products hold every pair twice and each feature with itself once.
    """
    a, rows = p.arrays, len(at) - 1
    size, row = np.diff(at), np.repeat(np.arange(rows), np.diff(at))
    if p.kind == "ftrl":
        return np.bincount(row, _weights(p, np.arange(len(a["z"])))[i] * v, rows)
    ends = list(zip(range(rows), at[:-1].tolist(), at[1:].tolist(), strict=True))
    if p.kind == "nn":
        h = np.zeros((rows, p.k))
        for r, lo, hi in ends:
            h[r] = v[lo:hi] @ a["e"].take(i[lo:hi], axis=0)
        h = np.maximum(h / np.maximum(1, size)[:, None], 0)
        return np.maximum(np.maximum(h @ a["w1"], 0) @ a["w2"], 0) @ a["w3"] + a["b"][0]
    vectors, weight = a["v"].reshape(-1, FIELDS * p.k).astype(np.float32), v.astype(np.float32)
    products = np.zeros((rows, p.k))
    for r, lo, hi in ends:
        if lo == hi:
            continue
        each, w = vectors.take(i[lo:hi], axis=0), weight[lo:hi]
        used, f = np.unique(field[lo:hi], return_inverse=True)
        of = np.zeros((len(used), hi - lo), np.float32)
        of[f, np.arange(hi - lo)] = w
        sums = (of @ each).reshape(len(used), FIELDS, p.k)[:, used]
        twice = sums * sums.transpose(1, 0, 2)
        own = (each.reshape(-1, FIELDS, p.k)[np.arange(hi - lo), field[lo:hi]] * w[:, None]).astype(np.float64) ** 2
        if p.restricted:
            on = (np.minimum(used[:, None], used[None, :]) <= LAST_LOW) & (np.maximum(used[:, None], used[None, :]) >= FIRST_HIGH)
            twice, own = twice * on[:, :, None], own * on[f, f][:, None]
        products[r] = (twice.sum((0, 1), dtype=np.float64) - own.sum(0)) / 2
    products /= np.maximum(1e-9, np.bincount(row, v * v, rows))[:, None]
    linear = np.bincount(row, a["w"][i] * v, rows) / np.maximum(1, size) + a["b"][0]
    if p.kind == "ffm":
        return linear + products.sum(1)
    return linear + np.maximum(np.maximum(products, 0) @ a["w1"], 0) @ a["w2"]



#: Bytes of parameters that come to the driver at once.
WAVE_BYTES = 1 << 27


def _in_waves(rdd, size: int) -> Iterator:
    """An RDD's rows in the order of its partitions, each of some size bytes. Tasks of a wave run side by side; a wave is as many as the driver holds at once, in full rounds of the cores."""
    sc, wave = rdd.context, max(1, WAVE_BYTES // size)
    wave -= wave % sc.defaultParallelism if wave > sc.defaultParallelism else 0
    for lo in range(0, parts := rdd.getNumPartitions(), wave):
        yield from sc.runJob(rdd, lambda each: map(tuple, each), range(lo, min(lo + wave, parts)))


def fit(rows: DataFrame, kind: str, epochs: int = 1, eta: float | None = None, l2: float = 2e-5, bits: int | None = None, k: int | None = None, parts: int | None = None, seed: int = 2017, drop_log: int = 1, restricted: bool = False, val: DataFrame | None = None) -> Params:
    """kind: ftrl, ffm, ffm_nn or nn. rows: label (negative: not trained on) and features. drop_log and restricted are about the pairs of ffm and ffm_nn.

    Losses of each epoch are in the result's losses; val: rows on which each epoch's model is tried.
    """
    params, sc = _start(kind, bits or SLOT_BITS[kind], k or FACTORS[kind], seed), rows.sparkSession.sparkContext
    eta = eta or {"ffm": 0.2, "ffm_nn": 0.05, "nn": 0.02}.get(kind, 0.0)
    params.restricted, losses = restricted, []
    known = rows.where("label >= 0").select("label", "features", _codes(params.bits).alias("codes"), _values().alias("values"))
    parts = parts or max(1, -(-known.count() // PART_ROWS))
    for epoch in range(epochs):
        shared = sc.broadcast(params)
        data = known.withColumn("h", F.xxhash64("features", "label", F.lit(seed), F.lit(epoch))).drop("features").repartition(parts, "h").sortWithinPartitions("h")

        def run(batches: Iterator, shared=shared, epoch=epoch) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            short = {"v"} if shared.value.kind in ("ffm", "ffm_nn") else set()  # the large table, 32 bits a number
            p = Params(shared.value.kind, {n: x.astype(np.float32) if n in short else x.copy() for n, x in shared.value.arrays.items()}, shared.value.bits, shared.value.k, shared.value.restricted)
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            sums, seen, loss = {n: np.ones_like(x) for n, x in p.arrays.items()}, 0, 0.0
            for batch in batches:
                at, *parts_of = _flat(batch.column("codes"), batch.column("values"))
                for y, lo, hi in zip(batch.column("label").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    loss += _update(p, tuple(x[lo:hi] for x in parts_of), y, eta, l2, sums, drop_log, rng)
                    seen += 1
            if seen:
                p.arrays["loss"] = np.array([loss / seen])
                for name, x in p.arrays.items():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([seen], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["name", "n", "x"])

        total: dict[str, list] = {}
        for name, n, x in _in_waves(data.mapInArrow(run, "name string, n long, x binary").rdd, 4 * sum(x.size for x in params.arrays.values())):
            x = np.frombuffer(x, np.float32).astype(np.float64) * n
            old = total.get(name)
            total[name] = [x if old is None else old[0] + x, n + (0 if old is None else old[1])]
        if total:
            mean = {n: x / count for n, (x, count) in total.items()}
            params = Params(kind, {n: mean[n].reshape(a.shape) for n, a in params.arrays.items()}, params.bits, params.k, restricted)
            tried = None if val is None else logloss(predict(params, val), F.col("pred")).first()["logloss"]
            losses.append((float(mean["loss"][0]), tried))
        shared.destroy()
    params.losses = tuple(losses)
    return params


def predict(params: Params, rows: DataFrame) -> DataFrame:
    """Adds pred: the probability of a click."""
    return predict_bags([params], rows)


def predict_bags(bags: list[Params], rows: DataFrame, by_score: bool = False) -> DataFrame:
    """Adds pred: the mean of the models' probabilities, or with by_score the probability of their mean score."""
    shared, widths = rows.sparkSession.sparkContext.broadcast(bags), sorted({p.bits for p in bags})

    @F.arrow_udf("double")
    def score(values, *codes):
        import pyarrow as pa

        total, kinds = 0.0, dict(zip(widths, codes, strict=True))
        for p in shared.value:
            t = _scores(p, *_flat(kinds[p.bits], values))
            total = total + (t if by_score else 1 / (1 + np.exp(-np.clip(t, -30, 30))))
        mean = total / len(shared.value)
        return pa.array(1 / (1 + np.exp(-np.clip(mean, -30, 30))) if by_score else mean, pa.float64())

    return rows.withColumn("pred", score(_values(), *map(_codes, widths)))


#: Of boosted trees: how many, their depth, the share of a tree's leaves that counts, the weight that holds leaves back and the least of a child, and bins of a column.
TREES, DEPTH, STEP, LEAF_L2, LEAST_CHILD, BINS = 1500, 4, 0.05, 1.0, 1.0, 32
#: Gradients are counted in such parts, as whole numbers: sums are the same however rows are dealt.
UNIT = 1 << 24
#: Cells of a step within a task, values of columns that are counted as one, and rows of a task at least.
CHUNK, JOINT, TASK_ROWS = 1 << 17, 4096, 20_000


def _together(widths: list[int], most: int) -> list[list[int]]:
    """Columns in groups whose widths' product is at most `most` (a wider column is alone), wide ones first."""
    groups: list[list[int]] = []
    for c in sorted(range(len(widths)), key=lambda c: -widths[c]):
        fits = (g for g in groups if np.prod([float(widths[x]) for x in [*g, c]]) <= most)
        if (g := next(fits, None)) is None:
            groups.append(g := [])
        g.append(c)
    return groups


def _best_splits(sums: np.ndarray, widths: list[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of each node its column and the last bin that goes left (the last of all: no split), and the sums of its two children. sums: (2, nodes, bins of all columns)."""
    starts, nodes = np.concatenate([[0], np.cumsum(widths)]), sums.shape[1]
    whole = sums[:, :, : widths[0]].sum(2)
    best, splits, children = np.zeros(nodes), [(0, widths[0] - 1)] * nodes, np.stack([whole, np.zeros_like(whole)], 2)
    score = lambda x: x[0] ** 2 / (x[1] + LEAF_L2)
    for c, width in enumerate(widths):
        if width < 2:
            continue
        left = np.cumsum(sums[:, :, starts[c] : starts[c + 1]], 2)[:, :, :-1]
        right = whole[:, :, None] - left
        gain = np.where((left[1] >= LEAST_CHILD) & (right[1] >= LEAST_CHILD), score(left) + score(right) - score(whole)[:, None], 0.0)
        for k, t in enumerate(gain.argmax(1)):
            if gain[k, t] > best[k]:
                best[k], splits[k], children[:, k] = gain[k, t], (c, int(t)), np.stack([left[:, k, t], right[:, k, t]], 1)
    return splits, children.reshape(2, -1)


def boost(bins: list[np.ndarray], seen: np.ndarray, clicks: np.ndarray, widths: list[int], trees: int, together=lambda x: x) -> tuple[np.ndarray, list]:
    """Scores of cells (rows with equal bins, of which `seen` have a known label and `clicks` a positive one) after so many boosted trees for log loss, and the trees as (splits of each level, leaves).

    together sums an array over all tasks; every task then makes the same trees.
    """
    cells, groups = len(seen), _together(widths, JOINT)
    sizes = [int(np.prod([widths[c] for c in g])) for g in groups]
    strides = {c: int(np.prod([widths[x] for x in g[k + 1 :]], dtype=np.int64)) for g in groups for k, c in enumerate(g)}
    joint = [sum((bins[c].astype(np.int32) * strides[c] for c in g), np.zeros(cells, np.int32)) for g in groups]
    n, y = together(np.array([seen.sum(), clicks.sum()], np.float64))
    made, value, node = [], np.full(cells, np.log(y / (n - y))), np.zeros(cells, np.uint8)
    grad, hess = np.zeros(cells), np.zeros(cells)
    parts = [slice(lo, min(lo + CHUNK, cells)) for lo in range(0, cells, CHUNK)]

    def sides(splits: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
        """Of each group of columns that splits use: which of its values go right, by node."""
        out = []
        for k, g in enumerate(groups):
            if any(c in g for c, _ in splits):
                at = np.arange(sizes[k])
                out.append((k, np.concatenate([(at // strides[c] % widths[c] > t if c in g else np.zeros(sizes[k], bool)) for c, t in splits]).astype(np.uint8)))
        return out

    def moved(part: slice, right: list[tuple[int, np.ndarray]]) -> np.ndarray:
        old = node[part].astype(np.int64)
        return 2 * old + sum(go[old * sizes[k] + joint[k][part]] for k, go in right)

    for _ in range(trees):
        levels, right = [], None
        for level in range(DEPTH):
            nodes = 1 << level
            sums = [np.zeros((2, nodes * size)) for size in sizes]
            for part in parts:
                if right is None:
                    p = 1 / (1 + np.exp(-value[part]))
                    grad[part], hess[part] = np.rint((clicks[part] - seen[part] * p) * UNIT), np.rint(seen[part] * p * (1 - p) * UNIT)
                    now = np.zeros(part.stop - part.start, np.int64)
                else:
                    now = moved(part, right)
                node[part] = now
                for k, size in enumerate(sizes):
                    key = now * size + joint[k][part]
                    sums[k][0] += np.bincount(key, grad[part], nodes * size)
                    sums[k][1] += np.bincount(key, hess[part], nodes * size)
            each: list = [None] * len(widths)
            for g, s in zip(groups, sums, strict=True):
                s = s.reshape(2, nodes, *(widths[c] for c in g))
                for k, c in enumerate(g):
                    each[c] = s.sum(tuple(2 + x for x in range(len(g)) if x != k))
            splits, children = _best_splits(together(np.concatenate(each, 2)) / UNIT, widths)
            levels.append(splits)
            right = sides(splits)
        leaves = STEP * children[0] / (children[1] + LEAF_L2)
        for part in parts:
            value[part] += leaves[moved(part, right)]
        made.append((levels, leaves))
    return value, made


class _Together:
    """Sums arrays over the tasks of a barrier stage: the first task adds what the others send it."""

    def __init__(self, context) -> None:
        import secrets
        import socket

        self.rank, host = context.partitionId(), context.getTaskInfos()[0].address.split(":")[0]
        server = socket.create_server((host, 0)) if self.rank == 0 else None
        port, token = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0].split()
        self.peers: list = []
        if server is None:
            self.peers = [socket.create_connection((host, int(port)), 600)]
            self.peers[0].sendall(token.encode())
        while server and len(self.peers) < len(context.getTaskInfos()) - 1:
            server.settimeout(600)
            peer = server.accept()[0]
            if self._read(peer, len(token)) == token.encode():
                self.peers.append(peer)
        for peer in self.peers:
            peer.settimeout(None)
            peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(peer, size: int) -> bytes:
        out = bytearray()
        while len(out) < size:
            if not (more := peer.recv(size - len(out))):
                raise ConnectionError("a task of the fit has ended")
            out += more
        return bytes(out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.rank:
            self.peers[0].sendall(x.tobytes())
            return np.frombuffer(self._read(self.peers[0], x.nbytes)).reshape(x.shape)
        total = x + sum(np.frombuffer(self._read(peer, x.nbytes)).reshape(x.shape) for peer in self.peers)
        for peer in self.peers:
            peer.sendall(total.tobytes())
        return total


def boosted(rows: DataFrame, columns: list[str], trees: int = TREES, kept: list[str] | None = None) -> DataFrame:
    """Adds pred by boosted trees of columns (missing: 0), fitted on rows with a known label.

    kept: the columns that the result has besides, all unless given. Columns are cut at BINS quantiles; rows with equal bins are one cell with counts. Rows are dealt by cell once,
    to at most as many tasks as run at once. A task holds its cells in memory (some 50 bytes each) and its rows in a file, while all tasks make all trees in one barrier stage.
    """
    sc, known = rows.sparkSession.sparkContext, F.col("label") >= 0
    of = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in columns}
    at = [k / BINS for k in range(1, BINS)] + [1.0]
    facts = rows.agg(F.count_if(F.col("label") > 0).alias("y"), F.count_if(known).alias("n"), F.count("*").alias("rows"), *(F.percentile_approx(F.when(known, x), at, 10_000).alias(f"q{k}") for k, x in enumerate(of.values()))).first()
    if not 0 < facts["y"] < facts["n"]:
        return rows.select(*kept or rows.columns, F.lit(0.5).alias("pred"))
    edges = [sorted({e for e in facts[f"q{k}"][:-1] if e < facts[f"q{k}"][-1]}) for k in range(len(columns))]
    widths = [len(e) + 1 for e in edges]
    packs = _together(widths, 1 << 40)
    code = [sum(((x > F.lit(e)).cast("long") for e in es), F.lit(0).cast("long")) for x, es in zip(of.values(), edges, strict=True)]
    kept, keys = kept or rows.columns, [f"__cell{k}" for k in range(len(packs))]
    for name, pack in zip(keys, packs, strict=True):
        value = F.lit(0).cast("long")
        for c in pack:
            value = value * widths[c] + code[c]
        rows = rows.withColumn(name, value)
    tasks = max(1, min(sc.defaultParallelism, -(-facts["rows"] // TASK_ROWS)))
    label = (F.when(known, 1).otherwise(0) + F.when(F.col("label") > 0, 2).otherwise(0)).cast("long")
    dealt = rows.select((F.col(keys[0]) * 4 + label).alias(keys[0]), *keys[1:], *kept).repartition(tasks, F.shiftright(keys[0], 2), *keys[1:])

    def run(batches: Iterator) -> Iterator:
        import tempfile

        import pyarrow as pa
        from pyspark import BarrierTaskContext

        file, writer = tempfile.TemporaryFile(), None
        found: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in keys}
        for batch in batches:
            for k in keys:
                found[k].append(batch.column(k).to_numpy(zero_copy_only=False).copy())
            others = batch.select(kept)
            writer = writer or pa.ipc.new_stream(file, others.schema)
            writer.write_batch(others)
        if writer:
            writer.close()
        codes = {k: np.concatenate(found.pop(k)) for k in keys}
        order = np.lexsort(tuple(codes.values()))
        codes = {k: x[order] for k, x in codes.items()}
        label, codes[keys[0]] = codes[keys[0]] & 3, codes[keys[0]] >> 2
        new = np.ones(len(label), bool)
        if len(label):
            new[1:] = np.any([x[1:] != x[:-1] for x in codes.values()], axis=0)
        starts = np.flatnonzero(new)
        counts = [np.add.reduceat(x.astype(np.float64), starts) if len(starts) else np.zeros(0) for x in (label & 1, label >> 1)]
        codes, bins = {k: x[starts] for k, x in codes.items()}, [np.zeros(0)] * len(widths)
        cell = np.empty(len(label), np.int32)
        cell[order] = np.cumsum(new) - 1
        del label, order, new
        for k, pack in zip(keys, packs, strict=True):
            left = codes[k]
            for c in reversed(pack):
                bins[c], left = (left % widths[c]).astype(np.uint8), left // widths[c]
        value, _ = boost(bins, *counts, widths, trees, _Together(BarrierTaskContext.get()))
        pred, lo = 1 / (1 + np.exp(-value)), 0
        file.seek(0)
        for batch in pa.ipc.open_stream(file) if writer else ():
            hi = lo + batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred[cell[lo:hi]])], names=[*kept, "pred"])
            lo = hi

    return stored(dealt.mapInArrow(run, rows.select(*kept).schema.add("pred", "double"), barrier=True))


def spark_ml(rows: DataFrame, kind: str, columns: list[str], kept: list[str] | None = None) -> DataFrame:
    """Adds pred by a classifier of columns, fitted on rows with a known label: lr and mlp of pyspark.ml, gbt by boosted(). kept: the columns that gbt keeps besides, all unless given."""
    if kind == "gbt":
        return boosted(rows, columns, kept=kept)
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = {
        "lr": lambda: LogisticRegression(labelCol="__y", featuresCol="__x", regParam=0.01, elasticNetParam=0.1, maxIter=20),
        "mlp": lambda: MultilayerPerceptronClassifier(labelCol="__y", featuresCol="__x", layers=[len(columns), 24, 2], maxIter=20, seed=2017),
    }[kind]()
    rows = rows.withColumn("__y", F.greatest(F.col("label"), F.lit(0)).cast("double"))
    for c in columns:
        rows = rows.withColumn(f"__c_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    steps = Pipeline(stages=[VectorAssembler(inputCols=[f"__c_{c}" for c in columns], outputCol="__vec"), StandardScaler(inputCol="__vec", outputCol="__x", withMean=True), made])
    known = rows.where("label >= 0")
    if not known.select("__y").distinct().count() > 1:
        return rows.withColumn("pred", F.lit(0.5))
    out = steps.fit(known).transform(rows).withColumn("pred", vector_to_array("probability")[1])
    return out.drop("__vec", "__x", "__y", "rawPrediction", "probability", "prediction", *(f"__c_{c}" for c in columns))
