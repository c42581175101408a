"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

Each source's documents, in a seeded random order, are cut into blocks. Weights are whole shares of a
period of p slots, to which they sum exactly. Block k of a source with share w is released at slot
floor(k * p / w) and due by slot ceil((k + 1) * p / w). One block runs in each slot: of those released,
the one with the earliest deadline. All deadlines are met then, so after any number of slots each
source is less than one block from its target. The schedule repeats after p slots: one period, or as
much of it as there are blocks for, is computed, and blocks beyond it shift by whole periods. Sources
of equal shares have equal windows and take turns, so a slot's choice is among the distinct shares,
however many sources there are. Slots of a source that has run out are passed over; the others keep
their shares among themselves.
"""

from __future__ import annotations

import json
from decimal import Decimal
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Given weights whose whole shares sum to more are rounded to this sum; from targets that changes a share by 2^-32 at most.
LONGEST_PERIOD = 1 << 31
#: Slots whose blocks are summed together, and blocks that are made together.
RANGE = 4_096


def whole_shares(weights: dict) -> dict:
    """Integers in the same proportions. Weights are ints, Fractions, Decimals, or floats with the digits they print; zero stays zero."""
    exact = {k: v if isinstance(v, Fraction) else Fraction(Decimal(str(v))) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("a weight is negative")
    scale = lcm(*(v.denominator for v in exact.values())) if exact else 1
    whole = {k: int(v * scale) for k, v in exact.items()}
    common = gcd(*whole.values()) or 1
    whole = {k: v // common for k, v in whole.items()}
    if (total := sum(whole.values())) > LONGEST_PERIOD:
        whole = {k: max(1, round(Fraction(v * LONGEST_PERIOD, total))) if v else 0 for k, v in whole.items()}
    return whole


def _schedule(sources: DataFrame) -> DataFrame:
    """(share, member, k, p, t): the block k, of those of a period, of each source that has a share, and its slot t. sources: (source, blocks, share, member)."""
    row = sources.groupBy("share").agg(F.count("*").alias("m"), F.max("blocks").alias("blocks")).agg(F.array_sort(F.collect_list(F.struct("share", "m", "blocks"))).alias("s"))
    row = row.selectExpr("s.share AS share", "s.m AS m", "s.blocks AS blocks").withColumn("p", F.expr("aggregate(zip_with(share, m, (x, y) -> x * y), 0L, (a, x) -> a + x)"))
    row = row.withColumn("n", F.expr("least(p, array_max(zip_with(blocks, share, (b, x) -> (b * p + x - 1) DIV x)))"))
    # j[c]: blocks of share[c] that have run; they are the (j DIV m)-th of its members, one after another
    step = """
      transform(array(array_min(transform(b.j, (j, c) -> IF((j DIV m[c]) * p DIV share[c] <= t, named_struct('due', ((j DIV m[c] + 1) * p + share[c] - 1) DIV share[c], 'c', c), NULL))).c),
        x -> named_struct('j', transform(b.j, (j, c) -> IF(c = x, j + 1, j)), 's', concat(b.s, array(b.j[x] * size(share) + x))))[0]"""
    slots = f"""
      aggregate(sequence(0L, (n - 1) DIV 256),
        named_struct('j', transform(share, x -> 0L), 'out', CAST(array() AS ARRAY<ARRAY<BIGINT>>)),
        (a, w) -> transform(array(aggregate(sequence(w * 256, least(w * 256 + 255, n - 1)), named_struct('j', a.j, 's', CAST(array() AS ARRAY<BIGINT>)), (b, t) -> {step})),
          r -> named_struct('j', r.j, 'out', concat(a.out, array(r.s))))[0],
        a -> a.out)"""
    row = row.where("n > 0").select("share", "m", "p", F.posexplode(F.expr(slots)).alias("w", "run")).select("share", "m", "p", "w", F.posexplode("run").alias("i", "x"))
    row = row.selectExpr("share", "m", "p", "CAST(w AS BIGINT) * 256 + i AS t", "CAST(x % size(share) AS INT) AS c", "x DIV size(share) AS j")
    return row.selectExpr("share[c] AS share", "j % m[c] AS member", "j DIV m[c] AS k", "p", "t")


def mix_sources(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block_docs: int = 16, seed: int = 7, buckets: int = 4_096) -> DataFrame:
    """docs with block, slot, release, deadline and mix_position (long, from 0, no gaps): the order to read them in.

    weights: source -> target share of the blocks (None for null sources, which are a source of their
    own); rows of a source with weight zero, or without one, are not in the mix. None given: the whole
    part of the root of each source's number of documents. The order within a source is by a seeded hash
    of the id, then the id, so rows of equal ids follow each other in any order; null ids are allowed.
    An empty table, or weights of zero alone, give no rows. Columns of docs with a name of the new ones
    are replaced; other names may be any.

    Within sources, rows are ranked in `buckets` hash ranges, and each range is moved up by the sizes of
    those below it: no task sorts a whole source. Blocks are made and joined in ranges of a source, and
    summed in ranges of slots; one task computes a period's schedule, in time in proportion to the
    period's slots (of those that any source needs) times distinct shares.
    """
    new = ["block", "slot", "release", "deadline", "mix_position"]
    old = [c for c in docs.columns if c not in new]
    base = docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(old))).alias("row"), F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("")).alias("source"), F.xxhash64(docs[id_col], F.lit(seed)).alias("h"), docs[id_col].alias("id"))
    base = base.withColumn("range", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)).cast("int"))
    sizes = base.groupBy("source", "range").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("source", "range", below.alias("start"))

    counts = sizes.groupBy("source").agg(F.sum("n").alias("docs"))
    if weights is None:
        share = F.floor(F.sqrt(F.col("docs").cast("double")))
    else:
        named = {"" if k is None else f"={k}": v for k, v in whole_shares(weights).items()}
        share = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(named)), "map<string,bigint>"), F.col("source")), F.lit(0))
    sources = counts.withColumn("share", share.cast("long")).where("share > 0").withColumn("blocks", F.expr(f"(docs + {block_docs - 1}) DIV {block_docs}"))
    sources = sources.withColumn("member", (F.row_number().over(Window.partitionBy("share").orderBy("source")) - 1).cast("long"))

    blocks = sources.select("*", F.explode(F.expr(f"sequence(0L, (blocks - 1) DIV {RANGE})")).alias("part")).repartition("source", "part")
    blocks = blocks.select("source", "share", "member", "docs", F.explode(F.expr(f"sequence(part * {RANGE}, least(blocks, (part + 1) * {RANGE}) - 1)")).alias("block")).withColumn("k", F.expr("block % share"))
    blocks = blocks.join(_schedule(sources), ["share", "member", "k"]).selectExpr(
        "source", "block", "block DIV share * p + t AS slot", "block * p DIV share AS release", "((block + 1) * p + share - 1) DIV share AS deadline", f"least({block_docs}, docs - block * {block_docs}) AS size", f"(block DIV share * p + t) DIV {RANGE} AS stretch")
    upto = lambda by: F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = blocks.groupBy("stretch").agg(F.sum("size").alias("size")).select("stretch", upto(Window.orderBy("stretch")).alias("first"))
    blocks = blocks.withColumn("inside", upto(Window.partitionBy("stretch").orderBy("slot"))).join(stretches, "stretch")

    rank = F.row_number().over(Window.partitionBy("source", "range").orderBy("h", "id")) - 1
    ranked = base.withColumn("rank", rank).join(starts, ["source", "range"]).withColumn("rank", F.col("rank") + F.col("start")).withColumn("block", F.expr(f"rank DIV {block_docs}"))
    mixed = ranked.join(blocks.select("source", "block", "slot", "release", "deadline", (F.col("first") + F.col("inside")).alias("at")), ["source", "block"])
    return mixed.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(old)), "block", "slot", "release", "deadline", F.expr(f"at + rank % {block_docs}").alias("mix_position"))
