"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIOR = 0.194
M32 = 0xFFFFFFFF


def pos_time_diff(td: Column) -> Column:
    return F.when(td < 0, F.lit(0.0)).otherwise(F.log1p(td.cast("double")) / 100)


def time_diff(td: Column) -> Column:
    return F.signum(td.cast("double")) * F.log1p(F.abs(td).cast("double")) / 100


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(t: Column) -> Column:
    return 1 / (1 + F.exp(-t))


def clip(p: Column, low: float = 1e-7, high: float = 1 - 1e-7) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def ctr(clicks: Column, views: Column, reg: float = 10.0) -> Column:
    return (clicks + F.lit(PRIOR * reg)) / (views + F.lit(reg))


def ctr_logit(views: Column, clicks: Column, reg: float = 50.0, centred: bool = True) -> Column:
    """Smoothed click rate as a logit; centred: less the prior's."""
    out = logit(ctr(clicks.cast("double"), views.cast("double"), reg))
    return out - logit(F.lit(PRIOR)) if centred else out


def _mod32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(M32).cast("long"))


def _with(x: Column, f) -> Column:
    """f of x, with x evaluated once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def mix32(a: Column) -> Column:
    """A 32-bit integer hash; every step is taken modulo 2^32, so nothing overflows a long."""
    a = _with(a, lambda x: _mod32(x.bitwiseXOR(F.lit(61).cast("long")).bitwiseXOR(F.shiftright(x, 16))))
    a = _with(_mod32(a * 9), lambda x: x.bitwiseXOR(F.shiftright(x, 4)))  # a + (a << 3) is a * 9
    return _with(_mod32(a * F.lit(0x27D4EB2D).cast("long")), lambda x: x.bitwiseXOR(F.shiftright(x, 15)))


def _mix32_of_column(a: Column) -> Column:
    """mix32 without lambdas: generated code evaluates what is written twice once. Within a lambda that would not be so."""
    a = _mod32(a.bitwiseXOR(F.lit(61).cast("long")).bitwiseXOR(F.shiftright(a, 16)))
    a = _mod32(a * 9)
    a = a.bitwiseXOR(F.shiftright(a, 4))
    a = _mod32(a * F.lit(0x27D4EB2D).cast("long"))
    return a.bitwiseXOR(F.shiftright(a, 15))


def hashed(field: int, category: Column, offset: int, bits: int = 20, mix=mix32) -> Column:
    """The hashed index of a category of a field: below 2^bits, at least offset."""
    return F.pmod(mix(_mod32(category.cast("long") + F.lit(field * 2654435761 % 2**32).cast("long"))), F.lit(2**bits - offset)) + F.lit(offset)


def hashed_column(field: int, category: Column, offset: int, bits: int = 20) -> Column:
    """hashed for columns of whole rows: faster than by lambdas."""
    return hashed(field, category, offset, bits, _mix32_of_column)


def raw_index(field: int, index: Column) -> Column:
    return F.lit(field << 20).cast("long").bitwiseOR(index.cast("long").bitwiseAND(F.lit(0xFFFFF).cast("long")))


def string_code(s: Column) -> Column:
    """A 32-bit code of a string that any engine can compute: the first 8 hex digits of its md5."""
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")


def rare_bucket(train: Column, test: Column, value: Column, least: int = 5, offset: int = 100) -> Column:
    """Ids that are rare in train or test share a code by their total count; others keep theirs, shifted."""
    return F.when(F.least(train, test) < least, train + test).otherwise(value + offset)


def rare_bucket_train(count: Column, value: Column, least: int = 50, offset: int = 100) -> Column:
    return F.when(count < least, count).otherwise(value + offset)


def repaired_time(s: Column) -> Column:
    """Years that begin 30 or 00 begin 20; null where the text is no time."""
    return F.try_to_timestamp(F.regexp_replace(s, "^(30|00)", "20"))


def publish_ms(s: Column, origin_ms: int = 1465876799998) -> Column:
    """Milliseconds from the log's origin, at least -1e12, which unreadable times get."""
    return F.greatest(F.coalesce(F.unix_millis(repaired_time(s)) - F.lit(origin_ms), F.lit(-(10**12))), F.lit(-(10**12)))


def parse_ids(s: Column) -> Column:
    """A space list of integers as array<bigint>; null and empty texts give an empty array."""
    return F.transform(F.filter(F.split(F.coalesce(s, F.lit("")), " "), lambda x: x != ""), lambda x: x.cast("long"))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def linspace(first: Column, last: Column, points: int) -> Column:
    """An array of points values from first to last at equal steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: first + (last - first) * i / F.lit(points - 1))


def prediction_name(made: Column, model: Column, score: Column) -> Column:
    """yyyyMMdd-HHmm-model-score, the score with five places."""
    return F.concat(F.date_format(made, "yyyyMMdd-HHmm"), F.lit("-"), model, F.lit("-"), F.format_string("%.5f", score))
