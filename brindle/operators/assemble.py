"""Feature assembly: profiles of hashed sparse features, text formats and the click-rate matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import stored

#: Columns with a list of ids -> the field that holds their hashes.
RIVALS, OTHERS, AFTER = {20: "rival_ids"}, {21: "doc_ads"}, {19: "docs_after"}
TAGGED = {23: "internal_sources", 24: "social_sources", 25: "search_sources", 26: "internal_docs", 27: "social_docs", 28: "search_docs"}
#: Per profile: hash offset; whether ids are bucketed by train and test counts (else by train counts); calendar
#: features as (field, column, first index); fields of the two time differences; id lists; and which of the optional
#: parts it has: later views (13, 14), the source's click rate (17), rival count (18), topics (8, 37), state within country (2), slots of two hours (15).
PROFILES = {
    "p1": {"offset": 200, "both": False, "calendar": ((13, "weekday", 50), (13, "hour", 70)), "times": (14, 14), "lists": {**RIVALS, **OTHERS}, "parts": {"rivals"}},
    "f1": {"offset": 200, "both": True, "calendar": ((15, "weekday", 70), (15, "hour", 50)), "times": (16, 16), "lists": {**RIVALS, **OTHERS, **AFTER}, "parts": {"later", "rate", "rivals"}},
    "f2": {"offset": 200, "both": False, "calendar": ((15, "weekday", 50), (15, "hour", 70)), "times": (16, 16), "lists": {}, "parts": {"later", "rate", "topics", "place"}},
    "f3": {"offset": 200, "both": True, "calendar": ((15, "weekday", 70), (15, "hour", 50)), "times": (16, 16), "lists": {**RIVALS, **OTHERS, **AFTER, 22: "user_docs"}, "parts": {"later", "rate", "rivals"}},
    "f4": {"offset": 700, "both": True, "calendar": ((15, "weekday", 70), (15, "hour", 50)), "times": (16, 16), "lists": {**RIVALS, **OTHERS, **AFTER, 22: "user_docs", 23: "user_sources"}, "parts": {"later", "rate", "rivals"}},
    "f5": {"offset": 700, "both": True, "calendar": ((15, "weekday", 40), (15, "hour", 50)), "times": (16, 22), "lists": {**RIVALS, **OTHERS, **AFTER, **TAGGED}, "parts": {"later", "rate", "rivals", "slot"}},
}
#: Fields with ids: column, least count of train rows, and what is added to ids that are kept. Of profiles that bucket by both counts the least is 50 for users and 5 else.
EVENT_IDS = {3: ("uid", 50, 100), 4: ("ev_document_id", 50, 100), 5: ("ev_source_id", 10, 10), 6: ("ev_publisher_id", 10, 10)}
AD_IDS = {30: ("ad_id", 50, 100), 31: ("campaign_id", 50, 100), 32: ("advertiser_id", 50, 100), 33: ("ad_document_id", 50, 100), 34: ("ad_source_id", 10, 10), 35: ("ad_publisher_id", 10, 10)}
#: (field, index, column): features that a positive column sets.
FLAGS = (
    (11, 2, "viewed"), (11, 3, "not_viewed"), (11, 4, "publisher_view_count"), (11, 5, "source_view_count"), (11, 6, "category_view_weight"), (11, 7, "topic_view_weight"),
    (12, 20, "ad_past_all_views"), (12, 21, "ad_past_clicks"), (12, 22, "ad_doc_past_all_views"), (12, 23, "ad_doc_past_clicks"), (12, 24, "pub_past_all_views"), (12, 25, "pub_past_clicks"),
    (12, 26, "src_past_all_views"), (12, 27, "src_past_clicks"), (12, 28, "cat_past_all_views"), (12, 29, "cat_past_clicks"), (12, 30, "top_past_all_views"), (12, 32, "top_past_clicks"),
)


def _feature(field: int, index: Column, value: Column | float = 1.0) -> Column:
    v = value if isinstance(value, Column) else F.lit(float(value))
    return F.struct(F.lit(field).alias("field"), index.cast("long").alias("index"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("value"))


def _raw(field: int, index: Column | int, value: Column | float = 1.0) -> Column:
    return _feature(field, S.raw_index(field, index if isinstance(index, Column) else F.lit(index)), value)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def features(rows: DataFrame, profile: str) -> Column:
    """array<struct<field, index, value>> of a profile; rows is the star join with train and test counts {column}__tr and {column}__te,
    the history columns, the profile's id lists (null: none) and ev_categories, ad_categories (ev_topics, ad_topics) as array<struct<id, conf>>."""
    p = PROFILES[profile]
    offset, parts = p["offset"], p["parts"]
    place = F.concat(_text("country"), _text("state")) if "place" in parts else _text("state")
    out = [_feature(k, S.hashed(k, S.string_code(x), offset)) for k, x in ((0, _text("platform")), (1, _text("country")), (2, place))]
    for k, (c, least, add) in {**EVENT_IDS, **AD_IDS}.items():
        value = S.string_code(_text(c)) if c == "advertiser_id" else F.coalesce(F.col(c), F.lit(0))
        tr, te = (F.coalesce(F.col(f"{c}__{x}"), F.lit(0)) for x in ("tr", "te"))
        code = S.rare_bucket(tr, te, value, 50 if c == "uid" else 5, add) if p["both"] else S.rare_bucket_train(tr, value, least, add)
        out.append(_feature(k, S.hashed(k, code, offset)))
    out += [F.when(F.col(f"ad_{x}_id") == F.col(f"ev_{x}_id"), _raw(10, k)) for k, x in enumerate(("publisher", "source"))]
    out += [F.when(F.col(c) > 0, _raw(field, index)) for field, index, c in FLAGS]
    if "later" in parts:
        later = F.col("ad_future_all_views") > 0
        out += [F.when(later, _raw(13, 40)), F.when(F.col("ad_doc_future_all_views") > 0, _raw(13, 41)), F.when(~later & (F.col("cmp_future_all_views") > 0), _raw(14, 42))]
    if "rate" in parts:
        out.append(_raw(17, 43, S.ctr_logit(F.col("src_past_views") + F.col("src_future_views"), F.col("src_past_clicks") + F.col("src_future_clicks"))))
    if "slot" in parts:
        out.append(_raw(15, 250 + F.col("weekday") * 12 + F.expr("hour DIV 2")))
    out += [_raw(field, F.col(c) + first) for field, c, first in p["calendar"]]
    first, second = p["times"]
    out += [_raw(first, 80, S.pos_time_diff(F.col("ts") - F.col("ad_publish_ts"))), _raw(second, 81, S.time_diff(F.col("ev_publish_ts") - F.col("ad_publish_ts")))]
    if "rivals" in parts:
        out.append(_raw(18, F.col("rival_count") + 180))
    noted = {7: "ev_categories", 36: "ad_categories", **({8: "ev_topics", 37: "ad_topics"} if "topics" in parts else {})}
    hashes = lambda k: lambda x: _feature(k, S.hashed(k, x, offset))
    weights = lambda k: lambda x: _feature(k, S.hashed(k, x["id"], offset), x["conf"])
    lists = [*(F.transform(F.col(c), hashes(k)) for k, c in p["lists"].items()), *(F.transform(F.col(c), weights(k)) for k, c in noted.items())]
    none = F.array().cast("array<struct<field:int,index:bigint,value:double>>")
    return F.filter(F.concat(F.array(*out), *(F.coalesce(x, none) for x in lists)), lambda x: x.isNotNull())


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds {column}__tr and {column}__te for each column that counts, as features.count_pivots makes them, has as a feature: the train and test rows with the row's value (null: none).

    counts should be stored: its size then decides between broadcast and sort-merge joins. Columns with very many values are better counted by counted().
    """
    for c in sorted(r["feature"] for r in counts.select("feature").distinct().collect()):  # one row a column
        n = counts.where(F.col("feature") == c).select(F.col("id").cast(rows.schema[c].dataType).alias(c), F.col("train_count").alias(f"{c}__tr"), F.col("test_count").alias(f"{c}__te"))
        rows = rows.join(n, c, "left")
    return rows


def counted(rows: DataFrame, column: str) -> DataFrame:
    """As with_counts for one column, within rows of the same value."""
    same = Window.partitionBy(column)
    return rows.withColumns({f"{column}__tr": F.count_if(~F.col("is_test")).over(same), f"{column}__te": F.count_if("is_test").over(same)})


def with_annotations(rows: DataFrame, annotations: DataFrame, name: str) -> DataFrame:
    """Adds ev_{name} and ad_{name}: the annotations of the page's and the ad's document as array<struct<id, conf>>, by id."""
    noted = stored(annotations.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "conf"))).alias("a")))
    for side in ("ev", "ad"):
        rows = rows.join(noted.select(F.col("document_id").alias(f"{side}_document_id"), F.col("a").alias(f"{side}_{name}")), f"{side}_document_id", "left")
    return rows


def id_code(column: str, profile: str, value: Column, tr: Column, te: Column) -> Column:
    """What is hashed of an id with so many train and test rows."""
    _, least, add = next(x for x in {**EVENT_IDS, **AD_IDS}.values() if x[0] == column)
    tr, te = F.coalesce(tr, F.lit(0)), F.coalesce(te, F.lit(0))
    return S.rare_bucket(tr, te, value, 50 if column == "uid" else 5, add) if PROFILES[profile]["both"] else S.rare_bucket_train(tr, value, least, add)


def with_id_indexes(rows: DataFrame, counts: DataFrame, profile: str) -> DataFrame:
    """Adds {column}__ix for each id column but the ad's: the index of the id's feature, made once for each id. counts: as for with_counts."""
    for k, (c, *_) in {**EVENT_IDS, **AD_IDS}.items():
        if c == "ad_id":
            continue
        value = S.string_code(F.coalesce(F.col("id"), F.lit(""))) if c == "advertiser_id" else F.coalesce(F.col("id").cast("long"), F.lit(0))
        index = lambda *of, k=k, c=c: S.hashed_column(k, id_code(c, profile, *of), PROFILES[profile]["offset"])
        n = counts.where(F.col("feature") == c).select(F.col("id").cast(rows.schema[c].dataType).alias(c), index(value, F.col("train_count"), F.col("test_count")).alias("__ix"))
        none = S.string_code(F.lit("")) if c == "advertiser_id" else F.lit(0)
        rows = rows.join(n, c, "left").withColumn(f"{c}__ix", F.coalesce("__ix", index(none, F.lit(0), F.lit(0)))).drop("__ix")
    return rows


def with_place_indexes(rows: DataFrame, places: DataFrame, profile: str) -> DataFrame:
    """Adds platform__ix, country__ix and state__ix, made once for each place. places: distinct (geo, platform, country, state) of rows, which has geo and platform."""
    offset = PROFILES[profile]["offset"]
    place = F.concat(_text("country"), _text("state")) if "place" in PROFILES[profile]["parts"] else _text("state")
    made = places.select(F.col("geo").alias("__geo"), F.col("platform").alias("__platform"), *(S.hashed(k, S.string_code(x), offset).alias(f"{c}__ix") for k, (c, x) in enumerate((("platform", _text("platform")), ("country", _text("country")), ("state", place)))))
    return rows.join(made, F.col("geo").eqNullSafe(F.col("__geo")) & F.col("platform").eqNullSafe(F.col("__platform")), "left").drop("__geo", "__platform")


def list_sums(field: int, ids: Column, profile: str) -> Column:
    """struct<n, index>: of the features of a list of ids of a field, their count and the sum of their indexes."""
    return F.struct(F.size(ids).cast("long").alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + S.hashed(field, x, PROFILES[profile]["offset"])).alias("index"))


def with_note_sums(rows: DataFrame, annotations: DataFrame, fields: dict[str, int], profile: str) -> DataFrame:
    """Adds f{field}: struct<n, index, norm> of the features of the annotations of the page's and the ad's document; they are made once for each document. fields: by side, ev and ad."""
    for side, k in fields.items():
        index = S.hashed_column(k, F.col("id"), PROFILES[profile]["offset"])
        made = stored(annotations.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(index).alias("index"), F.sum(F.col("conf") * F.col("conf")).alias("norm")))
        rows = rows.join(made.select(F.col("document_id").alias(f"{side}_document_id"), F.struct("n", "index", "norm").alias(f"f{k}")), f"{side}_document_id", "left")
    return rows


def sums(rows: DataFrame, profile: str) -> dict[str, Column]:
    """n_features, norm, index_sum, field_sum and cross_sum (of field times index) over the features that features() makes of a row.

    rows: as for features(), but with {column}__ix instead of counts, and f{field} instead of lists: sums over features that many rows share are made where they are shared.
    """
    p = PROFILES[profile]
    parts, noted = p["parts"], [7, 36, *((8, 37) if "topics" in PROFILES[profile]["parts"] else ())]
    #: (field, index) of features that every row has, with the value 1 but of `squares`; (field, index, on) of features under a condition.
    always = [*((k, F.col(f"{c}__ix")) for k, c in enumerate(("platform", "country", "state"))), *((k, F.col(f"{c}__ix")) for k, (c, *_) in {**EVENT_IDS, **AD_IDS}.items())]
    always += [(field, S.raw_index(field, F.col(c) + start)) for field, c, start in p["calendar"]]
    some = [(10, k, F.col(f"ad_{x}_id") == F.col(f"ev_{x}_id")) for k, x in enumerate(("publisher", "source"))] + [(field, index, F.col(c) > 0) for field, index, c in FLAGS]
    squares = [S.pos_time_diff(F.col("ts") - F.col("ad_publish_ts")), S.time_diff(F.col("ev_publish_ts") - F.col("ad_publish_ts"))]
    always += [(field, F.lit(field << 20 | index).cast("long")) for field, index in zip(p["times"], (80, 81), strict=True)]
    if "later" in parts:
        later = F.col("ad_future_all_views") > 0
        some += [(13, 40, later), (13, 41, F.col("ad_doc_future_all_views") > 0), (14, 42, ~later & (F.col("cmp_future_all_views") > 0))]
    if "rate" in parts:
        always.append((17, F.lit(17 << 20 | 43).cast("long")))
        squares.append(S.ctr_logit(F.col("src_past_views") + F.col("src_future_views"), F.col("src_past_clicks") + F.col("src_future_clicks")))
    if "slot" in parts:
        always.append((15, S.raw_index(15, 250 + F.col("weekday") * 12 + F.expr("hour DIV 2"))))
    if "rivals" in parts:
        always.append((18, S.raw_index(18, F.col("rival_count") + 180)))
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    zero = lambda k, x, none: F.coalesce(F.col(f"f{k}")[x], F.lit(none))
    whole: dict[int, list] = {}
    for k, x in always:
        whole.setdefault(k, []).append(x)
    counts: dict[int, list] = {}
    for k, index, on in some:
        has = F.when(on, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        counts.setdefault(k, []).append(has)
        whole.setdefault(k, []).append(has * F.lit(k << 20 | index).cast("long"))
    ones = total([x for xs in counts.values() for x in xs])
    for k in [*p["lists"], *noted]:
        whole.setdefault(k, []).append(zero(k, "index", 0))
        counts.setdefault(k, []).append(zero(k, "n", 0))
    n, index = {k: total(xs) for k, xs in counts.items()}, {k: total(xs) for k, xs in whole.items()}
    ones = total([ones, *(zero(k, "n", 0) for k in p["lists"])])
    square = lambda x: (lambda v: v * v)(F.coalesce(x, F.lit(0.0)))
    return {
        "n_features": total(n.values()) + F.lit(len(always)).cast("long"),
        "norm": (ones + F.lit(len(always) - len(squares)).cast("long")).cast("double") + total([*map(square, squares), *(zero(k, "norm", 0.0) for k in noted)]),
        "index_sum": total(index.values()),
        "field_sum": total([F.lit(k).cast("long") * x for k, x in n.items()]) + F.lit(sum(k for k, _ in always)).cast("long"),
        "cross_sum": total([F.lit(k).cast("long") * x for k, x in index.items() if k]),
    }


def dataset(rows: DataFrame, profile: str) -> DataFrame:
    """Adds features, norm (sum of squared values) and n_features."""
    out = rows.withColumn("features", features(rows, profile))
    return out.withColumns({"norm": F.aggregate("features", F.lit(0.0), lambda s, f: s + f["value"] * f["value"]), "n_features": F.size("features").cast("long")})


#: The text format's hash: 2^19 buckets after the first 100 indices.
TEXT_BITS, TEXT_OFFSET = 19, 100


def _text_hash(field: int, x: Column, is_text: bool) -> Column:
    mask = F.lit(2**TEXT_BITS - 1).cast("long")
    if is_text:
        h = ((S.string_code(x) + F.lit(field)).bitwiseAND(mask) * F.lit(2654435761).cast("long")).bitwiseAND(mask)
    else:
        h = S.hashed(field, x, 0, TEXT_BITS)
    return (h + F.lit(TEXT_OFFSET)).cast("string")


def libffm_lines(rows: DataFrame) -> Column:
    """label field:index:value ...: fields 0 to 25; label -1 is unknown; values but 1 with 6 places. rows: star, leak and category columns."""
    one = lambda k, c, is_text=False: F.concat(F.lit(f"{k}:"), _text_hash(k, _text(c) if is_text else F.coalesce(F.col(c), F.lit(0)), is_text), F.lit(":1"))
    many = lambda k, c: F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit(f"{k}:"), _text_hash(k, x["id"], False), F.lit(":"), F.format_string("%.6f", x["conf"]))), " ")
    some = lambda on, text: F.when(on, F.lit(text))
    clock = lambda k, c, first: F.concat(F.lit(f"{k}:"), (F.col(c) + first).cast("string"), F.lit(":1"))
    timed = lambda k, i, x: F.concat(F.lit(f"{k}:{i}:"), F.format_string("%.6f", F.coalesce(x, F.lit(0.0))))
    parts = [one(0, "ad_id"), one(1, "campaign_id"), one(2, "advertiser_id", True), one(3, "platform", True), one(4, "country", True), one(5, "state", True)]
    parts += [one(6, "ev_document_id"), one(7, "ev_source_id"), one(8, "ev_publisher_id"), many(12, "ev_categories"), one(9, "ad_document_id"), one(10, "ad_source_id"), one(11, "ad_publisher_id"), many(13, "ad_categories")]
    parts += [some(F.col("ad_publisher_id") == F.col("ev_publisher_id"), "18:0:1"), some(F.col("ad_source_id") == F.col("ev_source_id"), "19:1:1"), some(F.col("viewed") > 0, "20:2:1"), some(F.col("not_viewed") > 0, "21:3:1")]
    parts += [clock(22, "weekday", 50), clock(23, "hour", 70), timed(24, 4, S.pos_time_diff(F.col("ts") - F.col("ad_publish_ts"))), timed(25, 5, S.time_diff(F.col("ev_publish_ts") - F.col("ad_publish_ts")))]
    return F.concat_ws(" ", F.col("label").cast("string"), *parts)


SIMILARITIES = tuple(f"{p}_{x}" for p in ("cat", "top", "ent") for x in ("product", "jaccard"))
#: Columns whose positive values the line names as av_{file}_{column}: by ad and document, publisher and source, campaign and advertiser.
SEEN = {n: [f"{p}_{when}_{x}" for when in ("past", "future") for p in pair for x in ("views", "clicks", "all_views")] for n, pair in ((3, ("ad", "ad_doc")), (4, ("pub", "src")), (5, ("cmp", "adv")))}


def vw_lines(rows: DataFrame) -> Column:
    """[label ]|a ad |l place |t time |u user |d page |p promoted document |f flags, similarities (6 places) and counters.

    The label is -1 or 1; without a known label the line begins with its first namespace.
    """
    named = lambda tag, c: F.concat(F.lit(f"{tag}_"), _text(c))
    noted = lambda tag, c: F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit(f" {tag}_"), x["id"].cast("string"), F.lit(":"), F.format_string("%.6f", x["conf"]))), "")
    some = lambda on, text: F.when(on, F.lit(text)).otherwise(F.lit(""))
    space = lambda name, *pairs: F.concat(F.lit(f"|{name} "), F.concat_ws(" ", *(named(t, c) for t, c in pairs)))
    all_notes = lambda side, letter: [F.coalesce(noted(f"{letter}d{k}", f"{side}_{name}"), F.lit("")) for k, name in (("c", "categories"), ("t", "topics"), ("e", "entities"))]
    line = [F.when(F.col("label") >= 0, F.concat((F.col("label") * 2 - 1).cast("string"), F.lit(" "))).otherwise(F.lit(""))]
    line += [space("a", ("ad", "ad_id"), ("ac", "campaign_id"), ("aa", "advertiser_id")), space("l", ("c", "country"), ("s", "state"), ("p", "platform")), space("t", ("h", "hour"), ("w", "weekday")), space("u", ("u", "uid"))]
    line += [space("d", ("ed", "ev_document_id"), ("eds", "ev_source_id"), ("edp", "ev_publisher_id")), *all_notes("ev", "e"), space("p", ("ad", "ad_document_id"), ("ads", "ad_source_id"), ("adp", "ad_publisher_id")), *all_notes("ad", "a")]
    line += [F.lit("|f"), some(F.col("ad_publisher_id") == F.col("ev_publisher_id"), " sp"), some(F.col("ad_source_id") == F.col("ev_source_id"), " ss"), some(F.col("viewed") > 0, " v"), some(F.col("not_viewed") > 0, " nv")]
    line += [F.concat(F.lit(f" s_{i}:"), F.format_string("%.6f", F.coalesce(F.col(c), F.lit(0.0)))) for i, c in enumerate(SIMILARITIES)]
    line += [some(F.col(c) > 0, f" av_{n}_{i}") for n, columns in SEEN.items() for i, c in enumerate(columns)]
    return F.concat(*line)


MILLION, LOW = 1_000_000, 32


def rated(rows: DataFrame, prefix: str) -> DataFrame:
    """{prefix}__rates instead of the prefix's counters: the click-rate logits (prior strength 10, 6 places) of past and future, as millionths, in one number, by which rows travel shorter."""
    logit = lambda when: F.round(S.ctr_logit(F.col(f"{prefix}_{when}_views"), F.col(f"{prefix}_{when}_clicks"), 10.0, False), 6)
    past, future = (F.round(logit(when) * MILLION).cast("long") for when in ("past", "future"))
    both = F.shiftleft(past, LOW).bitwiseOR(future.bitwiseAND(F.lit((1 << LOW) - 1).cast("long")))
    return rows.withColumn(f"{prefix}__rates", both).drop(*(f"{prefix}_{when}_{x}" for when in ("past", "future") for x in ("views", "clicks", "all_views")))


def _rate(column: str, when: str) -> Column:
    """The past or future logit of a number that rated() made: millionths divided are the very doubles that rounding to 6 places gives."""
    both = F.col(column)
    return (F.shiftright(both if when == "past" else F.shiftleft(both, LOW), LOW) / F.lit(float(MILLION))).cast("double")


def ctr_matrix(rows: DataFrame) -> DataFrame:
    """c0 .. c18: two view flags, click-rate logits (prior strength 10) of past and future counters of a user's and a place's documents, sources, topics and categories, two zeros, and the logit of 1 / rival_count.

    rows: viewed, not_viewed, rival_count and, of each group and kind, what rated() makes of its counters.
    """
    names = [f"{g}_{a}" for g in ("uid", "g2") for a in ("ad_doc", "src", *(("top", "cat") if g == "uid" else ()))] + ["g2_cat"]
    rate = [_rate(f"{x}__rates", when) for x in names for when in ("past", "future")]
    zero = [F.lit(0.0)] * 2
    n = F.col("rival_count").cast("double")
    last = F.round(S.logit(S.clip(1 / n)), 6)
    columns = [(F.col("viewed") > 0).cast("double"), (F.col("not_viewed") > 0).cast("double"), *rate[:12], *zero, *rate[12:], last]
    return rows.select("*", *(c.alias(f"c{i}") for i, c in enumerate(columns)))
