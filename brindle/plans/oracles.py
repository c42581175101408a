"""DuckDB SQL for the registered queries, written apart from them: direct frames, nested scans and text functions."""

from __future__ import annotations

BASE = """
place AS (SELECT n_nationkey k, r_name || '>' || n_name || '>' place FROM nation JOIN region ON n_regionkey = r_regionkey),
clicks AS (SELECT l_orderkey display_id, l_partkey ad_id, l_suppkey supp_id, l_linenumber::BIGINT line_no, strftime(l_shipdate, '%Y-%m-%d') ship,
  (l_returnflag = 'R')::BIGINT clicked, l_orderkey % 5 = 0 is_test, CASE WHEN l_orderkey % 5 = 0 THEN -1 ELSE (l_returnflag = 'R')::INT END::BIGINT AS label FROM lineitem),
displays AS (SELECT o_orderkey display_id, o_custkey % 150 uid, o_orderkey % 200 document_id,
  (((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 30 + 30) % 30) * 86400000 + (o_orderkey * 7919 % 86400) * 1000)::BIGINT ts,
  o_orderkey % 3 + 1 platform, coalesce(place || (o_custkey % 10)::VARCHAR, '') geo FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN place ON c_nationkey = k),
ads AS (SELECT p_partkey ad_id, p_partkey % 200 ad_document_id, p_size::BIGINT campaign_id, p_brand advertiser_id FROM part),
views AS (SELECT user_id uid, event_id % 200 document_id, epoch_ms(ts) - 1704067200000 ts, event_id % 3 + 1 platform, coalesce(place || (user_id % 10)::VARCHAR, '') geo,
  32 + (props->>'$.k')::BIGINT % 3 tag FROM events LEFT JOIN place ON user_id % 25 = k),
docs AS (SELECT doc_id document_id, nullif(regexp_extract(source, '([0-9]+)$', 1), '')::BIGINT source_id, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 0 END::BIGINT publisher_id, -(doc_id * 86400000) publish_ts FROM documents),
categories AS (SELECT doc_id document_id, (doc_id * 7 + k * 11) % 20 id, 0.9::DOUBLE / k conf FROM documents, (VALUES (1), (2)) t(k)),
topics AS (SELECT doc_id document_id, (doc_id * 5 + k * 13) % 40 id, 0.5::DOUBLE / k conf FROM documents, (VALUES (1), (2), (3)) t(k)),
entities AS (SELECT doc_id document_id, (doc_id * 3 + k * 17) % 100 id, 0.8::DOUBLE / k conf FROM documents, (VALUES (1), (2), (3), (4)) t(k)),
star AS (SELECT c.*, d.uid, d.ts, d.platform, d.geo, d.document_id ev_document_id, a.ad_document_id, a.campaign_id, a.advertiser_id, x.source_id ad_source_id, x.publisher_id ad_publisher_id, x.publish_ts ad_publish_ts,
  y.source_id ev_source_id, y.publisher_id ev_publisher_id, y.publish_ts ev_publish_ts, split_part(geo, '>', 1) country, CASE WHEN len(string_split(geo, '>')) > 1 THEN split_part(geo, '>', 2) ELSE 'Z' END AS state,
  CASE WHEN len(string_split(geo, '>')) > 2 THEN split_part(geo, '>', 3)::BIGINT ELSE -1 END AS region, (ts // 3600000) % 24 AS hour, ts // 86400000 weekday, platform + 100 * ((ts // 10800000) % 56) g2a, substr(geo, 1, 5) g2b
  FROM clicks c LEFT JOIN displays d USING (display_id) LEFT JOIN ads a USING (ad_id) LEFT JOIN docs x ON x.document_id = a.ad_document_id LEFT JOIN docs y ON y.document_id = d.document_id)"""
ROW = "display_id, ad_id, supp_id, line_no, ship"
TIES = "ad_id, supp_id, line_no"


def q(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *more]) + "\n" + body


def _counters(prefix: str, keys: str, w: str = "1", kind: str = "BIGINT") -> str:
    out = []
    for when, frame in (("past", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("future", "1 FOLLOWING AND UNBOUNDED FOLLOWING")):
        for name, x in (("views", f"CASE WHEN label >= 0 THEN {w} END"), ("clicks", f"CASE WHEN label > 0 THEN {w} END"), ("all_views", w)):
            out.append(f"coalesce(sum({x}) OVER (PARTITION BY {keys} ORDER BY display_id RANGE BETWEEN {frame}), 0)::{kind} AS {prefix}_{when}_{name}")
    return ", ".join(out)


GROUPS = {"uid": "uid", "g2": "g2a, g2b"}
KEYS = {"ads": {"ad": "ad_id", "ad_doc": "ad_document_id"}, "ad_srcs": {"pub": "ad_publisher_id", "src": "ad_source_id"}, "ad_cmps": {"cmp": "campaign_id", "adv": "advertiser_id"}}
NAMES = [f"{when}_{x}" for when in ("past", "future") for x in ("views", "clicks", "all_views")]
PIVOTS = {
    "ads": "ad_id", "campaigns": "campaign_id", "advertisers": "advertiser_id", "ad_docs": "ad_document_id", "ad_doc_sources": "ad_source_id", "ad_doc_publishers": "ad_publisher_id",
    "ev_docs": "ev_document_id", "ev_doc_sources": "ev_source_id", "ev_doc_publishers": "ev_publisher_id", "countries": "country", "states": "state", "regions": "region", "uids": "uid",
}


def _weighted(group: str, kind: str, prefix: str) -> str:
    inner = f"SELECT {ROW}, a.conf, {_counters(prefix, GROUPS[group] + ', a.id', 'a.conf', 'DOUBLE')} FROM star LEFT JOIN {kind} a ON a.document_id = ad_document_id"
    return f"SELECT {ROW}, " + ", ".join(f"round(coalesce(sum(conf * {prefix}_{n}), 0), 6) AS {prefix}_{n}" for n in NAMES) + f" FROM ({inner}) GROUP BY {ROW}"


def _pivot(column: str) -> str:
    return f"SELECT {column}::VARCHAR AS id, count(*) FILTER (NOT is_test) AS train_count, count(*) FILTER (is_test) AS test_count FROM star GROUP BY {column}"


MEAN = "mean AS (SELECT ad_id, sum(label) / (count(*) + 10.0::DOUBLE) pred FROM clicks WHERE label >= 0 GROUP BY ad_id)"
SCORED = "scored AS (SELECT c.*, round(m.pred, 9) pred FROM clicks c JOIN (SELECT ad_id, sum(clicked) / (count(*) + 10.0::DOUBLE) pred FROM clicks GROUP BY ad_id) m USING (ad_id))"


def _pessimistic(drop_last: bool) -> str:
    last = " WHERE display_id < (SELECT max(display_id) FROM scored)" if drop_last else ""
    return q(
        f"SELECT round(avg(CASE WHEN p IS NOT NULL AND r <= 12 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS map12, count(*) AS displays FROM (SELECT g.display_id, p, (SELECT count(*) FROM scored s WHERE s.display_id = g.display_id AND s.pred >= g.p) r FROM (SELECT display_id, arg_max(pred, (ad_id, supp_id, line_no, ship)) FILTER (clicked = 1) p FROM scored{last} GROUP BY display_id) g)",
        SCORED,
    )


def _views_weight(group: str, cut: bool, kind: str, name: str) -> str:
    on = " AND ".join(f"w.{g} = s.{g}" for g in group.split(", "))
    v = "SELECT * FROM views" + (" WHERE ts <= 1123200000" if cut else "")
    return q(
        f"SELECT {', '.join('s.' + c for c in ROW.split(', '))}, round(coalesce(sum(w.w), 0), 6) AS {name} FROM star s LEFT JOIN (SELECT DISTINCT document_id, id FROM {kind}) a ON a.document_id = s.ad_document_id LEFT JOIN w ON w.id = a.id AND {on} GROUP BY ALL",
        f"w AS (SELECT {', '.join('v.' + g for g in group.split(', '))}, a.id, sum(a.conf) w FROM ({v}) v JOIN {kind} a ON a.document_id = v.document_id GROUP BY ALL)",
    )


def _views_docs(group: str, cut: bool) -> str:
    v = "SELECT * FROM views" + (" WHERE ts <= 1123200000" if cut else "")
    parts, joins = [], ""
    for name in ("publisher", "source"):
        parts.append(f"n_{name} AS (SELECT {', '.join('v.' + g for g in group.split(', '))}, {name}_id id, count(*) n FROM ({v}) v JOIN docs USING (document_id) GROUP BY ALL)")
        joins += f" LEFT JOIN n_{name} ON n_{name}.id = s.ad_{name}_id AND " + " AND ".join(f"n_{name}.{g} = s.{g}" for g in group.split(", "))
    cols = ", ".join(f"CASE WHEN s.ad_{x}_id = 0 THEN -1 ELSE coalesce(n_{x}.n, 0) END AS {x}_view_count" for x in ("publisher", "source"))
    return q(f"SELECT {', '.join('s.' + c for c in ROW.split(', '))}, {cols} FROM star s{joins}", *parts)


LEAK = """own AS (SELECT uid, document_id, count(*) n FROM views GROUP BY ALL), leak AS (SELECT s.*, coalesce(o.n, 0) viewed,
  CASE WHEN o.n IS NULL AND s.ad_document_id IN (SELECT document_id FROM views) THEN 1 ELSE 0 END not_viewed FROM star s LEFT JOIN own o ON o.uid = s.uid AND o.document_id = s.ad_document_id)"""


def _list(x: str, where: str = "", distinct: str = "DISTINCT ") -> str:
    return f"coalesce(array_to_string(list_sort(list({distinct}{x}){where}), ' '), '')"


def mix(x: str) -> str:
    """The 32-bit mix as nested subqueries' expression over a BIGINT x."""
    m = "4294967295"
    a = f"(xor(xor({x}, 61), ({x}) >> 16) & {m})"
    a = f"list_transform([{a}], lambda a: (a + (a << 3)) & {m})"
    a = f"list_transform({a}, lambda a: xor(a, a >> 4))"
    a = f"list_transform({a}, lambda a: (a * 668265261) & {m})"
    return f"list_transform({a}, lambda a: xor(a, a >> 15))[1]"


def hashed(field: int, x: str, offset: int, bits: int = 20) -> str:
    return f"({mix(f'((({x})::BIGINT + {field * 2654435761 % 2**32}) & 4294967295)')} % {2**bits - offset} + {offset})"


def code(s: str) -> str:
    return f"('0x' || substr(md5({s}), 1, 8))::BIGINT"


def _lg(c: str, v: str, reg: str) -> str:
    p = f"(({c} + 0.194::DOUBLE * {reg}) / ({v} + {reg}))"
    return f"ln({p} / (1 - {p}))"


POS = "CASE WHEN {0} < 0 THEN 0 ELSE ln(1 + ({0})::DOUBLE) / 100 END"
SIGNED = "CASE WHEN {0} < 0 THEN -ln(1 - ({0})::DOUBLE) / 100 ELSE ln(1 + ({0})::DOUBLE) / 100 END"
RIVALS = "riv AS (SELECT *, count(*) OVER (PARTITION BY display_id) rival_count FROM star), rleak AS (SELECT s.*, coalesce(o.n, 0) viewed, CASE WHEN o.n IS NULL AND s.ad_document_id IN (SELECT document_id FROM views) THEN 1 ELSE 0 END not_viewed FROM riv s LEFT JOIN (SELECT uid, document_id, count(*) n FROM views GROUP BY ALL) o ON o.uid = s.uid AND o.document_id = s.ad_document_id)"
BOTH = {"p1": False, "f1": True, "f2": False, "f3": True, "f4": True, "f5": True}
OFFSET = {"f4": 700, "f5": 700}
IDS = {
    3: ("uid", 50, 100), 4: ("ev_document_id", 50, 100), 5: ("ev_source_id", 10, 10), 6: ("ev_publisher_id", 10, 10), 30: ("ad_id", 50, 100), 31: ("campaign_id", 50, 100),
    32: ("advertiser_id", 50, 100), 33: ("ad_document_id", 50, 100), 34: ("ad_source_id", 10, 10), 35: ("ad_publisher_id", 10, 10),
}
SEEN = {3: ("ad", "ad_doc"), 4: ("pub", "src"), 5: ("cmp", "adv")}
HAS_LISTS = {
    "p1": {20: "rival_ids", 21: "doc_ads"}, "f1": {19: "docs_after", 20: "rival_ids", 21: "doc_ads"}, "f2": {}, "f3": {19: "docs_after", 20: "rival_ids", 21: "doc_ads", 22: "user_docs"},
    "f4": {19: "docs_after", 20: "rival_ids", 21: "doc_ads", 22: "user_docs", 23: "user_sources"},
    "f5": {19: "docs_after", 20: "rival_ids", 21: "doc_ads", 23: "sources32", 24: "sources33", 25: "sources34", 26: "docs32", 27: "docs33", 28: "docs34"},
}


def _notes(kind: str) -> str:
    return f"n_{kind} AS (SELECT document_id, list(struct_pack(id := id, conf := conf) ORDER BY id) l FROM {kind} GROUP BY document_id)"


def _weights(kind: str) -> str:
    return f"w_{kind} AS (SELECT {', '.join('s.' + c for c in ROW.split(', '))}, round(coalesce(sum(w.w), 0), 6) v FROM star s LEFT JOIN (SELECT DISTINCT document_id, id FROM {kind}) a ON a.document_id = s.ad_document_id LEFT JOIN (SELECT v.uid, a.id, sum(a.conf) w FROM views v JOIN {kind} a ON a.document_id = v.document_id WHERE v.ts <= 1123200000 GROUP BY ALL) w ON w.id = a.id AND w.uid = s.uid GROUP BY ALL)"


def _asm(body: str) -> str:
    """cnt: all that the profiles read, a row for each click."""
    users = [f"u_{x}{t} AS (SELECT uid, list(DISTINCT {c}) l FROM {src} WHERE tag = {t} GROUP BY uid)" for x, c, src in (("docs", "document_id", "views"), ("sources", "source_id", "views JOIN docs USING (document_id)")) for t in (32, 33, 34)]
    users = [u.replace("WHERE tag", "WHERE source_id IS NOT NULL AND tag") if "source_id" in u else u for u in users]
    docs = "u_user_docs AS (SELECT uid, list(DISTINCT document_id) l FROM mine WHERE document_id IN (SELECT document_id FROM displays GROUP BY document_id HAVING count(*) > 1) GROUP BY uid), u_user_sources AS (SELECT uid, list(DISTINCT source_id) l FROM mine JOIN docs USING (document_id) WHERE source_id IS NOT NULL GROUP BY uid)"
    counts = ", ".join(f"count(*) FILTER (NOT is_test) OVER (PARTITION BY {c}) AS {c}__tr, count(*) FILTER (is_test) OVER (PARTITION BY {c}) AS {c}__te" for c, *_ in IDS.values())
    counters = ", ".join(_counters(p, f"uid, {c}") for p, c in {**KEYS["ads"], **KEYS["ad_srcs"], "cmp": "campaign_id"}.items())
    names = [f"{x}{t}" for x in ("docs", "sources") for t in (32, 33, 34)] + ["user_docs", "user_sources"]
    lists = ", ".join(f"u_{n}.l AS {n}" for n in names) + ", ec.l AS ev_categories, ac.l AS ad_categories, et.l AS ev_topics, at_.l AS ad_topics, aft.l AS docs_after, oth.l AS doc_ads, list_filter(r.al, lambda y: y <> r.ad_id) AS rival_ids"
    views = ", ".join(f"CASE WHEN r.ad_{x}_id = 0 THEN -1 ELSE coalesce(v_{x}.n, 0) END AS {x}_view_count" for x in ("publisher", "source"))
    hist = ", ".join(f"h_{p}.{p}_{n}" for p in ("cat", "top") for n in NAMES)
    key = lambda t: " AND ".join(f"{t}.{c} = r.{c}" for c in ROW.split(", "))
    joins = " ".join([
        *(f"LEFT JOIN u_{n} ON u_{n}.uid = r.uid" for n in names), "LEFT JOIN n_categories ec ON ec.document_id = r.ev_document_id LEFT JOIN n_categories ac ON ac.document_id = r.ad_document_id LEFT JOIN n_topics et ON et.document_id = r.ev_document_id LEFT JOIN n_topics at_ ON at_.document_id = r.ad_document_id",
        "LEFT JOIN aft ON aft.uid = r.uid AND aft.ts = r.ts LEFT JOIN oth ON oth.display_id = r.display_id", *(f"LEFT JOIN v_{x} ON v_{x}.uid = r.uid AND v_{x}.id = r.ad_{x}_id" for x in ("publisher", "source")),
        *(f"JOIN w_{k} ON {key('w_' + k)}" for k in ("categories", "topics")), *(f"JOIN h_{p} ON {key('h_' + p)}" for p in ("cat", "top")),
    ])
    return q(
        body, RIVALS, BY_USERS, *users, docs, *map(_notes, ("categories", "topics")), *map(_weights, ("categories", "topics")), f"h_cat AS ({_weighted('uid', 'categories', 'cat')}), h_top AS ({_weighted('uid', 'topics', 'top')})",
        *(f"v_{x} AS (SELECT v.uid, {x}_id id, count(*) n FROM views v JOIN docs USING (document_id) WHERE v.ts <= 1123200000 GROUP BY ALL)" for x in ("publisher", "source")),
        "aft AS (SELECT d.uid, d.ts, list(DISTINCT v.document_id) l FROM (SELECT DISTINCT uid, ts FROM displays) d JOIN views v ON v.uid = d.uid AND v.ts > d.ts AND v.ts - d.ts < 3600000 GROUP BY ALL)",
        "oth AS (SELECT display_id, list(code) l FROM (SELECT display_id, (ev_document_id::VARCHAR || '99' || ad_id::VARCHAR)::BIGINT % 4194304 AS code, count(*) OVER (PARTITION BY ev_document_id, ad_id) n FROM star) WHERE n >= 2 GROUP BY display_id)",
        f"seen AS (SELECT *, list(ad_id) OVER (PARTITION BY display_id) al, {counters}, {counts} FROM rleak)",
        f"cnt AS (SELECT r.*, {lists}, {views}, {hist}, w_categories.v AS category_view_weight, w_topics.v AS topic_view_weight FROM seen r {joins})",
    )


def _terms(profile: str) -> list[tuple[int, str, str, str]]:
    """(field, condition, index, value)"""
    off, out = OFFSET.get(profile, 200), []
    state = "coalesce(country::VARCHAR, '') || coalesce(state::VARCHAR, '')" if profile == "f2" else "coalesce(state::VARCHAR, '')"
    for k, c in ((0, "coalesce(platform::VARCHAR, '')"), (1, "coalesce(country::VARCHAR, '')"), (2, state)):
        out.append((k, "true", hashed(k, code(c), off), "1.0"))
    for k, (c, least, add) in IDS.items():
        least = (50 if c == "uid" else 5) if BOTH[profile] else least
        test = f"least({c}__tr, {c}__te)" if BOTH[profile] else f"{c}__tr"
        low = f"{c}__tr + {c}__te" if BOTH[profile] else f"{c}__tr"
        own = code("coalesce(advertiser_id, '')") if c == "advertiser_id" else f"coalesce({c}, 0)"
        out.append((k, "true", hashed(k, f"CASE WHEN {test} < {least} THEN {low} ELSE {own} + {add} END", off), "1.0"))
    raw = lambda f, i: f"({f << 20} | (({i}) & 1048575))"
    positive = {
        11: {2: "viewed", 3: "not_viewed", 4: "publisher_view_count", 5: "source_view_count", 6: "category_view_weight", 7: "topic_view_weight"},
        12: {
            20: "ad_past_all_views", 21: "ad_past_clicks", 22: "ad_doc_past_all_views", 23: "ad_doc_past_clicks", 24: "pub_past_all_views", 25: "pub_past_clicks", 26: "src_past_all_views", 27: "src_past_clicks",
            28: "cat_past_all_views", 29: "cat_past_clicks", 30: "top_past_all_views", 32: "top_past_clicks",
        },
    }
    out += [(10, f"ad_{x}_id = ev_{x}_id", raw(10, str(i)), "1.0") for i, x in enumerate(("publisher", "source"))]
    out += [(f, f"{c} > 0", raw(f, str(i)), "1.0") for f, own in positive.items() for i, c in own.items()]
    if profile != "p1":
        out += [(13, "ad_future_all_views > 0", raw(13, "40"), "1.0"), (13, "ad_doc_future_all_views > 0", raw(13, "41"), "1.0"), (14, "ad_future_all_views = 0 AND cmp_future_all_views > 0", raw(14, "42"), "1.0")]
        out.append((17, "true", raw(17, "43"), f"({_lg('(src_past_clicks + src_future_clicks)', '(src_past_views + src_future_views)', '50')} - ln(0.194::DOUBLE / (1 - 0.194::DOUBLE)))"))
    day, hour = {"p1": (50, 70), "f2": (50, 70), "f5": (40, 50)}.get(profile, (70, 50))
    field = 13 if profile == "p1" else 15
    out += [(field, "true", raw(field, f"weekday + {day}"), "1.0"), (field, "true", raw(field, f"hour + {hour}"), "1.0")]
    if profile == "f5":
        out.append((15, "true", raw(15, "250 + weekday * 12 + hour // 2"), "1.0"))
    a, b = {"p1": (14, 14), "f5": (16, 22)}.get(profile, (16, 16))
    out += [(a, "true", raw(a, "80"), f"coalesce({POS.format('(ts - ad_publish_ts)')}, 0)"), (b, "true", raw(b, "81"), f"coalesce({SIGNED.format('(ev_publish_ts - ad_publish_ts)')}, 0)")]
    if profile != "f2":
        out.append((18, "true", raw(18, "rival_count + 180"), "1.0"))
    return out


def _export(profile: str) -> str:
    terms, off = _terms(profile), OFFSET.get(profile, 200)
    n = [f"CASE WHEN {on} THEN 1 ELSE 0 END" for _, on, _, _ in terms]
    index = [f"CASE WHEN {on} THEN {i} ELSE 0 END" for _, on, i, _ in terms]
    norm = [f"CASE WHEN {on} THEN ({v}) * ({v}) ELSE 0 END" for _, on, _, v in terms]
    fields = [f"CASE WHEN {on} THEN {f} ELSE 0 END" for f, on, _, _ in terms]
    cross = [f"CASE WHEN {on} THEN {f} * ({i}) ELSE 0 END" for f, on, i, _ in terms]
    noted = {7: "ev_categories", 36: "ad_categories", **({8: "ev_topics", 37: "ad_topics"} if profile == "f2" else {})}
    for f, c in {**HAS_LISTS[profile], **noted}.items():
        size = f"coalesce(len({c}), 0)"
        n.append(size)
        fields.append(f"{f} * {size}")
        index.append(f"coalesce(list_sum(list_transform({c}, lambda x: {hashed(f, 'x.id' if f in noted else 'x', off)})), 0)")
        cross.append(f"{f} * {index[-1]}")
        norm.append(f"coalesce(list_sum(list_transform({c}, lambda x: x.conf * x.conf)), 0)" if f in noted else size)
    return _asm(f"SELECT {ROW}, ({' + '.join(n)})::BIGINT AS n_features, round(({' + '.join(norm)})::DOUBLE, 6) AS norm, ({' + '.join(index)})::BIGINT AS index_sum, ({' + '.join(fields)})::BIGINT AS field_sum, ({' + '.join(cross)})::BIGINT AS cross_sum FROM cnt")


NOTED = " ".join(f"LEFT JOIN n_{k} {s}{k[0]} ON {s}{k[0]}.document_id = r.{s}_document_id" for k in ("categories", "topics", "entities") for s in ("ev", "ad"))


def _ffm() -> str:
    number = lambda k, x: f"({hashed(k, x, 0, 19)} + 100)::VARCHAR"
    text = lambda k, x: f"((((({code(x)}) + {k}) & 524287) * 2654435761 & 524287) + 100)::VARCHAR"
    one = lambda k, c: f"'{k}:' || {number(k, f'coalesce({c}, 0)')} || ':1'"
    word = lambda k, c: f"'{k}:' || {text(k, f'coalesce({c}::VARCHAR, {chr(39) * 2})')} || ':1'"
    many = lambda k, c: f"array_to_string(list_transform({c}, lambda x: '{k}:' || {number(k, 'x.id')} || ':' || printf('%.6f', x.conf)), ' ')"
    parts = [one(0, "ad_id"), one(1, "campaign_id"), *(word(k, c) for k, c in ((2, "advertiser_id"), (3, "platform"), (4, "country"), (5, "state")))]
    parts += [one(6, "ev_document_id"), one(7, "ev_source_id"), one(8, "ev_publisher_id"), many(12, "evc.l"), one(9, "ad_document_id"), one(10, "ad_source_id"), one(11, "ad_publisher_id"), many(13, "adc.l")]
    parts += [f"CASE WHEN {on} THEN '{t}' END" for on, t in (("ad_publisher_id = ev_publisher_id", "18:0:1"), ("ad_source_id = ev_source_id", "19:1:1"), ("viewed > 0", "20:2:1"), ("not_viewed > 0", "21:3:1"))]
    parts += ["'22:' || (weekday + 50)::VARCHAR || ':1'", "'23:' || (hour + 70)::VARCHAR || ':1'"]
    parts += [f"'{k}:{i}:' || printf('%.6f', coalesce({x}, 0)::DOUBLE)" for k, i, x in ((24, 4, POS.format("(ts - ad_publish_ts)")), (25, 5, SIGNED.format("(ev_publish_ts - ad_publish_ts)")))]
    return q(f"SELECT {ROW}, concat_ws(' ', label::VARCHAR, {', '.join(parts)}) AS line FROM rleak r {NOTED}", RIVALS, *map(_notes, ("categories", "topics", "entities")))


def _vw() -> str:
    tags = lambda *pairs: " || ' ' || ".join(f"'{t}_' || coalesce({c}::VARCHAR, '')" for t, c in pairs)
    notes = lambda side, a: " || ".join(f"coalesce(array_to_string(list_transform({side}{k}.l, lambda x: ' {a}d{k if k != 'c' else 'c'}_' || x.id::VARCHAR || ':' || printf('%.6f', x.conf)), ''), '')" for k in "cte")
    flags = " || ".join(f"CASE WHEN {on} THEN ' {t}' ELSE '' END" for on, t in (("ad_publisher_id = ev_publisher_id", "sp"), ("ad_source_id = ev_source_id", "ss"), ("viewed > 0", "v"), ("not_viewed > 0", "nv")))
    sims = " || ".join(f"' s_{i}:' || printf('%.6f', coalesce({c}, 0)::DOUBLE)" for i, c in enumerate(f"{p}_{x}" for p in ("cat", "top", "ent") for x in ("product", "jaccard")))
    every = [(n, [f"{p}_{when}_{x}" for when in ("past", "future") for p in pair for x in ("views", "clicks", "all_views")]) for n, pair in SEEN.items()]
    seen = " || ".join(f"CASE WHEN {c} > 0 THEN ' av_{n}_{i}' ELSE '' END" for n, cs in every for i, c in enumerate(cs))
    label = "CASE WHEN label >= 0 THEN (label * 2 - 1)::VARCHAR || ' ' ELSE '' END"
    text = f"{label} || '|a ' || {tags(('ad', 'ad_id'), ('ac', 'campaign_id'), ('aa', 'advertiser_id'))} || '|l ' || {tags(('c', 'country'), ('s', 'state'), ('p', 'platform'))} || '|t ' || {tags(('h', 'hour'), ('w', 'weekday'))} || '|u ' || {tags(('u', 'uid'))}"
    text += f" || '|d ' || {tags(('ed', 'r.ev_document_id'), ('eds', 'ev_source_id'), ('edp', 'ev_publisher_id'))} || {notes('ev', 'e')} || '|p ' || {tags(('ad', 'r.ad_document_id'), ('ads', 'ad_source_id'), ('adp', 'ad_publisher_id'))} || {notes('ad', 'a')} || '|f' || {flags} || {sims} || {seen}"
    counters = ", ".join(_counters(p, f"uid, {c}") for own in KEYS.values() for p, c in own.items())
    both = " ".join(f"LEFT JOIN s_{p} ON s_{p}.ev_document_id = r.ev_document_id AND s_{p}.ad_document_id = r.ad_document_id" for p in ("cat", "top", "ent"))
    return q(
        f"SELECT {ROW}, {text} AS line FROM seen r {NOTED} {both}", RIVALS, *map(_notes, ("categories", "topics", "entities")), f"seen AS (SELECT *, {counters} FROM rleak)",
        *(f"s_{p} AS ({_similar(k, p)})" for k, p in (("categories", "cat"), ("topics", "top"), ("entities", "ent"))),
    )


def _matrix() -> str:
    cols = [f"{_counters(f'{g}_{p}', f'{keys}, {c}')}" for g, keys in GROUPS.items() for p, c in (("ad_doc", "ad_document_id"), ("src", "ad_source_id"))]
    extra = [f"x_{g}_{p} AS ({_weighted(g, kind, f'{g}_{p}')})" for g, kind, p in (("uid", "topics", "top"), ("uid", "categories", "cat"), ("g2", "categories", "cat"))]
    rate = lambda p: f"round({_lg(p + '_clicks', p + '_views', '10')}, 6)"
    pairs = [f"{g}_{a}_{w}" for g in ("uid", "g2") for a in ("ad_doc", "src", *(("top", "cat") if g == "uid" else ())) for w in ("past", "future")]
    values = ["(viewed > 0)::INT::DOUBLE", "(not_viewed > 0)::INT::DOUBLE", *map(rate, pairs), "0.0::DOUBLE", "0.0::DOUBLE", rate("g2_cat_past"), rate("g2_cat_future")]
    p = "least(greatest(1.0::DOUBLE / rival_count, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)"
    values.append(f"round(ln({p} / (1 - {p})), 6)")
    joins = " ".join(f"JOIN x_{x} USING ({ROW})" for x in ("uid_top", "uid_cat", "g2_cat"))
    return q(f"SELECT {ROW}, " + ", ".join(f"{v} AS c{i}" for i, v in enumerate(values)) + f" FROM m {joins}", RIVALS, f"m AS (SELECT *, {', '.join(cols)} FROM rleak)", *extra)


def _similar(kind: str, prefix: str) -> str:
    return q(
        f"SELECT ev_document_id, ad_document_id, round(coalesce((SELECT sum(x.conf * y.conf) FROM {kind} x JOIN {kind} y ON x.id = y.id WHERE x.document_id = ev_document_id AND y.document_id = ad_document_id), 0), 6) AS {prefix}_product, "
        f"round(coalesce((SELECT count(*) FROM (SELECT id FROM {kind} WHERE document_id = ev_document_id INTERSECT SELECT id FROM {kind} WHERE document_id = ad_document_id))::DOUBLE / nullif((SELECT count(*) FROM (SELECT id FROM {kind} WHERE document_id = ev_document_id UNION SELECT id FROM {kind} WHERE document_id = ad_document_id)), 0), 0), 6) AS {prefix}_jaccard FROM (SELECT DISTINCT ev_document_id, ad_document_id FROM star)"
    )


def _after(span: int) -> str:
    return q(f"SELECT d.uid, d.ts, {_list('v.document_id')} AS doc_ids FROM (SELECT DISTINCT uid, ts FROM displays) d JOIN views v ON v.uid = d.uid AND v.ts > d.ts AND v.ts - d.ts < {span} GROUP BY ALL")


def _bag(x: str, frame: str, name: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY uid ORDER BY display_id RANGE BETWEEN {frame})), ' '), '') AS {name}"


PAST, FUTURE = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"
CLICKED = "CASE WHEN label > 0 THEN ad_document_id END"
BY_USERS = "mine AS (SELECT * FROM views WHERE uid IN (SELECT uid FROM displays))"

FOLDS = f"""labelled AS (SELECT ad_id, label, {mix('display_id')} % 3 AS fold FROM clicks WHERE label >= 0),
other AS (SELECT a.ad_id, a.fold, coalesce(sum(b.label), 0) / (count(b.ad_id) + 10.0::DOUBLE) pred FROM (SELECT DISTINCT ad_id, fold FROM labelled) a LEFT JOIN labelled b ON a.ad_id = b.ad_id AND a.fold <> b.fold GROUP BY ALL),
foldscore AS (SELECT fold, count(*) AS rows, avg(-CASE WHEN label > 0 THEN ln(p) ELSE ln(1 - p) END) AS ll FROM (SELECT l.fold, l.label, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, pred)) p FROM labelled l JOIN other USING (ad_id, fold)) GROUP BY fold)"""
BRANDS = """brands AS (SELECT p_brand, mid, count(*) n, count(*) FILTER (p_size < 25) n1 FROM (SELECT p_brand, p_size, floor(avg(p_retailprice) OVER (PARTITION BY p_brand)) mid FROM part) GROUP BY ALL HAVING n1 > 0)"""
MORE = {
    "tree_importances": f"""WITH {BRANDS} SELECT NULL::DOUBLE AS value, 'size' AS feature, count(*)::DOUBLE AS fscore, sum(n)::DOUBLE AS gain FROM brands
      UNION ALL SELECT NULL, 'price', round(sum(n1 / n::DOUBLE), 6), round(sum(n1 / n::DOUBLE * n1), 6) FROM brands UNION ALL SELECT 10, 'price', count(*)::DOUBLE, sum(n1)::DOUBLE FROM brands""",
    "tree_splits": f"WITH {BRANDS} SELECT mid::DOUBLE AS value, count(*) AS n FROM brands GROUP BY mid",
    "csv_round_trip": q("SELECT ad_id, ad_document_id AS document_id, campaign_id, NULL::BIGINT AS advertiser_id FROM ads"),
    "lines_round_trip": f"SELECT line, count(*) AS n FROM ({_ffm()}) GROUP BY line",
    "sparse_range": f"SELECT * FROM (SELECT {ROW}, n_features, (sum(n_features) OVER (ORDER BY {ROW}) - n_features)::BIGINT AS first_feature FROM ({_export('p1')})) WHERE first_feature BETWEEN 10000 AND 59999",
    "predictions_round_trip": q(f"SELECT {ROW}, round(coalesce(pred, 0), 6) AS pred FROM clicks LEFT JOIN mean USING (ad_id)", MEAN),
    "first_ad_of_display": q("SELECT display_id, min(ad_id) AS ad_id FROM clicks GROUP BY display_id"),
    "ads_with_default": q("SELECT i AS ad_id, coalesce(d, 0) AS display_id FROM range((SELECT max(ad_id) + 50 FROM ads)) t(i) LEFT JOIN (SELECT ad_id, max(display_id) d FROM clicks GROUP BY ad_id) ON ad_id = i"),
    "sorted_annotations": q("SELECT document_id, string_agg(id::VARCHAR || ':' || printf('%.6f', conf), ' ' ORDER BY id, conf) AS topics FROM topics GROUP BY document_id"),
    "joined_strictly": q(f"SELECT {ROW}, ad_document_id, campaign_id FROM clicks JOIN ads USING (ad_id)"),
    "fold_scores": q("SELECT fold, rows, round(ll, 6) AS logloss FROM foldscore", FOLDS),
    "fold_summary": q("SELECT round(avg(ll), 6) AS mean, round(stddev_pop(ll), 6) AS std, count(*) AS folds FROM foldscore", FOLDS),
    "bag_mean": q("SELECT ad_id, round(avg(p), 6) AS pred, round(1 / (1 + exp(-avg(ln(p / (1 - p))))), 6) AS pred_of_score FROM (SELECT ad_id, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, sum(label) / (count(*) + s))) p FROM clicks, (VALUES (5.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)) t(s) WHERE label >= 0 GROUP BY ad_id, s) GROUP BY ad_id"),
    "unit_functions": q("SELECT ad_id, (ad_id % 50 = 0)::INT AS nan, CASE WHEN ad_id % 50 = 0 THEN 0 ELSE sign(x) END::DOUBLE AS sgn, CASE WHEN ad_id % 50 = 0 OR x < 0 THEN 0 ELSE x END::DOUBLE AS relu, CASE WHEN ad_id % 50 = 0 THEN 0 ELSE round(1 / (1 + exp(-x)), 6) END::DOUBLE AS sigmoid FROM (SELECT ad_id, (ad_id % 21 - 10)::DOUBLE / 4 x FROM ads)"),
    "time_grid": q("SELECT i::INT AS point, round(a + (b - a) * i / 199.0::DOUBLE, 3) AS value FROM (SELECT min(ts)::DOUBLE a, max(ts)::DOUBLE b FROM displays), range(200) t(i)"),
    "prediction_names": q("SELECT fold, '20240102-0304-ad-mean-' || printf('%.5f', ll) AS name FROM foldscore", FOLDS),
}


ORACLE_SQL = {
    "entry_map12": q(f"SELECT round(avg(CASE WHEN r <= 12 THEN 1.0::DOUBLE / r ELSE 0 END), 6) AS map12, count(*) AS displays FROM (SELECT display_id, min(r) r FROM (SELECT *, row_number() OVER (PARTITION BY display_id ORDER BY pred DESC, {TIES}) r FROM scored) WHERE clicked = 1 GROUP BY display_id)", SCORED),
    "map12_pessimistic": _pessimistic(False),
    "map12_sorted": _pessimistic(True),
    "mrr_present_future": q(
        f"SELECT bucket, round(sum(s) / count(*), 6) AS mrr, count(*) AS displays FROM (SELECT s, unnest(['total', CASE WHEN ts < 1900000000 THEN 'present' ELSE 'future' END]) AS bucket FROM (SELECT display_id, any_value(ts) ts, sum(CASE WHEN clicked = 1 THEN 1.0::DOUBLE / r ELSE 0 END) s FROM (SELECT s.*, d.ts, row_number() OVER (PARTITION BY display_id ORDER BY pred DESC, {TIES}, ship) r FROM scored s JOIN displays d USING (display_id)) GROUP BY display_id)) GROUP BY bucket",
        SCORED,
    ),
    "submission_top12": q(f"SELECT display_id, string_agg(ad_id::VARCHAR, ' ' ORDER BY r) AS ad_ids FROM (SELECT *, row_number() OVER (PARTITION BY display_id ORDER BY pred DESC, {TIES}, ship) r FROM scored) WHERE r <= 12 GROUP BY display_id", SCORED),
    "ad_mean_ctr": q("SELECT ad_id, round(pred, 6) AS pred FROM mean", MEAN),
    "cv_split_counts": q("SELECT CASE WHEN ts >= 1900000000 OR display_id % 6 = 5 THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(clicked)::BIGINT AS n_clicked FROM clicks JOIN displays USING (display_id) GROUP BY 1"),
    **{f"counts_{n}": q(_pivot(c)) for n, c in PIVOTS.items()},
    "counts_all": q(" UNION ALL ".join(f"SELECT '{n}' AS feature, * FROM ({_pivot(c)})" for n, c in PIVOTS.items())),
    "leak_viewed": q(f"SELECT {ROW}, viewed, not_viewed FROM leak", LEAK),
    "viewed_docs": _views_docs("uid", True),
    "viewed_categories": _views_weight("uid", True, "categories", "category_view_weight"),
    "viewed_topics": _views_weight("uid", True, "topics", "topic_view_weight"),
    "g1_viewed_docs": _views_docs("platform, geo", False),
    "g1_viewed_categories": _views_weight("platform, geo", False, "categories", "category_view_weight"),
    "g1_viewed_topics": _views_weight("platform, geo", False, "topics", "topic_view_weight"),
    "uid_viewed_grps": q(f"SELECT {ROW}, {_counters('grp', 'uid')} FROM star"),
    **{f"{g}_viewed_{w}": q(f"SELECT {ROW}, " + ", ".join(_counters(p, f"{keys}, {c}") for p, c in KEYS[w].items()) + " FROM star") for g, keys in GROUPS.items() for w in KEYS},
    **{f"{g}_viewed_ad_cats": q(_weighted(g, "categories", "cat")) for g in GROUPS},
    **{f"{g}_viewed_ad_tops": q(_weighted(g, "topics", "top")) for g in GROUPS},
    "uid_viewed_ad_bags": q(f"SELECT {ROW}, {_bag('ad_document_id', PAST, 'past_views_docs')}, {_bag(CLICKED, PAST, 'past_clicks_docs')}, {_bag('ad_document_id', FUTURE, 'future_views_docs')}, {_bag(CLICKED, FUTURE, 'future_clicks_docs')} FROM star"),
    "uid_viewed_ad_leak": q(f"SELECT {ROW}, CASE WHEN EXISTS (SELECT 1 FROM displays d WHERE d.uid = s.uid AND d.document_id = s.ad_document_id AND d.display_id > s.display_id AND d.display_id IN (SELECT display_id FROM clicks)) THEN 1 ELSE 0 END AS later_flag FROM star s"),
    "uid_viewed_ad_leak_2": q(f"SELECT {ROW}, CASE WHEN n.next_doc = s.ad_document_id THEN 1 ELSE 0 END AS next_flag FROM star s JOIN (SELECT display_id, lead(document_id) OVER (PARTITION BY uid ORDER BY display_id) next_doc FROM displays WHERE display_id IN (SELECT display_id FROM clicks)) n USING (display_id)"),
    "user_docs": q(f"SELECT uid, {_list('document_id')} AS doc_ids FROM mine WHERE document_id IN (SELECT document_id FROM displays GROUP BY document_id HAVING count(*) > 1) GROUP BY uid", BY_USERS),
    "user_sources": q(f"SELECT uid, {_list('source_id')} AS source_ids FROM mine JOIN docs USING (document_id) WHERE source_id IS NOT NULL GROUP BY uid", BY_USERS),
    "user_tagged_docs": q("SELECT uid, " + ", ".join(_list("document_id", f" FILTER (tag = {t})") + f" AS {n}" for t, n in ((32, "internal"), (33, "social"), (34, "search"))) + " FROM views GROUP BY uid"),
    "user_tagged_sources": q("SELECT uid, " + ", ".join(_list("source_id", f" FILTER (tag = {t})") + f" AS {n}" for t, n in ((32, "internal"), (33, "social"), (34, "search"))) + " FROM views JOIN docs USING (document_id) WHERE source_id IS NOT NULL GROUP BY uid"),
    "one_hour_after": _after(3_600_000),
    "six_hours_after": _after(21_600_000),
    "doc_ad_others": q(f"SELECT display_id, {_list('code', '', '')} AS ids FROM (SELECT display_id, (ev_document_id::VARCHAR || '99' || ad_id::VARCHAR)::BIGINT % 4194304 AS code, count(*) OVER (PARTITION BY ev_document_id, ad_id) n FROM star) WHERE n >= 2 GROUP BY display_id"),
    "rivals": q(f"SELECT {ROW}, n AS rival_count, r - 1 AS rank, coalesce(array_to_string(list_concat(list_slice(al, 1, r - 1), list_slice(al, r + 1, n)), ' '), '') AS rivals FROM (SELECT *, count(*) OVER (PARTITION BY display_id) n, row_number() OVER (PARTITION BY display_id ORDER BY {TIES}, ship) r, list(ad_id) OVER (PARTITION BY display_id ORDER BY {TIES}, ship ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) al FROM clicks)"),
    **{f"similarity_{k}": _similar(k, p) for k, p in (("categories", "cat"), ("topics", "top"), ("entities", "ent"))},
    "feature_hash": q("SELECT ad_id, " + ", ".join(f"{hashed(k, 'ad_id', 200)} AS h{k}" for k in (0, 7, 30, 39)) + f", {hashed(30, 'ad_id', 100, 19)} AS h19, ({12 << 20} | (ad_id & 1048575)) AS raw12, {code('advertiser_id')} AS code FROM ads"),
    "rare_bucket": q(f'SELECT id::BIGINT AS ad_id, CASE WHEN least(train_count, test_count) < 5 THEN train_count + test_count ELSE id::BIGINT + 100 END AS "both", CASE WHEN train_count < 50 THEN train_count ELSE id::BIGINT + 100 END AS train FROM ({_pivot("ad_id")})'),
    "time_diffs": q(f"SELECT {ROW}, round({POS.format('(ts - ad_publish_ts)')}, 6) AS pos, round(({POS.format('(ad_publish_ts - ts)')})::DOUBLE, 6) AS neg, round({SIGNED.format('(ev_publish_ts - ad_publish_ts)')}, 6) AS signed FROM star"),
    "geo_calendar": q("SELECT DISTINCT display_id, country, state, region, hour, weekday FROM star"),
    "encode_first_seen": q("SELECT geo, dense_rank() OVER (ORDER BY f) AS code FROM (SELECT geo, min(display_id) f FROM displays GROUP BY geo)"),
    "publish_times": q("SELECT document_id, CASE document_id % 4 WHEN 0 THEN greatest(epoch_ms(TIMESTAMP '2015-06-01 00:00:00') - 1465876799998, -1000000000000) WHEN 1 THEN greatest(epoch_ms(TIMESTAMP '2015-02-03 04:05:06') - 1465876799998, -1000000000000) WHEN 2 THEN epoch_ms(TIMESTAMP '2016-06-14 04:00:00') - 1465876799998 ELSE -1000000000000 END AS publish_ms FROM docs"),
    "fold_assign": q(f"SELECT display_id, {mix('display_id')} % 3 AS fold FROM displays"),
    "logloss": q("SELECT round(avg(-CASE WHEN label > 0 THEN ln(p) ELSE ln(1 - p) END), 6) AS logloss, count(*) AS rows FROM (SELECT label, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, coalesce(pred, 0))) p FROM clicks LEFT JOIN mean USING (ad_id) WHERE label >= 0)", MEAN),
    "blend": q(f"SELECT {ROW}, round(0.7::DOUBLE * coalesce(pred, 0) + 0.3::DOUBLE / count(*) OVER (PARTITION BY display_id), 6) AS pred FROM clicks LEFT JOIN mean USING (ad_id)", MEAN),
    **{f"export_{p}": _export(p) for p in BOTH},
    "dataset_offsets": f"SELECT {ROW}, n_features, (sum(n_features) OVER (ORDER BY {ROW}) - n_features)::BIGINT AS first_feature FROM ({_export('p1')})",
    "export_ffm": _ffm(),
    "export_vw": _vw(),
    "ctr_logit_matrix": _matrix(),
    "streaming_past_views": q("SELECT epoch_ms(time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01')) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
}
ORACLE_SQL |= MORE
