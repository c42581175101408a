"""Each operator against a brute-force version, with nulls, empty texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import collections
import functools
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from brindle.llm import components, decontam, license_rules, licenses, lm, mixing, quality, simhash, substring, toxicity, warc, webp
from brindle.llm.common import crc_bucket, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}é" if k % 7 == 0 else f"Word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(1, 120)) for _ in range(40)]
    passage = text(45)
    rows = [*base, *base[:6], *(f"{b} {passage}\n{text(9)}" for b in base[:8]), None, "", "   \n", text(6000), passage + " " + passage, "İ ÉCOLE\x1cx y z"]
    return [(k, t) for k, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i is None or i % 5 else None, 1, 9, 0.5) for i, t in rows], SCHEMA)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (2, 1), (None, 4), (30, 20), (20, 10), (10, 5)], "u long, v long")
    assert {(r.node, r.component) for r in components.connected_components(links).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (30, 5), (20, 5), (10, 5), (5, 5)}
    assert components.connected_components(links.limit(0)).count() == 0


def test_simhash_finds_all_links(spark):
    rows = corpus()
    found = simhash.near_duplicates(frame(spark, [*rows, rows[3]]), shingle_words=4).collect()

    def plain(t):
        w = spaced(ascii_lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = {i: plain(t) for i, t in rows}
    assert all(r.f0 % 2**64 == prints[r.id] for r in found) and len(found) == len(rows) + 1
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.component for r in found} == root
    assert simhash.near_duplicates(frame(spark, rows[:1]).limit(0)).count() == 0


def test_near_duplicates_of_similar_sets_go(spark):
    rng = random.Random(5)
    words = [f"t{k}" for k in range(3000)]
    one = [rng.choice(words) for _ in range(300)]
    near = one[:150] + ["changed"] + one[151:]
    rows = [(1, " ".join(one)), (2, " ".join(near)), (3, " ".join(rng.choice(words) for _ in range(300))), (4, " ".join(one)), (None, "x y z a b c")]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert kept == {1, 3, None}


def test_near_duplicates_just_above_the_threshold_go(spark):
    rng = random.Random(9)
    rows = []
    for k in range(100):
        one = [f"u{rng.randrange(5000)}" for _ in range(300)]
        other = [f"changed{j}" if j % 50 == 25 else w for j, w in enumerate(one)]  # 266 of 326 shingles are shared: 0.816
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert set(range(0, 200, 2)) <= kept and len(kept) <= 105


def test_rows_without_an_id_are_judged_by_row(spark):
    one, other = ([f"{c}{k}" for k in range(300)] for c in "ab")
    near = " ".join(other[:150] + ["changed"] + other[151:])
    rows = [(3, " ".join(one)), (None, " ".join(one)), (None, " ".join(other)), (None, " ".join(other)), (None, near), (-5, "alone")]
    kept = collections.Counter((r.doc_id, r.text[:4]) for r in simhash.drop_near_duplicates(frame(spark, rows)).collect())
    assert kept == {(3, "a0 a"): 1, (None, "b0 b"): 1, (-5, "alon"): 1}
    model = quality.RuleModel(-3.0, [(((quality.STATS.index("log_words"), True, 2.0),), 6.0)])
    left = quality.keep_quality(frame(spark, [(None, "bad"), (None, " ".join(one)), (1, "bad"), (2, " ".join(one))]), model).collect()
    assert {(r.doc_id, len(r.text.split())) for r in left} == {(None, 300), (2, 300)}


def brute_repeats(rows, n=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = spaced(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone[s : s + n] = [True] * n
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_candidate_pairs_are_reduced_before_they_are_written(spark, monkeypatch):
    """Each bucket's task would write a file of its own, of pairs that other buckets find too."""
    made, kept = [], simhash.keep

    def keep(df, scratch=None):
        made.append(df._jdf.queryExecution().optimizedPlan().nodeName())
        return kept(df, scratch)

    monkeypatch.setattr(simhash, "keep", keep)
    rows = [(i, " ".join(f"w{j}" for j in range(i // 2 * 50, i // 2 * 50 + 60 + i % 2))) for i in range(20)]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == list(range(0, 20, 2))
    assert made and "FlatMapGroupsInArrow" not in made


def test_substring_dedup(spark):
    rows = corpus()
    assert {r.id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(frame(spark, rows)).collect()} == brute_repeats(rows)
    twice = substring.dedup_substrings(frame(spark, [rows[0], rows[0], (None, rows[0][1])])).collect()
    assert len(twice) == 3
    assert substring.dedup_substrings(frame(spark, rows).limit(0)).count() == 0


def test_substring_dedup_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", (2_000, 2_000))
    rows = corpus(8)
    assert {r.id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup_substrings(frame(spark, rows)).collect()} == brute_repeats(rows)


def test_repeated_rows_and_texts_of_one_id_keep_their_own_words(spark):
    one, two, passage, only = (" ".join(f"{c}{k}" for k in range(30)) for c in "abcd")
    rows = [(1, one), (1, one), (2, passage + " " + two), (3, passage + "  x"), (3, only), (4, "short  text"), (5, None), (6, "")]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in substring.drop_repeats(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, one, 1), (2, passage + " " + two, 1), (3, "x", 1), (3, only, 1), (4, "short  text", 1), (5, None, 1), (6, "", 1)], key=str)
    bare = substring.drop_repeats(frame(spark, [(1, one), (None, one + " y z")])).collect()
    assert {(r.doc_id, r.text) for r in bare} == {(1, one), (None, "y z")}


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, block_bytes):
    rows = corpus()
    items = [(1, " ".join(spaced(rows[3][1])[:14]) + " etc"), (2, rows[8][1]), (3, "zzz"), (4, None), (5, ""), (10, "word1"), (None, rows[9][1])]
    got = decontam.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    want = {}
    for i, t in rows:
        w, hit, own = alnum(t), set(), set()
        for k, x in items:
            v = alnum(x)
            for s in range(max(1, len(v) - 9)) if v else []:
                part = v[s : s + 10]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        own.add("null" if k is None else str(k))
        want[i] = (len(w), len(hit), sorted(own))
    assert {r.id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    kept = {r.doc_id for r in decontam.drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()}
    assert kept == {i for i, x in want.items() if not x[1]}


def edf(blocks, share):
    """Slots of all blocks (source, k), by an earliest-deadline-first run slot by slot. Equal deadlines: the smaller share, then round, then source."""
    p, done, out, t = sum(share.values()), dict.fromkeys(share, 0), {}, 0
    while any(done[s] < blocks[s] for s in share):
        ready = [(-(-(k + 1) * p // share[s]), share[s], k, s) for s, k in done.items() if k * p // share[s] <= t]
        s = min(ready)[3]
        if done[s] < blocks[s]:
            out[s, done[s]] = t
        done[s] += 1
        t += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 0.9, "b": 0.0996, "c": 0.0004}, {"a": 0.31, "b": 0.31, "c": 0.31, "": 0.07}, {"a": 1, "b": 0, "c": 0.7}, None])
def test_mixing_runs_earliest_deadlines_first(spark, weights):
    rows = [(k, "", "en", "abc"[min(2, k % 7)] if k % 50 else "", 1, 9, 0.5) for k in range(2000)] + [(5000, None, None, None, 1, 1, 1.0), (7, "", "en", "a", 1, 9, 0.5), (7, "", "en", "a", 1, 9, 0.5), (None, "", "en", "a", 1, 9, 0.5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = collections.Counter(r[3] for r in rows)
    share = mixing.whole_shares(weights) if weights else {s: math.isqrt(n) for s, n in counts.items()}
    share = {s: w for s, w in share.items() if w}
    got = mixing.mix_sources(docs, weights, block_docs=4).orderBy("mix_position").collect()
    assert [r.mix_position for r in got] == list(range(sum(counts[s] for s in share)))
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((r[0], r[3]) for r in rows if r[3] in share)
    assert all(r.release <= r.slot < r.deadline for r in got) and [r.slot for r in got] == sorted(r.slot for r in got)
    p, seen = sum(share.values()), {(r.source, r.block): r.slot for r in got}
    assert seen == edf({s: -(-counts[s] // 4) for s in share}, share)
    ends = {s: max(t for (x, _), t in seen.items() if x == s) for s in share}
    done = collections.Counter()
    for (s, _), t in sorted(seen.items(), key=lambda x: x[1]):
        done[s] += 1
        assert all(abs(done[x] * p - (t + 1) * w) < p for x, w in share.items() if t <= ends[x])  # less than one block from the target after every slot


def test_mixing_of_many_sources_small_tables_and_clashing_names(spark):
    many = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 1500 AS STRING) AS source", "id AS slot", "id AS rank", "id AS h", "'x' AS row")
    got = mixing.mix_sources(many, block_docs=1).collect()
    assert sorted(r.mix_position for r in got) == list(range(6000)) and all(r.rank == r.h == r.doc_id and r.row == "x" and r.release <= r.slot < r.deadline for r in got)
    assert mixing.mix_sources(many.limit(0)).count() == 0 and mixing.mix_sources(many, {}).count() == 0 and mixing.mix_sources(many, {"1": 0}).count() == 0
    assert mixing.whole_shares({"a": 0.9996, "b": 0.0004, "c": 0}) == {"a": 2499, "b": 1, "c": 0}
    assert sum(mixing.whole_shares({"a": 0.123456789012345, "b": 0.7654321, "c": 1e-15}).values()) <= mixing.LONGEST_PERIOD + 3
    with pytest.raises(ValueError):
        mixing.whole_shares({"a": -1})


def test_quality_rules_and_scores(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randint(1, 500)) for _ in range(60))
    rows = [(k, good() if k % 4 else "BUY!! " * rng.randint(20, 80)) for k in range(400)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.fit_quality(docs, labels, use=crc_bucket("doc_id", 5) != 0)
    got = {r.id: r for r in quality.score_quality(docs, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].predicted == int(k % 4 > 0) for k in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 402
    assert quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0))).first().score == 0.5


def test_toxicity(spark):
    rng = random.Random(2)
    plain = lambda: " ".join(f"n{rng.randint(1, 300)}" for _ in range(50))
    rows = [(k, plain() + (" vileword" * (1 + k % 3) + " nastyish" if k % 5 == 0 else "")) for k in range(600)] + [(900, None)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, labels, use=crc_bucket("doc_id", 5) != 0)
    got = {r.id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[k].toxic == (k % 5 == 0) for k in range(600))
    assert all(0 <= r.severity <= 3 for r in got.values()) and not got[900].toxic
    assert list(model.cuts) == sorted(model.cuts)


@pytest.mark.parametrize("archive_bytes", [64 << 20, 300])
def test_warc_round_trip_and_index(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    big = "<p>" + "x" * 200
    rows = [(5, "http://a.example.org/x?q=1", big), (2, "https://www.b.example.com:8080/y", big), (9, None, big), (1, "u", "small"), (7, "u", "small"), (8, "bad url\n", None), (12, "http://line.example.org/a\u2028b\x85c", None), (None, "n", big), (11, "http://é.org/", "é" * 120), (11, "http://é.org/", "é" * 120)]
    folder = shared_dir(spark)
    captures, shards = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.id: r for r in warc.read_archive(spark, folder, captures, shards).collect()}
    for i, _, html in rows:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].digest) == (len(b), *[hashlib.sha256(b).hexdigest()] * 2)
    assert {i: (r.kind, r.refers_to) for i, r in got.items()} == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 1: ("response", None), 7: ("response", None), 8: ("response", None), 12: ("response", None), None: ("response", None), 11: ("response", None)}
    index = warc.CaptureIndex(warc.store(folder)[0], shards)
    places = collections.defaultdict(set)
    for c in captures.collect():
        places[c.key].add((c.file, c.offset, c.length))
    assert all(index.find(k) in v for k, v in places.items())  # repeated rows share a key
    assert index.find("zz") is None and warc.reversed_host_key("http://www.A.example.org/p") == "org,example,a)/p"


@functools.cache
def compiled_rules():
    return [(priority, re.compile(rx), label) for priority, _, rx, label in license_rules.rules()]


def brute_licenses(text):
    """(words, base places, detections left) with every rule's regular expression run on the text, whatever its word."""
    w = alnum(text)
    base = [(k, label) for label, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    norm, found = " " + " ".join(w) + " ", []
    for order, (priority, rx, label) in enumerate(compiled_rules()):
        for m in rx.finditer(norm):
            a = norm[: m.start()].count(" ") - 1
            found.append((a, -(a + m.group().count(" ") + 1), priority, order, label))
    left = [d for d in found if not any(e != d and e[0] <= d[0] and e[1] <= d[1] and e[2] <= d[2] and (e[:2] != d[:2] or e[2:4] < d[2:4]) for e in found)]
    return w, base, left


LICENSE_TEXTS = ["Licensed under the Apache License, Version 2.0. MIT license", "GNU Lesser General Public License", "der mit license the MIT-License", "SPDX-License-Identifier: MIT", None, "", "all rights reserved. Copyright (c) 2020"]
LICENSE_TEXTS += ["licensed under the GNU GPL License v2", "GNU LGPL License", "gnu agpl license", "the MPL license", "GFDL license", "Expat License", "X11 License, MIT X11 license", "libpng license", "PSF license", "CDDL license", "CC BY License, CC BY-SA License"]
LICENSE_TEXTS += ["Creative Commons Attribution Non-Commercial License", "released under the terms of the Modified BSD licence version 2 or later", "see the COPYING file for more details", "The origin of this software must not be misrepresented; you must not claim"]
LICENSE_TEXTS += ["Licence MIT licence Licence", "licence licence license apache licence", "mit license mit license mit license", "public domain public domain copyright notice copyright notice", "the Apache License of the apache software license version 1 1"]
LICENSE_TEXTS += ["Neither the name of the Acme Widget Company nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]


def test_licenses(spark):
    texts = [*LICENSE_TEXTS, *(f"{n} license" for _, names, _ in license_rules.FAMILIES for n in license_rules._alternatives(names) if re.fullmatch("[a-z0-9 ]+", n))]
    rows = list(enumerate(texts))
    got = licenses.scan_licenses(frame(spark, [*rows, rows[0]])).collect()
    assert len(got) == len(rows) + 1 and got[0] == got[-1]
    for r in got:
        w, base, left = brute_licenses(texts[r.id])
        assert r.n_words == len(w) and sorted((b.start, b.label) for b in r.base) == sorted(base)
        assert sorted((d.start, d.stop, d.priority, d.label) for d in r.detections) == sorted((a, -b, p, label) for a, b, p, _, label in left), texts[r.id]
        assert r.labels == ",".join(sorted({label for _, label in base} | {d[4] for d in left})) and r.base_labels == ",".join(sorted({label for _, label in base}))
        assert r.score == max([licenses.SCORES[d[2]] for d in left] + [licenses.SCORES[3]] * bool(base), default=0)
    assert got[1].labels == "gpl,lgpl" and licenses.scan_licenses(frame(spark, rows).limit(0)).count() == 0
    assert [got[i].labels for i in range(7, 17)] == ["gpl", "lgpl", "agpl", "mpl", "fdl", "mit", "mit", "zlib", "psf", "cddl"]


def test_license_rules_find_their_own_words(spark):
    assert len(license_rules.HAND_WRITTEN) >= 200 and len({rx for _, _, rx in license_rules.HAND_WRITTEN}) == len(license_rules.HAND_WRITTEN)
    for _, words, rx, _ in license_rules.rules():
        held = license_rules.literal(rx.removeprefix("(?<= )(?:").removesuffix(")(?= )"))
        assert any(stem in held for stem in licenses.STEMS), rx
        assert ("license" if "licence" in words else words[0]) in held.split(" ") or "license" in words or words == ("identifier",), rx

    def sample(rx, last):
        """A match of rx: of each choice the first part or the last, what may be absent or not."""
        while True:
            new = re.sub(r"\(\?:([^()]*)\)([?]|\{[0-9,]*\})?", lambda m: "" if m[2] == "?" and not last else m[1].split("|")[-1 if last else 0], rx)
            if new == rx:
                break
            rx = new
        rx = re.sub(r"\[([^]])[^]]*\]", r"\1", rx.replace("[^ ]", "x")).replace("[^ ]+", "x")
        rx = re.sub(r"\.\{[0-9,]*\}", "x y", rx)
        rx = re.sub(r"([0-9a-z ])\{[0-9,]*\}", lambda m: m[1] * 4, rx)
        return re.sub(r" [?]", " " if last else "", re.sub(r"([0-9a-z])[?]", r"\1" if last else "", rx)).replace("+", "")

    texts = []
    for _, _, rx in license_rules.HAND_WRITTEN:
        texts += [t for t in (sample(rx, False), sample(rx, True)) if re.fullmatch(rx, t)]
    assert len(texts) > 1.8 * len(license_rules.HAND_WRITTEN) - 20
    for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).collect():
        left = brute_licenses(texts[r.id])[2]
        assert left and sorted((d.start, d.stop, d.priority, d.label) for d in r.detections) == sorted((a, -b, p, label) for a, b, p, _, label in left), texts[r.id]


def test_license_scan_of_long_texts_takes_time_in_proportion(spark):
    import time

    part, took = "copyright notice mit license ", []
    for n in (36_000, 144_000):
        began = time.time()
        r = licenses.scan_licenses(frame(spark, [(1, part * n)])).selectExpr("n_words", "size(base) b", "size(detections) d", "labels").first()
        took.append(time.time() - began)
        assert (r.n_words, r.b, r.labels) == (4 * n, n, "copyright,mit") and r.d == 2 * n
    assert took[1] < 8 * took[0]


def test_lm_counts_and_normalisation(spark):
    rows = corpus()
    got = {r.id: r for r in lm.score_texts(frame(spark, rows), crc_bucket("doc_id", 7) != 2).collect()}
    tokens = {i: [*spaced(ascii_lower(t)), None] for i, t in rows}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in learn for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0
    twice = lm.score_texts(frame(spark, [(1, "a b"), (1, "a b"), (2, None), (2, "")]), F.col("doc_id") < 9).collect()
    assert sorted((r.id, r.n_tokens, r.train_tokens) for r in twice) == [(1, 3, 8), (1, 3, 8), (2, 1, 8), (2, 1, 8)]
    assert lm.score_texts(frame(spark, rows).limit(0), F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in lm.score_texts(frame(spark, rows[:5]), F.lit(False)).collect())


def chain(seed, n):
    """Texts in which a word all but decides the next, over more words than have cells of their own."""
    rng, out = random.Random(seed), []
    for k in range(n):
        w = [rng.randrange(400)]
        for _ in range(120):
            w.append((w[-1] * 7 + 3) % 400 if rng.random() < 0.9 else rng.randrange(400))
        out.append((k, " ".join(f"q{x}{'aeiou'[x % 5]}" for x in w)))
    return out


def test_lm_learns_from_words_and_equals_a_sequential_model(spark):
    rows = chain(1, 500)
    got = {r.id: r for r in lm.score_texts(frame(spark, rows), crc_bucket("doc_id", 7) != 2).collect()}
    held = [r for r in got.values() if not r.train]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) / tokens > 0.2

    # the same model, step by step in one process, by plain loops over tokens
    learn = {i: lm.tokens_of(t.encode()) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2}
    count = collections.Counter(w for ws in learn.values() for w in ws)
    order = sorted(count, key=lambda w: (w != lm.END, -count[w], lm.word_hash(w) - 2**64 if lm.word_hash(w) >= 2**63 else lm.word_hash(w)))
    tops = {lm.word_hash(w): (i % (lm.CLASSES // 2)) * lm.SLOTS + i // (lm.CLASSES // 2) for i, w in enumerate(order[: lm.TOPS])}
    words = lm._Words(tops)
    mass, distinct = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for w, c in count.items():
        mass[words[w] & 255] += c
        distinct[words[w] & 255] += 1
    model = lm.start_model(lm.Vocabulary(sum(count.values()), len(count), tops, mass, distinct))
    rounds = {r.doc_id: r.k for r in spark.createDataFrame([(i,) for i in learn], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(lm.ROUNDS)).alias("k")).collect()}
    sure = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for k in range(lm.ROUNDS):
        seen = [np.zeros(model.w.shape), np.zeros(model.v.shape)]
        hoped = [np.zeros(model.w.shape), np.zeros(model.v.shape)]
        for i, ws in learn.items():
            if rounds[i] == k:
                x = np.array([words[w] for w in ws])
                rows_of = lm.feature_rows(x, np.array([0]))
                for t, cell in enumerate(x & 255):
                    c, own = cell // lm.SLOTS, rows_of[:, t]
                    own2 = lm.slot_rows(rows_of[:, t : t + 1], np.array([c]))[:, 0]
                    for table, at, weights, bias, target in ((0, own, model.w, model.bias, c), (1, own2, model.v, model.slot_bias[c], cell % lm.SLOTS)):
                        p = sure(weights[at].sum(0) + bias)
                        for r in at:
                            seen[table][r, target] += 1
                            hoped[table][r] += p
        model = lm.step(model, seen, hoped, 0.5, 10.0)
    for i, t in rows[:60]:
        x = np.array([words[w] for w in lm.tokens_of(t.encode())])
        at, score = lm.feature_rows(x, np.array([0])), 0.0
        for j, (w, cell) in enumerate(zip(lm.tokens_of(t.encode()), x & 255, strict=True)):
            c = cell // lm.SLOTS
            score += math.log(sure(model.w[at[:, j]].sum(0) + model.bias)[c]) + math.log(sure(model.v[lm.slot_rows(at[:, j : j + 1], np.array([c]))[:, 0]].sum(0) + model.slot_bias[c])[cell % lm.SLOTS])
            score += math.log((count[w] + 1) / (mass[cell] + distinct[cell] + 1))
        assert math.isclose(got[i].score, score / math.log(10), rel_tol=0.005), (i, got[i].score, score / math.log(10), got[i].base_score)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    model = lm.MaxEnt(rng.normal(0, 1, (lm.ROWS, lm.CLASSES)).astype(np.float32), rng.normal(0, 1, (lm.SLOT_ROWS, lm.SLOTS)).astype(np.float32), np.zeros(lm.CLASSES, np.float32), np.zeros((lm.CLASSES, lm.SLOTS), np.float32))
    cells = np.arange(lm.CLASSES * lm.SLOTS)
    rows_ = np.repeat(lm.feature_rows(np.array([3, 7, 250, 9]) << 8, np.array([0]))[:, -1:], len(cells), 1)
    assert abs(np.exp(lm.log_cells(model, cells, rows_)).sum() - 1) < 1e-4


def test_webp_formats():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (9, 13), (20, 17)):
        px = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
        flat = rng.integers(0, 4, (h, w, 1)).astype(np.uint8).repeat(4, 2)
        tiles = -(-w // 4) * -(-h // 4)
        modes = [int(x) for x in rng.integers(0, 14, tiles)]
        for image in (px, flat):
            for kw in ({}, {"subtract_green": True}, {"predictor": (2, modes)}, {"cross": (2, [int(x) for x in rng.integers(0, 1 << 24, tiles)])}, {"cache_bits": 5, "copies": True}, {"groups": (2, [m % 3 for m in modes[:-1]] + [2])}, {"predictor": (2, modes), "subtract_green": True, "copies": True, "cache_bits": 3}):
                assert (webp.decode(webp.encode(image, **kw)) == image).all(), kw
        assert (webp.decode(webp.encode(flat, palette=True, copies=True)) == flat).all()
    with pytest.raises(ValueError):
        webp.decode(webp.encode(px)[:60])


def test_webp_file_of_another_writer():
    """The one-pixel lossless file by which web pages commonly test for the format."""
    px = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert px.shape == (1, 1, 4)


def test_webp_payloads_use_transforms_references_and_cache():
    rng = random.Random(4)
    line = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40)).encode()[:128]
    prose = bytes(rng.randrange(256) for _ in range(4096))
    kinds = {"few": [b"BUY!! " * 500 + b"\0" * 8, b"\0" * 640, b"ab" * 3200], "pairs": [b"".join(line + bytes(rng.randrange(97, 123) for _ in range(64)) for _ in range(60)), prose + prose + prose], "": [prose, b"\0" * 64, b"x" * 192]}
    for kind, payloads in kinds.items():
        for p in payloads:
            assert webp.repetition(p) == kind and len(p) % 64 == 0
            media = webp.encode_bytes(p)
            assert webp.decode_bytes(media)[1] == p
            assert not kind or len(media) < len(p) * 0.75


def test_webp_texts(spark):
    rows = [*corpus(), (900, "same line of text\n" * 300), (901, "\n".join(f"{k} the same long line of text with its number" for k in range(400))), (902, "z" * 3_000_000), (3, "a second row")]
    for r in webp.read_media(webp.store_texts(frame(spark, [*rows, rows[0]]))).collect():
        b = (("a second row" if r.n_bytes == 12 else dict(rows[:-1])[r.id]) or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert bytes(r.pixels)[: len(p)] == p
    assert webp.read_media(webp.store_texts(frame(spark, rows).limit(0))).count() == 0


def hostile(spark, d):
    """The smallest documents with nulls, empty, long and repeated rows, texts of one id, and columns named as stages might name theirs."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    one = next(r for r in rows if 100 < len((r[1] or "").split()) < 400)
    long = " ".join(f"long{k % 700}x{k}" for k in range(6000))
    more = [(None, one[1], "en", "web-1", 5), (None, None, None, None, None), (None, "", "en", None, 0), one, (one[0], long + " end", "en", "web-9", 1), (None, long, "en", "web-9", 1), (9_000_001, None, "en", "web-1", None), (9_000_002, "", "en", "web-1", 0), (9_000_002, "", "en", "web-1", 0)]
    out = spark.createDataFrame([(*r, k, "x", "y", 0.5, 1) for k, r in enumerate([*rows, *more])], docs.schema.simpleString()[7:-1].replace(":", " ") + ", id long, kept_text string, row string, score double, c0 int")
    return out


def similar(a, b):
    x, y = ({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (spaced(ascii_lower(t)) for t in (a, b)))
    return len(x & y) >= 0.8 * len(x | y)


def test_pipeline_stages_equal_plain_versions(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = hostile(spark, d)
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    step = lambda name: spark.createDataFrame(stages[name](spark, docs, d).select(columns).collect(), docs.schema)
    text = {r.id: (r.doc_id, r.text) for r in docs.collect()}  # id numbers rows here

    kept = step("quality classifier")
    model = quality.fit_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), use=crc_bucket("doc_id", 5) != 0)

    def good(t):
        x = quality.statistics((t or "").encode(), quality._classes())
        z = model.bias + sum(w for rule, w in model.rules if all((x[k] > c) == above for k, above, c in rule))
        return 1 / (1 + math.exp(-z)) >= 0.3

    assert sorted(r.id for r in kept.collect()) == sorted(i for i, (_, t) in text.items() if good(t))
    assert len(model.rules) > 0 and any(not good(t) for _, t in text.values())

    docs = kept
    rows = [(r.id, r.doc_id, r.text) for r in docs.collect()]
    kept = step("simhash near-dedup")
    left = {r.id for r in kept.collect()}
    links = {i: i for i, _, _ in rows}

    def root(n):
        while links[n] != n:
            n = links[n]
        return n

    for x, (i, _, t) in enumerate(rows):
        for j, _, u in rows[:x]:
            if similar(t, u):
                links[root(i)] = root(j)
    times = collections.Counter(k for _, k, _ in rows)
    for group in {root(i) for i in links}:
        own = [i for i in links if root(i) == group]
        stay = [i for i in own if i in left]
        assert len(stay) == 1
        named = [text[i][0] for i in own if text[i][0] is not None]
        assert not named or times[min(named)] > 1 or text[stay[0]][0] == min(named)

    docs = kept
    rows = [(r.id, r.doc_id, r.text) for r in docs.collect()]
    kept = step("substring dedup")
    seen, want = set(), collections.Counter()
    for _, k, t in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, (r[2] or "").encode())):
        w = spaced(t)
        gone = [False] * len(w)
        for x in range(len(w) - 19):
            part = tuple(w[x : x + 20])
            if part in seen:
                gone[x : x + 20] = [True] * 20
            seen.add(part)
        if not any(gone):
            want[k, t] += 1
        elif not all(gone):
            want[k, " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.n_chars is not None and r.text != text[r.id][1])

    docs = kept
    items = [alnum(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    windows = {" ".join(v[x : x + 10]) for v in items for x in range(max(1, len(v) - 9)) if v}
    clean = lambda t: not any(f" {x} " in f" {' '.join(alnum(t))} " for x in windows)
    rows = [(r.id, r.text) for r in docs.collect()]
    kept = step("benchmark decontamination")
    assert sorted(r.id for r in kept.collect()) == sorted(i for i, t in rows if clean(t))

    docs = kept
    mixed = stages["mixing to target weights"](spark, docs, d)
    assert sorted(r.mix_position for r in mixed.collect()) == list(range(docs.count())) and mixed.columns[: len(columns)] == columns
    docs = docs.limit(0)
    assert all(stage(spark, docs, d).count() == 0 for stage in stages.values())


def test_operators_on_empty_tables_and_repeated_rows(spark):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (None, None), (2, ""), (3, "x" * 50_000 + " y" * 50_000)]
    docs, none = frame(spark, rows), frame(spark, rows).limit(0)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    toxic, rules = toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels)
    items = spark.createDataFrame([(1, "beta gamma"), (1, "beta gamma"), (2, None)], "item_id long, text string")
    for run in (lambda t: toxicity.score_toxicity(t, toxic), lambda t: quality.score_quality(t, rules), lambda t: decontam.find_contamination(t, items), lambda t: substring.dedup_substrings(t), lambda t: webp.read_media(webp.store_texts(t), pixels=False)):
        got = run(docs).collect()
        assert run(none).count() == 0 and len(got) == len(rows)
        same = [tuple(map(str, r)) for r in got if r.id == 1]
        assert same[0] == same[1] or "n_removed" in got[0].__fields__
    assert toxicity.fit_toxicity(none, labels.limit(0)).cuts is not None
    folder = shared_dir(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, folder, *warc.write_archive(pages, folder)).count() == 0


def test_ordinal_grades_follow_a_plain_likelihood():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 50, 12)).astype(np.int32) for _ in range(600)]
    grade = np.array([min(3, int(np.isin([1, 2, 3], x).sum())) for x in parts])
    m = toxicity.fit_ordinal(parts, grade, 4, penalty=1e-4, steps=400)

    def loss(w, cuts):
        total = 0.0
        for x, g in zip(parts, grade, strict=True):
            above = [1.0, *(1 / (1 + math.exp(c - sum(w[f] for f in x))) for c in cuts), 0.0]
            total -= math.log(max(1e-12, above[g] - above[g + 1]))
        return total / len(parts)

    w = m.weights.astype(float)
    best = loss(w, m.cuts)
    assert best < 0.6 * loss(np.zeros_like(w), m.cuts) and min(w[1], w[2], w[3]) > 5 * np.abs(np.delete(w[:50], [1, 2, 3])).mean()
    for f in (1, 2, 3):
        for e in (-0.5, 0.5):
            other = w.copy()
            other[f] += e
            assert loss(other, m.cuts) > best - 0.03
