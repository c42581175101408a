"""License scans by ordered signature rules; DataFrame functions only.

A rule (license_rules.py) is a regular expression over a text's words, lower-cased and joined by
spaces, with a label, a priority and a word that each of its matches holds. A text is looked at only
if it holds a stem that every rule needs, and a rule runs only if its word occurs. Of overlapping
detections, one that lies within another of the same or a better priority is suppressed; of equal
intervals the first rule's stays. All steps take time in proportion to a text and its matches: a rule
marks its matches in the text, words are numbered once, and suppression is one pass over the sorted
detections in runs of RUN, so that no list is copied for each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .license_rules import rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every text in which a rule can match holds one of these (lower-cased).
STEMS = ("licen", "spdx", "copyright", "domain", "reserved", "redistribution", "warrant", "permission", "misrepresented", "copying", "software", "library", "permitted", "bitstream", "charityware", "cddl", "jpeg", "libpng", "lppl", "mpl")
#: Score of a detection by its priority: tag, grant with version, grant, name, hint.
SCORES = (1.0, 0.95, 0.85, 0.6, 0.3)
RUN = 256

BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
KIND = "ARRAY<STRUCT<start: INT, neg: INT, priority: INT, ord: INT, stop: INT, label: STRING>>"


def _table(some: list[tuple[int, int, str, str]]) -> Column:
    return F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(i).alias("ord"), F.lit(rx).alias("rx"), F.lit(label).alias("label")) for i, p, rx, label in some))


def _spans(run: str) -> str:
    """SQL: a struct for each match of each of the rules run in norm. Matches are put between bytes 1 and 2, which norm can't hold."""
    ends = lambda test, at: f"filter(transform(w, (x, i) -> IF({test}, {at}, NULL)), i -> i IS NOT NULL)"
    starts, stops = ends("startswith(x, '\\u0001')", "i - 1"), ends("endswith(x, '\\u0002')", "i")
    return f"""flatten(transform({run}, r -> flatten(transform(
        filter(array(regexp_replace(norm, r.rx, '\\u0001$0\\u0002')), x -> octet_length(x) > octet_length(norm)),
        x -> transform(array(split(x, ' ', -1)), w ->
          zip_with({starts}, {stops}, (a, b) -> named_struct('start', a, 'neg', -b, 'priority', r.priority, 'ord', r.ord, 'stop', b, 'label', r.label)))[0]))))"""


def _kept() -> str:
    """SQL: of the sorted detections those that no earlier one of the same or a better priority reaches beyond."""
    empty = f"CAST(array() AS {KIND})"
    return f"""aggregate(sequence(0, (size(found) - 1) DIV {RUN}),
        named_struct('m', array(-1, -1, -1, -1, -1), 'out', CAST(array() AS ARRAY<{KIND}>)),
        (a, k) -> transform(array(aggregate(slice(found, k * {RUN} + 1, {RUN}),
            named_struct('m', a.m, 'kept', {empty}),
            (b, d) -> named_struct(
              'm', transform(b.m, (x, i) -> IF(i = d.priority, greatest(x, d.stop), x)),
              'kept', IF(exists(slice(b.m, 1, d.priority + 1), x -> x >= d.stop), b.kept, concat(b.kept, array(d)))))),
          r -> named_struct('m', r.m, 'out', concat(a.out, array(r.kept))))[0],
        a -> flatten(a.out))"""


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, detections, base_labels, labels, score) for each row of docs.

    Words are runs of ASCII letters and digits, lower-cased, and of other than ASCII characters. base
    are the places of BASE's phrases, detections the rules' that are left (structs of start, stop, in
    words from 0, priority, label); labels, distinct and sorted, are of both, base_labels of the former.
    score is that of the best detection, of names for base places, else 0. A rule's matches don't
    overlap each other; its next starts after the last. Null and empty texts have no words; repeated
    rows are kept; an empty table gives no rows. Extra columns are ignored.
    """
    every = [(i, p, words, rx, label) for i, (p, words, rx, label) in enumerate(rules())]
    by_word: dict[str, list] = {}
    for i, p, words, rx, label in every:
        by_word.setdefault("license" if "licence" in words else words[0], []).append((i, p, rx, label))
    lookup = F.create_map(*(x for w, some in by_word.items() for x in (F.lit(w), _table(some))))
    base_rules = _table([(-1, 3, f"(?<= ){phrase}(?= )", label) for label, phrase in BASE])

    text = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    gate: Column = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains(F.col("low"), F.lit(stem))
    gated = text.withColumn("low", F.lower("text")).select("id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(gate, F.col("text")).alias("text"))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.col("text")), SEPARATORS, " ")), F.lit(" "))
    found = gated.select("id", "n_words", F.when(F.col("text").isNotNull(), norm).alias("norm"))
    present = F.array_intersect(F.split(F.replace("norm", F.lit(" licence "), F.lit(" license ")), " "), F.array(*(F.lit(w) for w in by_word)))
    found = found.withColumn("run", F.when(F.col("norm").isNotNull(), F.flatten(F.transform(present, lambda w: F.element_at(lookup, w)))))
    found = found.withColumn("bases", F.when(F.col("norm").isNotNull(), base_rules))
    spans = lambda c: F.coalesce(F.expr(_spans(c)), F.expr(f"CAST(array() AS {KIND})"))
    found = found.select("id", "n_words", spans("bases").alias("base"), F.array_sort(spans("run")).alias("found"))
    found = found.select("id", "n_words", "base", F.expr(f"IF(size(found) < 2, found, {_kept()})").alias("kept"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.aggregate(F.concat("kept", "base"), F.lit(0.0), lambda a, d: F.greatest(a, F.element_at(F.array(*(F.lit(x) for x in SCORES)), d["priority"] + 1)))
    plain = lambda c: F.transform(c, lambda d: F.struct(d["start"].alias("start"), d["stop"].alias("stop"), d["priority"].alias("priority"), d["label"].alias("label")))
    return found.select("id", "n_words", plain("base").alias("base"), plain("kept").alias("detections"), labels(F.col("base.label")).alias("base_labels"), labels(F.concat("base.label", "kept.label")).alias("labels"), best.alias("score"))
