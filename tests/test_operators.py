"""Operators on small literal tables."""

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from brindle.functions import scalars as S
from brindle.operators import features, history, metrics, models, trees
from brindle.plans import workflow
from brindle.sources import files
from pyspark.sql import functions as F


def test_history_leaves_the_own_display_out(spark):
    rows = spark.createDataFrame([(1, "u", 7, 1), (1, "u", 7, 0), (2, "u", 7, -1), (3, "u", 7, 1), (3, "w", 7, 0)], "display_id long, uid string, ad_id long, label long")
    got = {(r.display_id, r.uid, r.label): (r.x_past_views, r.x_past_clicks, r.x_past_all_views, r.x_future_views, r.x_future_clicks, r.x_future_all_views) for r in history.past_future(rows, ["uid", "ad_id"], "x").collect()}
    assert got[1, "u", 1] == (0, 0, 0, 1, 1, 2)
    assert got[2, "u", -1] == (2, 1, 2, 1, 1, 1)
    assert got[3, "u", 1] == (2, 1, 3, 0, 0, 0)
    assert got[3, "w", 0] == (0,) * 6


def test_one_hour_after_is_strict(spark):
    shown = spark.createDataFrame([(1, 1000)], "uid long, ts long")
    views = spark.createDataFrame([(1, 10, 1000), (1, 11, 1001), (1, 12, 1000 + 3_599_999), (1, 13, 1000 + 3_600_000), (2, 14, 1500)], "uid long, document_id long, ts long")
    assert [tuple(r) for r in features.one_hour_after(shown, views).collect()] == [(1, 1000, "11 12")]


def test_metrics_with_ties_and_without_positive(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 0), (1, 2, 0.5, 1), (2, 3, 0.9, 0), *((3, k, 1.0 - k / 100, int(k == 12)) for k in range(13))], "display_id long, ad_id long, pred double, clicked int")
    assert metrics.map12(rows, ["ad_id"]).first()["map12"] == 0.25
    assert metrics.map12_pessimistic(rows, ["ad_id"]).first()["map12"] == round(0.5 / 3, 6)
    assert len(metrics.submission(rows, ["ad_id"]).where("display_id = 3").first()["ad_ids"].split()) == 12


def test_mix_equals_a_plain_model(spark):
    def plain(a):
        m = 2**32
        a = (a ^ 61) ^ (a >> 16)
        a = (a + (a << 3)) % m
        a ^= a >> 4
        a = a * 0x27D4EB2D % m
        return a ^ (a >> 15)

    values = [0, 1, 61, 2**31, 2**32 - 1, 123456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "a long").select(S.mix32(F.col("a"))).collect()]
    assert got == [plain(v) for v in values]


def test_similarity_of_overlapping_disjoint_and_missing(spark):
    notes = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 2, 0.4), (2, 3, 1.0), (3, 9, 1.0)], "document_id long, id long, conf double")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    got = {r.b: (r.x_product, r.x_jaccard) for r in features.similarity(pairs, notes, "a", "b", "x").collect()}
    assert got == {2: (0.2, round(1 / 3, 6)), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_models_learn_a_single_feature(spark):
    rows = [(i, i % 2, [{"field": 0, "index": i % 2, "value": 1.0}, {"field": 1, "index": 5, "value": 1.0}]) for i in range(1600)]
    df = spark.createDataFrame(rows, "i long, label long, features array<struct<field: int, index: long, value: double>>")
    for kind in ("ftrl", "ffm", "ffm_nn", "nn"):
        means = {r.label: r.p for r in models.predict(models.fit(df, kind, epochs=3, parts=2), df).groupBy("label").agg(F.avg("pred").alias("p")).collect()}
        assert means[1] > means[0], kind


def test_models_with_bags_and_restricted_pairs(spark):
    rows = [(i, i % 2, [{"field": 0, "index": i % 2, "value": 1.0}, {"field": 31, "index": 5, "value": 1.0}, {"field": 3, "index": 6, "value": 1.0}]) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, label long, features array<struct<field: int, index: long, value: double>>")
    bags = [models.fit(df, "ffm", epochs=2, parts=2, seed=s, restricted=True) for s in (1, 2)]
    one, other, both, scored = ([r.pred for r in models.predict_bags(b, df, by_score=t).orderBy("i").limit(2).collect()] for b, t in ((bags[:1], False), (bags[1:], False), (bags, False), (bags, True)))
    assert all(abs((a + b) / 2 - c) < 1e-9 for a, b, c in zip(one, other, both, strict=True)) and scored[1] > scored[0]


def test_model_losses_fall_and_ftrl_equals_plain_steps(spark):
    rows = [(i, i % 2, [{"field": 0, "index": i % 2, "value": 1.0}, {"field": 1, "index": i % 7, "value": 0.5}]) for i in range(300)] + [(999, -1, [{"field": 0, "index": 1, "value": 1.0}])]
    df = spark.createDataFrame(rows, "i long, label long, features array<struct<field: int, index: long, value: double>>")
    for kind in ("ftrl", "ffm", "ffm_nn", "nn"):
        p = models.fit(df, kind, epochs=3, bits=8, k=4, parts=1, val=df)
        assert len(p.losses) == 3 and p.losses[-1][0] < p.losses[0][0] and p.losses[-1][1] < 0.7, kind
    order = df.where("label >= 0").select("label", "features", F.xxhash64("features", "label", F.lit(2017), F.lit(0)).alias("h")).orderBy("h").collect()
    z, n, slot = {}, {}, lambda f: ((f["index"] * 0x9E3779B1 + f["field"] * 0x85EBCA6B) >> 7) % 256
    weight = lambda j: 0.0 if abs(z.get(j, 0)) < 2e-4 else ((1 if z[j] > 0 else -1) * 2e-4 - z[j]) / ((2.0 + n[j] ** 0.5) / 1.0 + 5e-4)
    for r in order:
        t = sum(weight(slot(f)) * f["value"] for f in r.features)
        g = 1 / (1 + math.exp(-t)) - r.label
        for j, v, w in [(slot(f), f["value"], weight(slot(f))) for f in r.features]:
            old = n.get(j, 0.0)
            n[j] = old + (g * v) ** 2
            z[j] = z.get(j, 0.0) + g * v - (n[j] ** 0.5 - old**0.5) * w
    p = models.fit(df, "ftrl", bits=8, parts=1)
    assert all(abs(p.arrays["z"][j] - z[j]) < 1e-3 and abs(p.arrays["n"][j] - n[j]) < 1e-3 for j in z)


def test_strict_join_names_a_missing_key(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert {(r.k, r.v) for r in features.strict_join(spark.createDataFrame([(1,), (2,), (1,)], "k long"), table, "k").collect()} == {(1, "a"), (2, "b")}
    for missing in (3, None):
        with pytest.raises(Exception, match="no row for k"):
            features.strict_join(spark.createDataFrame([(1,), (missing,)], "k long"), table, "k").collect()


DUMP = """booster[0]:
0:[time<5.5] yes=1,no=2,missing=1,gain=10,cover=100
1:[ad<2] yes=3,no=4,missing=3,gain=4,cover=40
3:leaf=0.1,cover=10
4:leaf=0.2,cover=30
2:leaf=-0.1,cover=60
booster[1]:
0:[ad<7] yes=1,no=2,missing=1,gain=3,cover=50
1:leaf=0.5,cover=20
2:[time<8] yes=3,no=4,missing=3,gain=2,cover=30
3:leaf=0.1,cover=15
4:leaf=0.2,cover=15
"""


def test_tree_dumps(spark, tmp_path):
    (tmp_path / "m.dump").write_text(DUMP)
    found = trees.read_dump(spark, f"file://{tmp_path}/m.dump")
    free = {r.feature: (round(r.fscore, 6), round(r.gain, 6)) for r in trees.importances(found).collect()}
    assert free == {"time": (1.6, 11.2), "ad": (1.4, 4.6)}
    held = {(r.value, r.feature): (r.fscore, r.gain) for r in trees.importances(found, "time", [1.0, 6.0]).collect()}
    assert held == {(1.0, "ad"): (2.0, 7.0), (6.0, "ad"): (1.0, 3.0)}
    assert {(r.value, r.n) for r in trees.split_values(found, "time").collect()} == {(5.5, 1), (8.0, 1)}
    grid = trees.value_grid(found, "time")
    assert (len(grid), grid[0], grid[-1]) == (200, 4.5, 9.0)
    with pytest.raises(ValueError):
        trees.parse("0:[a<1] yes=1,no=2,missing=1,gain=1,cover=2")


def test_files(spark, tmp_path):
    import zipfile

    body = "display_id,uuid,document_id,timestamp,platform,geo_location\n1,a,5,61,\\N,US>CA>807\n2,b,6,62,2,\n"
    with zipfile.ZipFile(tmp_path / "events.csv.zip", "w") as z:
        z.writestr("events.csv", body)
    got = [tuple(r) for r in files.read_zip_csv(spark, f"file://{tmp_path}/events.csv.zip", "events").orderBy("display_id").collect()]
    assert got == [(1, "a", 5, 61, None, "US>CA>807"), (2, "b", 6, 62, "2", None)]
    files.write_csv(spark.createDataFrame(got, files.SCHEMAS["events"]), f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/out", "events").collect()) == got
    rows = spark.createDataFrame([(1, 10, 3), (1, 11, 1), (2, 12, 2)], "k long, v long, n long")
    assert {r.k: r.v for r in files.unique_by(rows, "k", "n").collect()} == {1: 11, 2: 12}
    assert {r.k: r.v for r in files.unique_by(rows, "k", "n", last=True).collect()} == {1: 10, 2: 12}
    assert {r.k: [x.v for x in r["items"]] for r in files.sorted_lists(rows, "k", ["v"]).collect()} == {1: [10, 11], 2: [12]}
    assert {r.k: r.x for r in files.lookup(rows.select("k").distinct(), spark.createDataFrame([(1, 9)], "k long, x long"), "k", {"x": 0}).collect()} == {1: 9, 2: 0}
    files.write_sparse(rows.withColumnRenamed("n", "n_features"), f"file://{tmp_path}/sparse", ["k", "v"])
    assert [(r.v, r.offset) for r in files.read_sparse(spark, f"file://{tmp_path}/sparse", 1, 5).orderBy("offset").collect()] == [(11, 3), (12, 4)]


def test_training_workflow_skips_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([(d, a, int(a == 1), int(a == 1), d * 10) for d in range(6) for a in range(3)], "display_id long, ad_id long, label long, clicked long, ts long")
    calls = []

    def predict(train, test):
        calls.append(1)
        return metrics.with_ad_mean(test)

    splits = {"cv2": lambda: (rows, rows), "full": lambda: (rows, rows)}
    for _ in range(2):
        scores = workflow.train_model(spark, "m", f"file://{tmp_path}", splits, predict, ["display_id", "ad_id"], ["ad_id"], 30)
        assert scores == {"cv2": {"present": 1.0, "future": 1.0, "total": 1.0}}
    assert len(calls) == 2
    assert {r.ad_ids for r in spark.read.csv(f"file://{tmp_path}/subm/m", header=True).collect()} == {"1 0 2"}
