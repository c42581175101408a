"""What queries shuffle, in bytes for each row of clicks: their disk grows with it."""

import random
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from brindle.operators import history, models
from brindle.plans.queries import QUERIES

D = "/root/testdata/sf0.001"
#: Bytes a row at most, with tables of over 16 kB not broadcast.
MOST = {
    "model_nn": 1000,
    "model_ftrl": 1000,
    "model_ffm_nn": 1000,
    "model_ffm": 1000,
    "sparse_range": 1000,
    "model_lr": 300,
    "export_p1": 600,
    "export_f5": 600,
    "export_f3": 600,
    "export_f1": 600,
    "dataset_offsets": 700,
    "ctr_logit_matrix": 400,
    "model_stack": 300,
    "model_mlp": 300,
    "model_gbt": 300,
    "export_vw": 400,
    "export_f4": 600,
    "export_f2": 600,
}


def _stages(spark) -> dict[int, int]:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    known = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(known)}


@pytest.mark.parametrize("name", sorted(MOST))
def test_shuffled_bytes(spark, name):
    last, old = max(_stages(spark), default=-1), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        QUERIES[name](spark, D).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = spark.read.parquet(f"{D}/lineitem.parquet").count()
    assert sum(n for k, n in _stages(spark).items() if k > last) < MOST[name] * rows


#: Bytes a row at most of exports that deal whole rows before what follows from their columns is added.
BARE = {"export_vw": 198, "export_f5": 411, "export_f4": 416, "export_f3": 414, "export_f1": 408, "export_p1": 380}


@pytest.mark.parametrize("name", sorted(BARE))
def test_whole_rows_travel_bare(spark, name, monkeypatch):
    monkeypatch.setitem(MOST, name, BARE[name])
    test_shuffled_bytes(spark, name)


def test_scores_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.integers(0, 40, n)) if n % 2 else rng.integers(0, 40, n), rng.integers(0, 256, n), rng.normal(size=n)) for n in [0, 1, 7, 30, *rng.integers(0, 60, 150)]]
    at = np.concatenate([[0], np.cumsum([len(x[0]) for x in rows])])
    flat = [np.concatenate([x[c] for x in rows]) for c in range(3)]
    for kind in ("ftrl", "ffm", "ffm_nn", "nn"):
        for restricted in (False, True):
            p = models._start(kind, 8, 4, 3)
            p.restricted = restricted
            p.arrays = {n: x + rng.normal(0, 0.1, x.shape) ** 2 for n, x in p.arrays.items()}
            want = [models._forward(p, x)[0] for x in rows]
            assert np.allclose(models._scores(p, at, *flat), want, rtol=1e-4, atol=1e-4), (kind, restricted)


def test_gradient_is_summed_in_parts():
    """Softmaxes are made for few tokens at once; sums are those of all at once."""
    from brindle.llm import lm

    rng, n, made, soft = np.random.default_rng(3), 40_000, [], lm._soft
    words = rng.integers(1, 300, n).astype(np.uint64) << np.uint64(8) | rng.integers(0, 256, n).astype(np.uint64)
    cells, rows = (words & np.uint64(255)).astype(np.int64), lm.feature_rows(words, np.arange(0, n, 500))
    model, total = lm.start_model(lm.Vocabulary(n, 300, {}, np.ones(256, np.int64), np.ones(256, np.int64))), lm._Gradient()
    lm._soft = lambda *a: made.append(a[0].shape[1]) or soft(*a)
    try:
        total.add(model, cells, rows)
    finally:
        lm._soft = soft
    assert max(made) <= lm.SCORE_PART
    p, k = soft(rows, model.w, model.bias), cells // lm.SLOTS
    assert total.seen[0].sum() == rows.size and np.allclose(total.hoped[0].sum(1), lm.FEATURES * p.sum(0, dtype=np.float64), rtol=1e-5)
    assert total.seen[0][:, 3].sum() == lm.FEATURES * (k == 3).sum()


def test_stored_leaves_no_shuffle_files(spark):
    from brindle.sources.shared import stored

    files = lambda: sum(str(f.getName()).startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    df = stored(spark.range(10_000).repartition(7, "id"))
    end = time.time() + 30
    while (left := files()) > before and time.time() < end:
        time.sleep(0.2)
    assert left <= before
    assert df.count() == 10_000


#: Bytes a row at most of queries that read rows by display before they are dealt by ad or group.
LEAN = {"model_gbt": 101, "model_lr": 74, "model_mlp": 74, "model_stack": 39, "ctr_logit_matrix": 140}


@pytest.mark.parametrize("name", sorted(LEAN))
def test_rows_are_dealt_once_by_each_key(spark, name, monkeypatch):
    monkeypatch.setitem(MOST, name, LEAN[name])
    test_shuffled_bytes(spark, name)


def test_discarded_tables_leave_the_disk(spark):
    from brindle.sources.shared import discard, stored

    df = stored(spark.range(100))
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert folder.is_dir()
    discard(df)
    assert not folder.exists()


def test_weighted_history_in_place_is_that_of_joined_rows(spark):
    """Rows without annotations, null groups and ties of displays included."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, rng.choice([1, 2, None]), rng.randrange(40), rng.choice([-1, 0, 1]), rng.randrange(6), i * 7 if i % 3 else None) for i in range(400)], "row_id long, uid long, display_id long, label long, ad_document_id long, more long")
    notes = spark.createDataFrame([(doc, (doc * 3 + k) % 5, 0.9 / (k + 1)) for doc in range(5) for k in range(3)], "document_id long, id long, conf double")
    noted = notes.groupBy("document_id").agg(F.collect_list(F.struct("id", "conf")).alias("annotations"))
    sums = history.weighted_history(rows, notes, ["uid"], ["row_id"], "w")
    want = {r.row_id: r for r in rows.join(sums, "row_id").collect()}
    got = history.with_weighted_history(rows, noted, ["uid"], ["row_id"], "w").collect()
    assert len(got) == len(want) == 400
    for r in got:
        assert r.asDict() == want[r.row_id].asDict()


def test_tasks_of_a_fit_run_side_by_side(spark, monkeypatch):
    """One job for each wave of tasks instead of one for each task; waves change no result."""
    df = spark.range(400).selectExpr("CAST(id % 2 AS BIGINT) AS label", "array(named_struct('field', CAST(id % 3 AS INT), 'index', id % 7, 'value', 1.0D)) AS features")
    tracker, sc, made = spark.sparkContext.statusTracker(), spark.sparkContext, []
    for wave in (1 << 27, 1):
        monkeypatch.setattr(models, "WAVE_BYTES", wave, raising=False)
        sc.setJobGroup(f"fit {wave}", "")
        p = models.fit(df, "ffm", bits=4, k=2, parts=12)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        made.append((len(tracker.getJobIdsForGroup(f"fit {wave}")), p))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert made[0][0] <= 6 < 12 <= made[1][0]
    assert all((x == made[1][1].arrays[n]).all() for n, x in made[0][1].arrays.items())
