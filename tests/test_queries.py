"""Queries against their SQL on the smallest tables, the matching plan's shape, and resumable batches."""

import math
import os
import time

import duckdb
import pytest

from kinlink.config import Config
from kinlink.operators import blocking, model, similarity
from kinlink.plans import queries
from kinlink.plans.matching import features_of, sliced_features
from kinlink.plans.queries import QUERIES, SQL, Derived
from kinlink.streaming.incremental import match_arrivals

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["prepared_records", "number_tokens", "validated_lists", "blocking_keys", "candidate_pairs", "token_features", "ranked_candidates", "pair_features", "context_features", "match_lists", "threshold_grid", "miss_classes"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    answer = db.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    wanted = sorted(str([plain(v) for v in r]) for r in answer.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == wanted


def test_no_cartesian_product_and_pruned_scans(spark):
    for name in ("pair_counts", "match_lists", "threshold_grid"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert "n_chars" not in plan and "source" not in plan.split("ReadSchema")[1][:80]


def test_batches_resume(spark, tmp_path):
    d = Derived(spark, DATA)
    s1 = d.of(d.prepared, True)
    index = d.index.persist()
    for part in range(2):
        s1.where(f"abs(hash(entity_id)) % 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        match_arrivals(
            spark, str(tmp_path / "in"), s1.schema.simpleString()[7:-1].replace(":", " "),
            lambda batch: blocking.candidate_pairs(blocking.blocking_keys(batch), index), str(tmp_path / "out"), str(tmp_path / "state"),
        ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == d.pre.count()


def test_features_are_made_in_slices_that_leave_no_shuffles(spark):
    from pathlib import Path

    local = [Path(p.getPath()) for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {p for top in local for p in top.rglob("shuffle_*.data")}

    d = Derived(spark, DATA)
    s1, others, index = d.of(d.prepared, True).persist(), d.of(d.prepared, False).persist(), d.index.persist()
    before = shuffles() if index.count() else set()
    sliced = sliced_features(s1, others, index, gold=d.gold, entities=60)
    deadline = time.time() + 20
    while (left := shuffles() - before) and time.time() < deadline:  # executors delete behind the driver's back
        time.sleep(0.2)
    assert not left and len({f.rsplit("/", 2)[-2] for f in sliced.inputFiles()}) == 1 + s1.count() // 60 > 3
    whole = similarity.label(features_of(s1, others, index), d.gold)
    assert sliced.columns == whole.columns and sorted(map(str, sliced.collect())) == sorted(map(str, whole.collect()))
    wanted = {(r.s1_id, r.cand_id) for r in d.gold.collect()}
    assert all(r.y == ((r.s1_id, r.cand_id) in wanted) for r in sliced.collect()) and sliced.where("y = 1").count()


@pytest.mark.parametrize("name", ["pair_features", "gbm_scores"])
def test_no_shuffle_of_the_pairs_of_features_is_left_to_the_caller(spark, name):
    assert "Exchange" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_gbm_scores_trains_all_configured_trees(spark, monkeypatch):
    score, seen = model.score, []
    monkeypatch.setattr(model, "score", lambda fitted, *a: seen.append(fitted.stages[-1].getNumTrees) or score(fitted, *a))
    monkeypatch.setattr(queries, "CONFIG", Config(max_trees=2))
    QUERIES["gbm_scores"](spark, DATA)
    assert seen == [2] and Config().max_trees == 600
