"""File sources/sinks: training CSV (header, declared schema), the model's life, append."""

from __future__ import annotations

import pytest

from centwise.operators import categorize as cat
from centwise.operators import model_store as store
from centwise.sources import files


SEED = [("grocery shopping and snacks", "Food"), ("uber ride", "Transport"), ("electricity bill", "Bills"),
        ("electricity bill", "Bills"), ("bus ticket, return", "Transport"), ('the "big" dinner', "Food")]
OWN = [("grocery delivery", "Food"), ("uber ride", "Transport"), ("water bill", "Bills"), ("cinema night", "Fun"), (None, "Fun")]


def tables(model):
    return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect())
            for t in (model.vocab, model.prior, model.term)]


def test_training_csv(spark, tmp_path):
    csv_path = tmp_path / "seed.csv"
    csv_path.write_text('description,category\n"bus ticket, return",Transport\nuber ride,Transport\n')
    seed = files.read_training_csv(spark, str(csv_path))
    assert [tuple(r) for r in seed.collect()] == [("bus ticket, return", "Transport"), ("uber ride", "Transport")]


def test_model_retrained_by_batches_equals_one_training(spark, tmp_path):
    path = str(tmp_path / "model")
    frame = lambda rows: spark.createDataFrame(rows, "description string, category string")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.add_rows(spark, path, cat.training_frame(frame(SEED), None), 1)
    assert store.is_stale(spark, path)
    first = store.load_or_retrain(spark, path)
    assert {r.category: r.doc_count for r in first.prior.collect()} == {"Food": 2, "Transport": 2, "Bills": 1}
    assert not store.is_stale(spark, path) and store.current(spark, path) == 1
    before = tables(first)
    for _ in range(2):                                     # the delivery is repeated
        store.add_rows(spark, path, cat.training_frame(None, frame(OWN)), 2)
    # a retraining that dies between two tables: readers go on with the version there is
    cat.save(cat.fit(spark, store.batches.read_batches(spark, f"{path}/terms", store.TERMS)), f"{path}/v=2")
    assert store.is_stale(spark, path) and tables(store.load(spark, path)) == before
    second = store.load_or_retrain(spark, path)
    assert store.current(spark, path) == 2
    whole = cat.train(spark, cat.training_frame(frame(SEED), frame(OWN)))
    assert tables(second) == tables(whole) and tables(first) == before
    store.add_rows(spark, path, frame([("gym", "Health")]), 3)
    store.retrain(spark, path)
    store.forget(spark, path)
    assert store.batches.complete(spark, path, "v") == [2, 3]


def test_append_transactions(spark, demo_tx, tmp_path):
    path = str(tmp_path / "tx")
    files.append_transactions(demo_tx.limit(3), path)
    files.append_transactions(demo_tx.limit(2), path)
    assert spark.read.parquet(path).count() == 5
