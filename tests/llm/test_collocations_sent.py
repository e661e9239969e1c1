import random

import numpy as np

from plait.llm import collocations
from plait.plans.staging import Scratch


def test_a_task_sends_a_sum_once():
    """Chunks of a task are added up before they are sent: what all have in common is not sent for each."""
    sums, held, sent = np.arange(1000), [], []
    for _ in range(50):
        held.append((sums, np.ones(1000, np.int64)))
        sent += collocations._added_up(held, collocations._sums)
    whole = collocations._sums(*map(np.concatenate, zip(*held)))
    assert not sent and whole[0].tolist() == sums.tolist() and set(whole[1].tolist()) == {50}


def test_arrays_as_planes():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    parts = [rng.integers(-(2**60), 2**60, n) for n in (1, 7, 300)]
    column = pa.chunked_array([pa.array([collocations._planes(x) for x in parts], pa.binary())])
    assert collocations._numbers(column, [1, 7, 300], np.int64).tolist() == np.concatenate(parts).tolist()


def test_counts_come_from_one_pass(spark, monkeypatch):
    """Blocks of frequent phrases are few where candidates are many and light."""
    monkeypatch.setattr(collocations, "BLOCK", 20)
    made, init = [], collocations.Block.__init__
    monkeypatch.setattr(collocations.Block, "__init__", lambda *a: made.append(1) or init(*a))
    monkeypatch.setattr(collocations, "BITS", 16)
    monkeypatch.setattr(collocations, "RANGE", 50)
    r = random.Random(1)
    rows = [(" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) + " the end", "en") for _ in range(40)]
    with Scratch(spark) as scratch:
        phrases, _ = collocations.counted(spark.createDataFrame(rows, "text string, lang string"), scratch, 30)
        assert [r.f[0] for r in phrases.where("phrase = 'the end'").collect()] == [40]
    assert len(made) <= 4
