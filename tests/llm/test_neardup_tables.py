"""Near-dedup and components write few tables, and those of few rows in few files, so a small job with many partitions is no long one."""

import os

from plait.llm import neardup
from plait.plans import staging
from plait.plans.components import connected_components
from tests.llm.test_neardup import brute_kept, made


def counted(monkeypatch):
    """The labels of the tables written, and how many files with rows each had."""
    seen, old = [], staging.stage_at

    def stage_at(df, label):
        out, path = old(df, label)
        files = [f for f in os.listdir(path.removeprefix("file://")) if f.endswith(".parquet")]
        seen.append((label, len(files)))
        return out, path

    monkeypatch.setattr(staging, "stage_at", stage_at)
    monkeypatch.setattr("plait.plans.components.stage_at", stage_at, raising=False)
    return seen


def test_stars_are_left_alone_and_a_chain_takes_few_rounds(spark, monkeypatch):
    seen = counted(monkeypatch)
    star = spark.range(1, 200).selectExpr("id as a", "id % 3 - 3 as b")
    roots = {r.node: r.root for r in connected_components(star).collect()}
    assert roots == {i: i % 3 - 3 for i in range(1, 200)} | {-3: -3, -2: -2, -1: -1}
    assert len(seen) == 1
    seen.clear()
    chain = spark.range(1, 33).selectExpr("id as a", "id - 1 as b")
    assert {r.root for r in connected_components(chain).collect()} == {0}
    assert len(seen) % 2 and all(files == 1 for _, files in seen[1:]), seen


def test_tables_of_the_stage(spark, docs, monkeypatch):
    rows, seen = made(), counted(monkeypatch)
    assert sorted(r.doc_id for r in neardup.keep_one(docs(rows), crowd=8).collect()) == brute_kept(rows)
    labels = [label for label, _ in seen]
    assert len(labels) < 70, labels
    assert labels.count("likely") == 5 and not {"wanted", "more", "named", "least", "components"} & set(labels)
