import random

import pytest

from lexispark.operators import diff
from lexispark.operators.snapshots import Snapshot, changed, differing_leaves

SCHEMA = "doc_id long, content_hash string, title string"


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pair(spark, tmp_path, before, after, leaves):
    frames = [spark.createDataFrame([(k, *v) for k, v in d.items()], SCHEMA) for d in (before, after)]
    return frames, [Snapshot.write(f, f"file://{tmp_path}/{i}", leaves) for i, f in enumerate(frames)]


@pytest.mark.parametrize(("leaves", "changes"), [(1, 3), (7, 2), (64, 0), (300, 12)])
def test_equals_the_full_join(spark, tmp_path, leaves, changes):
    rng = random.Random(leaves)
    before = {k: (rng.choice([None, str(rng.random())]), f"t{k}") for k in range(200)}
    after = dict(before)
    for k in rng.sample(range(200), changes):
        match k % 3:
            case 0:
                after[k] = ("changed", "new title")
            case 1:
                del after[k]
            case 2:
                after[1000 + k] = (None, f"t{k}")
    frames, stored = pair(spark, tmp_path, before, after, leaves)
    assert content(changed(*stored)) == content(diff.changes(*frames).filter("status <> 'same'"))


def test_one_percent_reads_few_leaves(spark, tmp_path):
    before = {k: (str(k), "t") for k in range(1000)}
    after = before | {k: ("x", "t") for k in range(0, 1000, 100)}
    _, (a, b) = pair(spark, tmp_path, before, after, 256)
    leaves = differing_leaves(a, b)
    assert 0 < len(leaves) <= 10
    read = changed(a, b)
    assert read.count() == 10
    for part in (a, b):
        plan = part.rows(leaves)._jdf.queryExecution().optimizedPlan().toString()
        opened = {r[0] for r in part.rows(leaves).selectExpr("input_file_name()").distinct().collect()}
        assert "leaf" in plan and len(opened) <= len(leaves) < 0.1 * len(part.rows().inputFiles())


def test_empty_and_unequal(spark, tmp_path):
    _, (a, b) = pair(spark, tmp_path, {}, {1: ("h", "t")}, 16)
    assert content(changed(a, b)) == [(1, "new", "t")] and content(changed(b, a)) == [(1, "orphaned", "t")] and content(changed(a, a)) == []
    with pytest.raises(ValueError):
        differing_leaves(a, Snapshot.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/c", 1))
