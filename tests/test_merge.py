import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lexispark.operators.merge import Table, latest, upserted

SCHEMA = "k bigint, g string, v string"


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}", "t", SCHEMA, ("k",), buckets=8)


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_eight_parallel_writers_lose_nothing(spark, table):
    table.merge(rows(spark, (0, "a", "start")))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: table.merge(rows(spark, *[(k, "a", f"w{i}") for k in (0, 100 + i, 200 + i)])), range(8)))
    got = content(table.read())
    assert [k for k, _, _ in got] == [0, *range(100, 108), *range(200, 208)]
    assert got[0][2] in {f"w{i}" for i in range(8)}
    assert table.versions() == list(range(1, 10))


def test_writers_of_other_buckets_do_not_merge_again(spark, table, monkeypatch):
    table.merge(rows(spark, *[(k, "a", "x") for k in range(40)]))
    by_bucket = {r["b"]: r["k"] for r in table.read().select("k", table.bucket().alias("b")).collect()}
    one, other = list(by_bucket.values())[:2]
    late = Table(spark, table.path.rpartition("/")[0], "t", SCHEMA, ("k",), buckets=8)
    real, calls = late.manifest, []

    def overtaken(number=None):
        found = real(number)
        if number is None and not calls:
            calls.append(table.merge(rows(spark, (other, "a", "first"))))
        return found

    monkeypatch.setattr(late, "manifest", overtaken)
    written = []
    monkeypatch.setattr(late, "_write", lambda *a, w=late._write: written.append(1) or w(*a))
    late.merge(rows(spark, (one, "a", "second")))
    got = dict((k, v) for k, _, v in content(table.read()))
    assert got[one] == "second" and got[other] == "first" and len(written) == 2  # the stage and one bucket


def test_a_reader_survives_ten_merges(spark, table):
    table.merge(rows(spark, *[(k, "a", "old") for k in range(50)]))
    before = table.read()
    for i in range(10):
        table.merge(rows(spark, *[(k, "a", f"v{i}") for k in range(50)]))
    table.vacuum()
    assert {v for _, _, v in content(before)} == {"old"}
    assert {v for _, _, v in content(table.read())} == {"v9"}


def test_vacuum_spares_pins_and_the_latest(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}", "t", SCHEMA, ("k",), buckets=2, keep=2)
    t.overwrite(rows(spark, (1, "a", "pinned")))
    with t.pinned() as held:
        for i in range(4):
            t.overwrite(rows(spark, (1, "a", str(i))))
        assert t.vacuum(hours=168) == []
        assert len(t.vacuum(hours=-1)) >= 2 and content(held) == [(1, "a", "pinned")]
        assert t.versions() == [1, 4, 5]
    t.vacuum(hours=-1)
    assert t.versions() == [4, 5] and content(t.read()) == [(1, "a", "3")]


def test_a_merge_of_one_key_writes_one_bucket(spark, table):
    table.merge(rows(spark, *[(k, "a", "x") for k in range(400)]))
    before = table.manifest()
    table.merge(rows(spark, (7, "a", "new")))
    after = table.manifest()
    changed = [b for b in after.files if after.files[b] != before.files[b]]
    assert len(changed) == 1 and len(before.files) == 8
    assert content(table.changes(before.number)) == [(7, "a", "new", True), (7, "a", "x", False)]
    assert len(table.changes(before.number).inputFiles()) <= 2


def test_a_lookup_opens_one_file(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}", "t", SCHEMA, ("k",), buckets=250)
    t.overwrite(spark.range(5000).selectExpr("id AS k", "'a' AS g", "CAST(id AS STRING) AS v"))
    assert len(t.read().inputFiles()) == 250
    found = t.lookup([(4711,)])
    assert content(found) == [(4711, "a", "4711")] and len(found.inputFiles()) == 1
    assert content(t.lookup([(1,), (99_999,)])) == [(1, "a", "1")]
    assert t.lookup([(-1,)]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_dictionary(spark, table, seed):
    rng, want = random.Random(seed), {}
    for _ in range(6):
        new = {rng.randrange(30): (rng.choice("ab"), str(rng.random())) for _ in range(rng.randrange(12))}
        kind = rng.choice(["merge", "replace", "delete", "overwrite"])
        df = rows(spark, *[(k, *v) for k, v in new.items()])
        if kind == "merge":
            gone = rng.sample(range(30), 5)
            table.merge(df, gone=spark.createDataFrame([(k,) for k in gone], "k int"))
            want = {k: v for k, v in want.items() if k not in gone} | new
        elif kind == "replace":
            table.replace(df, ["g"])
            doomed = {g for g, _ in new.values()}
            want = {k: v for k, v in want.items() if v[0] not in doomed} | new
        elif kind == "delete":
            table.delete(df)
            want = {k: v for k, v in want.items() if k not in new}
        else:
            table.overwrite(df)
            want = new
        assert content(table.read()) == sorted(((k, *v) for k, v in want.items()), key=str)


def test_keys_may_be_null_and_repeat(spark, table):
    table.merge(rows(spark, (None, "a", "1"), (None, "a", "2"), (3, None, None), (3, "b", "z")), order="v")
    assert content(latest(table.read(), ["k"])) == content(table.read()) and table.read().count() == 2
    table.merge(rows(spark, (None, "c", "9")))
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(None, "9"), (3, "z")}
    assert table.read(1).count() == 2 and table.merge(table.empty()) == 2
    assert upserted(rows(spark, (1, "a", "x")), rows(spark, (1, "a", "y"), (2, "b", "z")), ["k"]).count() == 2


def test_append_and_compact(spark, table):
    for i in range(3):
        table.append(rows(spark, *[(k, "a", str(i)) for k in range(20)]), meta=lambda m, i=i: m.meta | {"n": i})
    assert table.read().count() == 60 and max(len(f) for f in table.manifest().files.values()) == 3
    assert table.manifest().meta == {"n": 2}
    table.compact()
    assert table.read().count() == 60 and {len(f) for f in table.manifest().files.values()} == {1}


def test_an_older_series_is_brought_up_to_date(spark, tmp_path):
    root = f"file://{tmp_path}"
    old = Table(spark, root, "t", "k bigint, v string", ("k",), version=2)
    old.merge(spark.createDataFrame([(1, "x"), (2, "y")], "k bigint, v string"))
    new = Table(spark, root, "t", "k bigint, g string, v string, extra int", ("k",), version=4, migrations={2: lambda d: d.withColumn("g", F.lit("two")), 3: lambda d: d.withColumn("v", F.upper("v"))})
    with ThreadPoolExecutor(4) as pool:
        assert all(content(x) == [(1, "two", "X", None), (2, "two", "Y", None)] for x in pool.map(lambda _: new.read(), range(4)))
    assert new.versions() == [1] and new.manifest().meta == {"migrated_from": 2}
    assert old.read().count() == 2


def test_the_first_layout_is_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    for n in (1, 2):
        spark.range(n).selectExpr("id AS k", "'a' AS g", "'x' AS v").coalesce(1).write.parquet(f"{root}/t/s3-v{n:06d}")
    os.makedirs(f"{tmp_path}/t/s3-v000003")
    assert Table(spark, root, "t", SCHEMA, ("k",)).read().count() == 2
