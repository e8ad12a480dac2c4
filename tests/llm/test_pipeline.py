from collections import Counter

import corpus_pipeline as cp
from lexispark.llm.common import documents, stored
from lexispark.llm.quality import quality_rules
from tests.llm.test_lines import brute as lines_brute
from tests.llm.test_mixing import copies
from tests.llm.test_simhash import brute as simhash_brute

D = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = documents(spark, D)
    now = {r["doc_id"]: r for r in docs.collect()}
    df = docs
    for name, stage in cp.STAGES:
        df = stored(stage(spark, df, D), "test-stage")
        out = df.collect()
        if name == "quality rules":
            keep = {r["doc_id"] for r in quality_rules(docs).collect() if r["kept"]}
            assert {r["doc_id"]: tuple(r) for r in out} == {k: (r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for k, r in now.items() if k in keep}
        elif name == "line dedup":
            want = {x[0]: x[5] for x in lines_brute([(k, r["text"]) for k, r in now.items()])}
            want = {k: t for k, t in want.items() if t.strip() or t == now[k]["text"]}
            assert {r["doc_id"]: r["text"] for r in out} == want
            assert all(r["n_chars"] == len(r["text"]) for r in out)
        elif name == "near duplicates":
            assert {r["doc_id"] for r in out} == {d for d, _, c in simhash_brute([(k, r["text"]) for k, r in now.items()]) if d == c}
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            gone = now.keys() - {r["doc_id"] for r in out}
            leaked = {k for k, r in now.items() if any(t in r["text"] for t in items)}
            assert leaked <= gone and len(gone) <= len(leaked) + 1
        else:
            n = Counter(r["source"] for r in now.values())
            want = {k: copies(k, len(now) / (len(n) * n[r["source"]])) for k, r in now.items()}
            assert Counter(r["doc_id"] for r in out) == Counter({k: v for k, v in want.items() if v})
            assert all(r["text"] == now[r["doc_id"]]["text"] for r in out)
            break
        assert tuple(df.columns) == cp.COLUMNS
        now = {r["doc_id"]: r for r in out}


def test_run(spark):
    assert cp.run(spark, D).columns == [*cp.COLUMNS, "copy", "shuffle_key"]
