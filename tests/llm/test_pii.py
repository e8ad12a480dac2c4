import hashlib
import math
import random
import re
import time
from collections import defaultdict

from lexispark.llm.common import documents
from lexispark.llm.pii import KINDS, PiiParams, find_pii, learn, redact
from lexispark.llm.queries import op2_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(ds):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0


def brute(text):
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text or ""):
            ds = [int(c) for c in m[0] if c in "0123456789"]
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 16 <= len(ds) <= 19 and luhn(ds), "phone": 8 <= len(ds) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    want = {}
    for r in documents(spark, d).select("doc_id", "text").collect():
        own = brute(r["text"])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        want[r["doc_id"]] = (*(sum(x[0] == k for x in own) for k in KINDS), hashlib.sha256(text.encode()).hexdigest(), text)
    got = {r["doc_id"]: r for r in op2_pii(spark, d).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert tuple(r)[1:6] == want[k][:5]
        assert set(want[k][5].split(",")) <= set(r["spans"].split(","))


TRICKY = [
    "a@b.com_x@d.com.e f@g", "x..@a-b.c.d, y@z", "1.2.3.4.5.6.7.8 and 256.1.1.1 or 010.000.1.255", "999.1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111111", "41111111111111111111", "1 4111  4111111111111111 2", "4111 1111 1111 1111 2",
    "+1 (415) 555-2671, +49 30 123456 78 9 +1 2 +123456789012345678", "é😀 +44 20 7946 0958 é😀 a@b.cd", "٣٤٥ 1٣.1.1.1",
]


def test_tricky_texts(spark, docs):
    got = {r["doc_id"]: sorted((KINDS[x["k"]], x["s"], x["e"]) for x in r["base"]) for r in find_pii(docs(*enumerate(TRICKY))).collect()}
    assert got == {i: sorted(brute(t)) for i, t in enumerate(TRICKY)}


def test_context_finds_unseen_identifiers(spark, docs):
    rows = [(i, f"please call me at +1 (415) 555-26{i:02d} after noon") for i in range(12)]
    rows += [(100, "please call me at 555-0199 after noon"), (101, "the flight 555-0199x left"), (102, "room 555-0199 is empty and call me at home")]
    got = {r["doc_id"]: [(KINDS[x["k"]], x["s"], x["e"]) for x in r["added"]] for r in find_pii(docs(*rows)).collect()}
    assert got[100] == [("phone", 18, 26)]
    assert got[102] == [("phone", 5, 13)]  # the instance is known now, wherever it stands
    assert got[101] == [] and all(got[i] == [] for i in range(12))
    out = {r["doc_id"]: r["text"] for r in redact(docs(*rows)).collect()}
    assert out[100] == "please call me at <phone> after noon" and out[0] == out[100]


def learn_brute(occ, p):
    edges, seeds = defaultdict(set), {}
    for k, inst, pats in occ:
        for pat in pats:
            edges[pat].add(inst)
        if k is not None:
            seeds[inst] = min(seeds.get(inst, k), k)
    edges = {pat: own for pat, own in edges.items() if len(own) >= p.min_support}
    known, before, rounds = {i: (k, 1.0) for i, k in seeds.items()}, None, 0
    for _ in range(p.rounds):
        rounds += 1
        trust = {}
        for pat, own in edges.items():
            for k in range(len(KINDS)):
                scores = [known[i][1] for i in own if i in known and known[i][0] == k]
                if len(scores) >= p.min_support and sum(scores) / len(own) >= p.min_confidence:
                    trust[pat, k] = round(sum(scores) / len(own), 6)
        doubt = defaultdict(float)
        for (pat, k), conf in trust.items():
            for i in edges[pat] - seeds.keys():
                doubt[i, k] += math.log(max(1 - conf, 1e-6))
        best = {}
        for (i, k), x in doubt.items():
            score = round(1 - math.exp(x), 6)
            if score >= p.min_score:
                best[i] = max(best.get(i, (0, -9)), (score, -k))
        found = {i: (-k, score) for i, (score, k) in best.items()}
        known = {i: (k, 1.0) for i, k in seeds.items()} | found
        if found == before:
            break
        before = found
    return {i: k for i, (k, _) in found.items()}, rounds


def test_rounds_equal_brute_force(spark):
    rng, p = random.Random(3), PiiParams(salts=3, min_confidence=0.5, min_score=0.55)
    occ = []
    for c in range(40):  # chains of contexts: each shares instances with the next
        for _ in range(rng.randint(5, 25)):
            i = rng.randint(3 * c, 3 * c + 8)
            seed = (c // 10) % 4 if c % 10 == 0 and rng.random() < 0.95 else None
            occ.append((seed, f"i{i}", [f"p{c}", f"q{rng.randint(0, 400)}"]))
    got = {r["inst"]: r["k"] for r in learn(spark.createDataFrame(occ, "k int, inst string, pats array<string>"), p).collect()}
    want, rounds = learn_brute(occ, p)
    assert got == want and len(want) > 10 and rounds > 2


def test_known_instances_induce_patterns(spark, docs):
    seeds = [f"please call me at +1 (415) 555-26{i:02d} after noon" for i in range(30)]
    bridge = [f"please call me at 555-01{i:02d} after noon" for i in range(5)] + [f"dial our desk 555-01{i:02d} right away" for i in range(5)]
    rows = list(enumerate([*seeds, *bridge, "dial our desk 77-1234 right away", "gate 77-9999 is shut"]))
    got = {r["doc_id"]: [(KINDS[x["k"]], x["s"], x["e"]) for x in r["added"]] for r in find_pii(docs(*rows)).collect()}
    assert got[40] == [("phone", 14, 21)] and got[41] == []
    assert all(got[i] == [("phone", 14, 22)] for i in range(35, 40))
    once = {r["doc_id"]: r["added"] for r in find_pii(docs(*rows), PiiParams(rounds=1)).collect()}
    assert once[40] == [] and once[35]


def test_many_tokens_in_one_text(spark, docs):
    text = " ".join(f"tok{i} a{i}@x.com" if i % 10 == 0 else f"tok{i} word" for i in range(100_000))
    began = time.perf_counter()
    r = find_pii(docs((1, text))).first()
    assert len(r["base"]) == 10_000 and time.perf_counter() - began < 60


def test_one_doc_id_with_two_texts(spark, docs):
    rows = [(1, "x a@b.cd"), (1, "write to longer@mail.example.org now"), (None, "+1 (415) 555-2671"), (None, None)]
    assert sorted((r["text"] or "" for r in redact(docs(*rows)).collect())) == ["", "<phone>", "write to <email> now", "x <email>"]


def test_edge_cases(spark, docs):
    many = " ".join(f"u{i}@x.com" for i in range(3000))
    rows = [(1, None), (2, ""), (3, many), (3, many), (None, "a@b.cd"), (4, "x" * 200_000 + "1" * 50_000)]
    got = sorted(((r["doc_id"], len(r["base"]), len(r["added"])) for r in find_pii(docs(*rows)).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 3000, 0), (3, 3000, 0), (None, 1, 0), (4, 0, 0)], key=str)
    r = find_pii(docs((3, many))).first()
    assert [(x["s"], x["e"]) for x in r["base"]] == [m.span() for m in re.finditer(r"\S+", many)]
    assert find_pii(docs(*rows).filter("false")).count() == 0
