from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from lexispark.llm.common import documents
from lexispark.llm.queries import op8_token_counts
from lexispark.llm.tokens import SPACE, VOCABULARY, Counter, read_vocabulary, token_counts


def reference(vocab):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def full_vocabulary():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def test_query_equals_a_public_library(spark):
    d = "/root/testdata/sf0.001"
    count = reference(full_vocabulary())
    want = {r[0]: (count(r[1]), len(r[1])) for r in documents(spark, d).select("doc_id", "text").collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["n_chars"]) for r in op8_token_counts(spark, d).collect()} == want


BYTES = [(f"<0x{b:02X}>", 0.0) for b in range(256)]
SMALL = [("<unk>", 0.0), *BYTES, (SPACE, -2.0), ("a", -2.0), ("b", -3.0), ("ab", -5.0), ("ba", -5.0), (SPACE + "a", -4.0), ("aba", -7.0), ("bb", -6.0), ("\n", -1.0)]


@settings(max_examples=400, deadline=None, database=None)
@given(st.text("ab \né☃", max_size=24))
def test_ties_and_unknown_characters(text):
    counter = Counter([p for p in SMALL if not p[0].startswith("<")])
    assert counter.count(text) == reference(SMALL)(text)


def test_small_table_gives_the_same_counts():
    pieces = read_vocabulary(VOCABULARY)
    texts = [f"word{i % 50} other{i}" for i in range(300)]
    small, large = Counter(pieces, table=4), Counter(pieces)
    assert [small.count(t) for t in texts] == [large.count(t) for t in texts]
    assert len(small.known) + len(small.older) <= 4


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "x" * 200_000), (5, " \n\t ")]
    got = token_counts(docs(*rows)).collect()
    n = {r["doc_id"]: r["n_tokens"] for r in got}
    assert n[1] == n[2] == 0 and n[3] == 1 and len(got) == len(rows) and n[4] > 1000
    assert token_counts(docs(*rows).filter("false")).count() == 0
