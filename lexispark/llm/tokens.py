"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries only the best score and its number of
pieces.  Tie rules are those of public unigram tokenizers: of equal scores the
longest last piece (the earliest start) wins; a character that no single-character piece
covers costs the least vocabulary score less ten and counts as its UTF-8
bytes.

Texts are cut before every blank, a word carries its blank as U+2581, and the first word gets one too
unless the text starts with a blank; no piece spans a cut, so a word's count does not
depend on its text and a bounded table of counted words saves most of the work.

The vocabulary (its size is bounded by the tokenizer) is read once from a path
that is a parameter, checked against ``max_pieces`` and broadcast.

Edge cases: null and empty texts have 0 tokens; other columns are ignored;
repeated rows give repeated results; a single word of any length is handled
in memory linear in that word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Public SentencePiece file whose pieces and scores serve as unigram vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class TokenParams:
    path: str = VOCABULARY
    max_pieces: int = 1_000_000
    #: counted words that a worker keeps
    table: int = 500_000


def read_vocabulary(path: str, max_pieces: int = 1_000_000) -> list[tuple[str, float]]:
    """Pieces with their scores; control, unknown and byte pieces are no matches in text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.get_piece_size() > max_pieces:
        raise ValueError(f"more than {max_pieces} pieces")
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not skip(i)]


class Counter:
    """Counts the tokens of texts; one per worker process."""

    def __init__(self, pieces: list[tuple[str, float]], table: int = 500_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        #: counted words; the older half goes when the younger one is full
        self.table, self.known, self.older = table // 2, {}, {}

    def viterbi(self, word: str) -> int:
        """Pieces of the best segmentation of one word, marker included."""
        n = len(word)
        score, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        done, single = 0, False  # the end position in work; whether one of its pieces has one character

        def close(upto: int) -> None:
            """Ends without a single-character piece may be reached by an unknown character."""
            nonlocal done, single
            while done < upto:
                if done and not single:
                    s = score[done - 1] + self.unknown
                    if s > score[done]:
                        score[done] = s
                        count[done] = count[done - 1] + len(word[done - 1].encode("utf-8", "replace"))
                done += 1
                single = False

        if len(self.automaton):
            for last, (size, worth) in self.automaton.iter(word):  # longest first at each end
                end = last + 1
                if end > done:
                    close(end)
                s = score[end - size] + worth
                if s > score[end]:
                    score[end] = s
                    count[end] = count[end - size] + 1
                if size == 1:
                    single = True
        close(n + 1)
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        known, total = self.known, 0
        for part in text.split(SPACE)[1:]:
            n = known.get(part)
            if n is None:
                n = self.older.get(part)
                if n is None:
                    n = self.viterbi(SPACE + part)
                if len(part) <= 64:
                    if len(known) >= self.table:
                        self.older, self.known = known, {}
                        known = self.known
                    known[part] = n
            total += n
        return total


def token_counts(docs: DataFrame, params: TokenParams | None = None) -> DataFrame:
    """doc_id, n_tokens, n_chars (long) for each row of ``docs`` (doc_id, text)."""
    p = params or TokenParams()
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(p.path, p.max_pieces))
    table = p.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, table)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([counter.count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())],
                names=["doc_id", "n_tokens", "n_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_chars bigint")
