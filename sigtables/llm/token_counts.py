"""Token counts under a unigram vocabulary: Aho-Corasick matches and a Viterbi pass that keeps only scores and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame

from sigtables.llm._text import column

SPACE_MARK = "▁"
#: What an unknown character costs below the least score, as unigram tokenizers have it.
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 250_000
RUNS = re.compile(" *[^ ]+| +")


class UnigramCounter:
    """Counts pieces of the best segmentation of a text, without building it.

    Rules as in unigram tokenizers: spaces become marks and one mark goes before the text; among paths of equal score
    the one whose last piece is longer wins; a character that is no piece costs UNKNOWN_PENALTY below the least score and
    counts as its UTF-8 bytes. No piece has a mark after another character, so a best path is made of best paths of its
    words, which are kept.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for p, score in pieces:
            if SPACE_MARK in p.lstrip(SPACE_MARK):
                raise ValueError(f"a mark stands inside {p!r}")
            if "\n" in p:
                raise ValueError("a piece has a line end")
            self.find.add_word(p, (len(p), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.characters = {p for p, _ in pieces if len(p) == 1}
        self.spaced: dict[str, tuple[int, float]] = {}
        self.bare: dict[str, tuple[int, float]] = {}

    def path(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        n = len(word)
        if self.characters.issuperset(word):  # no character is unknown: each place is reached by a piece
            top, number = [0.0] + [-inf] * n, [0] * (n + 1)
            for last, (size, score) in self.find.iter(word):
                start = last + 1 - size
                total = top[start] + score
                if total > top[last + 1]:
                    top[last + 1], number[last + 1] = total, number[start] + 1
            return number[n], top[n]
        best, count, single = [None] * (n + 1), [0] * (n + 1), [False] * n
        best[0] = 0.0
        at = 0

        def close(upto: int) -> int:
            for e in range(at, upto):
                if not single[e] and (best[e + 1] is None or best[e] + self.unknown > best[e + 1]):
                    best[e + 1], count[e + 1] = best[e] + self.unknown, count[e] + len(word[e].encode("utf-8", "surrogatepass"))
            return max(at, upto)

        for last, (size, score) in self.find.iter(word):
            at = close(last)
            if size == 1:
                single[last] = True
            start = last + 1 - size
            if best[last + 1] is None or best[start] + score > best[last + 1]:
                best[last + 1], count[last + 1] = best[start] + score, count[start] + 1
        close(n)
        return count[n], best[n] or 0.0

    def of(self, known: dict[str, tuple[int, float]], word: str, full: str) -> tuple[int, float]:
        got = known.get(word)
        if got is None:
            if len(known) >= WORDS_KEPT:
                known.clear()
            got = known[word] = self.path(full)
        return got

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation; (0, 0) for an empty text."""
        pieces, score = 0, 0.0
        for i, line in enumerate(text.split("\n") if text else ()):
            if i:  # a line end is never in a piece
                pieces, score = pieces + 1, score + self.unknown
            known, find, mark = self.spaced, self.spaced.get, SPACE_MARK
            words = line.split(" ")
            if "" in words[1:] or i == 0 and not words[0]:  # neighbouring spaces, or one at an end
                for run in RUNS.findall(line if i else f" {line}"):
                    a, b = self.of(self.bare, run, run.replace(" ", mark))
                    pieces, score = pieces + a, score + b
                continue
            for w in words[1:] if i else words:
                got = find(w) or self.of(known, w, mark + w)
                pieces += got[0]
                score += got[1]
            if i and words[0]:
                a, b = self.of(self.bare, words[0], words[0].replace(" ", mark))
                pieces, score = pieces + a, score + b
        return pieces, score


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and score of each whole text; a null text counts as empty, with no token.

    One pass without a shuffle; the vocabulary file must be readable at model_path on every executor. Repeated rows give
    repeated results; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary(model_path))
        for batch in batches:
            got = [counter.count(t or "") for t in column(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.float64())], [key, "n_tokens", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, score double")
