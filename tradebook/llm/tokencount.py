"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece at every place of a word; a dynamic programme over
end places carries the best score and the number of pieces on the best path, and nothing else. Ties and unknown
characters go as in the tokenizers library's Unigram model: of equal scores the piece that begins
first (the longest) stays, and neighbouring unknown characters are one token.

No unigram vocabulary lies in the box; the pieces and scores of a sentencepiece file are read as one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.book import register, table
from tradebook.llm.common import small_batches

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers; the memory starts anew when it is full.
REMEMBERED = 1_000_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary]


class Counter:
    """Counts the tokens of texts, a word (with the space before it) at a time."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """Tokens on the best path through ``text``."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        at = 0  # places up to here are final

        def settle(end: int) -> None:
            # an unknown single character is the last candidate for its end
            nonlocal at
            while at < end:
                if text[at] not in self.single:
                    found = self.unknown + score[at]
                    if score[at + 1] is None or found > score[at + 1]:
                        score[at + 1], unknown[at + 1] = found, True
                        count[at + 1] = count[at] + (not unknown[at])
                at += 1

        for last, (size, value) in self.automaton.iter(text):
            end = last + 1
            if end - 1 > at:
                settle(end - 1)
            found = value + score[end - size]
            if score[end] is None or found > score[end]:
                score[end], count[end], unknown[end] = found, count[end - size] + 1, False
        settle(n)
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        spaced = text.replace(" ", SPACE)
        words = (spaced[1:] if spaced[0] == SPACE else spaced).split(SPACE)
        known = self.known
        for word in set(words).difference(known):
            if len(known) > REMEMBERED:
                known.clear()
            known[word] = self.word(SPACE + word)
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:  # the memory was emptied on the way
            return sum(self.word(SPACE + word) for word in words)


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """Kept by a worker for all its tasks."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every row of ``docs`` (doc_id, text).

    Spaces become a mark, one is put in front, and each mark begins a word. Null and empty texts have
    no tokens. Rows repeat as given; other columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(path)
        for texts in parts:
            yield pd.Series([tokens.text(t or "") for t in texts], dtype="int64")

    return docs.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), count("text").alias("n_tokens")
    )


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under the pieces and scores of the sentencepiece vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


register("op9_token_counts", op9_token_counts)
