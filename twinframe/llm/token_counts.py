"""Counting unigram tokens without building them.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries, for each end,
the best score and the number of pieces on the path that reaches it, and nothing else. Ties go as in the tokenizer: a later start
replaces an earlier one only with a strictly greater score; a start whose single character is no piece gets an unknown step that
costs the least score minus 10; consecutive unknown characters are one token, spelled in byte pieces.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

UNKNOWN_PENALTY = 10.0
#: Bytes of remembered words (with some 150 for the objects of each), and characters of the longest word that is remembered.
CACHE_BYTES, LONGEST = 96_000_000, 64
#: The characters that split words: Unicode white space.
_WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD = re.compile(r"[\x1c-\x1f]")
_counters: dict[str, UnigramCounter] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model with unigram log-probabilities: Zipf's law over the order in which the model lists them.

    Control pieces keep the places that the model gives them but score too low to be used.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    total = sum(1 / (i + 1) for i in range(size))
    out = []
    for i in range(size):
        fit = not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.get_score(i) < -1e8)
        out.append((model.id_to_piece(i), -math.log((i + 1) * total) if fit else -1000.0 - i))
    return out


class UnigramCounter:
    """Counts the tokens of words for one vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in range(256))
        self.known: dict[str, int] = {}
        self.held = 0

    def count(self, word: str) -> int:
        """Tokens of one word, of which the first character is the word mark."""
        n, singles, unknown = len(word), self.singles, self.unknown
        best: list[float | None] = [0.0] + [None] * n
        tokens, unknown_run = [0] * (n + 1), [False] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):  # at one end the longest piece, that with the earliest start, comes first
            ends[end].append(match)
        for end in range(1, n + 1):
            top, count, run = None, 0, False
            for size, score in ends[end - 1]:
                total = score + best[end - size]
                if top is None or total > top:
                    top, count = total, tokens[end - size] + 1
            char = word[end - 1]
            if char not in singles:  # the unknown step starts last, so it comes after all pieces
                total = unknown + best[end - 1]
                if top is None or total > top:
                    top, run = total, True
                    count = tokens[end - 1] + (len(char.encode()) if self.bytes else not unknown_run[end - 1])
            best[end], tokens[end], unknown_run[end] = top, count, run
        return tokens[n]

    def count_text(self, text: str) -> tuple[int, int]:
        """(words, tokens) of a whole text; words are remembered up to CACHE_BYTES, longer ones than LONGEST never."""
        words = _WORD.findall(text) if _ODD.search(text) else text.split()
        known, total = self.known, 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.count("\u2581" + word.replace(" ", "\u2581"))
                if len(word) <= LONGEST:
                    known[word] = n
                    self.held += 4 * len(word) + 150
            total += n
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        return len(words), total


def _counter(path: str) -> UnigramCounter:
    if path not in _counters:
        _counters[path] = UnigramCounter(vocabulary(path))
    return _counters[path]


def with_token_counts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Add n_words and n_tokens (long) over whole texts. Null, empty and blank texts have 0; rows that repeat or have a null id are counted each
    for itself, an empty table stays empty, and input columns of these names are replaced. ``model``: a sentencepiece file at the same path everywhere."""

    def run(texts: pa.Array) -> list[list[int]]:
        counter = _counter(model)
        both = [counter.count_text(t) if t else (0, 0) for t in texts.to_pylist()]
        return [[w for w, _ in both], [n for _, n in both]]

    return append_columns(docs, [text_col], T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]), run)
