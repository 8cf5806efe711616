"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a batch go into a trie. Walking it, the forward score of a prefix (the best sum of log
probabilities of pieces that make it up) is computed once, however many pre-tokens share the prefix; a terminal
keeps the number of pieces on its best path. A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, utf8, with_results

#: Characters of pre-tokens, and for each WORD_COST more, whose counts a task keeps; beyond, it starts anew (counts are
#: the same). Bytes of text that are cut to words at once.
MOST_KEPT = 24_000_000
WORD_COST = 64
SLICE_BYTES = 4 << 20

#: What marks the start of a word in the vocabulary.
MARK = "▁"
_BYTE = re.compile(r"<0x[0-9A-F]{2}>\Z")


def read_pieces(model_path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with log probabilities by Zipf's law over their order in it.

    The public file has merge ranks, not probabilities; control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or _BYTE.match(model.id_to_piece(i)))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}


class UnigramCounter:
    """Counts of tokens of pre-tokens. A character in no piece is spelled in UTF-8 bytes, each a token.

    Of paths that score alike, the one with the longer last piece counts.
    """

    def __init__(self, pieces: dict[str, float]):
        # pieces by their characters from the last to the first: prefixes are extended at their end
        self.children: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        for piece, score in pieces.items():
            node = 0
            for c in reversed(piece):
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.score.append(None)
                node = nxt
            self.score[node] = score
        self.byte_score = min(pieces.values(), default=0.0) - 10

    def counts(self, pre_tokens) -> dict[str, int]:
        """Token counts of distinct pre-tokens. In order, each shares with the one before the longest prefix it can:
        the path of the trie from the root to it, whose scores stand already."""
        out = {}
        children, scores, byte_score = self.children, self.score, self.byte_score
        path = ""
        best, tokens = [0.0], [0]
        for word in sorted(pre_tokens):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, at, top, count = 0, end, None, 0
                while at:
                    node = children[node].get(word[at - 1])
                    if node is None:
                        break
                    at -= 1
                    own = scores[node]
                    if own is not None:
                        total = best[at] + own
                        if top is None or total >= top:
                            top, count = total, tokens[at] + 1
                if top is None or scores[children[0].get(word[end - 1], 0)] is None:
                    n = len(word[end - 1].encode())
                    total = best[end - 1] + n * byte_score
                    if top is None or total > top:
                        top, count = total, tokens[end - 1] + n
                best.append(top)
                tokens.append(count)
            path = word
            out[word] = tokens[-1]
        return out


class KeptCounts(dict):
    """Counts of pre-tokens, worked out for all new ones of a slice together. What is kept is bounded in characters."""

    def __init__(self, counter: UnigramCounter):
        super().__init__()
        self.counter, self.size = counter, 0

    def total(self, texts: list[list[str]]) -> list[int]:
        """The tokens of each text, given as its words."""
        fresh = set().union(*texts) - self.keys()
        size = sum(map(len, fresh)) + WORD_COST * len(fresh)
        if self.size + size > MOST_KEPT:
            self.clear()
            fresh = set().union(*texts)
            self.size, size = 0, sum(map(len, fresh)) + WORD_COST * len(fresh)
        self.size += size
        found = self.counter.counts([MARK + w for w in fresh])
        self.update((w[1:], n) for w, n in found.items())
        return [sum(map(self.__getitem__, t)) for t in texts]


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (long): tokens of the whole text, cut at white space into pre-tokens that start with a mark.

    Null, empty and blank texts have 0 tokens. Texts and words may be of any length; equal texts have equal counts, and
    repeated rows stay. A column named n_tokens is replaced, all others stay. An empty table gives an empty table. The
    vocabulary, one file of a fixed size, travels with the task; only texts go to Python, and only counts come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        kept = KeptCounts(UnigramCounter(shared.value))
        for batch in batches:
            _, offsets = utf8(batch)
            found = []
            for first, beyond in slices(offsets, SLICE_BYTES):
                found += kept.total([(t or "").split() for t in batch.slice(first, beyond - first).to_pylist()])
            yield pa.array(found, pa.int64())

    return with_results(docs, n_tokens=count(F.col(text_col)))
