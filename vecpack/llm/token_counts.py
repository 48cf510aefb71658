"""Token counts under a unigram vocabulary: one forward score for each shared prefix of the pre-tokens."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecpack.llm.common import with_python_columns

SPACE = "▁"
#: Pre-tokens whose counts a Python worker remembers between batches; then it forgets them all.
REMEMBERED = 600_000


class Unigram:
    """Pieces with log probabilities by Zipf's law over their ranks: p(rank) = 1 / ((rank + 1) H).

    A character that no piece covers becomes its UTF-8 bytes, one token each, at a penalty below any piece.
    """

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
        self.scores = {p: -math.log(i + 1) - total for i, p in reversed(list(enumerate(pieces)))}
        #: Lengths of the pieces of two characters or more, by their last two.
        self.lengths: dict[str, list[int]] = {}
        for end, size in sorted({(p[-2:], len(p)) for p in pieces if len(p) > 1}):
            self.lengths.setdefault(end, []).append(size)
        self.penalty = -math.log(len(pieces) + 1) - total - 10

    @staticmethod
    @lru_cache(2)
    def load(path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Unigram([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))])

    def count_all(self, words: list[str]) -> dict[str, int]:
        """Token count of each distinct word's best segmentation: of equal scores, the one of fewest tokens.

        Sorted words are the leaves of their trie in depth-first order: the forward scores on the path that
        a word shares with the one before it stay, only the new branch is computed, from the scores of all
        shorter prefixes, and the count at its end is kept.
        """
        counts: dict[str, int] = {}
        best, tokens, before = [0.0], [0], ""
        scores, lengths, penalty = self.scores, self.lengths, self.penalty
        for word in sorted(words):
            n = len(word)
            if word.startswith(before):
                shared = len(before)
            else:
                shared = 0
                for a, b in zip(before, word, strict=False):
                    if a != b:
                        break
                    shared += 1
                del best[shared + 1 :], tokens[shared + 1 :]
            for i in range(shared, n):  # word[i] ends the prefix
                c = word[i]
                size = 1 if c < "\x80" else len(c.encode())
                top, count = best[i] + size * penalty, tokens[i] + size
                if (s := scores.get(c)) is not None and (s := s + best[i]) >= top:
                    top, count = s, (tokens[i] + 1 if s > top else min(count, tokens[i] + 1))
                for length in lengths.get(word[i - 1 : i + 1], ()) if i else ():
                    j = i + 1 - length
                    if j < 0:
                        break
                    if (s := scores.get(word[j : i + 1])) is not None:
                        s += best[j]
                        if s > top or s == top and tokens[j] + 1 < count:
                            top, count = s, tokens[j] + 1
                best.append(top)
                tokens.append(count)
            counts[word], before = tokens[-1], word
        return counts


def count_tokens(df: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its ``text``, with n_words (pre-tokens by ``pattern``) and n_tokens under the pieces of ``vocabulary``.

    ``vocabulary`` is the place of a sentencepiece model. Null and empty texts have no words. Each batch
    puts its distinct pre-tokens in one trie; counts are remembered across batches within a fixed bound.
    No shuffle; whole texts; repeated rows alike; columns named like a result are replaced.
    """
    known: dict[str, int] = {}

    def compute(texts):
        import regex

        model, find = Unigram.load(vocabulary), regex.compile(pattern).findall
        words = [find(t) if t else [] for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = {w for ws in words for w in ws if w not in known}
        plain = {w: SPACE + w[1:] if w[0] == " " else w for w in new}
        counts = model.count_all(list(set(plain.values())))
        known.update((w, counts[p]) for w, p in plain.items())
        return [[len(ws) for ws in words], [sum(map(known.__getitem__, ws)) for ws in words]]

    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens")]
    return with_python_columns(df, [text], compute, fields, drop=(text,))
