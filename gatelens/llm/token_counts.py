"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

Words (maximal runs without Unicode white space) get the word mark in front and are segmented each for itself. An
Aho-Corasick automaton enumerates every vocabulary piece in a word; dynamic programming over end positions carries the
best score and the number of pieces on that path, no back pointers. Ties follow the tokenizers library's Unigram model:
at one end position pieces are tried from the longest, and only a strictly better score replaces; a character that is
no piece by itself may be the unknown piece at the least score minus 10, and a run of unknown pieces counts as one.

The public files hold no unigram model, so the vocabulary is the pieces of ``piece_bpe_32k.model`` with log probabilities
from their ranks by Zipf's law, -ln(rank + 1); no tokenizer is trained.

Counts of words are kept in a table per task, emptied when it holds ``memo`` words: the work follows the distinct words
and memory is bounded. Results: null and empty texts have no tokens; repeated rows are counted each for itself; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from gatelens.llm.common import two_columns

MARK = "▁"
#: Unicode White_Space without the four separators that only Python's split() knows.
EXTRA_SPACE = re.compile("[\x1c-\x1f]")
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WHITE = re.compile(f"[{SPACES}]")
WORDS = re.compile(f"[^{SPACES}]+")


def default_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with Zipf log probabilities by rank; control and byte pieces are left out."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(piece, -math.log(rank + 1)) for rank, piece in enumerate(kept, 1)]


def split_words(text: str) -> list[str]:
    return WORDS.findall(text) if EXTRA_SPACE.search(text) else text.split()


class CountingViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown_penalty: float = 10.0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if not WHITE.search(piece):  # no word holds such a piece
                self.automaton.add_word(piece, (len(piece) - 1, score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - unknown_penalty
        self.single = {p for p, _ in vocabulary if len(p) == 1}

    def count_all(self, words: list[str]) -> list[tuple[int, int]]:
        """(pieces, unknown pieces) of each marked word, in one traversal of all of them."""
        plain = [w for w in words if self.single.issuperset(w)]
        joined = "\n".join(plain)
        score, pieces = [-math.inf] * (len(joined) + 1), [0] * (len(joined) + 1)
        ends, at = [], 0
        for w in plain:
            score[at] = 0.0
            at += len(w)
            ends.append(at)
            at += 1
        for last, (back, s) in self.automaton.iter(joined):
            start = last - back
            total = s + score[start]
            if total > score[last + 1]:  # longest pieces come first at each end, and a tie keeps them
                score[last + 1] = total
                pieces[last + 1] = pieces[start] + 1
        found = dict(zip(plain, (pieces[e] for e in ends)))
        return [(found[w], 0) if w in found else self.count(w) for w in words]

    def count(self, word: str) -> tuple[int, int]:
        """(pieces, unknown pieces) of one marked word that may hold characters that are no piece."""
        n = len(word)
        score, pieces, unknowns, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        pending = self.automaton.iter(word)
        item = next(pending, None)
        for at in range(n):
            end = at + 1
            best = -math.inf
            while item is not None and item[0] == at:
                back, s = item[1]
                start = at - back
                if s + score[start] > best:
                    best = score[end] = s + score[start]
                    pieces[end], unknowns[end], open_unknown[end] = pieces[start] + 1, unknowns[start], False
                item = next(pending, None)
            if word[at] not in self.single and self.unknown + score[at] > best:
                more = 0 if open_unknown[at] else 1
                score[end] = self.unknown + score[at]
                pieces[end], unknowns[end], open_unknown[end] = pieces[at] + more, unknowns[at] + more, True
        return pieces[n], unknowns[n]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: list[tuple[str, float]] | None = None, memo: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or default_vocabulary())  # bounded by the tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = CountingViterbi(shared.value), {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(text.as_py() or "")
                if len(known) > memo:
                    known.clear()
                if fresh := list(set(words).difference(known)):
                    known.update(zip(fresh, model.count_all([MARK + w for w in fresh])))
                counts = [known[w] for w in words]
                rows.append((doc, len(words), sum(map(itemgetter(0), counts)), sum(map(itemgetter(1), counts))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                 ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
