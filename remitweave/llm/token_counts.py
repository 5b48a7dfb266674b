"""Token counts under a unigram model, by dynamic programming shared along a trie of pre-tokens.

A task collects the distinct pre-tokens (words with a word-start mark) of a slice of its rows, puts those it hasn't
met into a trie, and walks the trie depth first. At each node it computes once, for all words below it, the
best score of segmenting the prefix into pieces and the number of pieces; at a word's last node these are the
word's terminal counts. A document's count is the sum over its words. Nothing is shuffled.

Defined cases: null and empty texts have no tokens; a character in no piece counts as one token for each of its
UTF-8 bytes; of segmentations with equal scores the one with the longest last piece counts, at every prefix; repeated
rows are counted each; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from remitweave.llm.common import map_arrow, remembered

MARK = "▁"
#: Words that a worker remembers at most; then it starts anew. Counts don't depend on it.
REMEMBERED = 1_000_000


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities in proportion to 1 / rank, for a vocabulary listed by falling frequency."""
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}


def load_pieces(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model, in order."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    special = [i for i in range(sp.vocab_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)]
    skip = set(special)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if i not in skip]


class UnigramCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.known: dict[str, tuple[int, float]] = {}
        # pieces by their last character, then the one before, ...: one walk back from a prefix's end meets all that end there
        self.back: dict = {}
        for piece, score in scores.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score

    def learn(self, words: set[str]) -> None:
        """Terminal counts of words not met before."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        trie: dict = {}
        for word in new:
            node = trie
            for c in MARK + word:
                node = node.setdefault(c, {})
            node[""] = word
        chars: list[str] = []
        best, pieces = [0.0], [0]
        stack = [(c, child, 1) for c, child in trie.items()]
        back, unknown = self.back, self.unknown
        while stack:
            c, node, depth = stack.pop()
            del chars[depth - 1 :], best[depth:], pieces[depth:]
            chars.append(c)
            n_bytes = len(c.encode("utf-8", "surrogatepass"))
            top, count = best[depth - 1] + unknown * n_bytes, pieces[depth - 1] + n_bytes
            walk, at, found = back, depth, None
            while at and (walk := walk.get(chars[at - 1])) is not None:
                at -= 1
                if "" in walk:
                    s = best[at] + walk[""]
                    if found is None or s >= found:
                        found, count_found = s, pieces[at] + 1
            if found is not None and found >= top:
                top, count = found, count_found
            best.append(top)
            pieces.append(count)
            for key, child in node.items():
                if key == "":
                    self.known[child] = (count, top)
                else:
                    stack.append((key, child, depth + 1))

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """Words, tokens and log score of each text."""
        bags = [Counter(t.split()) if t else {} for t in texts]
        self.learn(set().union(*bags))
        known, out = self.known, []
        for bag in bags:
            words = tokens = 0
            score = 0.0
            for w, n in bag.items():
                t, s = known[w]
                words += n
                tokens += n * t
                score += n * s
            out.append((words, tokens, score))
        return out


def counter(path: str) -> UnigramCounter:
    """One for each worker process and vocabulary."""
    known = remembered("token_counts")
    if path not in known:
        known[path] = UnigramCounter(zipf_scores(load_pieces(path)))
    return known[path]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_tokens, score (log probability, rounded to 6 places)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = counter(vocabulary).count(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.int64()),
                pa.array([round(x[2], 6) for x in found], pa.float64()),
            ],
            ["id", "n_words", "n_tokens", "score"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, n_words bigint, n_tokens bigint, score double", memory="token_counts")
