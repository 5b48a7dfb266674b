"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once per worker.

A text is cut only where no pre-token of the tokenizer can reach across: at white space between words, and between
a word's last letter and the punctuation that follows it. The pieces' ids, joined, are the ids of the text. A text with
unusual white space is cut only at single spaces between two characters that aren't white space.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain

import numpy as np

from remitweave.llm.common import remembered

#: White space as either Python or the tokenizers see it; at a space next to these a text isn't cut.
CUT = re.compile(r"(?<=[^\s\x85]) (?=[^\s\x85])")
CONTROL = re.compile(r"[\x1c-\x1f]")
#: Pieces that a worker remembers at most (about 200 bytes each); then it starts anew. Ids don't depend on it.
REMEMBERED = 1_500_000
#: Pieces to a text that the tokenizer gets.
BATCH = 64


def lines_of(text: str) -> list[list[str]] | None:
    """Words by line, if single spaces and single line ends are all the white space there is."""
    lines = [x.split(" ") for x in text.split("\n")]
    return lines if list(chain.from_iterable(lines)) == text.split() else None


def stem_of(piece: str) -> tuple[str, str]:
    """A piece without the punctuation after its last letter, and that punctuation."""
    stem = piece.rstrip(string.punctuation)
    return (stem, piece[len(stem) :]) if stem and stem[-1].isalpha() else (piece, "")


class PieceEncoder:
    """``spaced``: a word that follows a space starts with it (byte-level vocabularies that mark word starts); else white
    space counts for nothing, case neither, and a word's last id is marked as such."""

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = style == "spaced"
        vocab = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocab.values()) + 1, bool)
        self.marked[[i for s, i in vocab.items() if (s.startswith("Ġ") if self.spaced else s.endswith("</w>"))]] = True
        self.line_end = self._plain(["\n"])[0] if self.spaced else b""
        self.words: dict[str, bytes] = {}  # after a space
        self.heads: dict[str, bytes] = {}  # at the start of a text or line, and punctuation after a letter

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], between: str) -> list[bytes]:
        """Ids of words made of letters only, ``BATCH`` words to a text. between: what stands before each of them."""
        out: list[bytes] = []
        groups = [words[i : i + BATCH] for i in range(0, len(words), BATCH)]
        encoded = self.tokenizer.encode_batch_fast([between + between.join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            if between == "\n":
                at = np.flatnonzero(ids == np.frombuffer(self.line_end, "<u4")[0])
                starts, stops = at + 1, [*at[1:].tolist(), len(ids)]
            elif self.spaced:
                starts = np.flatnonzero(self.marked[ids])
                stops = [*starts[1:].tolist(), len(ids)]
            else:
                stops = (np.flatnonzero(self.marked[ids]) + 1).tolist()
                starts = np.array([0, *stops[:-1]])
            if len(starts) != len(group):  # a word that the tokenizer parts after all
                out += self._plain([(between if self.spaced and between == " " else "") + w for w in group])
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops, strict=True)]
        return out

    def _learn(self, pieces: set[str], known: dict[str, bytes], between: str) -> None:
        new = pieces.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = pieces
        parts, stems = [], set()
        for p in new:
            stem, tail = (p, "") if p.isalpha() else stem_of(p)
            if not self.spaced and stem.isascii():
                stem = stem.lower()
            stems.add(stem)
            if p != stem:
                parts.append((p, stem, tail))
        need = stems.difference(known)
        letters = [s for s in need if s.isalpha()]
        others = [s for s in need if not s.isalpha()]
        known.update(zip(letters, self._together(letters, between), strict=True))
        before = " " if self.spaced and between == " " else ""
        known.update(zip(others, self._plain([before + s for s in others]), strict=True))
        tails = [t for t in {t for _, _, t in parts} if t and t not in self.heads]
        self.heads.update(zip(tails, self._plain(tails), strict=True))
        for p, stem, tail in parts:
            known[p] = known[stem] + self.heads[tail] if tail else known[stem]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self._encode_spaced(texts) if self.spaced else self._encode_unspaced(texts)

    def _encode_unspaced(self, texts: list[str | None]) -> list[bytes]:
        cuts = [[] if not t else CUT.split(t) if CONTROL.search(t) else t.split() for t in texts]
        self._learn(set().union(*cuts), self.words, " ")
        known = self.words.__getitem__
        return [b"".join(map(known, c)) for c in cuts]

    def _encode_spaced(self, texts: list[str | None]) -> list[bytes]:
        cuts = [[] if not t else lines_of(t) or [CUT.split(t)] for t in texts]
        words: set[str] = set()
        for c in cuts:
            for line in c:
                words.update(line[1:])
        self._learn(words, self.words, " ")
        self._learn({line[0] for c in cuts for line in c}, self.heads, "\n")
        known, heads, end = self.words.__getitem__, self.heads, self.line_end
        return [end.join([heads[line[0]] + b"".join(map(known, line[1:])) for line in c]) for c in cuts]


def encoder(path: str, style: str) -> PieceEncoder:
    """One for each worker process and vocabulary."""
    known = remembered("tokens")
    if (path, style) not in known:
        known[path, style] = PieceEncoder(path, style)
    return known[path, style]
