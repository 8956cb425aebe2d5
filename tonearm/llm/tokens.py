"""Token ids of whole texts by the ``tokenizers`` library, with a memo of words.

White space is never part of a token of this vocabulary and no normalisation reaches across
it, so a text's ids are the ids of its chunks between spaces and line feeds, one after another.
Each distinct chunk is encoded once per worker. A chunk of ASCII and Latin-1 letters goes
straight to the library's BPE model; any other chunk goes through its whole pipeline.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

#: Printable ASCII and Latin-1 letters: stable under NFC, lower case is one to one.
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's own split, for those characters in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The usual map of bytes to printable characters of byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return out


class WordIds(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers.

    Holds ``limit`` chunks at most and starts anew beyond it, so memory is bounded.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.pieces: dict[str, bytes] = {}
        self.letters = {b: ord(c) for b, c in _byte_letters().items()}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(piece) <= 40:
                if len(self.pieces) >= self.limit:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            out = b""
        elif "<|" not in chunk and len(chunk) < 1000 and _SIMPLE.fullmatch(chunk):
            out = b"".join(map(self._piece, _PIECES.findall(chunk.lower())))
        else:
            out = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memo per worker process and vocabulary, kept until a task calls ``lean`` there."""
    return WordIds(path)
