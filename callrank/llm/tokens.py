"""Whole texts to token ids with a public tokenizer file.

The tokenizer normalises and splits at white space, so a text's ids are the
ids of its words in a row.  Texts in which that is plainly so (printable
ASCII and Latin-1 letters) are split here and each distinct word is encoded
once for each Python worker; every other text goes through the library whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Distinct words that a Python worker remembers; further ones are encoded again.
WORDS_KEPT = 400_000

#: Texts of these characters only: no special token, no composed or odd letter.
_PLAIN = re.compile(r"[\t\n\r -;=-~À-ÖØ-öø-ÿ]*")
#: The tokenizer file's own pre-tokenizer pattern, for those characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned integers of
    ``width`` bytes (2 if the vocabulary allows it, else 4)."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One encoder for each file and Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-token.  Printable ASCII is its own byte-level form, so the
        model can take it as it is, without the steps before."""
        if not word.isascii():
            return self._whole(word)
        return np.array([t.id for t in self.model.tokenize(word)], self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text):
            return self._whole(text)
        words, known, new = _PIECE.findall(text.lower()), self.known, {}
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known and w not in new:
                    new[w] = self._word(w)
            out = b"".join([known[w] if w in known else new[w] for w in words])
            room = WORDS_KEPT - len(known)
            known.update(list(new.items())[:room] if len(new) > room else new)
            return out
